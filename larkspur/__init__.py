"""Document analytics compiled to Spark plans."""
