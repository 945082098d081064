"""Registered queries over the driver's tables, each beside the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import hlc, routing
from larkspur.operators import kv, observe, policy, txn, updates, vectors
from larkspur.operators.find import find, found_total, live, project
from larkspur.operators.filters import match
from larkspur.plans.pipeline import aggregate
from larkspur.sources.catalog import Catalog, backup, changes, get, get_document, has_gap, key_range, load, newest, restore_into, snapshot, uses_index, write_indexed, write_log
from larkspur.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their labels, null where there are none."""
    docs = load(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(load(spark, d, "labels"), "doc_id", "left")


LABELLED = "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
LINE = "l_orderkey, l_linenumber, l_quantity"


def filtered(name: str, table: str, spec: dict, columns: str, where: str) -> None:
    """A filter query: the rows of table that spec matches, and the SQL condition that means the same."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = labelled(spark, d) if table == "labelled" else load(spark, d, table)
        return match(df, spec).select(*(c.strip() for c in columns.split(",")))

    QUERIES[name] = run
    SQL[name] = f"SELECT {columns} FROM {LABELLED if table == 'labelled' else table} WHERE {where}"


filtered("flt_eq", "lineitem", {"l_returnflag": "R"}, LINE, "l_returnflag = 'R'")
filtered("flt_eq_null", "labelled", {"quality": None}, "doc_id, quality", "quality IS NULL")
filtered("flt_ne", "labelled", {"quality": {"$ne": 1}}, "doc_id, quality", "quality IS DISTINCT FROM 1")
filtered("flt_gt", "lineitem", {"l_quantity": {"$gt": 45}}, LINE, "l_quantity > 45")
filtered("flt_gte", "labelled", {"quality": {"$gte": 1}}, "doc_id, quality", "coalesce(quality >= 1, false)")
filtered("flt_lt", "labelled", {"quality": {"$lt": 1}}, "doc_id, quality", "quality IS NULL OR quality < 1")
filtered("flt_lte", "part", {"p_size": {"$lte": 5}}, "p_partkey, p_size", "p_size <= 5")
filtered("flt_null_literal", "labelled", {"quality": {"$gt": None}}, "doc_id, quality", "quality IS NOT NULL")
filtered("flt_in", "orders", {"o_orderstatus": {"$in": ["F", "P"]}}, "o_orderkey, o_orderstatus", "o_orderstatus IN ('F', 'P')")
filtered("flt_in_null", "labelled", {"quality": {"$in": [0, None]}}, "doc_id, quality", "quality IS NULL OR quality = 0")
filtered("flt_nin", "labelled", {"quality": {"$nin": [1]}}, "doc_id, quality", "NOT coalesce(quality IN (1), false)")
filtered("flt_exists", "labelled", {"quality": {"$exists": True}}, "doc_id, quality", "quality IS NOT NULL")
filtered("flt_regex", "part", {"p_name": {"$regex": "^[a-m].*e"}}, "p_partkey, p_name", "regexp_matches(p_name, '^[a-m].*e')")
filtered("flt_contains_str", "part", {"p_type": {"$contains": "S"}}, "p_partkey, p_type", "contains(p_type, 'S')")
filtered("flt_and", "lineitem", {"$and": [{"l_quantity": {"$gte": 10, "$lt": 20}}, {"l_discount": {"$gt": 0.05}}]}, LINE, "l_quantity >= 10 AND l_quantity < 20 AND l_discount > 0.05")
filtered("flt_or", "labelled", {"$or": [{"quality": 0}, {"toxic": 1}]}, "doc_id, quality, toxic", "coalesce(quality = 0, false) OR coalesce(toxic = 1, false)")
filtered("flt_or_empty", "part", {"$or": []}, "p_partkey", "false")
filtered("flt_nor", "labelled", {"$nor": [{"quality": 1}, {"lang": "en"}]}, "doc_id, quality, lang", "NOT (coalesce(quality = 1, false) OR lang = 'en')")
filtered("flt_not", "labelled", {"$not": {"quality": {"$gte": 1}}}, "doc_id, quality", "NOT coalesce(quality >= 1, false)")
filtered("flt_rank_fold", "orders", {"o_orderpriority": {"$gt": 3}, "o_totalprice": {"$lt": "a"}}, "o_orderkey", "true")
filtered("flt_unknown_op", "part", {"p_size": {"$near": 3}}, "p_partkey", "false")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def q_flt_path(spark, d):
    rows = load(spark, d, "events").select("event_id", F.from_json("props", "k long").alias("props"))
    return match(rows, {"props.k": {"$gte": 50}}).select("event_id", F.col("props.k").alias("k"))


@query("SELECT doc_id FROM documents WHERE list_contains(string_split(text, ' '), 'the')")
def q_flt_contains_arr(spark, d):
    rows = load(spark, d, "documents").select("doc_id", F.split("text", " ").alias("words"))
    return match(rows, {"words": {"$contains": "the"}}).select("doc_id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def q_find_sort_skip_limit(spark, d):
    return find(load(spark, d, "orders"), {"o_orderstatus": "F"}, {"o_totalprice": -1}, 10, 20, {"o_totalprice": 1}, "o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100")
def q_find_default_limit(spark, d):
    return find(load(spark, d, "orders"), key="o_orderkey").select("o_orderkey")


@query("SELECT count(*) AS total FROM orders WHERE o_totalprice > 100000")
def q_find_total(spark, d):
    return found_total(load(spark, d, "orders"), {"o_totalprice": {"$gt": 100000}})


EVENT_MS = "CAST(epoch_us(ts) // 1000 AS BIGINT)"


def enveloped(spark, d):
    """Events as documents with a time to live, some of them tombstones."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return load(spark, d, "events").select(
        F.col("event_id").alias("_id"), "user_id", "value", ms.alias("created_at"), (F.col("event_id") % 7 * 86400).alias("ttl"), (F.col("event_id") % 13 == 0).alias("_tombstone")
    )


@query(f"SELECT event_id AS _id, value FROM events WHERE event_id % 13 <> 0 AND (event_id % 7 = 0 OR 1704672000000 <= {EVENT_MS} + event_id % 7 * 86400000)")
def q_find_ttl(spark, d):
    return find(enveloped(spark, d), limit=None, now_ms=1704672000000).select("_id", "value")


@query("SELECT event_id AS _id, user_id FROM events WHERE event_id % 13 <> 0")
def q_tombstone_hide(spark, d):
    return find(enveloped(spark, d), limit=None).select("_id", "user_id")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def q_proj_include(spark, d):
    return project(load(spark, d, "customer"), {"c_name": 1, "c_acctbal": 1}, "c_custkey")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def q_proj_exclude(spark, d):
    return project(load(spark, d, "customer"), {"c_acctbal": 0, "c_mktsegment": 0}, "c_custkey")


@query("SELECT c_name, c_nationkey AS nation FROM customer")
def q_proj_rename(spark, d):
    return aggregate(load(spark, d, "customer"), [{"$project": {"nation": "$c_nationkey", "c_name": 1}}])


@query("SELECT count(*) AS n FROM lineitem WHERE l_discount >= 0.05 AND l_quantity < 24")
def q_count_filter(spark, d):
    return match(load(spark, d, "lineitem"), {"l_discount": {"$gte": 0.05}, "l_quantity": {"$lt": 24}}).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag AS _id, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 2) AS avg_price, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1")
def q_pipeline_minimum(spark, d):
    stages = [{"$match": {"l_quantity": {"$gt": 25}}}, {"$group": {"_id": "$l_returnflag", "qty": {"$sum": "$l_quantity"}, "avg_price": {"$avg": "$l_extendedprice"}, "n": {"$count": {}}}}, {"$sort": {"_id": 1}}]
    return aggregate(load(spark, d, "lineitem"), stages).select("_id", F.round("qty", 2).alias("qty"), F.round("avg_price", 2).alias("avg_price"), "n")


def grouped(name: str, stages: list, sql: str, table: str = "labelled", order: str = "doc_id") -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = labelled(spark, d) if table == "labelled" else load(spark, d, table)
        out = aggregate(df, stages, order=order)
        return out.select(*(F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))

    QUERIES[name] = run
    SQL[name] = sql.format(labelled=LABELLED)


grouped("grp_sum", [{"$group": {"_id": "$l_linestatus", "s": {"$sum": "$l_extendedprice"}}}], "SELECT l_linestatus AS _id, round(sum(l_extendedprice), 4) AS s FROM lineitem GROUP BY 1", "lineitem", "l_orderkey")
grouped("grp_sum_literal", [{"$group": {"_id": "$lang", "n": {"$sum": 1}}}], "SELECT lang AS _id, CAST(count(*) AS DOUBLE) AS n FROM {labelled} GROUP BY 1")
grouped("grp_sum_nonnum", [{"$group": {"_id": "$lang", "s": {"$sum": "$quality"}, "t": {"$sum": "$source"}}}], "SELECT lang AS _id, CAST(sum(coalesce(quality, 1)) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS t FROM {labelled} GROUP BY 1")
grouped("grp_avg", [{"$group": {"_id": "$lang", "a": {"$avg": "$n_chars"}}}], "SELECT lang AS _id, round(avg(n_chars), 4) AS a FROM {labelled} GROUP BY 1")
grouped("grp_avg_nulls", [{"$group": {"_id": "$lang", "a": {"$avg": "$quality"}}}], "SELECT lang AS _id, round(sum(coalesce(quality, 0)) / count(*), 4) AS a FROM {labelled} GROUP BY 1")
grouped("grp_minmax", [{"$group": {"_id": "$source", "lo": {"$min": "$n_chars"}, "hi": {"$max": "$n_chars"}}}], "SELECT source AS _id, min(n_chars) AS lo, max(n_chars) AS hi FROM {labelled} GROUP BY 1")
grouped("grp_minmax_seed", [{"$group": {"_id": "$source", "lo": {"$min": "$quality"}, "hi": {"$max": "$quality"}, "first": {"$min": "$lang"}}}], "SELECT source AS _id, CASE WHEN list(quality ORDER BY doc_id)[1] IS NOT NULL THEN min(quality) END AS lo, max(quality) AS hi, list(lang ORDER BY doc_id)[1] AS first FROM {labelled} GROUP BY 1")
grouped("grp_count", [{"$group": {"_id": "$event_type", "n": {"$count": {}}}}], "SELECT event_type AS _id, count(*) AS n FROM events GROUP BY 1", "events", "event_id")
grouped("grp_null_key", [{"$group": {"_id": None, "n": {"$count": {}}}}], "SELECT CAST(NULL AS VARCHAR) AS _id, count(*) AS n FROM events HAVING count(*) > 0", "events", "event_id")
grouped("grp_null_group", [{"$group": {"_id": "$quality", "n": {"$count": {}}}}], "SELECT quality AS _id, count(*) AS n FROM {labelled} GROUP BY 1")
grouped("grp_empty_input", [{"$match": {"lang": "xx"}}, {"$group": {"_id": None, "n": {"$count": {}}}}], "SELECT CAST(NULL AS VARCHAR) AS _id, count(*) AS n FROM {labelled} WHERE lang = 'xx' HAVING count(*) > 0")
grouped("agg_sort_limit_skip", [{"$sort": {"o_totalprice": -1}}, {"$skip": 5}, {"$limit": 15}, {"$project": {"o_orderkey": 1, "o_totalprice": 1}}], "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders ORDER BY orders.o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 5", "orders", "o_orderkey")


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS _id, count(*) AS n FROM events GROUP BY 1")
def q_grp_nested_key(spark, d):
    rows = load(spark, d, "events").select("event_id", F.from_json("props", "k long").alias("props"))
    return aggregate(rows, [{"$group": {"_id": "$props.k", "n": {"$count": {}}}}], order="event_id")


@query("WITH w AS (SELECT unnest(string_split(text, ' ')) AS _id FROM documents) SELECT _id, count(*) AS n FROM w GROUP BY 1 HAVING count(*) > 20")
def q_unwind_words(spark, d):
    rows = load(spark, d, "documents").select("doc_id", F.split("text", " ").alias("words"))
    return aggregate(rows, [{"$unwind": "$words"}, {"$group": {"_id": "$words", "n": {"$count": {}}}}, {"$match": {"n": {"$gt": 20}}}], order="doc_id")


def turned(spark, d):
    rows = load(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.when(F.col("role") == "assistant", F.col("turn"))).alias("turns"))
    return rows


TURNED = "(SELECT conv_id, list(turn) FILTER (WHERE role = 'assistant') AS turns FROM conversations GROUP BY conv_id)"


@query(f"SELECT conv_id, unnest(CASE WHEN turns IS NULL OR len(turns) = 0 THEN [NULL] ELSE turns END) AS turns FROM {TURNED}")
def q_unwind_preserve(spark, d):
    return aggregate(turned(spark, d), [{"$unwind": {"path": "$turns", "preserveNullAndEmptyArrays": True}}], order="conv_id")


@query("SELECT r_regionkey, r_name FROM region")
def q_unwind_scalar(spark, d):
    return aggregate(load(spark, d, "region"), [{"$unwind": "$r_name"}], order="r_regionkey")


@query("SELECT n.n_nationkey, n.n_name, coalesce(list(s.s_suppkey ORDER BY s.s_suppkey) FILTER (WHERE s.s_suppkey IS NOT NULL), []) AS suppliers FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY 1, 2")
def q_lookup_array(spark, d):
    suppliers = load(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    out = aggregate(load(spark, d, "nation"), [{"$lookup": {"from": "supplier", "localField": "n_nationkey", "foreignField": "s_nationkey", "as": "suppliers"}}], {"supplier": suppliers})
    return out.select("n_nationkey", "n_name", F.transform("suppliers", lambda s: s["s_suppkey"]).alias("suppliers"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def q_lookup_unwind(spark, d):
    stages = [{"$lookup": {"from": "customer", "localField": "o_custkey", "foreignField": "c_custkey", "as": "c"}}, {"$unwind": "$c"}, {"$project": {"o_orderkey": 1, "c_name": "$c.c_name"}}]
    return aggregate(load(spark, d, "orders"), stages, {"customer": load(spark, d, "customer")}, order="o_orderkey")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_lookup_anti(spark, d):
    stages = [{"$lookup": {"from": "labels", "localField": "doc_id", "foreignField": "doc_id", "as": "l"}}, {"$match": {"l": []}}, {"$project": {"doc_id": 1, "lang": 1}}]
    return aggregate(load(spark, d, "documents").select("doc_id", "lang"), stages, {"labels": load(spark, d, "labels")}, order="doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def q_lookup_semi(spark, d):
    stages = [{"$lookup": {"from": "labels", "localField": "doc_id", "foreignField": "doc_id", "as": "l"}}, {"$match": {"l": {"$ne": []}}}, {"$project": {"doc_id": 1, "lang": 1}}]
    return aggregate(load(spark, d, "documents").select("doc_id", "lang"), stages, {"labels": load(spark, d, "labels")}, order="doc_id")


@query("SELECT r.r_regionkey, list(n.n_name ORDER BY x.pos) AS names FROM region r, (SELECT unnest([0, 1, 1]) AS step, unnest([0, 1, 2]) AS pos) x JOIN nation n ON n.n_nationkey = r.r_regionkey + x.step GROUP BY 1")
def q_lookup_local_array(spark, d):
    local = load(spark, d, "region").select("r_regionkey", F.array(F.col("r_regionkey"), F.col("r_regionkey") + 1, F.col("r_regionkey") + 1).alias("ks"))
    nation = load(spark, d, "nation").select("n_nationkey", "n_name")
    out = aggregate(local, [{"$lookup": {"from": "nation", "localField": "ks", "foreignField": "n_nationkey", "as": "ns"}}], {"nation": nation}, order="r_regionkey")
    return out.select("r_regionkey", F.transform("ns", lambda n: n["n_name"]).alias("names"))


@query("SELECT n.n_nationkey, list(r.r_name ORDER BY r.r_regionkey) AS regions FROM nation n JOIN region r ON n.n_nationkey IN (r.r_regionkey, r.r_regionkey + 5) GROUP BY 1")
def q_lookup_foreign_array(spark, d):
    foreign = load(spark, d, "region").select("r_regionkey", "r_name", F.array(F.col("r_regionkey"), F.col("r_regionkey") + 5).alias("ks"))
    stages = [{"$lookup": {"from": "region", "localField": "n_nationkey", "foreignField": "ks", "as": "rs"}}, {"$match": {"rs": {"$ne": []}}}]
    out = aggregate(load(spark, d, "nation"), stages, {"region": foreign}, order="n_nationkey")
    return out.select("n_nationkey", F.transform("rs", lambda r: r["r_name"]).alias("regions"))


@query("""SELECT n_name AS _id, round(sum(l_extendedprice), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_quantity > 30 AND r_name = 'ASIA' GROUP BY 1 ORDER BY sum(l_extendedprice) DESC LIMIT 3""")
def q_pipeline_multi(spark, d):
    names = {n: load(spark, d, n) for n in ("orders", "customer", "nation", "region")}
    join = lambda table, local, key, name: [{"$lookup": {"from": table, "localField": local, "foreignField": key, "as": name}}, {"$unwind": f"${name}"}]
    stages = [{"$match": {"l_quantity": {"$gt": 30}}}, *join("orders", "l_orderkey", "o_orderkey", "o"), *join("customer", "o.o_custkey", "c_custkey", "c"), *join("nation", "c.c_nationkey", "n_nationkey", "n"), *join("region", "n.n_regionkey", "r_regionkey", "r")]
    stages += [{"$match": {"r.r_name": "ASIA"}}, {"$group": {"_id": "$n.n_name", "revenue": {"$sum": "$l_extendedprice"}, "n": {"$count": {}}}}, {"$sort": {"revenue": -1}}, {"$limit": 3}]
    return aggregate(load(spark, d, "lineitem"), stages, names, order=["l_orderkey", "l_linenumber"]).select("_id", F.round("revenue", 2).alias("revenue"), "n")


def updated(name: str, update: dict, columns: str, sql: str) -> None:
    """An update of parts that hold tags: two letters of the name and the brand."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        part = load(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice", F.array(F.substring("p_name", 1, 1), F.substring("p_name", 2, 1), F.substring("p_name", 1, 1)).alias("tags"))
        out = updates.apply_update(part, update)
        return out.select(*(F.round(c, 4).alias(c) if dict(out.dtypes)[c] == "double" else F.col(c) for c in columns.split(", ")))

    QUERIES[name] = run
    SQL[name] = f"WITH t AS (SELECT *, [substr(p_name, 1, 1), substr(p_name, 2, 1), substr(p_name, 1, 1)] AS tags FROM part) SELECT {sql} FROM t"


updated("upd_set", {"$set": {"p_size": 7, "note": "x"}}, "p_partkey, p_size, note", "p_partkey, 7 AS p_size, 'x' AS note")
updated("upd_unset", {"$unset": ["p_size", "tags"]}, "p_partkey, p_name, p_retailprice", "p_partkey, p_name, round(p_retailprice, 4) AS p_retailprice")
updated("upd_inc", {"$inc": {"p_size": 2, "p_name": 3, "fresh": 1}}, "p_partkey, p_size, p_name, fresh", "p_partkey, CAST(p_size + 2 AS DOUBLE) AS p_size, CAST(3 AS DOUBLE) AS p_name, CAST(1 AS DOUBLE) AS fresh")
updated("upd_mul", {"$mul": {"p_retailprice": 1.5, "fresh": 4}}, "p_partkey, p_retailprice, fresh", "p_partkey, round(p_retailprice * 1.5, 4) AS p_retailprice, CAST(0 AS DOUBLE) AS fresh")
updated("upd_push", {"$push": {"tags": "z", "p_size": 1}}, "p_partkey, tags, p_size", "p_partkey, list_append(tags, 'z') AS tags, [1] AS p_size")
updated("upd_pull", {"$pull": {"tags": "a", "p_size": 1}}, "p_partkey, tags, p_size", "p_partkey, list_filter(tags, lambda x: x <> 'a') AS tags, p_size")
updated("upd_addtoset", {"$addToSet": {"tags": "a"}}, "p_partkey, tags", "p_partkey, CASE WHEN list_contains(tags, 'a') THEN tags ELSE list_append(tags, 'a') END AS tags")
updated("upd_rename", {"$rename": {"p_name": "title", "nothing": "other"}}, "p_partkey, title", "p_partkey, p_name AS title")
updated("upd_bare", {"label": "b"}, "p_partkey, label", "p_partkey, 'b' AS label")


@query("SELECT p_partkey AS _id, CASE WHEN p_partkey <= 10 AND p_size = 1 THEN 2 ELSE p_size END AS version, CASE WHEN p_partkey <= 10 AND p_size = 1 THEN 'UPDATED' WHEN p_partkey <= 10 THEN 'CONFLICT' ELSE 'UNCHANGED' END AS status, CASE WHEN p_partkey <= 10 AND p_size = 1 THEN 'new' ELSE p_name END AS p_name FROM part")
def q_upd_versioned(spark, d):
    rows = load(spark, d, "part").select(F.col("p_partkey").alias("_id"), F.col("p_size").alias("version"), F.lit(0).alias("updated_at"), "p_name")
    return updates.update_versioned(rows, {"$set": {"p_name": "new"}}, 5, list(range(11)), 1).select("_id", "version", "status", "p_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 0")
def q_write_insert_dedupe(spark, d):
    all_rows = load(spark, d, "customer").select("c_custkey", "c_name")
    new = all_rows.withColumn("c_name", F.lit("new"))
    return txn.insert_new(all_rows.where("c_custkey % 3 <> 0"), new.unionByName(new), "c_custkey")


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2 HAVING count(*) > 1")
def q_write_unique_violations(spark, d):
    return txn.unique_violations(load(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


@query("SELECT c_custkey AS _id, CASE WHEN c_custkey % 10 = 1 THEN 'changed' ELSE c_name END AS value, CASE WHEN c_custkey % 10 = 1 THEN 2 ELSE 1 END AS version FROM customer WHERE c_custkey % 10 <> 2 UNION ALL SELECT -c_custkey, 'added', 1 FROM customer WHERE c_custkey % 10 = 3")
def q_txn_apply(spark, d):
    base = load(spark, d, "customer").select(F.col("c_custkey").alias("_id"), F.col("c_name").alias("value"), F.lit(1).alias("version"), F.lit(0).alias("updated_at"))
    op = lambda n, kind, key, value, seq: base.where(f"_id % 10 = {n}").select((F.col("_id") * 10 + seq).alias("seq"), F.lit(kind).alias("op"), key.alias("_id"), F.lit(value).alias("value"), F.lit(0).alias("expected_version"))
    ops = op(1, "update", F.col("_id"), "first", 0).unionByName(op(1, "update", F.col("_id"), "changed", 1)).unionByName(op(2, "remove", F.col("_id"), None, 2)).unionByName(op(3, "insert", -F.col("_id"), "added", 3))
    return txn.execute(base, ops, 1)[0].select("_id", "value", "version")


UNIT = [1.0, -0.5] * 32
_Q = "CAST(" + str(UNIT) + " AS DOUBLE[])"
_E = "CAST(embedding AS DOUBLE[])"
_COS = f"list_dot_product({_E}, {_Q}) / (sqrt(list_dot_product({_E}, {_E})) * sqrt(list_dot_product({_Q}, {_Q})) + 1e-10)"


def searched(name: str, metric: str, expression: str, floor: float = -1e9) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = vectors.search(load(spark, d, "embeddings"), UNIT, 10, metric, floor)
        return out.select("vec_id", F.round("score", 5).alias("score"))

    QUERIES[name] = run
    SQL[name] = f"SELECT vec_id, round({expression}, 5) AS score FROM embeddings WHERE {expression} >= {floor} ORDER BY {expression} DESC, vec_id LIMIT 10"


searched("vec_cosine", "cosine", _COS)
searched("vec_dot", "dot", f"list_dot_product({_E}, {_Q})")
searched("vec_euclidean", "euclidean", f"1 / (1 + list_distance({_E}, {_Q}))")
searched("vec_min_score", "cosine", _COS, 0.25)


@query("""WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS s FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, round(s, 5) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 3""")
def q_vec_batch_knn(spark, d):
    rows = load(spark, d, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vectors.search_many(rows, asked, 3, "dot").select("query_id", "vec_id", F.round("score", 5).alias("score"))


SALES = [policy.Policy("own", "SELECT", ["sales"], "o_orderstatus = 'F' AND NOT o_totalprice < 50000"), policy.Policy("urgent", "ALL", [], "o_orderpriority IN ('1-URGENT', '2-HIGH')"), policy.Policy("off", "ALL", [], "", enabled=False)]


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def q_rls_filter(spark, d):
    return policy.secure(load(spark, d, "orders"), SALES, "SELECT", {"guest"}).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND NOT o_totalprice < 50000) OR o_orderpriority IN ('1-URGENT', '2-HIGH')")
def q_rls_multi_policy(spark, d):
    return policy.secure(load(spark, d, "orders"), SALES, "SELECT", {"sales"}).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE false")
def q_rls_deny(spark, d):
    return policy.secure(load(spark, d, "orders"), [policy.Policy("broken", using="o_orderstatus = = 'F'")]).select("o_orderkey")


@query("SELECT event_type AS role, (event_type = 'click' OR event_type LIKE 'p%') AS allowed FROM events GROUP BY event_type")
def q_priv_check(spark, d):
    permissions = [{"role": "click", "target": {"type": "collection", "name": ""}, "privileges": policy.grant(0, "SELECT", "INSERT")}]
    roles = load(spark, d, "events").select(F.col("event_type").alias("role")).distinct()
    names = [r[0] for r in roles.collect()]  # one row a role
    parents = {n: ["click"] for n in names if n.startswith("p")}
    yes = [n for n in names if policy.allowed(permissions, policy.closure(n, parents), {"type": "collection", "name": "orders"}, "SELECT")]
    return roles.select("role", F.col("role").isin(yes).alias("allowed"))


def clocked(spark, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return load(spark, d, "events").select(F.col("user_id").alias("_id"), "event_id", "value", hlc.render(ms, F.col("event_id") % 65536).alias("_hlc"))


CLOCK = f"lower(printf('%012x', {EVENT_MS}) || printf('%04x', event_id % 65536))"


@query(f"SELECT event_id, {CLOCK} AS _hlc, {EVENT_MS} AS ms FROM events")
def q_hlc_render(spark, d):
    return clocked(spark, d).select("event_id", "_hlc", hlc.millis(F.col("_hlc")).alias("ms"))


@query(f"SELECT user_id AS _id, arg_max(event_id, {CLOCK}) AS event_id, max({CLOCK}) AS _hlc FROM events GROUP BY 1")
def q_lww_merge(spark, d):
    rows = clocked(spark, d).drop("value")
    return hlc.merge(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"))


@query(f"SELECT event_id, {CLOCK} AS _hlc FROM events WHERE {CLOCK} > '018cd000000000000' ORDER BY 2, user_id LIMIT 1024")
def q_changes_since(spark, d):
    return hlc.changes_since(clocked(spark, d), "018cd000000000000").select("event_id", "_hlc")


@query("SELECT event_id AS lsn, event_type FROM events WHERE event_id > 100 ORDER BY 1 LIMIT 50")
def q_change_feed(spark, d):
    return changes(load(spark, d, "events").select(F.col("event_id").alias("lsn"), "event_type"), 100, 50)


@query("SELECT user_id, max(event_id) AS seq FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'")
def q_compact_newest(spark, d):
    rows = load(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("tombstone"))
    return newest(rows, "user_id", "seq").select("user_id", "seq")


@query("SELECT p_name, p_partkey FROM part WHERE p_name >= 'c' AND p_name < 'f'")
def q_key_range(spark, d):
    return key_range(load(spark, d, "part").select("p_name", "p_partkey"), "p_name", "c", "f")


def xored(a: str, shift: int) -> str:
    return f"CAST(xor(CAST({a} AS UBIGINT), CAST({a} // {1 << shift} AS UBIGINT)) AS UHUGEINT)"


def ring_sql(shards: list[str]) -> str:
    """Tables k (event_id, its place) and r (place, owner) of a ring, by the formula of the hash."""
    wrap = 1 << 64
    fnv = f"list_reduce(list_prepend(CAST({0xCBF29CE484222325} AS UHUGEINT), list_transform(string_split(x, ''), lambda c: CAST(ord(c) AS UHUGEINT))), lambda h, b: (CAST(xor(CAST(h AS UBIGINT), CAST(b AS UBIGINT)) AS UHUGEINT) * {0x100000001B3}) % {wrap})"
    steps = ["h0 AS (SELECT id, x, owner, " + fnv + " AS h FROM names)"]
    for n, (shift, factor) in enumerate(((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)), 1):
        steps.append(f"h{n} AS (SELECT id, owner, ({xored('h', shift)} * {factor}) % {wrap} AS h FROM h{n - 1})")
    steps.append(f"h3 AS (SELECT id, owner, CAST({xored('h', 31)} AS UBIGINT) AS place FROM h2)")
    names = " UNION ALL ".join([f"SELECT NULL AS id, '{s}#' || v AS x, '{s}' AS owner FROM range(256) t(v)" for s in shards] + ["SELECT event_id, CAST(event_id AS VARCHAR), NULL FROM events"])
    return f"WITH names AS ({names}), {', '.join(steps)}, r AS (SELECT place, owner FROM h3 WHERE owner IS NOT NULL), k AS (SELECT id AS event_id, place FROM h3 WHERE owner IS NULL)"


def owners_sql(shards: list[str]) -> str:
    return f"({ring_sql(shards)} SELECT k.event_id, coalesce(r.owner, (SELECT arg_min(owner, place) FROM r)) AS owner FROM k ASOF LEFT JOIN r ON k.place <= r.place)"


THREE, FOUR = ["s0", "s1", "s2"], ["s0", "s1", "s2", "s3"]


@query(f"SELECT event_id, owner FROM {owners_sql(THREE)}")
def q_route_owner(spark, d):
    return load(spark, d, "events").select("event_id", routing.Ring(THREE).route(F.col("event_id")).alias("owner"))


@query(f"SELECT owner, count(*) AS n FROM {owners_sql(THREE)} GROUP BY 1")
def q_route_balance(spark, d):
    return load(spark, d, "events").select(routing.Ring(THREE).route(F.col("event_id")).alias("owner")).groupBy("owner").agg(F.count("*").alias("n"))


@query(f"SELECT a.event_id, a.owner AS old_owner, b.owner AS new_owner FROM {owners_sql(THREE)} a JOIN {owners_sql(FOUR)} b USING (event_id) WHERE a.owner <> b.owner")
def q_reshard_moves(spark, d):
    return routing.moves(load(spark, d, "events").select("event_id"), "event_id", routing.Ring(THREE), routing.Ring(FOUR))


@query(f"SELECT owner, count(*) AS rows, count(DISTINCT owner) AS tasks FROM {owners_sql(FOUR)} GROUP BY 1")
def q_shard_bulk_insert(spark, d):
    put = routing.dealt(load(spark, d, "events").select("event_id"), "event_id", routing.Ring(FOUR)).withColumn("task", F.spark_partition_id())
    return put.groupBy("owner").agg(F.count("*").alias("rows"), F.count_distinct("task").alias("tasks"))


@query("""SELECT * FROM (VALUES (1, 'tick', '00000000000a0000'), (2, 'tick', '00000000000a0001'), (3, 'remote ahead', '0000000000140008'), (4, 'remote behind', '0000000000140009'),
(5, 'same time', '0000000000140021'), (6, 'beyond the drift', '00000000ea920001'), (7, 'full counter', '00000000ea930000'), (8, 'own time ahead', '00000001d4c00000')) t(step, what, hlc)""")
def q_hlc_update(spark, d):
    clock = hlc.Clock()
    steps = [(1, "tick", clock.tick(10)), (2, "tick", clock.tick(9)), (3, "remote ahead", clock.update(f"{20:012x}{7:04x}", 12)), (4, "remote behind", clock.update(f"{3:012x}{9:04x}", 13)), (5, "same time", clock.update(f"{20:012x}{0x20:04x}", 20))]
    steps.append((6, "beyond the drift", clock.update(f"{10**12:012x}{5:04x}", 50)))
    clock.count = 0xFFFF
    steps += [(7, "full counter", clock.tick(60)), (8, "own time ahead", clock.update(f"{30:012x}{1:04x}", 0x1D4C0))]
    return spark.createDataFrame(steps, "step int, what string, hlc string")


def op_log(spark, d, ops: dict[str, str]) -> DataFrame:
    """Events as an operation log: the event's kind names the operation, the user is the key."""
    kind = F.col("event_type")
    op = F.lit(None).cast("string")
    for event, name in ops.items():
        op = F.when(kind == event, name).otherwise(op)
    rows = load(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("key"), op.alias("op"), (F.col("event_id") % 5).cast("string").alias("field"), (F.col("event_id") % 11).cast("string").alias("value"),
        F.round("value", 2).alias("score"), (F.col("event_id") % 4 * 1000).alias("ttl"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
    )
    return rows.where("op IS NOT NULL")


def log_sql(ops: dict[str, str]) -> str:
    case = " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in ops.items())
    return f"(SELECT * FROM (SELECT event_id AS seq, user_id AS key, CASE event_type {case} END AS op, CAST(event_id % 5 AS VARCHAR) AS field, CAST(event_id % 11 AS VARCHAR) AS value, round(value, 2) AS score, event_id % 4 * 1000 AS ttl, {EVENT_MS} AS ts FROM events) WHERE op IS NOT NULL)"


STRING_OPS = {"click": "set", "purchase": "incr", "view": "get", "error": "del", "signup": "decr"}
HASH_OPS = {"click": "hset", "view": "hset", "error": "hdel"}
LIST_OPS = {"click": "lpush", "view": "rpush"}
SET_OPS = {"click": "sadd", "view": "sadd", "error": "srem"}
ZSET_OPS = {"click": "zadd", "view": "zadd", "error": "zrem"}
TTL_OPS = {"click": "set", "view": "expire", "signup": "persist", "error": "del"}


@query(f"SELECT key, arg_max(value, seq) AS value FROM {log_sql(STRING_OPS)} WHERE op IN ('set', 'del') GROUP BY 1 HAVING arg_max(op, seq) = 'set'")
def q_kv_set_last(spark, d):
    return kv.last_set(op_log(spark, d, STRING_OPS))


@query(f"""WITH l AS (SELECT * FROM {log_sql(STRING_OPS)}), b AS (SELECT key, max(seq) AS s, arg_max(op, seq) AS op, arg_max(value, seq) AS v FROM l WHERE op IN ('set', 'del') GROUP BY 1),
i AS (SELECT l.key, sum(CASE WHEN l.op = 'incr' THEN CAST(l.value AS BIGINT) ELSE -CAST(l.value AS BIGINT) END) AS moved FROM l LEFT JOIN b ON l.key = b.key WHERE l.op IN ('incr', 'decr') AND (b.s IS NULL OR l.seq > b.s) GROUP BY 1)
SELECT coalesce(b.key, i.key) AS key, CAST(CASE WHEN b.op = 'set' THEN CAST(b.v AS BIGINT) ELSE 0 END + coalesce(moved, 0) AS BIGINT) AS value FROM b FULL JOIN i ON b.key = i.key WHERE moved IS NOT NULL OR b.op = 'set'""")
def q_kv_incr(spark, d):
    return kv.counters(op_log(spark, d, STRING_OPS))


@query(f"SELECT key, field, arg_max(value, seq) AS value FROM {log_sql(HASH_OPS)} GROUP BY 1, 2 HAVING arg_max(op, seq) = 'hset'")
def q_kv_hash(spark, d):
    return kv.hashes(op_log(spark, d, HASH_OPS))


_LIST = f"(SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN op = 'lpush' THEN -seq ELSE seq END) - 1 AS pos, count(*) OVER (PARTITION BY key) AS size FROM {log_sql(LIST_OPS)})"


@query(f"SELECT key, value, pos FROM {_LIST} WHERE pos >= greatest(size - 5, 0) AND pos <= size - 2")
def q_kv_list_range(spark, d):
    return kv.list_range(op_log(spark, d, LIST_OPS), -5, -2)


@query(f"SELECT key, value FROM {log_sql(SET_OPS)} GROUP BY 1, 2 HAVING arg_max(op, seq) = 'sadd'")
def q_kv_set_members(spark, d):
    return kv.members(op_log(spark, d, SET_OPS))


@query(f"WITH z AS (SELECT key, value, arg_max(score, seq) AS score FROM {log_sql(ZSET_OPS)} GROUP BY 1, 2 HAVING arg_max(op, seq) = 'zadd') SELECT key, value, score, row_number() OVER (PARTITION BY key ORDER BY score, value) - 1 AS rank FROM z QUALIFY rank < 3")
def q_kv_zrange(spark, d):
    return kv.sorted_set(op_log(spark, d, ZSET_OPS)).where("rank < 3")


@query("SELECT p_partkey, p_name FROM part WHERE p_name GLOB '?a*e*'")
def q_kv_glob(spark, d):
    return load(spark, d, "part").where(kv.glob(F.col("p_name"), "?a*e*")).select("p_partkey", "p_name")


def ttl_sql(ops: dict[str, str]) -> str:
    """What is left of each key's time: an expire counts where the key exists by then."""
    made = ", ".join(f"'{x}'" for x in kv.MAKES)
    return f"""WITH s AS (SELECT *, last_value(CASE WHEN op IN ({made}) THEN 1 WHEN op = 'del' THEN 0 END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq) AS alive FROM {log_sql(ops)}),
t AS (SELECT key, arg_max(alive, seq) AS alive, coalesce(arg_max(CASE WHEN op = 'expire' OR (op = 'set' AND ttl > 0) THEN ts + ttl * 1000 ELSE -1 END, seq) FILTER (WHERE op IN ('set', 'persist', 'del') OR (op = 'expire' AND alive = 1)), -1) AS ends FROM s GROUP BY 1)
SELECT key, CAST(CASE WHEN ends = -1 THEN -1 ELSE floor((ends - 1706659200000) / 1000.0) END AS BIGINT) AS ttl FROM t WHERE alive = 1 AND (ends = -1 OR 1706659200000 < ends)"""


@query(ttl_sql(TTL_OPS))
def q_kv_ttl(spark, d):
    return kv.ttl_state(op_log(spark, d, TTL_OPS), F.lit(1706659200000))


@query("SELECT user_id AS key, max(event_id) AS touched FROM events GROUP BY 1 QUALIFY row_number() OVER (PARTITION BY key % 8 ORDER BY touched DESC) <= 5")
def q_kv_lru(spark, d):
    log = load(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"))
    return kv.lru(log, 5, shard=F.pmod("key", F.lit(8))).select("key", "touched")


@query(f"""WITH l AS (SELECT * FROM {log_sql(STRING_OPS)}), h AS (SELECT key, arg_max(value, seq) AS value FROM l WHERE op IN ('set', 'del') GROUP BY 1 HAVING arg_max(op, seq) = 'set'),
g AS (SELECT op, last_value(CASE WHEN op IN ('set', 'del') THEN op END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM l)
SELECT (SELECT count(*) FROM h) AS keys, (SELECT CAST(sum(strlen(CAST(key AS VARCHAR)) + strlen(value)) AS BIGINT) FROM h) AS mem_bytes, count(*) FILTER (WHERE last = 'set') AS hits,
count(*) FILTER (WHERE NOT coalesce(last = 'set', false)) AS misses, round(count(*) FILTER (WHERE last = 'set') / count(*), 6) AS hit_rate FROM g WHERE op = 'get'""")
def q_kv_stats(spark, d):
    return kv.stats(op_log(spark, d, STRING_OPS)).withColumn("hit_rate", F.round("hit_rate", 6))


_BUCKET = "CASE " + " ".join(f"WHEN value * 100 <= {b} THEN CAST({b} AS DOUBLE)" for b in observe.BUCKETS) + " ELSE CAST('inf' AS DOUBLE) END"


@query(f"WITH c AS (SELECT event_type AS route, {_BUCKET} AS le, count(*) AS n FROM events GROUP BY 1, 2) SELECT route, le, CAST(sum(n) OVER (PARTITION BY route ORDER BY le) AS BIGINT) AS cumulative FROM c")
def q_obs_histogram(spark, d):
    return observe.histogram(load(spark, d, "events").withColumn("ms", F.col("value") * 100), "event_type", "ms")


@query("SELECT event_type AS route, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def q_obs_quantile(spark, d):
    out = observe.quantiles(load(spark, d, "events"), "event_type", "value", exact=True)
    return out.select("route", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")))


@query("SELECT date_trunc('day', ts) AS start, count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS bad, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS ratio FROM events GROUP BY 1")
def q_obs_error_ratio(spark, d):
    return observe.ratio_by_window(load(spark, d, "events"), "ts", F.col("event_type") == "error").withColumn("ratio", F.round("ratio", 6))


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def q_obs_rate_window(spark, d):
    rows = load(spark, d, "events").groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS recent FROM events")
def q_login_rate(spark, d):
    return observe.rate_limited(load(spark, d, "events"), "user_id", "ts", 10, 86400).select("event_id", "user_id", "recent")


@query("SELECT page_id, regexp_replace(url || '/0123456789abcdef01', '/[0-9a-fA-F_-]{16,}', '/:id', 'g') AS route FROM pages")
def q_obs_route(spark, d):
    return load(spark, d, "pages").select("page_id", observe.canonical_route(F.concat("url", F.lit("/0123456789abcdef01"))).alias("route"))


def event_stream(spark, d) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(d)


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def q_stream_lww(spark, d):
    rows = event_stream(spark, d).select("user_id", "event_id", "event_type")
    return streams.run_once(streams.latest(rows, "user_id", "event_id"), streams.scratch(spark, "stream_lww"))


@query("SELECT user_id AS key, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1")
def q_stream_kv(spark, d):
    rows = event_stream(spark, d).where("event_type = 'purchase'").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("n"))
    return streams.run_once(rows, streams.scratch(spark, "stream_kv"))


@query("SELECT event_id AS message, event_type AS channel FROM events WHERE event_type IN ('signup', 'error')")
def q_stream_pubsub(spark, d):
    rows = event_stream(spark, d).select(F.col("event_id").alias("message"), F.col("event_type").alias("channel"))
    return streams.run_once(streams.channel(rows, "signup", "error"), streams.scratch(spark, "stream_pubsub"), "append")


@query(ttl_sql({"purchase": "incr", "view": "expire", "signup": "persist", "error": "del"}))
def q_kv_expire_missing(spark, d):
    return kv.ttl_state(op_log(spark, d, {"purchase": "incr", "view": "expire", "signup": "persist", "error": "del"}), F.lit(1706659200000))


DEL_OPS = {"click": "hset", "view": "sadd", "purchase": "zadd", "signup": "rpush", "error": "del"}
_KEPT = f"(SELECT l.* FROM {log_sql(DEL_OPS)} l LEFT JOIN (SELECT key, max(seq) AS gone FROM {log_sql(DEL_OPS)} WHERE op = 'del' GROUP BY 1) g USING (key) WHERE gone IS NULL OR seq > gone)"


@query(f"""SELECT key, 'hash' AS held, count(DISTINCT field) AS n FROM {_KEPT} WHERE op = 'hset' GROUP BY 1 UNION ALL SELECT key, 'set', count(DISTINCT value) FROM {_KEPT} WHERE op = 'sadd' GROUP BY 1
UNION ALL SELECT key, 'zset', count(DISTINCT value) FROM {_KEPT} WHERE op = 'zadd' GROUP BY 1 UNION ALL SELECT key, 'list', count(*) FROM {_KEPT} WHERE op = 'rpush' GROUP BY 1""")
def q_kv_del_all(spark, d):
    log = op_log(spark, d, DEL_OPS)
    held = {"hash": kv.hashes(log), "set": kv.members(log), "zset": kv.sorted_set(log), "list": kv.replayed_lists(log)}
    parts = [df.groupBy("key").agg(F.count("*").alias("n")).select("key", F.lit(name).alias("held"), "n") for name, df in held.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"SELECT DISTINCT key FROM {_KEPT} WHERE op <> 'del'")
def q_kv_exists(spark, d):
    return kv.exists(op_log(spark, d, DEL_OPS))


_KEY = "strlen(CAST(key AS VARCHAR))"


@query(f"""WITH b AS (SELECT key, {_KEY} + sum(strlen(field) + strlen(value)) AS n FROM (SELECT key, field, arg_max(value, seq) AS value FROM {_KEPT} WHERE op = 'hset' GROUP BY 1, 2) GROUP BY 1
UNION ALL SELECT key, {_KEY} + sum(strlen(value)) FROM (SELECT DISTINCT key, value FROM {_KEPT} WHERE op = 'sadd') GROUP BY 1
UNION ALL SELECT key, {_KEY} + sum(strlen(value) + 8) FROM (SELECT DISTINCT key, value FROM {_KEPT} WHERE op = 'zadd') GROUP BY 1
UNION ALL SELECT key, {_KEY} + sum(strlen(value)) FROM {_KEPT} WHERE op = 'rpush' GROUP BY 1) SELECT key, CAST(sum(n) AS BIGINT) AS mem_bytes FROM b GROUP BY 1""")
def q_kv_bytes(spark, d):
    return kv.footprint(op_log(spark, d, DEL_OPS))


POP_OPS = {"click": "rpush", "view": "lpop", "purchase": "rpush"}


@query(f"""WITH w AS (SELECT *, sum(CASE WHEN op = 'rpush' THEN 1 ELSE -1 END) OVER (PARTITION BY key ORDER BY seq) AS s FROM {log_sql(POP_OPS)}),
n AS (SELECT key, arg_max(s, seq) - least(0, min(s)) AS n FROM w GROUP BY 1),
p AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS back FROM w WHERE op = 'rpush') SELECT key, value, CAST(n - back AS BIGINT) AS pos FROM p JOIN n USING (key) WHERE back <= n""")
def q_kv_pop(spark, d):
    return kv.replayed_lists(op_log(spark, d, POP_OPS))


grouped("grp_limit", [{"$group": {"_id": "$user_id", "n": {"$count": {}}}}, {"$skip": 2}, {"$limit": 7}], "SELECT user_id AS _id, count(*) AS n FROM events GROUP BY 1 ORDER BY CAST(user_id AS VARCHAR) LIMIT 7 OFFSET 2", "events", "event_id")
grouped("agg_limit_natural", [{"$match": {"o_orderstatus": "F"}}, {"$skip": 3}, {"$limit": 9}, {"$project": {"o_orderkey": 1}}], "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY 1 LIMIT 9 OFFSET 3", "orders", "o_orderkey")


@query("SELECT * FROM (VALUES ('SELECT', 1), ('INSERT', 2), ('UPDATE', 4), ('DELETE', 8), ('CREATE', 16), ('DROP', 32), ('ALTER', 64), ('INDEX', 128), ('TRUNCATE', 256), ('REFERENCES', 512), ('TRIGGER', 1024), ('EXECUTE', 2048), ('USAGE', 4096), ('CREATE_TEMP', 8192), ('CONNECT', 16384), ('ALL', 4294967295)) t(name, bits)")
def q_priv_bits(spark, d):
    return spark.createDataFrame(list(policy.PRIVILEGES.items()), "name string, bits long")


@query("SELECT unnest(['superuser', 'db_admin', 'user_admin', 'read_write', 'read_only', 'public']) AS role")
def q_system_roles(spark, d):
    return spark.createDataFrame([(r,) for r in policy.SYSTEM_ROLES], "role string")


@query("""WITH a AS (SELECT user_id, event_id, event_type = 'purchase' AS ok FROM events WHERE event_type IN ('error', 'purchase')), r AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM a),
n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS n FROM r WHERE NOT ok) SELECT user_id, min(event_id) AS locked_at FROM n WHERE n = 5 GROUP BY 1""")
def q_auth_lockout(spark, d):
    rows = load(spark, d, "events").where("event_type IN ('error', 'purchase')").withColumn("ok", F.col("event_type") == "purchase")
    return policy.locked_out(rows, "user_id", "event_id", "ok")


ORDERED = [policy.Policy("big", using="o_totalprice >= 100000")]
SEGMENTS = [policy.Policy("some", using="c_mktsegment IN ('BUILDING', 'MACHINERY')")]


def guarded(spark, d) -> tuple[policy.Guard, dict[str, DataFrame]]:
    permissions = [{"role": "clerk", "target": {"type": "collection", "name": ""}, "privileges": policy.grant(0, "SELECT", "INSERT")}]
    return policy.Guard({"clerk"}, permissions, {"orders": ORDERED, "customer": SEGMENTS}), {n: load(spark, d, n) for n in ("orders", "customer")}


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice >= 100000 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def q_rls_lookup(spark, d):
    guard, tables = guarded(spark, d)
    stages = [{"$lookup": {"from": "customer", "localField": "o_custkey", "foreignField": "c_custkey", "as": "c"}}, {"$unwind": "$c"}, {"$project": {"o_orderkey": 1, "c_name": "$c.c_name"}}]
    return guard.aggregate("orders", stages, tables, order="o_orderkey")


@query("SELECT count(*) AS n FROM orders WHERE o_totalprice >= 100000")
def q_rls_count(spark, d):
    guard, tables = guarded(spark, d)
    return guard.rows(tables["orders"], "orders").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice < 1000 OR o_orderstatus = 'O'")
def q_rls_check(spark, d):
    rules = [policy.Policy("cheap", "INSERT", check="o_totalprice < 1000", using="o_totalprice < 5"), policy.Policy("open", using="o_orderstatus = 'O'")]
    return policy.secure(load(spark, d, "orders"), rules, "INSERT", check=True).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def q_point_get(spark, d):
    return get(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 7)


@query(f"SELECT event_id AS _id, value FROM events WHERE event_id = 14 AND event_id % 13 <> 0 AND (event_id % 7 = 0 OR 1704672000000 <= {EVENT_MS} + event_id % 7 * 86400000)")
def q_document_get(spark, d):
    return get_document(enveloped(spark, d), 14, 1704672000000).select("_id", "value")


@query("SELECT count(*) AS n FROM events WHERE event_id % 13 <> 0 AND value > 20")
def q_count_live(spark, d):
    return match(live(enveloped(spark, d)), {"value": {"$gt": 20}}).agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS _id, p_partkey % 3 = 0 AS _tombstone, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS p_name, CASE WHEN p_partkey % 3 = 0 THEN 'f' ELSE '0' END AS _hlc FROM part")
def q_delete_tombstone(spark, d):
    rows = load(spark, d, "part").select(F.col("p_partkey").alias("_id"), F.lit("0").alias("_hlc"), F.lit(False).alias("_tombstone"), F.lit(0).alias("updated_at"), "p_name")
    return updates.delete(rows, rows.where("_id % 3 = 0").select("_id"), True, "f", 9).select("_id", "_tombstone", "p_name", "_hlc")


@query("SELECT p_partkey AS _id, p_name FROM part WHERE p_partkey % 3 <> 0")
def q_delete_hard(spark, d):
    rows = load(spark, d, "part").select(F.col("p_partkey").alias("_id"), "p_name")
    return updates.delete(rows, rows.where("_id % 3 = 0").select("_id"))


@query("SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN -1 ELSE label END AS label FROM embeddings UNION ALL SELECT -1 - vec_id, -1 FROM embeddings WHERE vec_id % 4 = 0")
def q_vec_upsert(spark, d):
    rows = load(spark, d, "embeddings")
    new = rows.where("vec_id % 4 = 0").withColumn("label", F.lit(-1))
    new = new.unionByName(new.withColumn("vec_id", -1 - F.col("vec_id")))
    return vectors.upsert(rows, new).select("vec_id", "label")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 5 <> 0")
def q_vec_remove(spark, d):
    rows = load(spark, d, "embeddings")
    return vectors.remove(rows, rows.where("vec_id % 5 = 0")).select("vec_id", "label")


def counted(spark, d) -> DataFrame:
    return load(spark, d, "customer").select(F.col("c_custkey").alias("_id"), F.col("c_name").alias("name"), F.lit(1.0).alias("n"), F.lit(3).alias("version"), F.lit(0).alias("updated_at"))


@query("SELECT c_custkey AS _id, CAST(CASE c_custkey WHEN 5 THEN 12 ELSE 1 END AS DOUBLE) AS n, CASE c_custkey WHEN 5 THEN 4 ELSE 3 END AS version FROM customer WHERE c_custkey <> 6 UNION ALL SELECT -1, CAST(7 AS DOUBLE), 1")
def q_txn_inc_twice(spark, d):
    ops = [{"op": "update", "id": 5, "update": {"$inc": {"n": 5}}, "expected_version": 3}, {"op": "update", "id": 5, "update": {"$mul": {"n": 2}}}, {"op": "remove", "id": 6}, {"op": "insert", "id": -1, "doc": {"name": "new", "n": 2.0}}, {"op": "update", "id": -1, "update": {"$inc": {"n": 5}}}]
    return txn.run(counted(spark, d), ops, 9)[0].select("_id", "n", "version")


@query("SELECT * FROM (VALUES ('stale version', 'CONFLICT'), ('version of an insert', 'CONFLICT'), ('stale read', 'CONFLICT'), ('read of a row since made', 'CONFLICT'), ('insert twice', 'DUPLICATE'), ('update of none', 'NOT_FOUND'), ('remove, then insert', 'COMMITTED'), ('same name', 'DUPLICATE'), ('fresh read', 'COMMITTED'), ('refused', 'FORBIDDEN')) t(what, status)")
def q_txn_conflict(spark, d):
    base = counted(spark, d)
    up = lambda i, v=0, name="x": {"op": "update", "id": i, "update": {"$set": {"name": name}}, "expected_version": v}
    new = lambda i, name="y": {"op": "insert", "id": i, "doc": {"name": name, "n": 0.0}}
    known = base.where("_id = 2").first()["name"]
    cases = {
        "stale version": ([up(1, 2)], {}), "version of an insert": ([new(-1), up(-1, 1)], {}), "stale read": ([up(1)], {"reads": {2: 1}}), "read of a row since made": ([up(1)], {"reads": {2: 0}}),
        "insert twice": ([new(-1), new(-1)], {}), "update of none": ([up(-5)], {}), "remove, then insert": ([{"op": "remove", "id": 1}, new(1)], {}), "same name": ([up(1, 3, known)], {"unique": ["name"]}),
        "fresh read": ([up(1)], {"reads": {2: 3, -7: 0}}), "refused": ([up(1)], {"allowed": lambda op, rows: not rows.where("_id > 0").isEmpty() and op["op"] != "update"}),
    }
    return spark.createDataFrame([(what, txn.run(base, ops, 9, **more)[1]) for what, (ops, more) in cases.items()], "what string, status string")


@query("SELECT 5 AS _id, CAST(2 AS DOUBLE) AS n, 'seen' AS name")
def q_txn_read_own(spark, d):
    ops = [{"op": "update", "id": 5, "update": {"$set": {"name": "seen"}}}, {"op": "update", "id": 5, "update": {"$inc": {"n": 1}}}]
    return get(txn.replay(counted(spark, d), ops), "_id", 5).select("_id", "n", "name")


@query("SELECT CAST(count(*) AS BIGINT) AS inserted, list(-c_custkey ORDER BY -c_custkey) AS ids FROM customer WHERE c_custkey BETWEEN 1 AND 40")
def q_bulk_insert(spark, d):
    held = load(spark, d, "customer").select(F.col("c_custkey").alias("_id"), "c_name")
    fresh = held.where("_id BETWEEN 1 AND 40").select((-F.col("_id")).alias("_id"), F.concat(F.lit("new "), "c_name").alias("c_name"))
    again = held.where("_id BETWEEN 1 AND 40").select((F.col("_id") * -100).alias("_id"), "c_name")  # a name that is taken
    large = held.where("_id = 1").select(F.lit(-999999).cast("long").alias("_id"), F.repeat(F.lit("x"), F.lit(5000)).alias("c_name"))
    return txn.inserted(txn.insert_many(held, fresh.unionByName(fresh).unionByName(again).unionByName(large).unionByName(held.where("_id < 9")), unique=["c_name"], most_bytes=1000)[1])


@query("SELECT doc_id, coalesce(list(k ORDER BY k) FILTER (WHERE k IS NOT NULL), []) AS ks FROM (SELECT d.doc_id, r.r_regionkey AS k FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN region r ON r.r_regionkey = l.quality AND r.r_regionkey <> 0) GROUP BY 1")
def q_lookup_null_keys(spark, d):
    local = labelled(spark, d).select("doc_id", "quality")
    foreign = load(spark, d, "region").select(F.when(F.col("r_regionkey") != 0, F.col("r_regionkey")).alias("k"))
    out = aggregate(local, [{"$lookup": {"from": "region", "localField": "quality", "foreignField": "k", "as": "rs"}}], {"region": foreign}, order="doc_id")
    return out.select("doc_id", F.transform("rs", lambda r: r["k"]).alias("ks"))


@query("SELECT CAST(status // 100 AS INTEGER) AS status_class, count(*) AS requests FROM (SELECT 200 + event_id % 4 * 101 AS status FROM events) GROUP BY 1")
def q_obs_status_class(spark, d):
    return observe.status_classes(load(spark, d, "events").withColumn("status", 200 + F.col("event_id") % 4 * 101))


@query("SELECT 'requests_total{kind=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def q_metrics_text(spark, d):
    rows = load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).select(F.col("event_type").alias("kind"), "n")
    return observe.exposition(rows, "requests_total", "n", "kind")


@query(f"SELECT event_id AS _id, value, CAST(77 AS BIGINT) AS lsn FROM events WHERE event_id % 13 <> 0 AND (event_id % 7 = 0 OR 1704672000000 <= {EVENT_MS} + event_id % 7 * 86400000)")
def q_snapshot(spark, d):
    return snapshot(enveloped(spark, d), 77, 1704672000000).select("_id", "value", "lsn")


@query(f"SELECT max(_hlc) AS max_hlc FROM (SELECT {CLOCK} AS _hlc FROM events WHERE {CLOCK} > '018cd000000000000' ORDER BY 1, user_id LIMIT 1024)")
def q_changes_max_hlc(spark, d):
    return hlc.latest_change(clocked(spark, d), "018cd000000000000")


@query("SELECT c_nationkey, c_mktsegment, c_custkey FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING'")
def q_composite_prefix(spark, d):
    path = streams.scratch(spark, "indexed")
    write_indexed(load(spark, d, "customer"), path, ["c_nationkey", "c_mktsegment", "c_custkey"], ["c_custkey"], 4)
    found = match(spark.read.parquet(path), {"c_nationkey": 3, "c_mktsegment": "BUILDING"}).select("c_nationkey", "c_mktsegment", "c_custkey")
    if not uses_index(found, "c_nationkey", "c_mktsegment"):
        raise AssertionError("the prefix is not pushed down")
    return found


@query("SELECT c_custkey AS _id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'kept' END AS name FROM customer")
def q_backup_restore(spark, d):
    rows = load(spark, d, "customer").select(F.col("c_custkey").alias("_id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "b").otherwise("a").alias("_hlc"))
    path = streams.scratch(spark, "backup")
    backup(rows, path, "_id", 5, 6)
    held = rows.select("_id", F.lit("kept").alias("name"), F.lit("aa").alias("_hlc"))
    return restore_into(held, path, "_id long, name string, _hlc string")[0].select("_id", "name")


@query("SELECT event_id, event_type AS msg, CASE WHEN event_type = 'error' THEN 'audit' ELSE 'main' END AS channel FROM events")
def q_log_channels(spark, d):
    path, rows = streams.scratch(spark, "logs"), load(spark, d, "events").select("event_id", F.col("event_type").alias("msg"))
    write_log(rows.where("msg <> 'error'"), path)
    write_log(rows.where("msg = 'error'"), path, "audit")
    return streams.run_once(streams.tail(spark, path, "event_id long, msg string, channel string", "json"), streams.scratch(spark, "log_tail"), "append")


@query("SELECT 'default' AS database, 'public' AS schema, 'region' AS name, count(*) AS document_count FROM region UNION ALL SELECT 'default', 'sales', 'orders', count(*) FROM orders")
def q_list_collections(spark, d):
    names = Catalog()
    names.create("region", load(spark, d, "region"))
    names.create("orders", load(spark, d, "orders"), "sales")
    names.create("gone", load(spark, d, "nation"))
    names.drop("gone")
    return names.listing(spark)


@query("SELECT true AS late, false AS in_time")
def q_feed_gap(spark, d):
    log = load(spark, d, "events").select(F.col("event_id").alias("lsn")).where("lsn >= 100")
    return spark.createDataFrame([(has_gap(log, 50), has_gap(log, 99))], "late boolean, in_time boolean")
