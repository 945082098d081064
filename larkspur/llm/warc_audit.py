"""Merkle fixity audit of WARC files held in two replicas.

A replica is a folder of WARC files. Its bytes are read back, cut into records at their own headers and hashed. A
tree's leaves hash (offset, length, digest) of the records that start in an offset range of `RANGE` bytes, in offset
order; each level above hashes the children of `FANOUT` ranges by number, up to a root a file, and file roots hash on
into a root of the collection. An audit compares the replicas' tops and goes down only where nodes differ, so it
looks at the records of differing ranges alone.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import CLEANUP, cut, load, prepare, settings, shared_folder

RANGE, FANOUT, FILE_RECORDS = 1 << 14, 16, 1000
#: The head of a record; the content's own digest names it, so a record's bytes follow from the page alone.
END = "\r\n\r\n"
HEAD = "WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:sha256:{digest}>\r\nWARC-Target-URI: {url}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n"


def records(pages: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """page_id, file, offset, length, digest, copies of every distinct page, as WARC files of about `file_records` records.

    A page goes to a file by its digest, so that no key makes a file large, and lies there in the order of (page_id,
    digest). Equal rows are one record with a count of copies. Null urls and bodies are empty; a null page_id is kept.
    """
    slim = cut(spelled(pages).drop("record").groupBy("page_id", "digest", "length").agg(F.count("*").alias("copies")))
    order = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), "digest").rowsBetween(Window.unboundedPreceding, -1)
    return slim.withColumn("file", file_of(files(slim, file_records))).withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))


def files(held: DataFrame, file_records: int = FILE_RECORDS) -> int:
    return max(1, -(-held.count() // file_records))


def file_of(number: int) -> F.Column:
    return F.conv(F.substring("digest", 1, 12), 16, 10).cast("long") % number


def spelled(pages: DataFrame) -> DataFrame:
    """page_id, record (text, but for the blank lines at its end), digest and length (of all its bytes) of every row."""
    head = HEAD.split("{digest}")
    middle, tail = head[1].split("{url}")
    length = tail.split("{length}")
    url, html = F.coalesce(F.col("url").cast("string"), F.lit("")), F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), html.alias("html"))
    record = F.concat(F.lit(head[0]), F.sha2("html", 256), F.lit(middle), "url", F.lit(length[0]), F.octet_length("html").cast("string"), F.lit(length[1]), "html")
    rows = rows.select("page_id", record.alias("record"))
    return rows.select("page_id", "record", F.sha2(F.concat("record", F.lit(END)), 256).alias("digest"), (F.octet_length("record") + len(END)).cast("long").alias("length"))


def write_replica(records: DataFrame, folder: str, number: int, compression: str = "none") -> None:
    """`number` WARC files of records (page_id, record, digest), laid out as records() says, each record closed by blank lines.

    A record's file follows from its digest and its place in it from the order, so records are shuffled once and
    joined with nothing; repeated ones are written once.
    """
    place = [F.col("page_id").asc_nulls_first(), F.col("digest")]
    again = F.row_number().over(Window.partitionBy("file", "page_id", "digest").orderBy("length"))
    rows = records.withColumn("file", file_of(number)).repartition("file").withColumn("_again", again).where("_again = 1")
    with settings(records.sparkSession, {CLEANUP: "true"}):
        rows.sortWithinPartitions("file", *place).select("file", "record").write.mode("overwrite").partitionBy("file").text(folder, compression=compression, lineSep=END)


def unpacked(content: bytes) -> bytes:
    """The bytes of a file, or of what can be unpacked of it if it is compressed."""
    if not content.startswith(b"\x1f\x8b"):
        return content
    unzip, parts = zlib.decompressobj(31), []
    try:
        for at in range(0, len(content), 1 << 16):
            parts.append(unzip.decompress(content[at : at + (1 << 16)]))
    except zlib.error:
        pass
    return b"".join(parts)


_LENGTH = re.compile(rb"\r\ncontent-length: *(\d{1,18})\r\n", re.I)


def records_in(content: bytes) -> list[tuple[int, int, str]]:
    """offset, length, digest of each record. Bytes that no record's head opens are passed over up to the next head.

    A record reaches as far as its head says where another record or the end follows there; where the head is
    damaged, as far as the next record's head.
    """
    out, at = [], content.find(b"WARC/1.")
    while at >= 0:
        stop, head = -1, content.find(b"\r\n\r\n", at)
        m = _LENGTH.search(content, at, head + 2) if head >= 0 else None
        if m:
            stop = head + 8 + int(m[1])
            if stop > len(content) or content[stop - 4 : stop] != b"\r\n\r\n":
                stop = -1
        if stop < 0:
            after = content.find(b"\r\n\r\nWARC/1.", at + 1)
            stop = after + 4 if after >= 0 else len(content)
        out.append((at, stop - at, hashlib.sha256(content[at:stop]).hexdigest()))
        at = stop if content.startswith(b"WARC/1.", stop) else content.find(b"WARC/1.", stop)
    return out


def read_replica(spark: SparkSession, folder: str) -> DataFrame:
    """file, offset, length, digest of every record that the bytes of the folder's WARC files hold. A file is read whole, one at a time."""

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = records_in(unpacked(content.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.int64()), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))], ["file", "offset", "length", "digest"])

    prepare(spark)
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "1", "spark.sql.files.openCostInBytes": "65536"}):
        files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary, file long").option("pathGlobFilter", "part-*").load(folder)
        return cut(files.select("file", "content").mapInArrow(run, "file long, offset long, length long, digest string"), short=False)


def gathered(rows: DataFrame, *keys: str) -> DataFrame:
    """Hash of each node's parts (column what: order, text) in order."""
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("what")), lambda x: x["text"]), "\n"), 256).alias("hash"))


def raised(level: DataFrame) -> DataFrame:
    return cut(gathered(level.select("file", F.floor(F.col("node") / FANOUT).alias("node"), F.struct("node", F.concat_ws(":", "node", "hash").alias("text")).alias("what")), "file", "node"))


def grown(level: DataFrame) -> list[DataFrame]:
    """level and the levels over it, until each file has one node."""
    levels = [level]
    while not levels[-1].where("node > 0").isEmpty():
        levels.append(raised(levels[-1]))
    return levels


def tree(held: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels within files, then levels over files, each from the bottom up, as (file, node, hash).

    held needs file, offset, length, digest, none of them null. A node has at most FANOUT children and a leaf the
    records that start in RANGE bytes; several records at one offset are all hashed, in order. Over files, file is -1
    and the lowest nodes are the files.
    """
    text = F.struct("offset", F.concat_ws(":", "offset", "length", "digest").alias("text"))
    leaves = cut(gathered(held.select("file", F.floor(F.col("offset") / RANGE).alias("node"), text.alias("what")), "file", "node"))
    within = grown(leaves)
    return within, grown(within[-1].select(F.lit(-1).cast("long").alias("file"), F.col("file").alias("node"), "hash"))


def descend(a: list[DataFrame], b: list[DataFrame], within: DataFrame | None = None) -> DataFrame:
    """(file, node) of the lowest nodes that differ, from the top down; within: the only files to look at.

    Where one tree is higher than the other, both start at the lower one's height.
    """
    height, live = min(len(a), len(b)), within
    for k in range(height - 1, -1, -1):
        sides = [a[k], b[k].withColumnRenamed("hash", "other")]
        if live is not None:
            on = ["file"] if k == height - 1 else ["file", "up"]
            sides = [x.withColumn("up", F.floor(F.col("node") / FANOUT)).join(live, on, "left_semi").drop("up") for x in sides]
        found = cut(sides[0].join(sides[1], ["file", "node"], "full").where("NOT (hash <=> other)").select("file", "node"))
        live = found.withColumnRenamed("node", "up")
    return found


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """primary's columns with status: ok, corrupt, missing; and rows of the replica alone, with status extra.

    Both need file, offset, length, digest. corrupt: the replica has another record at the offset; missing: it has
    none there; extra: primary has none there. Records in branches that agree are never compared. Empty sides: all of
    the other is missing or extra. Other columns of primary pass through and are null in extra rows.
    """
    prepare(primary.sparkSession)
    place = ["file", "offset", "length", "digest"]
    primary, replica = cut(primary), cut(replica.select(*place))
    (low_a, high_a), (low_b, high_b) = tree(primary.select(*place)), tree(replica)
    files = descend(high_a, high_b).select(F.col("node").alias("file"))
    ranges = descend(low_a, low_b, files).distinct()
    node = F.floor(F.col("offset") / RANGE).alias("node")
    inside = lambda df: df.select("*", node).join(ranges, ["file", "node"], "left_semi").drop("node")
    ours, theirs = inside(primary), inside(replica)
    there = theirs.select("file", "offset").distinct().withColumn("_there", F.lit(True))
    same = theirs.distinct().withColumn("_same", F.lit(True))
    status = F.when(F.col("_same"), "ok").when(F.col("_there"), "corrupt").otherwise("missing").alias("status")
    judged = ours.join(there, ["file", "offset"], "left").join(same, place, "left").select(*primary.columns, status)
    agree = primary.select("*", node).join(ranges, ["file", "node"], "left_anti").select(*primary.columns, F.lit("ok").alias("status"))
    extra = theirs.join(ours.select("file", "offset"), ["file", "offset"], "left_anti").select(*place, F.lit("extra").alias("status"))
    return agree.unionByName(judged).unionByName(extra, allowMissingColumns=True)


def damaged(records: DataFrame) -> DataFrame:
    """What a faulty disk would have written: in pages whose id leaves 7 by 101 a byte differs, those that leave 5 by 103 are all zeros."""
    flipped = F.regexp_replace("record", "^WARC/1.1\r\nWARC-Type: resource", "WARC/1.1\r\nWARC-Type: resourcf")
    zeros = F.repeat(F.lit("\0"), F.octet_length("record"))
    record = F.when(F.col("page_id") % 103 == 5, zeros).when(F.col("page_id") % 101 == 7, flipped).otherwise(F.col("record"))
    return records.withColumn("record", record)


def op10_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of pages with its place and what the audit of a damaged replica says of it.

    Both replicas are written as WARC files into the shared folder, read back for the audit, and deleted.
    """
    prepare(spark)
    pages = load(spark, sf_dir, "pages")
    held = cut(records(pages))
    folder = shared_folder(spark, f"warc-{uuid.uuid4().hex}")
    whole, number = spelled(pages), files(held)
    write_replica(whole, f"{folder.path}/a", number, "gzip")
    write_replica(damaged(whole), f"{folder.path}/b", number, "gzip")
    found = audit(read_replica(spark, f"{folder.path}/a"), read_replica(spark, f"{folder.path}/b"))
    folder.delete()
    said = found.where("status <> 'extra'").select("file", "offset", "status")
    return held.join(said, ["file", "offset"], "left").select("page_id", "file", "offset", "length", "digest", "copies", F.coalesce("status", F.lit("missing")).alias("status"))


QUERIES = {"op10_merkle_fixity": op10_merkle_fixity}
SQL = {
    "op10_merkle_fixity": """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:sha256:' || sha256(html) || '>' || chr(13) || chr(10)
        || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(html) AS VARCHAR)
        || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM p),
d AS (SELECT page_id, sha256(record) AS digest, CAST(strlen(record) AS BIGINT) AS length, count(*) AS copies FROM r GROUP BY ALL),
f AS (SELECT *, CAST('0x' || substr(digest, 1, 12) AS BIGINT) % greatest(1, CAST(ceil((SELECT count(*) FROM d) / 1000.0) AS BIGINT)) AS file FROM d)
SELECT page_id, file, CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id NULLS FIRST, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  length, digest, copies, CASE WHEN page_id % 103 = 5 THEN 'missing' WHEN page_id % 101 = 7 THEN 'corrupt' ELSE 'ok' END AS status FROM f"""
}
