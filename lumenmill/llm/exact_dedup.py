"""Exact de-duplication over an extendible-hash index kept in shared files.

Two texts are equal when they are identical after every run of [\\x20\\x09-\\x0D] has become
one space. Only DataFrame functions are used:

1. The keys are 64-bit hashes of normalised texts (xxhash64, or a ``key`` of the caller's).
2. The directory: a bucket holds the keys that share their leading bits. It doubles (one more bit)
   as long as a bucket holds more than ``capacity`` keys; buckets that are not overfull keep their
   lower local depth. There is no depth at which it stops. Capacity is a 65,536th of the keys where
   that is more than CAPACITY, so the directory has 2**20 cells at most and may be broadcast.
3. Owner tasks: every row goes, by the directory, to the task that owns its bucket's range of
   hashes. There the rows of a bucket are ordered by hash and text: rows whose hashes are equal form
   a chain, bytes are compared along it, and each run of equal texts is an entry with its smallest
   id and its size. The index (bucket, local depth, hash, place in the chain, digest, and the rows
   of each entry) is written to the shared folder, and the result is read from it.
4. A key with more than HOT rows, or a hundred-thousandth of all, would swamp its owner: its copies
   are combined where they are read, so an owner gets one row for each text and map task, and the
   rows look up their entry by hash and digest. There are 100,000 such keys at most.

Defined results: a null text counts as empty; empty texts are equal to each other; a null id
never stays unless all ids of its group are null; rows repeated with their id share that id's
fate (each is returned); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenmill.llm.common import discard, parts, prepare, stage, table

CAPACITY = 256
HOT = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def build_directory(keys: DataFrame, count: int, capacity: int) -> tuple[DataFrame, int]:
    """The directory over distinct keys (h): cell, bucket, local_depth; and its global depth, the
    number of leading bits that make a cell."""
    depth = min(63, max(1, math.ceil(math.log2(max(1, count / capacity))) + 1))
    while True:
        cells = stage(keys.groupBy(F.shiftrightunsigned("h", 64 - depth).alias("cell")).agg(F.count(F.lit(1)).alias("load")), "dedup-cells")
        if depth == 63 or cells.filter(F.col("load") > capacity).isEmpty():
            break
        discard(cells)
        depth = min(63, depth + 1)
    levels = cells.select("cell", "load", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {depth} - depth)"))
    loads = levels.groupBy("depth", "prefix").agg(F.sum("load").alias("bucket_load"))
    fits = (F.col("bucket_load") <= capacity) | (F.col("depth") == depth)
    found = levels.join(loads, ["depth", "prefix"]).filter(fits).groupBy("cell").agg(F.min("depth").alias("local_depth"))
    bucket = F.expr(f"shiftleft(shiftright(cell, {depth} - local_depth), {depth} - local_depth)")
    directory = stage(found.select("cell", bucket.alias("bucket"), "local_depth"), "dedup-directory")
    discard(cells)
    return directory, depth


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, hot: int = HOT, key: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """The index, a row for every row of docs: bucket, local_depth, h, chain, id, keep_id,
    group_size, text_sha256, n_bytes."""
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm")).withColumn("h", key("norm"))
    keys = stage(rows.groupBy("h").agg(F.count(F.lit(1)).alias("c")), "dedup-keys")
    size = keys.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("c"), F.lit(0)).alias("rows")).first()
    directory, depth = build_directory(keys, size["keys"], max(capacity, size["keys"] >> 16))
    large = stage(keys.filter(F.col("c") > max(hot, size["rows"] // 100_000)).select("h"), "dedup-hot")  # 100,000 at most
    discard(keys)

    cell = F.shiftrightunsigned("h", 64 - depth)
    placed = rows.withColumn("cell", cell).join(F.broadcast(directory), "cell").drop("cell")
    digest = [F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").alias("n_bytes")]
    chain = Window.partitionBy("bucket", "h").orderBy("norm")
    entry = Window.partitionBy("bucket", "h", "norm")
    owned = placed.join(F.broadcast(large), "h", "left_anti").repartition(parts(docs.sparkSession), "bucket")
    owned = owned.withColumn("keep_id", F.min("id").over(entry)).withColumn("group_size", F.count(F.lit(1)).over(entry)).withColumn("chain", F.dense_rank().over(chain))
    index = owned.select("bucket", "local_depth", "h", "chain", "id", "keep_id", "group_size", *digest)
    if not large.isEmpty():
        copies = placed.join(F.broadcast(large), "h", "left_semi")
        entries = copies.groupBy("bucket", "local_depth", "h", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        entries = entries.withColumn("chain", F.dense_rank().over(chain)).select("bucket", "local_depth", "h", "chain", "keep_id", "group_size", *digest)
        entries = stage(entries, "dedup-hot-entries")
        looked_up = copies.select("id", "h", digest[0]).join(F.broadcast(entries), ["h", "text_sha256"])
        index = index.unionByName(looked_up.select(*index.columns))
    return stage(index, "dedup-index")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, hot: int = HOT, key: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """One row per row of docs: the id, keep_id, group_size, kept, text_sha256, n_bytes."""
    index = build_index(docs, id_col, text_col, capacity, hot, key)
    return index.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_bytes")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {"op3_exact_dedup": op3_exact_dedup}

ORACLES = {
    "op3_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)
"""
}
