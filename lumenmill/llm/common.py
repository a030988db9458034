"""Reading tables, stages in the shared folder, and shipping functions to workers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import lumenmill

# Functions travel with the job, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(lumenmill)

#: Rows of text in one Arrow batch; batches are cut further by bytes where it matters.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on: small Arrow batches, and shuffle files
    that go when the write which needed them has ended."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one in the warehouse;
    with a local master, where there is no other machine, a temporary one."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("lumenmill.shared.dir", None)
    if not path:
        local = re.match(r"local(\[|$)", spark.sparkContext.master)
        path = tempfile.mkdtemp(prefix="lumenmill-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lumenmill-stages"
        spark.conf.set("lumenmill.shared.dir", path)
    return path.rstrip("/")


#: What a file of a stage holds, where the rows or the bytes of text are known beforehand.
FILE_ROWS, FILE_BYTES = 100_000, 16 << 20


def files(spark: SparkSession, rows: int, size: int = 0) -> int:
    """Files for so many rows of numbers and bytes of text: two for each core at least."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS), -(-size // FILE_BYTES))


def stage(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost
    executor costs no more than the tasks it was running. Partitions are put together into `most`
    files at most: in a local folder a JVM without Hadoop's native library starts a process (chmod)
    for each file, its checksum and its folder, and while one starts it counts with all the memory
    of the JVM."""
    spark = df.sparkSession
    df = df.coalesce(most) if most else df
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of stages that nothing reads any more."""
    for df in frames:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a table that are each worth more than this share of all rows: so many at most.
HOT_ROWS = 20_000


def join_counted(left: DataFrame, right: DataFrame, on: list[str], total: int, how: str = "inner") -> DataFrame:
    """Inner or left join with a staged table of distinct keys and `c`, how many rows of left (or of
    what stands for them) have each. Keys with more than a HOT_ROWS-th of `total` are broadcast, so
    their rows stay where they are: HOT_ROWS keys at most."""
    line = max(1000, total // HOT_ROWS)
    hot = F.broadcast(right.filter(F.col("c") > line))
    cold = left.join(hot.select(*on), on, "left_anti").join(right.filter(F.col("c") <= line), on, how)
    return left.join(hot, on).unionByName(cold)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n
