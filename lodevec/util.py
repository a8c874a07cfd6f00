"""Helpers shared by the operators: cutting lineage, sizing shuffles, reading tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a temporary one only if it names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="lodevec-")
    return _OWN_DIR[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        pass


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut and a lost executor costs nothing.

    The table is removed when the driver ends, and the shuffle files of the write when it ends: nothing else reads them, and
    the context cleaner would leave them until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodevec-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodevec_path = path
    return out


def drop_settled(df: DataFrame) -> None:
    """Remove a settled table that no later step reads."""
    path = getattr(df, "_lodevec_path", None)
    if path:
        _delete(df.sparkSession, path)


def numbered(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Add dense numbers from ``start``: by ``order``, or in the order of partitions and rows if it is empty.

    Range partitions are sorted and written; each starts at the sum of the sizes of those before it. The driver sees one
    count per partition, and no task sees more than its partition.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    tagged = settle(rows.withColumn("__m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__m", 33)
    at, starts = start, []
    for p, n in sorted((r[0], r[1]) for r in tagged.groupBy(part).count().collect()):
        starts.append((p, at))
        at += n
    offsets = df.sparkSession.createDataFrame(starts, "__p bigint, __s bigint")
    number = F.col("__s") + F.col("__m").bitwiseAND((1 << 33) - 1)
    return tagged.join(F.broadcast(offsets), part == F.col("__p")).withColumn(name, number).drop("__m", "__p", "__s")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): the lines of text files with their numbers from 1 within the file."""
    lines = numbered(spark.read.text(path).select("value", F.input_file_name().alias("file")), [], "n")
    first = lines.groupBy(F.col("file").alias("of")).agg(F.min("n").alias("start"))
    return lines.join(first, F.col("file") == F.col("of")).select("file", (F.col("n") - F.col("start") + 1).alias("line_no"), "value")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def md5_long(col):
    """128-bit digest of a string column as binary: equality of digests stands for equality of texts."""
    return F.unhex(F.md5(col))
