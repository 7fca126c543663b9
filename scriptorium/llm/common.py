"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """A table of the data folder, reduced to the columns that are used."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where none is set, a local folder if Spark runs on one machine, else an error."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="scriptorium-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared checkpoint folder, so that executors may be lost and nothing runs twice."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a compressed table of columns: smaller, and later reads take the columns they need; the partitioning is lost."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a bucket, and buckets that Spark allows.
BUCKET_ROWS, MOST_BUCKETS = 400_000, 100_000


def bucketed(df: DataFrame, column: str, rows: int) -> tuple[DataFrame, int]:
    """``df`` written to the shared folder in buckets of ``column``, and their number: joins on it don't move these rows again."""
    spark = df.sparkSession
    n = min(max(spark.sparkContext.defaultParallelism, -(-rows // BUCKET_ROWS)), MOST_BUCKETS)
    name = f"scriptorium_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark)}/{name}"
    df.repartition(n, column).write.bucketBy(n, column).option("path", path).saveAsTable(name)
    return spark.table(name), n


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parallelism(spark: SparkSession) -> int:
    """At least the cores at hand and at least the shuffle partitions asked for."""
    return max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)


def beyond_ascii(c: Column) -> Column:
    """Whether a text has a character beyond ASCII; far cheaper than a pattern."""
    return F.octet_length(c) != F.length(c)


def char_class(chars: Iterable[str]) -> str:
    """The inside of a Java or Python character class holding ``chars``, adjacent code points joined to ranges."""
    points = sorted({ord(c) for c in chars})
    runs: list[list[int]] = []
    for p in points:
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    esc = lambda p: f"\\x{{{p:x}}}"
    return "".join(esc(a) if a == b else f"{esc(a)}-{esc(b)}" for a, b in runs)
