"""Materialising tables in the folder that the cluster's executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where none is set, a local folder if Spark runs on one machine, else an error."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="scriptorium-"))
    return sc._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """The table written to the shared folder: lineage ends there, and lost executors lose nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def in_order(df: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """The rows numbered from 1 in an order, without bringing them into one task.

    Ranges of the order are numbered on their own and shifted by the counts of the ranges before: a row for each partition.
    """
    placed = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part, within = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["p"], r["c"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("c")).collect())
    before, total = {}, 0
    for p, c in sizes:
        before[p] = total
        total += c
    shift = df.sparkSession.createDataFrame(list(before.items()), "_p long, _before long")
    numbered = placed.withColumn("_p", part).join(F.broadcast(shift), "_p")
    return numbered.withColumn(name, F.col("_before") + within + 1).drop("_p", "_m", "_before")
