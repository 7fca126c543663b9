"""Incremental ingest: arriving records are deduplicated against the library and appended, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.operators.records import key_of, merge_strict
from scriptorium.shared import in_order


def accepted(library: DataFrame, batch: DataFrame) -> DataFrame:
    """The new records of a batch with ids after the library's greatest. (batch has ord)"""
    top = library.agg(F.coalesce(F.max("paper_id"), F.lit(-1)).alias("top")).first()["top"]
    fresh = merge_strict(library, batch)
    return in_order(fresh.drop("paper_id"), "ord").withColumn("paper_id", F.lit(top) + F.col("n")).drop("n")


def report(library: DataFrame, batch: DataFrame) -> DataFrame:
    """(outcome, records): added, duplicated, or failed for want of a title."""
    ok = batch.where("title is not null and trim(title) != ''")
    new = merge_strict(library, ok).select("ord").withColumn("added", F.lit(True))
    marked = batch.join(new, "ord", "left")
    outcome = F.when(F.col("title").isNull() | (F.trim("title") == ""), "failed").when(F.col("added"), "added").otherwise("duplicated")
    return marked.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("records"))


def stream_into(stream: DataFrame, path: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Appends a stream of records (title, abstract, authors, year, source_id, ord) to the library at path, all that is available.

    A batch that is run again after a failure finds its records in the library and adds nothing.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        library = spark.read.parquet(path)
        fresh = accepted(library, batch).select(*library.columns).cache()
        fresh.write.mode("append").parquet(path)
        if on_batch:
            on_batch(fresh, number)
        fresh.unpersist()

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def content_keys(papers: DataFrame) -> DataFrame:
    return papers.select(key_of().alias("content_key"), "paper_id")
