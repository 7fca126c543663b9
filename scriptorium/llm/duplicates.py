"""Problem 5: records that are identical but for their formatting.

Each record is brought to a canonical key of its title, abstract, authors and year.
The records are range-partitioned and sorted by (hash of the key, key, id) and
each partition is scanned for runs of equal full keys.  The hash spreads evenly and
the id is part of the range, so a key that holds a third of all rows is split
over partitions.  Only runs that touch a partition's ends can
go on in the next: their summaries, at most two a partition, are stitched and joined back.

Edge cases: null and empty fields count as the same; a record whose fields are all
empty is a record like any other; texts are compared whole; rows repeated under
one id count as copies but give no pair of an id with itself; an empty table gives an
empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import cut, parallelism, read

def letters(c: Column) -> Column:
    """Letters, digits and marks in lower case; everything else is formatting."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}\p{M}]+", ""))


#: What stands between the parts of a name; hyphens and apostrophes are within a part, and Chinese names are one part.
APART, HAN = r"[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000},;.·•]+", r"[\x{3400}-\x{9fff}]"


def name_key(c: Column) -> Column:
    """A name without case, punctuation and the order of its parts."""
    parts = F.filter(F.transform(F.split(c, APART), letters), lambda x: x != "")
    return F.coalesce(F.when(c.rlike(HAN), letters(c)).otherwise(F.array_join(F.sort_array(parts), " ")), F.lit(""))


def canonical_key(title: str = "title", abstract: str = "abstract", authors: str = "authors", year: str = "year") -> Column:
    names = F.filter(F.transform(F.coalesce(F.col(authors), F.array().cast("array<string>")), name_key), lambda x: x != "")
    return F.concat_ws(
        "␟",
        letters(F.col(title)),
        F.array_join(F.array_sort(names), "␞"),
        F.coalesce(F.col(year).cast("string"), F.lit("")),
        letters(F.col(abstract)),
    )


_ROWS = "part int, kind int, id long, keep_id long, n long, digest binary"
COPY, RUN, FIRST, LAST = 0, 1, 2, 4


def _scan(every_run: bool):
    """Streams over one sorted partition, comparing each full key with the one before.

    Yields a COPY row for each record that follows the first of its run, and for each record of the
    partition's first run; a RUN row for each run (every_run) or those at the partition's ends.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last_key, keep, rows, run = None, None, 0, 0

        def closed(kind: int) -> tuple:
            return kind | (FIRST if run == 1 else 0), keep, keep, rows, hashlib.sha256(last_key.encode()).digest()

        for b in batches:
            if not b.num_rows:
                continue
            key, ids = b.column("key"), b.column("id").to_numpy()
            differs = np.ones(len(ids), dtype=bool)
            differs[1:] = pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
            differs[0] = key[0].as_py() != last_key
            starts = np.flatnonzero(differs)
            number = np.cumsum(differs) - 1  # of the run within the batch, -1: the run going on
            size = np.bincount(number + 1, minlength=len(starts) + 1)
            keeps = np.concatenate([[keep if keep is not None else 0], ids[starts]])
            out = []
            rows += int(size[0])
            if len(starts):
                if last_key is not None and (every_run or run == 1):
                    out.append(closed(RUN))
                before = run
                # runs that begin and end in this batch: all of them, or only the partition's first
                for j in range(len(starts) - 1) if every_run else range(min(1, len(starts) - 1) if run == 0 else 0):
                    run = before + j + 1
                    keep, rows, last_key = int(ids[starts[j]]), int(size[j + 1]), key[int(starts[j])].as_py()
                    out.append(closed(RUN))
                run = before + len(starts)
                keep, rows, last_key = int(ids[starts[-1]]), int(size[-1]), key[int(starts[-1])].as_py()
            first_run = run - len(starts) + 1 + number == 1 if len(starts) else np.full(len(ids), run == 1)
            copy = ~differs | first_run
            made = [(COPY | (FIRST if f else 0), int(i), int(k), 1, None) for f, i, k in zip(first_run[copy], ids[copy], keeps[number[copy] + 1], strict=True)]
            if out or made:
                yield _batch(part, out + made)
        if last_key is not None:
            yield _batch(part, [closed(RUN | LAST)])

    return scan


def _batch(part: int, rows: list[tuple]) -> pa.RecordBatch:
    kind, ids, keep, n, digest = zip(*rows, strict=True)
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([part] * len(rows), kind, ids, keep, n, digest), types, strict=True)], names=["part", "kind", "id", "keep_id", "n", "digest"])


def sorted_runs(records: DataFrame, key: Column, every_run: bool) -> tuple[DataFrame, DataFrame]:
    """(copies, runs): (id, keep_id) of every record but its group's first; (keep_id, n) of every group, or with
    ``every_run`` false none."""
    n = parallelism(records.sparkSession)
    r = records.select("id", key.alias("key"))
    r = r.select("id", "key", F.xxhash64("key").alias("h"), F.xxhash64("key", F.lit(1)).alias("g"))
    r = r.repartitionByRange(n, "h", "g", "id").sortWithinPartitions("h", "g", "key", "id")
    scanned = cut(r.select("id", "key").mapInArrow(_scan(every_run), _ROWS))
    # at most two rows of each partition: its first and its last run
    ends = scanned.where(F.col("kind").bitwiseAND(RUN) != 0).where(F.col("kind").bitwiseAND(FIRST | LAST) != 0).orderBy("part").collect()
    going_on, carried = {}, None
    for part in sorted({e["part"] for e in ends}):
        own = [e for e in ends if e["part"] == part]
        first = next(e for e in own if e["kind"] & FIRST)
        last = next(e for e in own if e["kind"] & LAST)
        if carried and carried[0] == first["digest"]:
            going_on[part] = carried[1]
        carried = (last["digest"], going_on[part] if last is first and part in going_on else last["keep_id"])
    fix = records.sparkSession.createDataFrame(list(going_on.items()), "part int, carried long")
    fixed = scanned.join(F.broadcast(fix), "part", "left")  # at most a row for each partition
    first = F.col("kind").bitwiseAND(FIRST) != 0
    fixed = fixed.withColumn("keep_id", F.when(first, F.coalesce("carried", "keep_id")).otherwise(F.col("keep_id")))
    copies = fixed.where(F.col("kind").bitwiseAND(RUN) == 0).where("id != keep_id").select("id", "keep_id")
    groups = fixed.where(F.col("kind").bitwiseAND(RUN) != 0).groupBy("keep_id").agg(F.sum("n").alias("n"))
    return copies, groups


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = read(spark, sf_dir, "papers", "id", "title", "abstract", "authors", "year")
    copies, _ = sorted_runs(papers, canonical_key(), every_run=False)
    return copies.select("keep_id", F.col("id").alias("copy_id")).distinct()


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record of each group with the number of its copies, itself included."""
    papers = read(spark, sf_dir, "papers", "id", "title", "abstract", "authors", "year")
    _, groups = sorted_runs(papers, canonical_key(), every_run=True)
    return papers.join(groups.withColumnRenamed("keep_id", "id"), "id").select("id", "title", "year", F.col("n").alias("copies"))


QUERIES = {"p5_found": p5_found, "p5_records": p5_records}


def _letters_sql(x: str) -> str:
    return f"lower(regexp_replace(coalesce({x}, ''), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', '', 'g'))"


_NAME_SQL = f"""CASE WHEN a IS NULL THEN '' WHEN regexp_matches(a, '{HAN}') THEN {_letters_sql("a")}
ELSE array_to_string(list_sort(list_filter(list_transform(string_split_regex(a, '{APART}'), lambda x: {_letters_sql("x")}), lambda x: x <> '')), ' ') END"""
_RECORDS_SQL = f"""WITH k AS (SELECT id, title, year, {_letters_sql("title")} AS t, {_letters_sql("abstract")} AS x,
list_sort(list_filter(list_transform(coalesce(authors, []::VARCHAR[]), lambda a: {_NAME_SQL}), lambda n: n <> '')) AS names FROM papers),
g AS (SELECT *, min(id) OVER (PARTITION BY t, x, names, year) AS keep_id, count(*) OVER (PARTITION BY t, x, names, year) AS copies FROM k)"""
SQL: dict[str, str] = {
    "p5_found": f"{_RECORDS_SQL} SELECT keep_id, id AS copy_id FROM g WHERE id <> keep_id",
    "p5_records": f"{_RECORDS_SQL} SELECT id, title, year, copies FROM g WHERE id = keep_id",
}
