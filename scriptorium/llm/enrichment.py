"""Problem 6: how characteristic a term is of a record within the collection.

A record of n terms is a draw from the collection's N terms, of which K are the term
scored.  The hypergeometric probability of at least the k occurrences seen comes from log-gamma differences in
vectorised functions; the score is its negative decimal logarithm, adjusted for false discoveries over all pairs of
record and term, and minus_log_p the same without the adjustment.

Terms are counted within each batch before they are shuffled.  The counts of frequent terms,
of which there can be at most ``FREQUENT`` by their share of all terms, are broadcast, so their pairs are scored where they
are read; pairs of the remaining, rare terms meet their counts in a join that no hot
term takes part in.  The adjustment takes ranks from a histogram of the log
probabilities with ``BINS`` bins a nat: a pair's rank is one more than the number of pairs in
likelier-than-chance bins beyond its own, so the adjusted probability is never understated,
and by no more than a bin's width overstated: 1/32 nat, 0.0136 of the score.

Edge cases: null and empty fields hold no terms; a record without terms has no rows; rows
repeated under one id are records of their own, with rows of their own; ties have equal scores;
texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import cut, read

#: Terms whose counts are broadcast at most: those that make up at least such a part of all terms.
FREQUENT = 100_000
#: Bins of the histogram for each nat, and nats that it covers.
BINS, NATS = 32, 700

_TERM = re.compile(r"[㐀-鿿]+|[^\W\d_㐀-鿿][^\W_㐀-鿿]*(?:-[^\W_㐀-鿿]+)*")


_HAN = re.compile("[㐀-鿿]")


def terms(text: str) -> list[str]:
    """Words in lower case; of a run of Chinese characters each pair, or the character if it stands alone."""
    low = text.lower()
    found = _TERM.findall(low)
    if low.isascii() or not _HAN.search(low):
        return found
    out = []
    for w in found:
        if "㐀" <= w[0] <= "鿿" and len(w) > 2:
            out += [w[i : i + 2] for i in range(len(w) - 1)]
        else:
            out.append(w)
    return out


# --- hypergeometric tail -------------------------------------------------------------------------------------------


#: log n! of small n, summed up once; beyond it Stirling's series, whose error there is below 1e-20.
_SMALL = 1 << 16
_LOG_FACTORIAL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _SMALL, dtype=np.float64)))])


def _log_falling(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """log x! - log (x - m)! for 0 <= m <= x, without cancelling: by table, or Stirling's series of the difference."""
    small = x < _SMALL
    if small.all():
        return _LOG_FACTORIAL[x.astype(np.int64)] - _LOG_FACTORIAL[(x - m).astype(np.int64)]
    y, d = np.maximum(x, 1.0), m
    z = np.maximum(y - d, 0.5)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = d * np.log(y) - (z + 0.5) * np.log1p(-d / y) - d + (1 / y - 1 / z) / 12
    # few left of many: the series isn't good for the small end
    near = ~small & (x - m < 100)
    if near.any():
        a, b = x[near], (x - m)[near].astype(np.int64)
        out[near] = (a + 0.5) * np.log(a) - a + 0.5 * np.log(2 * np.pi) + 1 / (12 * a) - _LOG_FACTORIAL[b]
    if small.any():
        a = np.where(small, x, 0).astype(np.int64)
        out = np.where(small, _LOG_FACTORIAL[a] - _LOG_FACTORIAL[np.where(small, x - m, 0).astype(np.int64)], out)
    return out


def log_pmf(j: np.ndarray, K: np.ndarray, n: np.ndarray, N: float) -> np.ndarray:
    """log P(X = j) of j marked among n drawn from N of which K are marked."""
    j, K, n = (np.asarray(v, dtype=np.float64) for v in (j, K, n))
    f = _log_falling
    ok = (j >= 0) & (j <= np.minimum(K, n)) & (n - j <= N - K)
    i = np.where(ok, j, np.maximum(n - (N - K), 0))
    return np.where(ok, f(K, i) - f(i, i) + f(n, i) + f(N - K, n - i) - f(np.full_like(n, N), n), -np.inf)


_CHUNK = 1 << 16


def log_tail(k: np.ndarray, K: np.ndarray, n: np.ndarray, N: float) -> np.ndarray:
    """log P(X >= k), elementwise."""
    k, K, n = (np.asarray(v, dtype=np.float64) for v in (k, K, n))
    if not len(k):
        return np.zeros(0)
    if len(k) > _CHUNK:  # arrays that stay in the processor's cache take half the time
        return np.concatenate([log_tail(k[i : i + _CHUNK], K[i : i + _CHUNK], n[i : i + _CHUNK], N) for i in range(0, len(k), _CHUNK)])
    once = (k == 1) & (n <= N - K)
    out = np.zeros(len(k))
    if once.any():
        # at least one: one minus the probability of none, which doesn't cancel
        a, b = K[once], n[once]
        drawn, back = np.unique(b, return_inverse=True)
        out[once] = np.log(-np.expm1(_log_falling(N - a, b) - _log_falling(np.full_like(drawn, N), drawn)[back]))
    rest = ~once
    out[rest] = _log_tail(k[rest], K[rest], n[rest], N)
    return out


def _log_tail(k: np.ndarray, K: np.ndarray, n: np.ndarray, N: float) -> np.ndarray:
    if not len(k):
        return np.zeros(0)
    lead = log_pmf(k, K, n, N)
    upper = k > n * K / N
    # from k up where k is beyond the mean, else one minus the part below k
    j = np.where(upper, k, k - 1)
    first = np.where(upper, lead, 0.0)
    term = np.ones(len(k))
    low = ~upper
    term[low] = np.exp(np.clip(log_pmf(j[low], K[low], n[low], N), -745, 700))
    total = np.where(j >= np.maximum(n - (N - K), 0), term, 0.0)
    live = np.flatnonzero(total > 0)
    cur, jj = term[live], j[live]
    while len(live):
        up, a, b = upper[live], K[live], n[live]
        rest = N - a - b
        step = np.where(up, (a - jj) * (b - jj) / ((jj + 1) * np.maximum(rest + jj + 1, 1)), jj * np.maximum(rest + jj, 0) / np.maximum((a - jj + 1) * (b - jj + 1), 1e-300))
        cur = cur * step
        jj = jj + np.where(up, 1, -1)
        total[live] += cur
        go = (cur > 1e-12 * total[live]) & (jj >= 0)
        live, cur, jj = live[go], cur[go], jj[go]
    with np.errstate(divide="ignore"):
        return np.where(upper, first + np.log(total), np.log(np.maximum(1.0 - total, 1e-16)))


# --- counts --------------------------------------------------------------------------------------------------------


def record_texts(papers: DataFrame) -> DataFrame:
    """(id, text): a record's fields, one on each line."""
    return papers.select("id", F.concat_ws("\n", "title", "abstract", F.array_join("keywords", "\n")).alias("text")).where("text != ''")


def _batch_terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms, code of each term, number of terms of each text)."""
    flat: list[str] = []
    n = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        own = terms(t)
        n[i] = len(own)
        flat += own
    code, distinct = pd.factorize(np.array(flat, dtype=object))
    return distinct, code, n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        distinct, code, _ = _batch_terms(b.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(distinct, pa.string()), pa.array(np.bincount(code, minlength=len(distinct)))], names=["term", "n"])


def term_counts(texts: DataFrame) -> DataFrame:
    """(term, n) over all records."""
    return texts.select("text").mapInArrow(_count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _pairs(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms; record, term code and k of each pair; n of each record)."""
    distinct, code, n = _batch_terms(b.column("text").to_pylist())
    record = np.repeat(np.arange(len(n)), n)
    width = max(len(distinct), 1)
    pair, k = np.unique(record * width + code, return_counts=True)
    return distinct, pair // width, pair % width, k, n


#: kind 0: paper_id is a bin of the histogram and k its pairs; kind 1: a pair of a rare term, in a record of so many terms.
_FIRST = "kind int, paper_id long, term string, k long, terms long"
_SCORED = "paper_id long, term string, k long, log_p double"


def _scored_pairs(b: pa.RecordBatch, frequent: dict[str, int], total: int) -> tuple:
    """(pairs as _pairs has them, count of each term, log p of the pairs of frequent terms, which those are)."""
    pairs = distinct, record, code, k, n = _pairs(b)
    count = np.fromiter((frequent.get(t, 0) for t in distinct), np.int64, len(distinct))
    ok = count[code] > 0
    return pairs, ok, log_tail(k[ok], count[code[ok]], n[record[ok]], float(total))


def _first_pass(shared, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "paper_id", "term", "k", "terms"]
        for b in batches:
            (distinct, record, code, k, n), ok, log_p = _scored_pairs(b, shared.value, total)
            at, pairs = np.unique(_bin(log_p), return_counts=True)
            nothing = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(at), np.int32)), pa.array(at), pa.nulls(len(at), pa.string()), pa.array(pairs), nothing], names=names)
            r = ~ok
            ids = b.column("id").to_numpy()[record[r]]
            words = pa.array(distinct, pa.string()).take(pa.array(code[r]))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(ids), np.int32)), pa.array(ids), words, pa.array(k[r]), pa.array(n[record[r]])], names=names)

    return run


def _last_pass(shared, total: int, adjust: Adjustment):
    emit = _final(adjust)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (distinct, record, code, k, _), ok, log_p = _scored_pairs(b, shared.value, total)
            yield emit(b.column("id").to_numpy()[record[ok]], pa.array(distinct, pa.string()).take(pa.array(code[ok])), k[ok], log_p)

    return run


def _bin(log_p: np.ndarray) -> np.ndarray:
    return np.minimum((-log_p * BINS).astype(np.int64), NATS * BINS - 1).clip(0)


def _histogram(log_p: np.ndarray) -> pa.RecordBatch:
    at, n = np.unique(_bin(log_p), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["at", "n"])


class Adjustment:
    """False-discovery adjusted probabilities from the histogram of all pairs."""

    def __init__(self, at: np.ndarray, n: np.ndarray) -> None:
        counts = np.zeros(NATS * BINS, dtype=np.float64)
        counts[at] = n
        self.pairs = counts.sum()
        beyond = counts[::-1].cumsum()[::-1] - counts  # pairs in bins less likely by chance
        edge = -np.arange(NATS * BINS) / BINS  # log of the largest probability in a bin
        with np.errstate(divide="ignore"):
            self.shift = np.log(self.pairs) - np.log(beyond + 1)
            # at a bin's largest probability all its pairs are ranked; smaller probabilities can't be adjusted to more
            reached = edge + np.log(self.pairs) - np.log(np.maximum(beyond + counts, 1))
        self.limit = np.minimum.accumulate(np.where(counts + beyond > 0, reached, np.inf))

    def log_q(self, log_p: np.ndarray) -> np.ndarray:
        b = _bin(log_p)
        return np.minimum(np.minimum(log_p + self.shift[b], self.limit[b]), 0.0)


_OUT = "paper_id long, term string, k long, score double, minus_log_p double"


def _final(adjust: Adjustment):
    def emit(ids, terms_, k, log_p) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), terms_, pa.array(k), *(pa.array(np.round(-x / np.log(10), 6) + 0.0) for x in (adjust.log_q(log_p), log_p))], names=["paper_id", "term", "k", "score", "minus_log_p"]
        )

    return emit


def distinctive_terms(papers: DataFrame, frequent_bound: int = FREQUENT) -> DataFrame:
    """(paper_id, term, k, score, minus_log_p) of every pair of record and term."""
    spark = papers.sparkSession
    texts = record_texts(papers)
    counts = cut(term_counts(texts))
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = total // frequent_bound + 1  # no more than frequent_bound terms can be as frequent
    frequent = {r["term"]: r["n"] for r in counts.where(F.col("n") >= least).toLocalIterator()}
    shared = spark.sparkContext.broadcast(frequent)

    def score_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, n, c = (b.column(x).to_numpy() for x in ("k", "terms", "n"))
            yield pa.RecordBatch.from_arrays([b.column("paper_id"), b.column("term"), b.column("k"), pa.array(log_tail(k, c, n, float(total)))], names=["paper_id", "term", "k", "log_p"])

    first = cut(texts.mapInArrow(_first_pass(shared, total), _FIRST))
    bins = first.where("kind = 0").select(F.col("paper_id").alias("at"), F.col("k").alias("n"))
    rare = None
    if least > 1:
        met = first.where("kind = 1").drop("kind").join(counts.where(F.col("n") < least), "term")
        rare = cut(met.mapInArrow(score_rare, _SCORED))
        bins = bins.unionByName(rare.mapInArrow(lambda bs: (_histogram(b.column("log_p").to_numpy()) for b in bs), "at long, n long"))
    h = bins.groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # at most NATS * BINS rows
    adjust = Adjustment(h["at"].to_numpy(np.int64), h["n"].to_numpy(np.float64))
    out = texts.mapInArrow(_last_pass(shared, total, adjust), _OUT)
    if rare is None:
        return out
    emit = _final(adjust)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield emit(b.column("paper_id").to_numpy(), b.column("term"), b.column("k").to_numpy(), b.column("log_p").to_numpy())

    return out.unionByName(rare.mapInArrow(finish, _OUT))


def p6_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive_terms(read(spark, sf_dir, "papers", "id", "title", "abstract", "keywords"))


QUERIES = {"p6_terms": p6_terms}
SQL: dict[str, str] = {}
