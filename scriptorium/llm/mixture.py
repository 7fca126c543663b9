"""Problem 9: a mix of sources in target shares of tokens, by balanced sampling.

The size of the mix is the largest that every target can be met at, given how often a
document may be used.  A source's documents are then each used r times on average,
r = share x size / tokens of the source: floor(r) times for certain and once more with
probability r - floor(r).  The cube method draws which: within blocks of a source, inclusion
probabilities move through the null space of the constraints (number of documents, number of tokens) until
all but as many documents as there are constraints are in or out; what is left over
of the blocks forms new blocks, until one block a source remains, whose landing problem is solved
by trying all outcomes.

Documents are spread over blocks by a hash, so a source that holds most of the corpus is many
blocks; no block grows with the data.

Edge cases: null and empty texts have no tokens and aren't chosen; documents without a source or
of a source without target have share 0; a target without documents or tokens can't be met and is reported
with share 0; repeated doc_ids are one row each; an empty table gives an empty mix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import cut, parallelism, read
from scriptorium.llm.tokens import token_counts, vocabulary_path

#: Documents of a block, and of them those that the last block of a source keeps for the landing.
BLOCK, LANDING = 4000, 12
_EPS = 1e-9


def fly(pi: np.ndarray, x: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """The flight phase: probabilities of which all but len(constraints) are 0 or 1, with the same constraint totals.

    x: a row of constraint values for each unit, divided by the unit's probability in the usual statement; here
    totals of x * pi are kept.
    """
    pi = pi.astype(float).copy()
    p = x.shape[1]
    moving = [int(i) for i in np.flatnonzero((pi > _EPS) & (pi < 1 - _EPS))]
    window: list[int] = []
    at = 0
    while True:
        while len(window) < p + 1 and at < len(moving):
            window.append(moving[at])
            at += 1
        if len(window) < p + 1:
            return pi
        a = x[window].T
        u = _null_vector(a)
        if u is None:
            return pi
        q = pi[window]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)).min()
            down = np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)).min()
        step = up if draw.random() * (up + down) < down else -down
        q = np.clip(q + step * u, 0, 1)
        pi[window] = q
        window = [i for i, v in zip(window, q, strict=True) if _EPS < v < 1 - _EPS]


def _null_vector(a: np.ndarray) -> np.ndarray | None:
    """A vector that a maps to 0; for two constraints on three units the cross product."""
    if a.shape == (2, 3):
        u = np.cross(a[0], a[1])
        if np.abs(u).max() > 1e-12:
            return u / np.abs(u).max()
    u = np.linalg.svd(a)[2][-1]
    return u if np.abs(a @ u).max() < 1e-6 * max(1.0, np.abs(a).max()) else None


def land(pi: np.ndarray, x: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Settles the few units left so that the constraint totals change least: all outcomes are tried."""
    pi = pi.copy()
    left = np.flatnonzero((pi > _EPS) & (pi < 1 - _EPS))
    if len(left):
        settled = np.where((pi > _EPS) & (pi < 1 - _EPS), 0.0, np.round(pi)) @ x
        outcomes = (np.arange(2 ** len(left))[:, None] >> np.arange(len(left)) & 1).astype(float)
        off = np.abs(outcomes @ x[left] + settled - total) / np.maximum(np.abs(total), 1.0)
        pi[left] = outcomes[off.sum(axis=1).argmin()]
    return np.round(pi)


_UNITS = "source string, doc_id long, n_tokens long, pi double"


def _fly_block(last: bool):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["doc_id", "n_tokens"], kind="stable")
        x = np.column_stack([np.ones(len(block)), block["n_tokens"].to_numpy(float)])
        start = block["pi"].to_numpy(float)
        draw = np.random.default_rng(abs(int(block["doc_id"].iloc[0])) % (2**32))
        pi = start.copy()
        flying = np.ones(len(block), dtype=bool)
        if last:
            # some documents stay for the landing, so that its outcomes are fine enough
            flying[draw.permutation(len(block))[:LANDING]] = False
        pi[flying] = fly(pi[flying], x[flying], draw)
        if last:
            pi = land(pi, x, start @ x)
        return block[["source", "doc_id", "n_tokens"]].assign(pi=pi)

    return run


def sample_balanced(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source, doc_id, n_tokens, pi in {0, 1}) from fractional pi, balanced on documents and tokens of each source."""
    settled = units.where(f"pi <= {_EPS} or pi >= {1 - _EPS}").withColumn("pi", F.round("pi"))
    moving = units.where(f"pi > {_EPS} and pi < {1 - _EPS}")
    level = 0
    while True:
        sizes = moving.groupBy("source").agg(F.count("*").alias("rows"))
        sizes = cut(sizes) if level == 0 else sizes
        blocks = sizes.select("source", F.ceil(F.col("rows") / F.lit(block)).alias("blocks"))
        most = blocks.agg(F.max("blocks")).first()[0] or 0
        last = most <= 1
        b = moving.join(F.broadcast(blocks), "source").withColumn("b", F.pmod(F.xxhash64("doc_id", F.lit(level)), F.col("blocks")))  # a row for each source
        # a fixed number of partitions: by size alone the blocks, whose work is long for their bytes, would be put into one task
        flown = b.repartition(parallelism(units.sparkSession), "source", "b").groupBy("source", "b").applyInPandas(_fly_block(last), _UNITS)
        if last:
            return settled.unionByName(flown)
        flown = cut(flown)
        settled = settled.unionByName(flown.where(f"pi <= {_EPS} or pi >= {1 - _EPS}").withColumn("pi", F.round("pi")))
        moving = flown.where(f"pi > {_EPS} and pi < {1 - _EPS}")
        level += 1


def mix(counts: DataFrame, targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source, doc_id, n_tokens, repeats) of the chosen documents. counts: (source, doc_id, n_tokens)."""
    goal = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most"))
    have = counts.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    plan = goal.join(have, "source")
    size = F.min(F.col("most") * F.col("tokens") / F.col("share"))
    total = plan.agg(size.alias("total"))
    # one row of a few numbers for each target
    rate = cut(plan.crossJoin(F.broadcast(total)).select("source", "most", (F.col("share") * F.col("total") / F.col("tokens")).alias("r")))
    c = counts.where("n_tokens > 0").join(F.broadcast(rate), "source")
    whole = F.least(F.floor(F.col("r") + 1e-12), F.col("most"))
    c = cut(c.select("source", "doc_id", "n_tokens", whole.alias("whole"), F.greatest(F.lit(0.0), F.col("r") - whole).alias("pi")))
    drawn = sample_balanced(c.select("source", "doc_id", "n_tokens", "pi"), block).select("source", "doc_id", "n_tokens", F.col("pi").cast("long").alias("more"))
    base = c.where("whole > 0").select("source", "doc_id", "n_tokens", F.col("whole").cast("long").alias("more"))
    return base.unionByName(drawn).groupBy("source", "doc_id", "n_tokens").agg(F.sum("more").alias("repeats")).where("repeats > 0")


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, tokens, documents, share) of every target."""
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"))
    all_tokens = got.agg(F.sum("tokens").alias("all"))
    both = targets.select("source", "target_share").join(got, "source", "left").crossJoin(F.broadcast(all_tokens))  # one row
    n = F.coalesce("tokens", F.lit(0))
    return both.select("source", "target_share", n.alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.round(F.coalesce(n / F.col("all"), F.lit(0.0)), 6).alias("share"))


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    documents = read(spark, sf_dir, "documents", "doc_id", "source", "text").where("text != '' and source is not null")
    targets = read(spark, sf_dir, "mix_targets", "source", "target_share", "max_repeats")
    wanted = documents.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")  # a row for each source
    return cut(token_counts(wanted, vocabulary_path(spark), "source", "doc_id")), targets


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents with their repeats."""
    return mix(*_inputs(spark, sf_dir))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source."""
    counts, targets = _inputs(spark, sf_dir)
    return shares(mix(counts, targets), targets)


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
