"""Problem 10: the reading level of each document.

Gradient-boosted regression trees over distributions of sentence length, word length,
vocabulary, syntax (length of clauses, share of function words, insertions, figures) and cohesion.  Function words are the
words that most labelled documents hold, whatever their language.  Vocabulary is graded by the labelled documents: a word's grade is the mean
level of those that hold it, shrunk to the mean of all, and a document in training
doesn't count for its own words.  Of each measure, the trees see the distribution over a
document's sentences, so a title or a stray sentence of another level moves little.

The model is fitted to a bounded sample of labelled documents (``SAMPLE``, chosen by a
hash of the id).  Folds that keep each source together give predictions of unseen sources;
an isotonic regression of the levels on these calibrates the grades, and their errors are reported by source.  Every document is scored, whole.

Edge cases: null, empty and blank texts have no level; null labels don't count; repeated or
disagreeing labels count by their mean; labels of unknown documents are ignored; without any label no level is given;
other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import cut, read

#: Labelled documents that the model is fitted to at most, on average over the hash.
SAMPLE = 6000
FOLDS, TREES, DEPTH, RATE, BINS = 4, 80, 4, 0.12, 32
#: Words that count as function words: those in most of the labelled documents.
FUNCTION_WORDS = 300
#: Weight of the mean level in a word's grade, and labelled documents that a graded word needs.
SHRINK, LEAST_DOCS = 2.0, 2

_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’»)]*\s+|(?<=[。！？])|[\r\n]+|[;；]")
_WORD = re.compile(r"[㐀-鿿]{2}|[㐀-鿿]|[^\W\d_㐀-鿿]+(?:['’-][^\W\d_㐀-鿿]+)*")
_DIGIT, _COMMA = re.compile(r"\d+"), re.compile(r"[,，、(（]")


def words_of(sentence: str) -> list[str]:
    """Words in lower case, of Chinese pairs of characters."""
    return _WORD.findall(sentence)


class Measures:
    """Measures of a batch of texts: per sentence, then their distribution over each text."""

    QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)

    def __init__(self, grades: dict[str, tuple[float, int]], mean: float) -> None:
        self.index = {w: k for k, w in enumerate(grades)}
        self.sum = np.array([0.0, *(g[0] for g in grades.values())])
        self.n = np.array([0, *(g[1] for g in grades.values())])
        self.mean = mean
        # of equally common words those of the lower code point, so that every fit is the same
        common = sorted(grades, key=lambda w: (-grades[w][1], w))[:FUNCTION_WORDS]
        self.function = np.zeros(len(self.sum))
        self.function[[self.index[w] + 1 for w in common]] = 1.0

    def features(self, texts: list[str], own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(matrix, whether the text has any word). own: the text's own level in training, left out of its words' grades."""
        flat: list[str] = []
        sizes: list[int] = []
        of_text: list[int] = []
        extra: list[tuple[int, int]] = []
        whole = np.zeros((len(texts), 4))
        for t, text in enumerate(texts):
            seen: set[str] = set()
            total, before, shared, links = 0, set(), 0.0, 0
            for s in _SENTENCE.split(text.lower()):
                w = words_of(s)
                if not w:
                    continue
                flat += w
                sizes.append(len(w))
                of_text.append(t)
                extra.append((len(_DIGIT.findall(s)), len(_COMMA.findall(s))))
                now = set(w)
                if before:
                    shared += len(now & before) / len(now)
                    links += 1
                before = now
                seen |= now
                total += len(w)
            if total:
                whole[t] = (len(seen) / total**0.5, shared / max(links, 1), np.log1p(total), sum("㐀" <= x[0] <= "鿿" for x in seen) / len(seen))
        some = np.zeros(len(texts), dtype=bool)
        if not flat:
            return np.zeros((len(texts), self.width())), some
        size, text_of = np.array(sizes), np.array(of_text)
        some[text_of] = True
        start = np.cumsum(size) - size
        get = self.index.get
        code = np.fromiter((get(w, -1) for w in flat), np.int64, len(flat)) + 1
        length = np.fromiter(map(len, flat), np.float64, len(flat))
        total_sum, n = self.sum[code], self.n[code].astype(np.float64)
        if own is not None:
            level = np.repeat(own[text_of], size)
            n = np.maximum(n - 1, 0)
            total_sum = np.where(n > 0, total_sum - level, 0.0)
        grade = (total_sum + SHRINK * self.mean) / (n + SHRINK)
        known = (n >= 1).astype(np.float64)
        mean = lambda x: np.add.reduceat(x, start) / size
        per_sentence = [
            mean(grade),
            np.minimum.reduceat(grade, start),
            np.maximum.reduceat(grade, start),
            size.astype(np.float64),
            mean(length),
            mean((length > 7).astype(np.float64)),
            mean(known),
        ]
        own_counts = np.array(extra, dtype=np.float64)
        per_sentence += [own_counts[:, 0] / size, own_counts[:, 1] / size, size / (own_counts[:, 1] + 1), mean(self.function[code])]
        texts_with, first, count = np.unique(text_of, return_index=True, return_counts=True)
        columns = []
        for values in per_sentence:
            order = np.lexsort((values, text_of))
            v = values[order]
            for q in self.QUANTILES:
                columns.append(v[first + np.round(q * (count - 1)).astype(int)])
            columns.append(np.add.reduceat(values, first) / count)
        by_words = np.add.reduceat(per_sentence[0] * size, first) / np.add.reduceat(size, first)
        columns += [by_words, np.log1p(count.astype(float))]
        x = np.zeros((len(texts), self.width()))
        x[texts_with, : len(columns)] = np.array(columns).T
        x[:, len(columns) :] = whole
        return x, some

    @classmethod
    def width(cls) -> int:
        return 11 * (len(cls.QUANTILES) + 1) + 2 + 4


# --- gradient-boosted trees ----------------------------------------------------------------------------------------


class Trees:
    """Boosted regression trees on histograms of binned features, squared error."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> None:
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b, f, k = self._binned(x), x.shape[1], self.bins
        least = max(2, min(10, len(y) // 40))
        self.base, self.model = float(y.mean()), []
        at_all = np.full(len(y), self.base)
        offsets = np.arange(f) * k
        for _ in range(self.trees):
            residual = y - at_all
            node = np.zeros(len(y), dtype=np.int64)
            splits = []
            for d in range(self.depth):
                nodes = 2**d
                cell = (node * (f * k))[:, None] + offsets + b
                s = np.bincount(cell.ravel(), np.repeat(residual, f), nodes * f * k).reshape(nodes, f, k).cumsum(axis=2)
                n = np.bincount(cell.ravel(), minlength=nodes * f * k).reshape(nodes, f, k).cumsum(axis=2)
                all_s, all_n = s[:, :1, -1:], n[:, :1, -1:]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = s**2 / n + (all_s - s) ** 2 / (all_n - n) - all_s**2 / all_n
                gain = np.where((n >= least) & (all_n - n >= least), gain, -1.0).reshape(nodes, -1)
                best = gain.argmax(axis=1)
                feature, cut_at = np.where(gain.max(axis=1) > 1e-9, best // k, 0), np.where(gain.max(axis=1) > 1e-9, best % k, k)
                splits.append((feature, cut_at))
                node = node * 2 + (b[np.arange(len(y)), feature[node]] > cut_at[node])
            leaves = 2**self.depth
            n = np.bincount(node, minlength=leaves)
            value = self.rate * np.bincount(node, residual, leaves) / (n + 1.0)
            self.model.append((splits, value))
            at_all += value[node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        b, out, i = self._binned(x), np.full(len(x), self.base), np.arange(len(x))
        for splits, value in self.model:
            node = np.zeros(len(x), dtype=np.int64)
            for feature, cut_at in splits:
                node = node * 2 + (b[i, feature[node]] > cut_at[node])
            out += value[node]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots of a rising step function of x closest to y."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, v in zip(x[order], y[order], strict=True):
        blocks.append([a, v, 1.0])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            right = blocks.pop()
            left = blocks[-1]
            left[1] = (left[1] * left[2] + right[1] * right[2]) / (left[2] + right[2])
            left[2] += right[2]
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


class Levels:
    """The fitted model: word grades, trees and calibration."""

    def __init__(self, grades: dict[str, tuple[float, int]], mean: float, x: np.ndarray, y: np.ndarray, folds: np.ndarray, sources: np.ndarray) -> None:
        self.measures = Measures(grades, mean)
        held = np.zeros(len(y))
        for k in np.unique(folds):
            rest = folds != k
            held[~rest] = Trees().fit(x[rest], y[rest]).predict(x[~rest]) if rest.sum() >= 10 else y.mean()
        self.knots, self.levels = isotonic(held, y)
        off = np.abs(self.calibrated(held) - y)
        by = pd.DataFrame({"source": sources, "documents": 1, "mean_error": off, "within_half": (off <= 0.5).astype(float)}).groupby("source")
        #: Of each source, the errors of grades from models that didn't see it.
        self.errors = by.agg({"documents": "sum", "mean_error": "mean", "within_half": "mean"}).reset_index()
        self.trees = Trees().fit(x, y)

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.knots, self.levels)

    def grade(self, texts: list[str]) -> np.ndarray:
        x, some = self.measures.features(texts)
        return np.where(some, self.calibrated(self.trees.predict(x)), np.nan)


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, source, level) of the bounded sample of labelled documents."""
    by = labels.where("level is not null").groupBy("doc_id").agg(F.avg("level").alias("level"))
    n = by.count()
    by = by.where(F.pmod(F.xxhash64("doc_id"), F.lit(10**6)) < int(min(1.0, SAMPLE / max(n, 1)) * 10**6))
    return documents.where("trim(text) != ''").join(F.broadcast(by), "doc_id")  # SAMPLE rows of two numbers


def fit_levels(documents: DataFrame, labels: DataFrame) -> Levels | None:
    sample = cut(labelled(documents, labels).select("doc_id", "text", F.coalesce("source", F.lit("")).alias("source"), "level"))
    mean = sample.agg(F.avg("level")).first()[0]
    if mean is None:
        return None

    def grade_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s: dict[str, list[float]] = {}
            for text, level in zip(b["text"], b["level"], strict=True):
                for w in set(words_of(text.lower())):
                    e = s.setdefault(w, [0.0, 0])
                    e[0] += level
                    e[1] += 1
            yield pd.DataFrame({"word": list(s), "s": [e[0] for e in s.values()], "n": [e[1] for e in s.values()]})

    rows = sample.select("text", "level").mapInPandas(grade_words, "word string, s double, n long").groupBy("word").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    grades = {r["word"]: (r["s"], r["n"]) for r in rows.where(F.col("n") >= LEAST_DOCS).toLocalIterator()}  # words of SAMPLE documents
    measures = Measures(grades, mean)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, some = measures.features(b["text"].tolist(), b["level"].to_numpy())
            out = b[["doc_id", "source", "level"]].assign(x=list(x))
            yield out[some]

    got = sample.mapInPandas(measure, "doc_id long, source string, level double, x array<double>").toPandas().sort_values(["doc_id", "level"])
    if got.empty:
        return None
    folds = pd.util.hash_array(got["source"].to_numpy(object), categorize=False) % FOLDS
    return Levels(grades, mean, np.stack(got["x"].to_numpy()), got["level"].to_numpy(), folds, got["source"].to_numpy(object))


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, grade, level): the calibrated grade and the nearest level of every document with text."""
    documents, labels = documents.select("doc_id", "text", "source"), labels.select("doc_id", "level")
    model = fit_levels(documents, labels)
    rows = documents.where("trim(text) != ''").select("doc_id", "text")
    if model is None:
        return rows.select("doc_id", F.lit(None).cast("double").alias("grade"), F.lit(None).cast("int").alias("level"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.iloc[at : at + 500]
                g = shared.value.grade(part["text"].tolist())
                ok = ~np.isnan(g)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[ok], "grade": np.round(g[ok], 4), "level": np.clip(np.round(g[ok]), 1, 4).astype(np.int32)})

    return rows.mapInPandas(run, "doc_id long, grade double, level int")


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return read(spark, sf_dir, "documents", "doc_id", "text", "source"), read(spark, sf_dir, "reading_labels", "doc_id", "level")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(*_inputs(spark, sf_dir)).where("level = 1").select("doc_id").distinct()


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's grade and level."""
    return reading_levels(*_inputs(spark, sf_dir))


def p10_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the cross-validated grades by source: the labelled documents, the mean error, and the share within half a level."""
    model = fit_levels(*_inputs(spark, sf_dir))
    rows = [] if model is None else [(r.source, int(r.documents), round(float(r.mean_error), 4), round(float(r.within_half), 4)) for r in model.errors.itertuples()]
    return spark.createDataFrame(rows, "source string, documents long, mean_error double, within_half double")


QUERIES = {"p10_found": p10_found, "p10_levels": p10_levels, "p10_errors": p10_errors}
SQL: dict[str, str] = {}
