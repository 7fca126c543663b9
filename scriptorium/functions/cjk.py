"""Segmentation of Chinese runs by a lexicon of atomic words, and Unicode compatibility forms, as Arrow UDFs."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def atomic(lexicon: Iterable[str]) -> list[str]:
    """The lexicon without entries that are a chain of shorter entries, so that parts of a compound are found."""
    words = {w for w in lexicon if len(w) > 1}

    def splits(w: str, whole: bool = True) -> bool:
        return any(w[:k] in words and (k < len(w) or not whole) and (k == len(w) or splits(w[k:], False)) for k in range(2, len(w) + (not whole)))

    return sorted(w for w in words if not splits(w))


def cut_run(run: str, lexicon: frozenset[str], longest: int) -> list[str]:
    """Longest match from the left; what the lexicon lacks is cut into pairs."""
    out: list[str] = []
    unknown = ""
    i = 0
    while i < len(run):
        n = next((n for n in range(min(longest, len(run) - i), 1, -1) if run[i : i + n] in lexicon), 0)
        if n:
            out += _pairs(unknown)
            unknown = ""
            out.append(run[i : i + n])
            i += n
        else:
            unknown += run[i]
            i += 1
    return out + _pairs(unknown)


def _pairs(run: str) -> list[str]:
    return [run[i : i + 2] for i in range(0, len(run), 2)]


def segmenter(lexicon: Iterable[str]) -> Callable[[Column], Column]:
    """A function from an array of runs to the array of their words; Latin runs pass in lower case."""
    words = frozenset(atomic(lexicon))
    longest = max(map(len, words), default=1)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(runs: pd.Series) -> pd.Series:
        return runs.map(lambda rs: [w for r in rs for w in (cut_run(r, words, longest) if "一" <= r[0] <= "鿿" else [r.lower()])])

    return cut


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Compatibility form; the JVM has none, so texts beyond ASCII, and only they, go through Arrow."""
    return F.coalesce(_nfkc(F.when(F.octet_length(text) != F.length(text), text)), text)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc_each(lists: pd.Series) -> pd.Series:
    return lists.map(lambda ts: [t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in ts], na_action="ignore")


def nfkc_each(texts: Column) -> Column:
    """Compatibility form of every text of an array."""
    beyond = F.exists(texts, lambda t: F.coalesce(F.octet_length(t) != F.length(t), F.lit(False)))
    return F.coalesce(_nfkc_each(F.when(beyond, texts)), texts)
