"""Problem 1: the same publications in two sources without a shared identifier.

A deterministic cascade.  Both sides are first reduced to classes: papers that are
the same record but for formatting, and fetched rows of one record.  Each pass joins the unresolved
fetched classes exactly with the papers on the keys of its rules, from strong attribute combinations to
weak ones (title, sentences of the abstract, parts of author names, year, and the title
with one word or character left out).  A catalogue may hold a publication twice, so any number of fetched
classes may link to one paper; a key links only if it belongs to one class of papers, which is found by
aggregating before the join: no key makes more pairs than it has fetched classes, and a key that several
papers share is left to the keys that add an attribute.
Pairs whose other attributes contradict each other are dropped, what is linked is
anti-joined, and the next pass sees the rest of the fetched classes.

A rule's confidence is its labelled precision, smoothed: of its pairs for which an
attribute that the rule doesn't use is known on both sides, the share that agrees in it, or, where labels are
given, the share of true pairs.

Edge cases: null and empty fields make no key; a record without title, abstract and authors
stays unlinked; a null source_id makes a class of its own row; copies and re-fetched
rows get the links of their class; texts are compared by whole sentences; empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import bucketed, cut, read, written
from scriptorium.llm.glyphs import normalise
from scriptorium.llm.languages import KindsOfCharacters, clean


_MARKS = re.compile("[\u0300-\u036f]+")
_NOT_TITLE = re.compile(r"<[^>]{1,8}>|\([^()]*abstract\)\s*$|\(exten[^()]*\)\s*$")
_WORD = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+")
_CUT = re.compile(r"(?:…|\.\.\.)\s*(?:<[^>]*>)?\s*$")
_BREAK = re.compile(r"[.!?]+(?=\s|$)|[。！？…]")
_FORMATTING = re.compile(r"[\W_]+")
_PART_OF_NAME = re.compile(r"[a-z]{2,}|[㐀-鿿]+|[а-яё]{2,}")
# Particles and fillers of author lists; letters without a decomposition, and the plain letters they are typed as.
_FILLERS = frozenset({"al", "et", "de", "van", "von", "der", "den", "di", "da", "la", "le", "el", "du", "del", "and", "und", "jr"})
_PLAIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ð": "d", "þ": "th"})
_HAN = re.compile("[㐀-鿿]")
_SPACED_HAN = re.compile(r"(?<=[㐀-鿿])[\s·•]+(?=[㐀-鿿])")
#: Words that only name a part or an edition; titles that differ in one, or in a number, name different works.
_PARTS = frozenset("part teil partie parte vol volume ii iii iv revisited erratum corrigendum 续 上 下 часть".split())
#: Texts that may hold garbled or look-alike characters; their sentences may differ without contradicting.
_ODD = re.compile("[^\x00-ÿ\u0400-\u045f\u2010-\u2026\u3001-\u3015\u4e00-\u9fff\uff01-\uff1f]|[\x80-\xa0¢-ª¬-¯±-¶¸-º¼-¾ÂÃÐØÞ×÷øþ]|[A-Za-z][а-яѕіј]|[¡-ÿ]{4}")


def folded(text: str) -> str:
    """Lower case without accents."""
    return text.lower() if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", text.lower())).translate(_PLAIN)


#: What plain ASCII letters and digits are among other bytes: left out, or parted by blanks.
_NO_LETTERS = bytes(c for c in range(128) if not chr(c).isalnum())
_WORDS = bytes(c if chr(c).isalnum() else 32 for c in range(128)) + bytes(128)
_ALPHABETIC = bytes(c if chr(c).isalpha() else 32 for c in range(128)) + bytes(128)


def letters(text: str) -> str:
    """Letters and digits in lower case; everything else is formatting."""
    low = text.lower()
    return low.encode().translate(None, _NO_LETTERS).decode() if low.isascii() else _FORMATTING.sub("", low)


def title_words(title: str) -> list[str]:
    """The folded words of a title, of Chinese each character."""
    text = folded(normalise(title))
    if "<" in text or "(" in text:
        text = _NOT_TITLE.sub(" ", text)
    return text.encode().translate(_WORDS).decode().split() if text.isascii() else _WORD.findall(text)


def was_cut(text: str) -> bool:
    return ("…" in text or "..." in text) and bool(_CUT.search(text))


def whole_sentences(abstract: str) -> list[str]:
    """The letters of every sentence of twelve letters or more, the first and then the longest before the others.

    A last one that was cut off doesn't count. The two in front are keys: of an abstract that was cut off the first remains,
    of one whose beginning differs the longest, which is rarely a stock phrase.
    """
    parts = _BREAK.split(abstract)
    if was_cut(abstract):
        while parts and not parts[-1].strip():
            parts.pop()
        parts = parts[:-1]
    first, *rest = [x for x in map(letters, parts) if len(x) >= 12] or [None]
    if rest:
        longest = max(range(len(rest)), key=lambda k: len(rest[k]))
        rest.insert(0, rest.pop(longest))
    return [first, *rest] if first else []


_APART = re.compile(r"[\s,;.·•]+")


def name_key(name: str) -> str:
    """A name without case, punctuation and the order of its parts; a Chinese name is one part."""
    parts = [letters(x) for x in _APART.split(name)]
    return "".join(parts) if _HAN.search(name) else " ".join(sorted(x for x in parts if x))


def author_parts(authors: str) -> list[str]:
    """Parts of names that are longer than initials, and Chinese names, each once."""
    text = folded(authors)
    if text.isascii():
        found = [x for x in text.encode().translate(_ALPHABETIC).decode().split() if len(x) > 1]
    else:
        found = _PART_OF_NAME.findall(_SPACED_HAN.sub("", text) if _HAN.search(text) else text)
    return [x for x in dict.fromkeys(found) if x not in _FILLERS]


def _hashes(texts: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(texts, dtype=object), categorize=False).view(np.int64) if texts else np.zeros(0, np.int64)


class _Hashed:
    """Collects texts of one batch to hash them together."""

    def __init__(self) -> None:
        self.texts: list[str] = []

    def one(self, text: str | None) -> int:
        self.texts.append(text or "")
        return len(self.texts) - 1

    def many(self, texts: list[str]) -> tuple[int, int]:
        self.texts += texts
        return len(self.texts) - len(texts), len(self.texts)


#: Classes that a task remembers; beyond it only more rows of one class are joined.
_SEEN = 1_000_000
_DESCRIBED = "id long, c long, first boolean, t long, s array<long>, a array<int>, y int, odd boolean, cut boolean, marks long, w array<long>, plain int, sum long, start long, parts array<long>"


_SUBTITLE = re.compile(r"[:：–—]|\.\s|\s-\s")


def segments(title: str) -> list[list[str]]:
    """The words of each part of a title with a subtitle, of parts of three words (six Chinese characters) or more."""
    if not _SUBTITLE.search(title):
        return []
    parts = [title_words(x) for x in _SUBTITLE.split(title)]
    return [w for w in parts if len(w) >= (6 if w and _HAN.match(w[0]) else 3)] if len(parts) > 1 else []


def readings(title: str, kinds: KindsOfCharacters) -> list[str]:
    """A title; of a garbled one its restored form, and what is left without its garbled words."""
    plain = clean(title, kinds)
    if plain == title or title.isascii():
        return [title]
    kept = [w for w in title.split() if w in set(plain.split())]
    return [plain, " ".join(kept)] if kept and len(kept) < len(title.split()) else [plain]


def _lists(ranges: list[tuple[int, int]], values: np.ndarray) -> tuple[pa.ListArray, np.ndarray]:
    """The values of each range as a column of lists, and their offsets."""
    r = np.array(ranges, dtype=np.int64).reshape(-1, 2)
    size = r[:, 1] - r[:, 0]
    offsets = np.concatenate([[0], np.cumsum(size)])
    flat = np.repeat(r[:, 0] - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values[flat])), offsets


def _xor(ranges: list[tuple[int, int]], values: np.ndarray) -> np.ndarray:
    """The values of each range joined by exclusive or; 0 for an empty one."""
    column, offsets = _lists(ranges, values)
    flat, some = column.values.to_numpy(), np.diff(offsets) > 0
    out = np.zeros(len(ranges), np.int64)
    if some.any():
        out[some] = np.bitwise_xor.reduceat(flat, offsets[:-1][some])
    return out


def _some(at: list[int | None], values: np.ndarray) -> pa.Array:
    """The values at the places, null where there is none."""
    k = np.array([-1 if x is None else x for x in at], dtype=np.int64)
    return pa.array(values[k] if len(values) else np.zeros(len(k), np.int64), mask=k < 0)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, c, title, abstract, authors, year): the attributes, hashes standing for texts; a row for each reading of the title.

    c: null makes the class from the record itself, as duplicates does: title, abstract, authors and year without formatting.
    first: whether the task hasn't seen the class before; only such rows' attributes count, so a class that holds a third of
    all rows is a few rows for each task when classes are joined.
    """
    kinds, key_of = KindsOfCharacters(), lru_cache(200_000)(name_key)  # names are heavy-tailed
    seen: set[tuple[int, int]] = set()
    for b in batches:
        h, rows = _Hashed(), []
        for id_, c, title, abstract, authors, year in zip(*(b.column(x).to_pylist() for x in ("id", "c", "title", "abstract", "authors", "year")), strict=True):
            title, abstract, authors = title or "", abstract or "", authors or ""
            own = None
            if c is None:
                names = sorted(map(key_of, authors.split("␞")))
                own = h.one("␟".join((letters(title), "␞".join(n for n in names if n), str(year), letters(abstract))))
            odd = not abstract.isascii() and bool(_ODD.search(abstract))
            s = h.many(whole_sentences(normalise(clean(abstract, kinds)) if odd else abstract))
            a = h.many(author_parts(authors))
            for t in readings(title, kinds):
                words = title_words(t)
                n = len(words)
                begin = words[: 6 if n and "㐀" <= words[0] <= "鿿" else 4]
                marks = [w for w in words if w in _PARTS or w.isdigit()]
                plain = [w for w in words if w not in marks] if marks else words
                parts = [h.many(w) for w in segments(t)]
                rows.append((id_, c, own, h.one("".join(words)) if n else None, s, a, year, odd, was_cut(t), h.one(" ".join(sorted(marks))), h.many(plain + marks), len(plain), h.one("".join(begin)) if n >= 4 else None, parts))
        if not rows:
            continue
        id_, given, own, t, s, a, year, odd, cut_, marks, w, plain, start, parts = zip(*rows, strict=True)
        v = _hashes(h.texts)
        c = [x if o is None else y for x, o, y in zip(given, own, v[[o or 0 for o in own]].tolist(), strict=True)]
        title = _some(t, v)
        first = []
        for key in zip(c, title.to_pylist(), strict=True):
            if len(seen) >= _SEEN:
                seen.clear()
            first.append(key not in seen)
            seen.add(key)
        counts = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        of_parts = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(_xor([x for own_ in parts for x in own_], v)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(id_, pa.int64()), pa.array(c, pa.int64()), pa.array(first), title, _lists(s, v)[0], _lists(a, (v >> 32).astype(np.int32))[0], pa.array(year, pa.int32()), pa.array(odd), pa.array(cut_),
                _some(marks, v), _lists(w, v)[0], pa.array(plain, pa.int32()), pa.array(_xor(w, v)), _some(start, v), of_parts,
            ],
            names=[f.split()[0] for f in _DESCRIBED.split(", ")],
        )


# Rules by pass, strong ones first: name -> (which attributes it leaves for checking, key columns).
STRONG = {"title+abstract+author": "y", "title+abstract+year": "a", "title+abstract": "a", "sentences": "ta", "sentence+author": "t", "title+authors": "s", "title+author+year": "s"}
MIDDLE = {"title+author": "s", "sentence+year": "ta", "second+author": "t", "sentence": "ta", "title+year": "sa"}
LOOSE = {"title-1+author": "s", "title-1+sentence": "a", "title-1+year": "sa", "beginning+author": "s"}
PASSES = (STRONG, MIDDLE, LOOSE)
RULES = {**STRONG, **MIDDLE, **LOOSE}
NUMBER = {r: k for k, r in enumerate(RULES)}


#: Words of a title that has variants with one word less; shorter titles only stand for themselves.
LEAST_TITLE = 5


#: What a text is, in its two lowest bits.
KINDS = {"title": 0, "sentence": 1, "loose": 2, "part": 3}


def _kind(text: Column, kind: str) -> Column:
    return text.bitwiseAND(F.lit(-4)).bitwiseOR(F.lit(KINDS[kind]))


#: Marks of a whole title that meets parts of titles, and of a beginning that meets a title cut off, on the side of the papers.
WHOLE, BEGUN = 0x5DEECE66D0C0FFEE, 0x2545F4914F6CDD1D


def _loose_texts(d: DataFrame, fetched: bool, *columns: str) -> DataFrame:
    """Rows (columns, own, b): a title's words in any order, those less one of them, and what meets a title of which a part is missing.

    Words that name a part or an edition, and numbers, are never left out: titles that differ in one name different works.
    A part of a title meets whole titles only, and the beginning of a title that was cut off any beginning.
    own is the title as it is.
    """
    d = d.select(*columns, F.coalesce("t", F.lit(0)).alias("own"), "t", "sum", "start", "cut", "parts", F.posexplode_outer(F.when(F.size("w") >= LEAST_TITLE, F.slice("w", 1, F.col("plain")))).alias("i", "word"))
    once = F.coalesce("i", F.lit(0)) == 0  # what isn't of one word comes with the first
    whole = F.when(F.col("t").isNotNull(), F.col("sum"))
    marked = lambda x, m: _kind(x.bitwiseXOR(F.lit(m)), "part")
    if fetched:
        others = [_kind(whole, "loose"), F.when(F.col("cut"), _kind(F.col("start"), "part")), marked(F.col("start"), BEGUN), _kind(whole, "part")]
        parts = F.transform("parts", lambda x: marked(x, WHOLE))
    else:
        others = [_kind(whole, "loose"), _kind(F.col("start"), "part"), F.when(F.col("cut"), marked(F.col("start"), BEGUN)), marked(whole, WHOLE)]
        parts = F.transform("parts", lambda x: _kind(x, "part"))
    less = F.array(_kind(F.col("sum").bitwiseXOR(F.col("word")), "loose"))
    b = F.explode(F.when(once, F.concat(less, F.array(*others), parts)).otherwise(less))
    return d.select(*columns, "own", b.alias("b")).where("b is not null")


@dataclass(frozen=True)
class _Side:
    """The classes of one side in buckets of c, and the number of the buckets."""

    rows: DataFrame
    buckets: int

    def with_met(self, met: DataFrame) -> DataFrame:
        """The classes that have a text of met (c, b), with the array met of these."""
        own = met.repartition(self.buckets, "c").groupBy("c").agg(F.collect_set("b").alias("met"))
        return self.rows.join(own.hint("shuffle_hash"), "c")  # a bucket's texts fit a hash table, and the bucket needn't be sorted


@dataclass(frozen=True)
class _Met:
    """papers, fetched: (c, b), classes and their texts that the other side has too and that several classes of papers have;
    direct: (pc, fc, how, n), pairs by texts that one class of papers has, how being the kinds of these texts as bits."""

    papers: DataFrame
    fetched: DataFrame
    direct: DataFrame


def _meeting(p: DataFrame, f: DataFrame, loose: bool) -> _Met:
    """Texts that both sides have.

    A text that one class of papers has names the pair; only for the others are keys with every author part made.
    loose: titles less a word and titles of which a part is missing, of which those count that meet under two different
    titles; equal titles have met before.
    """
    if loose:
        pr, fr = _loose_texts(p, False, "c"), _loose_texts(f, True, "c")
    else:
        texts = F.array(_kind(F.col("t"), "title"), *(_kind(F.get("s", F.lit(k)), "sentence") for k in (0, 1)))
        pr, fr = (d.select("c", F.explode(texts).alias("b")).where("b is not null") for d in (p, f))

    def met(rows: DataFrame, other: DataFrame) -> DataFrame:
        o, x = rows.alias("o"), other.drop("c").distinct().hint("shuffle_hash").alias("x")
        same = F.col("o.b") == F.col("x.b")
        return o.join(x, same & (F.col("o.own") != F.col("x.own")) if loose else same, "left_semi")

    pm = written(met(pr, fr))
    fm = written(met(fr, pm).select("c", "b").distinct())
    owners = pm.groupBy("b").agg(F.min("c").alias("pc"), F.max("c").alias("other"))
    one, several = owners.where("pc = other").select("b", "pc"), owners.where("pc != other").select("b")
    how = F.bit_or(F.expr("shiftleft(1, cast(b & 3 as int))"))
    direct = written(fm.withColumnRenamed("c", "fc").join(one, "b").groupBy("pc", "fc").agg(how.alias("how"), F.count("*").alias("n")))
    return _Met(pm.select("c", "b").join(several, "b", "left_semi"), fm.join(several, "b", "left_semi"), direct)


def _keys(d: DataFrame, which: int, fetched: bool) -> DataFrame:
    """(key, c) of one pass; a key's last four bits name its rule. Rows are exploded by author and text, so that the keys are compiled code."""

    def h(rule: str, *c: Column) -> Column:
        return F.when(F.greatest(*[x.isNull().cast("int") for x in c]) == 0 if len(c) > 1 else c[0].isNotNull(), F.xxhash64(F.lit(NUMBER[rule]), *c).bitwiseAND(F.lit(-16)).bitwiseOR(F.lit(NUMBER[rule])))

    met = lambda x: F.when(F.array_contains("met", x), x)
    y = F.col("y")
    years = [y - 1, y, y + 1] if fetched else [y]
    if which == 2:
        # of a text that meets: the rows of its authors, of which the first makes the keys without an author
        d = d.select("*", F.explode("met").alias("b")).select("c", "a", "y", F.get("s", F.lit(0)).alias("s1"), "b", F.posexplode_outer("a").alias("i", "p"))
        v, p = F.when(F.col("b").bitwiseAND(F.lit(3)) == KINDS["loose"], F.col("b")), F.col("p")
        first = F.coalesce("i", F.lit(0)) == 0
        found = [h("title-1+author", v, p), h("beginning+author", F.when(v.isNull(), F.col("b")), p)]
        found += [F.when(first, x) for x in (h("title-1+sentence", v, F.col("s1")), *(h("title-1+year", v, z) for z in years))]
    else:
        s1, s2 = (met(_kind(F.get("s", F.lit(k)), "sentence")) for k in (0, 1))
        d = d.select("c", met(_kind(F.col("t"), "title")).alias("t"), s1.alias("s1"), s2.alias("s2"), "a", "y", F.sort_array("a").alias("names"))
        d = d.select("*", F.posexplode_outer("a").alias("i", "p"))
        first = F.coalesce("i", F.lit(0)) == 0
        t, s1, s2, p = (F.col(x) for x in ("t", "s1", "s2", "p"))
        if which == 0:
            found = [h("title+abstract+author", t, s1, p), h("sentence+author", s1, p), h("title+author+year", t, p, y)]
            alone = [h("title+abstract+year", t, s1, y), h("title+abstract", t, s1), h("sentences", s1, s2), h("title+authors", F.when(F.size("a") > 0, t), F.col("names"))]
        else:
            found = [h("title+author", t, p), h("second+author", s2, p)]
            alone = [h("sentence", s1), h("sentence", s2), *(h("sentence+year", s1, z) for z in years), *(h("title+year", t, z) for z in years)]
        found += [F.when(first, x) for x in alone]
    return d.select("c", F.explode(F.array(*found)).alias("key")).where("key is not null")


def _single(keys: DataFrame, name: str) -> DataFrame:
    """Keys that belong to one class; aggregated before the join, so a key makes no more pairs than the other side has."""
    g = keys.groupBy("key").agg(F.min("c").alias(name), F.max("c").alias("other"))
    return g.where(F.col(name) == F.col("other")).drop("other")


#: Least share of the shorter title's words that the titles have in common, years apart that another work is, and least share
#: of the shorter abstract's sentences that makes the same text.
LIKE, APART, SAME = 0.5, 2, 0.5
#: Share of the shorter title's words in common that a title with one word changed has at least.
NEARLY = 0.8


def _mask(names: Iterable[str]) -> int:
    return sum(1 << NUMBER[r] for r in names)


#: Rules that link by a sentence, and those that link by an author's name.
BY_TEXT, BY_AUTHOR = _mask(r for r in RULES if r.startswith(("sentence", "second"))), _mask(r for r in RULES if r.endswith(("+author", "+author+year")))


def _checked(pairs: DataFrame, p: _Side, f: _Side, which: int) -> DataFrame:
    """(pc, fc, rule, rules, n, s, a, t, y): pairs without contradictions, the strongest rule of the pass that holds, and the agreement
    of each attribute: null where it is unknown on a side. pairs: (pc, fc, rules as bits, how as bits, n).

    A pair that a text names directly has the rules whose other attributes agree too.
    """
    side = lambda d, c, x: d.select(F.col("c").alias(c), *[F.col(n).alias(f"{x}_{n}") for n in ("t", "s", "a", "y", "odd", "cut", "marks", "w")])
    # a fetched class has few pairs: they make the hash tables that the bucket streams past
    j = side(f.rows, "fc", "f").join(pairs.hint("shuffle_hash"), "fc")
    # a paper may have a third of all pairs: its attributes leave their bucket, so that both sides are shuffled and the hot one is split
    named = side(p.rows, "pc", "p").join(pairs.select("pc").distinct().repartition(p.buckets, "pc").hint("shuffle_hash"), "pc", "left_semi")
    j = j.join(written(named), "pc")
    # whole sentences in common: one alone may be a stock phrase
    both = F.size(F.array_intersect("p_s", "f_s")) / F.least(F.size("p_s"), F.size("f_s"))
    s = F.when((F.size("p_s") > 0) & (F.size("f_s") > 0), F.when(both >= SAME, True).when((both == 0) & ~F.col("p_odd") & ~F.col("f_odd"), False))
    a = F.when((F.size("p_a") > 0) & (F.size("f_a") > 0), F.arrays_overlap("p_a", "f_a"))
    names = F.size(F.array_intersect("p_a", "f_a")) / F.greatest(F.lit(1), F.least(F.size("p_a"), F.size("f_a")))
    common = F.size(F.array_intersect("p_w", "f_w")) / F.greatest(F.lit(1), F.least(F.size(F.array_distinct("p_w")), F.size(F.array_distinct("f_w"))))
    t = F.when(F.col("p_t").isNotNull() & F.col("f_t").isNotNull(), common)
    dy = F.coalesce(F.abs(F.col("p_y") - F.col("f_y")), F.lit(0))
    j = j.select("pc", "fc", "rules", "how", "n", (F.sort_array("p_a") == F.sort_array("f_a")).alias("same_a"), (F.col("p_y") == F.col("f_y")).alias("same_y"), (F.col("p_y").isNotNull() & F.col("f_y").isNotNull() & (dy <= 1)).alias("near_y"), s.alias("s"), a.alias("a"), names.alias("names"), t.alias("t"), dy.alias("dy"), (dy <= 1).alias("y"), (F.col("f_cut") | F.col("p_cut") | (F.abs(F.size("p_w") - F.size("f_w")) > 1)).alias("short"), (F.col("p_marks") == F.col("f_marks")).alias("m"), (F.col("p_t") == F.col("f_t")).alias("same_t"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    no = lambda c: ~F.coalesce(F.col(c), F.lit(True))
    # a sentence and the title in common outweigh a year far off or an author's name that is typed otherwise, but not both
    contradicts = (no("s") | no("a") | (F.col("dy") >= APART) | ~yes("m") & ~yes("same_t")) & ~(yes("s") & (F.coalesce("t", F.lit(0.0)) >= 0.9) & (~no("a") | (F.col("dy") < APART) & yes("m")))
    bits = lambda mask, bad: F.when(bad, F.lit(mask)).otherwise(F.lit(0))
    out = [
        # a common sentence under titles with little in common
        bits(BY_TEXT & ~_mask(["sentences"]), F.coalesce("t", F.lit(0.0)) < LIKE),
        bits(_mask(["sentences"]), F.coalesce("t", F.lit(1.0)) < LIKE),
        # the beginning of a title alone may be common to many works
        bits(_mask(["beginning+author"]), ~(yes("s") | F.col("short") & (F.coalesce("t", F.lit(0.0)) >= 0.99))),
        # without authors or abstract on a side, a title that only resembles isn't enough
        bits(_mask(["title-1+year"]), ~yes("s") & ~yes("a")),
        # a given name in common isn't an author in common, unless a text that the rule doesn't use agrees
        bits(BY_AUTHOR & BY_TEXT, (F.col("names") < LIKE) & (F.coalesce("t", F.lit(0.0)) < 0.9)),
        bits(BY_AUTHOR & ~BY_TEXT, (F.col("names") < LIKE) & ~yes("s")),
    ]
    by = lambda kind: F.col("how").bitwiseAND(F.lit(1 << KINDS[kind])) != 0
    agree = {"author": yes("a"), "authors": yes("same_a"), "abstract": yes("s"), "year": yes("near_y"), "title-1": by("loose"), "title": by("title"), "sentence": by("sentence"), "second": F.lit(False), "beginning": by("part")}
    left = F.col("rules")
    for r in PASSES[which]:
        parts = r.split("+")
        ok = by("sentence") & yes("s") if r == "sentences" else F.lit(True)
        for x in parts if r != "sentences" else ():
            ok &= yes("same_y") if x == "year" and which == 0 else yes("s") if r == "title-1+sentence" and x == "sentence" else agree[x]
        left = left.bitwiseOR(F.when(ok, F.lit(1 << NUMBER[r])).otherwise(F.lit(0)))
    for x in out:
        left = left.bitwiseAND(F.bitwise_not(x))
    # weaker rules that hold as well: the next passes don't see the pair, but its agreement tells how good they are
    near = F.coalesce("t", F.lit(0.0))
    weaker = {"title+author": yes("same_t") & yes("a"), "title+year": yes("same_t") & yes("near_y"), "sentence+year": yes("s") & yes("near_y"), "sentence": yes("s"), "title-1+author": (near >= NEARLY) & yes("a"), "title-1+year": (near >= NEARLY) & yes("near_y"), "title-1+sentence": (near >= NEARLY) & yes("s"), "beginning+author": F.col("short") & (near >= 0.99) & yes("a")}
    held = F.lit(0)
    for r, ok in weaker.items():
        held = held.bitwiseOR(F.when(ok, F.lit(1 << NUMBER[r])).otherwise(F.lit(0)))
    j = j.where(~contradicts).select("pc", "fc", left.alias("rules"), held.alias("held"), "n", "s", "a", (F.col("t") >= 0.75).alias("t"), "y")
    # a title has several readings; the aggregate also keeps the long expressions from being repeated in those that use them
    j = j.groupBy("pc", "fc").agg(F.bit_or("rules").alias("rules"), F.bit_or("held").alias("held"), *[F.max(x).alias(x) for x in ("n", *"saty")]).where("rules != 0")
    return j.select("pc", "fc", F.expr("cast(round(log2(rules & -rules)) as int)").alias("rule"), F.col("rules").bitwiseOR(F.col("held")).alias("rules"), "n", "s", "a", "t", "y")


def link(p: _Side, f: _Side) -> DataFrame:
    """(pc, fc, rule, rules, s, a, t, y): linked classes, the strongest rule that linked them and all that hold."""
    linked: DataFrame | None = None
    for which in range(3):
        rest = f if linked is None else replace(f, rows=f.rows.join(linked.select(F.col("fc").alias("c")).hint("shuffle_hash"), "c", "left_anti"))
        if which != 1:  # the first two passes have the same texts
            met = _meeting(p.rows, rest.rows, loose=which == 2)
        pk, fk = _single(_keys(p.with_met(met.papers), which, False), "pc"), _keys(rest.with_met(met.fetched), which, True).select("key", F.col("c").alias("fc")).distinct()
        bit = F.expr("shiftleft(1, cast(key & 15 as int))")
        pairs = pk.join(fk, "key").groupBy("pc", "fc").agg(F.bit_or(bit).alias("rules"), F.count("*").alias("n")).withColumn("how", F.lit(0))
        direct = met.direct if which != 1 else met.direct.join(linked.select("fc"), "fc", "left_anti")
        pairs = pairs.unionByName(direct.withColumn("rules", F.lit(0))).groupBy("pc", "fc").agg(F.bit_or("rules").alias("rules"), F.bit_or("how").alias("how"), F.sum("n").alias("n"))
        pairs = _checked(written(pairs), p, f, which)
        # records that differ in an author or the year only share most keys; the one with more keys in common is meant
        found = pairs.groupBy("fc").agg(F.max_by(F.struct("pc", "rule", "rules", "s", "a", "t", "y"), F.struct("n", -F.col("rule"), "pc")).alias("b")).select("b.pc", "fc", "b.rule", "b.rules", "b.s", "b.a", "b.t", "b.y")
        linked = cut(found if linked is None else linked.unionByName(found))
    names = F.element_at(F.array(*[F.lit(r) for r in RULES]), F.col("rule") + 1)
    return linked.withColumn("rule", names)


def confidences(linked: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(rule, confidence): smoothed precision by attributes the rule doesn't use, or by labels (pc, fc).

    A rule is judged by all pairs that it holds for, also those that a stronger one linked.
    """
    if "rules" in linked.columns:
        each = F.explode(F.array_compact(F.array(*[F.when(F.col("rules").bitwiseAND(F.lit(1 << k)) != 0, F.lit(r)) for r, k in NUMBER.items()])))
        linked = linked.withColumn("rule", each)
    if labels is not None:
        ok = linked.join(labels.withColumn("true", F.lit(1)), ["pc", "fc"], "left").withColumn("ok", F.coalesce("true", F.lit(0)))
    else:
        free = F.create_map(*[x for r, a in RULES.items() for x in (F.lit(r), F.lit(a))])[F.col("rule")]
        seen = [F.when(free.contains(x), F.col(x)) for x in "saty"]
        ok = linked.withColumn("ok", F.coalesce(*[c.cast("int") for c in seen])).where("ok is not null")
    return ok.groupBy("rule").agg(((F.sum("ok") + 1.0) / (F.count("*") + 2.0)).alias("confidence"))


def matches(papers: DataFrame, fetched: DataFrame) -> DataFrame:
    """(paper_id, fetch_id, rule, confidence)."""
    rows = papers.select("id", F.lit(None).cast("long").alias("c"), "title", "abstract", F.array_join("authors", "␞").alias("authors"), F.col("year").cast("int").alias("year"))
    c = F.when(F.col("source_id").isNull(), F.xxhash64("fetch_id", F.lit(2))).otherwise(F.xxhash64("source_id", F.lit(1)))
    got = fetched.select(F.col("fetch_id").alias("id"), c.alias("c"), "title", "abstract", "authors", F.col("year").cast("int").alias("year"))
    p_rows, f_rows = (written(d.mapInArrow(_describe, _DESCRIBED)) for d in (rows, got))
    linked = link(*(_Side(*bucketed(d.where("first").drop("id", "first"), "c", d.count())) for d in (p_rows, f_rows)))
    linked = linked.join(F.broadcast(confidences(linked)), "rule", "left").select("pc", "fc", "rule", F.coalesce("confidence", F.lit(0.5)).alias("confidence"))  # a row for each rule
    ids = p_rows.select(F.col("id").alias("paper_id"), F.col("c").alias("pc")).distinct()
    fetch_ids = f_rows.select(F.col("id").alias("fetch_id"), F.col("c").alias("fc")).distinct()
    return linked.join(ids, "pc").join(fetch_ids, "fc").select("paper_id", "fetch_id", "rule", "confidence")


_PAPER = ("id", "source", "title", "abstract", "authors", "year")
_FETCHED = ("fetch_id", "source_id", "title", "abstract", "authors", "year")


def p1_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(read(spark, sf_dir, "papers", *_PAPER), read(spark, sf_dir, "fetched", *_FETCHED))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_matches(spark, sf_dir).select("paper_id", "fetch_id").distinct()


QUERIES = {"p1_found": p1_found, "p1_matches": p1_matches}
SQL: dict[str, str] = {}
