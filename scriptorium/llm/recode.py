"""Problem 3: text that was decoded with the wrong code page.

A swap of single-byte pages is a substitution cipher on letters.  It is learned for each source, from the words made
of high characters alone that no multi-byte reading explains: the letters meant are the states of a hidden Markov
model whose transitions are the corpus' own letter bigrams, and expectation-maximisation learns which letter each
character stands for.  It starts from the published pages and, given enough words, also freely from letter frequencies,
so that a page that no list names can be learned; the start that makes the words likeliest wins, and what its
table doesn't explain is learned again.  The table is applied with ``str.translate``.

A free mapping can't be identified for multi-byte text (thousands of Chinese characters seen once each), so there the
cipher's key is a hidden variable over the pairs of published pages, which fix the mapping; expectation-maximisation
learns how often each source used each key: the E step weighs, for every field, each key's decoding against the text as
it stands, by the same bigrams; the M step re-estimates each source's key frequencies.

The bigram model counts all texts of the corpus that aren't plain ASCII and in which no
sequence stands that a key could undo, so that it holds no garbled pairs.  Its size is
bounded by the alphabets: Han and private-use characters count only after a
class of characters, so only pairs of alphabetic characters are kept as pairs.

Edge cases: null and empty texts are never affected; a null source is a source of its
own; texts of any length are processed whole; a replacement character or C1 control marks a
text as garbled even where the original is lost.  Rightly written accents and
foreign words stay, since no key makes them likelier.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import beyond_ascii, cut, parallelism, read

# Code pages under which UTF-8 is misread, and swaps of legacy pages (as read, as written).
MISREAD_UTF8 = ("latin-1", "cp1252", "cp1251", "cp437", "mac_roman", "koi8-r", "cp1250", "cp850")
LEGACY = (("latin-1", "cp1251"), ("cp1252", "cp1251"), ("latin-1", "koi8-r"))
#: Single-byte pages of alphabets that a learned table may start from, and pages that their bytes may be shown in.
STARTS, SHOWN_AS = ("cp1251", "koi8-r", "iso8859-5", "mac_cyrillic", "cp866"), ("latin-1", "cp1252")
DOUBLE = (("latin-1", "gb18030"), ("cp1252", "gb18030"))
DAMAGE = "[�\u0080-\u0084\u0086-\u009f]"
_DAMAGE = re.compile(DAMAGE)
# Blocks that the corpus' languages use (Latin, Greek, Cyrillic, punctuation, symbols, Han, full-width forms).
PLAUSIBLE = re.compile("[\x00-\x7e\xa0-\u024f\u0386-\u03ce\u0400-\u045f\u2010-\u2026\u20ac\u2116\u2122\u2190-\u22ff\u3000-\u3015\u4e00-\u9fff\uff00-\uff5e�ﬀ-ﬄ\u0300-\u030c\u200b-\u200d\ufeff\u2000-\u200a\u202f]*")
HAN, OTHER = 0x4E00, 0x20
EM_ROUNDS = 4
#: Least gain of a run. Bytes that happen to be valid in a multi-byte code are evidence by themselves (about a nat for
#: each tail byte), so there the gain may be below 0; a swap of letters must gain so much for each letter of the field.
_LEAST_GAIN, _LEAST_PER_LETTER = -3.0, 1.5


def _chars(page: str) -> list[str]:
    """The character each byte is shown as; bytes that the page leaves out are shown as C1 controls."""
    return [bytes([b]).decode(page, "ignore") or chr(b) for b in range(256)]


class Utf8As:
    """UTF-8 read as a single-byte page."""

    def __init__(self, page: str) -> None:
        shown = _chars(page)
        cls = lambda a, b: "[" + "".join(re.escape(shown[x]) for x in range(a, b + 1)) + "]"
        tail = cls(0x80, 0xBF)
        self.unit = re.compile(f"(?:{cls(0xC2, 0xDF)}{tail}|{cls(0xE0, 0xEF)}{tail}{{2}}|{cls(0xF0, 0xF4)}{tail}{{3}})+")
        self.name, self.to_byte = f"utf-8 as {page}", {ord(c): b for b, c in enumerate(shown)}
        self.leads, self.tails = frozenset(shown[0xC2:0xF5]), frozenset(shown[0x80:0xC0])

    def decode(self, run: str) -> str | None:
        try:
            return run.translate(self.to_byte).encode("latin-1").decode("utf-8")
        except UnicodeError:
            return None


class Utf8AsGb:
    """UTF-8 read as GB18030; a byte that was lost stays a replacement character."""

    name = "utf-8 as gb18030"
    unit = re.compile("(?:[^\x00-ÿ�]�?)+|�")

    _evidence = re.compile(b"[\xe2-\xef][\x80-\xbf]{2}|[\xc3\xce\xd0\xd1][\x80-\xbf]")

    def possible(self, text: str) -> bool:
        """Whether the text may be such: Chinese has characters then that GB2312 lacks; other text has bytes valid in UTF-8."""
        raw = text.encode("gb2312", "ignore")
        if len(text) < len(raw) * 0.7:
            return any(len(c.encode("gb2312", "ignore")) == 0 for c in set(text))
        return bool(self._evidence.search(text.encode("gb18030", "replace")))

    def decode(self, run: str) -> str | None:
        try:
            raw = b"\xff".join(part.encode("gb18030") for part in run.split("�"))
        except UnicodeError:
            return None
        done = raw.decode("utf-8", "replace")
        lost = done.count("�")
        return done if lost * 3 <= len(done) and len(done) > lost else None


class GbAs:
    """GB18030 read as a single-byte page."""

    def __init__(self, page: str) -> None:
        shown = _chars(page)
        self.unit = re.compile("(?:[" + "".join(re.escape(c) for c in shown[0xA1:0xFF]) + "]{2})+")
        self.name, self.to_byte = f"gb18030 as {page}", {ord(c): b for b, c in enumerate(shown)}

    def decode(self, run: str) -> str | None:
        try:
            return run.translate(self.to_byte).encode("latin-1").decode("gb18030")
        except UnicodeError:
            return None


class ByteSwap:
    """One single-byte page read as another: a substitution of letters."""

    def __init__(self, shown_as: str, written_as: str) -> None:
        shown, meant = _chars(shown_as), _chars(written_as)
        self.name = f"{written_as} as {shown_as}"
        self.table = {ord(a): b for a, b in zip(shown[0x80:], meant[0x80:], strict=True) if a != b}
        self.unit = re.compile("[" + "".join(re.escape(shown[b]) for b in range(0xA0, 0x100) if shown[b].isalpha() or shown[b] in "÷×¸¨") + "]+")

    def decode(self, run: str) -> str | None:
        return run.translate(self.table)


class Learned:
    """A learned substitution: character as shown -> letter meant."""

    name = "learned"

    def __init__(self, table: dict[str, str]) -> None:
        self.table = str.maketrans(table)
        self.unit = re.compile("[" + "".join(map(re.escape, table)) + "]+")

    def decode(self, run: str) -> str | None:
        return run.translate(self.table)


@lru_cache(1)
def multi_byte_keys() -> list:
    return [*map(Utf8As, MISREAD_UTF8), Utf8AsGb(), *(GbAs(a) for a, _ in DOUBLE)]


@lru_cache(1)
def keys() -> list:
    """All published keys; where nothing is learned, swaps of single-byte pages too."""
    return [*multi_byte_keys(), *(ByteSwap(*x) for x in LEGACY)]


# --- bigrams -------------------------------------------------------------------------------------------------------


def _fold(points: np.ndarray) -> np.ndarray:
    """Context classes: Han and other wide characters become one class."""
    wide = (points >= 0x2E80) & (points < 0xFB00) | (points >= 0x20000)
    return np.where(wide, HAN, points)


def _count_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        text = "\n".join(t for t in batch["text"] if not _UNUSUAL.search(t))
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        points = np.where(points < 128, np.where((points >= 48) & (points < 58), 48, points), points)
        left = _fold(points[:-1])
        right = points[1:]
        wide = _fold(right) == HAN
        left = np.where(wide & (left != HAN), OTHER, left)
        pair, n = np.unique(left << 21 | right, return_counts=True)
        yield pd.DataFrame({"pair": pair, "n": n})


def bigram_counts(fields: DataFrame) -> DataFrame:
    """(pair, n) over all texts with a character beyond ASCII in which no key can apply; a pair is context << 21 | character."""
    return fields.where(beyond_ascii(F.col("text"))).select("text").mapInPandas(_count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


class Bigrams:
    """Smoothed log probabilities of a character after its context."""

    def __init__(self, pair: np.ndarray, n: np.ndarray) -> None:
        self.pairs = dict(zip(pair.tolist(), n.tolist(), strict=True))
        self.left: dict[int, int] = {}
        self.single: dict[int, int] = {}
        for p, c in self.pairs.items():
            self.left[p >> 21] = self.left.get(p >> 21, 0) + c
            self.single[p & 0x1FFFFF] = self.single.get(p & 0x1FFFFF, 0) + c
        self.total = sum(self.single.values()) + 50_000
        self.known: dict[tuple[int, int], float] = {}

    def log_p(self, a: int, b: int) -> float:
        got = self.known.get((a, b))
        if got is None:
            if 48 <= a < 58:
                a = 48
            if 48 <= b < 58:
                b = 48
            left = HAN if 0x2E80 <= a < 0xFB00 or a >= 0x20000 else a
            if left != HAN and (0x2E80 <= b < 0xFB00 or b >= 0x20000):
                left = OTHER
            alone = (self.single.get(b, 0) + 0.5) / self.total
            got = float(np.log((self.pairs.get(left << 21 | b, 0) + 4 * alone) / (self.left.get(left, 0) + 4)))
            if len(self.known) < 1_000_000:
                self.known[a, b] = got
        return got

    def knows(self, c: str) -> bool:
        return ord(c) in self.single

    def score(self, before: str, text: str, after: str) -> float:
        s = [ord(c) for c in (before[-1:] or "\n") + text + (after[:1] or "\n")]
        return sum(self.log_p(a, b) for a, b in zip(s, s[1:]))


# --- one text ------------------------------------------------------------------------------------------------------


#: A Chinese character or a word in a legacy page leaves at least so many bytes beyond ASCII in a row.
_HIGH_RUN = re.compile("[\xa1-ÿ]{2}")


def _apply(text: str, key, lm: Bigrams, chars: frozenset[str] | None = None) -> tuple[str, float]:
    """The text after undoing ``key`` wherever that makes it likelier, and the gain in log probability. chars: those of the text."""
    if isinstance(key, Utf8As):
        chars = frozenset(text) if chars is None else chars
        if chars.isdisjoint(key.leads) or chars.isdisjoint(key.tails):
            return text, 0.0
    out, at, gain, letters = [], 0, 0.0, 0
    swap = isinstance(key, (ByteSwap, Learned))
    if isinstance(key, Utf8AsGb) and not key.possible(text) or isinstance(key, (GbAs, ByteSwap)) and not _HIGH_RUN.search(text):
        return text, 0.0
    for m in key.unit.finditer(text):
        run, end = m[0], m.end()
        done = key.decode(run)
        if done is None or done == run or not swap and not PLAUSIBLE.fullmatch(done):
            continue
        # any two high bytes are a character of a two-byte page: that is evidence only if it is one that the corpus uses
        if isinstance(key, GbAs) and 2 * sum(map(lm.knows, done)) < len(done):
            continue
        before, after = text[m.start() - 1 : m.start()] if m.start() else "", text[end : end + 1]
        g = lm.score(before, done.replace("�", ""), after) - lm.score(before, run, after)
        # further layers of the same damage
        while not swap:
            more = key.unit.sub(lambda x: key.decode(x[0]) or x[0], done)
            if more == done:
                break
            g2 = lm.score(before, more.replace("�", ""), after) - lm.score(before, run, after)
            if g2 > g:
                done, g = more, g2
            else:
                break
        if swap or g > _LEAST_GAIN:
            out += [text[at : m.start()], done]
            at, gain, letters = end, gain + (g if swap else g - _LEAST_GAIN), letters + len(run)
    if not at or swap and gain < 4 + _LEAST_PER_LETTER * letters:
        return text, 0.0
    return "".join(out) + text[at:], gain


def gains(text: str, lm: Bigrams) -> list[float]:
    chars = frozenset(text)
    return [_apply(text, k, lm, chars)[1] for k in multi_byte_keys()]


def restore(text: str, first: int, lm: Bigrams, learned: Learned | None = None) -> str:
    """Undoes the key of the given number, then whatever other key still helps; each makes the text likelier, so this ends."""
    own = [*multi_byte_keys(), *([learned] if learned else [])]
    done = _apply(text, own[first], lm)[0] if 0 <= first < len(own) else text
    while True:
        chars = frozenset(done)
        best = max((_apply(done, k, lm, chars) for k in own), key=lambda x: x[1])
        if best[1] <= 0 or best[0] == done:
            return done
        done = best[0]


# --- learned substitutions -----------------------------------------------------------------------------------------

_HIGH = frozenset(c for page in SHOWN_AS for c in _chars(page)[0x80:])
_HIGH_WORD = re.compile("(?<![^\\W\\d_])[" + "".join(re.escape(c) for c in sorted(_HIGH - {"\xa0", "\xad"})) + "]{3,}(?![^\\W\\d_])")
#: Distinct words of a source that one task learns from; more are spread over tasks. Tries of a free start.
WORDS, FREE_TRIES = 5000, 4
#: Cells of an array of words, places and letters; bytes of sums that come to the driver at once.
BLOCK, MOST_BYTES = 4_000_000, 64_000_000
EM_STEPS = 40
#: Uses that a page's letter for a character counts as having been seen: many where the page is believed, few where it is only a
#: place to start from, next to none in a free start.
_BELIEVED, _STARTED, _FREE = 50.0, 1.0, 0.02


_HIGH_PAIRS = re.compile("[\xa1-\xfe]{2,}")


def high_words(text: str) -> list[str]:
    """Words of three letters or more, all of them beyond ASCII in a single-byte page."""
    return _HIGH_WORD.findall(text)


def may_be_pairs(text: str) -> bool:
    """Whether runs of high characters have even lengths, as those of a two-byte page have; words of letters have odd ones as often."""
    runs = _HIGH_PAIRS.findall(text)
    return sum(len(r) % 2 for r in runs) < 0.25 * len(runs)


class Cipher:
    """Decipherment of words: hidden letters with the corpus' bigrams, a substitution as emissions. seen: how often each character
    is used. The words stay where they are (``Words``, ``SpreadWords``), only sums over them come here."""

    def __init__(self, seen: dict[str, float], lm: Bigrams) -> None:
        # the alphabet other than Latin that the corpus writes most
        letters = sorted((n, c) for c, n in lm.single.items() if 0x370 <= c < 0x590 and chr(c).isalpha())
        self.letters = [chr(c) for _, c in letters[::-1]]
        self.chars = sorted(seen)
        self.seen = np.array([seen[c] for c in self.chars])
        if not letters:
            return
        log = np.vectorize(lm.log_p)
        o = np.array([ord(c) for c in self.letters], dtype=np.int64)
        self.first, self.last = np.exp(log(32, o)), np.exp(log(o, 32))
        self.step = np.exp(log(o[:, None], o[None, :]))
        self.common = np.array([n for n, _ in letters[::-1]], dtype=float)

    def groups(self, words: list[str], counts: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(characters, weights) of words of one length, in blocks of bounded size."""
        at = {c: k for k, c in enumerate(self.chars)}
        n = np.log1p(np.array(counts, dtype=float))  # repeated records repeat their words
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        out = []
        for size, own in by_length.items():
            rows = max(1, BLOCK // (size * len(self.letters)))
            for part in (own[i : i + rows] for i in range(0, len(own), rows)):
                out.append((np.array([[at[c] for c in words[k]] for k in part]), n[part]))
        return out

    def start(self, page: str | None, shown: str, draw: np.random.Generator) -> np.ndarray:
        """Letters x characters: the page's own letters, or for no page letters of about the same frequency."""
        b = np.full((len(self.letters), len(self.chars)), 1e-3)
        if page is not None:
            meant = dict(zip(_chars(shown), _chars(page), strict=True))
            index = {c: k for k, c in enumerate(self.letters)}
            for j, c in enumerate(self.chars):
                if meant.get(c) in index:
                    b[index[meant[c]], j] = 1.0
            return b
        near = np.abs(np.log(self.common / self.common.sum() + 1e-6)[:, None] - np.log(self.seen / self.seen.sum() + 1e-6)[None, :])
        return np.exp(-near) * draw.gamma(1.0, 1.0, b.shape) + 1e-4

    def expected(self, b: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray]:
        """(log likelihood of the words, expected uses of each letter for each character) under the emissions ``b``.

        A word may also be of another cipher or none: then each of its characters is as likely as any, and it counts the
        less the likelier that is.
        """
        used, total = np.zeros_like(b), 0.0
        for x, n in groups:
            m, size = x.shape
            e = b[:, x].transpose(1, 2, 0)  # word, place, letter
            forward, scale = np.empty_like(e), np.empty((m, size))
            now = self.first * e[:, 0]
            for i in range(size):
                if i:
                    now = (forward[:, i - 1] @ self.step) * e[:, i]
                scale[:, i] = now.sum(axis=1) + 1e-300
                forward[:, i] = now / scale[:, i, None]
            back = np.tile(self.last, (m, 1))
            end = (forward[:, -1] * self.last).sum(axis=1) + 1e-300
            own, other = np.log(scale).sum(axis=1) + np.log(end), np.full(m, -size * np.log(len(self.chars)))
            either = np.logaddexp(own, other)
            total += float(n @ either)
            n = n * np.exp(own - either)
            for i in range(size - 1, -1, -1):
                g = forward[:, i] * back
                g *= (n / (g.sum(axis=1) + 1e-300))[:, None]
                np.add.at(used.T, x[:, i], g)
                back = (back * e[:, i]) @ self.step.T / scale[:, i, None]
        return total, used

    def table(self, words: Words | SpreadWords) -> dict[str, str]:
        """Character -> letter of the start that explains the words best after EM_STEPS rounds.

        A letter that differs from the start's page has to be told, which costs as much as naming one of the letters; so few
        words keep to a page, and many can leave it.
        """
        draw = np.random.default_rng(7)
        pages = [self.start(p, s, draw) for p in STARTS for s in SHOWN_AS]
        free = [self.start(None, "", draw) for _ in range(FREE_TRIES)]
        starts = [*((p, w) for p in pages for w in (_BELIEVED, _STARTED)), *((f, _FREE) for f in free)]
        emissions = [start / start.sum(axis=1, keepdims=True) for start, _ in starts]
        for _ in range(EM_STEPS):
            sums = [(total, used + start * weight) for (total, used), (start, weight) in zip(words.expected(self, emissions), starts, strict=True)]
            emissions = [used / used.sum(axis=1, keepdims=True) for _, used in sums]
        best, found = -np.inf, pages[0]
        for (start, weight), (total, used) in zip(starts, sums, strict=True):
            told = len(self.chars) if weight == _FREE else int(((used.argmax(axis=0) != start.argmax(axis=0)) | (start.max(axis=0) < 1.0)).sum())
            if total - told * np.log(len(self.letters)) > best:
                best, found = total - told * np.log(len(self.letters)), used
        return completed({c: self.letters[int(found[:, j].argmax())] for j, c in enumerate(self.chars)}, frozenset(self.letters))


#: Share of its characters that a table has in common with a page, for the page to give the characters that were not seen.
SAME_PAGE = 0.9


def completed(table: dict[str, str], alphabet: frozenset[str]) -> dict[str, str]:
    """The table with the letters of the published page that it nearly is for what it couldn't learn: characters that
    weren't seen, letters that the corpus lacks; without such a page the table itself."""
    # a byte is shown by either page; where they differ the one has a control character
    pages = [{c: x for s in SHOWN_AS for c, x in zip(_chars(s), _chars(p), strict=True)} for p in STARTS]
    could = [{c for c in table if m.get(c) in alphabet} for m in pages]
    alike, page = max((sum(m[c] == table[c] for c in own) / len(table), k) for k, (m, own) in enumerate(zip(pages, could, strict=True)))
    if alike < SAME_PAGE - (1 - len(could[page]) / len(table)):
        return table
    return {c: x for c, x in pages[page].items() if c in _HIGH and x != c and (x.isalpha() or c < "\xa0" and x.isprintable())} | {c: table[c] for c in could[page]}


def _explains(table: dict[str, str], word: str, lm: Bigrams) -> bool:
    """Whether a table makes a word likelier by the least gain for each of its letters."""
    return lm.score(" ", word.translate(str.maketrans(table)), " ") - lm.score(" ", word, " ") >= _LEAST_PER_LETTER * len(word)


class Words:
    """The words of a source in memory."""

    def __init__(self, words: list[str], counts: list[int]) -> None:
        self.words, self.counts, self.size = words, counts, len(words)
        self._groups: tuple[Cipher, list] | None = None

    def seen(self) -> dict[str, float]:
        out: dict[str, float] = {}
        for w, n in zip(self.words, np.log1p(np.array(self.counts, dtype=float)).tolist(), strict=True):
            for c in w:
                out[c] = out.get(c, 0.0) + n
        return out

    def expected(self, cipher: Cipher, emissions: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        if self._groups is None or self._groups[0] is not cipher:
            self._groups = cipher, cipher.groups(self.words, self.counts)
        return [cipher.expected(b, self._groups[1]) for b in emissions]

    def without(self, table: dict[str, str], lm: Bigrams) -> Words:
        """The words that a table doesn't explain."""
        rest = [(w, n) for w, n in zip(self.words, self.counts, strict=True) if not _explains(table, w, lm)]
        return Words([w for w, _ in rest], [n for _, n in rest])


class SpreadWords:
    """The words of a source spread over tasks: the driver gets sums over each task's words. words: (word, n)."""

    def __init__(self, words: DataFrame, shared) -> None:
        self.shared, spark = shared, words.sparkSession
        words = cut(words)
        self.size = words.count()
        self.tasks = min(parallelism(spark), -(-self.size // WORDS)) or 1
        self.words = cut(words.repartition(self.tasks, "word"))

    def seen(self) -> dict[str, float]:
        c = self.words.select(F.explode(F.split("word", "")).alias("c"), F.log1p("n").alias("n")).where("c != ''")
        return {r["c"]: r["n"] for r in c.groupBy("c").agg(F.sum("n").alias("n")).collect()}  # no more than there are high characters

    def expected(self, cipher: Cipher, emissions: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        at_once = max(1, MOST_BYTES // (self.tasks * emissions[0].nbytes))
        return [x for k in range(0, len(emissions), at_once) for x in self._expected(cipher, emissions[k : k + at_once])]

    def _expected(self, cipher: Cipher, emissions: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        sent = self.words.sparkSession.sparkContext.broadcast((cipher, emissions))

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cipher, emissions = sent.value
            out = [(0.0, np.zeros_like(b)) for b in emissions]
            for batch in batches:
                groups = cipher.groups(batch["word"].tolist(), batch["n"].tolist())
                new = [cipher.expected(b, groups) for b in emissions]
                out = [(t + t2, u + u2) for (t, u), (t2, u2) in zip(out, new, strict=True)]
            yield pd.DataFrame({"k": range(len(out)), "total": [t for t, _ in out], "used": [u.tobytes() for _, u in out]})

        out = [(0.0, np.zeros_like(b)) for b in emissions]
        for r in self.words.mapInPandas(sums, "k int, total double, used binary").collect():
            total, used = out[r["k"]]
            out[r["k"]] = total + r["total"], used + np.frombuffer(r["used"]).reshape(used.shape)
        sent.destroy()
        return out

    def without(self, table: dict[str, str], lm: Bigrams) -> SpreadWords:
        shared = self.shared

        def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = Bigrams(*shared.value)
            for b in batches:
                yield b[pd.Series([not _explains(table, w, own) for w in b["word"]], index=b.index, dtype=bool)]

        return SpreadWords(self.words.mapInPandas(rest, self.words.schema), shared)


def _learn(words: Words | SpreadWords, lm: Bigrams, enough: int = 0) -> tuple[list[dict[str, str]], Words | SpreadWords | None]:
    """The substitutions of one source, as long as a table explains words and more than ``enough`` words are left, and
    the words left to learn from, if any."""
    out: list[dict[str, str]] = []
    while words.size > enough:
        cipher = Cipher(words.seen(), lm)
        if not cipher.letters:
            return out, None
        table = cipher.table(words)
        rest = words.without(table, lm)
        if rest.size == words.size:
            return out, None
        out.append(table)
        words = rest
    return out, words


def learn_tables(words: list[str], counts: list[int], lm: Bigrams) -> list[dict[str, str]]:
    """The substitutions of one source: what a table doesn't make likelier is learned again, as long as a table explains words."""
    return _learn(Words(words, counts), lm)[0]


# Characters that a garbled text needs at least one of: the lead bytes of UTF-8 as shown by each page, and the rest.
_LEADS = "".join(sorted({_chars(p)[b] for p in MISREAD_UTF8 for b in range(0xC2, 0xF5)}))


def unexplained(text: str, gained: list[float]) -> list[str]:
    """The words of high characters alone, if no multi-byte key gains at least a nat for each of their letters."""
    words = high_words(text)
    least = sum(map(len, words))
    as_utf8, as_pairs = max(gained[: -len(DOUBLE)]), max(gained[-len(DOUBLE) :])
    return [] if as_utf8 > least or as_pairs > least and may_be_pairs(text) else words


_FOUND = "paper_id long, field string, source string, text string, gains array<double>, damaged boolean, words array<string>"


def _objects(values: list, like: pd.DataFrame) -> pd.Series:
    """A column of lists or maps, also where there are none."""
    return pd.Series(values, index=like.index, dtype=object)


def _suspects(shared):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lm = Bigrams(*shared.value)
        for batch in batches:
            batch = batch[[bool(_UNUSUAL.search(t) or _HAN_PAIR.search(t)) for t in batch["text"]]]
            g = [gains(t, lm) for t in batch["text"]]
            damaged = [bool(_DAMAGE.search(t)) for t in batch["text"]]
            words = [unexplained(t, x) for t, x in zip(batch["text"], g, strict=True)]
            keep = [d or max(x) > 0 or len(w) > 0 for d, x, w in zip(damaged, g, words, strict=True)]
            own = {"gains": _objects(g, batch), "damaged": pd.Series(damaged, batch.index, dtype=bool), "words": _objects(words, batch)}
            yield batch.assign(**own)[pd.Series(keep, index=batch.index, dtype=bool)]

    return scan


def fields_of(papers: DataFrame) -> DataFrame:
    """(paper_id, field, source, text) of the filled titles and abstracts."""
    f = F.explode(F.array(*[F.struct(F.lit(x).alias("field"), F.col(x).alias("text")) for x in ("title", "abstract")]))
    return papers.select(F.col("id").alias("paper_id"), "source", f.alias("f")).select("paper_id", "f.field", "source", "f.text").where("text != ''")


#: Plain texts that no key applies to: Latin letters with accents as they are usual in the corpus' languages, Han with its
#: punctuation, Cyrillic; what remains goes through the keys.
_USUAL = (
    "[^\x00-\x7F\xa0-ÿŒœ\u0400-\u045f\u2010-\u2026\u3001-\u3015\u4e00-\u9fff\uff01-\uff1f\u03b1\u03b2\u200b-\u200d\u2060\ufeff]"
)
_USUAL_PAIRS = (
    "[ÂÃÄÅÐÑÎÏ][^\x00-\x7F]|[–—][^\x00-\x7F ]|[А-Я][ЂЃѓЉЊЌЋЏђљњќћџЎўЈҐЁЄЇІіґёєјЅѕї°±µ¶·№»¤¦§©¬®‚„…†‡€‰‹›‘’“”•–—™\xa0\xad«]|[\u4e00-\u9fff][A-Za-z]|[A-Za-z][\u4e00-\u9fff]"
    "|[¡-ÿ]{3}|[Ђ-Џђ-џ]|[¢-§©-ª¬®-¯±-¶¸-º¼-¾×÷ØøÆæÞþ]"
)


_UNUSUAL = re.compile(_USUAL + "|" + _USUAL_PAIRS)
_HAN_PAIR = re.compile("[一-鿿]{2}")


def learn_bigrams(fields: DataFrame):
    """The bigram counts as a broadcast pair of arrays; their number is bounded by the alphabets."""
    got = bigram_counts(fields).toPandas()
    return fields.sparkSession.sparkContext.broadcast((got["pair"].to_numpy(np.int64), got["n"].to_numpy(np.int64)))


def suspects(fields: DataFrame, shared) -> DataFrame:
    """The fields that some multi-byte key changes, that hold damage or words of high characters alone, with the gain of each key."""
    return fields.where(beyond_ascii(F.col("text"))).mapInPandas(_suspects(shared), _FOUND)


_TABLES = "array<map<string,string>>"


def learned_tables(found: DataFrame, shared) -> DataFrame:
    """(s, tables) of every source that has words of high characters alone, learned from all of them: up to WORDS in one task,
    more of them spread over tasks."""
    words = cut(found.select(F.coalesce("source", F.lit("")).alias("s"), F.explode("words").alias("word")).groupBy("s", "word").agg(F.count("*").alias("n")))
    large = [r["s"] for r in words.groupBy("s").agg(F.count("*").alias("size")).where(F.col("size") > WORDS).collect()]
    own_task, spread = words.where(~F.col("s").isin(large)) if large else words, []
    for s in large:
        tables, left = _learn(SpreadWords(words.where(F.col("s") == s).select("word", "n"), shared), Bigrams(*shared.value), WORDS)
        spread.append((s, tables))
        if left is not None:
            own_task = own_task.unionByName(left.words.withColumn("s", F.lit(s)))

    def learn(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["n", "word"], ascending=[False, True])
        return pd.DataFrame({"s": own["s"].iloc[:1], "tables": [learn_tables(own["word"].tolist(), own["n"].tolist(), Bigrams(*shared.value))]})

    learned = own_task.groupBy("s").applyInPandas(learn, f"s string, tables {_TABLES}")
    if not spread:
        return learned
    earlier = found.sparkSession.createDataFrame(spread, f"s string, earlier {_TABLES}")
    none = F.array().cast(_TABLES)
    return learned.join(earlier, "s", "full").select("s", F.concat(F.coalesce("earlier", none), F.coalesce("tables", none)).alias("tables"))


def with_learned(found: DataFrame, shared) -> DataFrame:
    """Adds the gain of the source's likeliest learned table as the last of the gains, and that table."""
    tables = learned_tables(found, shared)
    joined = found.withColumn("s", F.coalesce("source", F.lit(""))).join(tables, "s", "left").drop("s")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lm = Bigrams(*shared.value)
        known: dict[str, list[tuple[Learned, dict]]] = {}
        for b in batches:
            best: list[tuple[float, dict | None]] = []
            for text, source, tables_, words in zip(b["text"], b["source"], b["tables"], b["words"], strict=True):
                own: list[tuple[Learned, dict]] = []
                if tables_ is not None and len(words):
                    key = source or ""
                    if key not in known:
                        known[key] = [(Learned(dict(t)), dict(t)) for t in tables_]
                    own = known[key]
                best.append(max(((_apply(text, k, lm)[1], t) for k, t in own), key=lambda x: x[0], default=(0.0, None)))
            out = b.drop(columns=["tables", "words"])
            all_gains = [[*g, x] for g, (x, _) in zip(b["gains"], best, strict=True)]
            yield out.assign(gains=_objects(all_gains, b), table=_objects([t if t and x > 0 else None for x, t in best], b))

    schema = "paper_id long, field string, source string, text string, gains array<double>, damaged boolean, table map<string,string>"
    return joined.select("paper_id", "field", "source", "text", "gains", "damaged", "words", "tables").mapInPandas(score, schema)


def _posterior(gain: str, prior: str) -> Column:
    """Posterior of each key and, last, of the text as it stands; a key that gains nothing isn't the one."""
    possible = F.transform(gain, lambda g: F.when(g > 0, g).otherwise(-1e6))
    logs = F.zip_with(F.concat(possible, F.array(F.lit(0.0))), F.col(prior), lambda g, p: F.log(p) + g)
    return F.transform(F.transform(logs, lambda x: F.exp(x - F.array_max(logs))), lambda e: e)


def assign_keys(found: DataFrame) -> DataFrame:
    """EM over the sources' key frequencies; adds the likeliest key (-1: as it stands)."""
    k = len(multi_byte_keys()) + 2  # the learned table and, last, the text as it stands
    found = found.withColumn("s", F.coalesce("source", F.lit("")))
    prior = found.select("s").distinct().withColumn("prior", F.array(*[F.lit(1.0 / k)] * k))
    for _ in range(EM_ROUNDS):
        e = found.join(prior, "s").withColumn("e", _posterior("gains", "prior"))
        e = e.withColumn("z", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
        sums = e.groupBy("s").agg(F.count("*").alias("n"), *[F.sum(F.col("e")[i] / F.col("z")).alias(f"c{i}") for i in range(k)])
        prior = sums.select("s", F.array(*[(F.col(f"c{i}") + 0.5) / (F.col("n") + 0.5 * k) for i in range(k)]).alias("prior"))
    e = found.join(prior, "s").withColumn("e", _posterior("gains", "prior"))
    best = F.array_position("e", F.array_max("e")).cast("int") - 1
    return e.withColumn("key", F.when(best == k - 1, -1).otherwise(best)).drop("s", "prior", "e")


def garbled_fields(papers: DataFrame) -> tuple[DataFrame, object]:
    """(paper_id, field, source, text, key, damaged, table) of the garbled fields, and the broadcast bigrams; the scan's result is materialised."""
    fields = fields_of(papers)
    shared = learn_bigrams(fields)
    found = cut(suspects(fields, shared))
    return assign_keys(with_learned(found, shared)).where("key >= 0 or damaged"), shared


def restored_fields(papers: DataFrame) -> DataFrame:
    """(paper_id, field, key_name, restored, complete): the original text as far as it can be restored."""
    found, shared = garbled_fields(papers)

    def undo(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lm = Bigrams(*shared.value)
        names = [*(k.name for k in multi_byte_keys()), Learned.name]
        for b in batches:
            done = [restore(t, k, lm, Learned(dict(table)) if table is not None else None) for t, k, table in zip(b["text"], b["key"], b["table"], strict=True)]
            yield pd.DataFrame(
                {
                    "paper_id": b["paper_id"],
                    "field": b["field"],
                    "key_name": [names[k] if k >= 0 else None for k in b["key"]],
                    "restored": done,
                    "complete": [not _DAMAGE.search(t) for t in done],
                }
            )

    return found.select("paper_id", "field", "text", "key", "table").mapInPandas(undo, "paper_id long, field string, key_name string, restored string, complete boolean")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = read(spark, sf_dir, "papers", "id", "title", "abstract", "source")
    return garbled_fields(papers)[0].select("paper_id", "field").distinct()


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled fields with their original text."""
    return restored_fields(read(spark, sf_dir, "papers", "id", "title", "abstract", "source"))


QUERIES = {"p3_found": p3_found, "p3_restored": p3_restored}
SQL: dict[str, str] = {}
