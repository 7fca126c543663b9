"""Problem 4: the language of each document and of each of its segments.

Every language has probabilities of the pieces of a fixed public vocabulary.  A word's
probability in a language is the sum over all its segmentations into pieces, by
the forward algorithm; a sentence's is the product over its words.  The piece
probabilities are fitted by expectation-maximisation to a bounded sample of labelled rows
(``SAMPLE`` rows a language, chosen by a hash of the id); every row is then scored, whole.
Words are scored once for each worker and looked up after that.

Text is unified and, where it was read in a wrong code page, read again before it is scored;
with no bigrams at hand, a fixed preference among kinds of characters decides whether.

Edge cases: null and empty texts have no segments; a label in any known spelling counts as its
language, any other as none; a sentence of fewer than ``LEAST_WORDS`` words has a lower confidence; foreign names and terms inside a sentence don't change it; a tie goes to the
language first in ``LANGUAGES``.
"""

from __future__ import annotations

import math
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import glyphs, recode
from scriptorium.llm.common import read
from scriptorium.llm.tokens import TOKENIZERS

LANGUAGES = ("en", "zh", "de", "fr", "es", "ru")
VOCABULARY = "piece_bpe_32k.model"
#: Labelled rows of each language that the model is fitted to at most.
SAMPLE = 2000
ROUNDS = 2
#: Words (Chinese: characters) that a segment needs for a full confidence, and least posterior of its language.
LEAST_WORDS, LEAST_HAN, LEAST_POSTERIOR = 4, 8, 0.9

# Spellings of the languages' names.
SPELLINGS = {
    "en": "en eng english englisch anglais ingles inglés английский 英语 英文",
    "zh": "zh zho chi chinese cn chinesisch chinois chino mandarin китайский 中文 汉语 简体中文",
    "de": "de deu ger german deutsch allemand aleman alemán немецкий 德语",
    "fr": "fr fra fre french français francais französisch frances francés французский 法语",
    "es": "es spa spanish español espanol castellano spanisch espagnol испанский 西班牙语",
    "ru": "ru rus russian русский russisch russe ruso 俄语",
}


def named_language(label: Column) -> Column:
    """The language that a label names in any spelling, with or without a region; null if none."""
    word = F.lower(F.regexp_extract(F.trim(label), r"^([\p{L}]+)", 1))
    of = F.create_map(*[F.lit(x) for code, names in SPELLINGS.items() for n in names.split() for x in (n, code)])
    return F.try_element_at(of, word)


# --- words and sentences -------------------------------------------------------------------------------------------

_WORD = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]+(?:['’][^\W\d_㐀-鿿]+)*")
_HAN = re.compile("[㐀-鿿]")
_BREAK = re.compile(r"(?<=[.!?])[\"'”’»)]*\s+|(?<=[。！？])|[\r\n]+")


def sentences(text: str) -> list[str]:
    return [s for s in _BREAK.split(text) if s and not s.isspace()]


def words(sentence: str) -> list[str]:
    return _WORD.findall(sentence.lower())


# --- piece model ---------------------------------------------------------------------------------------------------


def public_pieces(path: str) -> dict[str, int]:
    """The vocabulary's pieces; "▁" begins a word. Loaded where the model is fitted, only."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            p = sp.id_to_piece(i).lower()
            found.setdefault(p, i)
    return found


_LONGEST = 16
_FLOOR = 1e-6


class Pieces:
    """Piece probabilities of every language: piece -> row of ``table``."""

    def __init__(self, index: dict[str, int], table: np.ndarray) -> None:
        self.index, self.table = index, table

    def forward(self, word: str) -> np.ndarray:
        """Log probability of the word in each language, over all segmentations."""
        s = "▁" + word if not "㐀" <= word[0] <= "鿿" else word
        n = len(s)
        a = np.zeros((n + 1, self.table.shape[1]))
        a[0] = 1.0
        scale = 0.0
        for i in range(n):
            now = a[i]
            top = now.max()
            if top < 1e-200:
                a[i:] *= 1e200
                scale -= math.log(1e200)
                now = a[i]
            for j in range(i + 1, min(n, i + _LONGEST) + 1):
                k = self.index.get(s[i:j])
                if k is not None:
                    a[j] += now * self.table[k]
                elif j == i + 1:
                    a[j] += now * _FLOOR
        return np.log(np.maximum(a[n], 1e-300)) + scale


def fit(counts: dict[tuple[str, str], int], pieces: dict[str, int], rounds: int = ROUNDS) -> Pieces:
    """EM over segmentations: expected piece counts by forward and backward sums over each distinct word."""
    by_language: list[dict[str, int]] = [{} for _ in LANGUAGES]
    for (lang, word), n in counts.items():
        by_language[LANGUAGES.index(lang)][word] = n
    used: dict[str, int] = {}
    spans: dict[str, list[tuple[int, int, int]]] = {}
    for own in by_language:
        for w in own:
            if w not in spans:
                s = "▁" + w if not "㐀" <= w[0] <= "鿿" else w
                got = []
                for i in range(len(s)):
                    for j in range(i + 1, min(len(s), i + _LONGEST) + 1):
                        if j == i + 1 or s[i:j] in pieces:
                            got.append((i, j, used.setdefault(s[i:j], len(used))))
                spans[w] = got
    table = np.full((len(used), len(LANGUAGES)), _FLOOR)
    for lang, own in enumerate(by_language):
        # longer pieces are likelier to begin with
        p = np.array([len(x) ** 2.0 for x in used])
        p /= p.sum()
        for _ in range(rounds):
            got = np.zeros(len(used))
            for w, n in own.items():
                e = spans[w]
                size = e[-1][1]
                f, b = [0.0] * (size + 1), [0.0] * (size + 1)
                f[0] = b[size] = 1.0
                q = [p[k] for _, _, k in e]
                for (i, j, _), x in zip(e, q, strict=True):
                    f[j] += f[i] * x
                for (i, j, _), x in zip(reversed(e), reversed(q), strict=True):
                    b[i] += x * b[j]
                if f[size] > 0:
                    for (i, j, k), x in zip(e, q, strict=True):
                        got[k] += n * f[i] * x * b[j] / f[size]
            p = (got + 0.01) / (got.sum() + 0.01 * len(used))
        table[:, lang] = p
    return Pieces(used, np.maximum(table, _FLOOR / 10))


# --- reading again what was read in a wrong code page, without a learned model ---------------------------------------


class KindsOfCharacters:
    """Stands in for bigrams: a fixed log preference for each kind of character."""

    class _Known(dict):
        def __missing__(self, c: str) -> float:
            o = ord(c)
            if o < 0x80:
                got = -3.0
            elif 0x4E00 <= o <= 0x9FFF:
                try:
                    got = -5.5 if c.encode("gb2312")[0] < 0xD8 else -9.5
                except UnicodeError:
                    got = -11.0
            elif 0x410 <= o <= 0x44F or c in "ёЁ":
                got = -3.5 if c.islower() else -5.5
            elif c in "–—‘’“”„…«»°¿¡。，、；：！？（）「」":
                got = -5.0
            elif unicodedata.category(c) == "Ll" and o < 0x180:
                got = -4.5
            elif unicodedata.category(c) == "Lu" and o < 0x180:
                got = -7.0
            else:
                got = -9.0
            self[c] = got
            return got

    def __init__(self) -> None:
        self.of = self._Known().__getitem__

    def knows(self, c: str) -> bool:
        return self.of(c) > -9.0

    def score(self, before: str, text: str, after: str) -> float:
        return sum(map(self.of, text))


# What the legacy Cyrillic page shows for the tail bytes of UTF-8.
_TAILS = "ЂЃѓЉЊЌЋЏђљњќћџЎўЈҐЁЄЇІіґёєјЅѕї°±µ¶·№»¤¦§©¬®‚„…†‡€‰‹›‘’“”•–—™\xa0\xad«"
_SUSPECT = re.compile(f"[^\x00-\x7fÀ-ÿ\xa0\xad¡¿«»°α-ωΑ-ΩЀ-џ‐-…€\u2000-\u200d\u202f\u2060\ufeff、-〕一-鿿！-ｚﬀ-ﬄ\u0300-\u030cœŒ№]|[ÂÃÄÅÐÑÎÏ][^\x00-\x7f]|[–—][^\x00-\x7f]|[А-Я][{_TAILS}]|[¡-ÿ]{{4}}")
_FEW_HAN = re.compile("[a-z][一-鿿]|[一-鿿]{6}")
_AS_GB = next(k for k in recode.keys() if k.name == recode.Utf8AsGb.name)


def clean(text: str, kinds: KindsOfCharacters) -> str:
    if text.isascii():
        return text
    if _SUSPECT.search(text) or _FEW_HAN.search(text) and _AS_GB.possible(text):
        chars = frozenset(text)
        tried = [recode._apply(text, key, kinds, chars)[0] for key in recode.keys()]
        text = max([text, *(t for t in tried if t != text)], key=lambda t: kinds.score("", t, ""))
    return glyphs.normalise(text)


# --- scoring -------------------------------------------------------------------------------------------------------


class Scorer:
    """Scores sentences; each distinct word once, at most ``limit`` of them kept."""

    def __init__(self, pieces: Pieces, limit: int = 400_000) -> None:
        self.pieces, self.limit, self.kinds = pieces, limit, KindsOfCharacters()
        self.known: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    def word(self, w: str) -> int:
        k = self.known.get(w)
        if k is None:
            k = self.known[w] = len(self.rows)
            self.rows.append(self.pieces.forward(w))
        return k

    def segments(self, texts: list[str]) -> Iterator[tuple[int, int, str, int, float, float]]:
        """(text, segment, sentence, language, posterior, length) of every sentence; length: its words as a part of those it needs, 1 at most."""
        if len(self.known) > self.limit:
            self.known.clear()
            self.rows.clear()
        flat: list[int] = []
        own: list[tuple[int, int, str, bool]] = []
        sizes: list[int] = []
        get, word = self.known.get, self.word
        for t, text in enumerate(texts):
            text = clean(text, self.kinds)
            plain = text.isascii()
            for k, s in enumerate(sentences(text)):
                w = words(s)
                n = len(w)
                if n:
                    han = 0 if plain else len(_HAN.findall(s))
                    own.append((t, k, s, min(1.0, max((n - han) / LEAST_WORDS, han / LEAST_HAN))))
                    sizes.append(n)
                    flat += [i if (i := get(x)) is not None else word(x) for x in w]
        if not own:
            return
        sums = np.add.reduceat(np.array(self.rows)[flat], np.cumsum(sizes) - sizes, axis=0)
        best = sums.argmax(axis=1)
        posterior = 1.0 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        for (t, k, s, length), lang, p in zip(own, best.tolist(), posterior.tolist(), strict=True):
            yield t, k, s, lang, p, length


def training_counts(papers: DataFrame) -> dict[tuple[str, str], int]:
    """(language, word) -> count over the bounded sample of labelled rows."""
    labelled = papers.select("id", named_language(F.col("language")).alias("lang"), "abstract").where("lang is not null and abstract != ''")
    size = labelled.groupBy("lang").agg(F.count("*").alias("rows"))
    every = F.greatest(F.lit(1), F.ceil(F.col("rows") / F.lit(SAMPLE)))
    sample = labelled.join(F.broadcast(size), "lang").where(F.pmod(F.xxhash64("id"), every) == 0)  # size: a row for each of LANGUAGES
    word = F.explode(F.regexp_extract_all(F.lower("abstract"), F.lit(r"([\x{3400}-\x{9fff}]|[\p{L}&&[^\x{3400}-\x{9fff}]]+(?:['’][\p{L}&&[^\x{3400}-\x{9fff}]]+)*)"), 1))
    rows = sample.select("lang", word.alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    return {(r["lang"], r["word"]): r["n"] for r in rows.toLocalIterator()}


def fitted(papers: DataFrame, path: str) -> Pieces:
    return fit(training_counts(papers), public_pieces(path))


def vocabulary_path(spark: SparkSession) -> str:
    return os.path.join(spark.conf.get("spark.scriptorium.tokenizers", TOKENIZERS), VOCABULARY)


_SEGMENTS = "paper_id long, segment int, sentence string, lang string, confidence double"


def segment_languages(papers: DataFrame, path: str) -> DataFrame:
    """(paper_id, segment, sentence, lang, confidence): each sentence's language; the shorter it is, the lower the confidence."""
    shared = papers.sparkSession.sparkContext.broadcast(fitted(papers, path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for b in batches:
            ids = b["id"].to_numpy()
            out = []
            for t, k, s, lang, p, length in scorer.segments(b["abstract"].tolist()):
                out.append((ids[t], k, s, LANGUAGES[lang], p * length))
            yield pd.DataFrame(out, columns=["paper_id", "segment", "sentence", "lang", "confidence"])

    return papers.select("id", "abstract").where("abstract != ''").mapInPandas(run, _SEGMENTS)


def unnamed_languages(papers: DataFrame, path: str) -> DataFrame:
    """(paper_id, lang): languages of whole sentences that the paper's label doesn't name."""
    shared = papers.sparkSession.sparkContext.broadcast(fitted(papers, path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for b in batches:
            ids, named = b["id"].to_numpy(), b["named"].tolist()
            out = set()
            for t, _, _, lang, p, length in scorer.segments(b["abstract"].tolist()):
                if p * length >= LEAST_POSTERIOR and LANGUAGES[lang] != named[t]:
                    out.add((ids[t], LANGUAGES[lang]))
            yield pd.DataFrame(list(out), columns=["paper_id", "lang"])

    rows = papers.select("id", F.coalesce(named_language(F.col("language")), F.lit("")).alias("named"), "abstract").where("abstract != ''")
    return rows.mapInPandas(run, "paper_id long, lang string")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unnamed_languages(read(spark, sf_dir, "papers", "id", "language", "abstract"), vocabulary_path(spark)).distinct()


def p4_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each paper's language by the letters of its segments, with the share that is in it as confidence."""
    papers = read(spark, sf_dir, "papers", "id", "language", "abstract")
    s = segment_languages(papers, vocabulary_path(spark))
    by = s.groupBy("paper_id", "lang").agg(F.sum(F.length("sentence") * F.col("confidence")).alias("weight"))
    best = F.max_by("lang", F.struct("weight", "lang"))
    found = by.groupBy("paper_id").agg(best.alias("lang"), (F.max("weight") / F.sum("weight")).alias("confidence"))
    return papers.select(F.col("id").alias("paper_id")).join(found, "paper_id", "left").select("paper_id", "lang", F.round("confidence", 4).alias("confidence"))


QUERIES = {"p4_found": p4_found, "p4_documents": p4_documents}
SQL: dict[str, str] = {}
