"""Problem 8: token ids of the whole corpus by a public byte-level tokenizer.

Each batch of texts is split by the vocabulary's pattern; its distinct words are
encoded together by merge rounds in numpy.  The symbols of all words stand in
one flat array; a pair's rank is found by binary search over the sorted pair keys;
each round merges the lowest-ranked pair of every piece.  A piece ends where no merge can cross: between
two bytes that no merge joins, so a run of Chinese characters is many short pieces
instead of one long one and the number of rounds stays small.

Edge cases: null and empty texts get an empty list; blank texts are tokens like any others; special
tokens' strings are ordinary text; very long texts are processed whole; repeated rows give repeated rows.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm.common import read

TOKENIZERS = os.environ.get("SCRIPTORIUM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
_NONE = np.int64(1 << 40)

# The pattern that splits text before the merges, with white space as the tokenizer's library has it.
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Merges:
    """The merge table of a byte-level vocabulary as sorted arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letters = model["vocab"], _byte_letters()
        self.of_byte = np.zeros(256, dtype=np.int64)
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[a] << 17 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)  # by rank
        self.crosses = np.zeros((256, 256), dtype=bool)
        for a, b in pairs:
            self.crosses[letters[a[-1]], letters[b[0]]] = True

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        k = left << 17 | right
        at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        return np.where(self.key[at] == k, self.rank[at], _NONE)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids of each word)."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.array([len(r) for r in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        begin = np.zeros(len(data), dtype=bool)
        begin[(np.cumsum(size) - size)[size > 0]] = True
        begin[1:] |= ~self.crosses[data[:-1], data[1:]]
        done = np.full(len(data), -1, dtype=np.int64)
        at, sym, piece = np.arange(len(data)), self.of_byte[data], np.cumsum(begin)
        rank = np.full(len(data), _NONE)
        same = piece[1:] == piece[:-1]
        rank[:-1][same] = self.ranks(sym[:-1][same], sym[1:][same])
        while len(at):
            starts = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(at)))
            least_of = np.repeat(least, lengths)
            going = least_of < _NONE
            if not going.all():
                done[at[~going]] = sym[~going]
                at, sym, piece, rank, least_of = at[going], sym[going], piece[going], rank[going], least_of[going]
                if not len(at):
                    break
            chosen = rank == least_of
            hit = np.flatnonzero(chosen)
            # of overlapping hits (a a a) every second from the left is merged
            if len(hit) > 1:
                fresh = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (piece[hit[1:]] != piece[hit[:-1]])])
                run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - run_start) % 2 == 0]
            sym[hit] = self.merged[rank[hit]]
            keep = np.ones(len(at), dtype=bool)
            keep[hit + 1] = False
            moved = np.zeros(len(at), dtype=bool)
            moved[hit] = True
            at, sym, piece, rank, moved = at[keep], sym[keep], piece[keep], rank[keep], moved[keep]
            moved[:-1] |= moved[1:]
            m = np.flatnonzero(moved)
            last = m == len(at) - 1
            nxt = np.where(last, m, m + 1)
            fits = ~last & (piece[nxt] == piece[m])
            rank[m] = np.where(fits, self.ranks(sym[m], sym[nxt]), _NONE)
        kept = done >= 0
        word = np.repeat(np.arange(len(words)), size)
        return done[kept].astype(np.int32), np.bincount(word[kept], minlength=len(words))


@lru_cache(2)
def merges(path: str) -> Merges:
    return Merges(path)


_ANY, _PLAIN = regex.compile(PATTERN), re.compile(ASCII_PATTERN)


def split(text: str) -> list[str]:
    return _PLAIN.findall(text) if text.isascii() else _ANY.findall(text)


class Encoder:
    """Encodes batches; keeps the ids of words seen before, at most ``limit`` of them."""

    def __init__(self, path: str, limit: int = 300_000) -> None:
        self.m, self.limit = merges(path), limit
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text)."""
        words: list[str] = []
        n = np.zeros(len(texts), dtype=np.int64)
        for k, t in enumerate(texts):
            if t:
                found = split(t)
                n[k] = len(found)
                words += found
        if not words:
            return np.zeros(0, np.int32), n
        code, distinct = pd.factorize(np.array(words, dtype=object))
        del words
        if len(self.known) > self.limit:
            self._clear()
        index = np.fromiter((self.known.get(w, -1) for w in distinct), np.int64, len(distinct))
        fresh = np.flatnonzero(index < 0)
        if len(fresh):
            ids, size = self.m.encode(distinct[fresh].tolist())
            base = len(self.size)
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, ids])
            index[fresh] = np.arange(base, base + len(fresh))
            self.known.update(zip(distinct[fresh], index[fresh].tolist(), strict=True))
        w = index[code]
        size, begin = self.size[w], self.begin[w]
        end = np.cumsum(size)
        flat = self.flat[np.repeat(begin - (end - size), size) + np.arange(end[-1])]
        of_text = np.concatenate([[0], end])[np.cumsum(n)] - np.concatenate([[0], end])[np.cumsum(n) - n]
        return flat, of_text


#: Characters of text that are encoded at once.
CHARS_AT_ONCE = 4_000_000


def _pieces(texts: list[str | None]) -> Iterator[slice]:
    at, chars = 0, 0
    for k, t in enumerate(texts):
        chars += len(t or "")
        if chars > CHARS_AT_ONCE:
            yield slice(at, k + 1)
            at, chars = k + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def encode_rows(path: str, counts_only: bool = False):
    """For mapInArrow over (key columns..., text): the key columns and ids, or their number n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(path)
        for b in batches:
            texts = b.column("text").to_pylist()
            rest = [n for n in b.schema.names if n != "text"]
            for part in _pieces(texts):
                flat, n = e.batch(texts[part])
                if counts_only:
                    made = pa.array(n)
                else:
                    made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))
                own = [b.column(c).slice(part.start, part.stop - part.start) for c in rest]
                yield pa.RecordBatch.from_arrays([*own, made], names=[*rest, "n_tokens" if counts_only else "ids"])

    return run


def vocabulary_path(spark: SparkSession | None = None) -> str:
    """The vocabulary's place: the parameter spark.scriptorium.tokenizers, or the environment, or the default."""
    folder = spark.conf.get("spark.scriptorium.tokenizers", TOKENIZERS) if spark else TOKENIZERS
    return os.path.join(folder, VOCABULARY)


def token_ids(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids)."""
    return documents.select("doc_id", "text").mapInArrow(encode_rows(path), "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, path: str, *keys: str) -> DataFrame:
    """The key columns and n_tokens."""
    own = documents.select(*keys, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != "text")
    return own.mapInArrow(encode_rows(path, counts_only=True), f"{schema}, n_tokens long")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(read(spark, sf_dir, "documents", "doc_id", "text"), vocabulary_path(spark))


QUERIES = {"p8_ids": p8_ids}
SQL: dict[str, str] = {}
