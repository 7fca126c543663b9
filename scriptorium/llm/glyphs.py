"""Problem 2: one consistent form for text that looks the same.

A longest-match transducer over grapheme clusters, compiled once from rules over the Unicode character database (widths,
ligatures, radicals, compatibility forms, spaces, invisible characters, composed accents) and a short list of
look-alike letters.  Its keys are clusters; keys of look-alike letters belong to a context, the script that the
letter's word is written in, and are tried before those without.  Compiling checks the table for conflicts: within
a context no key has two outputs and no output holds a key, so a text needs one pass and its result is a fixed point.

The pass takes, at each place, the longest key: a whole cluster, or else its parts.  A word's script is that of its
letters that look like none of another script; a word made of look-alikes alone takes the script of its neighbours,
so its output waits until two more words are read.

A text enters the transducer if it holds a character of a key, a letter beside one of another script, or a word
made of look-alikes alone; compiling checks that no key is missed by this test.  Plain ASCII never leaves the JVM.

Edge cases: null stays null and is unaffected; an empty text stays empty; texts
of any length are processed whole; repeated rows give repeated rows; other columns are
not touched.  Precomposed accents, typographic quotes and dashes, Chinese punctuation and
whole words in their own script are left as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.common import beyond_ascii, char_class, read

# Letters that look like a Latin letter, and that letter.
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХЬаеорсухіѕјԁԛԝһ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονι",
        "ABESIJKMHOPCTYXbaeopcyxisjdqwh" "ABEZHIKMNOPTYXovi",
        strict=True,
    )
)
# Simplified radical forms that the character database doesn't decompose, and their characters.
RADICALS = dict(zip("⺠⻁⻄⻅⻆⻉⻋⻓⻔⻘⻚⻛⻜⻝⻢⻣⻤⻥⻦⻨⻩⻬⻮⻰⻳", "民虎西见角贝车长门青页风飞食马骨鬼鱼鸟麦黄齐齿龙龟", strict=True))
# Dashes kept apart from the plain hyphen only by line breaking.
HYPHENS = {"‑": "-"}


class ConflictError(ValueError):
    """Two rules give one key different outputs, or an output holds a key."""


_PLAIN_EXCEPTIONS = {"™"}


def _rules() -> Iterator[tuple[str, str]]:
    """(key, output) of what doesn't depend on the word."""
    for o in range(0x00A0, 0x30000):
        c = chr(o)
        kind, decomposition = unicodedata.category(c), unicodedata.decomposition(c)
        if c in _PLAIN_EXCEPTIONS:
            continue
        if kind == "Zs":
            yield c, " "
        elif kind == "Cf" and not 0x600 <= o <= 0x8FF and o not in (0x110BD, 0x110CD):
            yield c, ""
        elif 0xFF01 <= o <= 0xFF5E:
            if (plain := chr(o - 0xFEE0)).isalnum():
                yield c, plain
        elif 0x2E80 <= o <= 0x2FDF or 0xF900 <= o <= 0xFAFF or 0x2F800 <= o <= 0x2FA1F:
            if decomposition:
                yield c, unicodedata.normalize("NFKC", c)
        elif 0xFB00 <= o <= 0xFB06 or 0x1D400 <= o <= 0x1D7FF or (0x2100 <= o <= 0x218F and kind in ("Lu", "Ll", "Lo")):
            if (plain := unicodedata.normalize("NFKC", c)) != c:
                yield c, plain
        elif 0x2160 <= o <= 0x217F or (0x24B6 <= o <= 0x24E9) or 0x3400 <= o and decomposition.startswith("<wide>"):
            yield c, unicodedata.normalize("NFKC", c)
    yield from RADICALS.items()
    yield from HYPHENS.items()
    for o in range(0x00C0, 0x2000):
        c = chr(o)
        apart = unicodedata.normalize("NFD", c)
        # what is written as a letter and its marks, also with only the last of them apart
        if apart != c and len(apart) > 1 and apart[0].isalpha() and unicodedata.normalize("NFC", apart) == c:
            yield apart, c
            shorter = unicodedata.normalize("NFC", apart[:-1]) + apart[-1]
            if shorter not in (apart, c):
                yield shorter, c


#: Contexts of a key: none, and a word in Latin or Cyrillic script.
ANY, IN_LATIN, IN_CYRILLIC = "", "latin", "cyrillic"


def _contextual() -> Iterator[tuple[str, str, str]]:
    """(context, key, output) of look-alike letters."""
    latin_to_cyrillic = {v: k for k, v in reversed(LOOKALIKES.items()) if "Ѐ" <= k}
    for other, latin in LOOKALIKES.items():
        yield IN_LATIN, other, latin
        if other < "Ѐ" and latin in latin_to_cyrillic:
            yield IN_CYRILLIC, other, latin_to_cyrillic[latin]
    for latin, cyrillic in latin_to_cyrillic.items():
        yield IN_CYRILLIC, latin, cyrillic


def compile_table(rules: Iterable[tuple[str, ...]]) -> dict[str, dict[str, str]]:
    """context -> key -> output, from (key, output) or (context, key, output)."""
    tables: dict[str, dict[str, str]] = {ANY: {}, IN_LATIN: {}, IN_CYRILLIC: {}}
    for *context, key, out in rules:
        own = tables[context[0] if context else ANY]
        if own.setdefault(key, out) != out:
            raise ConflictError(f"{key!r} gives both {own[key]!r} and {out!r}")
    for context, own in tables.items():
        for key, out in own.items():
            parts = {out[i:j] for i in range(len(out)) for j in range(i + 1, len(out) + 1)}
            if parts & own.keys() or parts & tables[ANY].keys():
                raise ConflictError(f"the output of {key!r} holds a key")
            if context and key in tables[ANY]:
                raise ConflictError(f"{key!r} has an output with and without a context")
    return tables


@lru_cache(1)
def tables() -> dict[str, dict[str, str]]:
    return compile_table([*_rules(), *_contextual()])


# Letters of Latin script, and of Greek and Cyrillic script.
LATIN, OTHER = r"A-Za-zÀ-ɏ", r"Ͱ-ϿЀ-ԯ"
_FOREIGN = "".join(LOOKALIKES)
_TWINS = "".join(sorted(set(LOOKALIKES.values())))

# Ranges without any key.
PLAIN_RANGES = "\x00-\x7F¡-¬®-ɏ\u0391-\u03c9\u0401-\u045f\u2012-\u2027\u2030-\u203a€№™\u2190-\u23ff\u3001-\u3015\u4e00-\u9fff！-／：-？"
_TRIGGER = re.compile(f"[^{PLAIN_RANGES}]|[{LATIN}][{OTHER}]|[{OTHER}][{LATIN}]|[Ͱ-Ͽ][Ѐ-ԯ]|[Ѐ-ԯ][Ͱ-Ͽ]|(?<![^\\W\\d_])[{_FOREIGN}]+(?![^\\W\\d_])")

_SURE_LATIN = regex.compile(f"[{LATIN}--[{_TWINS}]]", regex.V1)
_SURE_CYRILLIC = regex.compile(f"[Ѐ-ԯ--[{_FOREIGN}]]", regex.V1)
_SURE_OTHER = regex.compile(f"[{OTHER}--[{_FOREIGN}]]", regex.V1)
_ANY_LATIN, _ANY_OTHER, _TWO_LATIN = re.compile(f"[{LATIN}]"), re.compile(f"[{OTHER}]"), re.compile("[A-Za-z]{2}")
_ANY_CYRILLIC = re.compile("[Ѐ-ԯ]")
#: Words on each side that a word of look-alikes alone takes its script from.
NEAR = 2


class Transducer:
    """The compiled tables."""

    def __init__(self) -> None:
        self.tables = tables()
        for context, own in self.tables.items():
            for key in own:
                sample = key if not context else f"{key} w" if context == IN_LATIN else f"{key}б"
                if not _TRIGGER.search(sample):
                    raise ConflictError(f"the test for texts misses {key!r}")
        keys = self.tables[ANY]
        firsts = char_class({k[0] for k in keys if len(k) == 1})
        firsts = regex.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", firsts)
        # a word with what is invisible or decomposed in it; a cluster that isn't a letter's
        self.token = regex.compile(r"(?P<word>[\p{L}\p{M}\p{Cf}]*\p{L}[\p{L}\p{M}\p{Cf}]*)|(?P<other>[" + firsts + r"]\p{M}*)")
        self.cluster = regex.compile(r"\P{M}\p{M}*|\p{M}+")
        self.words = lru_cache(100_000)(self.word)

    def longest(self, cluster: str, table: dict[str, str]) -> str:
        """The output of a cluster: of the longest keys from its beginning on."""
        if cluster in table:
            return table[cluster]
        if len(cluster) > 2 and unicodedata.combining(cluster[-1]):
            cluster = unicodedata.normalize("NFD", cluster)  # marks in their canonical order
        out, i, n = [], 0, len(cluster)
        while i < n:
            j = next((j for j in range(n, i, -1) if cluster[i:j] in table), 0)
            out.append(table[cluster[i:j]] if j else cluster[i])
            i = j or i + 1
        done = "".join(out)
        return done if done == cluster else self.longest(done, table)

    def word(self, text: str) -> tuple[str, str | None]:
        """A word without what doesn't depend on its script, and its script: null if only look-alikes hold it."""
        plain = text if text.isascii() else "".join(self.longest(c, self.tables[ANY]) for c in self.cluster.findall(text))
        latin, other = _SURE_LATIN.search(plain), _SURE_OTHER.search(plain)
        if latin or other:
            script = ANY if latin and other else IN_LATIN if latin else IN_CYRILLIC if _ANY_CYRILLIC.search(plain) else ANY
        else:
            script = None if _ANY_OTHER.search(plain) or _ANY_LATIN.search(plain) else ANY
        return plain, script

    def in_script(self, word: str, script: str) -> str:
        return "".join(self.tables[script].get(c, c) for c in word) if script else word

    def run(self, text: str) -> str:
        out: list[str] = []
        waiting: list[tuple[int, str]] = []  # places in out of words that wait for their neighbours
        words: list[str] = []  # words as they came, for their neighbours
        at = 0

        def settle(place: int, number: int) -> None:
            word = words[number]
            near = " ".join((*words[max(0, number - NEAR) : number], *words[number + 1 : number + 1 + NEAR]))
            mixed = bool(_ANY_LATIN.search(word)) and bool(_ANY_OTHER.search(word))
            if not _ANY_OTHER.search(word):
                return
            if _SURE_CYRILLIC.search(near):
                out[place] = self.in_script(word, IN_CYRILLIC) if mixed else word
            elif (mixed or _TWO_LATIN.search(near)) and not _SURE_OTHER.search(near):
                out[place] = self.in_script(word, IN_LATIN)

        for m in self.token.finditer(text):
            out.append(text[at : m.start()])
            at = m.end()
            if m["word"] is None:
                out.append(self.longest(m[0], self.tables[ANY]))
                continue
            plain, script = self.words(m[0])
            words.append(plain)
            out.append(plain if not script else self.in_script(plain, script))
            if script is None:
                waiting.append((len(out) - 1, len(words) - 1))
            while waiting and waiting[0][1] + NEAR < len(words):
                settle(*waiting.pop(0))
        for x in waiting:
            settle(*x)
        return "".join(out) + text[at:]


@lru_cache(1)
def transducer() -> Transducer:
    return Transducer()


def normalise(text: str | None) -> str | None:
    """The consistent form of one text; the text itself if nothing in it is a trigger."""
    if not text or text.isascii() or not _TRIGGER.search(text):
        return text
    return transducer().run(text)


@F.pandas_udf(T.StringType())
def _normalise_udf(texts: pd.Series) -> pd.Series:
    return texts.map(normalise, na_action="ignore")


def normalised(column: str) -> Column:
    """The consistent form of a string column; only rows with a trigger leave the JVM's expression."""
    c = F.col(column)
    return F.when(beyond_ascii(c), _normalise_udf(c)).otherwise(c)


def unify(df: DataFrame, *columns: str) -> DataFrame:
    """Adds, for each column, ``<column>_unified`` and whether it was affected, ``<column>_affected``."""
    for c in columns:
        df = df.withColumn(f"{c}_unified", normalised(c))
        df = df.withColumn(f"{c}_affected", F.coalesce(F.col(f"{c}_unified") != F.col(c), F.lit(False)))
    return df


def candidates(papers: DataFrame) -> DataFrame:
    """(paper_id, field, text): the fields that may hold a trigger."""
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("title", "abstract")]))
    return papers.select(F.col("id").alias("paper_id"), fields.alias("f")).select("paper_id", "f.*").where(beyond_ascii(F.col("text")))


def _changes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        done = b["text"].map(normalise)
        yield b.assign(unified=done)[done != b["text"]][["paper_id", "field", "unified"]]


def affected_fields(papers: DataFrame) -> DataFrame:
    """(paper_id, field, unified) of the fields that change."""
    return candidates(papers).mapInPandas(_changes, "paper_id long, field string, unified string")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm import recode

    papers = read(spark, sf_dir, "papers", "id", "title", "abstract", "source")
    garbled = recode.p3_found(spark, sf_dir)
    found = affected_fields(papers).select("paper_id", "field")
    return found.join(garbled, ["paper_id", "field"], "left_anti").distinct()


def p2_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paper with the consistent form of its title and abstract."""
    papers = read(spark, sf_dir, "papers", "id", "title", "abstract")
    return unify(papers, "title", "abstract").select(
        F.col("id").alias("paper_id"), "title_unified", "abstract_unified", "title_affected", "abstract_affected"
    )


QUERIES = {"p2_found": p2_found, "p2_unified": p2_unified}
SQL: dict[str, str] = {}
