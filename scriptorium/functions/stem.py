"""Suffix stripping of English words (the published algorithm of 1980) as SQL expressions.

Each step is one CASE expression over the word column ``w``; the text is the same for
Spark and DuckDB but for the name of the pattern test, so one definition serves both the engine and its oracle.
A leading y is held in upper case while the steps run: it is a consonant there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
POSITIVE = f"^({_C})?{_V}{_C}"  # measure > 0
ABOVE_ONE = f"^({_C})?{_V}{_C}{_V}{_C}"  # measure > 1
EXACTLY_ONE = f"^({_C})?{_V}{_C}({_V})?$"
HAS_VOWEL = f"^({_C})?[aeiouy]"
SHORT_END = f"^{_C}[aeiouy][^aeiouwxy]$"  # consonant, vowel, consonant other than w, x, y, with measure 1
DOUBLED = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|[^aeiouy]yy)$"

# Suffixes and what replaces them.
DERIVED = dict(
    zip(
        "ational tional enci anci izer abli alli entli eli ousli ization ation ator alism iveness fulness ousness aliti iviti biliti logi".split(),
        "ate tion ence ance ize able al ent e ous ize ate ate al ive ful ous al ive ble log".split(),
        strict=True,
    )
)
ADJECTIVAL = dict(zip("icate ative alize iciti ical ful ness".split(), ("ic", "", "al", "ic", "ic", "", ""), strict=True))
FINAL = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _stem(suffix: str) -> str:
    return f"left(w, length(w) - {len(suffix)})"


def steps(test: str) -> list[str]:
    """The CASE expression of each step; ``test`` is the dialect's function of (text, pattern)."""

    def is_(text: str, pattern: str) -> str:
        return f"{test}({text}, '{pattern}')"

    def swap(suffixes: dict[str, str], measure: str) -> str:
        # the longest suffix that fits decides, whether or not its stem is long enough
        order = sorted(suffixes, key=len, reverse=True)
        cases = "".join(f" WHEN w LIKE '%{s}' THEN CASE WHEN {is_(_stem(s), measure)} THEN concat({_stem(s)}, '{suffixes[s]}') ELSE w END" for s in order)
        return f"CASE{cases} ELSE w END"

    plural = f"CASE WHEN w LIKE '%sses' THEN {_stem('es')} WHEN w LIKE '%ies' THEN {_stem('es')} WHEN w LIKE '%ss' THEN w WHEN w LIKE '%s' THEN {_stem('s')} ELSE w END"
    # the mark \u0001 says that -ed or -ing went, so that the next step repairs the stem
    past = (
        f"CASE WHEN w LIKE '%eed' THEN CASE WHEN {is_(_stem('eed'), POSITIVE)} THEN {_stem('d')} ELSE w END"
        f" WHEN w LIKE '%ed' AND {is_(_stem('ed'), HAS_VOWEL)} THEN concat({_stem('ed')}, '+')"
        f" WHEN w LIKE '%ing' AND {is_(_stem('ing'), HAS_VOWEL)} THEN concat({_stem('ing')}, '+') ELSE w END"
    )
    bare = _stem("+")
    repair = (
        f"CASE WHEN w NOT LIKE '%+' THEN w WHEN w LIKE '%at+' OR w LIKE '%bl+' OR w LIKE '%iz+' THEN concat({bare}, 'e')"
        f" WHEN {is_(bare, DOUBLED)} THEN {_stem('x+')}"
        f" WHEN {is_(bare, SHORT_END)} THEN concat({bare}, 'e') ELSE {bare} END"
    )
    y = f"CASE WHEN w LIKE '%y' AND {is_(_stem('y'), HAS_VOWEL)} THEN concat({_stem('y')}, 'i') ELSE w END"
    order = sorted(FINAL, key=len, reverse=True)
    last = "".join(
        f" WHEN w LIKE '%{s}' THEN CASE WHEN {is_(_stem(s), ABOVE_ONE)}" + (f" AND {is_(_stem(s), '[st]$')}" if s == "ion" else "") + f" THEN {_stem(s)} ELSE w END" for s in order
    )
    e = f"CASE WHEN w LIKE '%e' AND ({is_(_stem('e'), ABOVE_ONE)} OR {is_(_stem('e'), EXACTLY_ONE)} AND NOT {is_(_stem('e'), SHORT_END)}) THEN {_stem('e')} ELSE w END"
    ll = f"CASE WHEN w LIKE '%ll' AND {is_(_stem('l'), ABOVE_ONE)} THEN {_stem('l')} ELSE w END"
    return [plural, past, repair, y, swap(DERIVED, POSITIVE), swap(ADJECTIVAL, POSITIVE), f"CASE{last} ELSE w END", e, ll]


APPLIES = "^[a-z]{4,}$"


def stems(words: DataFrame) -> DataFrame:
    """(word, term) for a table of distinct words; what isn't a plain word of four letters or more stays."""
    done = words.select("word", F.regexp_replace("word", "^y", "Y").alias("w"))
    for step in steps("regexp_like"):
        done = done.select("word", F.expr(f"CASE WHEN word RLIKE '{APPLIES}' THEN {step} ELSE w END").alias("w"))
    done = done.select("word", F.when(F.col("word").rlike(APPLIES), F.lower("w")).otherwise(F.col("word")).alias("term"))
    # An aggregate over the words, which are distinct and partitioned so already, keeps filters on the term from being
    # pushed into the steps, where each would repeat the one before many times over.
    return done.groupBy("word").agg(F.max("term").alias("term"))


def stems_sql(words: str) -> str:
    """DuckDB: (word, term) from a relation of distinct words."""
    inner = f"SELECT word, regexp_replace(word, '^y', 'Y') AS w FROM {words}"
    for step in steps("regexp_matches"):
        inner = f"SELECT word, CASE WHEN regexp_matches(word, '{APPLIES}') THEN {step} ELSE w END AS w FROM ({inner})"
    return f"SELECT word, CASE WHEN regexp_matches(word, '{APPLIES}') THEN lower(w) ELSE word END AS term FROM ({inner})"
