"""Guards over the answer of an injected metadata refiner (a language model, say); without one, records stay as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import fenced_json, strip, text_or_empty

ANSWER = "title string, abstract string, authors array<string>, year int, keywords array<string>"
# Lengths, years and words that an answer must respect.
TITLE, ABSTRACT_LEAST, ABSTRACT_MOST, MARKER_WITHIN = (4, 150), 60, 3000, 4000
YEARS, KEYWORD, MOST_AUTHORS, MOST_KEYWORDS = (1900, 2100), (2, 40), 10, 8
GENERIC_WORDS = [
    "方法", "研究", "问题", "系统", "基于", "一种", "分析", "应用", "实现", "本文", "论文", "模型", "与", "的", "在", "中", "本文提出", "引言", "介绍", "结论", "摘要", "相关工作",
    "study", "approach", "method", "system", "analysis", "based", "application", "using", "propose", "model", "paper", "introduction", "conclusion", "abstract", "references",
    "background", "work",
]
# A text has an abstract of its own where a marker stands; heads that are no titles; beginnings that are no abstracts.
MARKER = "摘要|Abstract|Summary"
NO_TITLE = r"(?i)^(\d{1,2}\s*[.、]?\s+[A-Za-z\x{4e00}-\x{9fff}]|\d{4}$|(introduction|abstract|references|background)\b)"
INTRODUCTION = r"(?i)^(引言|introduction|we present|in this (paper|work)|this (paper|work) (presents|proposes|introduces))"
EDGES = "。，,;；"


def useful_keywords(words: Column) -> Column:
    """Distinct keywords of fitting length that are neither numbers nor generic."""
    kept = F.filter(F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: strip(w, EDGES)), lambda w: F.length(w).between(*KEYWORD) & ~w.rlike(r"^\d+$") & ~F.lower(w).isin(*GENERIC_WORDS))
    return F.slice(F.array_distinct(kept), 1, MOST_KEYWORDS)


def refined(parsed: DataFrame, refine: Callable[[Column], Column] | None = None) -> DataFrame:
    """Parsed records (text, title, abstract, authors, year) with an answer's fields where they pass; adds agent_keywords, ai_used.

    refine: from a text to the answer, JSON with or without a fence; an answer that is no JSON changes nothing.
    """
    none = F.lit(None).cast("array<string>")
    if refine is None:
        return parsed.withColumn("agent_keywords", none).withColumn("ai_used", F.lit(False))
    df = parsed.withColumn("_a", F.from_json(fenced_json(refine(F.col("text"))), ANSWER))
    a = lambda n: F.col(f"_a.{n}")
    title, abstract = strip(text_or_empty(a("title"))), strip(text_or_empty(a("abstract")))
    marker = F.coalesce(F.left(F.col("text"), F.lit(MARKER_WITHIN)).rlike(MARKER), F.lit(False))
    authors = F.slice(F.filter(F.transform(F.coalesce(a("authors"), F.array().cast("array<string>")), lambda n: strip(n)), lambda n: F.length(n) >= 2), 1, MOST_AUTHORS)
    keywords = useful_keywords(a("keywords"))
    out = df.withColumns(
        {
            "title": F.when(F.length(title).between(*TITLE) & ~title.rlike(NO_TITLE), title).otherwise(F.col("title")),
            "abstract": F.when(marker & (F.length(abstract) >= ABSTRACT_LEAST) & ~abstract.rlike(INTRODUCTION), F.left(abstract, F.lit(ABSTRACT_MOST))).otherwise(F.col("abstract")),
            "authors": F.when(F.size(authors) > 0, authors).otherwise(F.col("authors")),
            "year": F.when(a("year").between(*YEARS), a("year")).otherwise(F.col("year")),
            "agent_keywords": F.when((F.size(keywords) > 0) & (F.coalesce(F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("abstract"), F.lit("")), F.nullif(title, F.lit(""))).isNotNull()), keywords),
            "ai_used": F.coalesce(F.coalesce(a("title"), a("abstract"), a("year").cast("string")).isNotNull() | (F.size(authors) > 0), F.lit(False)),
        }
    )
    return out.drop("_a")
