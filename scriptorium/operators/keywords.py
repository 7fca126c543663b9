"""Keywords of a record by weighted term frequency and inverse document frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.stem import stems
from scriptorium.functions.text import pairs_of_characters, tokens
from scriptorium.operators.index import Index, build, document_frequency

# The weight of a title's and an abstract's occurrence.
TITLE_WEIGHT, ABSTRACT_WEIGHT = 2, 1


def idf(df, total):
    """ln((N + 1) / (df + 1)) + 1."""
    return F.log((F.lit(total) + 1.0) / (df + 1.0)) + 1.0


def ranked_keywords(papers: DataFrame, df: DataFrame, total: int, stopwords: set[str], k: int = 8, segment=pairs_of_characters, known: DataFrame | None = None) -> DataFrame:
    """(paper_id, rank, keyword, score): the k best terms of each record, shown in the record's most usual spelling.

    Terms of one letter don't count; terms that show the same spelling count once. known: (word, term) of every
    word of the records, where an index has them; otherwise words are stemmed here.
    """
    weigh = lambda field, w, base: F.transform(tokens(F.col(field), stopwords, segment), lambda t, i: F.struct(t.alias("word"), F.lit(w).alias("w"), (i + F.lit(base)).alias("pos")))
    rows = papers.select("paper_id", F.inline(F.concat(weigh("title", TITLE_WEIGHT, 0), weigh("abstract", ABSTRACT_WEIGHT, 1 << 24))))
    words = rows.groupBy("paper_id", "word").agg(F.sum("w").alias("w"), F.min("pos").alias("first"))
    known = stems(words.select("word").distinct()) if known is None else known
    stemmed = words.join(known, "word").where(F.length("term") >= 2)
    usual = F.max_by("word", F.struct("w", -F.col("first")))
    per_term = stemmed.groupBy("paper_id", "term").agg(F.sum("w").alias("tf"), usual.alias("keyword"))
    scored = per_term.join(df, "term", "left").withColumn("score", F.round(F.col("tf") * idf(F.coalesce("df", F.lit(0)), total), 4))
    order = Window.partitionBy("paper_id").orderBy(F.desc("score"), "term")
    placed = scored.withColumn("place", F.row_number().over(order))
    once = placed.groupBy("paper_id", "keyword").agg(F.min("place").alias("place"), F.max_by("score", -F.col("place")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("paper_id").orderBy("place"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("paper_id", "rank", "keyword", "score")


def keyword_lists(ranked: DataFrame) -> DataFrame:
    """(paper_id, keywords)."""
    return ranked.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))), lambda x: x["keyword"]).alias("keywords"))


def with_final_keywords(papers: DataFrame, stopwords: set[str], preserve_explicit: bool = False, segment=pairs_of_characters) -> Index:
    """Two passes: document frequencies of the records as they are give the keywords; these are then indexed with them."""
    first = build(papers, stopwords, segment)
    total = papers.count()
    found = keyword_lists(ranked_keywords(papers, document_frequency(first.postings), total, stopwords, segment=segment)).withColumnRenamed("keywords", "found")
    final = F.coalesce("found", F.array().cast("array<string>"))
    if preserve_explicit:
        final = F.when(F.size("keywords") > 0, F.col("keywords")).otherwise(final)
    return build(papers.join(found, "paper_id", "left").withColumn("keywords", final).drop("found"), stopwords, segment)
