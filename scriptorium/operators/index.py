"""The inverted index: postings, spellings and document frequencies as flat tables.

``build`` takes a corpus of (paper_id, title, abstract, keywords) and returns an ``Index``.
Words are stemmed once each, on the distinct vocabulary, and joined back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.stem import stems
from scriptorium.functions.text import pairs_of_characters, tokens
from scriptorium.shared import settled


@dataclass(frozen=True)
class Index:
    """papers: the corpus; postings: (term, paper_id, tf, positions); spellings: (term, orig, freq, first_doc, first_pos)."""

    papers: DataFrame
    postings: DataFrame
    spellings: DataFrame

    def write(self, path: str) -> None:
        """Postings in ranges of terms and spellings in ranges of spellings, sorted, so that filters on them skip row groups.

        Choosing ranges reads a table twice, so postings and spellings are settled before.
        """
        self.papers.write.mode("overwrite").parquet(f"{path}/papers")
        settled(self.postings).repartitionByRange("term", "paper_id").sortWithinPartitions("term", "paper_id").write.mode("overwrite").parquet(f"{path}/postings")
        settled(self.spellings).repartitionByRange("orig").sortWithinPartitions("orig").write.mode("overwrite").parquet(f"{path}/spellings")

    @staticmethod
    def read(spark, path: str) -> Index:
        return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("papers", "postings", "spellings")))


def index_text(title: str = "title", abstract: str = "abstract", keywords: str = "keywords") -> Column:
    """What is indexed of a record; positions run on from the title to the abstract and the keywords."""
    joined = F.when(F.size(keywords) > 0, F.array_join(keywords, " "))
    return F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit("")), joined)


def token_rows(papers: DataFrame, stopwords: set[str], segment=pairs_of_characters) -> DataFrame:
    """(paper_id, pos, word)."""
    return papers.select("paper_id", F.posexplode(tokens(index_text(), stopwords, segment)).alias("pos", "word"))


def word_rows(rows: DataFrame) -> DataFrame:
    """(paper_id, word, positions, n): the words of each document; grouped before they meet their stems."""
    return rows.groupBy("paper_id", "word").agg(F.array_sort(F.collect_list("pos")).alias("positions"), F.count("*").alias("n"))


def build(papers: DataFrame, stopwords: set[str], segment=pairs_of_characters) -> Index:
    words = word_rows(token_rows(papers, stopwords, segment))
    vocabulary = words.groupBy("word").agg(F.sum("n").alias("freq"), F.min(F.struct("paper_id", F.col("positions")[0])).alias("first"))
    terms = stems(vocabulary.select("word"))
    stemmed = words.join(terms, "word")
    postings = stemmed.groupBy("term", "paper_id").agg(F.sum("n").cast("int").alias("tf"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
    spellings = vocabulary.join(terms, "word").select("term", F.col("word").alias("orig"), "freq", F.col("first.paper_id").alias("first_doc"), F.col("first.col2").alias("first_pos"))
    return Index(papers, postings, spellings)


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def displays(spellings: DataFrame) -> DataFrame:
    """(term, display): the most frequent spelling, of equally frequent ones the first seen."""
    return spellings.groupBy("term").agg(F.max_by("orig", F.struct("freq", -F.col("first_doc"), -F.col("first_pos"))).alias("display"))


def stats(index: Index, stopwords: int) -> DataFrame:
    p = index.postings.agg(F.countDistinct("term").alias("unique_terms"), F.count("*").alias("total_postings"))
    n = index.papers.agg(F.count("*").alias("total_papers"))
    return n.crossJoin(p).withColumn("stopwords_count", F.lit(stopwords).cast("long"))  # one row each


def term_rows(index: Index) -> DataFrame:
    """(term, display, df) of every term; order them with ``by_frequency``."""
    return document_frequency(index.postings).join(displays(index.spellings), "term", "left").select("term", F.coalesce("display", "term").alias("display"), "df")


def by_frequency() -> list[Column]:
    return [F.desc("df"), F.lower("term"), F.col("term")]


def snapshot(index: Index, limit: int = 20) -> DataFrame:
    """The terms of most documents with their whole posting lists."""
    top = document_frequency(index.postings).orderBy(F.desc("df"), "term").limit(limit)
    lists = index.postings.join(F.broadcast(top), "term").groupBy("term", "df").agg(F.array_sort(F.collect_list(F.struct("paper_id", "tf", "positions"))).alias("postings"))
    return lists.join(displays(index.spellings.join(F.broadcast(top.select("term")), "term", "left_semi")), "term", "left").withColumn("display", F.coalesce("display", "term"))


def page(rows: DataFrame, number: int, size: int, *order: Column | str) -> DataFrame:
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def filter_terms(rows: DataFrame, part: str) -> DataFrame:
    part = part.strip().lower()
    return rows.where(F.lower("term").contains(part) | F.lower("display").contains(part)) if part else rows


def completions(spellings: DataFrame) -> DataFrame:
    """(orig, freq): a spelling's frequency over all terms it belongs to."""
    return spellings.groupBy("orig").agg(F.sum("freq").alias("freq"))


def suggest(index: Index, prefix: str, k: int = 10) -> DataFrame:
    """(word, freq): spellings that begin so; only if there are none, terms that hold the text."""
    prefix = prefix.strip().lower()
    found = completions(index.spellings.where(F.col("orig").startswith(prefix))).select(F.col("orig").alias("word"), "freq").orderBy(F.desc("freq"), "word").limit(k)
    if len(prefix) < 2 or found.head(1):
        return found
    return substring_suggest(index, prefix, k)


def substring_suggest(index: Index, part: str, k: int = 10) -> DataFrame:
    held = index.spellings.where(F.col("term").contains(part.lower())).groupBy(F.col("term").alias("word")).agg(F.sum("freq").alias("freq"))
    return held.orderBy(F.desc("freq"), F.desc("word")).limit(k)


def stem_vocabulary(postings: DataFrame) -> DataFrame:
    """(term, tf): occurrences of each term."""
    return postings.groupBy("term").agg(F.sum("tf").alias("tf"))


def language_histogram(papers: DataFrame) -> DataFrame:
    """Records by language; without one they count as English."""
    return papers.groupBy(F.coalesce(F.nullif("language", F.lit("")), F.lit("en")).alias("language")).agg(F.count("*").alias("papers"))


def append(index: Index, papers: DataFrame, stopwords: set[str], segment=pairs_of_characters) -> Index:
    """The index with further papers; ids that it has already are left as they are."""
    fresh = papers.join(index.papers.select("paper_id"), "paper_id", "left_anti")
    more = build(fresh, stopwords, segment)
    spellings = index.spellings.unionByName(more.spellings).groupBy("term", "orig").agg(F.sum("freq").alias("freq"), F.min(F.struct("first_doc", "first_pos")).alias("f"))
    return Index(
        index.papers.unionByName(fresh, allowMissingColumns=True),
        index.postings.unionByName(more.postings),
        spellings.select("term", "orig", "freq", "f.first_doc", "f.first_pos"),
    )


def remove(index: Index, ids: DataFrame, stopwords: set[str], segment=pairs_of_characters) -> Index:
    """The index without the papers of these ids (paper_id); only their own words are taken out of the spellings.

    A spelling that was first seen in a removed paper is looked up again, in the papers that hold its term.
    """
    ids = ids.select("paper_id").distinct()
    gone, rest = (index.papers.join(ids, "paper_id", how) for how in ("left_semi", "left_anti"))
    postings = index.postings.join(ids, "paper_id", "left_anti")
    less = build(gone, stopwords, segment).spellings.select("term", "orig", (-F.col("freq")).alias("freq"))
    freq = index.spellings.select("term", "orig", "freq").unionByName(less).groupBy("term", "orig").agg(F.sum("freq").alias("freq")).where("freq > 0")
    kept = freq.join(index.spellings.drop("freq"), ["term", "orig"])
    moved = kept.join(ids.withColumnRenamed("paper_id", "first_doc"), "first_doc", "left_semi").select("term", "orig")
    holders = rest.join(postings.join(moved.select("term").distinct(), "term", "left_semi").select("paper_id").distinct(), "paper_id", "left_semi")
    seen = token_rows(holders, stopwords, segment).groupBy(F.col("word").alias("orig")).agg(F.min(F.struct("paper_id", "pos")).alias("f"))
    again = moved.join(seen, "orig").select("term", "orig", F.col("f.paper_id").alias("doc"), F.col("f.pos").alias("at"))
    spellings = kept.join(again, ["term", "orig"], "left").select("term", "orig", "freq", F.coalesce("doc", "first_doc").alias("first_doc"), F.when(F.col("doc").isNotNull(), F.col("at")).otherwise(F.col("first_pos")).alias("first_pos"))
    return Index(rest, postings, spellings)
