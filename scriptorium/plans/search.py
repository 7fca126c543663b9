"""Queries as one DataFrame plan each: leaves are resolved to hits, pivoted by document, filtered by the compiled query."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.stem import stems
from scriptorium.functions.text import detect_language, pairs_of_characters, tokens
from scriptorium.operators.index import Index, displays
from scriptorium.operators.keywords import idf
from scriptorium.plans.query import And, Node, Not, Or, QuerySyntaxError, Word, holds_for_nothing, is_boolean, leaves, parse

TOP_K = 50
SHOWN_POSITIONS = 30


@dataclass(frozen=True)
class SearchResult:
    """hits: (paper_id, score, matched); ranked: the best of them with the papers' columns; count: of all hits."""

    query: str
    query_type: str
    mode: str
    hits: DataFrame | None
    ranked: DataFrame | None
    trace: dict = field(default_factory=dict)
    error: str | None = None

    def count(self) -> int:
        return self.hits.count() if self.hits is not None else 0


def query_terms(spark: SparkSession, texts: list[str], stopwords: set[str], segment=pairs_of_characters) -> list[list[tuple[str, str]]]:
    """(original, term) of the tokens of each part of a query, in order: the same analysis as the index has, in one job."""
    parts = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    words = parts.select("i", F.posexplode(tokens(F.col("text"), stopwords, segment)).alias("pos", "word"))
    found: list[list[tuple[str, str]]] = [[] for _ in texts]
    for r in words.join(stems(words.select("word").distinct()), "word").orderBy("i", "pos").collect():  # the words of one query
        found[r["i"]].append((r["word"], r["term"]))
    return found


def phrase_hits(postings: DataFrame, terms: list[str]) -> DataFrame:
    """(paper_id, tf, positions) where the terms stand one after the other: starts that every term, shifted, agrees on."""
    spark = postings.sparkSession
    places = spark.createDataFrame(list(enumerate(terms)), "i int, term string")
    starts = postings.where(F.col("term").isin(*terms)).join(F.broadcast(places), "term").select("paper_id", "i", F.explode("positions").alias("p")).select("paper_id", (F.col("p") - F.col("i")).alias("start"), "i")
    whole = starts.groupBy("paper_id", "start").agg(F.countDistinct("i").alias("n")).where((F.col("n") == len(terms)) & (F.col("start") >= 0))
    return whole.groupBy("paper_id").agg(F.count("*").cast("int").alias("tf"), F.array_sort(F.collect_list("start")).alias("positions"))


def all_of(postings: DataFrame, terms: list[str]) -> DataFrame:
    """(paper_id, tf, positions) of documents with every term: frequencies add up, positions are the first term's."""
    rows = postings.where(F.col("term").isin(*terms))
    g = rows.groupBy("paper_id").agg(F.count("*").alias("n"), F.sum("tf").cast("int").alias("tf"), F.first(F.when(F.col("term") == terms[0], F.col("positions")), ignorenulls=True).alias("positions"))
    return g.where(F.col("n") == len(terms)).drop("n")


class Searcher:
    """Runs queries over an index."""

    def __init__(self, index: Index, stopwords: set[str], segment=pairs_of_characters, bilingual: DataFrame | None = None) -> None:
        self.index, self.stopwords, self.segment, self.bilingual = index, stopwords, segment, bilingual
        self.spark = index.postings.sparkSession
        self._total: int | None = None
        self._analysed: dict[str, list[tuple[str, str]]] = {}

    @property
    def total(self) -> int:
        if self._total is None:
            self._total = self.index.papers.count()
        return self._total

    # leaves

    def terms(self, *texts: str) -> list[list[tuple[str, str]]]:
        """The terms of each text; what was analysed before is remembered."""
        fresh = [t for t in dict.fromkeys(texts) if t not in self._analysed]
        if fresh:
            self._analysed.update(zip(fresh, query_terms(self.spark, fresh, self.stopwords, self.segment), strict=True))
        return [self._analysed[t] for t in texts]

    def leaf_hits(self, leaf: str) -> DataFrame | None:
        """(paper_id, tf, positions) of one leaf; None if no document can match."""
        found = [t for _, t in self.terms(leaf)[0]]
        if not found:
            return None
        if " " in leaf and len(found) > 1:
            return phrase_hits(self.index.postings, found)
        distinct = list(dict.fromkeys(found))
        if len(distinct) == 1:
            return self.index.postings.where(F.col("term") == distinct[0]).select("paper_id", "tf", "positions")
        return all_of(self.index.postings, distinct)

    def scored(self, per_leaf: list[tuple[str, DataFrame]], mode: str) -> DataFrame:
        """(leaf, paper_id, tf, positions, part): every hit with its part of the score."""
        hits = None
        for leaf, h in per_leaf:
            own = h.select(F.lit(leaf).alias("leaf"), "paper_id", "tf", "positions")
            hits = own if hits is None else hits.unionByName(own)
        if mode == "tfidf":
            df = hits.groupBy("leaf").agg(F.count("*").alias("df"))
            hits = hits.join(F.broadcast(df), "leaf")  # a row for each leaf of the query
            return hits.withColumn("part", F.col("tf") * idf(F.col("df"), self.total)).drop("df")
        return hits.withColumn("part", F.col("tf").cast("double"))

    def ranked(self, hits: DataFrame, k: int | None) -> DataFrame:
        """The best k, by score and then id; the papers' columns join only those."""
        best = hits.orderBy(F.desc("score"), "paper_id")
        best = best.limit(k) if k is not None else best
        return best.join(self.index.papers, "paper_id").orderBy(F.desc("score"), "paper_id")

    def _matched(self) -> Column:
        return F.array_sort(F.collect_list(F.struct(F.col("leaf").alias("term"), "tf", F.slice("positions", 1, SHOWN_POSITIONS).alias("positions"))))

    def shown(self, ranked: DataFrame) -> DataFrame:
        """Ranked hits with the usual spelling of each matched term."""
        m = ranked.select("paper_id", F.explode("matched").alias("m")).select("paper_id", "m.*")
        own = self.index.spellings.join(m.select("term").distinct(), "term", "left_semi")
        m = m.join(displays(own), "term", "left").withColumn("display", F.coalesce("display", "term"))
        again = m.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("term", "display", "tf", "positions"))).alias("matched_terms"))
        return ranked.drop("matched").join(again, "paper_id", "left").orderBy(F.desc("score"), "paper_id")

    # kinds of search

    def boolean(self, query: str, mode: str = "tf") -> DataFrame | None:
        """(paper_id, score, matched) of all documents that the query holds for."""
        ast = parse(query)
        names = leaves(ast)
        self.terms(*names)
        per_leaf = [(leaf, h) for leaf in names if (h := self.leaf_hits(leaf)) is not None]
        if not per_leaf and not holds_for_nothing(ast):
            return None
        flags = {leaf: f"l{i}" for i, leaf in enumerate(names)}
        if per_leaf:
            hits = self.scored(per_leaf, mode)
            pivot = hits.groupBy("paper_id").agg(F.round(F.sum("part"), 4).alias("score"), self._matched().alias("matched"), *[F.max(F.col("leaf") == leaf).alias(f) for leaf, f in flags.items()])
        else:
            pivot = self.index.papers.select("paper_id", F.lit(0.0).alias("score"), F.lit(None).alias("matched")).limit(0)
        if holds_for_nothing(ast):
            pivot = self.index.papers.select("paper_id").join(pivot, "paper_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        has = {f: F.coalesce(F.col(f), F.lit(False)) if f in pivot.columns else F.lit(False) for f in flags.values()}
        return pivot.where(_compiled(ast, {leaf: has[f] for leaf, f in flags.items()})).select("paper_id", "score", "matched")

    def keywords(self, query: str, mode: str = "tf") -> DataFrame | None:
        """Documents that have every term of the query."""
        terms = list(dict.fromkeys(t for _, t in self.terms(query)[0]))
        return self._of_terms(terms, mode, every=True)

    def union(self, terms: list[str], mode: str = "tf") -> DataFrame | None:
        """Documents that have any of the terms."""
        return self._of_terms(list(dict.fromkeys(terms)), mode, every=False)

    def _of_terms(self, terms: list[str], mode: str, every: bool) -> DataFrame | None:
        if not terms:
            return None
        rows = self.index.postings.where(F.col("term").isin(*terms)).withColumnRenamed("term", "leaf")
        if mode == "tfidf":
            df = rows.groupBy("leaf").agg(F.count("*").alias("df"))
            rows = rows.join(F.broadcast(df), "leaf").withColumn("part", F.col("tf") * idf(F.col("df"), self.total))
        else:
            rows = rows.withColumn("part", F.col("tf").cast("double"))
        g = rows.groupBy("paper_id").agg(F.count("*").alias("n"), F.round(F.sum("part"), 4).alias("score"), self._matched().alias("matched"))
        return (g.where(F.col("n") == len(terms)) if every else g).select("paper_id", "score", "matched")

    # languages

    def translations(self, words: list[str]) -> list[tuple[str, str, list[str]]]:
        """(word, language of the translations, translations) of the words that the dictionary has."""
        if self.bilingual is None or not words:
            return []
        wanted = self.spark.createDataFrame([(i, w) for i, w in enumerate(dict.fromkeys(words))], "i int, word string")
        found = expand(wanted, self.bilingual).groupBy("i", "word", "lang").agg(F.array_sort(F.collect_list(F.struct("ord", "synonym"))).alias("s"))
        return [(r["word"], r["lang"], [x["synonym"] for x in r["s"]]) for r in found.orderBy("i").collect()]  # the words of one query

    def cross_language(self, query: str, mode: str = "tf") -> tuple[DataFrame | None, dict]:
        """Any of the query's terms or of their translations; without translations there is no result."""
        pairs = self.terms(query)[0]
        words = list(dict.fromkeys(w for w, _ in pairs))
        whole = re.findall("[一-鿿]+", query)  # a Chinese run may be an entry of its own, however it is cut
        grams = [" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)]
        found = self.translations(list(dict.fromkeys(words + whole)) + grams)
        if not found:
            return None, {}
        terms = [t for _, t in pairs] + [t for own in self.terms(*(s for _, _, syn in found for s in syn)) for _, t in own]
        return self.union(terms, mode), {w: syn for w, _, syn in found}

    # the one entry

    def search(self, query: str, mode: str = "tf", cross: bool = False, top_k: int | None = TOP_K) -> SearchResult:
        mode = mode if mode in ("tf", "tfidf") else "tf"
        if not query.strip():
            return SearchResult(query, "empty", mode, None, None, error="empty query")
        trace: dict = {}
        if is_boolean(query):
            try:
                hits, kind = self.boolean(query, mode), "boolean"
                trace["ast"] = str(parse(query))
            except QuerySyntaxError as e:
                return SearchResult(query, "boolean", mode, None, None, error=str(e))
        else:
            hits, kind = None, "keywords"
            lang = self.spark.createDataFrame([(query,)], "q string").select(detect_language(F.col("q"))).first()[0]
            if self.bilingual is not None and (cross or lang in ("zh", "mixed")):
                hits, trace["translations"] = self.cross_language(query, mode)
                kind = "cross" if trace["translations"] else kind
            if kind == "cross":
                words = [query, *(s for syn in trace["translations"].values() for s in syn)]
                trace |= self.trace_of(dict.fromkeys(t for own in self.terms(*words) for _, t in own))
                trace["strategy"] = "union of the terms and their translations: any of them makes a hit"
            else:
                hits = self.keywords(query, mode)
                trace |= self.trace_of(dict.fromkeys(t for _, t in self.terms(query)[0]))
                trace["strategy"] = "intersection in ascending order of document frequency: " + " -> ".join(str(trace["df"][t]) for t in trace["merge_order"])
        ranked = self.shown(self.ranked(hits, top_k)) if hits is not None else None
        return SearchResult(query, kind, mode, hits, ranked, trace)

    def trace_of(self, terms: Iterable[str]) -> dict:
        """df and usual spelling of each term of a query, and the order in which the terms' lists are merged."""
        terms = list(terms)
        if not terms:
            return {"df": {}, "display": {}, "merge_order": []}
        wanted = F.col("term").isin(*terms)
        df = {t: 0 for t in terms} | {r["term"]: r["df"] for r in self.index.postings.where(wanted).groupBy("term").agg(F.count("*").alias("df")).collect()}  # the terms of one query
        display = {t: t for t in terms} | {r["term"]: r["display"] for r in displays(self.index.spellings.where(wanted)).collect()}
        return {"df": df, "display": display, "merge_order": sorted(terms, key=lambda t: (df[t], t))}


def _compiled(node: Node, has: dict[str, Column]) -> Column:
    match node:
        case Word(text):
            return has[text]
        case Not(inner):
            return ~_compiled(inner, has)
        case And(left, right):
            return _compiled(left, has) & _compiled(right, has)
        case Or(left, right):
            return _compiled(left, has) | _compiled(right, has)
    raise TypeError(node)


def expand(words: DataFrame, bilingual: DataFrame) -> DataFrame:
    """The words' columns with (lang, synonym, ord): translations in both directions. bilingual: (en, zh, ord)."""
    d = bilingual.select(F.lower(F.trim("en")).alias("en"), F.trim("zh").alias("zh"), "ord").where("en != '' and zh != ''")
    both = d.select(F.col("en").alias("k"), F.lit("zh").alias("lang"), F.col("zh").alias("synonym"), "ord").unionByName(
        d.select(F.col("zh").alias("k"), F.lit("en").alias("lang"), F.col("en").alias("synonym"), "ord")
    )
    key = F.when(F.col("word").rlike(r"[\x{4e00}-\x{9fff}]"), F.trim("word")).otherwise(F.lower(F.trim("word")))
    return words.withColumn("k", key).join(both, "k").drop("k")


def query_batch(postings: DataFrame, queries: DataFrame, total: int) -> DataFrame:
    """(query_id, paper_id, score) for many keyword queries at once. queries: (query_id, term), each term once a query."""
    asked = queries.select("term").distinct()
    df = postings.join(asked, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    size = queries.groupBy("query_id").agg(F.count("*").alias("terms"))
    rows = postings.select("term", "paper_id", "tf").join(queries, "term").join(df, "term")
    g = rows.groupBy("query_id", "paper_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("tf") * idf(F.col("df"), total)), 4).alias("score"))
    return g.join(size, "query_id").where("n = terms").select("query_id", "paper_id", "score")
