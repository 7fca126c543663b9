"""Operators on records: mapping raw rows, ids, merging sources, strict duplicates, removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.cjk import nfkc, nfkc_each
from scriptorium.functions.text import content_key, strip, text_or_empty
from scriptorium.shared import in_order, settled


def author_list(joined: Column) -> Column:
    """Names of a string joined by commas."""
    return F.filter(F.transform(F.split(joined, ","), lambda n: strip(n)), lambda n: n != "")


def mapped(raw: DataFrame) -> DataFrame:
    """Raw rows in the corpus' form: an id that is no integer becomes the source_id; tags stand in for missing keywords."""
    has = set(raw.columns)
    col = lambda n, t="string": F.col(n) if n in has else F.lit(None).cast(t)
    given = F.coalesce(col("id").cast("string"), col("paper_id").cast("string"))
    number = F.expr("try_cast(x as bigint)")
    kinds = dict(raw.dtypes)
    authors = author_list(F.col("authors")) if kinds.get("authors") == "string" else col("authors", "array<string>")
    empty = F.array().cast("array<string>")
    out = raw.withColumn("x", given).select(
        number.alias("paper_id"),
        F.coalesce(F.nullif(col("source_id"), F.lit("")), F.col("x")).alias("source_id"),
        strip(text_or_empty(col("title"))).alias("title"),
        strip(text_or_empty(col("abstract"))).alias("abstract"),
        F.coalesce(authors, empty).alias("authors"),
        F.coalesce(col("keywords", "array<string>"), col("tags", "array<string>"), empty).alias("keywords"),
        F.expr("try_cast(year as int)").alias("year") if "year" in has else F.lit(None).cast("int").alias("year"),
        *[col(c).alias(c) for c in ("language", "source", "file_name", "file_store")],
        *([F.col("ord")] if "ord" in has else []),
    )
    return out


def numbered(rows: DataFrame) -> DataFrame:
    """Every row an id of its own: the first holder (by ord) keeps its id, the others fill the smallest free ids in order.

    rows: (paper_id, ord, ...). The free ids are matched to the rows without one by number, so nothing runs in sequence
    but the numbering of those rows.
    """
    first = F.row_number().over(Window.partitionBy("paper_id").orderBy("ord"))
    none = rows.where("paper_id is null")  # apart, since any number of them would be one group
    marked = rows.where("paper_id is not null").withColumn("keeps", first == 1)
    kept, rest = marked.where("keeps").drop("keeps"), marked.where("not keeps").drop("keeps").unionByName(none)
    waiting = in_order(rest, "ord")
    n = rest.count()
    if not n:
        return kept
    used = kept.select("paper_id")
    # among the first (rows kept + rows waiting) ids enough are free
    top = kept.count() + n
    ids = rows.sparkSession.range(0, top).select(F.col("id").alias("paper_id")).join(used, "paper_id", "left_anti")
    free = in_order(ids, "paper_id").where(F.col("n") <= n)
    return kept.unionByName(waiting.drop("paper_id").join(free, "n").drop("n").select(rows.columns))


def key_of(row_year: str = "year") -> Column:
    """The digest that two records share only if their contents are the same, compatibility forms counting as equal."""
    return content_key(nfkc(F.col("title")), nfkc(F.col("abstract")), nfkc_each(F.col("authors")), F.col(row_year))


def merge_by_id(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows with an id, of equal ids the last; new rows whose id is absent, of equal ids the first. (source_id, ord, ...)"""
    old = old.where("source_id is not null and source_id != ''")
    rank_old = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("ord")))
    rank_new = F.row_number().over(Window.partitionBy("source_id").orderBy("ord"))
    kept = old.withColumn("r", rank_old).where("r = 1").drop("r")
    fresh = new.withColumn("r", rank_new).where("r = 1").drop("r").join(kept.select("source_id"), "source_id", "left_anti")
    return kept.unionByName(fresh)


def first_by_key(papers: DataFrame, order: str = "paper_id") -> DataFrame:
    """(content_key, paper_id): the first record of each content."""
    return papers.groupBy(key_of().alias("content_key")).agg(F.min_by("paper_id", order).alias("paper_id"))


def merge_strict(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of new that are accepted one after the other, by ord: those whose content and source_id neither old nor an accepted row has.

    Rows that clash with none are accepted at once. Of the others, in each round those are accepted that come first by
    their content and by their source_id, and those are dropped that clash with them; so a row that only clashes with a
    dropped one stays. Rows that agree in both are one row to the rounds, the first; a third of all rows sharing a
    content are aggregated before they are joined. ord is unique; nulls and empty source_ids clash with nothing.
    """
    sid = F.nullif(F.col("source_id"), F.lit(""))
    keyed = new.withColumn("_k", key_of()).withColumn("_s", sid)
    keyed = keyed.join(old.select(key_of().alias("_k")).distinct(), "_k", "left_anti")
    keyed = keyed.join(old.select(sid.alias("_s")).where("_s is not null").distinct(), "_s", "left_anti")
    todo = settled(keyed.groupBy("_k", "_s").agg(F.min("ord").alias("ord")))
    taken: DataFrame | None = None
    while True:
        by_k, by_s = todo.groupBy("_k").agg(F.min("ord").alias("first_k")), todo.where("_s is not null").groupBy("_s").agg(F.min("ord").alias("first_s"))
        marked = todo.join(by_k, "_k").join(by_s, "_s", "left")
        won = settled(marked.where("ord = first_k and (first_s is null or ord = first_s)").select("_k", "_s", "ord"))
        taken = won if taken is None else taken.unionByName(won)
        rest = todo.join(won.select("_k"), "_k", "left_anti").join(won.where("_s is not null").select("_s"), "_s", "left_anti")
        todo = settled(rest)
        if todo.isEmpty():
            break
    return keyed.join(taken.select("ord"), "ord", "left_semi").select(new.columns)


def merge_report(fetched: DataFrame, added: DataFrame) -> DataFrame:
    n = fetched.agg(F.count("*").alias("fetched")).crossJoin(added.agg(F.count("*").alias("added")))  # one row each
    return n.select("added", (F.col("fetched") - F.col("added")).alias("skipped"))


def library(papers: DataFrame, query: str = "") -> DataFrame:
    """Records whose title, abstract or any author holds the text, in any case."""
    q = query.strip().lower()
    if not q:
        return papers
    held = F.exists(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.coalesce(F.lower(a).contains(q), F.lit(False)))
    return papers.where(F.coalesce(F.lower("title").contains(q), F.lit(False)) | F.coalesce(F.lower("abstract").contains(q), F.lit(False)) | held)


def paper(papers: DataFrame, paper_id: int) -> DataFrame:
    """The record of an id."""
    return papers.where(F.col("paper_id") == paper_id)


def stored_name(paper_id: Column, content: Column, name: Column) -> Column:
    """The name under which a file is kept: id, eight digits of its digest, its extension."""
    ext = F.regexp_extract(name, r"(\.[^./\\]+)$", 1)
    return F.concat(paper_id.cast("string"), F.lit("_"), F.left(F.sha2(content, 256), F.lit(8)), F.when(ext == "", ".bin").otherwise(ext))
