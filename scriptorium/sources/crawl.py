"""Catalogue connectors as Spark data sources: one partition for each topic, so topics are fetched in parallel.

A fetcher is a function of (topic, limit) that returns raw records. ``preprint_fetcher`` and ``work_fetcher`` make them
from a function that gets an address, by default over the network; tests and offline runs hand in recorded answers.
Registered names: "preprints" and "works".
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urlencode
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scriptorium.functions.text import preprint_id, rebuilt_abstract

# Categories and topics that are fetched.
CATEGORIES = ("cs.AI", "cs.LG", "cs.CV", "cs.CL", "cs.NE")
MIN_PAPERS = 150

Fetcher = Callable[[str, int], list[dict]]
Getter = Callable[[str], bytes]
# Addresses of the catalogues' interfaces, their name spaces, and records of a page.
FEED, WORKS = "https://export.arxiv.org/api/query", "https://api.openalex.org/works"
ATOM = "{http://www.w3.org/2005/Atom}"
PAGE_SIZE = 50
WORK_FIELDS = "id,doi,title,authorships,publication_year,abstract_inverted_index,language"
SCHEMA = "topic string, ord long, id string, title string, abstract string, inverted map<string,array<int>>, authors array<string>, year int, language string, doi string"


def over_network(url: str) -> bytes:
    with urllib.request.urlopen(url, timeout=20) as answer:  # noqa: S310 - addresses of the catalogues only
        return answer.read()


def feed_records(feed: bytes) -> list[dict]:
    """Raw records of an Atom feed."""
    out = []
    for e in ElementTree.fromstring(feed).iter(f"{ATOM}entry"):
        said = lambda tag, e=e: (e.findtext(f"{ATOM}{tag}") or "").strip()
        published = said("published")[:4]
        names = [(a.findtext(f"{ATOM}name") or "").strip() for a in e.iter(f"{ATOM}author")]
        out.append({"id": said("id"), "title": said("title"), "abstract": said("summary"), "authors": [n for n in names if n], "year": int(published) if published.isdigit() else None})
    return out


def work_records(answer: bytes) -> list[dict]:
    """Raw records of a page of works; abstracts stay inverted."""
    out = []
    for w in json.loads(answer).get("results") or []:
        names = [(a.get("author") or {}).get("display_name") for a in w.get("authorships") or []]
        row = {"id": w.get("id"), "title": w.get("title"), "inverted": w.get("abstract_inverted_index"), "authors": [n for n in names if n], "year": w.get("publication_year"), "language": w.get("language"), "doi": w.get("doi")}
        out.append(row)
    return out


def preprint_fetcher(get: Getter = over_network) -> Fetcher:
    """Topics are categories such as cs.CL, or words; newest first, or most relevant first."""

    def fetch_topic(topic: str, limit: int) -> list[dict]:
        category = topic in CATEGORIES
        asked = {"search_query": f"cat:{topic}" if category else f'all:"{topic}"', "start": 0, "max_results": limit, "sortBy": "submittedDate" if category else "relevance"}
        return feed_records(get(f"{FEED}?{urlencode(asked)}"))

    return fetch_topic


def work_fetcher(get: Getter = over_network, pages: int = 2) -> Fetcher:
    """Topics are words; pages are read until one is not full. Chinese topics ask for Chinese works."""

    def fetch_topic(topic: str, limit: int) -> list[dict]:
        out: list[dict] = []
        size = min(limit, PAGE_SIZE)
        for page in range(1, pages + 1):
            asked = {"search": topic, "per-page": size, "page": page, "select": WORK_FIELDS}
            if any("一" <= c <= "鿿" for c in topic):
                asked["filter"] = "language:zh"
            found = work_records(get(f"{WORKS}?{urlencode(asked)}"))
            out += found
            if len(found) < size or len(out) >= limit:
                break
        return out

    return fetch_topic


def lookup(spark: SparkSession, url_or_id: str, get: Getter = over_network) -> DataFrame:
    """The preprint of an address or number in the corpus' form: one row, or none if there is no such preprint."""
    wanted = spark.createDataFrame([((url_or_id or "").strip(),)], "u string").select(preprint_id(F.col("u"))).first()[0]
    try:
        found = feed_records(get(f"{FEED}?{urlencode({'id_list': wanted})}"))[:1] if wanted else []
    except (OSError, ElementTree.ParseError):
        found = []
    rows = [("", 0, r["id"], r["title"], r["abstract"], None, r["authors"], r["year"], None, None) for r in found if r["title"]]
    return preprints(spark.createDataFrame(rows, SCHEMA)).withColumns({"source_id": F.lit(wanted), "source": F.lit("url")})


def topic_source(short_name: str, fetch: Fetcher, topics: tuple[str, ...]) -> type[DataSource]:
    """A data source class over a fetcher, to be registered with ``spark.dataSource.register``."""

    class Topic(InputPartition):
        def __init__(self, number: int, topic: str) -> None:
            self.number, self.topic = number, topic

    class Reader(DataSourceReader):
        def __init__(self, limit: int) -> None:
            self.limit = limit

        def partitions(self) -> list:
            return [Topic(i, t) for i, t in enumerate(topics)]

        def read(self, partition) -> Iterator[tuple]:
            try:
                found = fetch(partition.topic, self.limit)
            except Exception:  # noqa: BLE001 - one topic that fails doesn't end the crawl
                found = []
            for k, r in enumerate(found[: self.limit]):
                yield (
                    partition.topic,
                    partition.number * 1_000_000 + k,
                    *(r.get(n) for n in ("id", "title", "abstract", "inverted", "authors", "year", "language", "doi")),
                )

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return short_name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader(int(self.options.get("limit", "50")))

    return Source


def _first_by_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("source_id").orderBy("ord"))).where("r = 1").drop("r")


def preprints(raw: DataFrame) -> DataFrame:
    """Records in the corpus' form: ids without versions, line breaks as spaces, the first of equal ids."""
    line = lambda c: F.trim(F.translate(c, "\n", " "))
    rows = raw.select("ord", preprint_id(F.col("id")).alias("source_id"), line("title").alias("title"), line("abstract").alias("abstract"), "authors", "year", F.lit("en").alias("language"), F.lit("arxiv").alias("source"))
    return _first_by_id(rows)


def works(raw: DataFrame) -> DataFrame:
    """Records of a catalogue of works: abstracts rebuilt from their inverted form, at most ten authors, no empty titles."""
    rows = raw.where("trim(title) != ''").select(
        "ord",
        F.substring_index(F.coalesce(F.nullif("doi", F.lit("")), "id"), "/", -1).alias("source_id"),
        F.trim("title").alias("title"),
        F.coalesce("abstract", rebuilt_abstract(F.col("inverted")), F.lit("")).alias("abstract"),
        F.slice(F.coalesce("authors", F.array().cast("array<string>")), 1, 10).alias("authors"),
        "year",
        "language",
        F.lit("openalex").alias("source"),
    )
    return _first_by_id(rows)


NORMALISERS = {"preprints": preprints, "works": works}


def fetch(spark: SparkSession, source: str, limit: int = 50) -> DataFrame:
    """The records of a registered source in the corpus' form."""
    if source not in NORMALISERS:
        raise ValueError(f"unknown source {source!r}")
    return NORMALISERS[source](spark.read.format(source).option("limit", limit).load())


def ensure_papers(papers: DataFrame, fetch_more: Callable[[], DataFrame], least: int = MIN_PAPERS) -> DataFrame:
    """The corpus itself if it has enough records, else merged with fetched ones."""
    from scriptorium.operators.records import merge_by_id

    return papers if papers.limit(least).count() >= least else merge_by_id(papers, fetch_more())
