"""The library as one object: search, browse, add, remove, ingest. Every answer is a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import pairs_of_characters
from scriptorium.log import logger
from scriptorium.operators import index as I
from scriptorium.operators import records as R
from scriptorium.operators.keywords import keyword_lists, ranked_keywords, with_final_keywords
from scriptorium.plans.search import Searcher, SearchResult
from scriptorium.shared import settled
from scriptorium.sources import crawl, files, pdf
from scriptorium.sources.archive import FileArchive
from scriptorium.streaming.ingest import accepted


class Library:
    """papers: (paper_id, title, abstract, authors, keywords, year, language, source_id, source, file_name, file_store)."""

    def __init__(
        self,
        papers: DataFrame,
        stopwords: set[str],
        bilingual: DataFrame | None = None,
        segment: Callable = pairs_of_characters,
        index: I.Index | None = None,
        keywords: bool = True,
        preserve_explicit: bool = False,
    ) -> None:
        self.stopwords, self.bilingual, self.segment = stopwords, bilingual, segment
        if index is None:
            index = with_final_keywords(papers, stopwords, preserve_explicit, segment) if keywords else I.build(papers, stopwords, segment)
        # later calls build on these tables, so their lineage ends here
        self.index = I.Index(*(settled(t) for t in (index.papers, index.postings, index.spellings)))

    @property
    def spark(self) -> SparkSession:
        return self.index.papers.sparkSession

    def _with(self, index: I.Index) -> Library:
        return Library(index.papers, self.stopwords, self.bilingual, self.segment, index)

    # reading

    def search(self, query: str, mode: str = "tf", top_k: int | None = 50, cross: bool = False) -> SearchResult:
        return Searcher(self.index, self.stopwords, self.segment, self.bilingual).search(query, mode, cross, top_k)

    def suggest(self, prefix: str, k: int = 10) -> DataFrame:
        return I.suggest(self.index, prefix, k)

    def index_snapshot(self, limit: int = 20) -> DataFrame:
        return I.snapshot(self.index, min(max(limit, 1), 200))

    def stats(self) -> DataFrame:
        return I.stats(self.index, len(self.stopwords))

    def meta(self, refiner: bool = False) -> DataFrame:
        """(language, papers) with the totals of the library in each row, and whether a refiner is set up."""
        totals = I.stats(self.index, len(self.stopwords)).drop("stopwords_count")
        return I.language_histogram(self.index.papers).crossJoin(F.broadcast(totals)).withColumn("refiner", F.lit(refiner))  # one row

    def terms(self, part: str = "", page: int = 1, size: int = 100) -> DataFrame:
        return I.page(I.filter_terms(I.term_rows(self.index), part), page, min(max(size, 1), 500), *I.by_frequency())

    def papers(self, query: str = "", page: int = 1, size: int = 20) -> DataFrame:
        return I.page(R.library(self.index.papers, query), page, min(max(size, 1), 100), "paper_id")

    def paper(self, paper_id: int) -> DataFrame:
        return R.paper(self.index.papers, paper_id)

    # writing: each gives a new library

    def add(self, records: DataFrame) -> Library:
        """Appends the records (title, abstract, authors, year, source_id, keywords, ord) that the library doesn't have.

        Explicit keywords stay; others are extracted with the frequencies from before the records came.
        """
        return self._added(records)[0]

    def _added(self, records: DataFrame, archive: FileArchive | None = None) -> tuple[Library, DataFrame]:
        """The library with the records, and (ord, paper_id) of those that were accepted. With an archive, content is stored."""
        fresh = accepted(self.index.papers, records.where("title is not null and trim(title) != ''"))
        if archive is not None:
            name = R.stored_name(F.col("paper_id"), F.col("content"), F.coalesce("file_name", F.lit("")))
            fresh = fresh.withColumn("file_store", F.when(F.col("content").isNotNull(), name))
        fresh = settled(fresh)
        if archive is not None:
            archive.store(fresh.where("content is not null").select("file_store", "file_name", "content"))
        taken = fresh.select("ord", "paper_id")
        df = I.document_frequency(self.index.postings)
        found = keyword_lists(ranked_keywords(fresh, df, self.index.papers.count(), self.stopwords, segment=self.segment)).withColumnRenamed("keywords", "found")
        empty = F.array().cast("array<string>")
        fresh = fresh.join(found, "paper_id", "left").withColumn("keywords", F.when(F.size("keywords") > 0, F.col("keywords")).otherwise(F.coalesce("found", empty))).drop("found", "ord", "content")
        return self._with(I.append(self.index, settled(fresh), self.stopwords, self.segment)), taken

    def remove(self, *ids: int, archive: FileArchive | None = None) -> Library:
        """The library without these papers; with an archive, their files are no longer found."""
        gone = self.spark.createDataFrame([(i,) for i in ids], "paper_id long")
        if archive is not None:
            archive.remove(self.index.papers.join(gone, "paper_id", "left_semi"))
        return self._with(I.remove(self.index, gone, self.stopwords, self.segment))

    def file(self, paper_id: int, archive: FileArchive) -> DataFrame:
        """(paper_id, file_name, content) of a paper's file; empty if it has none in the archive."""
        return archive.resolve(self.paper(paper_id))

    def add_url(self, url: str, get: crawl.Getter = crawl.over_network) -> Library:
        """Adds the preprint of an address or number; an error if there is none."""
        found = settled(crawl.lookup(self.spark, url, get))
        if found.isEmpty():
            raise ValueError(f"no preprint found for {url!r}")
        return self.add(_as_records(found))

    def add_files(
        self, contents: DataFrame, extract_pdf: files.Extractor = pdf.extract, refine: Callable | None = None, refine_all: bool = False, archive: FileArchive | None = None
    ) -> tuple[Library, DataFrame]:
        """Parses files (name, content), those of ZIP archives too, and adds them.

        Also gives a report of every file: (archive, name, outcome, paper_id, title, authors, abstract, year, confidence, ai_used,
        no_text, error), the outcome being added, duplicated (paper_id is the one that has its content) or failed: an archive that
        was refused, a format that can't be read.
        """
        zipped = F.lower("name").endswith(".zip")
        none = F.lit(None).cast("string")
        plain = contents.where(~zipped).select(none.alias("archive"), "name", "content", none.alias("refused"))
        entries = plain.unionByName(files.zip_entries(contents.where(zipped)).select("archive", F.coalesce("name", "archive").alias("name"), "content", F.col("error").alias("refused")))
        entries = settled(entries.withColumn("ord", F.monotonically_increasing_id()))
        # names may repeat, so a file goes by its number while it is parsed
        numbered = entries.where("refused is null").select(F.concat_ws("/", F.col("ord").cast("string"), F.substring_index("name", "/", -1)).alias("name"), "content")
        done = files.parse_files(numbered, extract_pdf, refine, refine_all)
        done = settled(done.withColumn("ord", F.substring_index("name", "/", 1).cast("long")).drop("name"))
        done = done.join(entries, "ord")
        placed = F.lower("name").rlike("(" + "|".join(x.replace(".", r"\.") for x in (".pdf", *files.TEXT_SUFFIXES)) + ")$")
        rows = done.where(placed).select(
            "title", "abstract", "authors", "year", none.alias("source_id"), F.coalesce("agent_keywords", F.array().cast("array<string>")).alias("keywords"), none.alias("language"),
            F.lit("upload").alias("source"), F.col("name").alias("file_name"), none.alias("file_store"), "ord", "content",
        )
        library, taken = self._added(rows, archive)
        keys = R.first_by_key(library.index.papers).withColumnRenamed("paper_id", "holder")
        known = settled(rows.select("ord", R.key_of().alias("content_key"))).join(keys, "content_key").select("ord", "holder")
        report = entries.select("ord", "archive", "name", "refused").join(done.drop("archive", "name", "content", "refused", "text", "charset", "agent_keywords"), "ord", "left")
        report = report.join(taken, "ord", "left").join(known, "ord", "left")
        outcome = F.when(F.col("paper_id").isNotNull(), "added").when(F.col("holder").isNotNull(), "duplicated").otherwise("failed")
        return library, report.select(
            "archive", "name", outcome.alias("outcome"), F.coalesce("paper_id", "holder").alias("paper_id"), "title", "authors", "abstract", "year", "confidence", "ai_used", "no_text",
            F.coalesce("refused", "error").alias("error"),
        )

    def ingest_source(self, source: str, limit: int = 600) -> Library:
        """Fetches a registered catalogue source and adds what is new."""
        return self.add(_as_records(crawl.fetch(self.spark, source, limit)))

    def crawl(self, *sources: str, limit: int = 600, progress: Callable[[dict], None] | None = None) -> tuple[Library, dict]:
        """Fetches registered sources one after the other and adds what is new; also gives the status that progress was told step by step."""
        status: dict = {"running": True, "source": "+".join(sources), "total": 0, "added": 0, "skipped": 0, "message": "started"}
        tell = progress or (lambda _: None)
        tell(dict(status))
        library = self
        try:
            for source in sources:
                rows = settled(_as_records(crawl.fetch(self.spark, source, limit)))
                fetched = rows.count()
                library, taken = library._added(rows)
                added = taken.count()
                status |= {"total": status["total"] + fetched, "added": status["added"] + added, "skipped": status["skipped"] + fetched - added, "message": f"{source} done"}
                tell(dict(status))
            status |= {"message": f"added {status['added']}, skipped {status['skipped']}"}
        except Exception:
            logger().exception("crawl failed: %s", status["source"])
            status |= {"message": "failed, see the log"}
            raise
        finally:
            status["running"] = False
            tell(dict(status))
        return library, status


def _as_records(rows: DataFrame) -> DataFrame:
    """Fetched rows with the columns that only uploads have, empty."""
    none = F.lit(None).cast("string")
    return rows.withColumns({"keywords": F.array().cast("array<string>"), "file_name": none, "file_store": none})
