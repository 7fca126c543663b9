import io
import zipfile

import pytest
from pyspark.sql import functions as F

from scriptorium.engine import Library
from scriptorium.operators import index as I
from scriptorium.plans.search import Searcher
from scriptorium.sources import crawl
from scriptorium.sources.archive import FileArchive

ROWS = [
    (0, "Attention based transformers", "Transformers use attention over sequences.", [], 2019),
    (1, "Graph neural networks", "A graph network for a neural graph survey.", [], 2020),
    (2, "卷积神经网络综述", "卷积 神经网络 survey of attention", [], 2021),
]
SCHEMA = "paper_id long, title string, abstract string, keywords array<string>, year int"


@pytest.fixture(scope="module")
def search(spark):
    papers = spark.createDataFrame(ROWS, SCHEMA)
    bilingual = spark.createDataFrame([("graph", "图", 0), ("convolution", "卷积", 1), ("attention", "注意力", 2)], "en string, zh string, ord int")
    return Searcher(I.build(papers, {"the", "a", "of", "for"}), {"the", "a", "of", "for"}, bilingual=bilingual)


def ids(hits):
    return sorted(r["paper_id"] for r in hits.collect()) if hits is not None else []


def test_boolean(search):
    assert ids(search.boolean("graph AND (neural OR network)")) == [1]
    assert ids(search.boolean("attention NOT survey")) == [0]
    assert ids(search.boolean("transformers AND attention")) == [0]
    assert ids(search.boolean("NOT attention")) == [1]
    assert ids(search.boolean("NOT the")) == [0, 1, 2]


def test_phrase(search):
    assert ids(search.boolean('"graph neural"')) == [1]
    assert ids(search.boolean('"neural graph"')) == [1]
    assert ids(search.boolean('"network graph survey"')) == []


def test_keywords_and_scores(search):
    assert ids(search.keywords("graph networks")) == [1]
    assert ids(search.keywords("graph nosuch")) == []
    assert search.keywords("the") is None
    tf = {r["paper_id"]: r["score"] for r in search.keywords("graph").collect()}
    assert tf == {1: 3.0}


def test_same_stem_leaves_both_score(search):
    hits = search.boolean("transformer OR transformers")
    assert hits.first()["score"] == 4.0


def test_laws(search):
    assert ids(search.boolean("NOT (graph OR attention)")) == ids(search.boolean("(NOT graph) AND (NOT attention)"))
    assert set(ids(search.boolean("graph AND neural"))) <= set(ids(search.boolean("graph OR neural")))
    assert set(ids(search.boolean('"graph neural"'))) <= set(ids(search.boolean("graph AND neural")))


def test_search_routes_ranks_and_reports(search):
    r = search.search("graph neural", "tfidf")
    assert r.query_type == "keywords" and r.count() == 1 and r.trace["merge_order"]
    assert r.ranked.first()["matched_terms"][0]["display"] == "graph"
    assert search.search("  ").error and search.search("a and").error
    assert search.search("卷积").query_type in ("cross", "keywords")


def test_index_invariants(search):
    i = search.index
    s = I.stats(i, 4).first()
    assert s["total_papers"] == 3
    assert I.document_frequency(i.postings).agg({"df": "sum"}).first()[0] == s["total_postings"]
    assert [r["word"] for r in I.suggest(i, "trans").collect()] == ["transformers"]
    assert I.suggest(i, "ansform").first()["word"] == "transform"


def test_append_equals_rebuild_and_remove_undoes(spark, search):
    papers = spark.createDataFrame(ROWS, SCHEMA)
    sw = {"the", "a", "of", "for"}
    grown = I.append(I.build(papers.where("paper_id < 2"), sw), papers, sw)
    key = lambda i: sorted((r["term"], r["paper_id"], r["tf"], r["positions"]) for r in i.postings.collect())
    assert key(grown) == key(search.index)
    freq = lambda i: sorted((r["term"], r["orig"], r["freq"]) for r in i.spellings.collect())
    assert freq(grown) == freq(search.index)
    less = I.remove(grown, spark.createDataFrame([(2,)], "paper_id long"), sw)
    assert key(less) == key(I.build(papers.where("paper_id < 2"), sw))
    assert freq(less) == freq(I.build(papers.where("paper_id < 2"), sw))


def test_written_index_reads_back(spark, search, tmp_path):
    search.index.write(str(tmp_path))
    again = I.Index.read(spark, str(tmp_path))
    assert again.postings.count() == search.index.postings.count()


def test_library_facade(spark):
    full = [(0, "Attention", "Attention is used.", ["A. B"], [], 2017, "en", "s0", "manual", None, None)]
    schema = "paper_id long, title string, abstract string, authors array<string>, keywords array<string>, year int, language string, source_id string, source string, file_name string, file_store string"
    lib = Library(spark.createDataFrame(full, schema), {"is"})
    new = spark.createDataFrame(
        [("Graph databases", "On graph stores.", ["C"], [], 2020, "en", "s1", "manual", None, None, 0), ("attention!", "attention is used", ["a b"], [], 2017, "en", None, "manual", None, None, 1)],
        schema.split(", ", 1)[1] + ", ord long",
    )
    grown = lib.add(new)
    assert grown.index.papers.count() == 2
    assert grown.search("graph").count() == 1
    assert grown.remove(1).search("graph").count() == 0
    assert grown.papers("databases").count() == 1 and grown.paper(0).count() == 1
    assert grown.meta().first()["papers"] == 2 and grown.terms("graph").count() == 1
    files = spark.createDataFrame([("n.txt", "A study of trees\nAnn Lee, Bo Wu\nAbstract: We grow trees in 2021.\n".encode())], "name string, content binary")
    with_file, parsed = grown.add_files(files)
    assert parsed.first()["title"] == "A study of trees" and with_file.search("trees").count() == 1
    meta = with_file.meta().first()
    assert meta["total_papers"] == 3 and meta["total_postings"] > 0 and not meta["refiner"]


FULL = "paper_id long, title string, abstract string, authors array<string>, keywords array<string>, year int, language string, source_id string, source string, file_name string, file_store string"


def small_library(spark):
    return Library(spark.createDataFrame([(0, "Attention", "Attention is used.", ["A. B"], [], 2017, "en", "s0", "manual", None, None)], FULL), {"is"})


def test_files_are_reported_and_archived(spark, tmp_path):
    one, two = (f"A study of {x}\nAnn Lee, Bo Wu\nAbstract: We grow {x} in 2021.\n".encode() for x in ("trees", "bushes"))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for n, c in (("x/n.txt", one), ("y/n.txt", two), ("again.txt", one), ("empty.txt", b"")):
            z.writestr(n, c)
    contents = spark.createDataFrame([("all.zip", packed.getvalue()), ("bad.zip", b"no"), ("z.doc", b"?")], "name string, content binary")
    kept = FileArchive(spark, str(tmp_path / "files"))
    lib, report = small_library(spark).add_files(contents, archive=kept)
    got = sorted((r["name"], r["outcome"], r["paper_id"]) for r in report.collect())
    ids = {n: p for n, o, p in got if o == "added"}
    assert [(n, o) for n, o, _ in got] == [("again.txt", "duplicated"), ("bad.zip", "failed"), ("empty.txt", "added"), ("n.txt", "added"), ("n.txt", "added"), ("z.doc", "failed")]
    held = {bytes(r["content"]): r["file_name"] for i in (1, 2, 3) for r in lib.file(i, kept).collect()}
    assert held == {one: "n.txt", two: "n.txt", b"": "empty.txt"} and ids["empty.txt"] in (1, 2, 3)
    assert lib.file(0, kept).count() == 0
    trees = lib.search("trees").hits.first()["paper_id"]
    assert lib.remove(trees, archive=kept).search("trees").count() == 0 and lib.file(trees, kept).count() == 0


def test_refiner_in_the_ingest_path(spark):
    answer = F.lit('{"title": "A refined title", "keywords": ["shrubs"]}')
    contents = spark.createDataFrame([("n.txt", b"1 Introduction\nlower case text\n")], "name string, content binary")
    lib, report = small_library(spark).add_files(contents, refine=lambda text: F.when(text.isNotNull(), answer))
    assert report.first()["title"] == "A refined title" and report.first()["ai_used"]
    assert lib.papers("refined").first()["keywords"] == ["shrubs"]


def test_crawl_of_several_sources_and_url(spark):
    feed = b'<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/1706.03762v5</id><published>2017</published><title>Shrubs</title><summary>On shrubs.</summary></entry></feed>'
    rows = [{"id": "http://arxiv.org/abs/1801.00001", "title": "Hedges", "abstract": "On hedges.", "authors": [], "year": 2018}]
    spark.dataSource.register(crawl.topic_source("preprints", lambda t, n: rows, ("a",)))
    spark.dataSource.register(crawl.topic_source("works", lambda t, n: [{"id": "W1", "title": "Hedges", "abstract": "On hedges.", "authors": [], "year": 2018}, {"id": "W2", "title": "Lawns"}], ("a",)))
    told = []
    lib, status = small_library(spark).crawl("preprints", "works", progress=told.append)
    assert (status["added"], status["skipped"], status["total"], status["running"]) == (2, 1, 3, False)
    assert told[0]["running"] and [t["added"] for t in told] == [0, 1, 2, 2]
    assert lib.add_url("1706.03762", lambda url: feed).search("shrubs").count() == 1
    with pytest.raises(ValueError):
        lib.add_url("1706.03762", lambda url: b"<feed xmlns='http://www.w3.org/2005/Atom'/>")
    with pytest.raises(ValueError):
        lib.crawl("nowhere")
