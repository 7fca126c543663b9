import io
import json
import json
import zipfile
import zlib

import pytest

from scriptorium.sources import crawl, files, pdf
from scriptorium.sources.corpus import read_bilingual, read_json, read_stopwords, read_version, write_version


def test_json_corpus(spark, tmp_path):
    p = tmp_path / "papers.json"
    p.write_text(json.dumps([{"id": 1, "title": "T", "authors": ["a", "b"]}, {"id": "x", "title": "U", "authors": "c, d"}]))
    assert sorted(r["authors"] for r in read_json(spark, str(p)).collect()) == [["a", "b"], ["c", "d"]]
    assert read_json(spark, str(tmp_path / "none.json")).count() == 0


def test_small_sources(spark, tmp_path):
    (tmp_path / "s.txt").write_text("The\n# note\n\nthe\n的\n")
    assert read_stopwords(spark, str(tmp_path / "s.txt")) == {"the", "的"}
    assert read_stopwords(spark, str(tmp_path / "no.txt")) == set()
    (tmp_path / "b.json").write_text(json.dumps({"pairs": [[" Graph ", "图"], ["", "x"]]}))
    assert [tuple(r) for r in read_bilingual(spark, str(tmp_path / "b.json")).collect()] == [("graph", "图", 0)]


def test_versions_swap(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "paper_id long, title string")
    write_version(df, str(tmp_path))
    write_version(df.where("paper_id = 1"), str(tmp_path))
    assert read_version(spark, str(tmp_path)).count() == 1


def test_decoding():
    text = "图神经网络 graph"
    for charset in ("utf-8", "utf-8-sig", "gb18030"):
        assert files.decode(text.encode(charset))[0] == text
    assert files.unmisread("汉字网络".encode().decode("latin-1")) == "汉字网络"
    assert files.unmisread("résumé") == "résumé"
    assert files.unmisread("plain") == "plain"


def archive(members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, c in members:
            z.writestr(n, c)
    return b.getvalue()


def test_zip_entries(spark):
    df = spark.createDataFrame([("a.zip", archive([("x/a.txt", b"1"), ("../evil.txt", b"2"), ("b.pdf", b"3"), ("c.exe", b"4")])), ("bad.zip", b"no"), ("e.zip", archive([]))], "name string, content binary")
    got = files.zip_entries(df).collect()
    assert sorted(r["name"] for r in got if r["error"] is None) == ["a.txt", "b.pdf"]
    assert sorted(r["archive"] for r in got if r["error"]) == ["bad.zip", "e.zip"]


PAPER = """基于图的检索研究
Graph based retrieval: a study
张三，李四
北京大学计算机学院 100000
收稿日期：2019-01-02
摘要：本文研究检索。2020
2020
关键词：检索
1 引言
"""


def test_layout(spark):
    rows = [("zh.txt", PAPER.encode("gb18030")), ("en.txt", b"Deep trees\nAnn Lee and Bo Wu\nAbstract: We study trees in 2024.\nKeywords: x\n"), ("none.txt", b"1 Introduction\nlower case text\n"), ("x_y.pdf", b"%PDF"), ("z.doc", b"")]
    got = {r["name"]: r for r in files.parse_files(spark.createDataFrame(rows, "name string, content binary")).collect()}
    zh = got["zh.txt"]
    assert (zh["title"], zh["authors"], zh["abstract"], zh["year"]) == ("基于图的检索研究", ["张三", "李四"], "本文研究检索。2020", 2020)
    en = got["en.txt"]
    assert (en["title"], en["authors"], en["abstract"], en["year"]) == ("Deep trees", ["Ann Lee", "Bo Wu"], "We study trees in 2024.", 2024)
    assert got["x_y.pdf"]["title"] == "x y" and got["x_y.pdf"]["no_text"] and got["x_y.pdf"]["confidence"] == 0.15
    assert got["z.doc"]["error"]
    with_pdf = files.parse_files(spark.createDataFrame([("p.pdf", b"1")], "name string, content binary"), lambda raw: "A fine title\nAnn Lee, Bo Wu\nAbstract: Text of 2001.").first()
    assert with_pdf["title"] == "A fine title" and not with_pdf["no_text"]


def pdf_file(lines, compress=True, info=b"", encrypted=False):
    """A file of one page whose text is shown line by line."""
    shown = b"BT /F1 12 Tf 72 720 Td 14 TL\n" + b"\n".join(b"(" + x.replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj T*" for x in lines) + b"\nET"
    data = zlib.compress(shown) if compress else shown
    head = b"<< /Length %d%s >>" % (len(data), b" /Filter /FlateDecode" if compress else b"")
    body = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 5 0 R >> >> /Contents 4 0 R >>",
            head + b"\nstream\n" + data + b"\nendstream", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", b"<< " + info + b" >>"]
    out = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, x) for i, x in enumerate(body))
    return out + b"trailer << /Root 1 0 R /Info 6 0 R" + (b" /Encrypt 7 0 R" if encrypted else b"") + b" >>\n%%EOF"


LINES = [b"Deep trees (a study)", b"Ann Lee and Bo Wu", b"Abstract: We study trees in 2024.", b"Keywords: x"]


def test_pdf_reader():
    for compress in (True, False):
        assert pdf.read_small(pdf_file(LINES, compress)).text.split("\n") == [x.decode() for x in LINES]
    spaced = pdf_file([]).replace(b"ET", b"ET")
    got = pdf.extract(pdf_file(LINES, info=b"/Title (A \\(named\\) title) /CreationDate (D:20190203)"))
    assert (got.title, got.year) == ("A (named) title", 2019)
    assert pdf.year_of(["", "D:2018"]) == 2018 and pdf.quality("a\x01�") == 3 - 1 - 20 and pdf.quality("") == -1
    for bad in (b"", b"%PDF", spaced, pdf_file(LINES, encrypted=True)):
        with pytest.raises(pdf.NoTextError):
            pdf.extract(bad)
    assert pdf._page_text(b"BT /F1 9 Tf [(Se) 20 (arch) -400 (by)] TJ ET BT /F2 9 Tf <00010002> Tj ET", {b"F1": {}, b"F2": {1: "检", 2: "索"}}) == "Search by\n检索"
    assert pdf._codes(b"beginbfrange <0001> <0002> <4e00> endbfrange beginbfchar <03> <00660069> endbfchar") == {1: "一", 2: "丁", 3: "fi"}


def test_pdf_in_parsing(spark):
    rows = [("a.pdf", pdf_file(LINES)), ("b.pdf", pdf_file([b"x"], info=b"/Title (Its own title) /ModDate (D:2001)")), ("c.pdf", pdf_file(LINES, encrypted=True))]
    got = {r["name"]: r for r in files.parse_files(spark.createDataFrame(rows, "name string, content binary")).collect()}
    assert (got["a.pdf"]["title"], got["a.pdf"]["authors"], got["a.pdf"]["year"]) == ("Deep trees (a study)", ["Ann Lee", "Bo Wu"], 2024)
    assert (got["b.pdf"]["title"], got["b.pdf"]["year"]) == ("Its own title", 2001)
    assert got["c.pdf"]["no_text"] and got["c.pdf"]["title"] == "c" and "加密" in got["c.pdf"]["error"]


FEED = b"""<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/1706.03762v5</id><published>2017-06-12T00:00:00Z</published>
<title>A
 title</title><summary> Its text. </summary><author><name>Ann Lee</name></author><author><name>Bo Wu</name></author></entry></feed>"""


def test_feeds_and_works(spark):
    asked = []
    get = lambda url: asked.append(url) or FEED
    assert crawl.preprint_fetcher(get)("cs.CL", 5)[0]["authors"] == ["Ann Lee", "Bo Wu"] and "cat%3Acs.CL" in asked[0]
    got = crawl.lookup(spark, "https://arxiv.org/abs/1706.03762v1", get).first()
    assert (got["source_id"], got["title"], got["abstract"], got["year"], got["source"]) == ("1706.03762", "A  title", "Its text.", 2017, "url")
    assert crawl.lookup(spark, "1234.56789", lambda url: b"<feed xmlns='http://www.w3.org/2005/Atom'/>").count() == 0
    assert crawl.lookup(spark, "", get).count() == 0 and crawl.lookup(spark, "1234.56789", lambda url: b"broken").count() == 0
    page = json.dumps({"results": [{"id": "https://w/W1", "doi": None, "title": "T", "authorships": [{"author": {"display_name": "A"}}, {"author": None}], "publication_year": 2020, "abstract_inverted_index": {"b": [1], "a": [0]}}]}).encode()
    urls = []
    rows = crawl.work_fetcher(lambda url: urls.append(url) or page)("知识图谱", 1)
    assert len(rows) == 1 and rows[0]["authors"] == ["A"] and rows[0]["inverted"] == {"b": [1], "a": [0]} and "language%3Azh" in urls[0]


def test_log_rotates(tmp_path):
    from scriptorium.log import logger

    log = logger(str(tmp_path))
    assert logger(str(tmp_path)) is log and len([h for h in log.handlers if str(tmp_path) in getattr(h, "baseFilename", "")]) == 1
    log.info("said")
    assert "said" in (tmp_path / "app.log").read_text()


def test_crawl_sources(spark):
    def recorded(topic, limit):
        if topic == "broken":
            raise RuntimeError("offline")
        return [{"id": "http://arxiv.org/abs/1706.03762v2", "title": "A\ntitle", "authors": ["x"], "year": 2017}, {"id": f"http://arxiv.org/abs/{'1801' if topic == 'a' else '1802'}.00001", "title": "B"}]

    spark.dataSource.register(crawl.topic_source("preprints", recorded, ("a", "broken", "b")))
    got = crawl.fetch(spark, "preprints")
    assert sorted((r["source_id"], r["title"]) for r in got.collect()) == [("1706.03762", "A title"), ("1801.00001", "B"), ("1802.00001", "B")]
    spark.dataSource.register(crawl.topic_source("works", lambda t, n: [{"id": "https://w/W1", "title": "T", "inverted": {"b": [1], "a": [0]}}, {"id": "W2", "title": " "}], ("t",)))
    assert [(r["source_id"], r["abstract"]) for r in crawl.fetch(spark, "works").collect()] == [("W1", "a b")]
    with pytest.raises(ValueError):
        crawl.fetch(spark, "nowhere")


def test_refiner_guards(spark):
    from pyspark.sql import functions as F

    from scriptorium.sources.refine import refined

    df = spark.createDataFrame([("Abstract: x", "Old", "", [], None), ("no marker", "Old", "", [], 2000)], "text string, title string, abstract string, authors array<string>, year int")
    answer = F.lit('```json\n{"title": "A new title", "abstract": "' + "word " * 20 + '", "authors": ["A"], "year": 1850, "keywords": ["trees", "method", "12", "trees"]}\n```')
    got = refined(df, lambda text: answer).collect()
    assert got[0]["title"] == "A new title" and got[0]["abstract"].startswith("word") and got[0]["year"] is None
    assert got[1]["abstract"] == "" and got[1]["year"] == 2000 and got[1]["agent_keywords"] == ["trees"]
    intro = F.lit('{"title": "2 Methods of old", "abstract": "We present a thing. ' + "word " * 20 + '", "keywords": ["trees。", "图；"]}')
    guarded = refined(df, lambda text: intro).first()
    assert guarded["title"] == "Old" and guarded["abstract"] == "" and guarded["agent_keywords"] == ["trees"]
    assert refined(df, lambda text: F.lit("no json")).first()["title"] == "Old"
    assert not refined(df).first()["ai_used"]
