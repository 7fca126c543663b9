import random

from scriptorium.operators import records as R
from scriptorium.streaming.ingest import report, stream_into

S = "title string, abstract string, authors array<string>, year int, source_id string, paper_id long, ord long"


def rows(spark, *r):
    return spark.createDataFrame(list(r), S)


def test_merge_strict(spark):
    old = rows(spark, ("T", "a", ["x"], 2000, "s1", 0, 0))
    new = rows(spark, ("t!", "A", ["X"], 2000, None, None, 0), ("T", "b", ["x"], 2000, "s1", None, 1), ("U", "c", [], None, "s2", None, 2), ("u", "c", [], None, None, None, 3), ("V", "d", None, None, None, None, 4))
    got = R.merge_strict(old, new)
    assert sorted(r["ord"] for r in got.collect()) == [2, 4]
    assert R.merge_report(new, got).first().asDict() == {"added": 2, "skipped": 3}
    assert {r["outcome"]: r["records"] for r in report(old, new).collect()} == {"added": 2, "duplicated": 3}


def accepted_in_order(old, new):
    """Brute force: one row after the other."""
    key = lambda r: (r[0].strip().lower(), r[1].strip().lower(), r[3])
    keys, ids, out = {key(r) for r in old}, {r[4] for r in old if r[4]}, []
    for r in new:
        if key(r) not in keys and not (r[4] and r[4] in ids):
            keys.add(key(r))
            ids |= {r[4]} if r[4] else set()
            out.append(r[6])
    return out


def test_merge_strict_chains(spark):
    old = [("old", "", [], 1, "s0", 0, 0)]
    new = [("A", "", [], 1, "s1", None, 0), ("B", "", [], 1, "s1", None, 1), ("B", "", [], 1, "s3", None, 2)]
    assert sorted(r["ord"] for r in R.merge_strict(rows(spark, *old), rows(spark, *new)).collect()) == accepted_in_order(old, new) == [0, 2]
    draw = random.Random(7)
    for _ in range(3):
        new = [(draw.choice("ABCDEFGHIJ"), "", [], draw.choice([1, None]), draw.choice([None, "", *(f"s{i}" for i in range(12))]), None, i) for i in range(90)]
        assert sorted(r["ord"] for r in R.merge_strict(rows(spark, *old), rows(spark, *new)).collect()) == accepted_in_order(old, new)
    assert R.merge_strict(rows(spark, *old), rows(spark).limit(0)).count() == 0


def test_content_key_takes_compatibility_forms(spark):
    new = rows(spark, ("Ｇｒａｐｈ", "ﬁne", ["Ａ Ｂ"], 1, None, None, 0), ("Graph", "fine", ["a b"], 1, None, None, 1))
    assert [r["ord"] for r in R.merge_strict(rows(spark).limit(0), new).collect()] == [0]


def test_numbered_fills_gaps(spark):
    df = spark.createDataFrame([(0, 0), (None, 1), (0, 2), (3, 3), (None, 4)], "paper_id long, ord long")
    assert {r["ord"]: r["paper_id"] for r in R.numbered(df).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4}


def test_merge_by_id(spark):
    old = rows(spark, ("a", "", [], 1, "1", 0, 0), ("b", "", [], 1, "1", 1, 1), ("c", "", [], 1, None, 2, 2))
    new = rows(spark, ("d", "", [], 1, "1", 3, 3), ("e", "", [], 1, "2", 4, 4), ("f", "", [], 1, "2", 5, 5))
    assert sorted(r["title"] for r in R.merge_by_id(old, new).collect()) == ["b", "e"]


def test_mapped(spark):
    raw = spark.createDataFrame([("7", " T ", "A, B,", "x1", None), ("w-1", "U", None, None, "2001")], "id string, title string, authors string, source_id string, year string")
    got = sorted(R.mapped(raw).collect(), key=lambda r: r["title"])
    assert (got[0]["paper_id"], got[0]["title"], got[0]["authors"], got[0]["source_id"]) == (7, "T", ["A", "B"], "x1")
    assert (got[1]["paper_id"], got[1]["source_id"], got[1]["year"]) == (None, "w-1", 2001)


def test_stream_appends_new_records_once(spark, tmp_path):
    lib, inbox = str(tmp_path / "lib"), str(tmp_path / "in")
    rows(spark, ("T", "a", ["x"], 2000, "s1", 0, 0)).drop("ord").write.parquet(lib)
    rows(spark, ("T", "a", ["x"], 2000, None, None, 0), ("N", "n", [], 2001, None, None, 1)).drop("paper_id").write.parquet(inbox)
    for _ in range(2):
        stream = spark.readStream.schema("title string, abstract string, authors array<string>, year int, source_id string, ord long").parquet(inbox)
        stream_into(stream, lib, str(tmp_path / "ck")).awaitTermination()
    assert sorted((r["paper_id"], r["title"]) for r in spark.read.parquet(lib).collect()) == [(0, "T"), (1, "N")]
