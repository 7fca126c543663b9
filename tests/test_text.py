import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.functions.cjk import atomic, cut_run, nfkc, segmenter
from scriptorium.functions.stem import stems

STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "filing": "file", "happy": "happi", "sky": "sky",
    "relational": "relat", "conditional": "condit", "digitizer": "digit", "vietnamization": "vietnam", "triplicate": "triplic", "electrical": "electr", "hopeful": "hope",
    "goodness": "good", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll",
    "survey": "survei", "learning": "learn", "cnn": "cnn", "x9": "x9", "state-of-the-art": "state-of-the-art", "networks": "network", "transformers": "transform",
}


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_stems(spark):
    df = spark.createDataFrame([(w,) for w in STEMS], "word string")
    assert {r["word"]: r["term"] for r in stems(df).collect()} == STEMS


def test_tokens_drop_digits_first_and_stopwords(spark):
    got = one(spark, X.tokens(F.col("t"), {"the"}), t="The 3d naïve CNN-2_x 卷积神经 图")
    assert got == ["d", "na", "ve", "cnn-2_x", "卷积", "积神", "神经", "图"]
    assert spark.createDataFrame([(None,)], "t string").select(X.tokens(F.col("t"), set())).first()[0] == []


@pytest.mark.parametrize(("t", "lang"), [("神经网络", "zh"), ("graph neural", "en"), ("图 graph", "mixed"), ("12", "en")])
def test_detect_language(spark, t, lang):
    assert one(spark, X.detect_language(F.col("t")), t=t) == lang


def test_segmentation_keeps_parts_of_compounds():
    words = frozenset(atomic(["卷积", "神经网络", "卷积神经网络"]))
    assert cut_run("卷积神经网络", words, 4) == ["卷积", "神经网络"]
    assert cut_run("未知卷积词", words, 4) == ["未知", "卷积", "词"]


def test_segmenter_udf(spark):
    df = spark.createDataFrame([("用卷积 Deep",)], "t string")
    assert df.select(segmenter(["卷积"])(X.runs(F.col("t")))).first()[0] == ["用", "卷积", "deep"]


def test_content_key_ignores_formatting_and_author_order(spark):
    df = spark.createDataFrame([("A  title!", "x", ["B C", "A"], 2000), ("a Title", "X", ["a", "b-c", " "], 2000), ("a title", "x", ["a"], 2000)], "t string, x string, a array<string>, y int")
    keys = [r[0] for r in df.select(X.content_key(F.col("t"), F.col("x"), F.col("a"), F.col("y"))).collect()]
    assert keys[0] == keys[1] != keys[2]


def test_urls_and_numbers(spark):
    assert one(spark, X.external_url(F.col("s")), s="1706.03762v3") == "https://arxiv.org/abs/1706.03762v3"
    assert one(spark, X.external_url(F.col("s")), s="https://doi.org/1") == "https://doi.org/1"
    assert one(spark, X.external_url(F.col("s")), s="W12") is None
    assert one(spark, X.preprint_id(F.col("s")), s="https://arxiv.org/abs/1706.03762v3") == "1706.03762"


def test_year_titles_confidence(spark):
    assert one(spark, X.usual_year(F.col("t")), t="in 2004, 1999 and 2004; 12004") == 2004
    assert one(spark, X.usual_year(F.col("t")), t="2001 1999") == 1999
    assert one(spark, X.title_from_file_name(F.col("t")), t="a_b--c.pdf") == "a b c"
    assert one(spark, X.title_from_file_name(F.col("t")), t="__.pdf") == X.UNTITLED
    assert one(spark, X.title_from_abstract(F.col("t")), t="we show this. Then more.") == "We show this"
    assert one(spark, X.confidence(F.col("t"), F.col("a"), F.array(F.lit("n")), F.lit(None)), t="Title", a="x" * 80) == 0.75


def test_clean_lines(spark):
    text = "A  title\n\n---\n第 3 页 共 9 页\narXiv:1706.03762\nhttps://x.org\nDepartment of Physics, 10000\nDepartment of Physics\nSame\nSame\n收稿日期：2020\nWe met, at the University of X. It was fine."
    assert one(spark, X.clean_lines(F.col("t")), t=text) == ["A title", "Same", "We met, at the University of X. It was fine."]


def test_error_messages(spark):
    assert one(spark, X.parse_error_message(F.col("t")), t="EOF marker not found").startswith("PDF 文件损坏")
    assert one(spark, X.parse_error_message(F.col("t")), t="strange") == X.UNKNOWN_ERROR


def test_fenced_json_and_rebuilt_abstract(spark):
    assert one(spark, X.fenced_json(F.col("t")), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    df = spark.createDataFrame([({"b": [1], "a": [0, 2]},)], "m map<string,array<int>>")
    assert df.select(X.rebuilt_abstract(F.col("m"))).first()[0] == "a b a"


def test_nfkc(spark):
    assert one(spark, nfkc(F.col("t")), t="ＡＢ") == "AB"
