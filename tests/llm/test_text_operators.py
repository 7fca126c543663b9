import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import glyphs, languages, recode, tokens

PAPER = "id long, title string, abstract string, source string"


# --- one form for look-alikes --------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("odd", "plain"),
    [("Ｆｕｌｌ１", "Full1"), ("étude", "étude"), ("a​b­c", "abc"), ("a b c　d", "a b c d"), ("conﬁg", "config"), ("⽅法", "方法"), ("报告了", "报告了"),
     ("rесursive", "recursive"), ("Kelvin", "Kelvin"), ("transcripts and а set", "transcripts and a set"), ("покaзал", "показал")],
)
def test_unified(odd, plain):
    assert glyphs.normalise(odd) == plain
    assert glyphs.normalise(plain) == plain


@pytest.mark.parametrize("same", ["", "étude “x” – y", "，。：（中）", "β-weighted α", "архив «Вестник» о том", "plain", "20 °C", None])
def test_left_alone(same):
    assert glyphs.normalise(same) == same


@pytest.mark.parametrize(
    ("odd", "plain"),
    [("in the \u0455\u0440\u0430\u0441\u0435 of words", "in the space of words"), ("full \u0430\u0441\u0441\u0435\u0455\u0455 here", "full access here"), ("\u0440\u0435\u0430\u0441\u0435", "\u0440\u0435\u0430\u0441\u0435"),
     ("\u0391\u0431\u0437\u0430\u0446", "\u0410\u0431\u0437\u0430\u0446"), ("o\u0323\u0302", "\u1ed9"), ("o\u0302\u0323", "\u1ed9"), ("re\u00adco\u200bd\u0435", "recode")],
)
def test_words_of_lookalikes_and_marks(odd, plain):
    assert glyphs.normalise(odd) == plain
    assert glyphs.normalise(plain) == plain


def test_conflicts_are_found():
    with pytest.raises(glyphs.ConflictError):
        glyphs.compile_table(iter([("a", "b"), ("a", "c")]))
    with pytest.raises(glyphs.ConflictError):
        glyphs.compile_table(iter([("a", "b"), ("b", "c")]))
    for bad in ([("latin", "a", "b"), ("latin", "a", "c")], [("latin", "a", "b"), ("latin", "b", "c")], [("a", "b"), ("latin", "a", "c")], [("latin", "a", "b"), ("b", "c")]):
        with pytest.raises(glyphs.ConflictError):
            glyphs.compile_table(bad)
    glyphs.compile_table([("latin", "a", "b"), ("cyrillic", "b", "a")])


def test_outputs_are_fixed_points():
    t = glyphs.tables()
    assert all(glyphs.normalise(o) == o for o in t[""].values())
    assert all(glyphs.normalise(k) == o for k, o in t[""].items())


def test_unify_columns(spark):
    df = spark.createDataFrame([("ａ", None), (None, ""), ("a", "x" * 100_000 + "​")], "title string, abstract string")
    got = glyphs.unify(df, "title", "abstract").collect()
    assert [r["title_affected"] for r in got] == [True, False, False]
    assert [r["abstract_affected"] for r in got] == [False, False, True]
    assert got[2]["abstract_unified"] == "x" * 100_000
    assert glyphs.unify(df.limit(0), "title").count() == 0


# --- wrong code pages ----------------------------------------------------------------------------------------------

CLEAN = [
    "Die Prüfung der Messwerte für größere Sammlungen bleibt zuverlässig", "La détection des anomalies était jugée coûteuse à l’échelle", "Результаты показывают, что анализ данных надёжен",
    "本文提出一种用于代码补全的方法，并在土壤样本上进行实验。", "La evaluación según la comparación tres años",
]
GARBLED = {
    "a": CLEAN[0].encode().decode("cp1252", "ignore"), "b": CLEAN[1].encode().decode("latin-1"), "c": CLEAN[2].encode().decode("latin-1"), "d": CLEAN[3].encode().decode("latin-1"),
    "e": CLEAN[4].encode().decode("cp1251", "ignore"), "f": CLEAN[0].encode("latin-1").decode("utf-8", "replace"), "g": CLEAN[3].encode("gb18030").decode("latin-1"), "h": CLEAN[1].encode().decode("mac_roman"),
}


def test_garbled_fields_are_found_and_restored(spark):
    rows = [(i, t, None, "x") for i, t in enumerate(CLEAN * 6)] + [(1000 + i, g, None, None) for i, g in enumerate(GARBLED.values())] + [(2000, None, "", "x"), (2001, "Zoë’s café", "São «x»", "x")]
    papers = spark.createDataFrame(rows, PAPER)
    got = {(r["paper_id"], r["field"]) for r in recode.garbled_fields(papers)[0].collect()}
    assert got == {(1000 + i, "title") for i in range(len(GARBLED))}
    back = {r["paper_id"]: r for r in recode.restored_fields(papers).collect()}
    assert back[1001]["restored"] == CLEAN[1] and back[1002]["restored"] == CLEAN[2] and back[1006]["restored"] == CLEAN[3]
    assert not back[1005]["complete"]
    assert recode.garbled_fields(papers.limit(0))[0].count() == 0


RUSSIAN = (
    "В работе предложен новый метод поиска. Результаты показывают, что метод работает быстро. В заключение обсуждаются ограничения и дальнейшие задачи. "
    "Сравнение показало, что анализ больших фондов и метод взвешивания дополняют друг друга. Эксперименты проведены на наборах данных из трёх архивов. "
    "До сих пор обработка запросов считалась слишком дорогой для крупных собраний. Обнаружение аномалий остаётся надёжным решением даже на зашумлённых данных."
)


def garbled_as(text, page):
    return text.encode(page, "ignore").decode("latin-1")


@pytest.mark.parametrize("page", ["cp1251", "iso8859-5", "cp866", "cp855"])
def test_letters_of_any_page_are_learned(page):
    """cp855 is on no list: its letters come from the words alone."""
    counted = pd.concat(recode._count_pairs(iter([pd.DataFrame({"text": [RUSSIAN] * 4})]))).groupby("pair")["n"].sum()
    lm = recode.Bigrams(counted.index.to_numpy(), counted.to_numpy())
    words = recode.high_words(garbled_as(RUSSIAN, page))
    tables = recode.learn_tables(sorted(set(words)), [words.count(w) for w in sorted(set(words))], lm)
    assert len(tables) == 1
    meant = [w.encode("latin-1").decode(page) for w in words]
    got = [w.translate(str.maketrans(tables[0])) for w in words]
    assert sum(a == b for x, y in zip(meant, got, strict=True) for a, b in zip(x, y, strict=True)) > 0.95 * sum(map(len, words))


def test_swapped_pages_of_a_source(spark):
    rows = [(i, "Заметка", RUSSIAN, "x") for i in range(8)] + [(20 + i, t, "GRÖSSE ÜBER ÖL, ÉTÉ À MAÏS", "x") for i, t in enumerate(CLEAN)] + [(100, "Заметка", garbled_as(RUSSIAN, "cp866"), "y"), (101, garbled_as("Метод взвешивания и обзор подходов", "koi8-r"), None, "z"), (102, "Größere Prüfung ÖL", "détection À ÉTÉ", "y")]
    back = {(r["paper_id"], r["field"]): r for r in recode.restored_fields(spark.createDataFrame(rows, PAPER)).collect()}
    assert {k: r["key_name"] for k, r in back.items()} == {(100, "abstract"): "learned", (101, "title"): "learned"}
    assert back[100, "abstract"]["restored"][:40] == RUSSIAN[:40] and back[101, "title"]["restored"] == "Метод взвешивания и обзор подходов"


def test_all_words_of_a_source_are_learned_from(spark, monkeypatch):
    """Words beyond those of one task, here rarer ones in another page, are learned from too, and give the tables of one task."""
    other = "Метод взвешивания и обзор подходов к задачам поиска"
    rows = [(i, "Заметка", RUSSIAN, "x") for i in range(8)] + [(20 + i, t, None, "x") for i, t in enumerate(CLEAN)] + [(100 + i, None, garbled_as(RUSSIAN, "cp1251"), "y") for i in range(3)] + [(200, garbled_as(other, "koi8-r"), None, "y"), (201, garbled_as(other, "koi8-r"), None, None)]
    fields = recode.fields_of(spark.createDataFrame(rows, PAPER))
    shared = recode.learn_bigrams(fields)
    found = recode.suspects(fields, shared).cache()

    def tables():
        return {r["s"]: r["tables"] for r in recode.learned_tables(found, shared).collect()}

    one_task = tables()
    monkeypatch.setattr(recode, "WORDS", 20)
    assert tables() == one_task and set(one_task) == {"", "y"} and len(one_task["y"]) == 2
    back = {r["paper_id"]: r["restored"] for r in recode.restored_fields(spark.createDataFrame(rows, PAPER)).collect()}
    assert set(back) == {100, 101, 102, 200, 201} and back[200] == back[201] == other and back[100][:40] == RUSSIAN[:40]


# --- languages -----------------------------------------------------------------------------------------------------

SENTENCES = {
    "en": "We present a new method for the search of large archives. The results show that it is fast. This paper looks into the problem of noise.",
    "de": "In dieser Arbeit wird ein neues Verfahren für die Suche vorgestellt. Die Ergebnisse zeigen, dass es schnell ist. Dabei spielt der Vergleich eine Rolle.",
    "fr": "Nous présentons une nouvelle méthode pour la recherche. Les résultats montrent que la méthode est rapide. Cet article étudie le problème.",
    "es": "En este trabajo se presenta un nuevo método para la búsqueda. Los resultados muestran que es rápido. Por último, se discuten las tareas.",
    "ru": "В работе предложен новый метод поиска. Результаты показывают, что метод работает быстро. В заключение обсуждаются задачи.",
    "zh": "本文提出一种新的检索方法。实验结果表明，该方法速度很快。最后讨论了存在的问题和今后的工作。",
}


def test_forward_is_the_sum_over_segmentations():
    pieces = languages.Pieces({"▁": 0, "a": 1, "b": 2, "▁a": 3, "ab": 4, "▁ab": 5}, np.array([[0.1], [0.2], [0.3], [0.05], [0.15], [0.01]]))
    want = 0.1 * 0.2 * 0.3 + 0.05 * 0.3 + 0.1 * 0.15 + 0.01
    assert np.isclose(np.exp(pieces.forward("ab"))[0], want)


def test_languages(spark):
    rows = [(i * 10 + k, lang, text) for i, (lang, text) in enumerate(SENTENCES.items()) for k in range(3)]
    rows += [(900, "English", SENTENCES["de"]), (901, None, SENTENCES["en"]), (902, "en", SENTENCES["en"] + " " + SENTENCES["zh"]), (903, "en", None), (904, "en", ""), (905, "en", "The task is 「故障诊断」 in most of the notes.")]
    papers = spark.createDataFrame(rows, "id long, language string, abstract string")
    path = languages.vocabulary_path(spark)
    got = {tuple(r) for r in languages.unnamed_languages(papers, path).collect()}
    assert got == {(900, "de"), (901, "en"), (902, "zh")}
    seg = languages.segment_languages(papers, path).where("paper_id = 902").orderBy("segment").collect()
    assert [s["lang"] for s in seg] == ["en"] * 3 + ["zh"] * 3 and all(s["confidence"] > 0.9 for s in seg)


@pytest.mark.parametrize(("label", "code"), [("en-US", "en"), ("Chinese", "zh"), (" DEU", "de"), ("und", None), ("", None), ("Español", "es")])
def test_labels(spark, label, code):
    assert spark.createDataFrame([(label,)], "l string").select(languages.named_language(F.col("l"))).first()[0] == code


# --- tokens --------------------------------------------------------------------------------------------------------

HARD = ["", None, " ", "\n\n a", "a" * 3000, "don't  I'LL we've\r\n\r\n", "ʼn①²Ⅷ 𝒳😀👨‍👩‍👧 à", "é\x1c\x1dx \x85 y　z<|endoftext|>", "神经网络" * 50, "Результаты показывают", "​﻿ x"]


def test_ids_equal_the_public_library(spark):
    from tokenizers import Tokenizer

    path = tokens.vocabulary_path(spark)
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    want = [x.ids for x in t.encode_batch([h or "" for h in HARD], add_special_tokens=False)]
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string").withColumn("n_tokens", F.lit(1))
    got = {r["doc_id"]: r["ids"] for r in tokens.token_ids(df, path).collect()}
    assert [got[i] for i in range(len(HARD))] == want
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df, path, "doc_id").collect()} == {i: len(w) for i, w in enumerate(want)}
    assert tokens.token_ids(df.limit(0), path).count() == 0


def test_cache_is_bounded(spark):
    e = tokens.Encoder(tokens.vocabulary_path(spark), limit=3)
    for _ in range(3):
        ids, n = e.batch(["some words here and there", None, "x"])
        assert n.tolist()[1] == 0 and len(ids) == n.sum()
    assert isinstance(pd.Series(ids).sum(), (int, np.integer))
