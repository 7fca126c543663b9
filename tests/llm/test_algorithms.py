import random
from fractions import Fraction
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import duplicates, enrichment, linkage, mixture, names, reading

RECORD = "id long, title string, abstract string, authors array<string>, year int"


# --- duplicates ----------------------------------------------------------------------------------------------------


def test_runs_with_a_hot_key_equal_brute_force(spark):
    r = random.Random(1)
    rows = []
    for i in range(3000):
        k = 0 if r.random() < 0.4 else r.randrange(700)
        t = [f"Title {k}", f"TITLE  {k}!", f" title: {k}"][r.randrange(3)]
        rows.append((i, t, None if r.random() < 0.5 else "", r.choice([["B A", "C"], ["C", "A, B"]]), None if k % 2 else 2000))
    df = spark.createDataFrame(rows, RECORD).withColumn("key", F.lit("clash")).repartition(7)
    groups: dict = {}
    for i, t, _, _, y in rows:
        groups.setdefault(("".join(c for c in t.lower() if c.isalnum()), y), []).append(i)
    want = {(min(g), x) for g in groups.values() for x in g if x != min(g)}
    copies, none = duplicates.sorted_runs(df, duplicates.canonical_key(), every_run=False)
    assert {(r["keep_id"], r["id"]) for r in copies.collect()} == want
    copies, runs = duplicates.sorted_runs(df, duplicates.canonical_key(), every_run=True)
    assert {(r["keep_id"], r["id"]) for r in copies.collect()} == want
    assert {r["keep_id"]: r["n"] for r in runs.collect()} == {min(g): len(g) for g in groups.values()}


def test_names_keep_their_parts(spark):
    names = [["Leon Ray"], ["Noel Ary"], ["RAY, Leon"], ["卢 启怀", "J.K. O'Neil"], ["ONeil, J. K.", "卢·启怀", None, " "]]
    df = spark.createDataFrame([(i, "T", "a", n, 1) for i, n in enumerate(names)], RECORD)
    assert {(r["keep_id"], r["id"]) for r in duplicates.sorted_runs(df, duplicates.canonical_key(), every_run=False)[0].collect()} == {(0, 2), (3, 4)}
    assert [linkage.name_key(n) for n in ("Leon Ray", "RAY, Leon", "卢·启怀", "J.K. O'Neil")] == ["leon ray", "leon ray", "卢启怀", "j k oneil"]


def test_partition_that_begins_with_one_run(spark):
    df = spark.createDataFrame([(i, "same", None, None, None) for i in range(40)], RECORD)
    for every in (False, True):
        copies, runs = duplicates.sorted_runs(df, duplicates.canonical_key(), every_run=every)
        assert {(r["keep_id"], r["id"]) for r in copies.collect()} == {(0, i) for i in range(1, 40)}
    assert [(r["keep_id"], r["n"]) for r in runs.collect()] == [(0, 40)]


def test_duplicates_edges(spark):
    rows = [(1, None, None, None, None), (2, "", "", [], None), (3, "x" * 50_000, None, None, 1), (4, "x" * 50_000, None, None, 2)]
    copies, _ = duplicates.sorted_runs(spark.createDataFrame(rows, RECORD), duplicates.canonical_key(), every_run=False)
    assert [(r["keep_id"], r["id"]) for r in copies.collect()] == [(1, 2)]
    assert duplicates.sorted_runs(spark.createDataFrame([], RECORD), duplicates.canonical_key(), every_run=False)[0].count() == 0


# --- linkage -------------------------------------------------------------------------------------------------------

PAPERS = [
    (1, "a", "Sparse trees for music tagging", "We present trees. They work well here.", ["Ann Leeson", "Bo Wustrow"], 2000),
    (2, "a", "Sparse trees for music tagging!", "We present trees. They work well here.", ["Bo Wustrow", "Leeson, Ann"], 2000),
    (3, "a", "Sparse trees for music tagging", "Another text entirely. With other words.", ["Zoe Krantz"], 2011),
    (4, "a", "Robust graph encoders that adapt to bug reports", "", ["Carla Montez", "Dirk Oberon"], 2015),
    (5, "a", None, None, None, None),
    (6, "a", "融合决策森林与注意力层的论断核查", None, ["房望思"], 2020),
]
FETCHED = [
    (10, "w1", "SPARSE TREES FOR MUSIC TAGGING", "We present trees. They work…", "Leeson, A.; Wustrow, B.", 2001),
    (11, "w1", "SPARSE TREES FOR MUSIC TAGGING", "We present trees. They work…", "Leeson, A.; Wustrow, B.", 2001),
    (12, "w2", "Sparse trees for music tagging, part II", "Quite another thing. Not the same.", "Leeson, A.; Wustrow, B.", 2003),
    (13, "w3", "Robust graph encodres that adapt to bug reports", None, "Carla Montez and Dirk Oberon", 2015),
    (14, None, None, None, None, None),
    (15, "w4", "融合决策森林与注意层的论断核查", None, "房望思", 2020),
    (16, "w5", "Something else entirely about nothing", "No such text. None at all.", "Nobody Known", 1999),
]
P_SCHEMA, F_SCHEMA = "id long, source string, title string, abstract string, authors array<string>, year int", "fetch_id long, source_id string, title string, abstract string, authors string, year int"


def test_linkage(spark):
    got = linkage.matches(spark.createDataFrame(PAPERS, P_SCHEMA).withColumn("fetch_id", F.lit("clash")), spark.createDataFrame(FETCHED, F_SCHEMA)).collect()
    assert {(r["paper_id"], r["fetch_id"]) for r in got} == {(1, 10), (1, 11), (2, 10), (2, 11), (4, 13), (6, 15)}
    assert all(0 < r["confidence"] < 1 for r in got)
    assert linkage.matches(spark.createDataFrame([], P_SCHEMA), spark.createDataFrame(FETCHED, F_SCHEMA)).count() == 0


def test_loose_titles_link_by_any_author(spark):
    papers = spark.createDataFrame([(1, "a", "Slow rewriting of pufelex grammars in museums", None, ["Ana Oro", "Bartholomew Longestnamehere"], 2001), (2, "a", "Ein Blick auf Fluesse und Seen", None, ["Eva Kurz", "Alexandrine Unterwasserfeld"], 2003)], P_SCHEMA)
    fetched = spark.createDataFrame([(10, "w1", "Slow rewritng of pufelex grammars in museums", None, "Oro, A., et al.", 2001), (11, "w2", "Ein Blick auf Flüsse und Sehen", None, "Jonathan Wiederholtes; Margarethe Hinzugekommen; Christopher Dazwischen; Eva Kurz", 2003)], F_SCHEMA)
    assert {(r["paper_id"], r["fetch_id"]) for r in linkage.matches(papers, fetched).collect()} == {(1, 10)}
    fetched = fetched.withColumn("title", F.regexp_replace("title", "Flüsse", "Fluesse"))
    assert {(r["paper_id"], r["fetch_id"]) for r in linkage.matches(papers, fetched).collect()} == {(1, 10), (2, 11)}


def test_equal_texts_link_by_any_author_or_year(spark):
    names = [f"Q {c * 9}" for c in "bcdfg"]
    papers = spark.createDataFrame([(1, "a", "Pufelex", None, ["Al Oro", *names], 2001), (2, "a", "Pufelex", None, ["Zed Krantz"], 2005), (3, "a", "Ein Blick auf kalte Seen", "Wir messen alle Seen im Norden. Kurz.", ["Eva Kurz"], 2003)], P_SCHEMA)
    fetched = spark.createDataFrame([(10, "w1", "Pufelex", None, "Oro, A., et al.", None), (11, "w2", "Ein Blick auf kalte Sehen", "Wir messen alle Seen im Norden. Anders aber.", None, 2003)], F_SCHEMA)
    assert {(r["paper_id"], r["fetch_id"]) for r in linkage.matches(papers, fetched).collect()} == {(1, 10), (3, 11)}
    assert {"sentence+year", "title-1+sentence", "title-1+year"} < set(linkage.RULES)


def test_catalogue_may_hold_a_publication_twice(spark):
    papers = spark.createDataFrame([PAPERS[0]], P_SCHEMA)
    fetched = spark.createDataFrame([FETCHED[0], (90, "w9", "Sparse trees for music tagging", None, "Leeson A; Wustrow B", None), (91, None, "Sparse trees", "We present trees. They work well here.", "Ann Leeson", 2000)], F_SCHEMA)
    assert {(r["paper_id"], r["fetch_id"]) for r in linkage.matches(papers, fetched).collect()} == {(1, 10), (1, 90), (1, 91)}


def test_hot_papers_and_hot_texts(spark):
    """A third of the fetched records describe one paper, and a third of the papers are copies of it."""
    papers = spark.createDataFrame([(i, "a", PAPERS[0][2] + "!" * (i % 3), PAPERS[0][3], PAPERS[0][4], 2000) for i in range(40)] + [(100 + i, "a", f"Another work number{i} on quite other things", None, [f"Nam{chr(97 + i % 26)}e Surn{i}x"], 1990) for i in range(80)], P_SCHEMA)
    fetched = spark.createDataFrame([(i, f"w{i}", "Sparse trees for music tagging", None, "Leeson, A.", 2000) for i in range(60)] + [(1000 + i, f"v{i}", f"Unrelated text {i} about rivers and stones", None, "Nobody Known", 2000) for i in range(120)], F_SCHEMA)
    got = {(r["paper_id"], r["fetch_id"]) for r in linkage.matches(papers, fetched).collect()}
    assert got == {(p, f) for p in range(40) for f in range(60)}


def test_parts_of_titles_and_short_names(spark):
    papers = spark.createDataFrame([(1, "a", "Revisiting code completion: temporal baselines and a routing policy", None, ["Wei Li", "Jun Xu", "Łukasz Sørensen"], 2008), (2, "a", "Scaling music tagging to 13 million loans", None, ["Yu Ma"], 2001)], P_SCHEMA)
    fetched = spark.createDataFrame([(10, "w1", "temporal baselines and a routing policy", None, "Wei Li, Jun Xu, Lukasz Sorensen", None), (11, "w2", "Scaling music tagging to 43 million loans", None, "Yu Ma", 2001)], F_SCHEMA)
    assert {(r["paper_id"], r["fetch_id"]) for r in linkage.matches(papers, fetched).collect()} == {(1, 10)}
    assert linkage.author_parts("Wei Li, Jun Xu; Łukasz Sørensen et al.") == ["wei", "li", "jun", "xu", "lukasz", "sorensen"]


def test_confidence_from_labels(spark):
    linked = spark.createDataFrame([(1, 1, "r", True, True, True, True), (2, 2, "r", True, True, True, True)], "pc long, fc long, rule string, s boolean, a boolean, t boolean, y boolean")
    labels = spark.createDataFrame([(1, 1)], "pc long, fc long")
    assert linkage.confidences(linked, labels).first()["confidence"] == 0.5


# --- names ---------------------------------------------------------------------------------------------------------


def test_names(spark):
    people = ["Vikram N. Takidrolund", "Takidrolund, V.N.", "TAKIDROLUND Vikram", "vikram takidrolund", "Thomas Takidrolund", "Tom Takidrolund", "Fanwen Zhuo", "Fan Wen Zhuo", "Zhuo, Fan-Wen", "卢启怀", "卢　启怀 ", "卢·启怀",
              "Institute of Soil Science, Hapaboville", "The Hapaboville Inst. for Soil Science", "Deep Catalogue Collaboration (Halvorine)", "Halvorine Deep Catalog Collaboration", "José Ñandu", "Jose Nandu", None, " "]
    df = spark.createDataFrame([(p,) for p in people * 2], "name string")
    got = {r["name"]: r["entity"] for r in names.entities(df).collect()}
    want = [{0, 1, 2, 3}, {4, 5}, {6, 7, 8}, {9, 10, 11}, {12, 13}, {14, 15}, {16, 17}]
    for group in want:
        assert len({got[people[i]] for i in group}) == 1, [people[i] for i in group]
    assert len({got[people[min(g)]] for g in want}) == len(want)
    assert names.entities(df.limit(0)).count() == 0


@pytest.mark.parametrize(("a", "b", "ok"), [("beatriz", "beaeriz", True), ("olumide", "olumdie", True), ("estelle", "esteelle", True), ("rosalind", "roalind", True), ("a", "a", False), ("abcd", "badc", False), ("farid", "faridaa", False)])
def test_near(a, b, ok):
    assert names.near(a, b) is ok


def test_two_nicknames_and_shared_initials(spark):
    people = ["Bill Bob Hastemo", "William Robert Hastemo", "A. Krilo", "Ann Krilo", "Anton Krilo", "Anton B. Dremo", "A. B. Dremo", "Agnes C. Dremo", "A. Dremo"]
    rows = names.entities(spark.createDataFrame([(p,) for p in people], "name string")).collect()
    got = {r["name"]: r["entity"] for r in rows}
    assert got["Bill Bob Hastemo"] == got["William Robert Hastemo"]
    assert got["A. B. Dremo"] == got["Anton B. Dremo"] != got["Agnes C. Dremo"]
    # two persons have the initial
    assert got["A. Krilo"] not in (got["Ann Krilo"], got["Anton Krilo"]) and got["A. Dremo"] not in (got["Anton B. Dremo"], got["Agnes C. Dremo"])
    assert all(r["score"] >= 0 for r in rows)


def test_mistyped_given_name(spark):
    rows = [f"Beatriz {s}man" for s in ("Kolo", "Bar", "Dorro", "Feli", "Gros", "Hubu", "Jakob", "Lister", "Nolo", "Pater", "Rusti", "Sandor", "Tolle", "Vester", "Wolle", "Zander", "Mirko")] + ["Beaeriz Koloman"]
    got = {r["name"]: r["entity"] for r in names.entities(spark.createDataFrame([(r,) for r in rows], "name string")).collect()}
    assert got["Beaeriz Koloman"] == got["Beatriz Koloman"] != got["Beatriz Barman"]


def test_rare_letter_sequences_count(spark, monkeypatch):
    """Sequences beyond those that are broadcast count as much as the others."""
    rows = [f"{g} {s}" for g in ("Beatriz", "Olumide", "Rosalind") for s in ("Koloman", "Barman", "Dorroman", "Feliman", "Grosko", "Hubuko", "Jakobko")] + ["Beaeriz Koloman", "Olumdie Grosko", "Roslind Hubuko", "Beatriz Grosok"]
    s = names.spellings(spark.createDataFrame([(r,) for r in rows], "name string"))
    people = s.select("form").distinct().cache()
    parts = names.parts_of(people)
    found = lambda: {(r["form"], r["target"]) for r in names.mistyped(people, parts).collect()}
    all_broadcast = found()
    assert ("beatriz grosok", "beatriz grosko") in all_broadcast
    monkeypatch.setattr(names, "MOST_SEQUENCES", 20)
    assert found() == all_broadcast


# --- enrichment ----------------------------------------------------------------------------------------------------


def test_tail_is_exact():
    r = random.Random(1)
    for _ in range(300):
        N = r.choice([50, 500, 5000])
        K, n = r.randint(1, N), r.randint(1, min(N, 80))
        low, high = max(1, n - (N - K)), min(K, n)
        if low > high:
            continue
        k = r.randint(low, high)
        want = float(sum(Fraction(comb(K, j) * comb(N - K, n - j), comb(N, n)) for j in range(k, high + 1)))
        assert np.isclose(np.exp(enrichment.log_tail(np.array([k]), np.array([K]), np.array([n]), float(N)))[0], want, rtol=1e-6, atol=1e-12)


def test_terms_with_and_without_rare_path(spark):
    rows = [(i, f"common words {'zeta' if i < 3 else 'other'}", "the common text of all " * 3, ["key"] if i % 2 else None) for i in range(60)] + [(99, None, None, None), (100, "", "", [])]
    df = spark.createDataFrame(rows, "id long, title string, abstract string, keywords array<string>").withColumn("term", F.lit("clash"))
    a = {(r["paper_id"], r["term"]): (r["k"], r["score"], r["minus_log_p"]) for r in enrichment.distinctive_terms(df).collect()}
    b = {(r["paper_id"], r["term"]): (r["k"], r["score"], r["minus_log_p"]) for r in enrichment.distinctive_terms(df, frequent_bound=4).collect()}
    assert a == b and (99, "common") not in a
    assert a[0, "zeta"][1] >= a[0, "common"][1] and a[0, "zeta"][2] > a[0, "common"][2]
    assert all(0 <= score <= p for _, score, p in a.values())
    assert enrichment.distinctive_terms(df.limit(0)).count() == 0


def test_adjustment_is_conservative_and_ordered():
    p = np.sort(np.random.default_rng(1).beta(0.3, 1, 4000))
    at, n = np.unique(enrichment._bin(np.log(p)), return_counts=True)
    q = np.exp(enrichment.Adjustment(at, n).log_q(np.log(p)))
    exact = np.minimum.accumulate((p * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    assert (np.diff(q) > -0.04 * q[1:] - 1e-12).all() and (q >= exact - 1e-12).all() and (q <= exact * 1.04 + 1e-12).all()


# --- mixture -------------------------------------------------------------------------------------------------------


def test_flight_keeps_totals_and_probabilities():
    r = np.random.default_rng(5)
    size = r.lognormal(5, 1, 60).round()
    x, pi = np.column_stack([np.ones(60), size]), np.full(60, 0.3)
    sums = np.zeros(60)
    for k in range(400):
        f = mixture.fly(pi, x, np.random.default_rng(k))
        assert np.allclose(f @ x, pi @ x) and ((f > 1e-9) & (f < 1 - 1e-9)).sum() <= 2
        sums += f
    assert abs(sums / 400 - 0.3).max() < 0.12


@pytest.mark.parametrize("block", [40, 4000])
def test_mix_meets_targets(spark, block):
    r = random.Random(2)
    rows = [("big" if i % 3 else "small", i, r.randrange(50, 400)) for i in range(900)] + [("big", 1000, 0), (None, 1001, 50), ("untargeted", 1002, 70)]
    counts = spark.createDataFrame(rows, "source string, doc_id long, n_tokens long")
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.5, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    chosen = mixture.mix(counts, targets, block).cache()
    got = {x["source"]: x["share"] for x in mixture.shares(chosen, targets).collect()}
    assert abs(got["big"] - 0.4 / 0.9) < 0.005 and abs(got["small"] - 0.5 / 0.9) < 0.005 and got["absent"] == 0
    most = {x["source"]: x["m"] for x in chosen.groupBy("source").agg(F.max("repeats").alias("m")).collect()}
    assert most["big"] <= 1 and most["small"] <= 3 and set(most) == {"big", "small"}
    assert mixture.mix(counts.limit(0), targets).count() == 0


# --- reading -------------------------------------------------------------------------------------------------------

EASY = ["The cat sat on the mat.", "We had a big box.", "Mum read a good book.", "The boy ran to the lake."]
HARD = ["The epistemic uncertainty attributable to misspecification dominates the aleatoric component, notwithstanding regularisation.", "Consequently, the variational surrogate admits stationary points coinciding with intractable marginals."]


def test_reading_levels(spark):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(160):
        easy = i % 2 == 0
        docs.append((i, "A title\n" + " ".join(r.choice(EASY if easy else HARD) for _ in range(6)), f"s{i % 5}"))
        if i < 100:
            labels.append((i, 1 if easy else 4))
    docs += [(900, None, "s"), (901, "", None), (902, " \n ", "s"), (903, "!!!", "s")]
    labels += [(0, None), (0, 1), (5000, 2)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("level", F.lit("clash"))
    got = {x["doc_id"]: x["level"] for x in reading.reading_levels(d, spark.createDataFrame(labels, "doc_id long, level int")).collect()}
    held = [i for i in range(100, 160)]
    assert np.mean([got[i] == (1 if i % 2 == 0 else 4) for i in held]) > 0.95
    assert not {900, 901, 902, 903} & set(got)
    assert all(v is None for v in (x["level"] for x in reading.reading_levels(d, spark.createDataFrame([], "doc_id long, level int")).collect()))


def test_isotonic():
    x, y = reading.isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 4]))
    assert y.tolist() == [1.0, 2.5, 4.0]
