"""Problem 7: spellings of names that denote the same person or organisation.

Every distinct spelling is rewritten to canonical forms by rules (case, accents,
marks, order of parts, nicknames, joined syllables, initials, legal and
institutional abbreviations, one mistyped letter), the forms are exploded and
equi-joined.  A rewriting counts by its rarity: a form shared by one entity only
links, a form shared by several doesn't, and every link carries the rarity of its form; a mistyped part links only where the part
is rare, or holds a rare letter sequence, against the part it is rewritten to.

Edge cases: null arrays, null and blank names have no spellings; a name in Chinese
characters is only ever linked to others such; spellings are compared exactly as
stored; repeated names count once; a name that one entity's hot rows repeat is counted
before the shuffle; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import ChainMap
from collections.abc import Iterator, Mapping
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import cut, read

# Full given names and their short forms.
NICKNAMES: dict[str, list[str]] = {}
for _line in """
alexander alex al sandy sasha xander; andrew andy; anthony tony; benjamin ben benny; charles charlie chuck; christopher chris kit; daniel dan danny;
david dave; dorothea dora dotty dot thea; edward ed eddie ted; elizabeth beth betty eliza liz lizzie; frederick fred freddy; gabriela gabi gabby; gregory greg;
james jim jimmy jamie; jennifer jen jenny; jeffrey jeff; joseph joe; jonathan jon jonny; joshua josh; katherine kate katie kathy kay kitty; kenneth ken; lawrence larry;
margaret maggie meg peggy greta; matthew matt; michael mike mick mickey; nathaniel nate; nicholas nick nicky nico; patricia pat patty trish tricia;
peter pete; philip phil; raymond ray; rebecca becky; richard dick rich rick ricky; robert bob bobby rob robbie bert; ronald ron; rosalind ros roz;
samuel sam sammy; stephen steve; susanna sue susie suzie; susan sue susie; theodora dora thea; timothy tim; thomas tom tommy; victoria vicky;
william bill billy will willy liam; zachary zach
""".replace("\n", " ").split(";"):
    _full, *_short = _line.split()
    for _s in _short:
        NICKNAMES.setdefault(_s, []).append(_full)
# Words of institutions, their short forms and the words that don't tell them apart.
INSTITUTIONAL = dict(
    pair.split(":")
    for pair in (
        "inst:institute univ:university uni:university dept:department dep:department lab:laboratory labs:laboratory laboratories:laboratory collab:collaboration "
        "coll:college ctr:center centre:center catalog:catalogue natl:national intl:international acad:academy assoc:association soc:society tech:technology "
        "sci:science res:research eng:engineering corp:corporation co:company inc:incorporated ltd:limited"
    ).split()
)
EMPTY_WORDS = {"the", "of", "for", "and", "at", "in", "a"}
ORGANISATION = {
    "institute", "university", "department", "laboratory", "collaboration", "college", "center", "academy", "association", "society", "consortium", "group",
    "company", "corporation", "foundation", "observatory", "library", "museum", "school", "faculty", "agency", "team", "project", "survey", "limited", "incorporated",
}
PARTICLES = {"al", "de", "van", "von", "der", "den", "di", "da", "la", "le", "el", "bin", "ibn", "du", "dos", "del", "ter"}
# Letters without a decomposition, and the plain letters they are typed as.
PLAIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ð": "d", "þ": "th"})
_HAN = re.compile("[㐀-鿿豈-﫿]")


def fold(name: str) -> str:
    low = unicodedata.normalize("NFKD", name).casefold().translate(PLAIN)
    return "".join(c for c in low if not unicodedata.combining(c))


def forms(name: str) -> tuple[str, str, list[str], str]:
    """(kind, full form, other full forms, initials) of a spelling; kinds: h Han, o organisation, p person, i initials only."""
    if _HAN.search(name):
        return "h", "".join(c for c in unicodedata.normalize("NFKC", name) if c.isalnum()), [], ""
    low = fold(name)
    parts = [p for p in re.split(r"[^\w'’`-]+", low) if p]
    words = [INSTITUTIONAL.get(w, w) for w in re.findall(r"[^\W_]+", low)]
    if len(words) > 2 and any(w in ORGANISATION for w in words):
        return "o", " ".join(sorted(w for w in words if w not in EMPTY_WORDS)), [], ""
    tokens: list[str] = []
    for p in parts:
        bits = [b for b in re.split(r"[-'’`_]+", p) if b]
        if len(bits) > 1 and bits[0] in PARTICLES:
            tokens += bits
        elif bits:
            tokens.append("".join(bits) if not all(len(b) == 1 for b in bits) else " ".join(bits))
    tokens = " ".join(tokens).split()
    long = [t for t in tokens if len(t) > 1]
    initials = "".join(t for t in tokens if len(t) == 1)
    core = [t for t in long if t not in PARTICLES]
    if len(core) >= 2:
        joined = []
        if len(core) == 3 and len(long) == 3 and not initials:
            joined = [" ".join(sorted((core[0] + core[1], core[2]))), " ".join(sorted((core[0], core[1] + core[2])))]
        # every choice of full names for the nicknames among the parts
        for full in product(*([t, *NICKNAMES.get(t, ())] for t in long)):
            if list(full) != long:
                joined.append(" ".join(sorted(full)))
        return "p", " ".join(sorted(long)), joined, initials
    if core and initials:
        return "i", " ".join(sorted(long)), [], initials
    return "o", " ".join(sorted(words)), [], ""


_PARSED = "name string, kind string, form string, joined array<string>, initials string"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [forms(n) for n in b["name"]]
        yield pd.DataFrame({"name": b["name"], "kind": [g[0] for g in got], "form": [g[1] for g in got], "joined": [g[2] for g in got], "initials": [g[3] for g in got]})


def spellings(names: DataFrame) -> DataFrame:
    """Distinct spellings of a one-column table of names, with their forms."""
    return names.where("trim(name) != ''").groupBy("name").agg(F.count("*").alias("n")).select("name").mapInPandas(_parse, _PARSED)


# --- one mistyped letter -------------------------------------------------------------------------------------------


def near(a: str, b: str) -> bool:
    """Whether one inserted, dropped, changed or swapped letter turns a into b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (len(a) > i + 1 and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    short, long = sorted((a, b), key=len)
    return short[i:] == long[i + 1 :]


_DELETED = "form string, part string, rest string, variant string"


def _deletions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every form with one letter of one part left out, and each part as it is."""
    for b in batches:
        out: list[tuple[str, str, str, str]] = []
        for form in b["form"]:
            parts = form.split(" ")
            for k, p in enumerate(parts):
                if len(p) < 4 or p in PARTICLES:
                    continue
                rest = " ".join(parts[:k] + parts[k + 1 :])
                out += [(form, p, rest, v) for v in {p, *(p[:i] + p[i + 1 :] for i in range(len(p)))}]
        yield pd.DataFrame(out, columns=["form", "part", "rest", "variant"])


LONGEST = 5
#: Letter sequences that are broadcast: those seen so often that there can't be more of them than this; rarer ones are joined.
MOST_SEQUENCES = 400_000


def sequences(part: str) -> list[str]:
    """The distinct letter sequences of a part."""
    s = f"^{part}$"
    return list(dict.fromkeys(s[i : i + n] for i in range(len(s)) for n in range(1, min(LONGEST, len(s) - i) + 1)))


def plausibility(part: str, counts: Mapping[str, int]) -> float:
    """Log probability of a part from the letter sequences of the other parts: its own are taken out."""
    s, total = f"^{part}$", 0.0
    for i in range(1, len(s)):
        for n in range(min(LONGEST - 1, i), -1, -1):
            seen = counts.get(s[i - n : i + 1], 0) - 1
            if seen > 0:
                of = counts.get(s[i - n : i], 0) - 1 if n else counts[""]
                total += np.log(seen / max(of, seen)) + (min(LONGEST - 1, i) - n) * np.log(0.4)
                break
        else:
            total += np.log(0.5 / counts[""]) + LONGEST * np.log(0.4)
    return total + PER_LETTER * len(part)


#: A part is taken for mistyped where it is so many times rarer than its neighbour, or its letters less likely by so many nats;
#: a part that is found in such a share of the forms, and in so many at least, is a part of its own. A longer part is less likely
#: by so much for each letter.
RARER_PART, LESS_LIKELY, KNOWN_SHARE, KNOWN_LEAST, PER_LETTER = 12.0, 2.5, 2.3e-4, 15, 1.6


def parts_of(people: DataFrame) -> DataFrame:
    """(part, df): in how many forms a part is found."""
    return cut(people.select(F.explode(F.split("form", " ")).alias("part")).groupBy("part").agg(F.count("*").alias("df")))


def mistyped(people: DataFrame, parts: DataFrame) -> DataFrame:
    """(form, target): forms of persons that are one letter away from a likelier form.

    Forms meet by what they have left without one letter of one part; no more distinct forms can share that than there are
    strings one letter away, so no such group grows with the data.
    """
    known = max(KNOWN_LEAST, KNOWN_SHARE * people.count())
    s = F.concat(F.lit("^"), F.col("part"), F.lit("$"))
    at = F.sequence(F.lit(1), F.length("part") + 2)
    grams = F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("part") + 3 - i)), lambda n: F.substring(s, i, n))))
    letters = parts.where("length(part) > 3").select(F.explode(grams).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    letters = cut(letters)
    single = letters.where("length(t) = 1").agg(F.sum("n")).first()[0] or 1
    least = max(2, single * LONGEST // MOST_SEQUENCES)
    counts = {r[0]: r[1] for r in letters.where(F.col("n") >= least).toLocalIterator()} | {"": single}
    shared = people.sparkSession.sparkContext.broadcast(counts)

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, t) for p in b["part"] for t in sequences(p) if t not in shared.value], columns=["part", "t"])

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [ChainMap(dict(r), shared.value) if r is not None else shared.value for r in b["rare"]]
            yield b.assign(rarest=[plausibility(p, c) for p, c in zip(b["part"], own, strict=True)])[["part", "df", "rarest"]]

    # a sequence seen once is only in its own part, which doesn't count
    rare = F.lit(None).cast("map<string,long>")
    if least > 2:
        few = parts.select("part").mapInPandas(others, "part string, t string").join(letters.where((F.col("n") > 1) & (F.col("n") < least)), "t")
        few = few.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("t", "n"))).alias("few"))
        parts, rare = parts.join(few, "part", "left"), F.col("few")
    rated = parts.select("part", "df", rare.alias("rare")).mapInPandas(rate, "part string, df long, rarest double")
    d = people.select("form").mapInPandas(_deletions, _DELETED)
    d = cut(d.join(rated, "part").withColumn("h", F.xxhash64("rest", "variant")).drop("variant", "rest"))
    a, b = (d.select("h", *[F.col(c).alias(f"{x}_{c}") for c in ("form", "part", "df", "rarest")]) for x in "ab")
    # a may be a mistyped b only if one of its measures is far lower; most forms have no such partner
    likelier = (F.col("b_df") >= RARER_PART * F.col("a_df")) | (F.col("a_df") < known) & (F.col("b_rarest") >= F.col("a_rarest") + LESS_LIKELY)
    pairs = a.join(b, "h").where((F.col("a_form") != F.col("b_form")) & likelier).select("a_form", "b_form", "a_part", "b_part", "b_df", "b_rarest", "a_rarest").distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            ok = [near(p, q) for p, q in zip(x["a_part"], x["b_part"], strict=True)]
            yield x[pd.Series(ok, index=x.index, dtype=bool)]

    pairs = pairs.mapInPandas(verify, pairs.schema)
    best = F.max_by("b_form", F.struct("b_rarest", "b_df", "b_form"))
    found = pairs.groupBy("a_form").agg(best.alias("target"))
    return found.withColumnRenamed("a_form", "form")


# --- entities ------------------------------------------------------------------------------------------------------


def entities(names: DataFrame) -> DataFrame:
    """(name, entity, score): every distinct spelling, the form that stands for its entity, and how rare that form is.

    score: decimal logarithm of the number of forms over those that share the entity's rarest part; the rarer
    the parts are that a rewriting keeps, the less likely it is another's by chance.
    """
    s = cut(spellings(names))
    people = s.where("kind = 'p'").groupBy("form").agg(F.array_distinct(F.flatten(F.collect_list("joined"))).alias("joined"), F.collect_set("initials").alias("middles"))
    people = cut(people)
    # joined syllables: only where the joined form stands for itself
    known = people.select(F.col("form").alias("target"))
    joins = people.select("form", F.explode("joined").alias("target")).join(known, "target", "left_semi").groupBy("form").agg(F.min("target").alias("joined_to"))
    parts = parts_of(people)
    typed = mistyped(people, parts)
    root = (
        people.join(joins, "form", "left")
        .join(typed, "form", "left")
        .select("form", "middles", F.coalesce("joined_to", "target", "form").alias("r1"), F.coalesce("joined_to", "target").isNotNull().alias("moved"))
    )
    root = cut(root)
    # a target may itself be rewritten once more
    again = root.where("moved").select(F.col("form").alias("r1"), F.col("r1").alias("r2"))
    root = root.join(again, "r1", "left").select("form", "middles", F.coalesce("r2", "r1").alias("entity"))
    person_names = s.where("kind = 'p'").join(root, "form").select("name", F.concat(F.lit("p "), "entity").alias("entity"))
    # initials: each person's forms with one part shortened; a form that one entity alone has links
    short = root.select("entity", "middles", F.split("form", " ").alias("t"))
    one = F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.size("t") - 1), lambda i: F.struct(i.alias("i"), F.element_at("t", i + 1).alias("w"))), lambda x: ~x["w"].isin(*PARTICLES)))
    short = short.select("entity", "middles", "t", one.alias("o")).select(
        "entity",
        F.explode(F.when(F.size("middles") > 0, F.col("middles")).otherwise(F.array(F.lit("")))).alias("middle"),
        F.array_join(F.filter("t", lambda w, i: i != F.col("o.i")), " ").alias("rest"),
        F.substring("o.w", 1, 1).alias("initial"),
    )
    # what one entity alone has: by the initial, and by the other initials too where both sides have them
    single = lambda *by: short.groupBy(*by).agg(F.min("entity").alias("e"), F.max("entity").alias("other"))
    by_initial, by_all = single("rest", "initial"), single("rest", "initial", "middle").where("middle != ''").withColumnRenamed("middle", "second")
    i = s.where("kind = 'i'").select("name", F.col("form").alias("rest"), F.col("initials").alias("given"), F.explode(F.array_distinct(F.array(F.substring("initials", 1, 1), F.substring("initials", -1, 1)))).alias("initial"))
    second = F.expr("if(length(given) > 1, if(substring(given, 1, 1) = initial, substring(given, 2), substring(given, 1, length(given) - 1)), '')")
    linked = i.withColumn("second", second).join(by_initial, ["rest", "initial"]).join(by_all.withColumnsRenamed({"e": "exact", "other": "exact_other"}), ["rest", "initial", "second"], "left")
    linked = linked.withColumn("entity", F.when(F.col("exact").isNotNull(), F.when(F.col("exact") == F.col("exact_other"), F.col("exact"))).when(F.col("e") == F.col("other"), F.col("e")))
    linked = linked.where("entity is not null").groupBy("name").agg(F.min("entity").alias("e"), F.max("entity").alias("other")).where("e = other").select("name", F.concat(F.lit("p "), "e").alias("entity"))
    alone = s.where("kind = 'i'").join(linked, "name", "left_anti").select("name", F.concat(F.lit("i "), "form", F.lit("/"), "initials").alias("entity"))
    rest = s.where("kind in ('h', 'o')").select("name", F.concat("kind", F.lit(" "), "form").alias("entity"))
    found = person_names.unionByName(linked).unionByName(alone).unionByName(rest)
    forms_ = people.count()
    persons = found.where("startswith(entity, 'p ')").select("entity").distinct()
    rarest = persons.select("entity", F.explode(F.split(F.substring("entity", F.lit(3), F.length("entity")), " ")).alias("part")).join(parts, "part").groupBy("entity").agg(F.min("df").alias("df"))
    score = F.log10(F.lit(float(max(forms_, 1))) / F.coalesce("df", F.lit(1)))
    return found.join(rarest, "entity", "left").select("name", "entity", F.round(score, 4).alias("score"))


def author_names(papers: DataFrame) -> DataFrame:
    return papers.select(F.explode("authors").alias("name"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cut(entities(author_names(read(spark, sf_dir, "papers", "authors"))).select("name", "entity"))
    a, b = e.select("entity", F.col("name").alias("name_a")), e.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b").distinct()


def p7_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with its entity and the rarity of the form that links it."""
    return entities(author_names(read(spark, sf_dir, "papers", "authors")))


QUERIES = {"p7_found": p7_found, "p7_entities": p7_entities}
SQL: dict[str, str] = {}
