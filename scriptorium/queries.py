"""The registered queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.functions.cjk import nfkc, segmenter
from scriptorium.functions.stem import stems, stems_sql
from scriptorium.operators import index as I
from scriptorium.operators import records as R
from scriptorium.operators.keywords import ranked_keywords, with_final_keywords
from scriptorium.plans.search import Searcher, expand, query_batch
from scriptorium.shared import shared_folder
from scriptorium.sources import files
from scriptorium.sources.corpus import stopword_set
from scriptorium.streaming.ingest import report

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table; one of fewer splits than there are cores is small, and spread so that all of them work on it."""
    df, cores = spark.read.parquet(f"{d}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("papers", "documents") and df.rdd.getNumPartitions() < cores // 2 else df


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").withColumnRenamed("id", "paper_id")


def stop(spark: SparkSession, d: str) -> set[str]:
    return stopword_set(table(spark, d, "stopwords").select("word"))


def built_index(spark: SparkSession, d: str) -> I.Index:
    return I.build(corpus(spark, d).select("paper_id", "title", "abstract", "keywords", "year"), stop(spark, d))


def _state(spark: SparkSession, d: str) -> str:
    """Digest of the files that the index is made from: their names, lengths and times."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    seen = [d]
    for t in ("papers", "stopwords"):
        path = hadoop.Path(f"{d}/{t}.parquet")
        seen += [f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in path.getFileSystem(conf).listStatus(path)]
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()[:32]


def index(spark: SparkSession, d: str) -> I.Index:
    """The stored index of the corpus: built and written to the shared folder once a session, then read from there."""
    path = f"{shared_folder(spark)}/index-{_state(spark, d)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/spellings/_SUCCESS")  # what is written last
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        built_index(spark, d).write(path)
    return I.Index.read(spark, path)


def searcher(spark: SparkSession, d: str) -> Searcher:
    return Searcher(index(spark, d), stop(spark, d), bilingual=table(spark, d, "bilingual"))


def long(*columns: str) -> list:
    return [F.col(c).cast("long").alias(c) for c in columns]


# --- SQL that the queries' oracles share ---------------------------------------------------------------------------

_HAN = r"[\x{4e00}-\x{9fff}]"
_RUNS = rf"'{_HAN}+|[A-Za-z][A-Za-z0-9_\-]*'"


def _token_list(text: str) -> str:
    pairs = "CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END"
    return f"flatten(list_transform(regexp_extract_all({text}, {_RUNS}), lambda r: CASE WHEN regexp_matches(r, '^{_HAN}') THEN {pairs} ELSE [lower(r)] END))"


_TEXT = "concat_ws(chr(10), coalesce(title, ''), coalesce(abstract, ''), CASE WHEN len(keywords) > 0 THEN array_to_string(keywords, ' ') END)"
_SW = "sw AS (SELECT DISTINCT lower(trim(word)) AS w FROM stopwords WHERE word IS NOT NULL AND trim(word) <> '' AND NOT starts_with(lower(trim(word)), '#'))"


def _tokens(source: str, text: str, name: str = "tok", id_: str = "id") -> str:
    return f"""raw_{name} AS (SELECT paper_id, unnest(l) AS word, generate_subscripts(l, 1) AS p FROM (SELECT {id_} AS paper_id, {_token_list(text)} AS l FROM {source})),
{name} AS (SELECT paper_id, word, row_number() OVER (PARTITION BY paper_id ORDER BY p) - 1 AS pos FROM raw_{name} WHERE word NOT IN (SELECT w FROM sw))"""


def _with(source: str = "papers", text: str = _TEXT) -> str:
    return f"""WITH {_SW},
{_tokens(source, text)},
voc AS (SELECT word, count(*) AS freq, min(struct_pack(d := paper_id, p := pos)) AS f FROM tok GROUP BY word),
st AS ({stems_sql("voc")}),
posts AS (SELECT term, paper_id, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM tok JOIN st USING (word) GROUP BY term, paper_id),
df AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
disp AS (SELECT term, arg_max(word, struct_pack(a := freq, b := -f.d, c := -f.p)) AS display FROM voc JOIN st USING (word) GROUP BY term),
n AS (SELECT count(*) AS n FROM papers)
"""


BASE = _with()


def _hits(leaf: str, term: str) -> str:
    return f"SELECT '{leaf}' AS leaf, paper_id, tf FROM posts WHERE term = '{term}'"


def _phrase(leaf: str, terms: list[str]) -> str:
    starts = " UNION ALL ".join(f"SELECT paper_id, unnest(positions) - {i} AS s, {i} AS i FROM posts WHERE term = '{t}'" for i, t in enumerate(terms))
    return f"SELECT '{leaf}' AS leaf, paper_id, count(*) AS tf FROM (SELECT paper_id, s FROM ({starts}) WHERE s >= 0 GROUP BY paper_id, s HAVING count(DISTINCT i) = {len(terms)}) GROUP BY paper_id"


def _ranked(leaves: list[str], having: str, tfidf: bool) -> str:
    part = "tf * (ln((n.n + 1.0) / (ldf.df + 1.0)) + 1.0)" if tfidf else "CAST(tf AS DOUBLE)"
    return f"""{BASE}, hits AS ({" UNION ALL ".join(leaves)}), ldf AS (SELECT leaf, count(*) AS df FROM hits GROUP BY leaf)
SELECT paper_id, round(sum({part}), 4) AS score FROM hits JOIN ldf USING (leaf) CROSS JOIN n GROUP BY paper_id HAVING {having}"""


def _has(leaf: str) -> str:
    return f"bool_or(leaf = '{leaf}')"


# --- tokens, stems, index ------------------------------------------------------------------------------------------


@query(f"WITH {_SW}, {_tokens('papers', _TEXT)} SELECT count(*) AS tokens, count(DISTINCT word) AS words, CAST(sum(length(word)) AS BIGINT) AS characters FROM tok")
def tokens_count(spark, d):
    rows = I.token_rows(corpus(spark, d), stop(spark, d))
    return rows.agg(F.count("*").alias("tokens"), F.countDistinct("word").alias("words"), F.sum(F.length("word")).alias("characters"))


@query(f"WITH {_SW}, {_tokens('papers', _TEXT)} SELECT paper_id, pos, word FROM tok")
def token_positions(spark, d):
    return I.token_rows(corpus(spark, d), stop(spark, d)).select("paper_id", F.col("pos").cast("long").alias("pos"), "word")


@query(f"""WITH {_SW}, doc AS (SELECT doc_id, text FROM documents), {_tokens('doc', "coalesce(text, '')", id_='doc_id')} SELECT word, count(*) AS n FROM tok GROUP BY word""")
def document_vocabulary(spark, d):
    rows = table(spark, d, "documents").select(F.explode(X.tokens(F.col("text"), stop(spark, d))).alias("word"))
    return rows.groupBy("word").agg(F.count("*").alias("n"))


@query(f"{BASE} SELECT word, term FROM st")
def vocabulary_stems(spark, d):
    return stems(I.token_rows(corpus(spark, d), stop(spark, d)).select("word").distinct())


@query(f"{BASE} SELECT term, paper_id, tf, array_to_string(positions, ' ') AS positions FROM posts")
def postings(spark, d):
    """The postings built from the texts; the other queries read the stored index."""
    return built_index(spark, d).postings.select("term", "paper_id", *long("tf"), F.array_join("positions", " ").alias("positions"))


@query(f"{BASE} SELECT term, df FROM df")
def term_document_frequency(spark, d):
    return I.document_frequency(index(spark, d).postings)


@query(f"{BASE} SELECT term, display FROM disp")
def term_display(spark, d):
    return I.displays(index(spark, d).spellings)


@query(f"{BASE} SELECT (SELECT n FROM n) AS total_papers, count(DISTINCT term) AS unique_terms, count(*) AS total_postings, (SELECT count(*) FROM sw) AS stopwords_count FROM posts")
def index_stats(spark, d):
    return I.stats(index(spark, d), len(stop(spark, d)))


@query(
    f"""{BASE}, top AS (SELECT term, df FROM df ORDER BY df DESC, term LIMIT 20)
SELECT term, display, df, string_agg(concat(paper_id, ':', tf), ' ' ORDER BY paper_id) AS postings FROM top JOIN posts USING (term) JOIN disp USING (term) GROUP BY ALL"""
)
def index_snapshot(spark, d):
    s = I.snapshot(index(spark, d), 20)
    return s.select("term", "display", "df", F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["paper_id"].cast("string"), p["tf"].cast("string"))), " ").alias("postings"))


@query(f"{BASE} SELECT term, display, df FROM df JOIN disp USING (term) ORDER BY df DESC, lower(term), term LIMIT 50 OFFSET 50")
def terms_page(spark, d):
    return I.page(I.term_rows(index(spark, d)), 2, 50, *I.by_frequency())


@query(f"{BASE} SELECT term, display, df FROM df JOIN disp USING (term) WHERE contains(lower(term), 'attent') OR contains(lower(display), 'attent')")
def terms_filter(spark, d):
    return I.filter_terms(I.term_rows(index(spark, d)), " Attent ")


@query(f"{BASE} SELECT word AS orig, CAST(sum(freq) AS BIGINT) AS freq FROM voc GROUP BY word")
def completion_vocabulary(spark, d):
    return I.completions(index(spark, d).spellings)


@query(f"{BASE} SELECT term, CAST(sum(tf) AS BIGINT) AS tf FROM posts GROUP BY term")
def stem_frequencies(spark, d):
    return I.stem_vocabulary(index(spark, d).postings)


@query(f"{BASE} SELECT word, freq FROM voc WHERE starts_with(word, 'comp') ORDER BY freq DESC, word LIMIT 10")
def suggest_prefix(spark, d):
    return I.suggest(index(spark, d), " Comp ", 10)


@query(f"{BASE} SELECT term AS word, CAST(sum(freq) AS BIGINT) AS freq FROM voc JOIN st USING (word) WHERE contains(term, 'etri') GROUP BY term ORDER BY freq DESC, term DESC LIMIT 10")
def suggest_substring(spark, d):
    """No word begins so, hence the terms that hold it."""
    return I.suggest(index(spark, d), "etri", 10)


@query("SELECT coalesce(nullif(language, ''), 'en') AS language, count(*) AS papers FROM papers GROUP BY 1")
def language_histogram(spark, d):
    return I.language_histogram(table(spark, d, "papers"))


# --- searching -----------------------------------------------------------------------------------------------------


def _found(hits: DataFrame) -> DataFrame:
    return hits.select("paper_id", "score")


@query(_ranked([_hits("attent", "attent"), _hits("layer", "layer")], "count(*) = 2", False))
def keyword_and_tf(spark, d):
    return _found(searcher(spark, d).keywords("attention layers"))


@query(_ranked([_hits("attent", "attent"), _hits("layer", "layer")], "count(*) = 2", True))
def keyword_and_tfidf(spark, d):
    return _found(searcher(spark, d).keywords("the attention layer", "tfidf"))


@query(_ranked([_hits("tree", "tree"), _hits("index", "index")], f"{_has('tree')} OR {_has('index')}", False))
def boolean_or(spark, d):
    return _found(searcher(spark, d).boolean("tree OR index"))


@query(_ranked([_hits("retrieval", "retriev"), _hits("survey", "survei")], f"{_has('retrieval')} AND NOT {_has('survey')}", True))
def boolean_and_not(spark, d):
    return _found(searcher(spark, d).boolean("retrieval NOT survey", "tfidf"))


@query(_ranked([_hits("noisy", "noisi"), _hits("sparse", "spars"), _hits("trees", "tree"), _hits("tree", "tree")], f"({_has('noisy')} OR {_has('sparse')}) AND ({_has('trees')} AND {_has('tree')})", True))
def boolean_nested(spark, d):
    return _found(searcher(spark, d).boolean("(noisy OR sparse) AND (trees tree)", "tfidf"))


@query(f"{BASE} SELECT id AS paper_id, 0.0::DOUBLE AS score FROM papers WHERE id NOT IN (SELECT paper_id FROM posts WHERE term = 'the' OR term = 'model')")
def boolean_pure_not(spark, d):
    return _found(searcher(spark, d).boolean("NOT (model OR models)"))


@query(_ranked([_phrase("x", ["topic", "model"])], "true", False))
def phrase_match(spark, d):
    return _found(searcher(spark, d).boolean('"topic models"'))


@query(_ranked([_phrase("p", ["loss", "function"]), _phrase("q", ["ablat", "show"]), _hits("recall", "recal")], f"{_has('p')} OR {_has('q')} AND {_has('recall')}", True))
def phrase_tfidf(spark, d):
    return _found(searcher(spark, d).boolean('"loss functions" OR "ablation shows" recall', "tfidf"))


@query(_ranked([_hits("corpu", "corpu"), _hits("decod", "decod")], "true", True))
def union_ranked(spark, d):
    return _found(searcher(spark, d).union(["corpu", "decod", "nosuchterm"], "tfidf"))


@query(
    _ranked([_hits("corpu", "corpu")], "true", True).replace("SELECT paper_id, round", "SELECT paper_id, round", 1)
    + " ORDER BY score DESC, paper_id LIMIT 50"
)
def search_top_k(spark, d):
    """The ranked page of a search: the 50 best hits."""
    return searcher(spark, d).search("corpus", "tfidf").ranked.select("paper_id", "score")


@query(
    f"""{BASE}, q(i, word) AS (VALUES (0, 'graph encoder'), (1, '主题模型'), (2, 'nothing'), (3, 'Topic Model')),
k AS (SELECT i, word, CASE WHEN regexp_matches(word, '{_HAN}') THEN trim(word) ELSE lower(trim(word)) END AS key FROM q),
dict AS (SELECT lower(trim(en)) AS en, trim(zh) AS zh, ord FROM bilingual WHERE trim(en) <> '' AND trim(zh) <> '')
SELECT CAST(i AS BIGINT) AS i, word, 'zh' AS lang, zh AS synonym FROM k JOIN dict ON key = en UNION ALL SELECT CAST(i AS BIGINT), word, 'en', en FROM k JOIN dict ON key = zh"""
)
def translate_expand(spark, d):
    q = spark.createDataFrame([(0, "graph encoder"), (1, "主题模型"), (2, "nothing"), (3, "Topic Model")], "i long, word string")
    return expand(q, table(spark, d, "bilingual")).select("i", "word", "lang", "synonym")


@query(
    f"""{BASE}, said AS (SELECT '主题模型' AS s UNION ALL SELECT en FROM bilingual WHERE trim(zh) IN ('主题', '题模', '模型', '主题模型', '主题 题模', '题模 模型', '主题 题模 模型') AND trim(en) <> ''),
qt AS (SELECT unnest({_token_list("s")}) AS word FROM said),
q AS (SELECT DISTINCT term FROM (SELECT DISTINCT word FROM qt WHERE word NOT IN (SELECT w FROM sw)) JOIN ({stems_sql("(SELECT DISTINCT word FROM qt)")}) USING (word))
SELECT paper_id, round(sum(CAST(tf AS DOUBLE)), 4) AS score FROM posts JOIN q USING (term) GROUP BY paper_id"""
)
def cross_language_search(spark, d):
    """Documents of either language for a query in one."""
    return _found(searcher(spark, d).cross_language("主题模型")[0])


@query(
    f"""{BASE}, qt AS (SELECT ord, unnest(l) AS word FROM (SELECT ord, {_token_list("en")} AS l FROM bilingual)),
q AS (SELECT DISTINCT ord AS query_id, term FROM (SELECT ord, word FROM qt WHERE word NOT IN (SELECT w FROM sw)) JOIN ({stems_sql("(SELECT DISTINCT word FROM qt)")}) USING (word)),
sz AS (SELECT query_id, count(*) AS terms FROM q GROUP BY query_id)
SELECT CAST(query_id AS BIGINT) AS query_id, paper_id, round(sum(tf * (ln((n.n + 1.0) / (df.df + 1.0)) + 1.0)), 4) AS score
FROM q JOIN posts USING (term) JOIN df USING (term) JOIN sz USING (query_id) CROSS JOIN n GROUP BY query_id, paper_id, terms HAVING count(*) = terms"""
)
def query_batch_and(spark, d):
    """Every English dictionary entry as a keyword query, all at once."""
    i, sw = index(spark, d), stop(spark, d)
    words = table(spark, d, "bilingual").select(F.col("ord").cast("long").alias("query_id"), F.explode(X.tokens(F.col("en"), sw)).alias("word"))
    q = words.join(stems(words.select("word").distinct()), "word").select("query_id", "term").distinct()
    return query_batch(i.postings, q, i.papers.count())


# --- keywords ------------------------------------------------------------------------------------------------------

_KEYWORDS = f"""{BASE},
{_tokens('papers', "coalesce(title, '')", 'tt')},
{_tokens('papers', "coalesce(abstract, '')", 'ta')},
wt AS (SELECT paper_id, word, sum(w) AS w, min(p) AS first FROM (SELECT paper_id, word, 2 AS w, pos AS p FROM tt UNION ALL SELECT paper_id, word, 1, pos + 16777216 FROM ta) GROUP BY paper_id, word),
pt AS (SELECT paper_id, term, sum(w) AS tf, arg_max(word, struct_pack(a := w, b := -first)) AS keyword FROM wt JOIN ({stems_sql("(SELECT DISTINCT word FROM wt)")}) USING (word) WHERE length(term) >= 2 GROUP BY paper_id, term),
sc AS (SELECT paper_id, term, keyword, round(tf * (ln((n.n + 1.0) / (coalesce(df.df, 0) + 1.0)) + 1.0), 4) AS score FROM pt LEFT JOIN df USING (term) CROSS JOIN n),
pl AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, term) AS place FROM sc),
un AS (SELECT paper_id, keyword, min(place) AS place, arg_min(score, place) AS score FROM pl GROUP BY paper_id, keyword),
kw AS (SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY place) AS rank, keyword, score FROM un QUALIFY rank <= 8)
"""


@query(f"{_KEYWORDS} SELECT paper_id, rank, keyword, score FROM kw")
def record_keywords(spark, d):
    i = index(spark, d)
    known = i.spellings.select(F.col("orig").alias("word"), "term")
    ranked = ranked_keywords(corpus(spark, d).select("paper_id", "title", "abstract"), I.document_frequency(i.postings), i.papers.count(), stop(spark, d), known=known)
    return ranked.select("paper_id", *long("rank"), "keyword", "score")


@query(
    f"""{_KEYWORDS}, lists AS (SELECT paper_id, string_agg(keyword, ' ' ORDER BY rank) AS words FROM kw GROUP BY paper_id),
again AS (SELECT id, concat_ws(chr(10), coalesce(title, ''), coalesce(abstract, ''), words) AS text FROM papers LEFT JOIN lists ON lists.paper_id = papers.id),
{_tokens('again', 'text', 'rt')},
rp AS (SELECT term, paper_id, count(*) AS tf FROM rt JOIN ({stems_sql("(SELECT DISTINCT word FROM rt)")}) USING (word) GROUP BY term, paper_id)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM rp GROUP BY term"""
)
def reindexed_postings(spark, d):
    """Term totals after extracted keywords replaced the records' own and were indexed."""
    i = with_final_keywords(corpus(spark, d).select("paper_id", "title", "abstract", "keywords"), stop(spark, d))
    return i.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


# --- records -------------------------------------------------------------------------------------------------------



def _compatibility() -> str:
    """Rows (character, compatibility form) of all characters that have one beyond their canonical form."""
    rows = []
    for o in (*range(0xA0, 0xD800), *range(0xF900, 0x30000)):
        c = chr(o)
        form = unicodedata.normalize("NFKC", c)
        if form != unicodedata.normalize("NFC", c):
            rows.append(f"({o},'{form.replace(chr(39), chr(39) * 2)}')")
    return ",".join(rows)


def _comp(x: str) -> str:
    """Words in lower case with single spaces; a capital sigma at the end of a word has a form of its own, which DuckDB doesn't know."""
    words = f"regexp_replace(coalesce({x}, ''), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
    return f"lower(trim(regexp_replace({words}, '(\\p{{L}})Σ([^\\p{{L}}]|$)', '\\1ς\\2', 'g')))"


# title, abstract and names in compatibility form, each character looked up; k has the records with their keys t, a, x
_KEYED = f"""nf AS (SELECT chr(o) AS c, form FROM (VALUES {_compatibility()}) v(o, form)),
raw AS (SELECT id, 't' AS f, 0 AS k, title AS s FROM papers UNION ALL SELECT id, 'x', 0, abstract FROM papers
  UNION ALL SELECT id, 'a', generate_subscripts(authors, 1), unnest(authors) FROM papers),
chars AS (SELECT id, f, k, unnest(l) AS c, generate_subscripts(l, 1) AS p FROM (SELECT id, f, k, regexp_extract_all(s, '(?s).') AS l FROM raw WHERE strlen(s) <> length(s))),
formed AS (SELECT id, f, k, nfc_normalize(string_agg(coalesce(form, c), '' ORDER BY p)) AS s FROM chars LEFT JOIN nf USING (c) GROUP BY id, f, k),
texts AS (SELECT id, f, k, coalesce(formed.s, raw.s) AS s FROM raw LEFT JOIN formed USING (id, f, k)),
named AS (SELECT id, array_to_string(list_sort(list({_comp("s")})), '|') AS a FROM texts WHERE f = 'a' AND regexp_matches(s, '[^\\s\\x{{a0}}\\x{{3000}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}]') GROUP BY id),
k AS (SELECT p.*, {_comp("tt.s")} AS t, coalesce(named.a, '') AS a, {_comp("xx.s")} AS x FROM papers p JOIN texts tt ON tt.id = p.id AND tt.f = 't' JOIN texts xx ON xx.id = p.id AND xx.f = 'x' LEFT JOIN named ON named.id = p.id)"""
_GROUPS = f"WITH {_KEYED}, g AS (SELECT t, a, year AS y, x, count(*) AS papers, min(id) AS first_id FROM k GROUP BY ALL)"


@query(f"{_GROUPS} SELECT first_id, papers FROM g WHERE papers > 1")
def content_groups(spark, d):
    """Records of the same content: the first id and how many there are."""
    p = corpus(spark, d)
    return p.groupBy(R.key_of().alias("k")).agg(F.min("paper_id").alias("first_id"), F.count("*").alias("papers")).where("papers > 1").select("first_id", "papers")


@query(f"{_GROUPS} SELECT first_id AS paper_id FROM g")
def first_by_content(spark, d):
    return R.first_by_key(corpus(spark, d)).select("paper_id")


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Papers crawled from one catalogue as the library, all others as arrivals."""
    p = corpus(spark, d).withColumn("ord", F.col("paper_id"))
    crawled = F.coalesce(F.col("source") == "arxiv", F.lit(False))
    return p.where(crawled), p.where(~crawled)


_OLD, _NEW = "coalesce(source = 'arxiv', false)", "NOT coalesce(source = 'arxiv', false)"


def _merge(arrivals: str) -> str:
    """Rows of nw that are accepted: those that clash with no other at once, the others one after the other by id."""
    return f"""WITH RECURSIVE {_KEYED},
old AS (SELECT * FROM k WHERE {_OLD}), nw AS (SELECT * FROM k WHERE {arrivals}),
fresh AS (SELECT id, concat_ws('|', t, a, coalesce(CAST(year AS VARCHAR), ''), x) AS key, nullif(source_id, '') AS sid FROM nw
  WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.t = nw.t AND old.a = nw.a AND old.x = nw.x AND old.year IS NOT DISTINCT FROM nw.year)
  AND (source_id IS NULL OR source_id NOT IN (SELECT source_id FROM old WHERE source_id IS NOT NULL AND source_id <> ''))),
counted AS (SELECT *, count(*) OVER (PARTITION BY key) AS keys, CASE WHEN sid IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY sid) END AS sids FROM fresh),
clash AS (SELECT id, key, sid, row_number() OVER (ORDER BY id) AS n FROM counted WHERE keys > 1 OR sids > 1),
turn(n, keys, sids, id) AS (SELECT CAST(0 AS BIGINT), []::VARCHAR[], []::VARCHAR[], CAST(NULL AS BIGINT) UNION ALL
  SELECT n, CASE WHEN ok THEN list_append(keys, key) ELSE keys END, CASE WHEN ok AND sid IS NOT NULL THEN list_append(sids, sid) ELSE sids END, CASE WHEN ok THEN id END
  FROM (SELECT c.n, t.keys, t.sids, c.key, c.sid, c.id, NOT list_contains(t.keys, c.key) AND (c.sid IS NULL OR NOT list_contains(t.sids, c.sid)) AS ok FROM turn t JOIN clash c ON c.n = t.n + 1)),
added AS (SELECT id FROM counted WHERE keys = 1 AND sids = 1 UNION ALL SELECT id FROM turn WHERE id IS NOT NULL)
"""


_MERGE = _merge(_NEW)


@query(f"{_MERGE} SELECT id AS paper_id FROM added")
def merge_strict(spark, d):
    return R.merge_strict(*_split(spark, d)).select("paper_id")


@query(f"{_MERGE} SELECT (SELECT count(*) FROM added) AS added, (SELECT count(*) FROM nw) - (SELECT count(*) FROM added) AS skipped")
def merge_report(spark, d):
    old, new = _split(spark, d)
    return R.merge_report(new, R.merge_strict(old, new))


@query(
    f"""{_merge(_NEW + " AND title IS NOT NULL AND trim(title) <> ''")}
SELECT CASE WHEN title IS NULL OR trim(title) = '' THEN 'failed' WHEN id IN (SELECT id FROM added) THEN 'added' ELSE 'duplicated' END AS outcome, count(*) AS records FROM k WHERE {_NEW} GROUP BY 1"""
)
def ingest_report(spark, d):
    return report(*_split(spark, d))


@query(
    """WITH old AS (SELECT * FROM papers WHERE coalesce(source = 'arxiv', false) AND source_id <> '' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY id DESC) = 1),
nw AS (SELECT * FROM papers WHERE NOT coalesce(source = 'arxiv', false) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY id) = 1)
SELECT id AS paper_id, source_id FROM old UNION ALL SELECT id, source_id FROM nw WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.source_id = nw.source_id)"""
)
def merge_by_id(spark, d):
    return R.merge_by_id(*_split(spark, d)).select("paper_id", "source_id")


@query(
    """WITH r AS (SELECT id AS ord, CASE WHEN id % 3 = 0 THEN NULL ELSE id // 2 END AS given FROM papers),
m AS (SELECT *, given IS NOT NULL AND row_number() OVER (PARTITION BY given ORDER BY ord) = 1 AS keeps FROM r),
w AS (SELECT ord, row_number() OVER (ORDER BY ord) AS n FROM m WHERE NOT keeps),
f AS (SELECT range AS free, row_number() OVER (ORDER BY range) AS n FROM range((SELECT count(*) FROM r)) WHERE range NOT IN (SELECT given FROM m WHERE keeps))
SELECT ord, given AS paper_id FROM m WHERE keeps UNION ALL SELECT ord, free FROM w JOIN f USING (n)"""
)
def surrogate_ids(spark, d):
    """Ids where a third of the rows have none and the others come in pairs of equals."""
    rows = table(spark, d, "papers").select(F.when(F.col("id") % 3 != 0, F.expr("id div 2")).alias("paper_id"), F.col("id").alias("ord"))
    return R.numbered(rows).select("ord", "paper_id")


_ENDS = rf"^[{X.SPACE}]+|[{X.SPACE}]+$"


@query(
    f"""SELECT fetch_id AS paper_id, regexp_replace(coalesce(title, ''), '{_ENDS}', '', 'g') AS title,
len(list_filter(list_transform(string_split(authors, ','), lambda a: regexp_replace(a, '{_ENDS}', '', 'g')), lambda a: a <> '')) AS n_authors FROM fetched"""
)
def mapped_rows(spark, d):
    """All raw rows of the second catalogue in the corpus' form; without authors, an author string that is there counts 0."""
    raw = table(spark, d, "fetched").withColumn("none", F.col("authors").isNull())
    mapped = R.mapped(raw.withColumnRenamed("fetch_id", "id").withColumn("ord", F.col("none")))
    return mapped.select("paper_id", "title", F.when(~F.col("ord"), F.size("authors").cast("long")).alias("n_authors"))


@query("SELECT id AS paper_id FROM papers WHERE contains(lower(title), 'graph') OR contains(lower(abstract), 'graph') OR list_bool_or(list_transform(coalesce(authors, []::VARCHAR[]), lambda a: contains(lower(a), 'graph')))")
def library_filter(spark, d):
    return R.library(corpus(spark, d), " Graph ").select("paper_id")


@query("SELECT id AS paper_id, title FROM papers ORDER BY id LIMIT 20 OFFSET 40")
def library_page(spark, d):
    return I.page(R.library(corpus(spark, d)), 3, 20, "paper_id").select("paper_id", "title")


@query("SELECT id AS paper_id, title, year FROM papers WHERE id = 4")
def paper_lookup(spark, d):
    return R.paper(corpus(spark, d), 4).select("paper_id", "title", "year")


@query("SELECT id AS paper_id, concat(id, '_', left(sha256(coalesce(abstract, '')), 8), CASE WHEN file_name IS NULL THEN '.bin' ELSE regexp_extract(file_name, '(\\.[^./]+)$', 1) END) AS stored FROM papers")
def stored_names(spark, d):
    p = corpus(spark, d)
    return p.select("paper_id", R.stored_name(F.col("paper_id"), F.coalesce("abstract", F.lit("")).cast("binary"), F.coalesce("file_name", F.lit(""))).alias("stored"))


@query(
    f"""{BASE}, gone AS (SELECT id FROM papers WHERE year = 2025) SELECT term, count(*) AS df FROM posts WHERE paper_id NOT IN (SELECT id FROM gone) GROUP BY term"""
)
def removed_frequencies(spark, d):
    """Document frequencies after the records of one year were taken out."""
    i = index(spark, d)
    return I.document_frequency(I.remove(i, i.papers.where("year = 2025"), stop(spark, d)).postings)


@query(
    f"""{_with("(SELECT * FROM papers WHERE year IS DISTINCT FROM 2025)")} SELECT word AS orig, term, freq, f.d AS first_doc, f.p AS first_pos FROM voc JOIN st USING (word)"""
)
def removed_spellings(spark, d):
    """Spellings after the records of one year were taken out: as if the index were built without them."""
    i = index(spark, d)
    return I.remove(i, i.papers.where("year = 2025"), stop(spark, d)).spellings.select("orig", "term", "freq", "first_doc", *long("first_pos"))


# --- text functions ------------------------------------------------------------------------------------------------


@query(f"SELECT id AS paper_id, CASE WHEN regexp_matches(coalesce(title, ''), '{_HAN}') THEN CASE WHEN regexp_matches(title, '[A-Za-z]') THEN 'mixed' ELSE 'zh' END ELSE 'en' END AS lang FROM papers")
def detect_language(spark, d):
    return corpus(spark, d).select("paper_id", X.detect_language(F.col("title")).alias("lang"))


@query(r"SELECT id AS paper_id, CASE WHEN regexp_matches(source_id, '^https?://') THEN source_id WHEN regexp_matches(source_id, '^\d{4}\.\d{4,5}(v\d+)?$') THEN 'https://arxiv.org/abs/' || source_id END AS url FROM papers")
def external_url(spark, d):
    return corpus(spark, d).select("paper_id", X.external_url(F.col("source_id")).alias("url"))


@query(r"SELECT id AS paper_id, coalesce(nullif(regexp_extract(source_id, '(\d{4}\.\d{4,5})(v\d+)?', 1), ''), string_split(source_id, '/')[-1]) AS number FROM papers")
def preprint_numbers(spark, d):
    return corpus(spark, d).select("paper_id", X.preprint_id(F.col("source_id")).alias("number"))


@query(
    r"""WITH y AS (SELECT doc_id, CAST(unnest(list_transform(regexp_extract_all(concat(' ', regexp_replace(coalesce(text, ''), '([0-9]+)', ' \1 ', 'g'), ' '), ' ((?:19|20)[0-9]{2}) ', 1), lambda v: v)) AS INT) AS y FROM documents),
c AS (SELECT doc_id, y, count(*) AS n FROM y WHERE y BETWEEN 1990 AND 2100 GROUP BY ALL)
SELECT doc_id, CAST(arg_min(y, struct_pack(a := -n, b := y)) AS BIGINT) AS year FROM c GROUP BY doc_id"""
)
def usual_year(spark, d):
    return table(spark, d, "documents").select("doc_id", X.usual_year(F.col("text")).cast("long").alias("year")).where("year is not null")


@query("SELECT id AS paper_id, (CAST(length(coalesce(title, '')) BETWEEN 4 AND 300 AS INT) + CAST(length(coalesce(abstract, '')) >= 80 AS INT) + CAST(coalesce(len(authors), 0) > 0 AS INT) + CAST(year IS NOT NULL AS INT)) / 4.0 AS confidence FROM papers")
def parse_confidence(spark, d):
    return corpus(spark, d).select("paper_id", X.confidence(F.col("title"), F.col("abstract"), F.col("authors"), F.col("year")).alias("confidence"))


@query(
    r"""WITH s AS (SELECT DISTINCT file_name, regexp_replace(file_name, '\.[^.]*$', '') AS stem FROM papers WHERE file_name IS NOT NULL),
w AS (SELECT file_name, trim(regexp_replace(stem, '[^\p{L}\p{N}]+', ' ', 'g')) AS words FROM s)
SELECT file_name, left(CASE WHEN words = '' THEN '未命名文献' ELSE words END, 150) AS title FROM w"""
)
def titles_from_file_names(spark, d):
    return corpus(spark, d).where("file_name is not null").select("file_name").distinct().select("file_name", X.title_from_file_name(F.col("file_name")).alias("title"))


_MESSAGES = ["PdfReadError: EOF marker not found", "file has not been decrypted: pdf password", "'gb2312' codec can't decode byte", "BadZipFile", "FileNotFoundError", "strange"]


@query(
    "SELECT m AS message, CASE "
    + " ".join(f"WHEN regexp_matches(m, '{p.replace(chr(39), chr(39) * 2)}') THEN '{h}'" for p, h in X.PARSE_ERRORS)
    + f" ELSE '{X.UNKNOWN_ERROR}' END AS hint FROM (SELECT unnest([{', '.join(chr(39) + m.replace(chr(39), chr(39) * 2) + chr(39) for m in _MESSAGES)}]) AS m)"
)
def parse_error_messages(spark, d):
    return spark.createDataFrame([(m,) for m in _MESSAGES], "message string").select("message", X.parse_error_message(F.col("message")).alias("hint"))


@query("SELECT id AS paper_id, abstract FROM papers WHERE abstract IS NOT NULL")
def rebuilt_abstracts(spark, d):
    """Whole abstracts in any script, inverted to positions at each blank and put back in order."""
    p = corpus(spark, d).where("abstract is not null").repartition("paper_id")  # one exchange for both groupings
    words = p.select("paper_id", F.posexplode(F.split("abstract", " ")).alias("p", "w"))
    inverted = words.groupBy("paper_id", "w").agg(F.collect_list("p").alias("ps")).groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("m"))
    return inverted.select("paper_id", X.rebuilt_abstract(F.col("m")).alias("abstract"))


@query(f"WITH {_SW} SELECT w FROM sw")
def stopwords(spark, d):
    w = F.lower(F.trim("word"))
    return table(spark, d, "stopwords").select(w.alias("w")).where("w is not null and w != '' and not startswith(w, '#')").distinct()


@query("SELECT lower(trim(en)) AS en, string_agg(trim(zh), '|' ORDER BY ord) AS zh FROM bilingual WHERE trim(en) <> '' AND trim(zh) <> '' GROUP BY 1")
def dictionary(spark, d):
    rows = table(spark, d, "bilingual").select(F.lower(F.trim("en")).alias("en"), F.trim("zh").alias("zh"), "ord").where("en != '' and zh != ''")
    return rows.groupBy("en").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "zh"))), lambda x: x["zh"]), "|").alias("zh"))




def _re2(pattern: str) -> str:
    """A pattern of the text functions as DuckDB's engine has it: its word boundaries and blanks know ASCII only."""
    pattern = pattern.replace("(?iU)", "(?i)").replace("(?U)", "")
    if pattern.startswith(r"\b"):
        pattern = r"(?:^|[^\p{L}\p{N}_])" + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + r"(?:[^\p{L}\p{N}_]|$)"
    return "'" + pattern.replace(r"\S", f"[^{X.SPACE}]").replace(r"\s", f"[{X.SPACE}]").replace("'", "''") + "'"


def _is(pattern: str) -> str:
    return f"regexp_matches(s, {_re2(pattern)})"


_STRIP = lambda x: f"regexp_replace({x}, '{_ENDS}', '', 'g')"
_NOISE = " OR ".join(_is(p) for p in (X.SYMBOL_LINE, X.PAGE_LINE, X.PREPRINT_LINE, X.ADDRESS_LINE, X.PUBLICATION_LINE))


@query(
    f"""WITH l AS (SELECT doc_id, unnest(a) AS s, generate_subscripts(a, 1) AS p FROM (SELECT doc_id, list_transform(string_split_regex(coalesce(text, ''), '{X.LINE_BREAK}'), lambda x: {_STRIP("x")}) AS a FROM documents)),
body AS (SELECT doc_id, p, s, {_STRIP("regexp_replace(s, '[ " + chr(92) + "t" + chr(92) + "x{3000}]+', ' ', 'g')")} AS text FROM l
  WHERE NOT ({_NOISE} OR length(s) <= 90 AND {_is(X.INSTITUTION)} AND ({_is(X.POSTCODE)} OR NOT {_is(X.SENTENCE_MARK)}))),
fresh AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY doc_id ORDER BY p), '') AS before FROM body)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS line, text FROM fresh WHERE s <> before"""
)
def clean_document_lines(spark, d):
    """Lines of every document's body, in order."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(X.clean_lines(F.col("text"))).alias("line", "text"))
    return lines.select("doc_id", *long("line"), "text")


@query()
def chinese_words(spark, d):
    """Words of every paper with Chinese runs cut by the dictionary's lexicon."""
    lexicon = [r[0] for r in table(spark, d, "bilingual").select(F.trim("zh")).distinct().collect()]  # a dictionary of fixed size
    cut = segmenter(lexicon)
    rows = corpus(spark, d).select("paper_id", F.posexplode(cut(X.runs(I.index_text()))).alias("pos", "word"))
    return rows


@query(f"WITH {_KEYED} SELECT id AS paper_id, t AS title FROM k")
def compatibility_forms(spark, d):
    return corpus(spark, d).select("paper_id", X.comparable(nfkc(F.col("title"))).alias("title"))


@query()
def decoded_uploads(spark, d):
    return table(spark, d, "uploads").select("name", files.decoded("content").alias("d")).select("name", "d.charset", "d.text")


@query()
def parsed_uploads(spark, d):
    done = files.parse_files(table(spark, d, "uploads").select("name", "content"))
    return done.select("name", "title", F.array_join("authors", "; ").alias("authors"), "abstract", "year", "confidence", "no_text")


@query()
def repaired_titles(spark, d):
    """Titles whose misreading as a whole could be undone."""
    return corpus(spark, d).where(F.octet_length("title") != F.length("title")).select("paper_id", "title", files.repaired("title").alias("repaired")).where("title != repaired")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Keyword search ranked by TF-IDF: the ten best papers."""
    return searcher(spark, d).search("retrieval index", "tfidf", top_k=10).ranked.select("paper_id", "title", "score")


