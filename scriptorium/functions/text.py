"""Text functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"\x{4e00}-\x{9fff}"
# A token is a run of Chinese characters or a Latin word that may hold digits, dashes and underscores.
TOKEN = rf"([{HAN}]+|[A-Za-z][A-Za-z0-9\-_]*)"
SPACE = r"\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{85}\x{1c}-\x{1f}"


def strip(c: Column, more: str = "") -> Column:
    """Trims white space of any kind, and the characters of ``more`` (inside a class)."""
    return F.regexp_replace(c, rf"^[{SPACE}{more}]+|[{SPACE}{more}]+$", "")


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


# --- tokens --------------------------------------------------------------------------------------------------------


def runs(text: Column) -> Column:
    """Runs of Chinese characters and Latin words, in order."""
    return F.regexp_extract_all(text_or_empty(text), F.lit(TOKEN), 1)


def pairs_of_characters(run: Column) -> Column:
    """Overlapping pairs of a Chinese run; a single character stands for itself."""
    return F.when(F.length(run) == 1, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2))))


def is_han(c: Column) -> Column:
    return c.rlike(f"^[{HAN}]")


def tokens(text: Column, stopwords: set[str], segment=pairs_of_characters) -> Column:
    """Lower-case tokens without stopwords; a token's index is its position. ``segment`` splits a Chinese run."""
    flat = F.flatten(F.transform(runs(text), lambda r: F.when(is_han(r), segment(r)).otherwise(F.array(F.lower(r)))))
    return F.filter(flat, lambda w: ~w.isin(*sorted(stopwords))) if stopwords else flat


def detect_language(text: Column) -> Column:
    """zh, en or mixed, by the scripts present; en where neither is."""
    han, latin = text_or_empty(text).rlike(f"[{HAN}]"), text_or_empty(text).rlike("[A-Za-z]")
    return F.when(han & latin, "mixed").when(han, "zh").otherwise("en")


# --- comparable forms ----------------------------------------------------------------------------------------------


def comparable(text: Column) -> Column:
    """Words in lower case with single spaces between them; the text is expected in NFKC."""
    return F.lower(F.trim(F.regexp_replace(text_or_empty(text), r"[^\p{L}\p{N}]+", " ")))


def comparable_names(names: Column) -> Column:
    """The comparable names in sorted order; blank names don't count."""
    filled = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.length(strip(text_or_empty(n))) > 0)
    return F.array_sort(F.transform(filled, comparable))


def content_key(title: Column, abstract: Column, authors: Column, year: Column) -> Column:
    """Digest that two records share only if title, authors in any order, year and abstract are the same."""
    return F.sha2(F.to_json(F.struct(comparable(title).alias("t"), comparable_names(authors).alias("a"), year.alias("y"), comparable(abstract).alias("x"))), 256)


# --- identifiers ---------------------------------------------------------------------------------------------------

PREPRINT_ID = r"\d{4}\.\d{4,5}"


def external_url(source_id: Column) -> Column:
    """A web address as it is; the page of a preprint number; else null."""
    return F.when(source_id.rlike("^https?://"), source_id).when(source_id.rlike(rf"^{PREPRINT_ID}(v\d+)?$"), F.concat(F.lit("https://arxiv.org/abs/"), source_id))


def preprint_id(text: Column) -> Column:
    """The number without version that an address or identifier holds, else its last path segment."""
    found = F.regexp_extract(text, rf"({PREPRINT_ID})(?:v\d+)?", 1)
    return F.when(found != "", found).otherwise(F.substring_index(text, "/", -1))


def masked(key: Column) -> Column:
    """A secret with only its ends shown."""
    n = F.length(key)
    return F.when(n <= 12, F.concat(F.left(key, F.lit(3)), F.lit("…"), F.right(key, F.lit(2)))).otherwise(F.concat(F.left(key, F.lit(4)), F.lit("…"), F.right(key, F.lit(4))))


# --- titles, years, confidence -------------------------------------------------------------------------------------

# Fixed value: the title of a file whose name has no words.
UNTITLED = "未命名文献"


def title_from_file_name(name: Column) -> Column:
    """Words of the file's stem; a fixed title if there are none."""
    stem = F.regexp_replace(F.substring_index(name, "/", -1), r"(?<=.)\.[^.]*$", "")
    words = strip(F.regexp_replace(F.regexp_replace(stem, r"[^\p{L}\p{N}]+", " "), r" +", " "))
    return F.left(F.when(words == "", F.lit(UNTITLED)).otherwise(words), F.lit(150))


def title_from_abstract(abstract: Column) -> Column:
    """The first sentence, capitalised."""
    first = strip(F.regexp_extract(text_or_empty(abstract), r"(?s)^(.*?[。.!?])(?:\s|$)|^(.*)$", 0), ".。")
    return F.left(F.concat(F.upper(F.left(first, F.lit(1))), F.substring(first, F.lit(2), F.length(first))), F.lit(150))


def years(text: Column) -> Column:
    found = F.regexp_extract_all(text_or_empty(text), F.lit(r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"), 1)
    return F.filter(F.transform(found, lambda y: y.cast("int")), lambda y: (y >= 1990) & (y <= 2100))


def usual_year(text: Column) -> Column:
    """The year named most often, of equally frequent ones the earliest."""
    y = years(text)
    counted = F.transform(F.array_distinct(y), lambda v: F.struct((-F.size(F.filter(y, lambda w: w == v))).alias("n"), v.alias("year")))
    return F.get(F.array_sort(counted), F.lit(0))["year"]


def confidence(title: Column, abstract: Column, authors: Column, year: Column) -> Column:
    """A quarter for each of: a title of usual length, an abstract of some length, authors, a year."""
    n = F.length(text_or_empty(title))
    marks = [(n >= 4) & (n <= 300), F.length(text_or_empty(abstract)) >= 80, F.coalesce(F.size(authors), F.lit(0)) > 0, year.isNotNull()]
    return sum((m.cast("int") for m in marks), F.lit(0)) / 4.0


# --- lines of a parsed text ----------------------------------------------------------------------------------------

# Lines that aren't part of a text's body.
PAGE_LINE = r"(?iU)^(第\s*\d+\s*页(\s*共\s*\d+\s*页)?|page\s*\d+\s*of\s*\d+|\d{1,4}\s*[/-]\s*\d{1,4})$"
PREPRINT_LINE = r"(?i)^arxiv\s*:\s*\d{4}\.\d{4,5}"
ADDRESS_LINE = r"(?iU)^(https?://|www\.|doi\s*:|\S+@\S+\.\S+)"
SYMBOL_LINE = r"^[^\p{L}\p{N}]*$"
PUBLICATION_LINE = (
    r"(?iU)^(收稿日期|修回日期|录用日期|网络首发|基金项目|基金资助|资助项目|作者简介|作者单位|通讯作者|通信作者|电子邮箱|e-?mail|邮编|"
    r"中图分类号|文献标志码|文献标识码|文章编号|引文格式|引用本文|DOI|received|revised|accepted|funding|corresponding author)\b"
)
# Words of an institution; a postcode; marks that a sentence has; ends of a line.
INSTITUTION = r"(?i)(大学|学院|研究院|研究所|学校|中心|实验室|University|College|Institute|Department|School)"
POSTCODE, SENTENCE_MARK = r"(?U)\b\d{5,6}\b", r"[。．.!?？，,:：]"
LINE_BREAK = r"\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def lines(text: Column) -> Column:
    return F.transform(F.split(text_or_empty(text), LINE_BREAK), lambda x: strip(x))


def _is_noise(line: Column) -> Column:
    affiliation = (F.length(line) <= 90) & line.rlike(INSTITUTION) & (line.rlike(POSTCODE) | ~line.rlike(SENTENCE_MARK))
    return line.rlike(SYMBOL_LINE) | line.rlike(PAGE_LINE) | line.rlike(PREPRINT_LINE) | line.rlike(ADDRESS_LINE) | line.rlike(PUBLICATION_LINE) | affiliation


def single_spaced(line: Column) -> Column:
    return strip(F.regexp_replace(line, r"[ \t\x{3000}]+", " "))


def clean_lines(text: Column) -> Column:
    """The lines of a text's body with single spaces; of equal neighbours the first stays."""
    body = F.filter(lines(text), lambda x: ~_is_noise(x))
    before = F.concat(F.array(F.lit("")), F.transform(body, lambda x: single_spaced(x)))
    # each line beside the one before it, which is one array further, so the last pair has no line
    fresh = F.zip_with(body, before, lambda x, p: F.when(x != p, single_spaced(x)))
    return F.filter(fresh, lambda x: x.isNotNull())


def clean_text(text: Column) -> Column:
    return F.array_join(clean_lines(text), "\n")


# --- messages ------------------------------------------------------------------------------------------------------

# Causes of a failed parse and what the user is told.
PARSE_ERRORS = (
    (r"(?i)pdf.*(encrypt|password|not allowed)", "PDF 已加密或受保护，无法读取"),
    (r"(?i)(pdfreaderror|startxref|eof marker|cross-reference|pdf header)", "PDF 文件损坏或格式异常，无法解析"),
    (r"(?i)codec can't (?:decode|encode)|unicode(?:decode|encode)error", "文本编码无法识别或含非常用字符，已跳过该文件"),
    (r"(?i)zipfile|badzipfile|not a zip", "压缩包不是有效的 ZIP 或已损坏"),
    (r"(?i)filenotfound|permission", "文件读取失败（不存在或无权限）"),
)
# Fixed value: what the user is told where no cause is known.
UNKNOWN_ERROR = "解析失败，详情已记录到日志，可改用 AI 精修或手动填写"


def parse_error_message(message: Column) -> Column:
    return F.coalesce(*[F.when(message.rlike(p), F.lit(m)) for p, m in PARSE_ERRORS], F.lit(UNKNOWN_ERROR))


def fenced_json(answer: Column) -> Column:
    """The JSON of an answer, with or without a code fence around it."""
    inner = F.regexp_extract(answer, r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$", 1)
    return F.when(inner != "", inner).otherwise(F.trim(answer))


def rebuilt_abstract(positions: Column) -> Column:
    """The text of an inverted abstract, a map from word to its positions."""
    each = F.flatten(F.transform(F.map_entries(positions), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(each), lambda x: x["w"]), " ")
