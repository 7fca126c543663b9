"""Files: character sets, ZIP archives, PDF by plug-in, and the rules that find a text's title, authors, abstract and year.

``contents``: (name, content). Decoding runs in Arrow batches; the layout rules are Columns over arrays of lines.
"""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions import text as X
from scriptorium.sources import pdf
from scriptorium.sources.refine import refined

# Character sets in the order they are tried, and misreadings that are undone.
CHARSETS = ("utf-8-sig", "utf-8", "gb18030", "utf-16", "big5")
MISREADINGS = (("latin-1", "utf-8"), ("cp1252", "utf-8"), ("gb18030", "utf-8"))
TEXT_SUFFIXES = (".txt", ".md", ".text", ".log", ".tex")
MAX_MEMBERS, MAX_TOTAL, MAX_MEMBER = 200, 512 << 20, 64 << 20


def badness(text: str) -> int:
    """Three for each replacement character, one for each control character other than line ends and tabs."""
    return 3 * text.count("�") + sum(c not in "\n\r\t" and unicodedata.category(c) == "Cc" for c in set(text) for _ in range(text.count(c)))


def _attempt(raw: bytes, charset: str) -> str | None:
    try:
        return raw.decode(charset)
    except (UnicodeError, ValueError):
        return None


def decode(raw: bytes) -> tuple[str, str]:
    """(text, charset): the first charset that reads the bytes without bad characters, else the one with fewest."""
    tries = [(t, c) for c in CHARSETS if (t := _attempt(raw, c)) is not None]
    return min(tries, key=lambda x: badness(x[0])) if tries else (raw.decode("latin-1"), "latin-1")


def unmisread(text: str) -> str:
    """Undoes UTF-8 read in another charset if that leaves fewer bad characters, or as many and more Chinese."""

    def measure(t: str) -> tuple[int, float]:
        return badness(t), -sum("一" <= c <= "鿿" for c in t) / max(len(t), 1)

    best = text
    for read_as, was in MISREADINGS:
        try:
            other = text.encode(read_as).decode(was)
        except UnicodeError:
            continue
        if other != best and measure(other) < measure(best):
            best = other
    return best


_DECODED = T.StructType([T.StructField("text", T.StringType()), T.StructField("charset", T.StringType())])


@F.pandas_udf(_DECODED)
def decoded(content: pd.Series) -> pd.DataFrame:
    got = [decode(bytes(c)) if c is not None else (None, None) for c in content]
    return pd.DataFrame(got, columns=["text", "charset"])


@F.pandas_udf(T.StringType())
def repaired(texts: pd.Series) -> pd.Series:
    return texts.map(unmisread, na_action="ignore")


# --- archives ------------------------------------------------------------------------------------------------------

_DRIVE = re.compile("^[A-Za-z]:")


def _members(content: bytes) -> list[tuple[str, bytes]]:
    """Readable members of an archive; raises ValueError with the reason if the archive as a whole is refused."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise ValueError(f"not a zip file: {e}") from e
    with archive:
        all_ = archive.infolist()
        if not all_:
            raise ValueError("the archive is empty")
        if len(all_) > MAX_MEMBERS:
            raise ValueError(f"more than {MAX_MEMBERS} members")
        if sum(m.file_size for m in all_) > MAX_TOTAL:
            raise ValueError("more than 512 MiB in all")
        found = []
        for m in all_:
            path = m.filename.replace("\\", "/")
            name = path.rsplit("/", 1)[-1]
            outside = path.startswith("/") or _DRIVE.match(path) or ".." in path.split("/")
            if not (outside or m.is_dir() or m.file_size > MAX_MEMBER) and name.lower().endswith((".pdf", *TEXT_SUFFIXES)):
                found.append((name, archive.read(m)))
    if not found:
        raise ValueError("no readable document")
    return found


_ENTRIES = "archive string, ord int, name string, content binary, error string"


def zip_entries(archives: DataFrame) -> DataFrame:
    """(archive, ord, name, content, error): a row for each document of each archive, or one with the reason for refusal."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["name"], b["content"], strict=True):
                try:
                    rows = [(name, i, n, c, None) for i, (n, c) in enumerate(_members(bytes(content or b"")))]
                except ValueError as e:
                    rows = [(name, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["archive", "ord", "name", "content", "error"]).astype({"ord": "Int32"})

    return archives.select("name", "content").mapInPandas(run, _ENTRIES)


# --- layout rules --------------------------------------------------------------------------------------------------

# Labels, markers and section heads.
TITLE_LABEL = r"(?i)^(title|题目|标题)\s*[:：]"
AUTHOR_LABEL = r"(?i)^(author|authors|作者|作者简介)\s*[:：]"
ABSTRACT_START = r"(?iU)^[【\[]?\s*(摘\s*要|内容提要|abstract|summary)\b"
ABSTRACT_END = r"(?i)^(关键词|key\s*words?|keywords?|中图分类号|引\s*言|\d{1,2}\s*[.、]?\s*(引言|介绍|相关工作|introduction|related work)|introduction|references|参考文献)"
SECTION_HEAD = (
    r"(?iU)^(引言|introduction|摘要|abstract|references|参考文献|\d{1,2}\s*[.、]?\s*(引言|介绍|相关工作|背景|background|introduction|related\s*work|方法|method|"
    r"结论|conclusion|实验|experiment|结果|results)\b|^\d{1,2}\s*$)"
)
NOISE_HEADER = r"(?i)(journal|proceedings|conference|vol\.?\s*\d+|no\.?\s*\d+|pp?\.?\s*\d+|issn|doi)"
LATIN_LINE = r"^[A-Za-z0-9][A-Za-z0-9 .,:;\-&'()/]*$"
NUMBERED_HEAD = r"^\d{1,2}\s*[.、]?\s+[A-Za-z\x{4e00}-\x{9fff}]"
SEPARATOR = r"(?iU)[,，;；、]|\band\b"
TITLE_LENGTH, ABSTRACT_LENGTH, PROSE_LENGTH, MOST_AUTHORS = 200, 2400, 600, 10
HAN = f"[{X.HAN}]"


def after_label(line: Column) -> Column:
    return X.strip(F.regexp_replace(line, r"^[^:：]*[:：]", ""))


def looks_like_title(line: Column) -> Column:
    plausible = (F.length(line) >= 4) & (F.length(line) <= TITLE_LENGTH) & ~line.rlike(r"^\d+$") & ~line.rlike(NUMBERED_HEAD) & ~line.rlike(SECTION_HEAD)
    return plausible & (line.rlike(HAN) | line.rlike(LATIN_LINE) & line.rlike("^[A-Z0-9]"))


def looks_like_authors(line: Column, title: Column) -> Column:
    return (F.length(line) > 0) & (F.length(line) <= 120) & (line.rlike(AUTHOR_LABEL) | line.rlike(HAN) | line.rlike(SEPARATOR) | ~title.rlike(HAN))


def split_authors(line: Column) -> Column:
    names = F.transform(F.split(F.regexp_replace(line, r"^\s*[\d*†‡#]+\s*", ""), SEPARATOR), lambda p: X.strip(p))
    return F.slice(F.transform(F.filter(names, lambda p: F.length(p) >= 2), lambda p: F.regexp_replace(p, r"^[*†‡]+|[*†‡]+$", "")), 1, MOST_AUTHORS)


def _first_index(lines: Column, holds: Callable[[Column, Column], Column]) -> Column:
    """The index of the first line that holds, -1 if none does."""
    at = F.transform(lines, lambda x, i: F.when(holds(x, i), i))
    return F.coalesce(F.array_min(at), F.lit(-1))


def _joined_within(lines: Column, most: int) -> Column:
    """Lines joined by spaces, up to the one that makes them longer than ``most``."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"))
    grown = F.aggregate(lines, start, lambda a, x: F.when(a["n"] > most, a).otherwise(F.struct(F.concat(a["kept"], F.array(x)).alias("kept"), (a["n"] + F.length(x)).alias("n"))))
    return X.strip(F.array_join(grown["kept"], " "))


def parsed(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds title, authors, abstract and year found in a text by its layout."""
    df = df.withColumn("_l", X.clean_lines(F.col(text)))
    lines = F.col("_l")
    labelled = F.coalesce(F.get(lines, F.lit(0)).rlike(TITLE_LABEL), F.lit(False))
    found = _first_index(F.slice(lines, 1, 4), lambda x, i: ~x.rlike(ABSTRACT_START) & ~x.rlike(NOISE_HEADER) & looks_like_title(x))
    at = F.when(labelled, F.lit(0)).otherwise(found)
    df = df.withColumn("_t", at)
    title = F.when(labelled, after_label(lines[0])).when(F.col("_t") >= 0, F.left(F.get(lines, F.col("_t")), F.lit(TITLE_LENGTH))).otherwise("")
    df = df.withColumn("title", title)
    # below a Chinese title its translation may stand
    translation = lambda x: F.col("title").rlike(HAN) & x.rlike(LATIN_LINE) & (F.length(x) <= TITLE_LENGTH) & ~x.rlike(AUTHOR_LABEL)
    begin = F.when(labelled, 1).otherwise(F.col("_t") + 1)
    body = _first_index(lines, lambda x, i: (i >= begin) & ~(F.lit(True) & ~labelled & translation(x)))
    df = df.withColumn("_b", F.when(body < 0, F.size(lines)).otherwise(body))
    labelled_at = _first_index(lines, lambda x, i: (i >= F.col("_b")) & (i < F.col("_b") + 4) & x.rlike(AUTHOR_LABEL))
    first = F.get(lines, F.col("_b"))
    plain = F.coalesce((F.col("title") != "") & looks_like_authors(first, F.col("title")), F.lit(False)) & ((labelled_at < 0) | (labelled_at > F.col("_b")) | ~first.rlike(AUTHOR_LABEL))
    df = df.withColumn("_a", F.when(plain, F.col("_b")).otherwise(labelled_at))
    line = F.get(lines, F.when(F.col("_a") >= 0, F.col("_a")))
    authors = F.when(F.col("_a") >= 0, split_authors(F.when(line.rlike(AUTHOR_LABEL), after_label(line)).otherwise(line))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("authors", authors).withColumn("_b", F.when(F.col("_a") >= 0, F.col("_a") + 1).otherwise(F.col("_b")))
    start = _first_index(lines, lambda x, i: (i >= F.col("_b")) & x.rlike(ABSTRACT_START))
    df = df.withColumn("_s", start)
    after = F.slice(lines, F.col("_s") + 2, F.size(lines))
    end = _first_index(after, lambda x, i: x.rlike(ABSTRACT_END))
    inside = F.filter(F.when(end < 0, after).otherwise(F.slice(after, 1, end)), lambda x: ~x.rlike(r"^(19|20)\d{2}$"))
    inline = F.regexp_replace(F.regexp_replace(F.get(lines, F.col("_s")), ABSTRACT_START, ""), r"^[:： \t\-】\]]+", "")
    marked = _joined_within(F.filter(F.concat(F.array(inline), inside), lambda x: x != ""), ABSTRACT_LENGTH)
    prose = F.slice(lines, F.col("_b") + 1, F.size(lines))
    stop = _first_index(prose, lambda x, i: x.rlike(SECTION_HEAD))
    unmarked = _joined_within(F.when(stop < 0, prose).otherwise(F.slice(prose, 1, stop)), PROSE_LENGTH)
    abstract = F.left(F.when(F.col("_s") >= 0, marked).otherwise(unmarked), F.lit(ABSTRACT_LENGTH))
    df = df.withColumn("abstract", F.coalesce(abstract, F.lit(""))).withColumn("year", X.usual_year(F.col(text)))
    return df.drop("_l", "_t", "_b", "_a", "_s")


#: From a PDF file to its text, or to its text with the title and year of its metadata; raises an error if there is none.
Extractor = Callable[[bytes], "str | pdf.PdfText"]
#: Confidence up to which a refiner is asked.
DOUBTFUL = 0.5


def parse_files(contents: DataFrame, extract_pdf: Extractor = pdf.extract, refine: Callable[[Column], Column] | None = None, refine_all: bool = False) -> DataFrame:
    """(name, title, authors, abstract, year, confidence, text, charset, no_text, error, agent_keywords, ai_used) of every file.

    Text files are decoded and parsed, PDF goes through ``extract_pdf``; a PDF without text gives a placeholder with its name
    as title; other files give an error row. A refiner, a function from texts to answers, is asked about doubtful files or all.
    """
    suffix = F.lower(F.regexp_extract("name", r"(\.[^./\\]+)$", 1))
    plain = contents.where(suffix.isin(*TEXT_SUFFIXES)).select("name", decoded("content").alias("d")).select("name", "d.text", "d.charset", F.lit(False).alias("no_text"), F.lit(None).cast("string").alias("error"))

    def read_pdf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, content in zip(b["name"], b["content"], strict=True):
                try:
                    got = extract_pdf(bytes(content or b""))
                    got = got if isinstance(got, pdf.PdfText) else pdf.PdfText(got)
                    out.append((name, unmisread(got.text), None, False, None, unmisread(got.title), got.year))
                except Exception as e:  # noqa: BLE001
                    out.append((name, "", None, True, f"{type(e).__name__}: {e}", None, None))
            yield pd.DataFrame(out, columns=["name", "text", "charset", "no_text", "error", "meta_title", "meta_year"]).astype({"meta_year": "Int32"})

    pages = contents.where(suffix == ".pdf").select("name", "content").mapInPandas(read_pdf, "name string, text string, charset string, no_text boolean, error string, meta_title string, meta_year int")
    other = contents.where(~suffix.isin(".pdf", *TEXT_SUFFIXES)).select("name", F.lit("").alias("text"), F.lit(None).cast("string").alias("charset"), F.lit(True).alias("no_text"), F.lit("unsupported format").alias("error"))
    both = parsed(plain.unionByName(other).unionByName(pages, allowMissingColumns=True))
    named = (F.col("title") == "") & F.length("meta_title").between(4, 300)
    both = both.withColumns({"title": F.when(named, F.col("meta_title")).otherwise(F.col("title")), "year": F.coalesce("year", "meta_year")})
    both = both.withColumn("confidence", X.confidence(F.col("title"), F.col("abstract"), F.col("authors"), F.col("year")))
    doubtful = F.lit(True) if refine_all else F.col("confidence") <= DOUBTFUL
    both = refined(both, None if refine is None else lambda text: refine(F.when(doubtful & (F.trim(text) != ""), text)))
    title = F.when((F.col("title") == "") & (F.col("abstract") != ""), X.title_from_abstract(F.col("abstract"))).otherwise(F.col("title"))
    placeholder = title == ""
    return both.select(
        "name",
        F.when(placeholder, X.title_from_file_name(F.col("name"))).otherwise(title).alias("title"),
        "authors",
        "abstract",
        "year",
        F.when(placeholder, 0.15).otherwise(F.col("confidence")).alias("confidence"),
        "text",
        "charset",
        (F.col("no_text") | placeholder).alias("no_text"),
        F.when(F.col("error").isNotNull(), X.parse_error_message(F.col("error"))).alias("error"),
        "agent_keywords",
        "ai_used",
    )
