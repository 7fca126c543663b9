"""Corpus, stopword and dictionary sources, and the versioned corpus sink."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_PAPER = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "paper_id", "source_id", "title", "abstract", "authors", "year", "language", "source", "file_name", "file_store")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("keywords", "tags")]
)


MOST_STOPWORDS = 100_000


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows of a JSON array, or of one object a line; a missing or broken file gives none.

    ``authors`` may be an array or a joined string and comes out as an array.
    """
    try:
        raw = spark.read.schema(RAW_PAPER).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
        raw.head(1)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
            raise
        return spark.createDataFrame([], RAW_PAPER).withColumn("authors", F.array().cast("array<string>"))
    listed = F.from_json("authors", "array<string>")
    joined = F.filter(F.transform(F.split("authors", ","), lambda a: F.trim(a)), lambda a: a != "")
    return raw.withColumn("authors", F.when(F.col("authors").startswith("["), listed).otherwise(joined)).where(F.coalesce("title", "abstract", "id", "source_id").isNotNull())


def stopword_set(words: DataFrame) -> set[str]:
    """The set of a one-column table of words: lower case, without blanks and comment lines.

    The words become part of every plan, so a table of more than ``MOST_STOPWORDS`` is refused.
    """
    w = F.lower(F.trim(words.columns[0]))
    found = words.select(w.alias("w")).where("w is not null and w != '' and not startswith(w, '#')").distinct().take(MOST_STOPWORDS + 1)
    if len(found) > MOST_STOPWORDS:
        raise ValueError(f"more than {MOST_STOPWORDS} stopwords")
    return {r[0] for r in found}


def read_stopwords(spark: SparkSession, path: str) -> set[str]:
    """Words of a text file, one a line; a missing file gives none."""
    try:
        return stopword_set(spark.read.text(path))
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return set()


def read_bilingual(spark: SparkSession, path: str) -> DataFrame:
    """(en, zh, ord) of a JSON file {"pairs": [[en, zh], ...]}."""
    pairs = spark.read.schema("pairs array<array<string>>").option("multiLine", True).json(path)
    rows = pairs.select(F.posexplode("pairs").alias("ord", "p")).select(F.lower(F.trim(F.col("p")[0])).alias("en"), F.trim(F.col("p")[1]).alias("zh"), "ord")
    return rows.where("en != '' and zh != ''")


def write_version(papers: DataFrame, root: str) -> str:
    """Writes the corpus, ordered by id, as a new version and only then points to it; readers see the old or the new one."""
    name = f"v-{uuid.uuid4().hex}"
    papers.orderBy("paper_id").write.parquet(f"{root}/{name}")
    spark = papers.sparkSession
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    following, pointer = hadoop.Path(f"{root}/pointer-{name}.json"), hadoop.Path(f"{root}/pointer.json")
    out = following.getFileSystem(conf).create(following, True)
    out.write(json.dumps({"current": name}).encode())
    out.close()
    # one rename that replaces the pointer: there is no moment without one
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    files = hadoop.FileContext.getFileContext(following.getFileSystem(conf).getUri(), conf)
    files.rename(files.makeQualified(following), files.makeQualified(pointer), how)
    return name


def read_version(spark: SparkSession, root: str) -> DataFrame:
    current = json.loads(spark.read.text(f"{root}/pointer.json").first()[0])["current"]
    return spark.read.parquet(f"{root}/{current}")
