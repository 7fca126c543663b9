"""The archive of ingested files: a table of contents under their stored names, in a folder that executors share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

FILES = "file_store string, file_name string, content binary"


@dataclass(frozen=True)
class FileArchive:
    """Files are appended; removed ones are named in a second table and no longer found. Only names of the archive resolve."""

    spark: SparkSession
    path: str

    def _table(self, name: str, schema: str) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def files(self) -> DataFrame:
        gone = self._table("removed", "file_store string")
        return self._table("files", FILES).join(gone, "file_store", "left_anti")

    def store(self, files: DataFrame) -> None:
        """Appends (file_store, file_name, content); a name that is there already stays as it is."""
        new = files.where("content is not null").dropDuplicates(["file_store"]).join(self.files().select("file_store"), "file_store", "left_anti")
        new.select("file_store", "file_name", "content").write.mode("append").parquet(f"{self.path}/files")

    def resolve(self, papers: DataFrame) -> DataFrame:
        """(paper_id, file_name, content) of the papers whose file is here."""
        wanted = papers.where("file_store is not null").select("paper_id", "file_store", papers["file_name"].alias("shown"))
        found = self.files().join(wanted, "file_store")
        return found.selectExpr("paper_id", "coalesce(shown, file_name) AS file_name", "content")

    def remove(self, papers: DataFrame) -> None:
        """Files of these papers are no longer found."""
        papers.where("file_store is not null").select("file_store").distinct().write.mode("append").parquet(f"{self.path}/removed")
