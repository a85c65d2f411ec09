"""Index tables that are kept up to date: changes found by a manifest, tables written as versions behind a pointer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import archive, retrieval


def manifest(files: DataFrame, file_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """file, size and hash of each text."""
    return files.where(F.col(text_col).isNotNull()).select(F.col(file_col).alias("file"), F.octet_length(text_col).alias("size"), F.sha1(text_col).alias("hash"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """file and change (new, changed, deleted) between two manifests."""
    a, b = old.select("file", F.col("hash").alias("was")), new.select("file", F.col("hash").alias("is"))
    change = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "deleted").when(F.col("was") != F.col("is"), "changed")
    return a.join(b, "file", "full_outer").select("file", change.alias("change")).where("change IS NOT NULL")


def chunk_index(files: DataFrame, file_col: str = "doc_id") -> DataFrame:
    """file, from_line, to_line, term, n: postings of the chunks of files."""
    c = archive.chunks(files, file_col)
    index = retrieval.postings(c.select(F.struct("file", "from_line", "to_line").alias("id"), "chunk"), "id", {"chunk": 1.0})
    return index.select("doc.file", "doc.from_line", "doc.to_line", "term", "n")


def update_index(index: DataFrame, files: DataFrame, changed: DataFrame, file_col: str = "doc_id") -> DataFrame:
    """The index after changes: entries of changed and deleted files go, those of new and changed ones are built; equal to a full build."""
    kept = index.join(changed.select("file"), "file", "left_anti")
    again = files.join(changed.where("change != 'deleted'").select(F.col("file").alias(file_col)), file_col, "left_semi")
    return kept.unionByName(chunk_index(again, file_col))


class VersionedTable:
    """A table of versions v=<n> beside each other; a file names the current one and is replaced last, so readers never see half a version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The current version; 0 if there is none."""
        path, fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))] if fs.exists(path(self.path)) else []
        return max([int(n[8:]) for n in names if n.startswith("current=")], default=0)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v={self.version()}")

    def write(self, df: DataFrame, keep: int = 2) -> int:
        """Writes df as the next version, then points to it; all but the last versions go."""
        path, fs = self._fs()
        n = self.version() + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v={n}")
        fs.create(path(f"{self.path}/current={n}"), True).close()
        for old in range(max(1, n - keep - 5), n - keep + 1):
            fs.delete(path(f"{self.path}/current={old}"), False)
            fs.delete(path(f"{self.path}/v={old}"), True)
        return n
