"""The engine for callers: search, read, file history, map, outline and status over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import archive, codemap, retrieval
from tidemark.plans import analysis_queries
from tidemark.session import settle
from tidemark.sources.tables import table

#: Lines that are read if no end is given, and at most.
READ_LINES, READ_MOST = 80, 400


class Engine:
    """Built once over a folder; what is searched is indexed on first use and written to the shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._lines = self._chunks = self._modules = None

    def lines(self) -> DataFrame:
        self._lines = self._lines or settle(archive.file_lines(table(self.spark, self.folder, "documents")))
        return self._lines

    def chunks(self) -> DataFrame:
        if self._chunks is None:
            self._chunks = settle(archive.chunks(table(self.spark, self.folder, "documents")).select(F.concat_ws(":", "file", "from_line").alias("chunk_id"), "file", "from_line", "to_line", "chunk"))
        return self._chunks

    def _asked(self, *queries: str) -> DataFrame:
        return self.spark.createDataFrame([(q,) for q in queries], "q string")

    def search(self, *queries: str, k: int = 8) -> DataFrame:
        """Ranked passages for each query, with file and lines."""
        found = retrieval.search_passages(self.chunks(), self._asked(*queries), k)
        return found.join(self.chunks(), "chunk_id").select("query", "rank", "file", "from_line", "to_line", "score", F.substring("chunk", 1, 220).alias("excerpt"))

    def read(self, file: int, from_line: int = 1, to_line: int | None = None) -> DataFrame:
        """Lines of a file; from 1 on, READ_LINES if no end is given, READ_MOST at most."""
        lo = max(1, from_line)
        hi = min(to_line if to_line is not None else lo + READ_LINES - 1, lo + READ_MOST - 1)
        return self.lines().where((F.col("file") == file) & F.col("line_no").between(lo, hi)).orderBy("line_no")

    def file_history(self, path: str) -> DataFrame:
        """Sessions whose tool calls name a path, with the first line and how often."""
        m = table(self.spark, self.folder, "messages").where("tool IS NOT NULL")
        tail = tx.fold(tx.path_tail(F.lit(path)))
        hit = m.where(F.contains(tx.fold(tx.plain_path(F.col("input"))), tail))
        return hit.groupBy("session").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_calls"), F.min("ts").alias("first_ts")).orderBy(F.col("first_ts").asc_nulls_first(), "session")

    def map(self, *queries: str) -> DataFrame:
        """The modules that fit each query best."""
        self._modules = self._modules or settle(archive.modules(self.lines()))
        return codemap.best(codemap.find(self._modules, self._asked(*queries)))

    def outline(self, file: int) -> DataFrame:
        return archive.outline(self.lines().where(F.col("file") == file)).orderBy("line_no")

    def status(self) -> DataFrame:
        return analysis_queries.health_verdict(self.spark, self.folder)
