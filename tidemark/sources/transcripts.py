"""Reading raw transcripts: JSON lines of two hosts, Markdown archives; bad lines are set aside, not lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

USAGE = "input_tokens long, cache_creation_input_tokens long, cache_read_input_tokens long, output_tokens long"


def json_lines(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """file, raw of each line of the .jsonl files under path; lines of NUL bytes or blanks are left out."""
    text = spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", str(recursive).lower()).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw")).where(~F.col("raw").rlike(r"^[\x00\s]*$"))


def session_of(file: Column) -> tuple[Column, Column]:
    """The session that a file holds, and whether it is a sub-session (a file in a folder subagents of its session)."""
    sub = F.regexp_extract(file, r"([^/]+)/subagents/[^/]+\.jsonl$", 1)
    return F.when(sub != "", sub).otherwise(F.regexp_extract(file, r"([^/]+)\.jsonl$", 1)), sub != ""


def messages(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of users and assistants, and the lines that are no JSON (with their file)."""
    parsed = lines.withColumn("json", F.try_parse_json("raw"))
    session, is_sub = session_of(F.col("file"))
    get = lambda p, t: F.try_variant_get("json", f"$.{p}", t)
    good = parsed.where("json IS NOT NULL").select(
        "file", session.alias("session"), is_sub.alias("sub_session"), get("type", "string").alias("type"), get("uuid", "string").alias("uuid"), get("timestamp", "string").cast("timestamp").alias("ts"),
        get("message.id", "string").alias("message_id"), get("message.role", "string").alias("role"), F.to_json(F.try_variant_get("json", "$.message.content", "variant")).alias("content"),
        F.from_json(F.to_json(F.try_variant_get("json", "$.message.usage", "variant")), USAGE).alias("usage"),
    )
    return good.where(F.col("type").isin("user", "assistant")), parsed.where("json IS NULL").select("file", "raw")


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """file, text of each Markdown file under path."""
    text = spark.read.option("pathGlobFilter", "*.md").option("wholetext", "true").text(path)
    return text.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.md$", 1).alias("file"), F.col("value").alias("text"))
