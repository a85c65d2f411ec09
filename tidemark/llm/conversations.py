"""Conversations from message rows, read as an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.delivery import identifier_text
from tidemark.session import settle

#: Lines of a session that are looked at together; a long session is many such stretches.
STRETCH = 2_000

# Characters with no shape besides separators, control and format characters.
_SHAPELESS = r"\u034f\u115f\u1160\u17b4\u17b5\u180b-\u180f\u3164\ufe00-\ufe0f\uffa0\u2800\x{E0100}-\x{E01EF}"
VISIBLE = rf"[^\s\p{{Z}}\p{{Cc}}\p{{Cf}}{_SHAPELESS}]"


def speaker(role: Column, kind: Column) -> Column:
    """user or assistant, from the role in any spelling or, if it is missing or unknown, from the row's type; null for others."""
    known = lambda c: F.when(c.isin("user", "human"), "user").when(c.isin("assistant", "model"), "assistant")
    return F.coalesce(known(F.lower(F.trim(role))), known(F.lower(F.trim(kind))))


def fold_events(df: DataFrame) -> DataFrame:
    """The log's final messages: of the rows with one identifier (creates, retries and edits) the best version holds, at the lowest line.

    Version order: with usage before without, then the largest output_tokens, then the smallest row_id. Rows without identifier are messages of their own.
    A message whose last version shows nothing (deleted or blank) keeps its place for parent links but is no turn.
    Scale: one aggregation with map-side combine over identifiers and flags; texts stay behind, only the winner's row_id is kept.
    """
    turn = F.lower(F.trim("type")).isin("user", "assistant") & F.coalesce(F.col("text").rlike(VISIBLE), F.lit(False))
    rows = df.select(
        F.col("session"),
        F.coalesce(identifier_text(F.col("uuid")), F.concat(F.lit("row "), F.col("row_id").cast("string"))).alias("message"),
        identifier_text(F.col("uuid")).alias("ident"),
        identifier_text(F.col("parent_uuid")).alias("parent"),
        F.col("row_id"),
        F.col("line_no").cast("long").alias("line_no"),
        F.when(turn, speaker(F.col("role"), F.col("type"))).alias("speaker"),
        F.struct(F.when(F.col("usage").isNull(), 0).otherwise(1).alias("u"), F.coalesce(F.col("usage.output_tokens"), F.lit(-1)).alias("o"), (-F.col("row_id")).alias("r")).alias("version"),
    ).where("session IS NOT NULL")
    return rows.groupBy("session", "message").agg(
        F.max_by("row_id", "version").alias("row_id"),
        F.max_by("speaker", "version").alias("speaker"),
        F.max_by("parent", "version").alias("parent"),
        F.first("ident").alias("ident"),
        F.min("line_no").alias("line_no"),
        F.min("row_id").alias("first_row"),
        F.count("*").alias("versions"),
    )


def judge_sessions(messages: DataFrame) -> DataFrame:
    """One row a session: n_turns and what is wrong with it: empty, starts_with_assistant, lacks_reply, broken_parent, and dropped if any is.

    Order is by line_no, then row; rows without line_no come last. A session is looked at in stretches of STRETCH lines whose ends are then
    compared, so that no task holds a whole session; parents are looked up by session and identifier.
    """
    line = F.coalesce(F.col("line_no"), F.lit((1 << 62)))
    turns = messages.where("speaker IS NOT NULL").select(
        "session", "speaker", line.alias("line"), "first_row", F.when(F.col("line_no").isNull(), F.lit(1 << 60) + F.floor(F.col("first_row") / STRETCH)).otherwise(F.floor(F.col("line_no") / STRETCH)).alias("stretch")
    )
    inside = Window.partitionBy("session", "stretch").orderBy("line", "first_row")
    order = F.struct("line", "first_row")
    stretches = (
        turns.withColumn("next", F.lead("speaker").over(inside))
        .groupBy("session", "stretch")
        .agg(
            F.count("*").alias("n"),
            F.min_by("speaker", order).alias("first"),
            F.max_by("speaker", order).alias("last"),
            F.max((F.col("speaker") == "user") & (F.col("next") == "user")).alias("unanswered"),
        )
    )
    across = Window.partitionBy("session").orderBy("stretch")
    ends = stretches.withColumn("follows", F.lead("first").over(across))
    talk = ends.groupBy("session").agg(
        F.sum("n").alias("n_turns"),
        (F.min_by("first", "stretch") == "assistant").alias("starts_with_assistant"),
        F.max(F.coalesce("unanswered", F.lit(False)) | ((F.col("last") == "user") & (F.coalesce("follows", F.lit("user")) == "user"))).alias("lacks_reply"),
    )
    known = messages.where("ident IS NOT NULL").select("session", F.col("ident").alias("parent"))
    orphans = messages.where("parent IS NOT NULL").select("session", "parent").join(known, ["session", "parent"], "left_anti").select("session").distinct().withColumn("broken_parent", F.lit(True))
    false = F.lit(False)
    sessions = messages.select("session").distinct().join(talk, "session", "left").join(orphans, "session", "left")
    out = sessions.select(
        "session",
        F.coalesce("n_turns", F.lit(0)).alias("n_turns"),
        F.col("n_turns").isNull().alias("empty"),
        F.coalesce("starts_with_assistant", false).alias("starts_with_assistant"),
        F.coalesce("lacks_reply", false).alias("lacks_reply"),
        F.coalesce("broken_parent", false).alias("broken_parent"),
    )
    return out.withColumn("dropped", F.expr("empty OR starts_with_assistant OR lacks_reply OR broken_parent"))


def conversations(df: DataFrame) -> DataFrame:
    """The turns of the sessions that survive: session, turn_no, speaker, row_id, line_no, text.

    turn_no counts within the session without any task holding it: stretches are counted first.
    """
    messages = settle(fold_events(df))
    kept = judge_sessions(messages).where("NOT dropped").select("session")
    turns = messages.where("speaker IS NOT NULL").join(kept, "session", "left_semi")
    turns = turns.withColumn("stretch", F.when(F.col("line_no").isNull(), F.lit(1 << 60) + F.floor(F.col("first_row") / STRETCH)).otherwise(F.floor(F.col("line_no") / STRETCH)))
    before = Window.partitionBy("session").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = turns.groupBy("session", "stretch").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("session", "stretch").orderBy(F.coalesce("line_no", F.lit(1 << 62)), "first_row")
    numbered = turns.withColumn("at", F.row_number().over(inside)).join(offsets, ["session", "stretch"]).withColumn("turn_no", F.col("at") + F.col("offset"))
    texts = df.select(F.col("row_id"), F.col("text"))
    return numbered.select("session", "turn_no", "speaker", "row_id", "line_no").join(texts, "row_id")


def dropped_sessions(df: DataFrame) -> DataFrame:
    """Sessions that are empty, broken or lack a reply. Rows without session belong to none; an empty table has none."""
    messages = settle(fold_events(df))
    return judge_sessions(messages).where("dropped").select("session")
