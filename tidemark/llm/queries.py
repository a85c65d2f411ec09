"""Queries of the operators in this package, with SQL of the same result where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import conversations, lookalikes, mixing, packing, personal, residue, splitting
from tidemark.plans.preparation import COPIES_SQL
from tidemark.sources.tables import limit_amount, table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Messages that are too long for one piece."""
    pieces = splitting.split_oversized(table(spark, folder, "messages"), limit_amount(spark, folder, "piece_max"), limit_amount(spark, folder, "piece_overlap"))
    return pieces.where("piece_no = 2").select("row_id")


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of the messages that are too long for one."""
    pieces = splitting.split_oversized(table(spark, folder, "messages"), limit_amount(spark, folder, "piece_max"), limit_amount(spark, folder, "piece_overlap"))
    return pieces.where("n_pieces > 1")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in the texts and tool inputs of messages."""
    return personal.personal_stretches(table(spark, folder, "messages"), table(spark, folder, "name_parts"))


def p4_sanitised(spark: SparkSession, folder: str) -> DataFrame:
    """Messages with placeholders for personal data."""
    return personal.sanitise(table(spark, folder, "messages").select("row_id", "text", "input"), table(spark, folder, "name_parts"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions to drop."""
    return conversations.dropped_sessions(table(spark, folder, "messages"))


def p5_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of the sessions that are kept."""
    return conversations.conversations(table(spark, folder, "messages"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of messages that look the same but differ in their characters."""
    return lookalikes.same_look_pairs(table(spark, folder, "messages"))


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_texts(table(spark, folder, "documents"), limit_amount(spark, folder, "container_capacity"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that alone exceed a container: the packer put them into several."""
    return _packed(spark, folder).where("n_parts > 1 AND part_no = 1").select("doc_id")


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its container."""
    return _packed(spark, folder)


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(_packed(spark, folder), limit_amount(spark, folder, "container_capacity"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources whose documents, all repeated as often as they may be, still fall short of their share in the mix."""
    return mixing.short_sources(mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1])


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mix: documents by copy, in random order."""
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual shares."""
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold template residue or a stand-in page."""
    return residue.residue_documents(table(spark, folder, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_pieces, p4_found, p4_sanitised, p5_found, p5_conversations, p6_found, p7_found, p7_packed, p7_fill, p8_found, p8_mix, p8_shares, p9_found)}


_TURNS_SQL = f"""WITH {COPIES_SQL},
lined AS (SELECT *, CASE WHEN ident IS NULL THEN line_no ELSE min(line_no) OVER (PARTITION BY ident) END AS at_line,
  CASE WHEN ident IS NULL THEN row_id ELSE min(row_id) OVER (PARTITION BY ident) END AS first_row,
  nullif(regexp_replace(regexp_replace(lower(trim(parent_uuid)), '^urn:uuid:|[{{}}-]', '', 'g'), '^0+$', ''), '') AS parent FROM ranked),
kept AS (SELECT *, CASE lower(trim(role)) WHEN 'human' THEN 'user' WHEN 'user' THEN 'user' WHEN 'model' THEN 'assistant' WHEN 'assistant' THEN 'assistant' ELSE type END AS speaker
  FROM lined WHERE copy_no = 1),
turns AS (SELECT * FROM kept WHERE type IN ('user', 'assistant') AND regexp_matches(text, '[^\\s\\p{{Z}}\\p{{Cc}}\\p{{Cf}}\\x{{34F}}\\x{{115F}}\\x{{1160}}\\x{{17B4}}\\x{{17B5}}\\x{{180B}}-\\x{{180F}}\\x{{3164}}\\x{{FE00}}-\\x{{FE0F}}\\x{{FFA0}}\\x{{2800}}\\x{{E0100}}-\\x{{E01EF}}]')),
nexts AS (SELECT *, lead(speaker, 1, 'user') OVER w AS following, row_number() OVER w AS turn_no FROM turns WINDOW w AS (PARTITION BY session ORDER BY at_line, first_row)),
bad AS (
  SELECT DISTINCT session FROM messages WHERE session NOT IN (SELECT session FROM turns)
  UNION SELECT session FROM nexts WHERE turn_no = 1 AND speaker = 'assistant'
  UNION SELECT session FROM nexts WHERE speaker = 'user' AND following = 'user'
  UNION SELECT session FROM kept k WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM kept x WHERE x.session = k.session AND x.ident = k.parent))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": "SELECT row_id FROM messages WHERE length(text) > (SELECT amount FROM size_limits WHERE limit_name = 'piece_max')",
        "p5_found": f"{_TURNS_SQL} SELECT session FROM bad",
        "p5_conversations": f"{_TURNS_SQL} SELECT session, turn_no, speaker, row_id, at_line AS line_no, text FROM nexts WHERE session NOT IN (SELECT session FROM bad)",
    }
