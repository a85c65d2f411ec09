"""Queries of the general record-preparation operators, with SQL of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import delivery, nested
from tidemark.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Surplus rows of messages."""
    return delivery.surplus_rows(table(spark, folder, "messages"))


def p1_usage_once(spark: SparkSession, folder: str) -> DataFrame:
    """Usage by project, each identifier counted once."""
    once = delivery.keep_one_copy(table(spark, folder, "messages").select("row_id", "batch_id", "uuid", "project", "usage"))
    sums = [F.sum(f"usage.{c}").alias(c) for c in ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens")]
    return once.groupBy("project").agg(F.count("*").alias("n_rows"), *sums)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Objects in arrays of messages.content, with their parents."""
    return nested.element_objects(table(spark, folder, "messages"))


def p3_table_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each flat table by schema path."""
    flat = nested.flat_tables(nested.labelled_nodes(table(spark, folder, "messages")))
    counts = [flat[t].groupBy("schema_path").agg(F.count("*").alias("n")).select(F.lit(t).alias("flat_table"), "schema_path", "n") for t in ("blocks", "results", "input_elements", "others")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


#: Rows of messages with the identifier that uuid denotes (NULL: none), and their rank among its copies.
COPIES_SQL = """
ids AS (SELECT *, nullif(regexp_replace(regexp_replace(lower(trim(uuid)), '^urn:uuid:|[{}-]', '', 'g'), '^0+$', ''), '') AS ident FROM messages),
ranked AS (SELECT *, CASE WHEN ident IS NULL THEN 1 ELSE row_number() OVER (
  PARTITION BY ident ORDER BY usage IS NULL, usage.output_tokens DESC NULLS LAST, row_id) END AS copy_no FROM ids)
"""

_NODES_SQL = """
WITH RECURSIVE nodes(row_id, path, parent_path, own, v, in_array) AS (
  SELECT row_id, '', '', '', CAST(content AS JSON), false FROM messages WHERE json_valid(content) AND json_type(content) IN ('ARRAY', 'OBJECT')
  UNION ALL
  SELECT row_id, path || '/' || k, own,
    CASE WHEN is_array AND json_type(child) = 'OBJECT' THEN path || '/' || k ELSE own END,
    child, is_array
  FROM (
    SELECT row_id, path, own, k, is_array,
      CASE WHEN k = 'input' AND NOT is_array AND json_type(raw) = 'VARCHAR' AND json_valid(raw ->> '$') THEN CAST(raw ->> '$' AS JSON) ELSE raw END AS child
    FROM (
      SELECT row_id, path, own, k, json_type(v) = 'ARRAY' AS is_array, json_extract(v, '/' || k) AS raw
      FROM (SELECT *, unnest(CASE json_type(v) WHEN 'OBJECT' THEN json_keys(v)
        WHEN 'ARRAY' THEN list_transform(range(CAST(json_array_length(v) AS BIGINT)), lambda x: CAST(x AS VARCHAR)) ELSE [] END) AS k FROM nodes)))
)
"""


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_usage_once, p3_found, p3_table_sizes)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {COPIES_SQL} SELECT row_id FROM ranked WHERE copy_no > 1",
        "p1_usage_once": f"""WITH {COPIES_SQL} SELECT project, count(*) AS n_rows, CAST(sum(usage.input_tokens) AS BIGINT) AS input_tokens,
          CAST(sum(usage.cache_creation_input_tokens) AS BIGINT) AS cache_creation_input_tokens, CAST(sum(usage.cache_read_input_tokens) AS BIGINT) AS cache_read_input_tokens,
          CAST(sum(usage.output_tokens) AS BIGINT) AS output_tokens FROM ranked WHERE copy_no = 1 GROUP BY project""",
        "p3_found": f"{_NODES_SQL} SELECT row_id, path, parent_path FROM nodes WHERE in_array AND json_type(v) = 'OBJECT'",
        "p3_table_sizes": f"""{_NODES_SQL}, found AS (SELECT regexp_replace(path, '/[0-9]+', '/*', 'g') AS schema_path FROM nodes WHERE in_array AND json_type(v) = 'OBJECT')
          SELECT CASE WHEN schema_path = '/*' THEN 'blocks' WHEN regexp_matches(schema_path, '^/\\*(/content/\\*)*/input/') THEN 'input_elements' WHEN schema_path LIKE '/*/content/%' THEN 'results' ELSE 'others' END AS flat_table,
          schema_path, count(*) AS n FROM found GROUP BY ALL""",
    }
