"""Queries over archived transcripts, trails, states and tool calls, with SQL of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import archive, ranges
from tidemark.session import spread
from tidemark.sources.tables import table

BRIDGE, GAP, ASOF_TOLERANCE, BAND = 400, 300, 300, 6


def _lines(spark, folder):
    return archive.file_lines(table(spark, folder, "documents"))


def transcript_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines, blank lines and characters of each file."""
    return _lines(spark, folder).groupBy("file").agg(F.count("*").alias("n_lines"), F.count_if(F.col("line").rlike(r"^\s*$")).alias("n_blank"), F.sum(F.length("line")).alias("n_chars"))


def turn_segments(spark, folder):
    return archive.turns(_lines(spark, folder))


def chunk_ranges(spark, folder):
    return archive.chunks(table(spark, folder, "documents")).select("file", "from_line", "to_line", F.length("chunk").alias("n_chars"))


def outline(spark, folder):
    return archive.outline(_lines(spark, folder))


def question_topics(spark, folder):
    return archive.question_topics(_lines(spark, folder))


def trail_links(spark, folder):
    e = archive.trail_entries(table(spark, folder, "documents"))
    return e.select("file", "day", "heading", F.posexplode("pointers").alias("at", "p")).select("file", "day", "heading", F.col("at").alias("link_no"), "p.path", "p.from_line", "p.to_line")


def code_modules(spark, folder):
    return archive.modules(_lines(spark, folder)).select("path", "description", F.size("symbols").alias("n_symbols"))


def _with_secrets(spark, folder):
    """Texts with a synthetic secret each, put together from pieces so that none lies in the repository."""
    docs = table(spark, folder, "documents").where("text IS NOT NULL")
    digits = F.lpad(F.col("doc_id").cast("string"), 8, "0")
    long = F.repeat(digits, 5)
    made = F.element_at(F.array(F.concat(F.lit("gh"), F.lit("p_"), F.substring(long, 1, 24)), F.concat(F.lit("sk"), F.lit("-"), long), F.concat(F.lit("AK"), F.lit("IA"), F.substring(long, 1, 16)), F.concat(F.lit("SERVICE_TO"), F.lit("KEN="), digits), F.concat(F.lit("Bea"), F.lit("rer "), long)), (F.col("doc_id") % 5 + 1).cast("int"))
    return docs.select("doc_id", F.concat(F.col("text"), F.lit("\n"), made, F.lit(" end")).alias("text"))


def redaction_counts(spark, folder):
    """Secrets replaced, by kind."""
    clean = spread(_with_secrets(spark, folder)).select("doc_id", tx.redact(F.col("text")).alias("text"))
    kinds = F.regexp_extract_all("text", F.lit(r"\[redacted:([a-z -]+)\]"), F.lit(1))
    return clean.select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def tool_calls(spark, folder):
    """One line for each first tool call of a message."""
    m = table(spark, folder, "messages").where("tool IS NOT NULL")
    return m.select("row_id", tx.tool_summary(F.col("tool"), F.col("input")).alias("summary"))


def command_kinds(spark, folder):
    """Shell calls by what they do."""
    m = table(spark, folder, "messages").where("tool = 'Bash'")
    return m.groupBy(F.coalesce(tx.command_kind(F.get_json_object("input", "$.command")), F.lit("other")).alias("kind")).agg(F.count("*").alias("n"))


def unarchived_sessions(spark, folder):
    """Sessions with messages that no statistics know."""
    return table(spark, folder, "messages").select("session").distinct().join(table(spark, folder, "session_stats"), "session", "left_anti")


def grown_sessions(spark, folder):
    """Sessions whose source has grown beyond what is archived."""
    return table(spark, folder, "session_state").where("bytes > byte_offset").select("session", (F.col("bytes") - F.col("byte_offset")).alias("behind"))


def uncovered_sessions(spark, folder):
    """Sessions that no pointer names."""
    p = archive.session_pointers(table(spark, folder, "trail"))
    return table(spark, folder, "session_state").select("session", "lines").join(p, "session", "left_anti")


def manifest_diff(spark, folder):
    """States and statistics matched: new, changed, deleted or same by day."""
    a = table(spark, folder, "session_state").select("session", F.col("day").alias("day_1"))
    b = table(spark, folder, "session_stats").groupBy("session").agg(F.max("day").alias("day_2"))
    state = F.when(F.col("day_2").isNull(), "new").when(F.col("day_1").isNull(), "deleted").when(F.col("day_1") != F.col("day_2"), "changed").otherwise("same")
    return a.join(b, "session", "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def pointer_validity(spark, folder):
    """Pointers by whether their session exists and their range lies inside of it."""
    p = archive.session_pointers(table(spark, folder, "trail")).join(table(spark, folder, "session_state").select("session", "lines"), "session", "left")
    verdict = F.when(F.col("lines").isNull(), "missing").when((F.col("from_line") < 1) | (F.coalesce("to_line", "from_line") > F.col("lines")), "outside").otherwise("valid")
    return p.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def _pointer_ranges(spark, folder):
    return archive.session_pointers(table(spark, folder, "trail")).select("session", F.col("from_line").cast("long").alias("from_line"), F.coalesce("to_line", "from_line").cast("long").alias("to_line"))


def interval_union(spark, folder):
    return ranges.merged(_pointer_ranges(spark, folder), "session")


def coverage_gaps(spark, folder):
    """Runs of at least GAP lines that no pointer covers; pointers at most BRIDGE lines apart count as one."""
    sizes = table(spark, folder, "session_state").select("session", "lines").where("lines > 0")
    return ranges.gaps(ranges.merged(_pointer_ranges(spark, folder), "session", BRIDGE), sizes, "session", GAP)


def _edits(spark, folder, *tools):
    return table(spark, folder, "messages").where(F.col("tool").isin(*tools)).groupBy("session", "line_no").agg(F.min("row_id").alias("row_id"))


def edits_in_range(spark, folder):
    """Edits inside the ranges that pointers name."""
    met = ranges.within(_edits(spark, folder, "Edit", "Write"), ranges.merged(_pointer_ranges(spark, folder), "session"), "session")
    return met.groupBy("session", "from_line", "to_line").agg(F.count("*").alias("n_edits"))


def asof_topic(spark, folder):
    """Each edit with the last pointer that ends at or before it, at most ASOF_TOLERANCE lines away."""
    marks = archive.session_pointers(table(spark, folder, "trail")).select("session", F.coalesce("to_line", "from_line").cast("long").alias("ends_at"), F.col("file").alias("topic"))
    return ranges.nearest_before(_edits(spark, folder, "Edit"), marks, "session", "line_no", "ends_at", ASOF_TOLERANCE, "topic")


def nearest_read(spark, folder):
    """Each edit with the nearest read on either side, at most BAND lines away."""
    reads = _edits(spark, folder, "Read").select("session", F.col("line_no").alias("read_line"), F.col("row_id").alias("read_row"))
    return ranges.nearest_around(_edits(spark, folder, "Edit"), reads, "session", "line_no", "read_line", BAND, "read_row")


def lookahead_flag(spark, folder):
    """Searches, and whether one of the next six tool calls of the session is a read."""
    calls = table(spark, folder, "messages").where("tool IS NOT NULL").groupBy("session", "line_no").agg(F.min_by("tool", "row_id").alias("tool"))
    ahead = Window.partitionBy("session").orderBy("line_no").rowsBetween(1, 6)
    flagged = calls.withColumn("opens", F.coalesce(F.max(F.when(F.col("tool") == "Read", 1).otherwise(0)).over(ahead), F.lit(0)))
    return flagged.where("tool = 'Search'").groupBy("opens").agg(F.count("*").alias("n"))


def prompt_to_files(spark, folder):
    """Files edited after each prompt of a user and before the next."""
    m = table(spark, folder, "messages")
    rows = m.where("(type = 'user' AND text IS NOT NULL) OR tool IN ('Edit', 'Write')").select("session", "line_no", "row_id", (F.col("type") == "user").cast("int").alias("asks"), F.get_json_object("input", "$.file_path").alias("path"))
    order = Window.partitionBy("session").orderBy("line_no", "row_id")
    numbered = rows.withColumn("prompt_no", F.sum("asks").over(order)).where("asks = 0 AND path IS NOT NULL AND prompt_no > 0")
    return numbered.groupBy("session", "prompt_no").agg(F.count_distinct("path").alias("n_files"))


def corrupt_quarantine(spark, folder):
    """Rows whose content is JSON, missing, or broken."""
    c = F.col("content")
    state = F.when(c.isNull(), "missing").when(F.try_parse_json(c).isNull(), "broken").otherwise("json")
    return table(spark, folder, "messages").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def passage_dedupe(spark, folder):
    """Documents whose whole text (line breaks and outer blanks aside) another with a smaller id has."""
    same = F.sha2(F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), r"^\s+|\s+$", ""), 256)
    d = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", same.alias("same"))
    first = d.groupBy("same").agg(F.min("doc_id").alias("kept"), F.count("*").alias("n")).where("n > 1")
    return d.join(first, "same").where("doc_id != kept").select("doc_id", "kept")


def multiset_diff(spark, folder):
    """Texts of documents without session, less those with one, each as often as it is left over."""
    d = table(spark, folder, "documents").where("text IS NOT NULL").select("session", F.md5(F.regexp_replace("text", r"\s+", " ")).alias("h"))
    return d.where("session IS NULL").select("h").exceptAll(d.where("session IS NOT NULL").select("h"))


def repeated_misses(spark, folder):
    """Lookups that missed, by query."""
    return table(spark, folder, "misses").where("q IS NOT NULL").groupBy("q").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def trail_index(spark, folder):
    """Trail entries by day, newest first within the count; expired ones are struck through."""
    mark = F.when(F.col("expired"), F.concat(F.lit("~~"), F.col("heading"), F.lit("~~"))).otherwise(F.col("heading"))
    return table(spark, folder, "trail").select("file", F.coalesce(F.col("day").cast("string"), F.lit("")).alias("day"), mark.alias("entry"), F.size("pointers").alias("n_pointers"))


_FILES = "ls AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL)"
_HEADER = r"^## (USER|CLAUDE|CODEX) - (\d{4}-\d{2}-\d{2} \d{2}:\d{2})(?: <!-- \w+:([0-9a-f]{24,64}) -->)?\s*$"
_TURNS = f"""{_FILES}, last AS (SELECT file, max(line_no) AS n_lines FROM ls GROUP BY file),
heads AS (SELECT file, line_no, regexp_extract(line, '{_HEADER}', 1) AS r, regexp_extract(line, '{_HEADER}', 2) AS s, regexp_extract(line, '{_HEADER}', 3) AS e FROM ls WHERE regexp_matches(line, '{_HEADER}')),
turns AS (SELECT file, row_number() OVER w AS turn_no, lower(r) AS role, s AS said_at, nullif(e, '') AS event_id, line_no AS from_line, coalesce(lead(line_no) OVER w - 1, n_lines) AS to_line
  FROM heads JOIN last USING (file) WINDOW w AS (PARTITION BY file ORDER BY line_no))"""
_LINK_SQL = r"\]\(([^)#\s]*)#L(\d+)(?:-L?(\d+))?\)"
_POINTERS = r"""ptr AS (SELECT file, day, heading, regexp_extract(p.path, '([^/]+)\.md$', 1) AS session, CAST(p.from_line AS BIGINT) AS from_line, CAST(p.to_line AS BIGINT) AS open_to,
  CAST(coalesce(p.to_line, p.from_line) AS BIGINT) AS to_line FROM (SELECT *, unnest(pointers) AS p FROM trail))"""


def _union_sql(apart: int) -> str:
    return f"""isl AS (SELECT *, CASE WHEN from_line <= max(to_line) OVER (PARTITION BY session ORDER BY from_line, to_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {apart} THEN 0 ELSE 1 END AS n
  FROM ptr WHERE from_line <= to_line),
num AS (SELECT *, sum(n) OVER (PARTITION BY session ORDER BY from_line, to_line ROWS UNBOUNDED PRECEDING) AS i FROM isl),
uni AS (SELECT session, min(from_line) AS from_line, max(to_line) AS to_line FROM num GROUP BY session, i)"""


_EDIT = "(SELECT session, line_no, min(row_id) AS row_id FROM messages WHERE tool IN ({}) GROUP BY ALL)"

SQL = {
    "transcript_lines": f"WITH {_FILES} SELECT file, count(*) AS n_lines, count(*) FILTER (regexp_matches(line, '^\\s*$')) AS n_blank, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM ls GROUP BY file",
    "turn_segments": f"WITH {_TURNS} SELECT * FROM turns",
    "chunk_ranges": f"""WITH RECURSIVE {_FILES}, c AS (
      SELECT file, line_no, line, 1 AS from_line, length(line) + 1 AS held FROM ls WHERE line_no = 1
      UNION ALL
      SELECT l.file, l.line_no, l.line, CASE WHEN c.held > 400 AND regexp_matches(c.line, '^\\s*$') THEN l.line_no ELSE c.from_line END,
        CASE WHEN c.held > 400 AND regexp_matches(c.line, '^\\s*$') THEN length(l.line) + 1 ELSE c.held + length(l.line) + 1 END
      FROM c JOIN ls l ON l.file = c.file AND l.line_no = c.line_no + 1)
      SELECT file, CAST(from_line AS INT) AS from_line, CAST(max(line_no) AS INT) AS to_line, CAST(max(held) - 1 AS INT) AS n_chars FROM c GROUP BY file, from_line""",
    "outline": f"""WITH {_FILES}, h AS (SELECT file, line_no, length(regexp_extract(line, '^(#+)', 1)) AS level, regexp_extract(line, '^#{{2,4}}\\s+(.*?)\\s*$', 1) AS heading FROM ls
      WHERE regexp_matches(line, '^#{{2,4}}\\s') AND NOT regexp_matches(line, '{_HEADER}')) SELECT * FROM h WHERE length(heading) BETWEEN 8 AND 90""",
    "question_topics": f"""WITH {_TURNS}, q AS (SELECT file, from_line, n_lines, lead(from_line) OVER (PARTITION BY file ORDER BY from_line) AS nq FROM turns JOIN last USING (file) WHERE role = 'user'),
      t AS (SELECT file, from_line, least(coalesce(nq - 1, n_lines), from_line - 1 + 120) AS to_line FROM q),
      f AS (SELECT t.file, t.from_line, t.to_line, arg_min(l.line, l.line_no) AS line FROM t JOIN ls l ON l.file = t.file AND l.line_no BETWEEN t.from_line + 1 AND t.from_line + 11
        WHERE NOT regexp_matches(l.line, '^\\s*$') AND NOT regexp_matches(l.line, '^\\s*(```|\\[Tool|## )') GROUP BY ALL),
      g AS (SELECT file, from_line, to_line, substring(regexp_replace(line, '^[-*#>\\s]+', ''), 1, 120) AS heading FROM f)
      SELECT * FROM g WHERE length(heading) >= 10""",
    "trail_links": f"""WITH e AS (SELECT doc_id AS file, regexp_extract(text, '^# (\\d{{4}}-\\d{{2}}-\\d{{2}}) · ([^\\n]*)', 1) AS day, trim(regexp_extract(text, '^# (\\d{{4}}-\\d{{2}}-\\d{{2}}) · ([^\\n]*)', 2)) AS heading, regexp_extract_all(text, '{_LINK_SQL}') AS l
        FROM documents WHERE regexp_matches(text, '^# (\\d{{4}}-\\d{{2}}-\\d{{2}}) · ')),
      u AS (SELECT file, day, heading, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS link_no FROM e)
      SELECT file, day, heading, CAST(link_no AS INT) AS link_no, regexp_extract(x, '{_LINK_SQL}', 1) AS path, CAST(regexp_extract(x, '{_LINK_SQL}', 2) AS INT) AS from_line, CAST(nullif(regexp_extract(x, '{_LINK_SQL}', 3), '') AS INT) AS to_line FROM u""",
    "code_modules": rf"""WITH {_FILES}, f AS (SELECT file, regexp_extract(line, '^- `([^`]+)` — (.*?)(?: · ([^·]*))?$', 1) AS path, regexp_extract(line, '^- `([^`]+)` — (.*?)(?: · ([^·]*))?$', 2) AS description,
        regexp_extract(line, '^- `([^`]+)` — (.*?)(?: · ([^·]*))?$', 3) AS listed FROM ls WHERE regexp_matches(line, '^- `([^`]+)` — (.*?)(?: · ([^·]*))?$')),
      r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY length(description) DESC, file, description DESC) AS n FROM f)
      SELECT path, description, CAST(len(regexp_extract_all(listed, '([A-Za-z_]\w*)\(\):(\d+)')) AS INT) AS n_symbols FROM r WHERE n = 1""",
    "redaction_counts": r"""WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), k AS (SELECT CASE doc_id % 5 WHEN 0 THEN 'github' WHEN 1 THEN 'openai' WHEN 2 THEN 'aws' WHEN 3 THEN 'env' ELSE 'bearer' END AS kind FROM d),
      was AS (SELECT unnest(regexp_extract_all(text, '\[redacted:([a-z -]+)\]', 1)) AS kind FROM d)
      SELECT kind, count(*) AS n FROM (SELECT kind FROM k UNION ALL SELECT kind FROM was) GROUP BY kind""",
    "command_kinds": r"""WITH c AS (SELECT CASE WHEN json_valid(input) AND json_type(input) = 'OBJECT' THEN input ->> '$.command' END AS c FROM messages WHERE tool = 'Bash')
      SELECT CASE WHEN regexp_matches(c, '(^|[;&|]\s*)(sudo\s+)?(sed\s+-i|tee|patch|mv|cp|rm)([^\w-]|$)') OR regexp_matches(c, '(^|[^0-9&>=-])>{1,2}\s*[\w./~$"''-]') THEN 'edit'
        WHEN regexp_matches(c, '(^|[;&|]\s*)(sudo\s+)?(grep|rg|ag|find|fd|ls|tree|git\s+(grep|ls-files|log))([^\w-]|$)') THEN 'lookup'
        WHEN regexp_matches(c, '(^|[;&|]\s*)(sudo\s+)?(cat|head|tail|less|bat|nl|sed\s+-n|awk)([^\w-]|$)') THEN 'read' ELSE 'other' END AS kind, count(*) AS n FROM c GROUP BY 1""",
    "unarchived_sessions": "SELECT DISTINCT session FROM messages WHERE session NOT IN (SELECT session FROM session_stats)",
    "grown_sessions": "SELECT session, bytes - byte_offset AS behind FROM session_state WHERE bytes > byte_offset",
    "uncovered_sessions": f"WITH {_POINTERS} SELECT session, lines FROM session_state WHERE session NOT IN (SELECT session FROM ptr)",
    "manifest_diff": """SELECT CASE WHEN b.day IS NULL THEN 'new' WHEN a.day IS NULL THEN 'deleted' WHEN a.day != b.day THEN 'changed' ELSE 'same' END AS state, count(*) AS n
      FROM session_state a FULL JOIN (SELECT session, max(day) AS day FROM session_stats GROUP BY session) b ON a.session = b.session GROUP BY 1""",
    "pointer_validity": f"""WITH {_POINTERS} SELECT CASE WHEN lines IS NULL THEN 'missing' WHEN from_line < 1 OR to_line > lines THEN 'outside' ELSE 'valid' END AS verdict, count(*) AS n FROM ptr LEFT JOIN session_state USING (session) GROUP BY 1""",
    "interval_union": f"WITH {_POINTERS}, {_union_sql(1)} SELECT * FROM uni",
    "coverage_gaps": f"""WITH {_POINTERS}, {_union_sql(BRIDGE)}, c AS (SELECT session, lines, greatest(from_line, 1) AS f, least(to_line, lines) AS t FROM uni JOIN session_state USING (session) WHERE lines > 0 AND greatest(from_line, 1) <= least(to_line, lines)),
      g AS (SELECT session, coalesce(lag(t) OVER (PARTITION BY session ORDER BY f), 0) + 1 AS from_line, f - 1 AS to_line FROM c
        UNION ALL SELECT session, max(t) + 1, max(lines) FROM c GROUP BY session
        UNION ALL SELECT session, 1, lines FROM session_state WHERE lines > 0 AND session NOT IN (SELECT session FROM uni))
      SELECT * FROM g WHERE to_line - from_line + 1 >= {GAP}""",
    "edits_in_range": f"""WITH {_POINTERS}, {_union_sql(1)} SELECT u.session, u.from_line, u.to_line, count(*) AS n_edits FROM uni u JOIN {_EDIT.format("'Edit', 'Write'")} e ON e.session = u.session AND e.line_no BETWEEN u.from_line AND u.to_line GROUP BY ALL""",
    "asof_topic": f"""WITH {_POINTERS}, r AS (SELECT e.*, p.to_line AS ends_at, p.file AS topic, row_number() OVER (PARTITION BY e.session, e.line_no ORDER BY p.to_line DESC, p.file) AS n
      FROM {_EDIT.format("'Edit'")} e JOIN ptr p ON p.session = e.session AND p.to_line BETWEEN e.line_no - {ASOF_TOLERANCE} AND e.line_no) SELECT session, line_no, row_id, ends_at, topic FROM r WHERE n = 1""",
    "nearest_read": f"""WITH r AS (SELECT e.*, x.line_no AS read_line, x.row_id AS read_row, row_number() OVER (PARTITION BY e.session, e.line_no ORDER BY abs(x.line_no - e.line_no), x.line_no, x.row_id) AS n
      FROM {_EDIT.format("'Edit'")} e JOIN {_EDIT.format("'Read'")} x ON x.session = e.session AND abs(x.line_no - e.line_no) <= {BAND}) SELECT session, line_no, row_id, read_line, read_row FROM r WHERE n = 1""",
    "lookahead_flag": """WITH c AS (SELECT session, line_no, arg_min(tool, row_id) AS tool FROM messages WHERE tool IS NOT NULL GROUP BY ALL),
      f AS (SELECT tool, coalesce(max(CASE WHEN tool = 'Read' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING), 0) AS opens FROM c)
      SELECT opens, count(*) AS n FROM f WHERE tool = 'Search' GROUP BY opens""",
    "prompt_to_files": """WITH r AS (SELECT session, line_no, row_id, CASE WHEN type = 'user' THEN 1 ELSE 0 END AS asks, CASE WHEN json_valid(input) AND json_type(input) = 'OBJECT' THEN input ->> '$.file_path' END AS path
        FROM messages WHERE (type = 'user' AND text IS NOT NULL) OR tool IN ('Edit', 'Write')),
      n AS (SELECT *, sum(asks) OVER (PARTITION BY session ORDER BY line_no, row_id ROWS UNBOUNDED PRECEDING) AS p FROM r)
      SELECT session, CAST(p AS BIGINT) AS prompt_no, count(DISTINCT path) AS n_files FROM n WHERE asks = 0 AND path IS NOT NULL AND p > 0 GROUP BY ALL""",
    "corrupt_quarantine": "SELECT CASE WHEN content IS NULL THEN 'missing' WHEN NOT json_valid(content) THEN 'broken' ELSE 'json' END AS state, count(*) AS n FROM messages GROUP BY 1",
    "passage_dedupe": r"""WITH d AS (SELECT doc_id, regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^\s+|\s+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS kept FROM d)
      SELECT doc_id, kept FROM f WHERE doc_id != kept""",
    "multiset_diff": r"""WITH d AS (SELECT session, md5(regexp_replace(text, '\s+', ' ', 'g')) AS h FROM documents WHERE text IS NOT NULL) SELECT h FROM d WHERE session IS NULL EXCEPT ALL SELECT h FROM d WHERE session IS NOT NULL""",
    "repeated_misses": "SELECT q, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM misses WHERE q IS NOT NULL GROUP BY q",
    "trail_index": "SELECT file, coalesce(CAST(day AS VARCHAR), '') AS day, CASE WHEN expired THEN '~~' || heading || '~~' ELSE heading END AS entry, CAST(len(pointers) AS INT) AS n_pointers FROM trail",
}

_ALL = (
    transcript_lines, turn_segments, chunk_ranges, outline, question_topics, trail_links, code_modules, redaction_counts, tool_calls, command_kinds, unarchived_sessions, grown_sessions,
    uncovered_sessions, manifest_diff, pointer_validity, interval_union, coverage_gaps, edits_in_range, asof_topic, nearest_read, lookahead_flag, prompt_to_files, corrupt_quarantine,
    passage_dedupe, multiset_diff, repeated_misses, trail_index,
)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
