"""Archived transcripts: lines, turns, chunks, topics, outline and trail entries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.session import spread

#: Characters that a chunk holds before it closes at a blank line.
CHUNK_CHARACTERS = 400
#: Lines that a question's topic covers at most; lines that a heading's topic covers at least and at most.
QUESTION_LINES, HEADING_LEAST, HEADING_MOST = 120, 15, 60
TURN_HEADER = r"^## (USER|CLAUDE|CODEX) - (\d{4}-\d{2}-\d{2} \d{2}:\d{2})(?: <!-- \w+:([0-9a-f]{24,64}) -->)?\s*$"
_LINK = r"\]\(([^)#\s]*)#L(\d+)(?:-L?(\d+))?\)"


def file_lines(files: DataFrame, file_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """file, line_no from 1, line. Null texts have no lines."""
    return files.where(F.col(text_col).isNotNull()).select(F.col(file_col).alias("file"), F.posexplode(tx.lines(F.col(text_col))).alias("pos", "line")).select("file", (F.col("pos") + 1).alias("line_no"), "line")


def turns(lines: DataFrame) -> DataFrame:
    """file, turn_no, role, said_at, event_id (null if unmarked), from_line, to_line: from a header to the line before the next."""
    header = lines.where(F.col("line").rlike(TURN_HEADER))
    order = Window.partitionBy("file").orderBy("line_no")
    last = lines.groupBy("file").agg(F.max("line_no").alias("n_lines"))
    part = lambda i: F.regexp_extract("line", TURN_HEADER, i)
    numbered = header.select("file", F.row_number().over(order).alias("turn_no"), F.lower(part(1)).alias("role"), part(2).alias("said_at"), F.when(part(3) != "", part(3)).alias("event_id"), F.col("line_no").alias("from_line"), F.lead("line_no").over(order).alias("next_line"))
    return numbered.join(last, "file").select("file", "turn_no", "role", "said_at", "event_id", "from_line", F.coalesce(F.col("next_line") - 1, F.col("n_lines")).alias("to_line"))


def chunk_bounds(text: str, size: int = CHUNK_CHARACTERS) -> list[tuple[int, int, str]]:
    """First line, last line and text of each chunk: it closes at a blank line once its lines have more than size characters, breaks included."""
    out, start, held, lines = [], 1, 0, text.split("\n")
    for no, line in enumerate(lines, 1):
        held += len(line) + 1
        if held > size and not line.strip():
            out.append((start, no, "\n".join(lines[start - 1 : no])))
            start, held = no + 1, 0
    if start <= len(lines):
        out.append((start, len(lines), "\n".join(lines[start - 1 :])))
    return out


def chunks(files: DataFrame, file_col: str = "doc_id", text_col: str = "text", size: int = CHUNK_CHARACTERS) -> DataFrame:
    """file, from_line, to_line, chunk; narrow, one pass. Null texts have none."""
    schema = pa.schema({"file": pa.int64(), "from_line": pa.int32(), "to_line": pa.int32(), "chunk": pa.string()})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(f, *c) for f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for c in chunk_bounds(t, size)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return spread(files.where(F.col(text_col).isNotNull()).select(F.col(file_col).cast("long").alias("file"), F.col(text_col).alias("text"))).mapInArrow(cut, "file long, from_line int, to_line int, chunk string")


def outline(lines: DataFrame) -> DataFrame:
    """Headings of levels 2 to 4 with 8 to 90 characters that are no turn headers: file, line_no, level, heading."""
    heading = F.regexp_extract("line", r"^#{2,4}\s+(.*?)\s*$", 1)
    found = lines.where(F.col("line").rlike(r"^#{2,4}\s") & ~F.col("line").rlike(TURN_HEADER)).select("file", "line_no", F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), heading.alias("heading"))
    return found.where(F.length("heading").between(8, 90))


def question_topics(lines: DataFrame) -> DataFrame:
    """file, from_line, to_line, heading: each user turn up to the next, at most QUESTION_LINES lines; the heading is the first meaningful line within 11."""
    all_turns = turns(lines)
    last = lines.groupBy("file").agg(F.max("line_no").alias("n_lines"))
    order = Window.partitionBy("file").orderBy("from_line")
    asked = all_turns.where("role = 'user'").select("file", "from_line", F.lead("from_line").over(order).alias("next_question")).join(last, "file")
    asked = asked.withColumn("to_line", F.least(F.coalesce(F.col("next_question") - 1, F.col("n_lines")), F.col("from_line") - 1 + QUESTION_LINES))
    near = asked.withColumn("line_no", F.explode(F.sequence(F.col("from_line") + 1, F.col("from_line") + 11)))
    meaningful = lines.where(~F.col("line").rlike(r"^\s*$") & ~F.col("line").rlike(r"^\s*(?:```|\[Tool|## )"))
    said = near.join(meaningful, ["file", "line_no"]).groupBy("file", "from_line").agg(F.min_by("line", "line_no").alias("line"))
    heading = F.substring(F.regexp_replace("line", r"^[-*#>\s]+", ""), 1, 120)
    return asked.join(said, ["file", "from_line"]).select("file", "from_line", "to_line", heading.alias("heading")).where(F.length("heading") >= 10)


def trail_entries(files: DataFrame, file_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """file, day, heading, pointers (path, from_line, to_line) of trail texts: those that begin with a dated heading."""
    head = r"^# (\d{4}-\d{2}-\d{2}) · ([^\n]*)"
    links = F.regexp_extract_all(F.col(text_col), F.lit(_LINK), F.lit(0))
    number = lambda x, i: F.regexp_extract(x, _LINK, i)
    pointers = F.transform(links, lambda x: F.struct(number(x, 1).alias("path"), number(x, 2).cast("int").alias("from_line"), F.when(number(x, 3) != "", number(x, 3)).cast("int").alias("to_line")))
    return files.where(F.col(text_col).rlike(head)).select(F.col(file_col).alias("file"), F.regexp_extract(text_col, head, 1).alias("day"), F.trim(F.regexp_extract(text_col, head, 2)).alias("heading"), pointers.alias("pointers"))


def session_pointers(trail: DataFrame) -> DataFrame:
    """file, day, heading, session, from_line, to_line of each pointer of a trail table; an open end stays null."""
    p = trail.select("file", "day", "heading", "expired", F.explode("pointers").alias("p"))
    return p.select("file", "day", "heading", "expired", F.regexp_extract("p.path", r"([^/]+)\.md$", 1).alias("session"), F.col("p.from_line").alias("from_line"), F.col("p.to_line").alias("to_line"))




def modules(lines: DataFrame) -> DataFrame:
    """path, description, symbols (name, line) from code-map lines; of a path that is listed several times the longest description, then the first file."""
    pattern = r"^- `([^`]+)` — (.*?)(?: · ([^·]*))?$"
    found = lines.where(F.col("line").rlike(pattern)).select("file", F.regexp_extract("line", pattern, 1).alias("path"), F.regexp_extract("line", pattern, 2).alias("description"), F.regexp_extract("line", pattern, 3).alias("listed"))
    symbol = r"([A-Za-z_]\w*)\(\):(\d+)"
    symbols = F.transform(F.regexp_extract_all("listed", F.lit(symbol), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, symbol, 1).alias("name"), F.regexp_extract(x, symbol, 2).cast("int").alias("line")))
    best = found.groupBy("path").agg(F.max_by(F.struct("description", "listed"), F.struct(F.length("description"), -F.col("file"), "description")).alias("b"))
    return best.select("path", "b.description", F.col("b.listed").alias("listed")).select("path", "description", symbols.alias("symbols"))
