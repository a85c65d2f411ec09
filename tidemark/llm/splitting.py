"""Cutting oversized texts at natural boundaries, with overlap.

A hierarchy of separators (section, paragraph, line, sentence, word, character) cuts a text recursively into atoms that fit;
atoms are packed greedily into pieces up to the limit, each piece beginning with the end of the one before.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where one may cut, the most natural first: each pattern ends at the cut.
SEPARATORS = tuple(
    re.compile(p)
    for p in (
        r"\n(?=#{1,6} )",  # section
        r"\n[ \t\r]*\n\s*",  # paragraph
        r"\n\s*",  # line
        r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[」』）]*\s*",  # sentence
        r"\s+",  # word
    )
)


def _character_cut(text: str, lo: int, hi: int) -> int:
    """hi, or a little before it if a mark or joiner would be torn from its character."""
    at = hi
    while at > lo + 1 and at < len(text) and (unicodedata.category(text[at])[0] == "M" or text[at] in "\u200d\ufe0f" or text[at - 1] == "\u200d"):
        at -= 1
    return at if at > lo + 1 else hi


def atoms(text: str, size: int) -> Iterator[int]:
    """Ends of consecutive parts of at most size characters, cut at the most natural separators that do it."""
    stack = [(0, len(text), 0)]
    while stack:
        lo, hi, level = stack.pop()
        if hi - lo <= size:
            yield hi
        elif level == len(SEPARATORS):
            while hi - lo > size:
                lo = _character_cut(text, lo, lo + size)
                yield lo
            yield hi
        else:
            cuts = [m.end() for m in SEPARATORS[level].finditer(text, lo, hi) if lo < m.end() < hi]
            bounds = [lo, *cuts, hi]
            stack += [(a, b, level + 1) for a, b in reversed(list(zip(bounds, bounds[1:])))]


def spans(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of the pieces of a text: none longer than limit, each starting overlap characters before the end of the last."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    if len(text) <= limit:
        return [(0, len(text))]
    out: list[tuple[int, int]] = []
    start = end = 0
    for cut in atoms(text, limit - overlap):
        if cut - start > limit:
            out.append((start, end))
            start = max(0, end - overlap)
        end = cut
    return [*out, (start, end)]


_PIECES = "row long, piece_no int, start_at int, end_at int, n_pieces int, piece string"


def _cutter(limit: int, overlap: int):
    schema = pa.schema({"row": pa.int64(), "piece_no": pa.int32(), "start_at": pa.int32(), "end_at": pa.int32(), "n_pieces": pa.int32(), "piece": pa.string()})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = spans(text, limit, overlap)
                for i, (lo, hi) in enumerate(found, 1):
                    out.append((row, i, lo, hi, len(found), text[lo:hi]))
                    held += hi - lo
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return cut


def split_oversized(df: DataFrame, limit: int, overlap: int, text_col: str = "text", row_col: str = "row_id") -> DataFrame:
    """Pieces of each text in order: row, piece_no from 1, start_at and end_at in characters, n_pieces, piece.

    A text within the limit is one piece and stays in the JVM; an empty text is one empty piece; a null text has none. Rows that occur twice
    are cut twice. Narrow: no shuffle, two columns read; a text is cut in linear time whatever its length.
    """
    spans("", limit, overlap)
    needed = df.select(F.col(row_col).cast("long").alias("row"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    size = F.length("text")
    whole = needed.where(size <= limit).select("row", F.lit(1).alias("piece_no"), F.lit(0).alias("start_at"), size.alias("end_at"), F.lit(1).alias("n_pieces"), F.col("text").alias("piece"))
    cut = needed.where(size > limit).mapInArrow(_cutter(limit, overlap), _PIECES)
    return whole.unionByName(cut).withColumnRenamed("row", row_col)
