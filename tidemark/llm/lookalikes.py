"""One form for text that looks the same: script-aware repair of look-alike letters.

Canonical composition, width variants, ligatures, blanks and shapeless characters are settled character by character.
Letters of another script are repaired token by token: the dominant script of the token is found, look-alikes are
replaced only in tokens that mix scripts (or that consist of look-alikes alone, in a text of another script), and only
when the result is in the vocabulary of the corpus' texts of that script.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import salted_join
from tidemark.session import settle, spread

# Letters of the same shape, Latin with Cyrillic and Latin with Greek.
LATIN_CYRILLIC = "aа cс eе iі jј oо pр sѕ xх yу hһ dԁ qԛ wԝ vѵ lӏ AА BВ CС EЕ HН IІ JЈ KК MМ OО PР QԚ SЅ TТ VѴ WԜ XХ YУ"
LATIN_GREEK = "oο vν cϲ jϳ AΑ BΒ EΕ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ XΧ YΥ ZΖ"

_CYR_TO_LAT = {ord(c): a for a, c in LATIN_CYRILLIC.split()}
_GRK_TO_LAT = {ord(g): a for a, g in LATIN_GREEK.split()}
_LAT_TO_CYR = {ord(a): c for a, c in LATIN_CYRILLIC.split()}
_LAT_TO_GRK = {ord(a): g for a, g in LATIN_GREEK.split()}
_CYR_TO_GRK = {c: _LAT_TO_GRK[ord(a)] for c, a in _CYR_TO_LAT.items() if ord(a) in _LAT_TO_GRK}
_GRK_TO_CYR = {g: _LAT_TO_CYR[ord(a)] for g, a in _GRK_TO_LAT.items() if ord(a) in _LAT_TO_CYR}
TO_SCRIPT = {"L": _CYR_TO_LAT | _GRK_TO_LAT, "C": _LAT_TO_CYR | _GRK_TO_CYR, "G": _LAT_TO_GRK | _CYR_TO_GRK}
_LOOKALIKE = re.compile("[" + "".join(map(chr, {*_CYR_TO_LAT, *_GRK_TO_LAT, *_LAT_TO_CYR, *_LAT_TO_GRK})) + "]")

_LATIN = re.compile(r"[A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ]")
_CYRILLIC = re.compile(r"[Ѐ-ԯ]")
_GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
_OTHER = re.compile(r"[Ͱ-ԯἀ-῿]")
_TOKEN = re.compile(r"[^\W_]+(?:[\u0300-\u036f]+[^\W_]*)*")
_SCRIPTS = (("L", _LATIN), ("C", _CYRILLIC), ("G", _GREEK))
_JOINER = re.compile("\u200d(?![←-⯿\U0001f000-\U0001faff])|(?<![←-⯿\ufe0f\U0001f000-\U0001faff])\u200d")


@cache
def _settled() -> dict[int, str | None]:
    """What single characters become: from their decompositions and categories."""
    out: dict[int, str | None] = {}
    for c in (*range(0x80, 0x10000), *range(0xE0000, 0xE0200)):
        ch = chr(c)
        kind, _, parts = unicodedata.decomposition(ch).partition(" ")
        category = unicodedata.category(ch)
        if category == "Zs" or c == 0x2800:
            out[c] = " "
        elif category == "Cf" and c != 0x200D and not 0x600 <= c <= 0x605 and c not in (0x6DD, 0x70F, 0x8E2):
            out[c] = None
        elif c in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= c <= 0x180F or 0xFE00 <= c <= 0xFE0E or 0xE0100 <= c <= 0xE01EF:
            out[c] = None
        elif kind in ("<wide>", "<narrow>") or kind == "<compat>" and category[0] == "L":
            out[c] = unicodedata.normalize("NFKC", ch)
    out |= {c: None for c in (*range(0x00, 0x09), 0x0B, 0x0C, 0x0D, *range(0x0E, 0x20), 0x7F)} | {0x09: " "}
    return out


_CONTROL = re.compile(r"[\x00-\x09\x0b-\x1f\x7f]")


def settle_characters(text: str) -> str:
    """Composition, width, ligatures, blanks and shapeless characters; letters of other scripts stay.

    A joiner between pictographs stays, as it makes one picture of two; carriage returns and control characters have no shape.
    """
    if text.isascii() and not _CONTROL.search(text):
        return text
    text = text.translate(_settled())
    return unicodedata.normalize("NFC", _JOINER.sub("", text) if "\u200d" in text else text)


def shows_something(text: str) -> bool:
    """Whether anything but blanks and shapeless characters is left."""
    return not settle_characters(text).isspace() if text and settle_characters(text) else False


def skeleton(text: str) -> str:
    """Settled text with every look-alike as its Latin letter: equal for equal looks, whatever the corpus holds."""
    text = settle_characters(text)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(TO_SCRIPT["L"])) if _OTHER.search(text) else text


def _to_script(token: str, script: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", token).translate(TO_SCRIPT[script]))


def _dominant(s: str) -> str:
    """The script of most letters that have no look-alike, so that swapped look-alikes don't sway it; Latin on a tie or if there are none."""
    if not _OTHER.search(s):
        return "L"
    plain = _LOOKALIKE.sub("", unicodedata.normalize("NFD", s))
    counts = [(len(r.findall(plain)), k) for k, r in _SCRIPTS]
    most = max(n for n, _ in counts)
    return next(k for n, k in counts if n == most)


def suspicious(text: str) -> tuple[str, dict[str, list[str]]]:
    """The script of a settled text, and its tokens that may hold look-alikes, each with the forms to look up, the likeliest first.

    A token that mixes scripts belongs to the script of its letters without look-alikes. A token all of look-alikes has no
    script of its own: it may be of the text's script or, failing that in the corpus, of another.
    """
    script = _dominant(text)
    found: dict[str, list[str]] = {}
    if not _OTHER.search(text):
        return script, found
    for t in set(_TOKEN.findall(text)):
        scripts = [k for k, r in _SCRIPTS if r.search(t)]
        if not scripts or scripts == [script]:
            continue
        rest = _LOOKALIKE.sub("", unicodedata.normalize("NFD", t))
        if any(r.search(rest) for _, r in _SCRIPTS):
            if len(scripts) > 1:
                found[t] = [_to_script(t, _dominant(t))]
        else:
            forms = [_to_script(t, k) for k in (script, *(k for k in "LCG" if k != script))]
            found[t] = [f for f in dict.fromkeys(forms) if sum(bool(r.search(f)) for _, r in _SCRIPTS) == 1]
    return script, found


def repair(text: str, accepted: dict[str, str]) -> str:
    """Replaces the accepted tokens of a settled text."""
    return _TOKEN.sub(lambda m: accepted.get(m[0], m[0]), text) if accepted else text


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).digest()


_SCAN = pa.schema(
    {
        "kind": pa.string(), "row": pa.int64(), "raw": pa.binary(), "key": pa.binary(), "look": pa.binary(), "settled": pa.string(),
        "script": pa.string(), "tokens": pa.list_(pa.string()), "token": pa.string(), "form": pa.string(), "n": pa.int64(),
    }
)
_SCAN_DDL = "kind string, row long, raw binary, key binary, look binary, settled string, script string, tokens array<string>, token string, form string, n long"
#: Distinct tokens that a task holds before it passes their counts on.
_HELD = 200_000


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCAN)], schema=_SCAN)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows 'R' of each visible text, and from the whole task token counts 'V' and looked-up forms 'S'."""
    words: dict[str, Counter] = {"L": Counter(), "C": Counter(), "G": Counter()}
    asked: set[tuple[str, str, str, int]] = set()

    def counts() -> Iterator[pa.RecordBatch]:
        rows = [("V", None, None, None, None, None, k, None, t, None, n) for k, c in words.items() for t, n in c.items()]
        rows += [("S", None, None, None, None, None, k, None, t, f, i) for k, t, f, i in asked]
        for i in range(0, len(rows), 20_000):
            yield _batch(rows[i : i + 20_000])
        asked.clear()
        for c in words.values():
            c.clear()

    for b in batches:
        rows = []
        for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            flat = settle_characters(text)
            if not flat or flat.isspace():
                continue
            script, found = suspicious(flat)
            words[script].update(_TOKEN.findall(flat))
            asked.update((script, t, f, i) for t, forms in found.items() for i, f in enumerate(forms))
            raw = _digest(text)
            key = raw if flat == text else _digest(flat)
            look = _digest(skeleton(flat)) if _OTHER.search(flat) else key
            rows.append(("R", row, raw, key, look, flat if found else None, script, list(found), None, None, None))
        if rows:
            yield _batch(rows)
        if sum(map(len, words.values())) + len(asked) > _HELD:
            yield from counts()
    yield from counts()


_FIXED = pa.schema({"row": pa.int64(), "raw": pa.binary(), "key": pa.binary(), "look": pa.binary(), "text": pa.string()})


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        t = pa.Table.from_batches([b]).to_pydict()
        fixed = [repair(s, {p["token"]: p["form"] for p in pairs}) for s, pairs in zip(t["settled"], t["pairs"])]
        yield pa.RecordBatch.from_arrays([pa.array(t["row"], pa.int64()), pa.array(t["raw"], pa.binary()), pa.array([_digest(x) for x in fixed], pa.binary()), pa.array(t["look"], pa.binary()), pa.array(fixed, pa.string())], schema=_FIXED)


#: Parts into which the rows of one token or one look are split before they are joined.
SALTS = 16


def canonical_keys(df: DataFrame, text_col: str = "text", row_col: str = "row_id") -> DataFrame:
    """Of each row with visible text: raw (digest of the text as it stands), key (digest of its repaired form), look (digest of its skeleton),
    and text (the repaired form, where letters were looked up; elsewhere null: `settle_characters` gives it).

    Null, empty and blank texts give no row. Rows that occur twice come out twice.
    Scale: one pass over the texts; what is shuffled are token counts (combined in each task), and the rows with look-alikes.
    """
    needed = df.select(F.col(row_col).cast("long").alias("row"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL AND text != ''")
    scan = settle(spread(needed).mapInArrow(_scan, _SCAN_DDL))
    counts = scan.where("kind = 'V'").groupBy("script", "token").agg(F.sum("n").alias("n"))
    asked = scan.where("kind = 'S'").select("script", "token", "form", F.col("n").alias("choice")).distinct()
    accepted = (
        asked.join(counts.select("script", F.col("token").alias("form")), ["script", "form"])
        .groupBy("script", "token")
        .agg(F.min_by("form", "choice").alias("form"))
        .where("form != token")
    )
    rows = scan.where("kind = 'R'")
    salted = accepted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    doubtful = rows.where("size(tokens) > 0").select("row", "raw", "look", "settled", "script", "tokens")
    pairs = (
        doubtful.select("row", "raw", "script", F.explode("tokens").alias("token"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"))
        .join(salted, ["script", "token", "salt"])
        .groupBy("row", "raw")
        .agg(F.collect_set(F.struct("token", "form")).alias("pairs"))
    )
    repaired = (
        doubtful.join(pairs, ["row", "raw"], "left")
        .select("row", "raw", "look", "settled", F.coalesce("pairs", F.array().cast("array<struct<token:string,form:string>>")).alias("pairs"))
        .mapInArrow(_apply, "row long, raw binary, key binary, look binary, text string")
    )
    certain = rows.where("size(tokens) = 0").select("row", "raw", "key", "look", F.lit(None).cast("string").alias("text"))
    return certain.unionByName(repaired).withColumnRenamed("row", row_col)


def same_look_pairs(df: DataFrame, text_col: str = "text", row_col: str = "row_id") -> DataFrame:
    """Pairs of rows, the smaller first, whose repaired texts are equal but whose texts are not; an exact check of the skeletons follows.

    Equal texts are no pair. Rows are first brought together as classes of equal texts, classes of one look are paired, and only these pairs are
    expanded into rows, the smaller class first; so a text that a third of all rows have costs no more than its pairs. The rows of the larger
    class are met in parts. A row number that occurs twice with different texts makes no pair with itself.
    """
    keys = settle(canonical_keys(df, text_col, row_col).select(F.col(row_col).alias("row"), "raw", "key", "look"))
    classes = keys.groupBy("key", "look", "raw").agg(F.count("*").alias("n"))
    several = classes.groupBy("key", "look").agg(F.count("*").alias("texts")).where("texts > 1").select("key", "look")
    classes = settle(classes.join(several, ["key", "look"], "left_semi"))
    larger = classes.select("key", "look", F.col("raw").alias("raw_1"), F.col("n").alias("n_1"))
    smaller = classes.select("key", "look", F.col("raw").alias("raw_2"), F.col("n").alias("n_2"))
    paired = salted_join(larger, smaller, ["key", "look"], "raw_1", salts=SALTS).where("n_1 > n_2 OR (n_1 = n_2 AND raw_1 > raw_2)").select("raw_1", "raw_2")
    members = keys.join(classes.select("raw"), "raw", "left_semi").select("raw", "row")
    half = salted_join(members.select(F.col("raw").alias("raw_2"), F.col("row").alias("row_2")), paired, ["raw_2"], "row_2", salts=SALTS).select("raw_1", "row_2")
    met = salted_join(members.select(F.col("raw").alias("raw_1"), F.col("row").alias("row_1")), half, ["raw_1"], "row_1", salts=SALTS).where("row_1 != row_2")
    return met.select(F.least("row_1", "row_2").alias(f"{row_col}_1"), F.greatest("row_1", "row_2").alias(f"{row_col}_2"))


def unify(df: DataFrame, text_col: str = "text", row_col: str = "row_id", out_col: str = "text_unified") -> DataFrame:
    """df with its text in one form for equal looks; null stays null. row_col must be unique."""

    @F.pandas_udf("string")
    def settled(s: pd.Series) -> pd.Series:
        return s.map(settle_characters, na_action="ignore")

    fixed = canonical_keys(df, text_col, row_col).where("text IS NOT NULL").select(F.col(row_col).alias("_look_row"), F.col("text").alias("_look_text"))
    return df.join(fixed, df[row_col] == F.col("_look_row"), "left").withColumn(out_col, F.coalesce("_look_text", settled(F.col(text_col)))).drop("_look_row", "_look_text")
