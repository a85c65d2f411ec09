"""Personal information in free text: found, and replaced by typed placeholders.

What has a form of its own (addresses for mail and post, phone and identity numbers) is found by that form. Names have none: the corpus tells.
Terms that stand beside protected name parts are counted over all texts; a term whose share of such places (its disclosure) exceeds a threshold
reveals a person just as the listed parts do, becomes a protected part itself, and is removed wherever it completes a name. Letters before digits
are as ambiguous: they mark an identity number only if their places in the corpus disclose it, standing by words for papers or by other such data.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.nested import decoded, parse
from tidemark.session import settle, spread

#: A term is protected if at least this share of its places is beside a protected part that no other part explains.
DISCLOSURE = 0.3
#: Different listed parts that it must stand beside.
LEAST_PARTNERS = 2
#: Parts into which the places of one term are split before they are joined.
SALTS = 16

_UPPER = "".join(c for c in map(chr, range(0x41, 0x530)) if c.isupper())
_S = "[ \u00a0\u2007\u2009\u202f]"  # a blank that may be protected
_NUMBER = r"\d{1,5}(?:[/-]\d{1,5})?[A-Za-z]?(?![\w])"
_CAP = rf"[{_UPPER}][^\W\d_]+(?:[-’'][^\W\d_]+)*"

# Words for street and what they stand by.
_STREET_EN = "Road|Street|Lane|Avenue|Close|Drive|Court|Place|Square|Terrace|Crescent|Way|Walk|Row|Rise|Hill|Gardens|Grove|Mews|Boulevard|Parkway|Plaza|Highway|Rd\\.?|St\\.?|Ln\\.?|Ave\\.?|Blvd\\.?|Dr\\.?"
_STREET_SK = "ulica|ulici|ulice|cesta|trieda|nábrežie|námestie|Ulica|Cesta|Trieda|Nábrežie|Námestie"
_BEFORE_SK = "ul\\.|Ul\\.|nám\\.|Nám\\.|Námestie|námestie|Ulica|ulica|Nábrežie|nábrežie|Trieda|trieda|tr\\.|Cesta|вул\\.|вулиця|площа|пл\\."
_PREPOSITION_SK = "Na|Pod|Nad|Pri|Za|Pred|Medzi|K|V|U"
_BEFORE_ROMANCE = "Rue|Avenue|Boulevard|Place|Via|Viale|Piazza|Corso|Calle|Avenida|Plaza|Rua|Praça"
_STREET_DE = "straße|strasse|str\\.|platz|weg|gasse|allee|ring|ufer|damm|steig|markt"

ADDRESS = re.compile(
    rf"(?<![\w/.-])(?:"
    rf"\d{{1,5}}[A-Za-z]?{_S}(?:{_CAP}{_S}){{1,3}}(?:{_STREET_EN})(?![\w])"
    rf"|(?:{_BEFORE_ROMANCE}){_S}(?:(?:de|du|des|de la|della|del|di|da|dos){_S})?{_CAP}(?:{_S}{_CAP}){{0,2}},?{_S}{_NUMBER}"
    rf"|(?:{_CAP}{_S}){{1,3}}(?:{_STREET_EN}){_S}{_NUMBER}"
    rf"|(?:(?:{_PREPOSITION_SK}){_S})?{_CAP}(?:{_S}{_CAP})?{_S}(?:{_STREET_SK}){_S}{_NUMBER}"
    rf"|(?:{_BEFORE_SK}){_S}?(?:(?:{_PREPOSITION_SK}|{_PREPOSITION_SK.lower()}){_S})?{_CAP}(?:{_S}{_CAP}){{0,2}},?{_S}{_NUMBER}"
    rf"|{_CAP}(?:{_STREET_DE}){_S}{_NUMBER}"
    rf"|(?:{_CAP}{_S}){{1,2}}(?:Straße|Strasse|Platz|Weg|Gasse|Allee|Ring|Ufer|Damm){_S}{_NUMBER}"
    rf")"
)
#: What an address of the kinds above can't do without; spares most texts the pattern.
_STREET_HINT = re.compile(rf"(?:{_STREET_EN}|{_STREET_SK}|{_BEFORE_SK}|{_BEFORE_ROMANCE}|(?:{_STREET_DE}|Straße|Strasse|Platz|Weg|Gasse|Allee|Ring|Ufer|Damm){_S}\d)")

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_LOCAL = r"[^\W_](?:[\w.+%'-]*[\w+%-])?"
_AT = r"\s?[\[({<]\s?(?:at|AT|At|zavináč|ät|@)\s?[\])}>]\s?"
_DOT = r"(?:\s?[\[({<]\s?(?:dot|DOT|Dot|bodka|punkt|Punkt|\.)\s?[\])}>]\s?|\.)"
EMAIL = re.compile(
    rf"(?<![\w.+%-])(?:{_LOCAL}@(?:{_LABEL}\.)+[A-Za-z]{{2,}}(?![\w@])"
    rf"|{_LOCAL}(?:{_DOT}{_LOCAL})*{_AT}{_LABEL}(?:{_DOT}{_LABEL})+"
    rf"|{_LOCAL}(?: (?:dot|bodka|punkt) {_LOCAL})* (?:at|zavináč) {_LABEL}(?: (?:dot|bodka|punkt) {_LABEL})+)"
)
_EMAIL_HINT = re.compile(r"@|[\[({<]\s?(?:at|AT|At|zavináč|ät)\s?[\])}>]| (?:at|zavináč) \S+ (?:dot|bodka|punkt) ")

ID_NUMBER = re.compile(
    rf"(?<![\w/.-])(?:\d{{3}}-\d{{2}}-\d{{4}}"  # social insurance
    rf"|[A-Z]{{2}}{_S}?\d{{2}}{_S}?\d{{2}}{_S}?\d{{2}}{_S}?[A-D]"  # national insurance
    rf"|\d{{6}}{_S}?/{_S}?\d{{3,4}})"  # birth number
    r"(?![\w/]|[-.]\d)"
)
#: Passports and identity cards, but also tickets, parts and the like: the corpus decides by the letters.
OPEN_ID = re.compile(rf"(?<![\w/.-])([A-Z]{{2}}){_S}?\d{{6,7}}(?![\w/]|[-.]\d)")
# Words for papers of persons (case folded).
PAPERS = re.compile(r"passport|identity|id card|id no|insurance|pas(?:u|om)?\b|cestovn|preukaz|občiansk|doklad|reisepass|ausweis|pass(?:nummer|-nr)|паспорт|посвідчення|旅券|パスポート|身分証")
#: Characters before an open number in which such a word, or on either side in which other personal data, is evidence.
_NEAR = 24
_G = "[ \u00a0\u2007\u2009\u202f.-]"
PHONE = re.compile(
    rf"(?<![\w/.@#:-])(?:(?:\+|00)[1-9]\d{{0,2}}{_G}?(?:\(\d{{1,4}}\){_G}?)?\d{{2,4}}(?:{_G}?\d{{2,4}}){{1,4}}"
    rf"|\(0?\d{{2,4}}\){_G}?\d{{3,4}}{_G}?\d{{3,4}}"
    rf"|0\d{{3,4}}[ \u00a0\u2007\u2009\u202f/]\d{{3}}{_S}?\d{{3}}"
    rf"|(?<=[Cc]all )\d{{3}}[ .-]\d{{4}}|(?<=[Tt]el\. )\d{{3}}[ .-]\d{{4}}|(?<=[Pp]hone )\d{{3}}[ .-]\d{{4}}"
    rf"|\d{{3}}([ \u00a0\u2007\u2009\u202f.-])\d{{3}}\1\d{{4}})"
    r"(?![\w/]|[-.:]\d)"
)
_DIGITS = re.compile(r"\d{3}|\d\d[ \u00a0\u2007\u2009\u202f]\d\d")

_WORD = re.compile(rf"[{_UPPER}][^\W\d_]+(?:-[{_UPPER}][^\W\d_]+)*(?![\w])")
_RUN = re.compile(rf"(?<![\w@./-])(?:[{_UPPER}](?:\.|[^\W\d_]+(?:-[{_UPPER}][^\W\d_]+)*(?![\w.@/-]|\(\))|[^\W\d_]+(?:-[{_UPPER}][^\W\d_]+)*(?=\.(?!\w))))(?:,?{_S}[{_UPPER}](?:\.|[^\W\d_]+(?:-[{_UPPER}][^\W\d_]+)*(?![\w@/-]|\.\w|\(\))))+")
_PART = re.compile(rf"[{_UPPER}](?:\.|[^\W\d_]+(?:-[{_UPPER}][^\W\d_]+)*)")


def formed(text: str) -> list[tuple[str, str, int, int]]:
    """Kind, stretch, start and end of what has a form of its own; no two overlap. The kind 'open_id' is one that the corpus has yet to decide on."""
    out: list[tuple[str, str, int, int]] = []

    def take(kind: str, pattern: re.Pattern) -> None:
        for m in pattern.finditer(text):
            if kind == "phone" and sum(map(str.isdigit, m[0])) > 15:
                continue
            if not any(m.start() < e and s < m.end() for _, _, s, e in out):
                out.append((kind, m[0], m.start(), m.end()))

    if _EMAIL_HINT.search(text):
        take("email", EMAIL)
    if _DIGITS.search(text):
        take("id_number", ID_NUMBER)
        take("open_id", OPEN_ID)
        take("phone", PHONE)
    if _STREET_HINT.search(text):
        take("address", ADDRESS)
    return out


def runs(text: str, stretches: list[tuple[str, str, int, int]]) -> Iterator[str]:
    """Runs of capitalised words outside of the formed stretches; one that a stretch reaches into is searched again on either side of it."""
    for m in _RUN.finditer(text):
        inside = sorted((s, e) for _, _, s, e in stretches if m.start() < e and s < m.end())
        if not inside:
            yield m[0]
            continue
        at = m.start()
        for s, e in (*inside, (m.end(), m.end())):
            if at < s:
                yield from (x[0] for x in _RUN.finditer(text, at, s))
            at = max(at, e)


def strings(value) -> Iterator[str]:
    """The strings in a JSON value, in order; those that encode JSON themselves are opened."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            stack += reversed(list(v.values()))
        elif isinstance(v, list):
            stack += reversed(v)
        elif isinstance(v, str):
            yield v


def opened(text: str) -> list[str]:
    """The strings of a JSON text; the text itself if it is no JSON."""
    try:
        return list(strings(decoded(parse(text))))
    except ValueError:
        return [text]


def names_in(run: str, kinds: dict[int, set[str]]) -> list[str]:
    """The names in a run of capitalised words and initials, of whose parts kinds tells by place which are given or family names."""
    parts = [(m.start(), m.end(), m[0]) for m in _PART.finditer(run)]
    initial = [p[2].endswith(".") for p in parts]
    out, i = [], 0

    def is_kind(j: int, kind: str) -> bool:
        return j < len(parts) and kind in kinds.get(j, ())

    def comma(j: int) -> bool:
        return "," in run[parts[j][1] : parts[j + 1][0]]

    while i < len(parts):
        end = None
        if is_kind(i, "given") or initial[i]:
            j = i + 1
            while j < len(parts) and initial[j] and not comma(j - 1):
                j += 1
            if j < len(parts) and is_kind(j, "family") and not comma(j - 1):
                end = j
        if end is None and is_kind(i, "family") and i + 1 < len(parts):
            if is_kind(i + 1, "given"):
                end = i + 1
                while end + 1 < len(parts) and initial[end + 1] and not comma(end) and not is_kind(end + 2, "family"):
                    end += 1
            elif initial[i + 1] and not is_kind(i + 2, "family"):
                end = i + 1
        if end is None:
            i += 1
            continue
        out.append(run[parts[i][0] : parts[end][1]])
        i = end + 1
    return out


def _evidence(run: str, known: dict[str, set[str]]) -> list[tuple[str, str, str]]:
    """Unknown parts of a run that stand where a name part would: term, the kind it would be of, and the known part beside it."""
    parts = [(m.start(), m.end(), m[0]) for m in _PART.finditer(run)]
    kinds = {i: known[k] for i, p in enumerate(parts) if (k := p[2].casefold()) in known}
    if not kinds:
        return []
    explained = set()
    for name in names_in(run, kinds):
        at = run.find(name)
        explained |= {i for i, p in enumerate(parts) if at <= p[0] < at + len(name)}
    words = [i for i, p in enumerate(parts) if not p[2].endswith(".")]
    out = []
    for a, b in zip(words, words[1:]):
        for x, y in ((a, b), (b, a)):
            if x in kinds and x not in explained and y not in kinds and y not in explained:
                out += [(parts[y][2].casefold(), "family" if k == "given" else "given", parts[x][2].casefold()) for k in kinds[x]]
    return out


_SCAN = pa.schema({"what": pa.string(), "row": pa.int64(), "field": pa.string(), "kind": pa.string(), "found": pa.string(), "n": pa.int64(), "terms": pa.list_(pa.string())})
_SCAN_DDL = "what string, row long, field string, kind string, found string, n long, terms array<string>"
_HELD = 100_000


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCAN)], schema=_SCAN)


def _scanner(known: dict[str, set[str]], json_fields: set[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """'found' what has a form; 'run' what may hold names; and from the whole task 'term' counts and 'beside' evidence."""
        terms: Counter = Counter()
        beside: Counter = Counter()

        def counts() -> Iterator[pa.RecordBatch]:
            rows = [("term", None, None, None, t, n, None) for t, n in terms.items()]
            rows += [("beside", None, None, k, t, n, [p]) for (t, k, p), n in beside.items()]
            for i in range(0, len(rows), 20_000):
                yield _batch(rows[i : i + 20_000])
            terms.clear()
            beside.clear()

        for b in batches:
            out: list[tuple] = []
            names = b.schema.names[1:]
            columns = [b.column(i + 1).to_pylist() for i in range(len(names))]
            for at, row in enumerate(b.column(0).to_pylist()):
                for field, column in zip(names, columns):
                    if not (whole := column[at]):
                        continue
                    seen: dict[tuple, None] = {}
                    for text in opened(whole) if field in json_fields else (whole,):
                        stretches = formed(text)
                        for kind, stretch, start, end in stretches:
                            if kind == "open_id":
                                near = bool(PAPERS.search(text[max(0, start - _NEAR) : start].casefold())) or any(k != kind and s < end + _NEAR and start - _NEAR < e for k, _, s, e in stretches)
                                seen[kind, stretch] = near or seen.get((kind, stretch), False)
                            else:
                                seen[kind, stretch] = None
                        terms.update(w.casefold() for w in _WORD.findall(text))
                        for run in runs(text, stretches):
                            beside.update(_evidence(run, known))
                            seen["run", run] = None
                    for (kind, stretch), near in seen.items():
                        if kind == "open_id":
                            out.append(("open", row, field, "id_number", stretch, int(near), [stretch[:2]]))
                        elif kind == "run":
                            out.append(("run", row, field, None, stretch, None, [p.casefold() for p in _PART.findall(stretch)]))
                        else:
                            out.append(("found", row, field, kind, stretch, None, None))
            if out:
                yield _batch(out)
            if len(terms) + len(beside) > _HELD:
                yield from counts()
        yield from counts()

    return scan


def _namer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema({"row": pa.int64(), "field": pa.string(), "kind": pa.string(), "found": pa.string()})
    for b in batches:
        out = []
        t = b.to_pydict()
        for row, field, run, parts in zip(t["row"], t["field"], t["run"], t["parts"]):
            kinds: dict[int, set[str]] = {}
            for p in parts:
                kinds.setdefault(p["at"], set()).add(p["part_kind"])
            out += [(row, field, "name", n) for n in dict.fromkeys(names_in(run, kinds))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def protected_parts(scan: DataFrame, listed: DataFrame) -> DataFrame:
    """The listed name parts and the terms whose disclosure exceeds the threshold, with their kind.

    disclosure(t) = places of t beside a listed part that is not part of a complete name / all places of t. A term must stand
    beside LEAST_PARTNERS different ones. Pointwise mutual information of term and parts would rank alike, as the parts' frequency is common to all.
    """
    places = scan.where("what = 'term'").groupBy(F.col("found").alias("term")).agg(F.sum("n").alias("n"))
    beside = scan.where("what = 'beside'").groupBy(F.col("found").alias("term"), F.col("kind").alias("part_kind")).agg(F.sum("n").alias("n_beside"), F.count_distinct(F.col("terms")[0]).alias("partners"))
    learned = beside.join(places, "term").where((F.col("n_beside") >= DISCLOSURE * F.col("n")) & (F.col("partners") >= LEAST_PARTNERS)).select("term", "part_kind")
    return listed.unionByName(learned).distinct()


def open_numbers(scan: DataFrame) -> DataFrame:
    """The open numbers whose letters disclose an identity number: at least DISCLOSURE of the letters' places are beside words for papers or other personal data.

    Two letters have fewer than 700 forms, so what discloses is small whatever the corpus.
    """
    places = scan.where("what = 'open'").select("row", "field", "kind", "found", "n", F.col("terms")[0].alias("letters"))
    telling = places.groupBy("letters").agg(F.sum("n").alias("near"), F.count("*").alias("n")).where(F.col("near") >= DISCLOSURE * F.col("n")).select("letters")
    return places.join(F.broadcast(telling), "letters").select("row", "field", "kind", "found")


def personal_stretches(df: DataFrame, name_parts: DataFrame, fields: tuple[str, ...] = ("text", "input"), json_fields: tuple[str, ...] = ("input",), row_col: str = "row_id") -> DataFrame:
    """Row, field, kind (email, phone, id_number, address, name) and found: each stretch once a row and field, exactly as it stands.

    Fields in json_fields are JSON texts and searched in their decoded strings (as plain text if they are no JSON). Null and empty fields have
    nothing. name_parts (name_part, part_kind) must be a table of fixed size: it is collected, and refused beyond 10 000 parts. Names need
    a family name and a given name or initial.
    Scale: one pass over the texts; term counts are combined in each task; runs of capitalised words are joined with the protected parts in SALTS parts.
    """
    parts = [(r["name_part"].casefold(), r["part_kind"]) for r in name_parts.where("name_part IS NOT NULL").limit(10_001).collect()]
    if len(parts) > 10_000:
        raise ValueError("name_parts is too large to be sent to each task")
    known: dict[str, set[str]] = {}
    for part, kind in parts:
        known.setdefault(part, set()).add(kind)
    needed = df.select(F.col(row_col).cast("long").alias("row"), *[F.col(c).cast("string").alias(c) for c in fields])
    scan = settle(spread(needed).mapInArrow(_scanner(known, set(json_fields)), _SCAN_DDL))
    listed = df.sparkSession.createDataFrame(parts or [("", "given")], "term string, part_kind string")
    protected = protected_parts(scan, listed).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    terms = scan.where("what = 'run'").select("row", "field", F.col("found").alias("run"), F.posexplode("terms").alias("at", "term"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"))
    names = terms.join(protected, ["term", "salt"]).groupBy("row", "field", "run").agg(F.collect_set(F.struct("at", "part_kind")).alias("parts")).mapInArrow(_namer, "row long, field string, kind string, found string")
    found = scan.where("what = 'found'").select("row", "field", "kind", "found").unionByName(open_numbers(scan)).unionByName(names.distinct())
    return found.withColumnRenamed("row", row_col)


def _replaced(text: str | None, stretches: list, as_json: bool) -> str | None:
    if text is None or stretches is None or not len(stretches):
        return text
    forms: dict[str, str] = {}
    for s in stretches:
        mark = f"[{s['kind']}]"
        forms[s["found"]] = mark
        if as_json:
            for ascii_only in (True, False):
                once = json.dumps(s["found"], ensure_ascii=ascii_only)[1:-1]
                forms |= {once: mark, json.dumps(once, ensure_ascii=True)[1:-1]: mark}
    pattern = re.compile("|".join(rf"(?<!\w){re.escape(f)}(?!\w)" if f[0].isalnum() and f[-1].isalnum() else re.escape(f) for f in sorted(forms, key=len, reverse=True)))
    return pattern.sub(lambda m: forms[m[0]], text)


def sanitise(df: DataFrame, name_parts: DataFrame, fields: tuple[str, ...] = ("text", "input"), json_fields: tuple[str, ...] = ("input",), row_col: str = "row_id") -> DataFrame:
    """df with each stretch of the fields replaced by its kind in brackets; all else as it was. row_col must be unique; JSON stays JSON."""
    found = personal_stretches(df, name_parts, fields, json_fields, row_col)
    each = found.groupBy(F.col(row_col).alias("_personal_row")).agg(*[F.collect_list(F.when(F.col("field") == c, F.struct("kind", "found"))).alias(f"_personal_{c}") for c in fields])
    out = df.join(each, df[row_col] == F.col("_personal_row"), "left")

    def replacer(as_json: bool):
        @F.pandas_udf("string")
        def replace(text: pd.Series, stretches: pd.Series) -> pd.Series:
            return pd.Series([_replaced(t, s, as_json) for t, s in zip(text, stretches)], dtype=object)

        return replace

    for c in fields:
        out = out.withColumn(c, F.when(F.size(f"_personal_{c}") > 0, replacer(c in json_fields)(F.col(c), F.col(f"_personal_{c}"))).otherwise(F.col(c)))
    return out.drop("_personal_row", *[f"_personal_{c}" for c in fields])
