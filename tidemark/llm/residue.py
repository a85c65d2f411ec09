"""Template residue and stand-in pages: unfilled placeholders, filler, error pages and notices that scripts are required.

A document is taken apart into its frame (front matter, title, menu, footer) and the statements in between. Placeholder detectors look outside of
code and quotation. Whether a statement holds content, the corpus tells: a stand-in names nothing specific, is duplicated over several hosts, and
hardly ever stands in a document that names something specific. Words are weighed in the same way, so that filler in ever new order is found too.
Where the corpus has too little of a statement to tell, its own form decides. A document is residue if nothing in it holds content and its body
doesn't take up the terms of its title.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import salted_join
from tidemark.session import settle, spread

#: Documents that must have a statement or word before the corpus decides on it; they must be of two hosts at least.
LEAST_DOCUMENTS = 3
#: A statement or word is empty if at most this share of its documents name something specific, and content from the second share on. In between the corpus is of two minds.
EMPTY_UPTO, CONTENT_FROM = 0.1, 0.5
#: A statement that the corpus has too rarely is empty if at least this share of its words is empty; the second share will do if a part of it has the form of a stand-in.
EMPTY_WORDS, EMPTY_WORDS_OF_FORM = 0.7, 0.3
#: A statement's own form tells only if at least this share of its letters belongs to the form (less in scripts without blanks).
FORM_SHARE, FORM_SHARE_UNSPACED = 0.4, 0.25

_FRONT = re.compile(r"\A---\r?\n(.*?)\r?\n---\s*(?:\n|\Z)", re.S)
_FENCE = re.compile(r"^[ \t]*(```+|~~~+).*?(?:^[ \t]*\1[ \t]*$|\Z)", re.S | re.M)
_CODE = re.compile(r"``[^\n]+?``|`[^`\n]+`|^(?: {4}|\t).*$|<(code|pre|script|style|noscript)\b.*?</\1>", re.S | re.M | re.I)
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^“”\n]*”|„[^„“”\n]*[“”]|«[^«»\n]*»|»[^«»\n]*«|「[^「」\n]*」|『[^『』\n]*』|^[ \t]*>.*$|(?<!\w)'[^'\n]+'(?!\w)", re.M)
_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\([^()\n]*\)")

# The placeholder forms of common template languages. No form can hold its own beginning, so that each is found in one walk over a line.
PLACEHOLDERS = re.compile(
    r"\{\{[^{}\n]+\}\}"
    r"|\{%[^%\n]+%\}"
    r"|[$#]\{[^{}\n]+\}"
    r"|<%[^%\n]+%>"
    r"|%\([A-Za-z_][\w.]*\)[sdifr]"
    r"|\[\[\s?[A-Za-z_][\w. ]*\]\](?!\()"
    r"|<<\s?[A-Za-z_][\w. -]*>>"
    r"|(?<![\w%])%[A-Z][A-Z_]+%(?![\w%])"
    r"|(?<!\w)__[A-Z][A-Z_]*[A-Z]__(?!\w)"
    r"|@@[A-Za-z_][\w. ]*@@"
    r"|(?<![\w$#{%@)])\{[A-Za-z_][\w.]*\}(?!\})"
    r"|(?<![\w\]!])\[[A-Z][a-z]+(?: [A-Z][a-z]+)*\](?![(\[:])"
    r"|[\[<](?:INSERT|YOUR|ENTER|ADD|FILL|REPLACE|CHANGE|PLACEHOLDER)\b[A-Z0-9 _.'-]*[\]>]"
    r"|[\[<](?:[Ii]nsert|[Yy]our|[Ee]nter|[Ff]ill in|[Dd]oplň\w*|[Vv]lož\w*|[Vv]aše|[Hh]ier|[Ii]hr|[Ii]hre) [^\[\]<>\n]+[\]>](?!\()"
)

# Words of the usual filler text.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum nunc vitae porta massa augue orci quam tellus "
    "vel ac at nec mauris cras eget turpis risus lectus arcu diam donec fusce integer justo leo ligula metus morbi neque nibh odio pellentesque praesent "
    "purus rutrum sagittis sapien sem semper sodales suscipit tincidunt tortor tristique ultrices urna varius vestibulum vivamus viverra volutpat foo bar baz qux asdf qwer qwerty xxx xxxx bla blah test".split()
)

FILLER = re.compile(
    r"(?:your|the|some|more) (?:text|content|description|title|words?|copy) (?:goes|go|comes|will be|will go|here)\b|goes here\b|text here\b|sample (?:page|content|text)\b|placeholder (?:text|page|content)|dummy text|replace this (?:text|paragraph|content)"
    r"|\bsem (?:príde|pride|vložte|doplňte|napíšte)\b|\btu (?:doplňte|bude|príde|vložte)\b|vzorov[ýá] (?:text|stránka)|ukážkov[ýá] (?:text|stránka)"
    r"|hier (?:steht|kommt|folgt|entsteht|text|erscheint)\b.*\b(?:text|inhalt|beschreibung|seite)|\b(?:beispieltext|blindtext|platzhalter(?:text)?|musterseite|musterinhalt)\b"
    r"|тут буде|сюди (?:додайте|вставте)|зразок тексту|текст-заповнювач|ここに(?:本文|テキスト|説明|文章|内容)|サンプル(?:ページ|テキスト|文)|ダミーテキスト"
)

# What error pages, sign-in, maintenance and robot-check pages and script notices say, in the five languages of the corpus (case folded).
STAND_IN = re.compile(
    r"\b(?:error|chyba|fehler|помилка|エラー)\b[ :#-]*\d{3}\b|^\s*(?:4\d\d|5\d\d)\b[ :·-]*\w{0,20}|\b(?:4\d\d|5\d\d) (?:not found|forbidden|bad gateway|internal|service|gateway|too many|unauthorized|gone)"
    r"|(?:page|file|link|address|resource)\b.{0,40}\b(?:not (?:found|exist|on this server|available)|does ?n.t exist|leads nowhere|moved|mistyped|no longer|missing)|not found\b|nothing here\b|could ?n.t find"
    r"|access (?:is )?denied|forbidden|permission to (?:view|access|open)|no permission|not (?:allowed|authori[sz]ed)|unauthori[sz]ed|may not open|limited to members|members only"
    r"|(?:internal )?server error|bad gateway|gateway timeout|service (?:is )?(?:temporarily )?(?:unavailable|busy)|unexpected condition|unhandled exception|something went wrong|it is our fault|did not work|timed out|did not answer in time|no healthy backend"
    r"|too many requests|rate limit|more requests than allowed|slow down\b|try again (?:later|in)|reload in \d|temporarily unavailable|busy at the moment"
    r"|maintenance|scheduled downtime|planned work|back (?:soon|shortly)|be right back|moving things around|closed for"
    r"|(?:robot|security|human) check|not a robot|captcha|verify (?:that )?you are|could not verify|browser is being checked|checking your browser|one moment\b"
    r"|(?:please )?(?:sign|log) in\b(?: again)?(?: to \w+(?: \w+)?)?|signed out|logged out|session (?:has )?(?:expired|timed out)|login required|members of the workspace"
    r"|java ?scripts?\b.{0,60}\b(?:require|enable|turn|need|off|disabled|on)|(?:require|enable|need|rel(?:y|ies)|turn on|allow)\w*\b.{0,40}\b(?:java ?script|scripting|scripts)|script(?:s|ing)?\b.{0,60}\b(?:switched off|turned off|disabled|blocked|required)|without (?:java ?)?scripts?"
    r"|stránka sa nenašla|nenašl[aoi]?\b|neexistuje|bola presunutá|odkaz je zastaraný|prístup (?:bol )?zamietnutý|nemáte (?:oprávnenie|prístup)|obráťte sa na správcu|chyba servera|nepodarilo (?:sa )?spracovať|sa nepodarilo|dočasne nedostupn|nedostupn[áýé]\b|údržb|odstávk"
    r"|prihláste sa|prihlásenie|prihlásenia|odhlás|skúste to|príliš veľa|overenie|nie ste robot|javascript\w*|bez skriptov|vyžaduje (?:javascript|skript)|ľutujeme"
    r"|nicht gefunden|existiert nicht|verschoben oder gelöscht|zugriff (?:wurde )?verweigert|berechtigung|serverfehler|vorübergehend nicht|nicht (?:erreichbar|verfügbar)|wartung|anmeld|abgemeldet|sitzung (?:ist )?abgelaufen|versuchen sie es|zu viele anfragen|kein roboter|sicherheitsprüfung|skripte|zur startseite"
    r"|не знайдено|не існує|перенесли або видалили|доступ заборонено|немає (?:прав|доступу|дозволу)|помилка сервера|тимчасово недоступн|недоступн|обслуговуванн|технічн\w+ робот|увійдіть|увійти|сесі[яю]|спробуйте (?:ще раз|пізніше)|забагато запитів|не робот|скрипт|на головну"
    r"|見つかりません|存在しません|移動または削除|アクセス(?:が)?(?:拒否|できません|権)|権限がありません|サーバー?エラー|一時的に|利用できません|メンテナンス|ログイン|サインイン|セッション|もう一度お試し|リクエストが多|ロボット|スクリプト|^エラー|ホームへ"
    r"|führt ins leere|aktivieren\b|змініть налаштування|увімкн"
    # what stands below such messages: a reference to quote, a way out
    r"|^(?:error )?(?:ref|incident|code|kód|vorgang|request id|номер)\b[ :]*[#9]*(?: \S+){0,3}$|^quote # when you contact us|^contact us$|^(?:go )?back to (?:the )?(?:start|home)|^(?:späť|späť na úvod|zurück|назад|戻る)$"
)


_HOST = re.compile(r"\s+[|·–—]\s+([a-z0-9][\w.-]*|[A-Z0-9]+[.-][A-Z0-9.-]+)$")
_HEADED = re.compile(r"([a-z0-9][\w.-]*|[A-Z0-9]+[.-][A-Z0-9.-]+)\s+[|·]\s+\S")
_MENU = re.compile(r" {2,}|\t+|\s[|·•›»]\s")
_STOP, _STOP_UNSPACED = re.compile(r"[.!?:]\s+"), re.compile(r"[。！？]\s*|[.!?:]\s+")
#: What only content names: calls, identifiers, paths, dates, links, code; and what such a name can't do without.
SPECIFIC = re.compile(r"\w\(|[^\W_]_[^\W_]|(?<!\w)(?!and/or|on/off|n/a)\w+/\w|\d-\d\d(?!\d)|\]\(|`")
_SPECIFIC_HINT = re.compile(r"[(_/`]|\d-\d")
_MASKED = re.compile(r"(?<![^\W_])(?![45]\d\d(?![^\W_]))(?:\d+|[0-9a-f]{5,})(?![^\W_])")  # numbers and codes, but not what may be a status
_WORDS = re.compile(r"[^\W\d_]{3,}")
#: How a placeholder begins.
_BEGIN = re.compile(r"[{<%]|[$#]\{|\[(?=[A-Z\[]|\w+ )|__(?=[A-Z])|@@")


def prose(text: str) -> str:
    """The text without code and quotation; links are left with their labels' places empty."""
    text = _FENCE.sub("\n", text)
    text = _CODE.sub(" ", text)
    return _QUOTED.sub(" ", _LINK.sub(" ", text))


def unfilled(text: str) -> bool:
    """Whether a placeholder is left outside of code, quotation and link labels; [Label] is a link if the text defines it elsewhere."""
    if not any(PLACEHOLDERS.match(text, m.start()) for m in _BEGIN.finditer(text)):
        return False
    return any(not (m[0][0] == "[" and f"{m[0]}:" in text) for m in PLACEHOLDERS.finditer(prose(text)))


def _is_specific(statement: str) -> bool:
    return bool(_SPECIFIC_HINT.search(statement) and SPECIFIC.search(statement))


def _plain(statement: str) -> str:
    """A statement's form to compare by: lower case, numbers and codes as one sign."""
    return _MASKED.sub("#", statement.casefold()).strip(" \t*_#>-•").rstrip(".!?:。！？")


def _is_menu(line: str) -> bool:
    """Whether a line is of several entries of one or two words each."""
    entries = _MENU.split(line)
    return len(entries) > 1 and all(len(e.split()) <= 2 for e in entries)


def dissect(text: str) -> tuple[str | None, str, list[str], bool]:
    """Host, title, and the statements of a document outside of its frame (a repeated one counts once), and whether it names something specific.

    Statements that do so themselves are left out, as they are content by that.
    """
    front = _FRONT.match(text)
    host = None
    if front and (m := re.search(r"^project:\s*(\S+)", front[1], re.M)):
        host = m[1]
    body = text[front.end() :] if front else text
    specific = "```" in body or "~~~" in body
    if specific:
        body = _FENCE.sub("\n", body)
    title, out, first = "", {}, True
    lines = [s for line in body.split("\n") if (s := line.strip())]
    for s in lines:
        if "|" in s or "·" in s or "—" in s or "–" in s or "  " in s or "\t" in s:
            if first and (m := _HEADED.match(s)):
                host, first = m[1], False
                continue
            if m := _HOST.search(s):
                host, s = m[1], s[: m.start()]
                if first:
                    title, first = s, False
                    continue
            elif _is_menu(s):
                first = False
                continue
        if s[0] == "#" and not title:
            title, first = s.strip("# "), False
            specific = specific or _is_specific(s)
            continue
        if first and len(lines) > 1 and s[-1] not in ".!?。！？:;,":
            title, first = s, False
            specific = specific or _is_specific(s)
            continue
        first = False
        for x in (_STOP if s.isascii() else _STOP_UNSPACED).split(s):
            if _is_specific(x):
                specific = True
            elif p := _plain(x):
                out.setdefault(p)
    if title and not out and not specific:
        out = {p: None for p in (_plain(title),) if p}
    return host, title, list(out), specific


def _filler(statement: str) -> bool:
    words = re.findall(r"[^\W\d_]+", statement)
    return len(words) >= 3 and sum(w in LOREM for w in words) >= 0.7 * len(words)


@lru_cache(maxsize=50_000)
def form_share(statement: str) -> float:
    """The share of a statement's letters (in its plain form) that have the form of filler, an error or a notice. Quotations don't count."""
    bare = _QUOTED.sub(" ", statement)
    if _filler(bare):
        return 1.0
    inside = max(sum(sum(map(str.isalnum, m[0])) for m in p.finditer(bare)) for p in (STAND_IN, FILLER))
    return inside / max(1, sum(map(str.isalnum, bare)))


def says_so(statement: str) -> bool:
    """Whether a statement is a stand-in by its own form; one that says much besides is not."""
    return form_share(statement) >= (FORM_SHARE if " " in statement else FORM_SHARE_UNSPACED)


_SCAN = pa.schema({"what": pa.string(), "doc": pa.int64(), "residue": pa.bool_(), "titled": pa.bool_(), "title": pa.binary(), "statements": pa.list_(pa.struct([("key", pa.binary()), ("text", pa.string())])), "key": pa.binary(), "n": pa.int64(), "n_specific": pa.int64(), "least": pa.string(), "most": pa.string()})
_SCAN_DDL = "what string, doc long, residue boolean, titled boolean, title binary, statements array<struct<key:binary,text:string>>, key binary, n long, n_specific long, least string, most string"
_HELD = 200_000


def _key(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).digest()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCAN)], schema=_SCAN)


class _Counts:
    """Documents that hold a term, those of them that name something specific, and the first and last host."""

    def __init__(self, what: str):
        self.what, self.all, self.specific, self.by_host, self.held = what, Counter(), Counter(), {}, 0

    def add(self, terms: set[str], specific: bool, host: str | None) -> None:
        self.all.update(terms)
        if specific:
            self.specific.update(terms)
        if host is not None:
            seen = self.by_host.setdefault(host, set())
            self.held -= len(seen)
            seen |= terms
            self.held += len(seen)

    def rows(self) -> list[tuple]:
        least: dict[str, str] = {}
        most: dict[str, str] = {}
        for host in sorted(self.by_host):
            here = dict.fromkeys(self.by_host[host], host)
            most |= here
            least = here | least
        return [(self.what, None, None, None, None, None, _key(t), n, self.specific[t], least.get(t), most.get(t)) for t, n in self.all.items()]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """'doc' each document that may be residue; 'statement' and 'word' counts, combined in the task."""
    statements_of, words_of = _Counts("statement"), _Counts("word")

    def passed_on() -> Iterator[pa.RecordBatch]:
        rows = statements_of.rows() + words_of.rows()
        for i in range(0, len(rows), 20_000):
            yield _batch(rows[i : i + 20_000])

    for b in batches:
        out = []
        for doc, project, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if unfilled(text):
                out.append(("doc", doc, True, None, None, None, None, None, None, None, None))
                continue
            host, title, statements, specific = dissect(text)
            host, named = host or project, _plain(title)
            statements_of.add({*statements, named} if named else set(statements), specific, host)
            words_of.add(set(_WORDS.findall(text.casefold())), specific, host)
            if statements and not specific:
                terms = set(_WORDS.findall(title.casefold()))
                titled = named not in statements and not says_so(named) and any(not terms.isdisjoint(_WORDS.findall(s)) for s in statements)
                out.append(("doc", doc, False, titled, _key(named) if titled else None, [{"key": _key(s), "text": s} for s in statements], None, None, None, None, None))
        if out:
            yield _batch(out)
        if sum(len(c.all) + c.held for c in (statements_of, words_of)) > _HELD:
            yield from passed_on()
            statements_of, words_of = _Counts("statement"), _Counts("word")
    yield from passed_on()


def _evidence(scan: DataFrame, what: str) -> DataFrame:
    """key and empty of the statements or words that the corpus has often enough to tell."""
    sums = scan.where(F.col("what") == what).groupBy("key").agg(F.sum("n").alias("n"), F.sum("n_specific").alias("s"), F.min("least").alias("least"), F.max("most").alias("most"))
    often = sums.where((F.col("n") >= LEAST_DOCUMENTS) & (F.col("least") != F.col("most")))
    return often.select("key", F.when(F.col("s") <= EMPTY_UPTO * F.col("n"), True).when(F.col("s") >= CONTENT_FROM * F.col("n"), False).alias("empty")).where("empty IS NOT NULL")


_JUDGED = pa.schema({"key": pa.binary(), "formed": pa.bool_(), "hinted": pa.bool_(), "words": pa.list_(pa.binary())})


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        words = [[_key(w) for w in dict.fromkeys(_WORDS.findall(t))] for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([says_so(t) for t in texts]), pa.array([form_share(t) > 0 for t in texts]), pa.array(words, pa.list_(pa.binary()))], schema=_JUDGED)


def residue_documents(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", host_col: str | None = "project") -> DataFrame:
    """The documents that hold residue instead of content: one column, named as id_col.

    Null, empty and blank texts are no residue (they hold nothing that was put in place of content). A document that occurs twice comes out once.
    Documents may be of any length and have any number of statements.
    Scale: one pass over the texts; statements and words are counted in each task before they are shuffled, as digests; what is joined are the
    statements of documents that name nothing specific, each text of a statement once.
    """
    host = F.col(host_col).cast("string") if host_col else F.lit(None).cast("string")
    needed = df.select(F.col(id_col).cast("long").alias("doc"), host.alias("project"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL AND doc IS NOT NULL")
    scan = settle(spread(needed).mapInArrow(_scan, _SCAN_DDL))
    told = _evidence(scan, "statement")
    doubtful = scan.where("what = 'doc' AND NOT residue")
    rows = doubtful.select("doc", "titled", "title", F.explode("statements").alias("s")).select("doc", "titled", "title", "s.key", "s.text")
    asked = rows.groupBy("key").agg(F.first("text").alias("text"))
    known = settle(asked.join(told, "key", "left"))
    rare = known.where("empty IS NULL").select("key", "text").mapInArrow(_judge, "key binary, formed boolean, hinted boolean, words array<binary>")
    words = rare.select("key", "formed", "hinted", F.explode_outer("words").alias("word"))
    weighed = words.join(_evidence(scan, "word").select(F.col("key").alias("word"), "empty"), "word", "left").groupBy("key").agg(
        F.bool_or("formed").alias("formed"), F.bool_or("hinted").alias("hinted"), F.count_if("empty").alias("n_empty"), F.count("word").alias("n_words")
    )
    least_empty = F.when(F.col("hinted"), EMPTY_WORDS_OF_FORM).otherwise(EMPTY_WORDS) * F.col("n_words")
    by_itself = weighed.select("key", (F.col("formed") | ((F.col("n_words") >= 2) & (F.col("n_empty") >= least_empty))).alias("empty"))
    decided = settle(known.where("empty IS NOT NULL").select("key", "empty").unionByName(by_itself).where("empty"))
    met = salted_join(rows, decided, ["key"], "doc", "left")
    bodies = met.groupBy("doc").agg(F.bool_and(F.coalesce("empty", F.lit(False))).alias("bare"), F.max("titled").alias("titled"), F.max("title").alias("key")).where("bare")
    # A body that takes up its title's terms is about something, unless the title is a stand-in itself.
    about = bodies.where("titled").join(told.where("empty").select("key"), "key", "left_anti").select("doc")
    found = scan.where("what = 'doc' AND residue").select("doc").union(bodies.select("doc")).distinct()
    return found.join(about, "doc", "left_anti").select(F.col("doc").alias(id_col))


def without_residue(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", host_col: str | None = "project") -> DataFrame:
    """df without those documents."""
    out = residue_documents(df, text_col, id_col, host_col).select(F.col(id_col).alias("_residue_id"))
    return df.join(out, df[id_col] == F.col("_residue_id"), "left_anti")
