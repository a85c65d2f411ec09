"""Text functions as column expressions: folding, terms, stems, redaction, summaries of tool calls."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def _fold_table() -> tuple[str, str]:
    """Letters that lose a diacritic when folded, and what is left of them."""
    source, target = [], []
    for c in range(0xC0, 0x2000):
        ch = chr(c)
        bare = "".join(x for x in unicodedata.normalize("NFD", ch) if not 0x300 <= ord(x) <= 0x36F)
        if len(bare) == 1 and bare != ch:
            source.append(ch)
            target.append(bare)
    return "".join(source), "".join(target)


def fold(text: Column) -> Column:
    """Lower case without diacritics; composed and decomposed letters alike."""
    source, target = _fold_table()
    return F.lower(F.translate(F.regexp_replace(text, "[\\u0300-\\u036f]", ""), source, target))


def terms(text: Column) -> Column:
    """The folded words and numbers of a text, in order."""
    return F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def stem(word: Column, cut: int = 3, keep: int = 4) -> Column:
    """A word without its last letters, with at least keep of them left."""
    return F.substring(word, F.lit(1), F.greatest(F.lit(keep), F.length(word) - cut))


def collapse(text: Column) -> Column:
    """One line: blanks as one space, pipes escaped."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"\|", r"\\\\|"))


def lines(text: Column) -> Column:
    """The lines of a text; one that ends in a line break has an empty last line."""
    return F.split(text, "\n", -1)


def segments(identifier: Column) -> Column:
    """The parts of an identifier: camel case, acronyms, snake case and hyphens."""
    apart = F.regexp_replace(F.regexp_replace(identifier, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(apart, "[^A-Za-z0-9]+", " ")), " "), lambda x: x != "")


# The secret forms and their names, in the order in which they are to be replaced.
SECRETS = (
    ("sk-ant-[A-Za-z0-9_-]{20,}", "sk-ant"),
    ("sk-(?:proj|svcacct|admin)-[A-Za-z0-9_-]{20,}", "openai"),
    ("sk-[A-Za-z0-9]{32,}", "openai"),
    ("gh[pousr]_[A-Za-z0-9]{20,}", "github"),
    ("github_pat_[A-Za-z0-9_]{20,}", "github"),
    ("(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Z])", "aws"),
    ("AIza[0-9A-Za-z_-]{35}", "google"),
    ("(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}", "stripe"),
    ("xox[baprs]-[A-Za-z0-9-]{10,}", "slack"),
    ("https://hooks\\.slack\\.com/services/[A-Za-z0-9/]+", "slack webhook"),
    ("eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{5,}", "jwt"),
    ("-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----[\\s\\S]{64,}?-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----", "private key"),
    ("[Bb]earer\\s+[A-Za-z0-9._~+/=-]{20,}", "bearer"),
)
#: How each form begins: looked at before anything else of its pattern.
_BEGINS = ("sk-ant-", "sk-", "sk-", "gh[pousr]_", "github_pat_", "A[KS]IA", "AIza", "[sr]k_", "xox", "https://hooks", "eyJ", "-----BEGIN", "[Bb]earer")
#: Forms that may follow anything; the others must not follow a word character other than of an escaped line break.
_ANYWHERE = ("slack webhook", "private key")
_BEFORE = r"(?<=^|[^A-Za-z0-9_]|\\[nrt])"
#: User name and password in an address: the password goes, the name stays.
_PASSWORD = r"(?i)([a-z][a-z0-9+.-]{0,30}://[^\s:/@]+:)[^\s@/]{3,}(?=@)"
_SECRET_NAME = "SECRET|TOKEN|PASSWORD|PASSWD|API_KEY|APIKEY|PRIVATE_KEY|ACCESS_KEY"
_VALUE = r"[A-Za-z0-9_+/=.-]"
#: NAME=value where the name tells that the value is secret.
_VARIABLE = rf"(?<![A-Za-z0-9_])([A-Z][A-Z0-9_]*(?:{_SECRET_NAME})[A-Z0-9_]*)(\s*[=:]\s*)([\"']?)(?:(?={_VALUE}*\d){_VALUE}{{8,}}|{_VALUE}{{20,}})\3(?![^\s\"'])"


def redact(text: Column) -> Column:
    """Secrets as [redacted:kind]; specific forms before general ones."""
    clean = text
    for (pattern, name), begins in zip(SECRETS, _BEGINS):
        clean = F.regexp_replace(clean, f"(?={begins})" + (pattern if name in _ANYWHERE else _BEFORE + pattern), f"[redacted:{name}]")
    clean = F.regexp_replace(clean, _PASSWORD, "$1[redacted:password]")
    clean = F.regexp_replace(clean, _VARIABLE, "$1$2$3[redacted:env]$3")
    return F.when(text.rlike("|".join((*_BEGINS, "://", _SECRET_NAME))), clean).otherwise(text)


def without_data_uris(text: Column) -> Column:
    """Embedded images as [image]."""
    return F.regexp_replace(text, r"data:[\w/+.-]+;base64,[A-Za-z0-9+/=]+", "[image]")


# How a line begins that tells of a failure.
FAILURE = r"^\s*(Error:|Uncaught |[\w./\\-]+\(\d+,\d+\): error TS\d+|error TS\d+|FAIL |AssertionError|Traceback \(most recent)"


def failure_line(text: Column) -> Column:
    """The first line that tells of a failure, redacted, then cut to 160 characters; null if there is none."""
    failing = F.filter(lines(text), lambda x: x.rlike(FAILURE))
    return F.when(F.size(failing) > 0, F.substring(redact(F.trim(failing[0])), 1, 160))


# Tags that the host puts before text of its own.
INJECTED = ("system-reminder", "command-name", "command-message", "command-args", "local-command-stdout", "task-notification", "user-prompt-submit-hook")


def is_injected(text: Column) -> Column:
    """Whether a text was put in by the host."""
    return F.trim(text).rlike("^<(" + "|".join(INJECTED) + ")")


def without_leading_blocks(text: Column) -> Column:
    """The text after the closed tag blocks at its start."""
    return F.regexp_replace(text, r"(?s)^\s*(?:<([A-Za-z_][\w-]*)[\s>].*?</\1>\s*)+", "")


def command_kind(command: Column) -> Column:
    """edit, lookup or read, by what a shell command does; an edit in it outweighs a lookup, a lookup a read; null for others."""
    first = r"(?:^|[;&|]\s*)(?:sudo\s+)?"
    return (
        F.when(command.rlike(first + r"(?:sed\s+-i|tee|patch|mv|cp|rm)(?![\w-])") | command.rlike(r"(?<![0-9&>=-])>{1,2}\s*(?!/dev/null)[\w./~$\"'-]"), "edit")
        .when(command.rlike(first + r"(?:grep|rg|ag|find|fd|ls|tree)(?![\w-])") | command.rlike(first + r"git\s+(?:grep|ls-files|log)(?![\w-])"), "lookup")
        .when(command.rlike(first + r"(?:cat|head|tail|less|bat|nl|sed\s+-n|awk)(?![\w-])"), "read")
    )


def tool_summary(tool: Column, tool_input: Column) -> Column:
    """One line for a tool call: its name with the path, the command (at most 200 characters) or the query; redacted."""
    part = lambda k: F.get_json_object(tool_input, f"$.{k}")
    what = F.coalesce(part("file_path"), part("path"), F.substring(part("command"), 1, 200), part("query"), part("agent"), F.lit(""))
    return redact(F.when(what == "", F.concat(F.lit("[Tool: "), tool, F.lit("]"))).otherwise(F.concat(F.lit("[Tool: "), tool, F.lit(" "), collapse(what), F.lit("]"))))


def plain_path(path: Column) -> Column:
    """Forward slashes, no file:// before, no slash behind."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^file://", ""), "(?<=.)/+$", "")


def path_tail(path: Column) -> Column:
    """A path from its source folder on."""
    tail = F.regexp_extract(plain_path(path), r"(?:^|/)((?:src|scripts|lib|app)/.*)$", 1)
    return F.when(tail != "", tail).otherwise(plain_path(path))
