"""Storage and wiki markup as text that detection can read.

Markup goes, what people typed stays, and what stood on one line stays on one: a value must not be parted from
the word beside it. Pasted code is kept as it is. The helpers work on one text; the column forms run them in Arrow
batches. None of them parses XML.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Elements of the storage format that end a line, and those whose content is a setting, not text.
LINE_ENDS = frozenset(["p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "ac:structured-macro"])
SETTING, RESOURCE = "ac:parameter", "ri:"
#: Wiki macros whose body is kept as it is.
VERBATIM = ("code", "noformat")
#: Characters within which a tag, a macro's head, a link or monospaced text must close to count as one.
LONGEST_TAG, LONGEST_LINK = 4096, 3072
_BLANK, _BLANKS = " \t", re.compile(r"[ \t]{2,}")
#: A run in which nothing of wiki markup begins or closes once a line has begun.
_PLAIN = re.compile(r"[^\n|{}\[\]]{1,4096}")
#: Rows whose texts stand in Python as objects at once.
_TEXTS = 256
#: A-Z only, so that places in the lowered text are those in the text.
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _lines(text: str) -> str:
    """Lines without blanks at their ends, runs of blanks as one, none empty."""
    kept = []
    for line in text.splitlines():
        if line := _BLANKS.sub(" ", line).strip():
            kept.append(line)
    return "\n".join(kept)


def storage_text(storage: str) -> str:
    """Text of an XHTML storage body; macro settings go, macro bodies stay word for word.

    One walk from tag to tag. Text between tags is unescaped, a CDATA section is taken as it is, up to the end if
    it never closes; a sign "<" that opens no tag is text.
    """
    storage = storage.replace("\0", "")
    low, out, at = storage.translate(_LOWER), [], 0
    while at < len(storage):
        tag = storage.find("<", at)
        if tag < 0:
            break
        out.append(html.unescape(storage[at:tag]))
        if storage.startswith("<![CDATA[", tag):
            end = storage.find("]]>", tag)
            out.append(storage[tag + 9 : end if end >= 0 else None])
            at = end + 3 if end >= 0 else len(storage)
            continue
        end = storage.find(">", tag, tag + LONGEST_TAG + 2)
        if end < 0:
            out.append("<")
            at = tag + 1
            continue
        at = end + 1
        head = low[tag + 1 : end]
        name = head.strip("/").partition("/")[0].split()[:1]
        name = name[0] if name else ""
        out.append("\n" if name in LINE_ENDS else " ")
        if (name == SETTING or name.startswith(RESOURCE)) and not head.startswith("/") and not head.endswith("/"):
            close = low.find(f"</{name}>", at)
            at = close + len(name) + 3 if close >= 0 else at
    out.append(html.unescape(storage[at:]))
    return _lines("".join(out))


def _macro(low: str, at: int) -> tuple[str, int]:
    """Name and end of the macro head ``{name}`` or ``{name:settings}`` that opens at a brace; no name if none does."""
    end = low.find("}", at, at + LONGEST_TAG)
    name = low[at + 1 : end].partition(":")[0] if end > 0 else ""
    plain = name[:1].isalpha() and name.replace("_", "").replace("-", "").isalnum() and name.isascii()
    return (name, end + 1) if plain and "\n" not in low[at:end] else ("", at)


def _line_mark(low: str, at: int) -> tuple[int, bool]:
    """Where the heading, quote or list mark at the start of a line ends, and whether another mark may follow."""
    if low[at : at + 3] == "bq." or low[at : at + 1] == "h" and low[at + 1 : at + 2] in tuple("123456") and low[at + 2 : at + 3] == ".":
        return at + 3, True
    end, first = at, low[at]
    most = {"*": 8, "#": 8, "-": 2}.get(first, 4)
    allowed = "*#" if first in "*#" else "-" if first == "-" else "0123456789"
    while end - at < most and low[end : end + 1] in tuple(allowed):
        end += 1
    if first.isdigit() and end > at:
        end = end + 1 if low[end : end + 1] == "." else at
    return (end, False) if end > at and low[end : end + 1] in tuple(_BLANK) else (at, False)


def wiki_text(value: str) -> str:
    """Text of a wiki-markup field; code blocks stay word for word, links keep label and address.

    One walk over the characters that knows whether the line has begun. Brackets and double braces that close go,
    what they hold is walked like the rest; bars are blanks; other macro heads are blanks.
    """
    value = value.replace("\0", "")
    low, out, at, fresh, headed = value.translate(_LOWER), [], 0, True, False
    closing: dict[int, int] = {}
    unclosed: set[str] = set()
    while at < len(value):
        c = value[at]
        if at in closing:
            at += closing.pop(at)
            continue
        if c == "\n" or c in _BLANK or c == "|":
            out.append(" " if c == "|" else c)
            fresh, headed = c == "\n" or fresh and c != "|", headed and c != "\n"
            at += 1
            continue
        if c == "{":
            name, end = _macro(low, at)
            if name in VERBATIM and name not in unclosed:
                close = low.find(f"{{{name}}}", end)
                if close >= 0:
                    out.append(value[end:close])
                    at, fresh = close + len(name) + 2, False
                    continue
                unclosed.add(name)
            if value.startswith("{{", at) and (close := value.find("}}", at + 2, at + 2 + LONGEST_TAG)) >= 0:
                closing[close] = 2
                at += 2
                continue
            if name:
                out.append(" ")
                at = end
                continue
        if c == "[":
            close = value.find("]", at, at + LONGEST_LINK)
            if close >= 0 and close not in closing and "\n" not in value[at:close]:
                closing[close] = 1
                at += 1
                continue
        if fresh:
            end, heading = _line_mark(low, at)
            fresh = heading and not headed
            if end > at and not (heading and headed):
                at, headed = end, True
                continue
        run = _PLAIN.match(value, at)
        out.append(run[0] if run else c)
        fresh = False
        at = run.end() if run else at + 1
    return _lines("".join(out))


def _small_batches() -> None:
    """Rows that hold texts go to Python by a thousand, unless the session has a setting of its own."""
    spark, rows = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark is not None and spark.conf.get(rows) == "10000":
        spark.conf.set(rows, "1000")


def _column(one: Callable[[str], str | None]):
    _small_batches()

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        parts = [[None if v is None else one(v) for v in values.slice(i, _TEXTS).to_pylist()] for i in range(0, len(values), _TEXTS)]
        return pa.concat_arrays([pa.array(x, pa.string()) for x in parts]) if parts else pa.array([], pa.string())

    return run


def storage_to_text(body: Column) -> Column:
    return _column(storage_text)(body)


def wiki_to_text(value: Column) -> Column:
    return _column(wiki_text)(value)
