"""JSON document trees, issue fields and page bodies as text, in columns of Spark's own.

A tree is taken apart level by level: the nodes of a level stand in one array, each with a path that sorts as the tree
reads, and a fold over the possible levels turns them into pieces of text and into the nodes of the next level. The
pieces in the order of their paths are the text. No row meets another and nothing leaves the JVM but wiki and storage
markup, which :mod:`sievespark.functions.markup` walks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import markup

#: What the format allows and which nodes end a line, speak through an attribute, or are cells.
MOST_NODES, MOST_DEPTH = 200_000, 100
BLOCKS = [
    "blockquote", "bodiedSyncBlock", "bulletList", "codeBlock", "decisionItem", "decisionList", "expand", "extensionFrame", "heading", "layoutColumn",
    "layoutSection", "listItem", "mediaGroup", "mediaSingle", "nestedExpand", "orderedList", "panel", "paragraph", "rule", "syncBlock", "table",
    "tableRow", "taskItem", "taskList",
]
SPOKEN, CELLS = ["emoji", "mention", "status"], ["tableCell", "tableHeader"]
#: Characters that end a line, and those that are trimmed off its ends.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
EDGE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_LEVEL = "array<struct<path:string,cell:boolean,node:variant>>"
_PIECES = "array<array<struct<path:string,piece:string>>>"


def tidy(text: Column) -> Column:
    """Runs of blanks as one, lines trimmed, empty lines gone."""
    lines = F.split(F.regexp_replace(text, r"[ \t\f\x0b]{2,}", " "), LINE_BREAK)
    return F.array_join(F.filter(F.transform(lines, lambda x: F.regexp_replace(x, f"^{EDGE}|{EDGE}$", "")), lambda x: x != ""), "\n")


def _at(node: Column, path: str) -> Column:
    return F.try_variant_get(node, path, "variant")


def _string(node: Column, path: str) -> Column:
    """The string there, null for anything else."""
    held = _at(node, path)
    return F.when(F.schema_of_variant(held) == "STRING", F.try_variant_get(held, "$", "string"))


def _is_object(node: Column) -> Column:
    return F.try_variant_get(node, "$", "map<string,variant>").isNotNull()


def _said(node: Column) -> Column:
    """A node's own words, then a blank and the address it names: a card's, else that of its first link with one."""
    spoken = F.when(_string(node, "$.type").isin(SPOKEN), _string(node, "$.attrs.text"))
    marks = F.transform(F.try_variant_get(node, "$.marks", "array<variant>"), lambda m: F.when(_string(m, "$.type") == "link", _string(m, "$.attrs.href")))
    named = lambda x: F.coalesce(x != "", F.lit(False))
    own = _string(node, "$.attrs.url")
    link = F.when(named(own), own).otherwise(F.get(F.filter(marks, named), F.lit(0)))
    return F.concat(F.coalesce(_string(node, "$.text"), spoken, F.lit("")), F.coalesce(F.concat(F.lit(" "), link), F.lit("")))


def _pieces(x: Column) -> Column:
    """What a node says at its path, and behind everything below it the end of its line, a blank inside cells."""
    end = F.when(_string(x["node"], "$.type").isin(BLOCKS), F.when(x["cell"], " ").otherwise("\n")).otherwise("")
    return F.array(F.struct(x["path"].alias("path"), _said(x["node"]).alias("piece")), F.struct(F.concat(x["path"], F.lit("~")).alias("path"), end.alias("piece")))


def _below(x: Column) -> Column:
    cell = x["cell"] | F.coalesce(_string(x["node"], "$.type").isin(CELLS), F.lit(False))
    children = F.coalesce(F.try_variant_get(x["node"], "$.content", "array<variant>"), F.array().cast("array<variant>"))
    placed = F.transform(children, lambda c, i: F.struct(F.concat(x["path"], F.lpad(F.lower(F.hex(i)), 5, "0")).alias("path"), cell.alias("cell"), c.alias("node")))
    return F.filter(placed, lambda c: _is_object(c["node"]))


def document_text(root: Column) -> Column:
    """Text of a document tree given as VARIANT.

    Null for one with more than ``MOST_NODES`` nodes or deeper than ``MOST_DEPTH``, which counts as unread, not as empty.
    Blocks end lines, but inside table cells only a blank, so that a row stays one line. What is no object is no node.
    """
    first = F.array(F.struct(F.lit("").alias("path"), F.lit(False).alias("cell"), root.alias("node"))).cast(_LEVEL)
    start = F.struct(first.alias("level"), F.array().cast(_PIECES).alias("said"), F.lit(0).alias("nodes"))

    def step(held: Column, _: Column) -> Column:
        nodes = held["nodes"] + F.size(held["level"])
        within = nodes <= MOST_NODES
        level = F.when(within, held["level"]).otherwise(F.array().cast(_LEVEL))
        said = F.when(F.size(level) > 0, F.concat(held["said"], F.array(F.flatten(F.transform(level, _pieces))))).otherwise(held["said"])
        return F.struct(F.flatten(F.transform(level, _below)).alias("level"), said.alias("said"), nodes.alias("nodes"))

    end = F.reduce(F.sequence(F.lit(0), F.lit(MOST_DEPTH)), start, step)
    whole = lambda e: (F.size(e["level"]) == 0) & (e["nodes"] <= MOST_NODES)
    text = lambda e: tidy(F.array_join(F.transform(F.array_sort(F.flatten(e["said"])), lambda x: x["piece"]), ""))
    # Spark knows no two folds as one: each mention of the end would parse and walk the tree again, a lambda's variable does not
    return F.get(F.transform(F.array(end), lambda e: F.when(whole(e), text(e))), F.lit(0))


def issue_field_text(fields: Column, key: str) -> Column:
    """Text of a field of a JSON object: a tree, wiki markup, or nothing for null.

    Null, which means unread, where the object lacks it, is none, or has it in another shape. Keys that stand twice in an
    object make its JSON unreadable.
    """
    value = _at(F.try_parse_json(fields), f'$["{key}"]')
    text = _string(value, "$")
    tree = F.when(_string(value, "$.type") == "doc", value)
    return F.when(F.is_variant_null(value), "").when(text.isNotNull(), markup.wiki_to_text(text)).when(tree.isNotNull(), document_text(tree))


def supported_body_text(resource: Column) -> Column:
    """Text of a page or comment in JSON from its storage form, else its view form; null where it has neither, which is
    not the same as an empty one."""
    body = F.try_parse_json(resource)
    return markup.storage_to_text(F.coalesce(_string(body, "$.body.storage.value"), _string(body, "$.body.view.value")))
