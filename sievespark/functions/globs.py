"""Shell globs as regular expressions; matching is case-sensitive and ``*`` crosses ``/``."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def to_regex(glob: str) -> str:
    """Java and Python regular expression of a whole-string glob with ``*``, ``?``, ``[set]`` and ``[!set]``."""
    out, at = [], 0
    while at < len(glob):
        c = glob[at]
        at += 1
        if c == "*":
            if out[-1:] != [".*"]:
                out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            close = glob.find("]", at + 1 + (glob[at : at + 1] == "!"))
            if close < 0:
                out.append(r"\[")
                continue
            body, at = glob[at:close], close + 1
            negated, body = body.startswith("!"), body.removeprefix("!")
            members = re.sub(r"([\\\[\]^&~|])", r"\\\1", body)
            out.append(f"[{'^' if negated else ''}{members}]")
        else:
            out.append(re.escape(c) if c.isascii() and not c.isalnum() and c != "_" else c)
    return f"(?s)^{''.join(out)}\\z"


def regex_of(glob: Column) -> Column:
    """The same for a column of globs, meant for small tables of patterns."""

    @F.pandas_udf("string")
    def translate(globs: pd.Series) -> pd.Series:
        return globs.map(lambda g: None if g is None else to_regex(g))

    return translate(glob)


def selected(path: Column, include: list[str], exclude: list[str]) -> Column:
    """True where no exclude glob matches and an include glob does, or there is none."""
    hit = lambda globs: [path.rlike(to_regex(g)) for g in globs]
    keep = F.lit(True) if not include else F.greatest(F.lit(False), *hit(include))
    return keep & ~F.greatest(F.lit(False), F.lit(False), *hit(exclude))
