"""Shell-style patterns as column predicates: ``*``, ``?``, ``[seq]``, ``[!seq]``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# A bracket that comes first in a class, after the optional mark, belongs to it; without another one there is no class.
_TOKEN = re.compile(r"\*+|\?|\[!?+\]?+[^\]]*\]|.", re.S)


def _escape(char: str) -> str:
    return char if char.isalnum() or char == "_" else "\\x{%x}" % ord(char)


def _char_class(body: str) -> str:
    negate = body.startswith("!")
    body = body[1:] if negate else body
    parts: list[str] = []
    pos = 0
    while pos < len(body):
        if body[pos + 1 : pos + 2] == "-" and pos + 2 < len(body):
            low, high = body[pos], body[pos + 2]
            if low <= high:
                parts.append(f"{_escape(low)}-{_escape(high)}")
            pos += 3
        else:
            parts.append(_escape(body[pos]))
            pos += 1
    if not parts:
        return "." if negate else r"(?!)"
    return f"[{'^' if negate else ''}{''.join(parts)}]"


def glob_regex(pattern: str) -> str:
    """Anchored Java regular expression for a glob; case matters."""
    out = []
    for token in _TOKEN.findall(pattern):
        if token.startswith("*"):
            out.append(".*")
        elif token == "?":
            out.append(".")
        elif len(token) > 1:
            out.append(_char_class(token[1:-1]))
        else:
            out.append(_escape(token))
    return r"(?s)\A" + "".join(out) + r"\z"


def literal_runs(pattern: str) -> list[str]:
    """The stretches of plain characters that every match of the pattern holds."""
    runs, run = [], ""
    for token in _TOKEN.findall(pattern):
        if len(token) == 1 and token not in "*?":
            run += token
        else:
            runs, run = [*runs, run], ""
    return [r for r in [*runs, run] if r]


def glob_match(value: Column, pattern: str) -> Column | None:
    """Predicate for ``value`` matching ``pattern``; None when everything matches.

    Plain names and trailing-star patterns become equality and prefix tests, which are
    cheaper than a regular expression and can be pushed to a file scan.
    """
    if pattern.strip("*") == "" and pattern:
        return None
    if not re.search(r"[*?\[]", pattern):
        return value == F.lit(pattern)
    head = pattern.rstrip("*")
    if head != pattern and not re.search(r"[*?\[]", head):
        return value.startswith(head)
    return value.rlike(glob_regex(pattern))
