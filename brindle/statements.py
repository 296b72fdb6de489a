"""Splitting SQL text into statements, and telling which tables a statement changes."""

from __future__ import annotations

import re
from dataclasses import dataclass


def split(sql: str) -> list[str]:
    """Statements between semicolons; those in quotes and comments do not count."""
    out, start, i, n = [], 0, 0, len(sql)
    while i < n:
        c = sql[i]
        if c in "'\"`":
            i += 1
            while i < n and sql[i] != c:
                i += 2 if sql[i] == "\\" and c != "`" else 1
        elif sql.startswith("--", i):
            end = sql.find("\n", i)
            i = n if end < 0 else end
        elif sql.startswith("/*", i):
            end = sql.find("*/", i + 2)
            i = n if end < 0 else end + 1
        elif c == ";":
            out.append(sql[start:i])
            start = i + 1
        i += 1
    out.append(sql[start:])
    return [s.strip() for s in out if bare(s)]


def bare(sql: str) -> str:
    """Without comments and outer blanks."""
    return re.sub(r"/\*.*?\*/|--[^\n]*", " ", sql, flags=re.S).strip()


@dataclass(frozen=True)
class Write:
    """What a statement changes: one table, or anything at all."""

    verb: str
    table: str | None


_NAME = r"((?:[\w]+|`[^`]+`|\"[^\"]+\")(?:\s*\.\s*(?:[\w]+|`[^`]+`|\"[^\"]+\"))*)"
_TABLE_WRITES = [
    ("insert", re.compile(rf"insert\s+(?:into|overwrite)\s+(?:table\s+)?{_NAME}", re.I)),
    ("update", re.compile(rf"update\s+{_NAME}\s+set\b", re.I)),
    ("delete", re.compile(rf"delete\s+from\s+{_NAME}", re.I)),
    ("truncate", re.compile(rf"truncate\s+table\s+{_NAME}", re.I)),
]
_ANY_WRITES = re.compile(r"(merge|alter|create|replace|drop|attach|detach|vacuum|copy|load|refresh|msck|repair|optimize)\b", re.I)


def classify(sql: str) -> Write | None:
    """The write that a statement makes; None for reads and settings."""
    text = bare(sql)
    for verb, rx in _TABLE_WRITES:
        if m := rx.match(text):
            return Write(verb, re.sub(r"\s*\.\s*", ".", m[1]))
    if m := _ANY_WRITES.match(text):
        # A view holds no rows, so making one leaves cached columns as they were.
        if re.match(r"create\s+(?:or\s+replace\s+)?(?:global\s+)?temp(?:orary)?\s+view\b", text, re.I):
            return None
        return Write(m[1].lower(), None)
    return None


@dataclass(frozen=True)
class RowChange:
    """A parsed DELETE or UPDATE of one table."""

    verb: str
    table: str
    assignments: dict[str, str]
    condition: str | None


def row_change(sql: str) -> RowChange | None:
    text = bare(sql).rstrip(";").strip()
    if m := re.fullmatch(rf"delete\s+from\s+{_NAME}(?:\s+where\s+(.+))?", text, re.I | re.S):
        return RowChange("delete", m[1], {}, m[2])
    if m := re.fullmatch(rf"update\s+{_NAME}\s+set\s+(.+)", text, re.I | re.S):
        body, condition = _top_level(m[2], r"\bwhere\b")
        pairs = dict(re.split(r"\s*=\s*", p.strip(), maxsplit=1) for p in _commas(body))
        return RowChange("update", m[1], {k.strip("`\" "): v for k, v in pairs.items()}, condition)
    return None


def _masked(text: str) -> str:
    """Quoted text and what stands in brackets as blanks."""
    out, depth, quote = [], 0, ""
    for c in text:
        hidden = bool(depth or quote)
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote, hidden = c, True
        elif c in "([":
            depth, hidden = depth + 1, True
        elif c in ")]":
            depth -= 1
        out.append(" " if hidden else c)
    return "".join(out)


def _top_level(text: str, word: str) -> tuple[str, str | None]:
    m = re.search(word, _masked(text), re.I)
    return (text[: m.start()], text[m.end() :].strip()) if m else (text, None)


def _commas(text: str) -> list[str]:
    parts, start = [], 0
    for i, c in enumerate(_masked(text)):
        if c == ",":
            parts.append(text[start:i])
            start = i + 1
    return [*parts, text[start:]]
