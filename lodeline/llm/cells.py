"""Notebooks as ordered cells: which parts of a document are text."""

from __future__ import annotations

import json
import re

TEXT, CODE, OUTPUT = "text", "code", "output"

_PERCENT = re.compile(r"^# %%(?:$|[ \t]+(.*)$|(\[.*)$)", re.M)
_RENDERED = re.compile(r"^(?:(In ?\[[ \d]*\]:)|Out ?\[[ \d]*\]:|\[error\]|\[image\])[ \t]*$", re.M)


def _lines(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def _join(source) -> str:
    if isinstance(source, list):
        return "".join(x for x in source if isinstance(x, str))
    return source if isinstance(source, str) else ""


def _notebook(text: str) -> list[tuple[str, str]] | None:
    try:
        book = json.loads(text)
    except (ValueError, RecursionError):
        return None
    cells = book.get("cells") if isinstance(book, dict) else None
    if not isinstance(cells, list):
        return None
    return [(CODE if c.get("cell_type") == "code" else TEXT, _lines(_join(c.get("source")))) for c in cells if isinstance(c, dict)]


def _percent(text: str, marks: list[re.Match]) -> list[tuple[str, str]]:
    out = [(TEXT, text[: marks[0].start()])]
    for mark, end in zip(marks, [*[m.start() for m in marks[1:]], len(text)], strict=True):
        tag = (mark.group(1) or mark.group(2) or "").strip().lower()
        body = text[mark.end() + 1 : end]
        if tag.startswith("[markdown]"):
            out.append((TEXT, re.sub(r"(?m)^#[ \t]?", "", body)))
        else:
            out.append((OUTPUT if tag.startswith("[output") else CODE, body))
    return out


def _rendered(text: str, marks: list[re.Match]) -> list[tuple[str, str]]:
    """Code is what is indented under ``In [n]:``; an output lasts to the next blank line or mark; the rest is text."""
    out = []
    at = 0
    for mark, end in zip(marks, [*[m.start() for m in marks[1:]], len(text)], strict=True):
        if mark.start() > at:
            out.append((TEXT, text[at : mark.start()]))
        body = mark.end() + 1
        if mark.group(1):
            m = re.compile(r"(?:(?:[ ]{4}|\t).*(?:\n|\Z)|[ \t]*\n)*").match(text, body)
            stop = m.end() if m else body
            out.append((CODE, text[body:stop]))
        else:
            m = re.compile(r"\n[ \t]*(?:\n|\Z)").search(text, mark.end() + 1, end)
            stop = m.end() if m else end
            out.append((OUTPUT, text[body:stop]))
        at = max(min(stop, end), body)
        if at < end:
            out.append((TEXT, text[at:end]))
        at = end
    return out


def cells(text: str | None) -> list[tuple[str, str]]:
    """(kind, text) of each cell. The layout is read from the text itself.

    Null and blank texts have no cells. Text without marks is one text cell,
    JSON that isn't a notebook too.
    """
    if not text or not text.strip():
        return []
    bare = text.lstrip("﻿")
    if bare.lstrip()[:1] == "{" and (book := _notebook(bare)) is not None:
        return book
    bare = _lines(bare)
    if marks := list(_PERCENT.finditer(bare)):
        return _percent(bare, marks)
    marks = list(_RENDERED.finditer(bare))
    return _rendered(bare, marks) if marks else [(TEXT, bare)]
