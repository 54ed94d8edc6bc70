"""Markers in Markdown: anchors, generated regions and slots, from HTML comments outside fenced code.

    <!-- fact:anchor id=a binds=fact:x/1,fact:y/* -->          a statement about facts
    <!-- fact:gen id=b binds=... hash=h1:... content=h1:... -->  ... <!-- /fact:gen -->
    <!-- fact:slot id=c hash=h1:... --> ... <!-- /fact:slot -->

A region that is not closed, is closed by another kind, or lies in another region is set aside with its reason.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "doc string, line int, kind string, id string, binds array<string>, hash string, content string, body string, reason string"

_mark = re.compile(r"<!--\s*(/?)fact:(anchor|gen|slot)\b(.*?)-->")
_field = re.compile(r"([a-z-]+)=(?:\"([^\"]*)\"|(\S+))")
_fence = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")


def parse(doc: str, text: str) -> list[tuple]:
    """Rows of one document, in the order of their opening lines."""
    out: list[tuple] = []
    fence, open_ = "", None  # open_: (line, kind, fields, body lines)
    for number, line in enumerate((text or "").replace("\r\n", "\n").split("\n"), 1):
        if m := _fence.match(line):
            if not fence and not (m[1][0] == "`" and "`" in m[2]):
                fence = m[1]
            elif fence and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = ""
        marks = [] if fence or m else list(_mark.finditer(line))
        if open_ and not marks:
            open_[3].append(line)
        for mark in marks:
            closing, kind, rest = mark.groups()
            if closing:
                if open_ and open_[1] == kind:
                    out.append(_row(doc, *open_[:3], body="\n".join(open_[3])))
                else:
                    out.append(_row(doc, number, kind, {}, reason="closes nothing"))
                    if open_:
                        out.append(_row(doc, *open_[:3], reason=f"closed by {kind}"))
                open_ = None
                continue
            fields = {k: a or b for k, a, b in _field.findall(rest)}
            if not fields.get("id"):
                out.append(_row(doc, number, kind, fields, reason="has no id"))
            elif kind == "anchor":
                out.append(_row(doc, number, kind, fields))
            elif open_:
                out.append(_row(doc, number, kind, fields, reason="lies in another region"))
            else:
                open_ = (number, kind, fields, [])
    if open_:
        out.append(_row(doc, *open_[:3], reason="is not closed"))
    return sorted(out, key=lambda r: r[1])


def _row(doc: str, line: int, kind: str, fields: dict[str, str], body: str | None = None, reason: str | None = None) -> tuple:
    binds = [b for b in fields.get("binds", "").split(",") if b]
    return doc, line, kind, fields.get("id"), binds, fields.get("hash"), fields.get("content"), body, reason


def markers(docs: DataFrame) -> DataFrame:
    """Markers of docs(doc, text); reason is set for those set aside. State runs from line to line, so each document is read in Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for doc, text in zip(b["doc"], b["text"]) for r in parse(doc, text)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select("doc", "text").mapInPandas(run, SCHEMA)
