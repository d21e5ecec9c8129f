"""Passages that a page tags officially, with their places in the source. Imports no queries: workers load this module alone."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The elements that carry tags, the taxonomy's address and the ending of a text block's name.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style)(?=[\s>])[^>]*>.*?(?:</(?P=raw)(?=[\s/>])|\Z)|<(?P<end>/?)(?P<tag>ix:hidden|ix:nonnumeric|ix:continuation)(?=[\s/>])(?P<rest>[^>]*)>", re.I | re.S)
_TAXONOMY = re.compile(r"xmlns:([\w.-]+)\s*=\s*[\"'][^\"'>]*xbrl\.sec\.gov/cyd[^\"'>]*[\"']")
_BLOCK = "TextBlock"
_ATTRIBUTE = re.compile(r"([A-Za-z][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")

FRAGMENTS = "array<struct<name: string, id: string, next: string, start: bigint, end: bigint, hidden: boolean>>"


def tagged_fragments(raw: str) -> list[dict]:
    """Text blocks (with a name) and continuations (without, the first of each id) in the order in which they close.

    ``start`` and ``end`` bound the content in the source. An element that never closes is left out, and so is a tag without a ">". Scripts, styles and comments hold no tags.
    """
    prefixes = {p.lower() for p in _TAXONOMY.findall(raw)} or {"cyd"}
    waiting: dict[str, list[dict | None]] = {"ix:nonnumeric": [], "ix:continuation": []}
    out, ids, hidden = [], set(), 0
    for m in _TAG.finditer(raw, 0, raw.rfind(">") + 1):
        tag = (m["tag"] or "").lower()
        if tag == "ix:hidden":
            hidden = max(0, hidden - 1) if m["end"] else hidden + (not m["rest"].endswith("/"))
        elif tag and not m["end"]:
            said = {k.lower(): html.unescape(a or b) for k, a, b in _ATTRIBUTE.findall(m["rest"])}
            prefix, _, local = said.get("name", "").partition(":")
            block = tag == "ix:nonnumeric" and prefix.lower() in prefixes and local.endswith(_BLOCK)
            wanted = block or (tag == "ix:continuation" and said.get("id"))
            fragment = {"name": said["name"] if block else "", "id": said.get("id", ""), "next": said.get("continuedat", ""), "start": m.end(), "hidden": hidden > 0}
            if not m["rest"].endswith("/"):
                waiting[tag].append(fragment if wanted else None)
            elif wanted:
                out.append(fragment | {"end": m.end()})
        elif tag and waiting[tag]:
            fragment = waiting[tag].pop()
            if fragment:
                out.append(fragment | {"end": m.start()})
    first = []
    for f in out:
        if f["name"] or f["id"] not in ids:
            first.append(f)
            ids.update(() if f["name"] else (f["id"],))
    return first


def _fragments(pages: pd.Series) -> pd.Series:
    return pages.map(lambda raw: tagged_fragments(raw or ""))


def fragments(page: Column | str) -> Column:
    """``tagged_fragments`` of a column; a null page has none."""
    return F.pandas_udf(_fragments, FRAGMENTS)(page)
