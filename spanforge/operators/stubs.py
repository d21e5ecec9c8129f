"""Bodies that only say where their content stands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words of a pointer, of one to another document, and what the pointer names, first match first.
_LETTERS = r"\p{L}\p{N}_"
_INCORPORATED = rf"incorporat[{_LETTERS}]*\b[{_LETTERS},'&\-.\s]{{0,40}}?\bby\s+reference"
POINTS = (
    rf"{_INCORPORATED}|reference\s+is\s+made\b|refer\s+to\s+(?:the|note|item|part|section|our|page)\b"
    r"|(?:see|set\s+forth\s+in|appears?\s+in|appear\s+on|included\s+in|contained\s+in|described\s+in|discussed\s+in|are\s+set\s+forth\s+in|is\s+set\s+forth\s+in)\b"
    rf"[{_LETTERS},'&\-.\s\"“”]{{0,90}}?\b(?:note\s+\d|item\s+\d|part\s+[ivx]|financial\s+section|consolidated\s+financial|index\s+to|proxy\s+statement|annual\s+report|"
    r"management['’]s\s+discussion|pages?\s+\d)"
)
POINTS_OUTSIDE = rf"{_INCORPORATED}\b[{_LETTERS},'&\-.\s\"“”()]{{0,160}}?\b(?:(?:definitive\s+)?(?:proxy|information)\s+statement|annual\s+report|financial\s+section)"
NUMBER = r"\b\d[\d,]*\b"
SHORT_BODY, LONG_BODY, FEW_NUMBERS = 900, 3000, 12
TARGETS = [
    (r"proxy\s+statement", "the definitive proxy statement (external document, not fetched)"),
    (r"financial\s+section", "the appended Financial Section of this filing"),
    (r"annual\s+report", "the annual report / financial statements bound in this filing"),
    (r"note\s+\d+", "a financial-statement note ({}) elsewhere in this filing"),
    (r"item\s+\d+[a-c]?", "another item ({}) in this filing"),
    (r"pages?\s+\d+\s*[-–]\s*\d+", "a page range ({}) of this filing"),
]
ELSEWHERE = "content located elsewhere in this filing"


def stub_target(body: Column) -> Column:
    """What a body without content of its own points at, null for any other body.

    Up to 900 characters any pointer will do; up to 3000 it must name another document, in a text of fewer than twelve numbers.
    """
    named = F.lit(ELSEWHERE)
    for pattern, words in reversed(TARGETS):
        met = F.regexp_extract(body, f"(?i)({pattern})", 1)
        before, _, after = words.partition("{}")
        named = F.when(met != "", F.concat(F.lit(before), met, F.lit(after)) if "{}" in words else F.lit(words)).otherwise(named)
    short = (F.length(body) <= SHORT_BODY) & body.rlike(f"(?i){POINTS}")
    outside = F.length(body).between(SHORT_BODY + 1, LONG_BODY) & body.rlike(f"(?i){POINTS_OUTSIDE}") & (F.regexp_count(body, F.lit(NUMBER)) < FEW_NUMBERS)
    return F.when(short | outside, named)
