"""Chunks along nested declarations: a slice that is too large is cut where its own children begin, and so on down.

One pass of a pattern finds brackets, strings and comments; what is inside the latter two opens nothing. A line that
opens a declaration (the patterns of the flat chunker) stands at a depth: of brackets, or of indentation where that is
what nests. The shallowest declarations of a slice are its children.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions.helpers import suffix
from trawl.operators.chunking import BOUNDARIES, BOUNDARY_LANGUAGES, CAP, _each

_STRING = r""""(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'"""
_HASH = rf"""\"{{3}}(?s:.*?)(?:\"{{3}}|\Z)|'{{3}}(?s:.*?)(?:'{{3}}|\Z)|{_STRING}|\#[^\n]*"""
_SLASH = rf"""/\*(?s:.*?)(?:\*/|\Z)|//[^\n]*|`(?s:(?:\\.|[^`\\])*)(?:`|\Z)|{_STRING}"""
INDENTED = ("python", "ruby")


def depths(text: str, lang: str) -> list[tuple[int, int]]:
    """(start, depth) of each line that does not begin inside a string or a comment."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    closed, moves, depth = [], [], 0
    for m in re.finditer((_HASH if lang in (*INDENTED, "bash") else _SLASH) + r"|[{}()\[\]]", text):
        if m.end() - m.start() > 1 or m[0] not in "{}()[]":
            closed.append((m.start(), m.end()))
        else:
            depth = depth + 1 if m[0] in "{([" else max(0, depth - 1)
            moves.append((m.end(), depth))
    out, places, begun = [], [p for p, _ in moves], [a for a, _ in closed]
    for s in starts:
        k = bisect_left(begun, s) - 1
        if k >= 0 and closed[k][1] > s:
            continue
        inner = moves[i - 1][1] if (i := bisect_left(places, s + 1)) else 0
        if lang in INDENTED:
            line = text[s : (text.find("\n", s) + 1 or len(text) + 1) - 1].expandtabs(8)
            if inner and lang == "python":
                continue  # a line that goes on
            inner = len(line) - len(line.lstrip())
        out.append((s, inner))
    return out


def declarations(text: str, lang: str) -> list[tuple[int, int]]:
    """(start, depth) of each line that opens a declaration."""
    patterns = [re.compile(p.removeprefix("^"), re.ASCII) for p in BOUNDARIES.get(lang, ())]
    out = []
    for s, d in depths(text, lang):
        at = s
        while at < len(text) and text[at] in " \t":
            at += 1
        if any(p.match(text, at) or p.match(text, s) for p in patterns):
            out.append((s, d))
    return out


def nested_chunks(text: str, lang: str | None, cap: int = CAP) -> list[tuple[str, int, int, int]]:
    """(chunk, start, end, level): slices of at most cap characters where the declarations allow it.

    A slice over cap is cut where its shallowest declarations begin, each of these likewise; what stands before the
    first is a slice of its own. One without declarations inside is cut after lines, and only a line of over cap is
    longer. Blank slices go; start and end are those of the slice before it is trimmed.
    """
    found = declarations(text, lang or "")
    out: list[tuple[str, int, int, int]] = []

    def cut(lo: int, hi: int, level: int, inner: list[tuple[int, int]]) -> None:
        if hi - lo <= cap:
            out.append((text[lo:hi].strip(), lo, hi, level))
            return
        inner = [x for x in inner if lo < x[0] < hi]
        if not inner:
            at = lo
            while at < hi:
                end = at
                while end < hi:
                    next_ = text.find("\n", end, hi) + 1 or hi
                    if next_ - at > cap and end > at:
                        break
                    end = next_
                out.append((text[at:end].strip(), at, end, level))
                at = end
            return
        least = min(d for _, d in inner)
        ends = [lo, *(s for s, d in inner if d == least), hi]
        for a, z in zip(ends, ends[1:], strict=False):
            cut(a, z, level + 1, inner)

    cut(0, len(text), 0, found)
    return [x for x in out if x[0]]


def by_nesting(docs: DataFrame, id_col: str, text_col: str, path_col: str, cap: int = CAP) -> DataFrame:
    """id, chunk_index, start, end, level, chunk; languages without patterns are cut after lines. Null texts are empty and have no chunk."""
    table = F.create_map(*[F.lit(x) for pair in BOUNDARY_LANGUAGES.items() for x in pair])
    own = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.try_element_at(table, suffix(path_col)).alias("_lang"))

    def rows(text, lang):
        return [(k, a, z, level, c) for k, (c, a, z, level) in enumerate(nested_chunks(text, lang, cap))]

    return _each(own, id_col, ["_text", "_lang"], rows, "chunk_index bigint, start bigint, end bigint, level bigint, chunk string")
