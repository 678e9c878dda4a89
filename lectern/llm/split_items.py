"""Cutting oversized items into pieces under a limit by recursive bisection.

Natural boundaries are the places after any of ``。！？!?``, after ``.`` before white space, and at a blank line.
They cut an item into stretches. A run of stretches that is too long is cut at the strongest boundary near its
middle (a blank line before a line end before any other), and each half that is still longer than the limit minus
the overlap is cut again. Only a single stretch that is too long by itself is cut by force: at white space near its
middle, else at a comma, else in the middle. At last every piece but the first is extended backwards by the overlap.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOUNDARY = re.compile(r"[。！？!?]|\.(?=\s)|(?:\r\n|\n|\r(?!\n))[ \t]*(?:\r\n|\n|\r(?!\n))")
LINE_END = re.compile(r"[^\S\r\n]*[\r\n]")
WEAK = (re.compile(r"\s"), re.compile(r"[，、；：,;:]"))


class Piece(NamedTuple):
    """``text[start:end]``; ``overlap`` of its first characters belong to the piece before it."""

    start: int
    end: int
    overlap: int
    forced: bool


def stretches(text: str) -> tuple[list[int], list[int], list[int]]:
    """Starts and ends of the stretches between natural boundaries, without white space at their ends and without
    blank ones, and the strength (1 to 3) of the boundary behind each."""
    starts: list[int] = []
    ends: list[int] = []
    strengths: list[int] = []

    def add(a: int, b: int) -> None:
        part = text[a:b]
        bare = part.lstrip()
        if bare:
            starts.append(b - len(bare))
            ends.append(a + len(part.rstrip()))
            strengths.append(1)

    at = 0
    for m in BOUNDARY.finditer(text):
        if text[m.start()] in "\r\n":
            add(at, m.start())
            strength = 3
        else:
            add(at, m.end())
            strength = 2 if LINE_END.match(text, m.end()) else 1
        if strengths and strengths[-1] < strength:
            strengths[-1] = strength
        at = m.end()
    add(at, len(text))
    return starts, ends, strengths


def middle_cut(places: list[int], low: int, high: int) -> int | None:
    """The place between ``low`` and ``high``, both excluded, that is nearest to their middle."""
    i, j, middle = bisect_right(places, low), bisect_left(places, high), (low + high) / 2
    if i >= j:
        return None
    k = bisect_left(places, middle, i, j)
    return min(places[max(i, k - 1) : min(j, k + 1)], key=lambda p: (abs(p - middle), p))


def force(text: str, start: int, end: int, most: int) -> list[tuple[int, int]]:
    """Spans of at most ``most`` characters of a stretch without a natural boundary, bare of white space."""
    weak = [[m.end() for m in kind.finditer(text, start, end)] for kind in WEAK]
    out, todo = [], [(start, end)]
    while todo:
        a, b = todo.pop()
        while a < b and text[a].isspace():
            a += 1
        while a < b and text[b - 1].isspace():
            b -= 1
        if b - a <= most:
            if a < b:
                out.append((a, b))
            continue
        quarter = (b - a) // 4
        cuts = (middle_cut(places, a + quarter, b - quarter) for places in weak)
        cut = next((c for c in cuts if c is not None), (a + b) // 2)
        todo += [(cut, b), (a, cut)]
    return out


def split(text: str | None, limit: int = 300, overlap: int = 0) -> list[Piece]:
    """The pieces of ``text`` in order, none longer than ``limit``; one piece if it fits, none if it is null or blank."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and below the limit")
    if text is None or not text.strip():
        return []
    if len(text) <= limit:
        return [Piece(0, len(text), 0, False)]
    starts, ends, strengths = stretches(text)
    most = limit - overlap
    cores: list[tuple[int, int, bool]] = []
    todo = [(0, len(starts))]
    while todo:
        i, j = todo.pop()
        a, b = starts[i], ends[j - 1]
        if b - a <= most:
            cores.append((a, b, False))
        elif j == i + 1:
            cores += [(x, y, True) for x, y in force(text, a, b, most)]
        else:
            middle, quarter = (a + b) / 2, (b - a) / 4
            low = bisect_left(ends, middle - quarter, i, j - 1)
            high = bisect_right(ends, middle + quarter, i, j - 1)
            if low == high:  # none in the middle half: the nearest boundary on either side of it
                low, high = max(i, low - 1), min(j - 1, high + 1)
            cut = min(range(low, high), key=lambda k: (-strengths[k], abs(ends[k] - middle), k))
            todo += [(cut + 1, j), (i, cut + 1)]
    pieces = [Piece(*cores[0][:2], 0, cores[0][2])]
    for (before, _, _), (a, b, forced) in zip(cores, cores[1:], strict=False):
        first = max(before, a - overlap)
        pieces.append(Piece(first, b, a - first, forced))
    return pieces


SCHEMA = "part int, parts int, piece_start int, piece_len int, overlap int, forced boolean, piece_title string, piece string"


def split_column(
    df: DataFrame, key: str = "chunk_id", title: str = "title", text: str = "content", limit: int = 300, overlap: int = 0, longer_only: bool = False
) -> DataFrame:
    """One row for each piece of ``text``: its key, part number from 1, number of parts, offset, length, overlap with
    the piece before it, whether it was cut by force, title and text. One pass over the rows, no shuffle.

    A text of at most ``limit`` characters is one piece with its own title, or left out with ``longer_only``; pieces
    of a longer one are titled "title (part i)". Null and blank texts of at most ``limit`` characters have no piece;
    a longer blank text has one empty piece, so that it isn't lost. A null title counts as empty. Repeated rows give
    repeated pieces; columns other than the three are not read.
    """
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, *(f.split()[0] for f in SCHEMA.split(", "))]
        types = [pa.int32()] * 5 + [pa.bool_(), pa.string(), pa.string()]
        for batch in batches:
            index: list[int] = []
            rows: list[tuple[int, int, int, int, int, bool, str, str]] = []
            for i, (name, content) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                long = content is not None and len(content) > limit
                if longer_only and not long:
                    continue
                pieces = split(content, limit, overlap) or ([Piece(0, 0, 0, False)] if long else [])
                head = (name or "").strip()
                for k, p in enumerate(pieces, 1):
                    index.append(i)
                    rows.append((k, len(pieces), p.start, p.end - p.start, p.overlap, p.forced, f"{head} (part {k})".lstrip() if long else head, content[p.start : p.end]))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int32())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    return df.select(key, F.col(title), F.col(text)).mapInArrow(run, f"`{key}` {kind.simpleString()}, {SCHEMA}")
