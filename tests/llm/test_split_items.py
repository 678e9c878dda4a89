import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lectern.llm.queries import p5_found
from lectern.llm.split_items import split, split_column

SCHEMA = "chunk_id bigint, title string, content string, part int, piece string, metadata map<string,string>"


@given(st.text("ab中 。.\n!", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_pieces_cover_the_text(text, limit, overlap):
    pieces = split(text, limit, overlap)
    assert all(0 < p.end - p.start <= limit for p in pieces)
    own = "".join(text[p.start + p.overlap : p.end] for p in pieces)
    assert "".join(own.split()) == "".join(text.split())
    for a, b in zip(pieces, pieces[1:], strict=False):
        assert b.overlap <= overlap and b.start + b.overlap >= a.end


@given(st.text("ab中 。.\n\t!", max_size=300), st.integers(5, 40))
def test_forced_only_where_a_stretch_is_too_long(text, limit):
    stretches = [s.strip() for s in re.split(r"(?<=[。！？!?])|(?<=\.)(?=\s)|\n[ \t]*\n", text)]
    if len(text) > limit:
        assert any(p.forced for p in split(text, limit)) == any(len(s) > limit for s in stretches)


def test_strongest_boundary_near_the_middle():
    text = "a" * 40 + ". " + "b" * 30 + ".\n\n" + "c" * 40 + "."
    assert [text[p.start : p.end] for p in split(text, 80)] == ["a" * 40 + ". " + "b" * 30 + ".", "c" * 40 + "."]
    with pytest.raises(ValueError):
        split("x", 5, 5)


def test_rows(spark):
    rows = [(1, " T ", "甲。" * 200, 1, "x", {}), (2, None, "x" * 700, 1, "x", None), (3, "S", "short", 1, "x", {}), (4, "N", None, 1, "x", {}), (5, "B", " " * 400, 1, "x", {}), (6, "E", "", 1, "x", {}), (7, "L", "ab. " * 100_000, 1, "x", {})]
    got = split_column(spark.createDataFrame(rows, SCHEMA), overlap=20).collect()
    by = {}
    for r in got:
        by.setdefault(r["chunk_id"], []).append(r)
    assert set(by) == {1, 2, 3, 5, 7} and by[1][0]["piece_title"] == "T (part 1)" and by[2][0]["piece_title"] == "(part 1)" and by[3][0]["piece_title"] == "S"
    assert all(r["forced"] for r in by[2]) and not any(r["forced"] for r in by[1] + by[5] + by[7]) and by[5][0]["piece"] == ""
    assert split_column(spark.createDataFrame([], SCHEMA)).count() == 0


def test_found(spark, tiny):
    got = p5_found(spark, tiny)
    assert got.columns == ["chunk_id", "cut"] and {r["cut"] for r in got.collect()} == {"natural", "forced"}
