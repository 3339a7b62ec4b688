import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessellar.operators.packed import FOLD, split_batch, split_packed

CASES = [
    ("a,b", ["a", "b"]),
    ("['a, b', \"women's\"]", ["a, b", "women's"]),
    ('["so-called \\"x\\" y, z","b"]', ['so-called "x" y, z', "b"]),
    ('"a ""b"" c, d";e', ['a "b" c, d', "e"]),
    ("(1) x (a, b)\n(2) 'y, z'", ["x (a, b)", "y, z"]),
    ("* a\n* b\n* c-d", ["a", "b", "c-d"]),
    ("• a\n• “b; c”", ["a", "b; c"]),
    ("x / y/z | no. 1 position\tu", ["x", "y/z", "no. 1 position", "u"]),
    ("1. a\n2. 24/7 b\n10) c", ["a", "24/7 b", "c"]),
    ("GHG (scope 1, 2), b", ["GHG (scope 1, 2)", "b"]),
    ("women's, shareholders' rights, 'a, b'", ["women's", "shareholders' rights", "a, b"]),
    ("  a ,, a , ", ["a", "a"]),
    ("“open, b", ["“open", "b"]),
    ("„Basel III“; b", ["Basel III", "b"]),
    ("(„Basel“ rules), „a, b”", ["(„Basel“ rules)", "a, b"]),
    ("»a; b«, «c, d»", ["a; b", "c, d"]),
    ("‚a, b‘; ‘c, d’", ["a, b", "c, d"]),
    ("x\x04y, z\x01", ["x\x04y", "z\x01"]),
    ("a\u00a0b,\u00a0c\u00a0; d，e", ["a\u00a0b", "c", "d", "e"]),
    ("▪ a\n◦ b ‣ c\n(x，y) z", ["a", "b", "c", "(x，y) z"]),
    ("", []),
    (" ;,| \n", []),
    (None, []),
    ("café, naïve – x", ["café", "naïve", "x"]),
]


@pytest.mark.parametrize(("cell", "want"), CASES)
def test_cell(cell, want):
    assert split_batch(pa.array([cell], pa.string()))[1].to_pylist() == [want]


def test_cells_together_are_as_alone():
    parent, lists = split_batch(pa.array([c for c, _ in CASES], pa.string()))
    assert lists.to_pylist() == [w for _, w in CASES]
    assert list(parent) == [i for i, (_, w) in enumerate(CASES) for _ in w]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text("abcXYZ09 é", min_size=1, max_size=8).map(str.strip).filter(bool), max_size=6), max_size=8))
def test_round_trip(rows):
    """Quoted and joined by any of the separators, every list comes back."""
    for sep in (",", ";", " | ", "\n", "\t", " / "):
        cells = [sep.join(f'"{w}"' for w in r) for r in rows]
        assert split_batch(pa.array(cells, pa.string()))[1].to_pylist() == rows


def test_marks_inside_values_stay_as_they_are():
    for mark in FOLD:
        if mark not in "•▪◦‣，；":
            assert split_batch(pa.array([f"p{mark}q, r"]))[1].to_pylist() == [[f"p{mark}q", "r"]], mark
        assert split_batch(pa.array([f'"p{mark}q, r"; s']))[1].to_pylist() == [[f"p{mark}q, r", "s"]], mark
        assert split_batch(pa.array([f"(p{mark}q) r"]))[1].to_pylist() == [[f"(p{mark}q) r"]], mark


def test_long_cell_and_batch_of_none():
    long = "; ".join(f"k{i}" for i in range(20_000))
    assert len(split_batch(pa.array([long]))[1][0]) == 20_000
    assert split_batch(pa.array([], pa.string()))[1].to_pylist() == []
    assert split_batch(pa.array([None, None], pa.string()))[1].to_pylist() == [[], []]


def test_table(spark):
    df = spark.createDataFrame([(1, "a, b", "x"), (1, "a, b", "x"), (2, None, "y"), (None, "c", "z")], "kw_id bigint, keywords string, pos string")
    rows = sorted(split_packed(df, "keywords", "kw_id", value="keyword").collect(), key=str)
    assert sorted((r["kw_id"] or 0, r["pos"], r["keyword"]) for r in rows) == [(0, 1, "c"), (1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 2, "b")]
    assert split_packed(df.limit(0), "keywords", "kw_id").count() == 0
