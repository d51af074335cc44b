"""The judge's alignment against brute force, and its cases."""

import itertools

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.functions import judging
from loomwork.functions.text import verdict_or_error


def brute_aligned(a, b):
    """Best (score, matches) of a local alignment, cell by cell."""
    best, rows = (0, 0), [[(0, 0)] * (len(b) + 1)]
    for x in a:
        row = [(0, 0)]
        for j, y in enumerate(b):
            s, m = rows[-1][j]
            cells = [(0, 0), (s + judging.MATCH, m + 1) if x == y else (s + judging.CHANGE, m)]
            cells += [(c[0] + judging.SKIP, c[1]) for c in (rows[-1][j + 1], row[-1])]
            row.append(max(cells))
        rows.append(row)
        best = max(best, *row)
    return best[1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abcd"), max_size=12))
def test_alignment_is_the_best(a, b):
    assert judging.aligned(a, b) == brute_aligned(a, b)


def test_tokens():
    assert judging.tokens("The $1,500.00 and 010 POINTS, 1,234,567 x3 0.50") == ["the", "1500", "and", "10", "points", "1234567", "x", "3", "0.5"]
    assert judging.tokens(None) == judging.tokens(" .,!") == []


def test_agreement():
    true = [("$1500", "A player starts with 1,500 dollars."), ("10 points", "It gets 10.0 points."), ("a b c d e", "x a b z c d e"), ("Ärger", "der ärger")]
    false = [("$1500", "A player starts with 2,500 dollars."), ("10 points", "ten points"), ("a b c d e", "e d c b a"), ("a", ""), ("a", None), ("word", "other")]
    assert {judging.agreement(*x) for x in true} == {"true"} and {judging.agreement(*x) for x in false} == {"false"}
    assert judging.agreement("", "x") == judging.agreement(None, None) == judging.agreement("?!", "x") == judging.UNDECIDED


def test_columns(spark):
    rows = [("$1500", "1500"), ("1", "2"), (None, "x"), ("", None)]
    df = spark.createDataFrame(rows, "expected string, given string").repartition(2)
    got = df.select("expected", verdict_or_error(judging.agreement_column(F.col("expected"), F.col("given"))).alias("v")).collect()
    told = {r.expected: (r.v.passed, bool(r.v.error)) for r in got}
    assert told == {"$1500": (True, False), "1": (False, False), None: (None, True), "": (None, True)}


def test_long_texts():
    words = [f"w{i}" for i in range(3_000)]
    assert judging.aligned(words, list(itertools.chain(words[:1_500], ["x"], words[1_500:]))) == 3_000
