"""Literal cases and properties of the retrieval operators."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.functions.text import is_blank, is_pdf_name, term_bucket, term_counts, verdict
from loomwork.operators import answers, chunking, retrieval
from loomwork.sources.store import insert_if_absent

KEYS = "source string, page int, pos long, text string"


def reference_ids(rows):
    last, index, out = None, 0, []
    for source, page in rows:
        key = f"{source}:{page}"
        index = index + 1 if key == last else 0
        last = key
        out.append(f"{key}:{index}")
    return out


def test_run_length_ids_literal(spark):
    rows = [("a", 0), ("a", 0), ("a", 1), ("a", 0), (None, None), (None, None), ("b", 0)]
    df = spark.createDataFrame([(s, p, i, "") for i, (s, p) in enumerate(rows)], KEYS)
    got = [r.id for r in chunking.run_length_ids(df, ["pos"]).orderBy("pos").collect()]
    assert got == ["a:0:0", "a:0:1", "a:1:0", "a:0:0", "None:None:0", "None:None:1", "b:0:0"]


def plain_split(text, size, overlap, marks=("\n\n", "\n", " ")):
    """The splitter's contract, written anew: cut where the strongest mark that is left fits, then pack greedily."""

    def cut(part, marks):
        if len(part) <= size:
            return [part]
        if not marks:
            return list(part)
        found, at = [], 0
        while (end := part.find(marks[0], at)) >= 0:
            found.append(part[at : end + len(marks[0])])
            at = end + len(marks[0])
        return [x for piece in [*found, part[at:]] for x in cut(piece, marks[1:])]

    pieces, out, first, at = cut(text, marks), [], 0, 0
    while at < len(pieces):
        while at < len(pieces) and sum(map(len, pieces[first : at + 1])) <= size:
            at += 1
        out.append("".join(pieces[first:at]))
        if at < len(pieces):
            while first < at and (sum(map(len, pieces[first:at])) > overlap or sum(map(len, pieces[first : at + 1])) > size):
                first += 1
    return [x.strip() for x in out if x.strip()]


def test_recursive_chunks_equal_a_second_implementation(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("source", F.col("doc_id").alias("page"), F.col("doc_id").alias("pos"), "text")
    got = {}
    for r in chunking.recursive_chunks(docs).orderBy("page", "chunk").collect():
        got.setdefault(r.page, []).append(r.text)
    texts = {r.page: r.text or "" for r in docs.collect() if len(r.text or "") < 20_000}
    assert len(texts) > 150
    for page, text in texts.items():
        assert got.get(page, []) == plain_split(text, 800, 80)


def test_long_texts_split_as_in_the_second_implementation():
    rnd = random.Random(2)
    words = ["".join(rnd.choices("abcdeé日", k=rnd.randint(1, 12))) for _ in range(400)]
    long = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\n", "\n\n"]) for _ in range(20_000))
    for text in (long, "x" * 21_000, "a b\n" * 10_000, ("y" * 900 + "\n") * 60, " " * 5_000, "\n\n".join(["z" * 799, "q" * 801] * 20)):
        assert chunking.split_text(text) == plain_split(text, 800, 80)


@pytest.mark.parametrize("kinds", [1, 2, 5])
def test_run_length_ids_over_many_parts(spark, kinds):
    rnd = random.Random(kinds)
    rows = [("s", rnd.randrange(kinds)) for _ in range(500)]
    df = spark.createDataFrame([(s, p, i, "") for i, (s, p) in enumerate(rows)], KEYS).repartition(7)
    assert [r.id for r in chunking.run_length_ids(df, ["pos"]).orderBy("pos").collect()] == reference_ids(rows)
    assert chunking.run_length_ids(df.limit(0), ["pos"]).count() == 0


def test_page_ids_count_within_pages(spark):
    df = spark.createDataFrame([("a", 0, 5, "x" * 2000), ("a", 1, 6, "y"), (None, None, 7, "z")], KEYS)
    for number in (chunking.page_chunk_ids, chunking.repeated_page_ids):
        got = [r.id for r in number(chunking.stride_chunks(df)).orderBy("pos", "chunk").collect()]
        assert got == ["a:0:0", "a:0:1", "a:0:2", "a:1:0", "None:None:0"]
    twice = df.union(spark.createDataFrame([("a", 0, 9, "more")], KEYS))
    got = {r.id for r in chunking.repeated_page_ids(chunking.stride_chunks(twice)).collect()}
    assert got == {"a:0:0", "a:0:1", "a:0:2", "a:0:3", "a:1:0", "None:None:0"}


def test_stride_chunks_cover_the_text(spark):
    texts = ["", "a", "b" * 800, "c" * 801, "é" * 1520, "d" * 1521, None]
    df = spark.createDataFrame([("s", i, i, t) for i, t in enumerate(texts)], KEYS)
    got = {}
    for r in chunking.stride_chunks(df).orderBy("pos", "chunk").collect():
        got.setdefault(r.page, []).append(r.text)
    assert [len(got.get(i, [])) for i in range(7)] == [1, 1, 1, 2, 2, 3, 0]
    for i, t in enumerate(texts[:-1]):
        assert got[i][0] + "".join(c[80:] for c in got[i][1:]) == t


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é\n", max_size=400), st.integers(5, 60))
def test_recursive_split_properties(text, size):
    overlap = size // 5
    chunks = chunking.split_text(text, size, overlap)
    assert all(0 < len(c) <= size and c in text for c in chunks)
    bare = lambda x: "".join(x.split())
    assert sum(len(bare(c)) for c in chunks) >= len(bare(text))
    at = 0
    for c in chunks:  # in order, none skipped: the text goes on where the chunks before it end, or overlaps them
        at = next(i for i in range(max(0, at - overlap), len(text)) if text.startswith(c, i)) + len(c)


def test_recursive_split_prefers_strong_separators():
    text = "one two\nthree four\n\nfive six"
    assert chunking.split_text(text, 19, 0) == ["one two\nthree four", "five six"]
    assert chunking.split_text("x" * 25, 10, 2) == ["x" * 10, "x" * 10, "x" * 9]
    assert chunking.split_text(" \n\n ") == []


def test_insert_if_absent_matches_ids_only(spark):
    new = spark.createDataFrame([("x", "changed"), (None, "n"), ("y", "new")], "id string, text string")
    store = spark.createDataFrame([("x", "old"), (None, "n")], "id string, text string")
    assert sorted((r.id or "", r.text) for r in insert_if_absent(new, store).collect()) == [("", "n"), ("y", "new")]


def test_guards(spark):
    asked = spark.createDataFrame([(t,) for t in ["", " ", "\t\n", " a ", None, "　", "\x1c\x1d\x1e\x1f", "\x1c.", "\x85\xa0"]], "t string")
    assert [r[0] for r in asked.select(is_blank(F.col("t"))).collect()] == [True, True, True, False, True, True, True, False, True]
    names = spark.createDataFrame([(t,) for t in ["a.pdf", "B.PDF", "c.txt", None]], "t string")
    assert [r[0] for r in names.select(is_pdf_name(F.col("t"))).collect()] == [True, False, False, False]


def test_verdicts(spark):
    said = spark.createDataFrame([(t,) for t in ["True", "not true, false", "False."]], "t string")
    assert [r[0] for r in said.select(verdict(F.col("t"))).collect()] == [True, True, False]
    with pytest.raises(Exception, match="neither true nor false"):
        spark.createDataFrame([("maybe",)], "t string").select(verdict(F.col("t"))).collect()


def test_context_sources_and_prompt(spark):
    hits = spark.createDataFrame([(1, 2, "b", "B {question} $1500"), (1, 1, "a", "A"), (1, 3, None, "A")], "query_id long, rank int, id string, text string")
    assert answers.contexts(hits).first().context == "A\n\n---\n\nB {question} $1500\n\n---\n\nA"
    assert answers.source_lists(hits).first().sources == ["a", "b", "unknown"]
    asked = spark.createDataFrame([(1, "how {context} \\1?"), (2, "none")], "query_id long, question string")
    rows = {r.query_id: r for r in answers.assembled(asked, hits).collect()}
    assert "$1500" in rows[1].prompt and rows[1].prompt.rstrip().endswith("how {context} \\1?") and rows[1].prompt.count("{context}") == 1
    assert (rows[2].texts, rows[2].sources, rows[2].prompt) == ([], [], None)


def test_terms():
    assert term_counts("The THE, the!").max() == 3 and term_counts(None).sum() == 0 == term_counts("... !").sum()
    assert term_counts("é1 b_c").sum() == 3 and term_bucket("the") == term_bucket("the")


@pytest.mark.parametrize("block", [3, 4_096])
def test_nearest_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    monkeypatch.setattr(retrieval, "ROW_PART", 17)
    rng = np.random.default_rng(1)
    v = rng.integers(-2, 3, (60, 4)).astype(float)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None), (None, [0.0] * 4)], "id long, vector array<double>").repartition(4)
    asked = spark.createDataFrame([(i, v[i].tolist()) for i in range(10)], "query_id long, vector array<double>")
    got = {}
    for r in retrieval.nearest(rows, asked).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.dist, r.id))
    assert got == {q: sorted((float(((v[q] - x) ** 2).sum()), i) for i, x in enumerate(v))[:5] for q in range(10)}
    one = [(r.dist, r.id) for r in retrieval.nearest_to_one(rows.where("id is not null"), v[7].tolist()).orderBy("rank").collect()]
    assert one == got[7]
    assert retrieval.nearest(rows, asked.limit(0)).count() == 0
