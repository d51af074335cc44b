"""Answers from sentences, against a plain computation."""

import math
import tracemalloc
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loomwork.operators import summary


def brute(question, texts, weight, n):
    """The walk as a linear system, sentence by sentence."""
    parts = []
    for t in texts:
        for s in summary.sentences(t):
            if s not in parts:
                parts.append(s)
    if not parts:
        return ""

    def vector(s):
        v = {t: (1 + math.log(c)) * weight.get(t, 1.0) for t, c in Counter(summary.terms(s)).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else {}

    dot = lambda a, b: sum(x * b.get(t, 0) for t, x in a.items())
    vs, q = [vector(s) for s in parts], vector(question)
    m = len(parts)
    asked = [dot(v, q) for v in vs]
    back = np.array([x / sum(asked) for x in asked]) if sum(asked) > 0 else np.full(m, 1 / m)
    step = np.zeros((m, m))
    for i in range(m):
        row = [dot(vs[i], vs[j]) if i != j else 0 for j in range(m)]
        step[i] = np.array(row) / sum(row) if sum(row) > 0 else back
    rank = np.linalg.solve(np.eye(m) - summary.GO_ON * step.T, (1 - summary.GO_ON) * back)
    rank, taken = rank / rank.max(), []
    while len(taken) < min(n, m):
        value = [-9.0 if i in taken else rank[i] - summary.REPEAT * max([dot(vs[i], vs[j]) for j in taken], default=0) for i in range(m)]
        taken.append(int(np.argmax(value)))
    return " ".join(parts[i] for i in sorted(taken))


TEXTS = [
    "The longest train gets ten points. Trains are made of cars! A player draws two cards.",
    "A player starts with $1500. The bank keeps the rest.\nThe longest train gets ten points.",
    "Nothing here about games, only rain and rain. Rain falls in the plain, mainly.",
]


def test_equals_the_plain_computation(monkeypatch):
    monkeypatch.setattr(summary, "STEPS", 400)
    weight = {"train": 3.0, "points": 2.5, "the": 0.1, "player": 2.0, "rain": 2.0}
    for q in ("How many points does the longest train get?", "What does a player start with?", "rain", "unknown words only", ""):
        for n in (1, 2, 3, 20):
            assert summary.summary(q, TEXTS, weight, n) == brute(q, TEXTS, weight, n)


def test_what_is_asked_comes_and_repeats_do_not():
    got = summary.summary("How many points does the longest train get?", TEXTS, {}, 1)
    assert got == "The longest train gets ten points."
    copies = ["The longest train gets ten points. The longest train gets ten points!", "The train is long. A bank."]
    two = summary.summary("longest train points", copies, {}, 2)
    assert two.count("longest train gets ten points") == 1


def test_cases(spark):
    assert summary.summary("q", [], {}) == summary.summary("q", [None, "", " .!? "], {}) == ""
    assert summary.summary(None, ["One sentence"], {}) == "One sentence"
    assert len(summary.summary("a", ["a" * 5_000], {}, 1)) == summary.LONGEST
    ready = spark.createDataFrame([(1, "longest train", TEXTS), (2, "", []), (3, None, [None, "x y."])], "query_id long, question string, texts array<string>")
    chunks = spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "text string")
    got = {r.query_id: r.answer for r in summary.summaries(ready, chunks).collect()}
    n = {r.term: r.n for r in summary.document_frequencies(chunks).collect()}
    assert n["train"] == 2 and n["rain"] == 1
    assert got == {1: summary.summary("longest train", TEXTS, {t: math.log(1 + 4 / c) for t, c in n.items()}), 2: "", 3: "x y."}


def test_rows_of_the_question_only(spark):
    ready = spark.createDataFrame([(i, "the game", ["The game is over."]) for i in range(3)], "query_id long, question string, texts array<string>")
    assert summary.summaries(ready, spark.createDataFrame([("The game is over.",)], "text string")).select(F.count_distinct("answer")).first()[0] == 1


def test_all_sentences_of_the_hits_are_in_the_graph(monkeypatch):
    """Those beyond the first 200 were left out."""
    filler = " ".join(f"Word{i % 17} and word{i % 23} number {i}." for i in range(260))
    texts = [filler, "The longest train gets ten points."]
    asked = "How many points does the longest train get?"
    assert summary.summary(asked, texts, {}, 1) == "The longest train gets ten points."
    monkeypatch.setattr(summary, "STEPS", 400)
    rng = np.random.default_rng(1)
    weight = {t: rng.uniform(0.5, 3) for t in summary.terms(" ".join(texts))}  # no two sentences alike
    for q in (asked, "word3 and number 259", ""):
        assert summary.summary(q, texts, weight, 4) == brute(q, texts, weight, 4)


def test_many_sentences_take_memory_for_their_terms_only():
    texts = [f"Word{i % 97} and word{i % 89} number {i}." for i in range(20_000)]
    tracemalloc.start()
    assert summary.summary("number 19999", texts, {}, 1) == texts[-1]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
