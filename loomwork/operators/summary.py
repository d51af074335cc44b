"""Answers made of sentences of the hits: a similarity graph of sentences, ranked with regard to the question.

Sentences of a question's hits are nodes. Two are joined by the cosine of their term weights, and a walk over these edges
that returns to sentences like the question gives each a rank (personalised PageRank). The best are taken one by one, each
less what it repeats of those taken, and told in the order of the hits. Term weights fall with the number of stored
chunks that have the term, counted over all of them.

All sentences of a question's hits are in its graph, however many: no likeness of all pairs is held, a step of the walk goes
from sentences to their terms and back, so time and memory grow with the terms of the hits. Questions are the rows that Spark deals out.

Defined cases: hits without a sentence give the empty answer; a question without a term of the hits is ranked by the graph
alone. Equal ranks go to the earlier sentence. A sentence that comes twice counts once, where it stands first.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.session import broadcast_if_small, saved, scratch

#: Sentences of an answer; the walk's chance to go on, and its steps; how much likeness to a taken sentence counts against one.
SENTENCES, GO_ON, STEPS, REPEAT = 3, 0.5, 40, 1.0
#: Characters of a sentence, at most; the rest is a sentence of its own.
LONGEST = 400
_TERM = re.compile(r"[^\W_]+")
_END = re.compile(r"(?<=[.!?])\s+|\n+")


def terms(text: str | None) -> list[str]:
    return _TERM.findall((text or "").lower())


def sentences(text: str | None) -> list[str]:
    """Parts of a text that end with a mark or a line, without white space around; long ones cut at LONGEST."""
    parts = [p.strip() for p in _END.split(text or "")]
    return [p[i : i + LONGEST] for p in parts for i in range(0, len(p), LONGEST) if terms(p[i : i + LONGEST])]


def document_frequencies(chunks: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(term, n): how many chunks (text) have each term, or each of wanted(term)."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    terms_of = chunks.select(F.explode(found).alias("term"))
    terms_of = terms_of if wanted is None else terms_of.join(wanted, "term", "left_semi")
    return terms_of.groupBy("term").agg(F.count("*").alias("n"))


def ranks(question: str, parts: Sequence[str], weight: Mapping[str, float]) -> tuple[np.ndarray, Callable[[int], np.ndarray]]:
    """The rank of each sentence, and a function that gives all sentences' likeness to one of them."""
    names: dict[str, int] = {}
    counts = [Counter(names.setdefault(t, len(names)) for t in terms(p)) for p in (*parts, question)]
    rows = np.repeat(np.arange(len(counts)), [len(found) for found in counts])
    columns, times = (np.fromiter((x for found in counts for x in pick(found)), np.int64) for pick in (dict.keys, dict.values))
    values = (1 + np.log(times)) * np.array([weight.get(t, 1.0) for t in names] or [1.0])[columns]
    norm = np.sqrt(np.bincount(rows, values**2, len(counts)))
    values /= np.where(norm > 0, norm, 1)[rows]
    told = np.zeros(len(names))
    told[columns[rows == len(parts)]] = values[rows == len(parts)]
    rows, columns, values = (x[: np.searchsorted(rows, len(parts))] for x in (rows, columns, values))

    def of_terms(x: np.ndarray) -> np.ndarray:
        return np.bincount(columns, values * x[rows], len(names))

    def of_parts(x: np.ndarray) -> np.ndarray:
        return np.bincount(rows, values * x[columns], len(parts))

    def like(part: int) -> np.ndarray:
        one = np.zeros(len(names))
        one[columns[rows == part]] = values[rows == part]
        return of_parts(one)

    asked, own = of_parts(told), np.bincount(rows, values**2, len(parts))
    # The edges of a sentence, without itself: by the terms that others have too.
    shared = np.flatnonzero((np.bincount(columns[values != 0], minlength=len(names)) > 1)[columns] & (values != 0))
    out = np.bincount(rows[shared], values[shared] * (of_terms(np.ones(len(parts)))[columns[shared]] - values[shared]), len(parts))
    back = asked / asked.sum() if asked.sum() > 0 else np.full(len(parts), 1 / len(parts))
    rank = back.copy()
    for _ in range(STEPS):
        part = np.where(out > 0, rank / np.where(out > 0, out, 1), 0)
        rank = (1 - GO_ON) * back + GO_ON * (of_parts(of_terms(part)) - own * part + rank[out <= 0].sum() * back)
    return rank, like


def summary(question: str, texts: Sequence[str | None], weight: Mapping[str, float], n: int = SENTENCES) -> str:
    """The best n sentences of texts, which stand best first, for the question; in the order of the texts."""
    parts = list(dict.fromkeys(s for t in texts for s in sentences(t)))
    if not parts:
        return ""
    rank, like = ranks(question or "", parts, weight)
    rank, repeats, taken = np.round(rank / rank.max(), 9), np.zeros(len(parts)), []
    while len(taken) < min(n, len(parts)):
        value = np.round(rank - REPEAT * repeats, 9)
        value[taken] = -np.inf
        taken.append(int(value.argmax()))
        repeats = np.maximum(repeats, like(taken[-1]))
    return " ".join(parts[i] for i in sorted(taken))


def summaries(ready: DataFrame, chunks: DataFrame, n: int = SENTENCES) -> DataFrame:
    """(query_id, answer) of questions assembled with their hits (query_id, question, texts).

    Of the terms' frequencies those that a question's hits have are joined to it; no table of all terms goes anywhere.
    """
    folder = scratch(chunks.sparkSession, "summary")
    ready = saved(ready.select("query_id", "question", "texts"), f"{folder}/ready")  # searched once for all that follows
    held = ready.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "texts", "question")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("term"))
    wanted = saved(held.select("term").distinct(), f"{folder}/wanted")
    chunks_total = chunks.count()
    counted = document_frequencies(chunks, broadcast_if_small(wanted))
    weights = held.join(counted, "term").groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("term", F.log(1 + chunks_total / F.col("n")).alias("w")))).alias("weights"))
    joined = ready.join(weights, "query_id", "left")
    return joined.select("query_id", summary_column(F.col("question"), F.col("texts"), F.col("weights"), n).alias("answer"))


def summary_column(question: Column, texts: Column, weights: Column, n: int = SENTENCES) -> Column:
    @F.pandas_udf("string")
    def answers(questions: pd.Series, hits: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([summary(q, list(t) if t is not None else [], dict(w) if w is not None else {}, n) for q, t, w in zip(questions, hits, known)], dtype=object)

    return answers(question, texts, weights)
