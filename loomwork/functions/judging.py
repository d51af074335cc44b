"""Whether a given answer says what was expected, without a language model: numbers and a local alignment of words.

Texts become tokens: runs of letters in lower case, and numbers by value, so 1500, $1,500 and 1500.00 are one token. An
answer agrees if it has every number of the expected one, and a local alignment of the two, which may skip and change
words, matches at least SHARE of the expected tokens.

Defined cases: an expected answer without a token can't be judged, and the verdict says so; a null or empty given answer
disagrees.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SHARE = 0.8
#: Scores of a match, a change and a skipped word in an alignment.
MATCH, CHANGE, SKIP = 2, -1, -1
UNDECIDED = "the expected answer has nothing to compare"
_TOKEN = re.compile(r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?|[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    """Words in lower case, and numbers without signs of grouping, leading zeros and zeros after the point."""
    found = []
    for t in _TOKEN.findall((text or "").lower()):
        if t[0].isdecimal():
            whole, _, part = t.replace(",", "").partition(".")
            part = part.rstrip("0")
            t = (whole.lstrip("0") or "0") + (f".{part}" if part else "")
        found.append(t)
    return found


def aligned(expected: Sequence[str], given: Sequence[str]) -> int:
    """How many tokens match in a best local alignment; of several with one score, the one that matches most."""
    if not expected or not given:
        return 0
    names = {t: i for i, t in enumerate(dict.fromkeys([*expected, *given]))}
    b = np.array([names[t] for t in given])
    # A row for each expected token; a cell is score * size + matches, so the larger one is better in both.
    size = len(expected) + 1
    row, best = np.zeros(len(b) + 1, np.int64), 0
    steps = np.arange(len(b) + 1) * SKIP * size
    for t in expected:
        step = np.where(b == names[t], MATCH * size + 1, CHANGE * size)
        new = np.maximum(np.concatenate([[0], row[:-1] + step]), np.maximum(row + SKIP * size, 0))
        # Skips along the row: a running maximum once each cell's own skips are taken off.
        new = np.maximum(np.maximum.accumulate(new - steps) + steps, 0)
        best, row = max(best, int(new.max())), new
    return best % size


def agreement(expected: str | None, given: str | None, share: float = SHARE) -> str:
    """"true", "false", or why there is no verdict."""
    want, got = tokens(expected), tokens(given)
    if not want:
        return UNDECIDED
    if not {t for t in want if t[0].isdecimal()} <= set(got):
        return "false"
    return "true" if aligned(want, got) >= share * len(want) - 1e-9 else "false"


def agreement_column(expected: Column, given: Column, share: float = SHARE) -> Column:
    @F.pandas_udf("string")
    def judge(wanted: pd.Series, answers: pd.Series) -> pd.Series:
        return pd.Series([agreement(a, b, share) for a, b in zip(wanted, answers)], dtype=object)

    return judge(expected, given)
