"""Column functions over text: guards, verdicts, and term buckets."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Buckets of terms; texts taken at once in a task; terms whose bucket a worker keeps.
BUCKETS, SLICE, KEPT = 256, 512, 100_000
_TERM = re.compile(r"[^\W_]+")


def is_blank(text: Column) -> Column:
    """True for null and for text of white space only, the separators U+001C to U+001F included."""
    return F.coalesce(F.regexp_replace(text, r"(?U)[\s\x1C-\x1F]", "") == "", F.lit(True))


def is_pdf_name(name: Column) -> Column:
    """Whether a file name ends in .pdf, in exactly this case."""
    return F.coalesce(name.endswith(".pdf"), F.lit(False))


def verdict(text: Column) -> Column:
    """A judge's answer as boolean: true if it says true, else false if it says false, else an error."""
    said = F.lower(text)
    bad = F.raise_error(F.concat(F.lit("neither true nor false: "), F.coalesce(text, F.lit("null")))).cast("boolean")
    return F.when(F.contains(said, F.lit("true")), True).when(F.contains(said, F.lit("false")), False).otherwise(bad)


def verdict_or_error(text: Column) -> Column:
    """struct(passed, error): as verdict, but what is neither is an error text and no verdict."""
    said = F.lower(text)
    passed = F.when(F.contains(said, F.lit("true")), True).when(F.contains(said, F.lit("false")), False)
    error = F.when(passed.isNull(), F.concat(F.lit("neither true nor false: "), F.coalesce(text, F.lit("null"))))
    return F.struct(passed.alias("passed"), error.alias("error"))


def term_bucket(term: str) -> int:
    return int(hashlib.md5(term.encode()).hexdigest()[:6], 16) % BUCKETS


class _Buckets(dict):
    def __missing__(self, term: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        self[term] = found = term_bucket(term)
        return found


_BUCKET_OF = _Buckets()


def term_counts(text: str | None) -> np.ndarray:
    """How often terms (runs of letters and digits, in lower case) fall in each bucket."""
    found = [_BUCKET_OF[t] for t in _TERM.findall((text or "").lower())]
    return np.bincount(np.array(found, np.int64), minlength=BUCKETS)


def term_matrix(texts: Iterable[str | None]) -> np.ndarray:
    """(texts, BUCKETS) term counts."""
    return np.array([term_counts(t) for t in texts], float).reshape(-1, BUCKETS)


def term_counts_column(text: Column) -> Column:
    @F.arrow_udf("array<int>")
    def counts(texts: pa.Array) -> pa.Array:
        found = np.zeros((len(texts), BUCKETS), np.int32)
        for at in range(0, len(texts), SLICE):
            for row, text in enumerate(texts.slice(at, SLICE).to_pylist(), at):
                found[row] = term_counts(text)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BUCKETS), pa.array(found.ravel()))

    return counts(text)
