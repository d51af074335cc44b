"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule asks for measures of a whole text, and a measure is only computed when a rule that is reached asks for it:
the rules stand in a CASE chain, so a rule is only evaluated for documents that all rules before it let pass. The
order of the chain comes from a sample: each rule's cost is timed, its share of rejections counted, and rules that
reject most per unit of cost go first. The order changes cost only, never the verdict, which is the conjunction of
all rules, the base rules (few words, repeated words) among them.

The report has the measures of every document as columns, so there only the rules that ask for more are saved; a
filter (keep_good) has none of them, and there the cascade spares all measures that aren't reached.

Defined cases: a null or blank text has zero words, zero measures, and fails the base rule. Null ids and
repeated rows are kept as rows of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.rows import pack, unpack

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: The random sample that orders the rules: rows at most, share of all rows, seed. It only sets the order.
SAMPLE_ROWS, SAMPLE_SHARE, SAMPLE_SEED = 500, 0.05, 7
#: Evaluations of a rule for each row of the sample, so that they outweigh the time that any job takes.
EVALUATIONS = 8
#: Base rule: fewer words than this, or a larger share of words in repeated 3-word windows.
MIN_WORDS, MAX_REPEATED = 50, 0.5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window which occurs twice or more in the array.

    Windows are compared by a 64-bit hash within one document: sorting (hash, place) puts equal windows
    side by side, in n log n steps however often a window repeats.
    """

    def covered(places: Column) -> Column:
        gap = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
        return F.aggregate(gap, F.lit(0).cast("long"), lambda a, x: a + x)

    def places(sorted_: Column) -> Column:
        same = lambda x, i: F.coalesce(x["h"] == F.get(sorted_, i)["h"], F.lit(False))
        kept = F.filter(sorted_, lambda x, i: same(x, i + 1) | (same(x, i - 1) & (i > 0)))
        return F.sort_array(F.transform(kept, lambda x: x["i"]))

    def over(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(let(pairs, places), covered)
        )

    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    hashes = F.transform(starts, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return let(hashes, over)


class Measures:
    """Measures of a text by name, each an expression that is evaluated where it is asked for."""

    def __init__(self, text: Column, words: Column):
        self.text, self.words = text, words

    def _lines(self) -> Column:
        return F.filter(F.split(self.text, "\n"), lambda x: x.rlike(WORD))

    def __getitem__(self, name: str) -> Column:
        made = {
            "n_words": lambda: F.size(self.words),
            "word_chars": lambda: F.length(F.array_join(self.words, "")),
            "n_symbols": lambda: F.length(self.text) - F.length(F.regexp_replace(self.text, SYMBOLS, "")),
            "n_lines": lambda: F.size(self._lines()),
            "n_dup_lines": lambda: let(self._lines(), lambda kept: F.size(kept) - F.size(F.array_distinct(kept))),
            "n_repeat_words": lambda: repeated_words(self.words),
        }
        return made[name]().cast("long")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def with_words(text: Column, body: Callable[[Column, Column], Column]) -> Column:
    """body(text, words) of a text, null standing for the empty one; its words are split once."""
    return let(F.coalesce(text, F.lit("")), lambda t: let(F.array_remove(F.split(t, SPACE), ""), lambda words: body(t, words)))


def measures(text: Column) -> Column:
    """A struct of all MEASURES of a text."""
    return with_words(text, lambda t, words: F.struct(*(Measures(t, words)[k].alias(k) for k in MEASURES)))


@dataclass(frozen=True)
class Rule:
    """name, and rejects(measures, text): a boolean column that is never null; measures are asked for by name."""

    name: str
    rejects: Callable[[Measures | Column, Column], Column]


def base_rules() -> list[Rule]:
    return [
        Rule("few_words", lambda m, t: m["n_words"] < MIN_WORDS),
        Rule("repeated_words", lambda m, t: m["n_repeat_words"] > MAX_REPEATED * m["n_words"]),
    ]


def default_rules() -> list[Rule]:
    """Symbols, shouting and boilerplate; thresholds leave ordinary prose of any alphabet alone."""
    return [
        Rule("symbols", lambda m, t: m["n_symbols"] > 0.1 * m["n_words"]),
        Rule("repeated_lines", lambda m, t: m["n_dup_lines"] > 0.5 * m["n_lines"]),
        Rule("word_length", lambda m, t: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
        Rule("exclamations", lambda m, t: F.regexp_count(t, F.lit("!")) > 0.3 * m["n_words"]),
        Rule("capitals", lambda m, t: F.regexp_count(t, F.lit(r"\p{Lu}{2,}")) > 0.6 * m["n_words"]),
    ]


def base_failed(m: Measures | Column) -> Column:
    few, repeated = (r.rejects(m, F.lit("")) for r in base_rules())
    return few | repeated


def _facts(sample: DataFrame, measured: bool) -> tuple[Measures | Column, Column]:
    return (sample["m"] if measured else Measures(sample["t"], sample["w"])), sample["t"]


def order_rules(docs: DataFrame, rules: list[Rule], *, measured: bool = False, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per cost, both found on at most sample_rows rows.

    Cost is the time of EVALUATIONS of the rule for each row beyond those of a constant; with measured, measures are
    at hand already and don't count. A rule that rejects nothing goes last. With an empty sample the order stays.
    """
    text = docs.select(F.coalesce("text", F.lit("")).alias("t")).sample(SAMPLE_SHARE, SAMPLE_SEED).limit(sample_rows)
    sample = text.withColumn("w", F.array_remove(F.split("t", SPACE), ""))
    sample = (sample.withColumn("m", measures(F.col("t"))) if measured else sample).persist()
    try:
        facts = _facts(sample, measured)
        row = sample.agg(F.count("*").alias("n"), *(F.avg(r.rejects(*facts).cast("double")).alias(r.name) for r in rules)).first()
        if not row["n"]:
            return list(rules)

        def seconds(value: Column) -> float:
            again = F.aggregate(F.sequence(F.lit(1), F.lit(EVALUATIONS)), F.lit(0), lambda a, i: a + value.cast("int"))
            began = time.perf_counter()
            sample.agg(F.sum(again)).first()
            return time.perf_counter() - began

        idle = min(seconds(F.col("t").isNull()) for _ in range(2))
        cost = {r.name: max(1e-4, seconds(r.rejects(*facts)) - idle) for r in rules}
    finally:
        sample.unpersist()
    return sorted(rules, key=lambda r: -row[r.name] / cost[r.name])


def first_rejection(m: Measures | Column, text: Column, rules: list[Rule]) -> Column:
    """Name of the first rule of the cascade that rejects, else null; later rules are then not evaluated."""
    chain = F.when(F.lit(False), F.lit(""))
    for rule in rules:
        chain = chain.when(rule.rejects(m, text), F.lit(rule.name))
    return chain


def judge(docs: DataFrame, rules: list[Rule] | None = None, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with two more columns: lw_measures (a struct) and lw_rejected_by (a rule's name, or null if kept).

    Which of several rejecting rules is named depends on the measured order; whether one is named doesn't.
    """
    ordered = base_rules() + order_rules(docs, rules or default_rules(), measured=True, sample_rows=sample_rows)
    judged = docs.withColumn("lw_measures", measures(F.col("text")))
    return judged.withColumn("lw_rejected_by", first_rejection(F.col("lw_measures"), F.coalesce("text", F.lit("")), ordered))


def keep_good(docs: DataFrame, rules: list[Rule] | None = None, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, with the columns of docs; measures that aren't reached aren't computed."""
    packed = pack(docs, "text")
    ordered = order_rules(packed, base_rules() + (rules or default_rules()), sample_rows=sample_rows)
    verdict = with_words(F.col("text"), lambda t, words: first_rejection(Measures(t, words), t, ordered))
    return unpack(packed.where(verdict.isNull()), docs, ("text",))


def quality_report(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    m = F.col("lw_measures")
    return judge(docs.select("doc_id", "text")).select(
        "doc_id",
        *(m[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        base_failed(m).alias("base_failed"),
        F.col("lw_rejected_by").isNull().alias("kept"),
    )
