"""Mixing sources to target weights by temperature, in DataFrame functions only.

A source with share p of all tokens gets the weight p**a, normalised. The exponent a between 0 (equal weights)
and 1 (as they come) is found by bisection: the largest for which no source is repeated more than a limit, or
the one whose weights have a wanted entropy. The budget is the least at which every source is read through at
least once, or a given number of tokens.

Weights become passes over a source: whole passes, and a part of one more. Documents are dealt by hash into
blocks of about BLOCK documents of one source, each block in an order of its own (a hashed permutation); the
partial pass takes from every block the first documents of that order that fill the block's part of the budget.
So no task sees more than a block, however large its source, and the budget is met to half a document a block.

Defined cases: a null source is a source of its own. Sources without tokens get no weight, and their documents
one copy each. Null ids and repeated rows are dealt like others; equal rows are interchangeable. An empty table
stays empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.llm.rows import pack, unpack
from loomwork.session import saved, scratch

MAX_REPEATS, BLOCK, SEED = 2.0, 512, 17
#: Passes this close to a whole number are that number: products of shares may round to just below it.
WHOLE = 1e-9
#: Bisection: halvings evaluated by one job, jobs.
HALVINGS, JOBS = 4, 7
#: Sources whose weights are broadcast to the documents, at most; with more, each source's documents are dealt to
#: SALT copies of its weights, so that none of its joins has all of a large source.
BROADCAST_SOURCES, SALT = 50_000, 64


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_shares(docs: DataFrame) -> DataFrame:
    """(source, tokens, n, share) for each source, null included."""
    by = docs.groupBy("source").agg(F.sum("lw_tokens").alias("tokens"), F.count("*").alias("n"))
    by = saved(by, f"{scratch(docs.sparkSession, 'mixing')}/sources")
    total = by.agg(F.sum("tokens")).first()[0] or 1
    return by.withColumn("share", F.col("tokens") / F.lit(total))


def find_exponent(shares: DataFrame, *, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None) -> float:
    """The exponent that meets the limit, or whose weights have the entropy (a share of the highest, 0 to 1).

    Every job tests all midpoints that HALVINGS steps of bisection can reach, over the table of sources.
    """
    some = shares.where("share > 0")
    low, high = 0.0, 1.0
    p, log_p = F.col("share"), F.log("share")

    def values(points: list[float]) -> list[tuple[float, float]]:
        aggregates = [F.count("*")]
        for a in points:
            w = F.pow(p, F.lit(a))
            aggregates += [F.sum(w), F.sum(w * log_p), F.max(w / p) / F.min(w / p)]
        row = some.agg(*aggregates).first()
        n, out = row[0], []
        for i, a in enumerate(points):
            z, s, spread = row[1 + 3 * i : 4 + 3 * i]
            if not n:
                return []
            out.append(((math.log(z) - a * s / z) / math.log(n) if n > 1 else 1.0, spread))
        return out

    def flatter(told: tuple[float, float]) -> bool:
        """Whether an exponent lies on the flat side of what is wanted, so that a larger one may do."""
        return told[0] > entropy if entropy is not None else told[1] > max_repeats

    ends = values([0.0, 1.0])
    if not ends or (not flatter(ends[0]) and entropy is None) or (entropy is not None and not flatter(ends[0])):
        return 0.0  # equal weights already keep to the limit, or nothing is as even as wanted
    if flatter(ends[1]):
        return 1.0
    for _ in range(JOBS):
        step = (high - low) / (1 << HALVINGS)
        points = [low + i * step for i in range(1, 1 << HALVINGS)]
        told = dict(zip(points, values(points)))
        a, b = 0, 1 << HALVINGS
        while b - a > 1:
            middle = (a + b) // 2
            a, b = (middle, b) if flatter(told[points[middle - 1]]) else (a, middle)
        low, high = low + a * step, low + b * step
    return high


def source_passes(shares: DataFrame, exponent: float, budget: float | None = None) -> DataFrame:
    """shares with weight (normalised) and passes: how often each source is read at the budget."""
    raw = F.when(F.col("share") > 0, F.pow("share", F.lit(exponent)))
    z, least = shares.agg(F.sum(raw), F.max(F.col("tokens") / raw)).first()
    weighted = shares.withColumn("weight", raw / F.lit(z or 1.0))
    tokens = (least or 0.0) * (z or 1.0) if budget is None else float(budget)
    passes = F.col("weight") * F.lit(tokens) / F.col("tokens")
    passes = F.when(F.abs(passes - F.round(passes)) <= WHOLE, F.round(passes)).otherwise(passes)
    return weighted.withColumn("passes", F.when(F.col("tokens") > 0, passes))


def with_copies(docs: DataFrame, *, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, budget: float | None = None, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """docs with lw_tokens, lw_weight, lw_block, lw_place (in the block's permutation) and lw_copies."""
    counted = docs.withColumn("lw_tokens", count_words(F.col("text")))
    shares = source_shares(counted)
    exponent = find_exponent(shares, max_repeats=max_repeats, entropy=entropy)
    passes = source_passes(shares, exponent, budget)
    known = passes.select(
        F.col("source").alias("lw_source"),
        F.col("weight").alias("lw_weight"),
        F.col("passes").alias("lw_passes"),
        F.ceil(F.col("n") / block).alias("lw_blocks"),
    )
    counted = counted.withColumn("lw_order", F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text")))
    same = F.col("source").eqNullSafe(F.col("lw_source"))
    if shares.count() <= BROADCAST_SOURCES:
        joined = counted.join(F.broadcast(known), same)
    else:
        copied = known.withColumn("lw_copy_of", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        salted = counted.withColumn("lw_salt", F.pmod("lw_order", F.lit(SALT)).cast("int"))
        joined = salted.join(copied, (F.col("lw_salt") == F.col("lw_copy_of")) & same).drop("lw_salt", "lw_copy_of")
    joined = joined.withColumn("lw_block", F.pmod(F.xxhash64("lw_order"), F.col("lw_blocks")))
    each = Window.partitionBy("lw_source", "lw_block")
    order = each.orderBy("lw_order", "doc_id")  # lw_order has the text's hash
    before = F.sum("lw_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("lw_tokens") / 2
    part = F.col("lw_passes") - F.floor("lw_passes")
    extra = (before < part * F.sum("lw_tokens").over(each)) & (part > WHOLE)
    copies = F.when(F.col("lw_passes").isNull(), F.lit(1)).otherwise(F.floor("lw_passes") + extra.cast("long")).cast("int")
    placed = joined.withColumns({"lw_place": F.row_number().over(order), "lw_copies": copies})
    return placed.drop("lw_source", "lw_passes", "lw_blocks", "lw_order")


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixture: every document as often as it has copies, with the columns of docs."""
    names = ("doc_id", "text", "source")
    times = with_copies(pack(docs, *names), **settings).where("lw_copies > 0").withColumn("lw_copy", F.explode(F.sequence(F.lit(1), F.col("lw_copies"))))
    return unpack(times, docs, names)


def mixing_report(docs: DataFrame) -> DataFrame:
    """One row per document: source, tokens, the source's weight, block, place in its permutation, and copies."""
    dealt = with_copies(docs.select("doc_id", "text", "source"))
    return dealt.select("doc_id", "source", *(F.col(f"lw_{c}").alias(f"{c}" if c != "tokens" else "n_tokens") for c in ("tokens", "weight", "block", "place", "copies")))
