"""From ranked hits to context, prompt, sources and answers.

Hits are rows (query_id, rank, id, text), a few for each query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\n\n---\n\n"
NOTHING_FOUND = "Nothing in the indexed documents matches this question."
UNKNOWN = "unknown"


def _ranked(column: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct("rank", column)))
    return F.transform(rows, lambda x: x[column])


def contexts(hits: DataFrame) -> DataFrame:
    """(query_id, context): the texts of the hits in rank order, with a rule between them."""
    return hits.groupBy("query_id").agg(F.array_join(_ranked("text"), SEPARATOR).alias("context"))


def source_lists(hits: DataFrame) -> DataFrame:
    """(query_id, sources): the ids of the hits in rank order, repeats kept."""
    return hits.groupBy("query_id").agg(F.transform(_ranked("id"), lambda x: F.coalesce(x.cast("string"), F.lit(UNKNOWN))).alias("sources"))


def prompt(context: Column, question: Column) -> Column:
    """The prompt text; built by joining, so neither part is read as a pattern or a slot."""
    return F.concat(
        F.lit("Use only the passages below to answer.\n\n"), context, F.lit("\n\n---\n\nWith these passages alone, answer this question: "), question, F.lit("\n")
    )


def assembled(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, question, texts, sources, prompt) of every question(query_id, question); without hits, empty arrays and no prompt."""
    found = hits.groupBy("query_id").agg(_ranked("text").alias("texts"), F.transform(_ranked("id"), lambda x: F.coalesce(x.cast("string"), F.lit(UNKNOWN))).alias("sources"))
    none = F.array().cast("array<string>")
    joined = questions.join(found, "query_id", "left").withColumns({"texts": F.coalesce("texts", none), "sources": F.coalesce("sources", none)})
    return joined.withColumn("prompt", F.when(F.size("texts") > 0, prompt(F.array_join("texts", SEPARATOR), F.col("question"))))
