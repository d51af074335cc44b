"""Language identification by a byte convolutional network in numpy.

A text's UTF-8 bytes are cut into windows of a fixed length, the last one padded. Filters of several widths
slide over a window's bytes, each filter is pooled by its maximum, and a softmax over the pooled filters gives
the window's languages. A text's languages are the mean of its windows', weighted by their bytes; all windows
of the whole text count.

Fitting uses a bounded sample: SAMPLE_DOCS documents at most, and of all windows of their whole texts
SAMPLE_WINDOWS at most, both spread evenly over the languages. Everything else, prediction included, has no bound.

Defined cases: a null text, or one without a letter, is `und` with score 0. Without a single labelled document
every text is `und`. A null id is never held out and never learned from. Of languages that tie, the first by name
is told; rows that repeat are told alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
SAMPLE_DOCS, SAMPLE_WINDOWS, EPOCHS, BATCH, RATE, SEED = 2_000, 16_000, 4, 32, 0.01, 11
#: Hash values that the sample is cut from; languages whose counts are broadcast, at most.
SPAN, BROADCAST_LANGUAGES = 1 << 40, 10_000
#: Windows evaluated at once in a task, and bytes of texts that are cut into windows at once (one text at least).
CHUNK, SLICE_BYTES = 2_048, 4 << 20


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, text, bytes) of all windows: a row of bytes, the text it is of, and how many bytes aren't padding."""
    n = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    raw = b"".join(t.ljust(k * WINDOW, b"\0") for t, k in zip(texts, n.tolist()))
    owner = np.repeat(np.arange(len(texts)), n)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(WINDOW, np.array([len(t) for t in texts], np.int64)[owner] - within * WINDOW)
    return np.frombuffer(raw, np.uint8).reshape(-1, WINDOW), owner, size


def slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    """texts in order, in lists of about SLICE_BYTES."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > SLICE_BYTES:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class ByteNet:
    """filters[w][k] is a (256, FILTERS) table: what byte k of a place adds to each filter of width w."""

    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.filters = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.filters, self.bias, self.out, self.out_bias]

    def fit(self, pieces: np.ndarray, wanted: np.ndarray, *, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE) -> ByteNet:
        """Cross-entropy by Adam over shuffled batches of windows."""
        rng = np.random.default_rng(SEED)
        params = self.parameters()
        mean, square, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(pieces))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                step += 1
                for p, g, m, s in zip(params, self._gradients(pieces[rows], wanted[rows]), mean, square):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-7)
        return self

    def _gradients(self, x: np.ndarray, wanted: np.ndarray) -> list[np.ndarray]:
        pooled, best = [], []
        for w, table, bias in zip(WIDTHS, self.filters, self.bias):
            z = sum(table[k][x[:, k : WINDOW - w + 1 + k]] for k in range(w))
            top = z.argmax(1)
            best.append(top)
            pooled.append(np.take_along_axis(z, top[:, None], 1)[:, 0] + bias)
        raw = np.concatenate(pooled, 1)
        hidden = np.maximum(raw, 0)
        error = softmax(hidden @ self.out + self.out_bias)
        error[np.arange(len(x)), wanted] -= 1
        error /= len(x)
        back = (error @ self.out.T) * (raw > 0)
        found = []
        for n, (w, top) in enumerate(zip(WIDTHS, best)):
            part, g = back[:, n * FILTERS : (n + 1) * FILTERS], np.zeros_like(self.filters[n])
            for k in range(w):
                np.add.at(g[k], (np.take_along_axis(x, top + k, 1), np.arange(FILTERS)[None]), part)
            found.append(g)
        return [*found, back.sum(0).reshape(len(WIDTHS), FILTERS), hidden.T @ error, error.sum(0)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(windows, languages) probabilities. Filters read two bytes at a time from tables over byte pairs."""
        pair = x[:, :-1].astype(np.uint16) << 8 | x[:, 1:]
        if not hasattr(self, "tables"):
            self.tables = [[(t[k][:, None] + t[k + 1][None]).reshape(65536, FILTERS) for k in range(0, w - 1, 2)] for w, t in zip(WIDTHS, self.filters)]
        pooled = []
        for w, table, pairs, bias in zip(WIDTHS, self.filters, self.tables, self.bias):
            n = WINDOW - w + 1
            z = pairs[0][pair[:, :n]]
            for i, more in enumerate(pairs[1:], 1):
                z += more[pair[:, 2 * i : 2 * i + n]]
            if w % 2:
                z += table[w - 1][x[:, w - 1 :]]
            pooled.append(z.max(1) + bias)
        return softmax(np.maximum(np.concatenate(pooled, 1), 0) @ self.out + self.out_bias)

    def languages_of(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages) mean probabilities; zeros for an empty text."""
        x, owner, size = windows_of(texts)
        total, weight = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for at in range(0, len(x), CHUNK):
            part = slice(at, at + CHUNK)
            np.add.at(total, owner[part], self.predict(x[part]) * size[part, None])
            np.add.at(weight, owner[part], size[part])
        return total / np.maximum(weight, 1)[:, None]


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_windows(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS) -> DataFrame:
    """(lang, window) of labelled documents that aren't held out: windows of bytes from anywhere in their whole texts.

    The sample takes the documents, and then the windows, of least hash for each language. Counts by language give
    a bound on the hash that few more pass, so what is shuffled and ranked is about twice the sample, whatever the
    input.
    """
    doc = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    counts = doc.groupBy("lang").agg(F.count("*").alias("n"))
    languages = max(1, counts.count())
    most = max(1, sample_docs // languages)
    # About twice the wanted documents of each language have a hash this low; the rank then makes it exact.
    counts = counts.select("lang", (F.lit(2.0 * most + 20) / F.col("n") * SPAN).cast("long").alias("bound"))
    counts = F.broadcast(counts) if languages <= BROADCAST_LANGUAGES else counts
    hashed = doc.select("lang", F.xxhash64("doc_id").alias("h"), F.col("text").cast("binary").alias("raw")).join(counts, "lang").where(F.pmod("h", F.lit(SPAN)) < F.col("bound"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(SPAN)), "raw"))
    some = hashed.withColumn("rank", rank).where(F.col("rank") <= most)
    place = F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("raw") - 1) / WINDOW).cast("int"))).alias("place")
    windows = some.select("lang", "h", "rank", "raw", place).select("lang", F.xxhash64("h", "rank", "place").alias("h"), F.substring("raw", F.col("place") * WINDOW + 1, F.lit(WINDOW)).alias("window"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy("h", "window"))
    return windows.withColumn("rank", order).where(F.col("rank") <= max(1, sample_windows // languages)).select("lang", "rank", "window")


def train(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS) -> ByteNet | None:
    """A network fitted on the training windows; None if there are none."""
    rows = training_windows(docs, sample_docs, sample_windows).orderBy("lang", "rank").collect()
    if not rows:
        return None
    names = sorted({r.lang for r in rows})
    return ByteNet(names).fit(windows_of([bytes(r.window) for r in rows])[0], np.array([names.index(r.lang) for r in rows]))


def predict_column(spark, text: Column, net: ByteNet) -> Column:
    """A struct (lang, score) of the whole of each text; the network is small, its size fixed by the settings."""
    sent = spark.sparkContext.broadcast(net)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net = sent.value
        for texts in batches:
            found = [net.languages_of(part) for part in slices([(t or "").encode() for t in texts])]
            p = np.concatenate(found) if found else np.zeros((0, len(net.languages)))
            best = p.argmax(1)
            yield pd.DataFrame({"lang": [net.languages[i] for i in best], "score": np.minimum(1.0, p[np.arange(len(p)), best])})

    return predict(text)


def language_report(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    net = train(docs)
    held = is_held_out(F.col("doc_id")).alias("held_out")
    if net is None:
        return docs.select("doc_id", held, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    told = docs.select("doc_id", held, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"), predict_column(docs.sparkSession, F.col("text"), net).alias("p"))
    return told.select("doc_id", "held_out", F.when(F.col("lettered"), F.col("p.lang")).otherwise("und").alias("lang_pred"), F.when(F.col("lettered"), F.col("p.score")).otherwise(0.0).alias("score"))
