"""Near copies by five-word shingles, one document kept of each group: SimHash first, an exact join for the rest.

Each distinct text gets a SimHash fingerprint of its shingles, and the Golay-code search of simhash.py finds the
fingerprints within 3 bits of each other. Fingerprints alone miss about half of the pairs at a similarity of 0.8, so
what they leave in different groups is searched by an exact set-similarity join: shingles have one order over the
table: by the number of texts that have a shingle of the same bucket (BUCKETS of them, all texts counted), then by hash,
so that shingles of passages that many texts share come last. Two sets with a similarity of SIMILARITY or more share a shingle among the first n - ceil(SIMILARITY n) + 1 of each (prefix filter),
so these are the keys, and no pair is missed. Lengths and the places of a shared key bound the overlap and drop
most other pairs.

A link counts if the two shingle sets have a similarity of at least SIMILARITY, computed exactly; links make
groups. Links are tried in an order that spares all pairs of a group:

1. each fingerprint with the least one near it, and equal fingerprints with one of theirs;
2. the texts of a key with its hub, the text whose keys are shared most, if they are in different groups: copies of
   one original share its keys, but not each other's edits;
3. all texts of a key that are still in different groups with each other, so the groups are exact.

A hub's many partners are dealt out in parts of PART. Equal texts are collapsed before all this. Aggregates by a key are
written before they are joined back to its rows, so that adaptive execution can split a key that very many texts have.

Defined cases: rows with a null id are kept. A null text, and one without a word, is kept unless it is equal to
another. Rows that share an id stay or go together, and each of their texts is compared; of rows with equal id and
text one stays.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.llm.components import connected_components
from loomwork.llm.simhash import SEED, majority, near_prints, shingles
from loomwork.session import broadcast_if_small, drop, saved, scratch, tidy_shuffles

WIDTH, SIMILARITY = 5, 0.8
#: Partners of a hub in a part; keys before one that tell whether two texts have met already.
PART, BEFORE = 1_000, 8
#: Buckets of shingle hashes that texts are counted in, a power of two, and the stripes that they are added up in.
BUCKETS, STRIPES = 1 << 21, 32
#: Texts handled at once in a task.
SLICE = 1_000
#: Ids of repeats that are broadcast, at most: eight bytes each.
BROADCAST_IDS = 1_000_000
#: Slack for products of similarities and counts.
EPSILON = 1e-9


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """The hashes of a text's shingles, with repeats."""
    parts = shingles(text, width)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(p, SEED) for p in parts), np.uint64, len(parts))


def jaccard(a: set[bytes], b: set[bytes]) -> float:
    return len(a & b) / len(a | b) if a or b else 0.0


def shingle_counts(texts: DataFrame, width: int) -> np.ndarray:
    """How many texts (node, text) have a shingle of each of BUCKETS buckets of hashes, counted over all texts.

    Tasks send their counts in STRIPES, so that no task adds up all buckets of many others.
    """
    size = BUCKETS // STRIPES

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(BUCKETS, np.int64)
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            for text in batch.column("text").to_pylist():
                np.add.at(found, bucket(np.unique(shingle_hashes(text or "", width))), 1)
        for i in range(STRIPES):
            part = found[i * size : (i + 1) * size]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["stripe", "counts"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column("stripe").to_pylist(), batch.column("counts").to_pylist()):
                found[i] = found.get(i, 0) + np.frombuffer(zlib.decompress(part), np.int64)
        for i, part in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["stripe", "counts"])

    schema, counts = "stripe int, counts binary", np.zeros(BUCKETS, np.int64)
    for r in texts.select("text").mapInArrow(rows, schema).repartition(STRIPES, "stripe").mapInArrow(add_up, schema).collect():  # STRIPES rows
        counts[r.stripe * size : (r.stripe + 1) * size] = np.frombuffer(zlib.decompress(bytes(r.counts)), np.int64)
    return counts


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def shingle_sets(texts: DataFrame, counts: np.ndarray, width: int, similarity: float) -> DataFrame:
    """(node, n, print, keys) of texts (node, text) with a word: number of shingles, fingerprint, and prefix keys in order."""
    sent = texts.sparkSession.sparkContext.broadcast(counts)  # BUCKETS numbers

    def prefix(h: np.ndarray) -> np.ndarray:
        h = h[np.argsort(sent.value[bucket(h)], kind="stable")]
        return h[: len(h) - ceil(similarity * len(h) - EPSILON) + 1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                nodes, sizes, prints, keys = [], [], [], [np.zeros(0, np.uint64)]
                for node, text in zip(*(whole.slice(at, SLICE).column(c).to_pylist() for c in ("node", "text"))):
                    h = shingle_hashes(text or "", width)
                    if len(h):
                        once = np.unique(h)
                        nodes.append(node)
                        sizes.append(len(once))
                        prints.append(majority(h))
                        keys.append(prefix(once))
                ends = np.cumsum([len(k) for k in keys]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view("<i8")))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), lists], ["node", "n", "print", "keys"])

    return texts.select("node", "text").mapInArrow(rows, "node long, n int, print long, keys array<long>")


def print_links(sets: DataFrame, folder: str) -> DataFrame:
    """(a, b) of each text and one other of an equal fingerprint, or of the least one within 3 bits."""
    prints = saved(sets.groupBy("print").agg(F.min("node").alias("b")), f"{folder}/prints")
    same = sets.join(prints, "print").where("node != b").select(F.col("node").alias("a"), "b")
    least = near_prints(prints).groupBy(F.col("b").alias("print")).agg(F.min("a").alias("near"))
    near = least.join(prints, "print").withColumnRenamed("b", "a").join(prints.withColumnRenamed("print", "near"), "near")
    return same.union(near.select("a", "b"))


def least_overlap(n: Column, m: Column, similarity: float) -> Column:
    """Shingles that sets of n and m must share to be similar enough."""
    return F.ceil((n + m) * F.lit(similarity / (1 + similarity)) - F.lit(EPSILON))


def most_overlap(n: Column, place: Column, m: Column, other: Column) -> Column:
    """Shingles that sets of n and m can share if one that both have stands at these places of their common order."""
    return F.least(place, other) + F.least(n - place, m - other)


def shared_keys(sets: DataFrame, folder: str) -> DataFrame:
    """(key, node, n, place, texts) of the prefix keys that several texts have."""
    keys = sets.select("node", "n", F.posexplode("keys").alias("place", "key"))
    return keys.join(saved(keys.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1"), f"{folder}/shared"), "key")


def node_facts(keys: DataFrame, similarity: float) -> DataFrame:
    """(node, score) of each text: how often its keys are shared, on average."""
    length = F.col("n") - F.ceil(F.col("n") * F.lit(similarity) - F.lit(EPSILON)) + 1
    return keys.groupBy("node").agg((F.sum("texts") / F.max(length)).alias("score"))


def open_keys(keys: DataFrame, links: DataFrame, folder: str) -> DataFrame:
    """keys (key, node, ...) with the text's group as root, only of those keys whose texts are in several groups."""
    groups = connected_components(links, "a", "b").withColumnRenamed("node", "linked")
    rooted = keys.join(groups, F.col("node") == F.col("linked"), "left").drop("linked").withColumn("root", F.coalesce("root", "node"))
    rooted = saved(rooted, f"{folder}/rooted")
    several = saved(rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key"), f"{folder}/several")
    return rooted.join(several, "key", "left_semi")


def hub_links(keys: DataFrame, similarity: float, folder: str) -> DataFrame:
    """(a, b) of the texts of each key with its hub b in another group, if their overlap can be large enough."""
    hubs = keys.groupBy("key").agg(F.max(F.struct("score", "node", "n", "place", "root")).alias("hub"))
    hubs = hubs.select(F.col("key").alias("hub_key"), *(F.col(f"hub.{c}").alias(d) for c, d in (("node", "b"), ("n", "b_n"), ("place", "b_place"), ("root", "b_root"))))
    hubs = saved(hubs, f"{folder}/hubs")
    enough = most_overlap(F.col("n"), F.col("place"), F.col("b_n"), F.col("b_place")) >= least_overlap(F.col("n"), F.col("b_n"), similarity)
    return keys.join(hubs, (F.col("key") == F.col("hub_key")) & (F.col("root") != F.col("b_root")) & enough).select(F.col("node").alias("a"), "b").distinct()


def rest_links(keys: DataFrame, similarity: float, folder: str) -> DataFrame:
    """(a, b) of all texts of a key in different groups, if their overlap can be large enough.

    Two texts meet once, not once for each key that they share: not at a key if they share one of the BEFORE keys that
    stand before it, which is never so at the first. There, what follows in both bounds the overlap. Past the key
    prefixes, two texts share no more than one of them has left, so for the pairs that met the count of all shared keys
    is a closer bound.
    """
    before = F.collect_list("key").over(Window.partitionBy("node").orderBy("place").rowsBetween(-BEFORE, -1))
    keys = saved(keys.select("key", "node", "n", "place", "root", before.alias("before")), f"{folder}/before")
    right = keys.select(*(F.col(c).alias(f"b_{c}") for c in ("key", "node", "n", "place", "root", "before")))
    need = least_overlap(F.col("n"), F.col("b_n"), similarity)
    reach = F.least(F.col("n") - F.col("place"), F.col("b_n") - F.col("b_place")) >= need
    met = (F.col("key") == F.col("b_key")) & (F.col("node") < F.col("b_node")) & (F.col("root") != F.col("b_root")) & reach & ~F.arrays_overlap("before", "b_before")
    pairs = saved(keys.join(right, met).select(F.col("node").alias("a"), F.col("b_node").alias("b"), "n", "b_n").distinct(), f"{folder}/met")
    own = saved(keys.groupBy("node").agg(F.collect_list("key").alias("own")), f"{folder}/own")
    beyond = F.ceil(F.greatest("n", "b_n") * F.lit(similarity) - F.lit(EPSILON)) - 1
    with_a = pairs.join(own.withColumnRenamed("node", "a"), "a")
    close = (F.col("b") == F.col("node")) & (F.size(F.array_intersect("own", "b_own")) + beyond >= need)
    return with_a.join(own.withColumnRenamed("own", "b_own"), close).select("a", "b")


def verified_links(texts: DataFrame, links: DataFrame, folder: str, width: int, similarity: float) -> DataFrame:
    """The links (a, b) between texts (node, text) whose shingle sets are similar enough.

    Each b is a hub: its text goes once to every part of its partners, which pass it one by one.
    """
    links = saved(links, f"{folder}/tried")
    parts = saved(links.groupBy("b").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), f"{folder}/parts")
    needed = saved(links.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"{folder}/needed")
    held = texts.join(broadcast_if_small(needed, BROADCAST_IDS), F.col("node") == F.col("id"), "left_semi")
    hub = parts.join(held, F.col("b") == F.col("node")).select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("a"), "text")
    partner = links.join(parts, "b").join(held, F.col("a") == F.col("node")).select("b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), "a", "text")
    dealt = hub.union(partner).repartition("b", "part").sortWithinPartitions("b", "part", F.asc_nulls_first("a"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: set[bytes] = set()
        for batch in batches:
            found: list[tuple[int, int]] = []
            for b, a, text in zip(*(batch.column(c).to_pylist() for c in ("b", "a", "text"))):
                parts = set(shingles(text or "", width))
                if a is None:
                    own = parts
                elif jaccard(own, parts) >= similarity:
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    return saved(dealt.select("b", "a", "text").mapInArrow(rows, "a long, b long"), f"{folder}/links")


def _nodes(docs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, digest) of all rows, (digest, first_id, node) of all distinct texts, and (node, text) of these.

    If ids are unique, the least id of a text is its node, and texts stay where they are; else nodes are numbered.
    """
    seen = saved(docs.select("doc_id", "digest"), f"{folder}/seen")
    classes = seen.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows"))
    if seen.groupBy("doc_id").count().where("count > 1").limit(1).count():
        classes = saved(classes.drop("rows").withColumn("node", F.monotonically_increasing_id()), f"{folder}/classes")
        first = classes.select("digest", F.col("first_id").alias("doc_id"), "node")
        return seen, classes, docs.join(first, ["digest", "doc_id"]).select("node", "text").dropDuplicates(["node"])
    classes = saved(classes.withColumn("node", F.col("first_id")), f"{folder}/classes")
    shared = broadcast_if_small(saved(classes.where("rows > 1").select("digest", "first_id"), f"{folder}/shared_texts"))
    later = saved(seen.join(shared, "digest").where("doc_id != first_id").select(F.col("doc_id").alias("later_id")), f"{folder}/later")
    texts = docs.join(broadcast_if_small(later, BROADCAST_IDS), F.col("doc_id") == F.col("later_id"), "left_anti")
    return seen, classes.drop("rows"), texts.select(F.col("doc_id").alias("node"), "text")


def near_copies(docs: DataFrame, *, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, digest, kept_id) of documents with an id; kept_id is the smallest id of the document's group."""
    spark = docs.sparkSession
    folder = scratch(spark, "neardup")
    with tidy_shuffles(spark):
        docs = docs.select("doc_id", "text").where("doc_id is not null").withColumn("digest", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
        seen, classes, texts = _nodes(docs, folder)
        sets = saved(shingle_sets(texts, shingle_counts(texts, width), width, similarity), f"{folder}/sets")
        first = verified_links(texts, print_links(sets, f"{folder}/1"), f"{folder}/1", width, similarity)
        keys = saved(shared_keys(sets, f"{folder}/1"), f"{folder}/keys")
        drop(spark, f"{folder}/sets")
        facts = saved(node_facts(keys, similarity), f"{folder}/facts")
        scored = saved(open_keys(keys.drop("texts"), first, f"{folder}/open").join(facts, "node"), f"{folder}/scored")
        drop(spark, f"{folder}/keys", f"{folder}/open", f"{folder}/facts")
        second = first.union(verified_links(texts, hub_links(scored, similarity, f"{folder}/2"), f"{folder}/2", width, similarity))
        rest = saved(open_keys(scored.drop("root", "score"), second, f"{folder}/open"), f"{folder}/rest")
        drop(spark, f"{folder}/scored", f"{folder}/open")
        links = second.union(verified_links(texts, rest_links(rest, similarity, f"{folder}/3"), f"{folder}/3", width, similarity))
        # Texts of one id are one node of the groups, whether they are similar or not.
        named = seen.join(classes, "digest").select("doc_id", "node")
        several = named.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b < last").select("doc_id", "b")
        same = named.join(several, "doc_id").where("node != b").select(F.col("node").alias("a"), "b")
        linked = connected_components(links.union(same), "a", "b").withColumnRenamed("node", "linked")
        rooted = classes.join(linked, F.col("node") == F.col("linked"), "left").select("digest", "first_id", F.coalesce("root", "node").alias("root"))
        rooted = saved(rooted, f"{folder}/rooted")
        kept = saved(rooted.groupBy("root").agg(F.min("first_id").alias("kept_id")), f"{folder}/kept")
        found = saved(seen.join(rooted.join(kept, "root").select("digest", "kept_id"), "digest"), f"{folder}/found")
    drop(spark, *(f"{folder}/{part}" for part in ("rest", "1", "2", "3", "rooted", "kept", "seen", "classes", "shared_texts", "later")))
    return found


def keep_one(docs: DataFrame, *, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """docs without those that are near copies of one with a smaller id, with the columns of docs."""
    spark = docs.sparkSession
    found = near_copies(docs, width=width, similarity=similarity)
    gone = saved(found.where("doc_id != kept_id").select(F.col("doc_id").alias("lw_id")).distinct(), f"{scratch(spark, 'neardup')}/gone")
    kept = docs.join(broadcast_if_small(gone, BROADCAST_IDS), docs["doc_id"] == gone["lw_id"], "left_anti")
    stay = found.where("doc_id = kept_id")
    repeats = stay.groupBy("doc_id", "digest").count().where("count > 1").limit(1).count()
    if repeats:  # equal rows: only then is every kept text compared once more
        none = kept.where("doc_id is null")
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).union(none)
    return kept
