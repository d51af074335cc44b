"""SimHash and substring dedup against brute force."""

import hashlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomwork.llm import recompress, simhash
from loomwork.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x") for i, t in rows], DOCS)


def brute_print(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(p, seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(prints, 2):
        if (a ^ b).bit_count() <= 3:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


def brute_repeats(rows, k=13):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for p in range(len(w) - k + 1):
            if i is not None:
                key = tuple(w[p : p + k])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - k + 1):
            if i is not None and first[tuple(w[p : p + k])] < i:
                gone.update(range(p, p + k))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def odd_rows(spark, sf):
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    return rows + [
        (9001, None), (9002, ""), (9003, " \t\n"), (9004, "one"), (9005, "one two"), (9006, "a " * 40), (9007, "b " + "a " * 30),
        (9008, long), (9009, "new start " + long), (9010, shared), (9011, f"x {shared} y"), (9011, f"x {shared} y"),
        (9011, "another text of the same id"), (None, shared), (None, None), (9012, "É é ß " * 20), (8999, f"late {shared}"),
    ]


def test_golay_keys_find_every_pair_within_three_bits():
    rng = np.random.default_rng(5)
    a = np.repeat(rng.integers(-(2**63), 2**63 - 1, 3000), 1)
    for weight in (1, 2, 3):
        flip = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, weight, False).astype(np.uint64)) for _ in a])
        b = (a.view(np.uint64) ^ flip).view(np.int64)
        index, probe = (dict() for _ in range(2))
        for found, prints, side in ((index, a, False), (probe, b, True)):
            for row, key in zip(*simhash.search_keys(prints, side)):
                found.setdefault(int(row), set()).add(int(key))
        assert all(index[i] & probe[i] for i in range(len(a)))


def test_golay_keys_find_every_error_of_one_bit_in_each_segment():
    print_ = np.array([0x0123456789ABCDEF], np.uint64)
    bits = [np.uint64(1) << np.arange(s, s + n, dtype=np.uint64) for s, n in simhash.SEGMENTS]
    others = print_ ^ (bits[0][:, None, None] | bits[1][:, None] | bits[2]).ravel()
    for one, many in ((True, False), (False, True)):  # each side is indexed once and looked up once
        wanted = simhash.search_keys(print_.view(np.int64), one)[1]
        rows, keys = simhash.search_keys(others.view(np.int64), many)
        assert len(set(rows[np.isin(keys, wanted)].tolist())) == len(others) == 22 * 21 * 21


def test_golay_code_is_perfect():
    low, high, errors = simhash.golay()
    assert (errors[:, 0] >= 0).all() and len(set(errors[:, 0].tolist())) == 2048
    assert (errors[:, 5] >= 0).sum() == 1771


def test_simhash_matches_brute_force(spark, sf):
    rows = odd_rows(spark, sf)
    got = simhash.fingerprint_report(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = {t: brute_print(t) for _, t in rows}
    roots, smallest = brute_components(sorted(set(prints.values()))), {}
    for i, t in rows:
        if i is not None:
            smallest[roots[prints[t]]] = min(i, smallest.get(roots[prints[t]], i))
    want = sorted((i or -1, f"{prints[t]:016x}", smallest[roots[prints[t]]]) for i, t in rows)
    assert sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in got) == want


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(5, 5), (None, 3), (200, 100)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in [*range(100, 130), 200]}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_substring_dedup_matches_brute_force(spark, sf):
    rows = odd_rows(spark, sf)
    got = [tuple(r) for r in recompress.repeat_report(frame(spark, rows)).collect()]
    key = lambda r: (r[0] or -1, *r[1:])
    assert sorted(got, key=key) == sorted(brute_repeats(rows), key=key)


def test_drop_repeats_keeps_columns_and_clean_texts(spark):
    shared = " ".join(f"s{i}" for i in range(20))
    rows = [(1, shared), (2, f"a\n{shared}  b"), (3, "left  alone\n"), (4, None)]
    out = recompress.drop_repeats(frame(spark, rows))
    assert out.schema.names == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: (shared, len(shared)), 2: ("a b", 3), 3: ("left  alone\n", 12), 4: (None, None)}


@pytest.mark.parametrize("make", [simhash.fingerprint_report, recompress.repeat_report, recompress.drop_repeats])
def test_empty_table(spark, make):
    assert make(spark.createDataFrame([], DOCS)).count() == 0


def final_plan(rows):
    rows.collect()
    return rows._jdf.queryExecution().executedPlan().toString()


def test_joins_on_a_hot_key_are_split(spark, tmp_path):
    """Half of all rows have one key: adaptive execution must find a skewed join that it may split."""
    from loomwork.llm import components, neardup
    from loomwork.session import saved

    low = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.files.maxPartitionBytes": "16k",
    }
    before = {k: spark.conf.get(k, None) for k in low}
    for k, v in low.items():
        spark.conf.set(k, v)
    try:
        n = 40_000
        links = spark.range(n).selectExpr("id AS v", "CASE WHEN id % 2 = 0 THEN -1 ELSE id END AS u")
        links = saved(links, str(tmp_path / "links"))
        least = saved(links.groupBy("u").agg(F.min("v").alias("m")), str(tmp_path / "least"))
        assert "skew=true" in final_plan(components.pointed(links, least))
        sets = spark.range(n).selectExpr("id AS node", "10 AS n", "id % 7 AS print", "array(CASE WHEN id % 2 = 0 THEN -1L ELSE id END, id + 1000000) AS keys")
        sets = saved(sets, str(tmp_path / "sets"))
        keys = neardup.shared_keys(sets, str(tmp_path / "keys"))
        assert "skew=true" in final_plan(keys)
        keys = saved(keys.select("key", "node", "n", "place", F.lit(1.0).alias("score"), F.col("node").alias("root")), str(tmp_path / "rooted"))
        hubs = neardup.hub_links(keys, 0.8, str(tmp_path / "hubs"))
        assert "skew=true" in final_plan(hubs)
        none = spark.createDataFrame([], "a long, b long")
        assert "skew=true" in final_plan(neardup.open_keys(keys.drop("root"), none, str(tmp_path / "open")))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_frequent_passages_stay_out_of_the_prefixes(spark, tmp_path):
    """A passage that a hundredth of all texts share makes no pairs to compare: candidates grow with the rows."""
    from loomwork.llm import neardup

    pairs = []
    for n in (1_000, 2_000):
        rng = np.random.default_rng(n)
        passage = " ".join(f"p{i}" for i in range(50))
        texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**9, 120)) + (f" {passage}" if i % 12 == 0 else "") for i in range(n)]
        frame = spark.createDataFrame(list(enumerate(texts)), "node long, text string").repartition(4)
        sets = neardup.shingle_sets(frame, neardup.shingle_counts(frame, 5), 5, 0.8).persist()
        keys = neardup.shared_keys(sets, str(tmp_path / str(n)))
        pairs.append(keys.select(F.sum(F.col("texts") - 1)).first()[0] or 0)
    assert pairs[1] <= 2 * pairs[0] + 100 and pairs[1] < 2_000


def test_shingle_counts_cover_all_texts(spark):
    from loomwork.llm import neardup

    texts = ["a b c d e f", "a b c d e", "x y", "", None, "a b c d e a b c d e"]
    counts = neardup.shingle_counts(spark.createDataFrame(list(enumerate(texts)), "node long, text string").repartition(3), 5)
    want = np.zeros(neardup.BUCKETS, np.int64)
    for t in texts:
        np.add.at(want, neardup.bucket(np.unique(neardup.shingle_hashes(t or "", 5))), 1)
    assert (counts == want).all() and counts.sum() > 0


def test_fingerprint_keys_are_not_broadcast(spark, tmp_path):
    """Some hundred thousand fingerprints are a few megabytes, but their keys a hundred times that."""
    prints = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 2_000)
    spark.createDataFrame([(int(p),) for p in prints], "print long").write.parquet(f"{tmp_path}/prints")
    near = simhash.near_prints(spark.read.parquet(f"{tmp_path}/prints"))
    made = final_plan(near)
    assert "Broadcast" not in made and "SortMergeJoin" in made
