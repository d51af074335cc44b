"""The pipeline's stages, each on its own input, against brute force."""

import random

import corpus_pipeline
import pytest

from loomwork.llm import bpe, neardup, quality
from loomwork.session import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, lw_id long"


def prose(rnd, n):
    return [rnd.choice(["the", "of", "and", "to", "in"]) if rnd.random() < 0.4 else f"{rnd.choice('bdfgkl')}{rnd.randrange(9000)}" for _ in range(n)]


def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def planted(seed=0):
    """(rows, groups): texts with copies and near copies of a similarity of 0.8 or more, and some below."""
    rnd, rows, groups = random.Random(seed), [], []
    for _ in range(60):
        words = prose(rnd, rnd.randint(80, 400))
        group = [" ".join(words)]
        for _ in range(rnd.randint(0, 6)):
            near = list(words)
            for _ in range(rnd.randint(0, max(1, len(words) // 60))):
                near[rnd.randrange(len(near))] = f"edit{rnd.randrange(10**6)}"
            group.append(" ".join(near))
        groups.append(group)
    texts = [t for g in groups for t in g] + [None, "", " ", "one two", "one two", "one  two"]
    rnd.shuffle(texts)
    return [(i, t, "en", "s", None if t is None else len(t), 0) for i, t in enumerate(texts)]


def brute_kept(rows, similarity=0.8):
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {r[0]: shingle_set(r[1] or "") for r in rows}
    text = {r[0]: r[1] or "" for r in rows}
    for a in sets:
        for b in sets:
            if a < b and (text[a] == text[b] or (sets[a] or sets[b]) and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {r[0] for r in rows if find(r[0]) == r[0]}


def cut_copies(seed=3):
    """Pairs of a text and the same text cut short or extended, at a shingle similarity of 0.80 to 0.90."""
    rnd, texts = random.Random(seed), []
    for _ in range(150):
        words, share = prose(rnd, rnd.randint(100, 300)), rnd.uniform(0.80, 0.90)
        shingles = len(words) - 4
        short = words[: int(share * shingles) + 5]
        texts += [" ".join(words), " ".join(short)] if rnd.random() < 0.5 else [" ".join(short), " ".join(words)]
    return [(i, t, "en", "s", len(t), 0) for i, t in enumerate(texts)]


def copies_by_kind(kind, seed=9):
    """Pairs at a shingle similarity of 0.80 to 0.90: scattered edits, or a passage appended, put inside or cut off."""
    rnd, rows = random.Random(seed), []
    for i in range(80):
        words = prose(rnd, rnd.randint(150, 300))
        n, share = len(words) - 4, rnd.uniform(0.81, 0.90)
        more = prose(rnd, int(n / share - n) - 4)
        at = rnd.randrange(20, len(words) - 20)
        near = list(words)
        if kind == "edits":  # an edit changes five shingles of each text
            for place in rnd.sample(range(5, len(words) - 5, 6), max(1, int(n * (1 - share) / (1 + share) / 5))):
                near[place] = f"edit{rnd.randrange(10**9)}"
        near = {"edits": near, "appended": words + more, "inserted": words[:at] + more + words[at:], "truncated": words[: int(share * n) + 5]}[kind]
        rows += [(2 * i, " ".join(words), "en", "s", 1, 0), (2 * i + 1, " ".join(near), "en", "s", 1, 0)]
    return rows


def star_copies(n=300, seed=4):
    """Copies of one text with edits of their own: 0.8 or more like the text, less than 0.8 like each other."""
    rnd = random.Random(seed)
    words = prose(rnd, 400)
    rows = [(n // 2, " ".join(words), "en", "s", 1, 0)]
    for i in range(n + 1):
        near = list(words)
        for place in rnd.sample(range(5, 395), 8):
            near[place] = f"edit{rnd.randrange(10**9)}"
        if i != n // 2:
            rows.append((i, " ".join(near), "en", "s", 1, 0))
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_near_dedup_keeps_one_of_each_group(spark, seed):
    rows = planted(seed)
    df = spark.createDataFrame(rows, DOCS)
    kept = corpus_pipeline.near_dedup(spark, df, "")
    assert kept.columns == df.columns
    got, want = [r.doc_id for r in kept.collect()], brute_kept(rows)
    assert len(got) == len(set(got)) and want == set(got)


@pytest.mark.parametrize("seed", [3, 5])
def test_near_dedup_finds_cut_and_extended_copies(spark, seed):
    rows = cut_copies(seed)
    got = {r.doc_id for r in neardup.keep_one(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_kept(rows)


@pytest.mark.parametrize("kind", ["edits", "appended", "inserted", "truncated"])
def test_near_dedup_finds_every_kind_of_copy(spark, kind):
    rows = copies_by_kind(kind)
    got = {r.doc_id for r in neardup.keep_one(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_kept(rows) and len(got) <= 84


def test_near_dedup_compares_each_text_of_a_repeated_id(spark):
    rnd = random.Random(2)
    a, b = prose(rnd, 100), prose(rnd, 100)
    near = [*a[:-2], "other", "end"]
    rows = [(1, " ".join(a), "en", "s", 1, 0), (1, "zz " + " ".join(b), "en", "s", 1, 0), (2, " ".join(near), "en", "s", 1, 0), (3, "zz " + " ".join(b[:-1]), "en", "s", 1, 0)]
    got = [r.doc_id for r in neardup.keep_one(spark.createDataFrame(rows, DOCS)).collect()]
    assert got == [1, 1]


def test_near_dedup_of_a_star(spark):
    rows = star_copies()
    got = {r.doc_id for r in neardup.keep_one(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_kept(rows) == {0}


def test_near_dedup_beyond_hubs(spark):
    """Chains: each text is like the next one, the ends are not alike, so no hub reaches all."""
    rnd, rows = random.Random(6), []
    for g in range(40):
        words = prose(rnd, 300)
        for step in range(6):  # each is like the next, the ends are not alike
            rows.append((g * 6 + (step * 5) % 6, " ".join(words), "en", "s", 1, 0))
            for place in rnd.sample(range(300), rnd.randint(4, 8)):
                words[place] = f"step{rnd.randrange(10**9)}"
    got = {r.doc_id for r in neardup.keep_one(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_kept(rows)


def test_near_dedup_of_odd_tables(spark):
    rows = [(1, "a b", "en", "s", 3, 0), (1, "a b", "en", "s", 3, 0), (None, "a b", "en", "s", 3, 0), (None, None, None, None, None, None), (2, "A B", "en", "s", 3, 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted((r.doc_id or 0, r.text or "") for r in neardup.keep_one(df).collect())
    assert got == [(0, ""), (0, "a b"), (1, "a b")]
    assert neardup.keep_one(df.limit(0)).count() == 0


def test_stages_in_order_and_run(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "substring dedup", "mixing", "bpe"]
    docs = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    kept = {r.doc_id for r in quality.keep_good(docs).select("doc_id").collect()}
    assert {r.doc_id for r in rows} <= kept
    some = rows[0]
    assert bpe.decode_ids(b"".join(int(i).to_bytes(4, "little") for i in some.ids))


def test_stages_of_an_empty_table_and_nulls(spark):
    for rows in ([], [(None, None, None, None, None, None), (1, None, "en", "s", None, 0), (2, "x", None, None, 1, 1)]):
        docs = spark.createDataFrame(rows, DOCS)
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            assert stage(spark, docs, "").count() == (len(rows) if n else 0)  # quality rules keep no text so short


def test_stages_of_very_long_and_repeated_texts(spark):
    rnd = random.Random(11)
    long, other = " ".join(prose(rnd, 60_000)), " ".join(prose(rnd, 500))
    rows = [(1, long, "en", "s", len(long), 0), (2, other, "en", "t", len(other), 0), (2, other, "en", "t", len(other), 0), (3, f"new words {long}", "en", "s", len(long) + 10, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    want = {"quality rules": [1, 2, 2, 3], "simhash near-dedup": [1, 2], "substring dedup": [1, 2, 2, 3], "mixing": None, "bpe": [1, 2, 2, 3]}
    for name, stage in corpus_pipeline.STAGES:
        got = sorted(r.doc_id for r in stage(spark, docs, "").collect())
        assert got == want[name] if want[name] else set(got) == {1, 2, 3}, name
