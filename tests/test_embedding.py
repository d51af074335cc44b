"""Term vectors against a dense decomposition, and what they find."""

import hashlib
import pickle
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.functions.models import TermEmbedder, embed_column
from loomwork.operators import embedding
from loomwork.session import scratch, table

WORDS = [f"{a}{b}" for a in "kmrst" for b in "aeiou"]


def corpus(seed=1, n=250):
    rng = np.random.default_rng(seed)
    topics = [rng.permutation(WORDS)[:8] for _ in range(6)]
    return [" ".join(rng.choice(topics[i % 6], 30)) + " the of" * 3 for i in range(n)]


def dense(texts, names, window=4):
    at, n = {t: i for i, t in enumerate(names)}, np.zeros((len(names),) * 2)
    for t in texts:
        ids = [at.get(w, -1) for w in embedding.terms(t)]
        for x, a in enumerate(ids):
            for b in ids[x + 1 : x + 1 + window]:
                if a >= 0 and b >= 0:
                    n[a, b] += 1
                    n[b, a] += 1
    s = n.sum(1)
    with np.errstate(divide="ignore"):
        return np.maximum(np.where(n > 0, np.log(n * n.sum() / np.outer(s, s)), 0), 0)


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(t,) for t in [*corpus(), None, "", "solitary", "?!"]], "text string").repartition(5)


def test_vectors_are_those_of_the_dense_matrix(frame, monkeypatch):
    monkeypatch.setattr(embedding, "HELD", 500)
    names, shares = embedding.vocabulary(frame)
    count, texts = Counter(w for t in corpus() for w in embedding.terms(t)), Counter(w for t in corpus() for w in set(embedding.terms(t)))
    assert names == sorted(texts, key=lambda t: (-texts[t], t)) and shares == pytest.approx([count[t] / (sum(count.values()) + 1) for t in names])
    model = embedding.fit(frame, dimensions=6)
    values, turns = np.linalg.eigh(dense(corpus(), names))
    best = np.argsort(-values)[:6]
    want = (turns[:, best] * values[best]) @ turns[:, best].T
    assert np.abs(model.vectors @ model.vectors.T - want).max() < 0.05 * np.abs(want).max()


def test_texts(frame):
    model = embedding.fit(frame, dimensions=6)
    texts = corpus()
    vectors = model.embed([texts[0], texts[6], texts[1], None, "", "solitary"])
    assert np.allclose(np.linalg.norm(vectors[:3], axis=1), 1) and not vectors[3:5].any() and vectors[5].any()
    assert vectors[0] @ vectors[1] > vectors[0] @ vectors[2]  # a text of its own topic is nearer
    empty = embedding.fit(frame.limit(0))
    vectors = empty.embed(["x", None, "x", "y"])
    assert empty.names == [] and vectors.shape == (4, embedding.DIMENSIONS) and not vectors[1].any() and (vectors[0] == vectors[2]).all() and vectors[0] @ vectors[3] < 0.9


def test_copies_with_other_words_are_found(spark, sf):
    """Texts of which two words in five are replaced by any: how many find their original first, against the hashed terms."""
    docs = [r.text for r in table(spark, sf.replace("0.001", "0.01"), "documents").select("text").collect()]
    pieces = list(dict.fromkeys(t[:800] for t in docs if t and len(t) > 400))
    rng = np.random.default_rng(9)
    words = [w for t in pieces for w in t.split()]
    edited = [" ".join(rng.choice(words) if rng.random() < 0.4 else w for w in t.split()[20:80]) for t in pieces]
    frame = spark.createDataFrame([(t,) for t in docs], "text string").repartition(4)
    found = {}
    for name, model in (("terms", TermEmbedder()), ("vectors", embedding.fit(frame))):
        near = model.embed(edited) @ model.embed(pieces).T
        found[name] = float((near.argmax(1) == np.arange(len(pieces))).mean())
    assert found["vectors"] > found["terms"]


def test_terms_of_many_texts_at_once():
    texts = ["Straße ÑANDÚ x_y", None, "", " _ ", "İstanbul Σίσυφος e\u0301 ١٢ ½ x² 漢字", "a\u2028b\nc\x1cd\x00e", "\ud800f", "?!", "a a b"]
    names, ids, rows = embedding.coded(texts)
    assert [[names[i].as_py() for i in ids[rows == n]] for n in range(len(texts))] == [embedding.terms(t) for t in texts]
    assert len(embedding.coded([None, ""])[1]) == 0


def test_directions_are_those_of_a_generator_for_each_term():
    names = ["a", "solitary", "漢字", "x" * 99]
    for name, got in zip(names, embedding.directions(names, 24)):
        want = np.random.default_rng(int(hashlib.md5(name.encode()).hexdigest()[:12], 16)).normal(size=24)
        assert np.allclose(got, want / np.linalg.norm(want), atol=1e-15)
    assert embedding.directions([], 24).shape == (0, 24)


def test_directions_of_the_models_terms_are_not_made_again(monkeypatch):
    """Other terms came in such numbers that the model's own were forgotten and made anew all the time."""
    names = [f"w{i}" for i in range(300)]
    model, made = embedding.TermVectors(names, np.eye(300, 8), np.ones(300), np.zeros(8)), []
    monkeypatch.setattr(embedding, "KEPT", 20)
    monkeypatch.setattr(embedding, "DRAWN", 7, raising=False)
    monkeypatch.setattr(embedding, "hashlib", SimpleNamespace(md5=lambda x: made.append(x) or hashlib.md5(x)))
    others = [f"o{i}" for i in range(40)]
    texts = [" ".join([*names, *others, "o1"]), None, "w1 o2"] * 200
    vectors = model.embed(texts)
    assert not [x for x in made if x.startswith(b"w")]
    want = sum(model.whole(t) for t in embedding.terms(texts[0]))
    assert np.allclose(vectors[0], want / np.linalg.norm(want)) and np.allclose(vectors[-3], vectors[0]) and not vectors[1].any()


def test_counts_move_in_blocks_and_products_are_those_of_the_dense_matrix(frame, monkeypatch):
    names, _ = embedding.vocabulary(frame)
    counted = embedding.pair_counts(frame, names)
    assert counted.count() <= frame.rdd.getNumPartitions() * len(names)  # not a row a pair
    monkeypatch.setattr(embedding, "HELD", 200)
    folder = scratch(frame.sparkSession, "test")
    matrix = embedding.banded(embedding.pair_counts(frame, names), folder)
    sums, factor = embedding.row_sums(matrix, len(names)), np.random.default_rng(3).normal(size=(len(names), 5))
    for n, share in enumerate((1, 2, 4, 1_000)):  # no row is multiplied with its zeros, some, all
        monkeypatch.setattr(embedding, "DENSE", share)
        got = embedding.product(matrix, sums, factor, f"{folder}/{n}")
        assert np.allclose(got, dense([*corpus(), "solitary"], names) @ factor)


def test_places_in_the_matrix():
    size = 1_300
    i, j = np.meshgrid(np.arange(size), np.arange(size))
    pairs = (i % embedding.BANDS * -(-size // embedding.BANDS) + i // embedding.BANDS) * size + j
    found = embedding._entries(pairs.ravel(), size)
    assert (found[0] == i.ravel()).all() and (found[1] == j.ravel()).all() and len(np.unique(pairs)) == size**2
    for x in (np.array([0, 1, 255, 256, 1 << 40, -1]), np.zeros(0, np.int64)):
        assert (embedding.unpacked(embedding.packed(x), len(x)) == x).all()


def test_a_sent_model_embeds_alike(frame):
    model = embedding.fit(frame, dimensions=6)
    sent = embedding.Sent(frame.sparkSession.sparkContext.broadcast(model))
    rows = frame.select("text", embed_column(F.col("text"), sent).alias("v")).collect()
    assert len(rows) == 254 and np.allclose([r.v for r in rows], model.embed([r.text for r in rows]), atol=1e-6)


def test_orthonormal_columns_are_those_of_qr():
    rng = np.random.default_rng(4)
    for a in (rng.normal(size=(50, 7)), rng.normal(size=(7, 7)), rng.normal(size=(30, 2)) @ rng.normal(size=(2, 6)), np.zeros((9, 3)), rng.normal(size=(4, 1))):
        assert np.allclose(embedding.orthonormal(a), np.linalg.qr(a)[0], atol=1e-12) or np.linalg.matrix_rank(a) < a.shape[1]
        assert np.allclose(embedding.orthonormal(a).T @ embedding.orthonormal(a), np.eye(a.shape[1]))


def test_a_task_gets_no_vectors_that_it_does_not_need():
    model = embedding.TermVectors([f"w{i}" for i in range(2_000)], np.random.default_rng(5).normal(size=(2_000, 64)), np.ones(2_000), np.zeros(64))
    sent = pickle.dumps(model)
    assert len(sent) < 1.2 * 2_000 * 64 * 8 and (pickle.loads(sent).embed(["w1 other", None]) == model.embed(["w1 other", None])).all()
