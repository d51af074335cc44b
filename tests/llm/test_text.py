"""BPE against the library, quality measures against brute force, and the queries that have SQL."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomwork.llm import bpe, quality
from loomwork.session import table

ODD = ["", " ", "\n", "<|endoftext|>", "a <|endoftext|><|endoftext|> b<|endoftext", "  x  y ", "a" * 5000, "don't I'll 'S", "12²½Ⅷ٣", "你好 世界🙂é", " \u0085\x1c\xa0　x", "ab" * 20, "é ‍"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def texts(spark, sf):
    rnd = random.Random(4)
    made = ["".join(rnd.choice("abcABC  \n\t\r\x0béßñ好🙂12_'s!?-") for _ in range(rnd.randint(1, 90))) for _ in range(300)]
    return ODD + made + [r.text for r in table(spark, sf, "documents").select("text").collect()]


def test_encoding_equals_the_library(spark, library, texts):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, None])], "doc_id long, text string, ids int")
    want = library.encode_batch([*texts, ""], add_special_tokens=False)
    got = bpe.encoding_report(df).orderBy("doc_id").collect()
    for row, e in zip(got, want):
        ids = np.array(e.ids, "<u4").tobytes()
        back = library.decode(e.ids, skip_special_tokens=False)
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(e.ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    counted = bpe.count_report(df, limit=100).orderBy("doc_id").collect()
    for row, e, t in zip(counted, want, [*texts, ""]):
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(t.encode()), len(e.ids), len(e.ids) > 100)
    assert bpe.encoding_report(df.limit(0)).count() == 0 == bpe.count_report(df.limit(0)).count()


def test_decoding_equals_the_library_for_any_ids(library):
    rng = np.random.default_rng(3)
    for _ in range(300):
        ids = rng.integers(0, 50_257, 12)
        assert bpe.decode_ids(ids.astype("<u4").tobytes()) == library.decode(ids.tolist(), skip_special_tokens=False)


def brute_merge(voc, piece):
    ids = [voc.byte_ids[b] for b in piece]
    while True:
        ranks = [voc.ranks.get(a * voc.width + b, len(voc.merged)) for a, b in zip(ids, ids[1:])]
        if not ranks or min(ranks) == len(voc.merged):
            return ids
        i = ranks.index(min(ranks))
        ids[i : i + 2] = [voc.merged[ranks[i]]]


def test_tree_merges_as_a_plain_search_does():
    voc = bpe.vocabulary(bpe.VOCABULARY)
    rnd = random.Random(8)
    for n in [*range(0, 40), *(rnd.randint(40, 400) for _ in range(40))]:
        piece = "".join(rnd.choice(["the", "tion", "ing", "a", "é", "zz", "10"]) for _ in range(n)).encode()
        assert voc.merge(piece) == brute_merge(voc, piece)


def test_whole_tokens_are_whole(library):
    whole = sorted(bpe.vocabulary(bpe.VOCABULARY).whole_tokens())
    assert len(whole) > 45_000
    assert all(len(e.ids) == 1 for e in library.encode_batch(whole, add_special_tokens=False))


def brute_measures(text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    tri = list(zip(words, words[1:], words[2:]))
    n, covered = Counter(tri), set()
    for i, k in enumerate(tri):
        if n[k] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def quality_texts(texts):
    shout = "LOUD!! WORDS!! " * 30
    return [*texts, None, "a b c " * 30, "a b a b a b c", shout, "x | y | " * 40, " ".join(f"w{i % 4999}" for i in range(12_000)), "line one\nline one\n" * 40, "a\x1cb c d"]


def test_quality_measures_match_brute_force(spark, texts):
    texts = quality_texts(texts)
    df = spark.createDataFrame([(i, t, 2) for i, t in enumerate(texts)], "doc_id long, text string, lw_x int")
    got = quality.quality_report(df).orderBy("doc_id").collect()
    assert len(got) == len(texts)
    for row, text in zip(got, texts):
        want = brute_measures(text)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want, text
        assert row.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (row.base_failed and row.kept)
    assert quality.keep_good(df).columns == df.columns
    assert quality.keep_good(df).count() == sum(r.kept for r in got)
    assert quality.quality_report(df.limit(0)).count() == 0


def test_order_of_rules_does_not_change_the_verdict(spark, texts):
    rules = quality.default_rules()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(quality_texts(texts))], "doc_id long, text string").withColumn("m", quality.measures(quality.F.col("text")))
    kept = [
        {r.doc_id for r in df.where(quality.first_rejection(quality.F.col("m"), quality.F.coalesce("text", quality.F.lit("")), order).isNull()).select("doc_id").collect()}
        for order in (rules, rules[::-1], rules[3:] + rules[:3])
    ]
    assert kept[0] == kept[1] == kept[2]


def test_the_cascade_stops_at_the_first_rejection(spark, texts, monkeypatch):
    """A rule that would fail is never evaluated for documents that one before it rejects, nor are its measures."""
    bad = quality.Rule("bad", lambda m, t: quality.F.raise_error(quality.F.concat(t, quality.F.lit("reached"))).cast("boolean") | (m["n_repeat_words"] > 0))
    short = quality.Rule("short", lambda m, t: quality.F.length(t) < 10**9)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(quality, "order_rules", lambda docs, rules, **_: sorted(rules, key=lambda r: r.name != "short"))
    assert quality.keep_good(df, [bad, short]).count() == 0
    monkeypatch.setattr(quality, "order_rules", lambda docs, rules, **_: sorted(rules, key=lambda r: r.name != "bad"))
    with pytest.raises(Exception, match="reached"):
        quality.keep_good(df, [bad, short]).count()


def test_costly_rules_that_reject_little_go_late(spark):
    df = spark.createDataFrame([(i, f"w{i} " * 2000 if i % 50 else "# # #") for i in range(400)], "doc_id long, text string")
    costly = quality.Rule("costly", lambda m, t: (m["n_repeat_words"] > -1) & (m["n_words"] < 10))
    cheap = quality.Rule("cheap", lambda m, t: quality.F.length(t) > 10)
    never = quality.Rule("never", lambda m, t: quality.F.length(t) < 0)
    assert [r.name for r in quality.order_rules(df, [never, costly, cheap])][0] == "cheap"
    assert [r.name for r in quality.order_rules(df.limit(0), [never, costly, cheap])] == ["never", "costly", "cheap"]


def test_clean_documents_stay_and_junk_goes(spark, sf):
    big = sf.replace("0.001", "0.01")
    rows = quality.quality_report(table(spark, big, "documents")).join(table(spark, big, "labels"), "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    junk = [r.kept for r in rows if r.quality == 0]
    assert all(good) and len(good) > 100 and sum(junk) <= 0.02 * len(junk)
