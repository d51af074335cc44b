"""Token files, alignment and divergence against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwork.llm import alignment, divergence, tokenfile
from loomwork.llm.bpe import byte_letters
from loomwork.session import table

ODD = [
    "", None, " ", "a", "  two  spaces ", "\n\n\t x\r\n", "x" * 5_000, "日本語のテキスト、😀 and ▁ bar", "▁", "<|endoftext|> plain <s> </s> <unk> <0x0A>",
    "naïve café ÀÉÎ — “quotes” … ﬁ", "１２３ ²³ ½", "á ë ‍​", "\x00\x01\x7f", "don't can't I'LL", "ab " * 3_000, "\U0010ffff", " " * 3_000, "the the the the",
]


@pytest.fixture(scope="module")
def byte_level():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def docs(spark, sf):
    rows = [(i, t, i) for i, t in enumerate(ODD, 500)] + [(None, "no id", 0), (None, None, 0), (3, "again", 1), (3, "again", 1), (3, "other", 2), (-7, "below zero", 1)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    more = table(spark, sf, "documents").select("doc_id", "text", F.lit(0).alias("shard")).where("doc_id < 120")
    return odd.union(more).repartition(5)


def ids_crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, docs, byte_level, tmp_path):
    folder = f"file://{tmp_path}/files"
    tokenfile.write_tokens(docs, folder)
    encoded = [(r.doc_id, [*byte_level.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in docs.collect()]
    encoded.sort(key=lambda x: (x[0] is not None, x[0] or 0, len(x[1])))
    got = sorted(tokenfile.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.n_tokens) for r in got] == [(i, len(x)) for i, x in encoded]
    starts = np.concatenate([[0], np.cumsum([len(x) for _, x in encoded])])[:-1]
    assert [r.start for r in got] == starts.tolist()
    assert sorted((r.doc_id or -1, list(r.ids)) for r in got) == sorted((i or -1, x) for i, x in encoded)
    digests = sorted(tokenfile.read_tokens(spark, folder, digests=True).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens) for r in digests] == [(r.doc_id, r.start, r.n_tokens) for r in got]
    assert [r.ids_crc32 for r in digests] == [ids_crc(r.ids) for r in got]
    wanted = spark.createDataFrame([(3,), (-7,), (507,), (10**9,), (None,), (3,)], "doc_id long")
    found = sorted((r.doc_id, list(r.ids)) for r in tokenfile.fetch(wanted, folder).collect())
    assert found == sorted((i, x) for i, x in encoded if i in (3, -7, 507))
    assert len(list((tmp_path / "files").glob("shard-*"))) == len(tokenfile.manifest(folder)) > 1


def test_token_files_of_nothing_and_damage(spark, docs, tmp_path):
    empty = f"file://{tmp_path}/empty"
    tokenfile.write_tokens(docs.limit(0), empty)
    assert tokenfile.read_tokens(spark, empty).count() == 0 and tokenfile.manifest(empty) == []
    assert tokenfile.token_file_report(docs.select("doc_id", F.lit(None).cast("string").alias("text")).limit(2)).select("n_tokens", "ids_crc32").distinct().collect() == [(1, ids_crc([0]))]
    folder = f"file://{tmp_path}/files"
    tokenfile.write_tokens(docs.limit(5), folder)
    dictionary = tmp_path / "files/dictionary.zdict"
    dictionary.write_bytes(dictionary.read_bytes()[:-1] + b"?")
    with pytest.raises(Exception, match="isn't the dictionary"):
        tokenfile.read_tokens(spark, folder).count()


def test_an_attempt_that_does_not_count_is_not_read(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/files"
    tokenfile.write_tokens(docs.limit(20), folder)
    n = tokenfile.read_tokens(spark, folder).count()
    (tmp_path / "files/shard-000000-99999.bin").write_bytes(b"half a sha")
    assert tokenfile.read_tokens(spark, folder).count() == n == 20


def test_ids_equal_the_library_in_every_character(byte_level):
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000] + ["\U000e0041", "\U0010ffff"]
    texts = ["".join(f"a{c} {c}{c}1\n{c}" for c in points[i : i + 4_096]) for i in range(0, len(points), 4_096)]
    for text, want in zip(texts, byte_level.encode_batch(texts, add_special_tokens=False)):
        assert tokenfile.ids_of(text).tolist() == want.ids


def test_long_texts_take_the_other_ways(monkeypatch, byte_level):
    text = ("The naïve café  has  two spaces.\n\n" + "x" * 70 + " <|endoftext|> ") * 40
    short = tokenfile.ids_of(text).tolist()
    a, b = alignment.sides(alignment.VOCABULARY, alignment.PIECES)
    plain = [side.ids(text).tolist() for side in (a, b)]
    ends = [text[:k] for k in range(200, 260)]
    want = [b.ids(t).tolist() for t in ends]
    monkeypatch.setattr(tokenfile, "LONG", 10)
    monkeypatch.setattr(alignment, "LONG", 10)
    assert b.parts
    assert tokenfile.ids_of(text).tolist() == short == byte_level.encode(text, add_special_tokens=False).ids
    assert [side.ids(text).tolist() for side in (a, b)] == plain
    assert [b.ids(t).tolist() for t in ends] == want


def brute_alignment(rows):
    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters, aligned, count = byte_letters(), [], Counter()
    for doc_id, text in rows:
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        spelt = [[bytes(letters[c] for c in a_side.id_to_token(i)) for i in a]]
        spelt.append([bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b])
        if not text or any(b"".join(x) != (" " + text).encode() for x in spelt):
            aligned.append((doc_id, [], [], [], []))
            continue
        spans = []
        for tokens in spelt:
            ends = np.cumsum([len(x) for x in tokens]).tolist()
            spans.append(list(zip([0, *ends], ends)))
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = ["|".join(",".join(str(i) for i, (_, e) in zip(ids, span) if p < e <= c) for ids, span in zip((a, b), spans)) for p, c in zip([0, *cuts], cuts)]
        links, j = [], 0
        for i, (s, e) in zip(a, spans[0]):
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < e:
                links.append((i, b[k]))
                k += 1
        count.update(links)
        aligned.append((doc_id, a, b, groups, links))
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [
        (i, len(a), len(b), len(g), len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for i, a, b, g, x in aligned
    ]


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("sent, window, slice_", [(10**6, 1 << 16, 256), (0, 64, 2)])
def test_alignment(spark, docs, monkeypatch, sent, window, slice_):
    monkeypatch.setattr(alignment, "WINDOW", window)
    monkeypatch.setattr(alignment, "SLICE", slice_)
    monkeypatch.setattr(alignment, "HELD", 1_000)
    want = in_order(brute_alignment([(r.doc_id, r.text) for r in docs.collect()]))
    assert in_order(alignment.alignment_report(docs, sent=sent).collect()) == want
    assert alignment.alignment_report(docs.limit(0), sent=sent).count() == 0


def test_packed_pairs():
    pairs = np.array([3, 5, 1 << 32, (1 << 32) + 9, (50_000 << 32) + 31_999], np.int64)
    times = np.array([1, 70_000, 2, 1, 4], np.int64)
    got = alignment.unpacked(alignment.packed(pairs, times))
    assert got[0].tolist() == pairs.tolist() and got[1].tolist() == times.tolist()
    assert [len(x) for x in alignment.unpacked(alignment.packed(pairs[:0], times[:0]))] == [0, 0]


def brute_divergence(rows, least=3):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = term.findall(text.translate(low))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {r[0] for r in rows}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted({s for x, s, _ in rows if x == lang})
        share = {}
        for group in [*sources, None]:
            c = Counter() if group is not None else sum((counts[lang, s] for s in sources), Counter())
            c = counts[lang, group] if group is not None else c
            n = sum(c[t] for t in kept)
            share[group] = {t: (1 + 10**9 * (c[t] + 1) // (n + len(kept)), c[t]) for t in kept}
        f = lambda p, q: (p - q) * (p - q) // q
        for s in sources:
            pairs = sorted((-sum(f(share[s][t][0], share[o][t][0]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(share[s][t][0], share[None][t][0]), t.encode()) for t in kept if share[s][t][1] and share[s][t][0] > share[None][t][0])[:200]
            out += [(lang, s, "pair", o.decode(), -v, i) for i, (v, o) in enumerate(pairs, 1)] + [(lang, s, "term", t.decode(), -v, i) for i, (v, t) in enumerate(terms, 1)]
    return sorted(out)


LANGS = [
    ("en", "s1", "Alpha beta beta ÄÖ Straße x1y"), ("en", "s1", "alpha BETA gamma"), ("en", "s2", "alpha beta delta ÄÖ"), ("en", "s2", "ALPHA gamma äö"), ("en", "s3", None), ("en", "", "beta gamma ÄÖ"),
    (None, None, "lonely"), ("", "s1", "lonely word"), ("", "s2", "lonely"), ("xx", "a", "never kept"), ("xx", "b", "other"), ("xx", "c", ""), ("zz", "only", "one one one"), ("zz", "only", "one"), ("zz", "only", "one"),
    ("en", "s1", "Alpha beta beta ÄÖ Straße x1y"), ("en", "s4", "tie tied tie"), ("en", "s4", "tie tied"), ("en", "s4", "tie tied ab abc abcd abcde"), ("en", "s2", "ab abc abcd abcde"), ("en", "s1", "ab abc abcd abcde"),
]


def divergence_frame(spark, rows):
    return spark.createDataFrame([(i, *r, "clash", 1) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string, n int").repartition(4)


@pytest.mark.parametrize("small", [False, True])
def test_divergence(spark, monkeypatch, small):
    if small:  # every limit is met: nodes hand leaves on, tries move early, long texts, many blocks and tiles
        for name, n in {"BURST": 2, "LEAVES": 3, "WINDOW": 80, "BLOCK": 2, "SLICE": 2, "HELD": 1, "HELD_LEAVES": 1, "BATCH": 3, "STRIDE": 2}.items():
            monkeypatch.setattr(divergence, name, n)
    got = divergence.divergence_report(divergence_frame(spark, LANGS), tile=2 if small else 1_000)
    assert sorted(tuple(r) for r in got.collect()) == brute_divergence(LANGS)
    assert divergence.divergence_report(divergence_frame(spark, LANGS).limit(0)).count() == 0


def test_divergence_of_documents(spark, sf, monkeypatch):
    monkeypatch.setattr(divergence, "LEAVES", 500)
    monkeypatch.setattr(divergence, "WINDOW", 20_000)
    docs = table(spark, sf, "documents")
    rows = [(r.lang, r.source, r.text) for r in docs.select("lang", "source", "text").collect()]
    assert sorted(tuple(r) for r in divergence.divergence_report(docs).collect()) == brute_divergence(rows)


def test_trie():
    rng = np.random.default_rng(5)
    keys = {bytes(rng.integers(97, 100, rng.integers(1, 12)).astype("u1")) for _ in range(3_000)} | {b"a", b"ab", b"abc", b"abcd"}
    trie = divergence.Trie()
    for k in keys:
        leaf = trie.leaf(k)
        leaf["s"] = leaf.get("s", 0) + len(k)
    assert [(k, x["s"]) for k, x in trie.walk()] == [(k, len(k)) for k in sorted(keys)]
    assert trie.leaf(b"abc")["s"] == 3


def test_shares_beyond_64_bits():
    counts = np.array([[0, 10**10, 5 * 10**9]], np.int64)
    n = np.array([10**11, 3 * 10**11, 7], object)
    want = [1 + 10**9 * (c + 1) // (m + 12) for c, m in zip(counts[0].tolist(), n)]
    assert divergence.shares(counts, n, 12)[0].tolist() == want
    assert divergence.shares(counts[:, :1], np.array([10**11]), 12)[0, 0] == want[0]


def test_a_sweep_finds_ends_by_one_table(monkeypatch):
    """Both sides' ends are marked in one table of a window's bytes; membership tests of sorted ends took a third of the sweep."""
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 6, 50)
    spelt = alignment._numbers(50).__getitem__
    for _ in range(40):
        size = int(rng.integers(1, 60))
        ends = [np.unique([*rng.integers(1, size + 1, int(rng.integers(0, size + 1))), size]).astype(np.int64) for _ in range(2)]
        ids = [rng.integers(0, len(lengths), len(e)) for e in ends]
        common = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
        links = [(int(ids[0][np.searchsorted(ends[0], e)]), int(ids[1][np.searchsorted(ends[1], e)])) for e in sorted(set(ends[0].tolist()) | set(ends[1].tolist()))]
        groups = ";".join("|".join(",".join(str(i) for i, e in zip(x, y) if low < e <= high) for x, y in zip(ids, ends)) for low, high in zip([0, *common], common))
        for window in (size, 3):
            state = alignment.Sweep(spelt)
            with monkeypatch.context() as m:
                if window == size:
                    m.setattr(alignment, "inside", None)
                for at in range(0, size, window):
                    state.take(*((x[(e > at) & (e <= at + window)], e[(e > at) & (e <= at + window)]) for x, e in zip(ids, ends)))
            state.settle()
            assert (state.groups, state.links, state.sha.hexdigest()) == (len(common), len(links), hashlib.sha256(groups.encode()).hexdigest())
            want = sorted(Counter(a << 32 | b for a, b in links).items())
            assert list(zip(state.pairs.tolist(), state.times.tolist())) == want
