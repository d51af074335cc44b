"""WARC round trips, and mixtures against their definition."""

import hashlib
import io
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomwork.llm import mixing, warc
from loomwork.session import scratch, table

PAGES = "page_id long, url string, html string, size int"


def page_rows(spark, sf):
    big, small = "<p>é\r\n\r\nWARC/1.1 not a record</p>" * 9, "x" * 99
    rows = [tuple(r) for r in table(spark, sf, "pages").select("page_id", "url", "html").collect()]
    return rows + [
        (900, "http://a.example/x", big), (901, "http://b.example:80/x?q#f", big), (899, "http://a.example/x", big), (902, None, small), (903, "http://[bad", small),
        (904, "a\r\nb", None), (905, "", ""), (None, "http://n.example/", big), (None, None, None), (906, "http://h.example/\tt", "y" * 100), (907, "http://h.example/", "y" * 100),
        (899, "http://a.example/x", big),
    ]


def brute_archive(rows):
    least = {}
    for i, _, html in rows:
        if html is not None and len(html.encode()) >= 100 and i is not None:
            least[html] = min(i, least.get(html, i))
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        first = least.get(html) if len(raw) >= 100 else None
        revisit = first is not None and i != first
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


def test_archives_round_trip(spark, sf):
    rows = page_rows(spark, sf)
    pages = spark.createDataFrame([(*r, 0) for r in rows], PAGES).repartition(3)
    assert order(tuple(r) for r in warc.archive_report(pages).collect()) == order(brute_archive(rows))
    assert warc.archive_report(pages.limit(0)).count() == 0


@pytest.mark.parametrize("top", [10_000, 2])
def test_index_finds_every_capture(spark, sf, monkeypatch, top):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    monkeypatch.setattr(warc, "TOP", top)
    monkeypatch.setattr(warc, "FAN", 4)
    rows = page_rows(spark, sf)
    folder = scratch(spark, "test")
    warc.write_archives(spark.createDataFrame([(*r, 0) for r in rows], PAGES).repartition(3), f"{folder}/archive")
    captures = warc.read_archives(spark, f"{folder}/archive").persist()
    assert captures.count() == len(rows)
    index = warc.build_index(captures, f"{folder}/index")
    assert index.size >= len(rows) // 7 and len(index.directory()) == (1 if top > 2 else 3)
    for i, url, html in rows[::17] + rows[-12:-9]:
        url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
        hits = [h for h in index.find(url).collect() if h["page_id"] == i]
        assert hits
        if hits[0]["record_type"] == "response":
            with warc.opened(hits[0]["file"]) as stream:
                stream.seek(hits[0]["offset"])
                raw = stream.read(hits[0]["length"])
            [(headers, offset, length, payload)] = list(warc.parse_records(io.BytesIO(raw + b"\r\n\r\n").read))
            assert (payload, headers["WARC-Target-URI"], length) == ((html or "").encode(), url, len(raw))
    wanted = captures.select("key", "page_id").where("page_id is not null")
    assert {(r.key, r.page_id) for r in index.locate(wanted).collect()} == {(r.key, r.page_id) for r in wanted.collect()}
    some = wanted.orderBy("key").limit(2)
    assert {r.block for r in index.blocks_of(some).collect()} <= {r.block for r in index.blocks.orderBy("first_key").limit(3).collect()}
    read = {(r.page_id, r.payload_digest) for r in warc.read_ranges(captures.where("record_type = 'response'")).collect()}
    assert read == {(r.page_id, r.payload_digest) for r in captures.where("record_type = 'response'").collect()}
    captures.unpersist()


def test_records_longer_than_a_read(monkeypatch):
    monkeypatch.setattr(warc, "READ", 7)
    bodies = [b"x" * 100, b"", b"\r\n\r\n" * 9]
    raw = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\n\r\nH: 1\r\n\r\n%s\r\n\r\n" % (len(x) + 8, x) for x in bodies)
    assert [x[3] for x in warc.parse_records(io.BytesIO(raw).read)] == bodies
    assert [x[3] for x in warc.parse_records(io.BytesIO(raw[:-4]).read)] == bodies
    with pytest.raises(ValueError):
        list(warc.parse_records(io.BytesIO(raw[:-9]).read))


def test_large_pages(spark):
    big = "z" * 20_000_000
    pages = spark.createDataFrame([(1, "http://a/", big, 0), (2, "http://b/", big, 0), (3, "http://c/", "q" * 200, 0)], PAGES)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_report(pages).collect()}
    assert got == {1: (len(big), "response", None), 2: (len(big), "revisit", 1), 3: (200, "response", None)}


def mixture(spark, rows, **settings):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens int")
    return mixing.with_copies(df, **settings).collect()


def test_mixture_meets_limit_coverage_and_budget(spark):
    rows = [(i, "w " * (5 + i % 90), "hot" if i % 3 else f"s{i % 17}", 0) for i in range(4000)]
    got = mixture(spark, rows, block=64)
    assert len(got) == len(rows) and all(r.lw_copies >= 1 for r in got)
    tokens, used = defaultdict(int), defaultdict(int)
    for r in got:
        tokens[r.source] += r.lw_tokens
        used[r.source] += r.lw_tokens * r.lw_copies
    passes = {s: used[s] / tokens[s] for s in tokens}
    assert passes["hot"] == 1 and 1.9 < max(passes.values()) < 2.1
    weight, n = {r.source: r.lw_weight for r in got}, sum(used.values())
    assert all(abs(used[s] / n - weight[s]) < 0.01 for s in weight)
    places = defaultdict(list)
    for r in got:
        places[r.source, r.lw_block].append(r.lw_place)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())
    assert max(map(len, places.values())) < 150


def brute_passes(tokens, most=2.0):
    """Passes of each source by plain bisection: the largest exponent at which no source is read over most times the least."""
    total = sum(tokens.values())
    share = {s: n / total for s, n in tokens.items() if n}
    raw = lambda a: {s: p**a for s, p in share.items()}
    spread = lambda a: max(w / share[s] for s, w in raw(a).items()) / min(w / share[s] for s, w in raw(a).items())
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if spread(middle) > most else (low, middle)
    weights = raw(high if spread(0.0) > most else 0.0)
    z = sum(weights.values())
    budget = max(tokens[s] / w for s, w in weights.items()) * z
    return {s: w / z for s, w in weights.items()}, {s: w / z * budget / tokens[s] for s, w in weights.items()}


@pytest.mark.parametrize("most_sent", [50_000, 0])
def test_mixture_equals_brute_force(spark, monkeypatch, most_sent):
    """Weights, passes and copies recomputed; most_sent 0 takes the way of very many sources."""
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most_sent)
    rows = [(i, "w " * (1 + i * 7 % 50) if i % 11 else "", None if i % 7 == 3 else "hot" if i % 3 else f"s{i % 5}", 0) for i in range(3000)]
    rows += [(9000, "long " * 60_000, "s1", 0), (1, rows[1][1], rows[1][2], 0), (1, rows[1][1], rows[1][2], 0), (9001, None, "empty", 0), (None, "a b", "hot", 0)]
    got = mixture(spark, rows, block=40)
    assert len(got) == len(rows)
    tokens = defaultdict(int)
    for _, text, source, _ in rows:
        tokens[source] += len((text or "").split())
    weights, passes = brute_passes(tokens)
    blocks = defaultdict(list)
    for r in got:
        assert r.lw_weight == (pytest.approx(weights[r.source], rel=1e-6) if tokens[r.source] else None)
        blocks[r.source, r.lw_block].append(r)
    for (source, _), held in blocks.items():
        held.sort(key=lambda r: r.lw_place)
        whole, part = divmod(round(passes.get(source, 1.0), 7), 1)
        before, size = 0, sum(r.lw_tokens for r in held)
        for r in held:
            extra = part > 1e-6 and before + r.lw_tokens / 2 < part * size
            near_edge = part > 1e-6 and abs(before + r.lw_tokens / 2 - part * size) < 1e-3
            assert r.lw_copies == whole + extra or near_edge
            before += r.lw_tokens
    assert max(len(b) for b in blocks.values()) < 120  # no block has all of a source


def test_entropy_target_and_fixed_budget(spark):
    rows = [(i, "w " * 10, "abcd"[min(3, int(math.log2(1 + i / 60)))], 0) for i in range(2000)]
    got = mixture(spark, rows, entropy=0.95, budget=10_000, block=50)
    weights = {r.source: r.lw_weight for r in got}
    assert abs(-sum(w * math.log(w) for w in weights.values()) / math.log(len(weights)) - 0.95) < 1e-6
    assert abs(sum(r.lw_tokens * r.lw_copies for r in got) - 10_000) < 500


def test_odd_mixtures(spark):
    got = mixture(spark, [(1, None, None, 0), (2, "", "a", 0), (None, "a b", "b", 0), (3, "a b", None, 0), (3, "a b", None, 0)])
    assert sorted((r.doc_id or 0, r.lw_copies >= 1) for r in got) == [(0, True), (1, True), (2, True), (3, True), (3, True)]
    assert mixture(spark, []) == []
    df = spark.createDataFrame([(1, "a", "s", 5)], "doc_id long, text string, source string, lw int")
    assert mixing.mix(df).columns == df.columns and mixing.mix(df.where(F.lit(False))).count() == 0


def test_documents_without_words_stay_when_passes_round_down(spark):
    """Sources whose least passes come out an ulp below one in floating point, with empty texts in every block."""
    for sizes in ((n, n + 7 * k, 3 * n + k) for n in (11, 23, 37, 41) for k in (1, 2, 5)):
        shares = spark.createDataFrame([(str(i), n, 1, n / sum(sizes)) for i, n in enumerate(sizes)], "source string, tokens long, n long, share double")
        passes = [r.passes for a in (0.3, 0.55, 0.8) for r in mixing.source_passes(shares, a).collect()]
        assert not any(0.99 < p < 1 for p in passes)
    rows = [(i, "" if i % 3 else "w " * 9, "large", 0) for i in range(900)] + [(1000 + i, "w " * 9, "small", 0) for i in range(30)]
    assert all(r.lw_copies >= 1 for r in mixture(spark, rows, block=16))


def test_a_url_with_very_many_captures_is_found_in_one_block_each(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 50)
    url = "http://hot.example/page"
    rows = [(None if i == 0 else i, url if i % 4 else f"http://x.example/{i}", f"<p>{i}</p>") for i in range(4_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_archives(pages, str(tmp_path / "archive"))
    captures = warc.read_archives(spark, str(tmp_path / "archive")).persist()
    key, asked = warc.url_key(url), [i for i in range(4_000) if i % 4 and i % 3 == 0]
    for top in (10_000, 2):
        monkeypatch.setattr(warc, "TOP", top)
        monkeypatch.setattr(warc, "FAN", 4)
        index = warc.build_index(captures, str(tmp_path / f"index-{top}"))
        wanted = spark.createDataFrame([(key, i) for i in asked] + [("com,none)/", 5), (warc.url_key("http://x.example/0"), None)], "key string, page_id long")
        assert index.blocks_of(wanted).count() <= len(asked) + 2 + index.size // 10
        found = sorted((r.key, r.page_id or -1) for r in index.locate(wanted).collect())
        assert found == sorted([(key, i) for i in asked] + [(warc.url_key("http://x.example/0"), -1)])
