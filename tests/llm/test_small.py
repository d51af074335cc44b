"""Licenses, top-k and languages against brute force and held-out labels."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import language, licenses, topk
from loomwork.session import table


def brute_top(rows, k=20, every=20):
    rows = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(rows):
        if q % every == 0:
            best = sorted((-int(a @ b), i) for m, (i, b) in enumerate(rows) if m != n and len(b) == len(a))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [65_536, 70])
def test_top_k_matches_brute_force(spark, sf, block_rows, monkeypatch):
    monkeypatch.setattr(topk, "LEAST_QUERIES", 3)
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").select("vec_id", "embedding").collect()]
    rows += [(10_000, rows[3][1]), (10_001, rows[3][1]), (10_020, None), (10_040, [float("nan")] * 64), (10_060, [None] * 64), (10_080, [0.5, -2.0]), (10_081, [1.0, 9.5]), (10_082, []), (None, rows[0][1])]
    rows += [(20, rows[7][1]), rows[20], rows[20], (36, rows[8][1]), rows[36]]  # repeated queries and candidates, equal and not
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = sorted(tuple(r) for r in topk.top_k(df, block_rows=block_rows, block_queries=9).collect())
    assert got == brute_top([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows])


def test_top_k_of_large_components(spark):
    rows = [(i, [(-1.0) ** i * 1e5 * (i + 1), 3.7]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == brute_top(rows)
    for bad in (1e9, 1e18, 1e300):
        with pytest.raises(ValueError, match="too large"):
            topk.top_k(df.union(spark.createDataFrame([(90, [bad, 0.0])], df.schema)))


def test_top_k_of_ties_and_nothing(spark):
    df = spark.createDataFrame([(i, [0.25, -0.25]) for i in range(50)], "vec_id long, embedding array<float>")
    got = topk.top_k(df).where("query_id = 20").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [i for i in range(21) if i != 20]
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.limit(1)).count() == 0


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_labels(text):
    """Label to containment of the templates that any block holds enough of, by looking at every block."""
    words, found = brute_words(text), {}
    for label, (template, names) in licenses.TEMPLATES.items():
        wanted, names = set(brute_words(template)), [brute_words(name) for name in names]
        n, m = len(wanted), len(brute_words(template))
        for at in range(0, max(1, len(words)), m):
            block = words[at : at + 2 * m]
            if len(wanted & set(block)) >= 0.8 * n - 1e-9 and all(any(block[i : i + len(name)] == name for i in range(len(block))) for name in names):
                found[label] = max(found.get(label, 0), len(wanted & set(block)) / n)
    return found


FALSE_LICENSES = {
    "Photos are licensed under CC BY 4.0": "cc-by",
    "released under the apache license": "apache",
    "It has the GNU General Public License version 2": "gpl",
    "released under the license": "",
    "Licensed under the GNU license version 2.0": "",
    "See the License for the specific language governing permissions and limitations under the License. " * 4: "",
    "this program is distributed in the hope that it will be useful but without any warranty": "",
}


def test_short_mentions_get_no_label_of_the_method(spark):
    df = spark.createDataFrame(list(enumerate(FALSE_LICENSES)), "doc_id long, text string")
    got = {FALSE_LICENSES[t]: r for t, r in zip(FALSE_LICENSES, licenses.license_report(df).orderBy("doc_id").collect())}
    assert all(r.labels == want == r.base_labels for want, r in got.items())


def test_notices_are_told_apart(spark):
    """A notice with some words changed keeps its label; one of another version or license doesn't get it."""
    gpl3 = licenses.TEMPLATES["gpl-3.0"][0]
    texts = {
        gpl3: {"gpl-3.0", "gpl"},
        gpl3.replace("version 3", "version 2"): {"gpl-2.0", "gpl"},
        "x y z " * 300 + licenses.TEMPLATES["mit"][0].replace("software", "program") + " tail" * 200: {"mit"},
        licenses.TEMPLATES["isc"][0]: {"isc"},
        licenses.TEMPLATES["apache-2.0"][0]: {"apache-2.0", "apache"},
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = licenses.license_report(df).orderBy("doc_id").collect()
    assert [set(r.labels.split(",")) for r in rows] == list(texts.values())


# Notices as they stand in files, not made from the templates.
_AGPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
 * Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
 * later version.
 * This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
 * warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU Affero General Public License for more details.
 * You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
_LGPL = _AGPL.replace("Affero General", "Lesser General").replace("This program", "This library").replace("this program", "this library")
_BSD_CONDITIONS = """Copyright (c) 2020, Somebody. All rights reserved.
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.
* Redistributions in binary form must reproduce the above copyright notice,
  this list of conditions and the following disclaimer in the documentation
  and/or other materials provided with the distribution.
"""
_BSD_3 = """* Neither the name of the project nor the names of its
  contributors may be used to endorse or promote products derived from
  this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
_ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""


@pytest.mark.parametrize(
    "text, labels",
    [
        (_AGPL, "agpl-3.0"),
        (_LGPL, "lgpl-3.0"),
        (_LGPL.replace("version 3", "version 2.1"), "lgpl-2.1"),
        (_AGPL.replace("Affero ", ""), "gpl,gpl-3.0"),
        (_BSD_CONDITIONS + _BSD_3 + _BSD_END, "bsd-3-clause"),
        (_BSD_CONDITIONS + _BSD_END, "bsd-2-clause"),
        (_BSD_CONDITIONS, ""),  # as well the head of the one as of the other
        (_ZERO_BSD, "0bsd"),
        (_MPL, "mpl-2.0"),
        ("SPDX: none. " + _ZERO_BSD.replace("granted.", "granted, provided that the above copyright notice and this permission notice appear in all copies."), "isc"),
    ],
)
def test_relatives_of_a_license_are_told_apart(text, labels):
    ordered = [licenses.Template(label, tuple(sorted(set(licenses.words_of(t)))), len(licenses.words_of(t)), tuple(tuple(licenses.words_of(n)) for n in names)) for label, (t, names) in licenses.TEMPLATES.items()]
    assert licenses.scan_text("some code here\n" + text + "\nmore code", ordered)[5] == labels


def test_license_scan_matches_brute_force(spark, sf):
    texts = [r.text for r in table(spark, sf, "documents").select("text").collect()]
    texts += [None, "", "...", "MIT License mit license", "CC BY-NC 4.0 CC, BY", "x " * 30_000 + "Apache License", "éß MIT\x00License",
              "Released, quite freely, under MIT License terms", " ".join(t for t, _ in licenses.TEMPLATES.values()), *(f"a {t} b" for t, _ in licenses.TEMPLATES.values()), *FALSE_LICENSES]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    got = licenses.license_report(df).orderBy("doc_id").collect()
    assert len(got) == len(texts)
    for row, text in zip(got, texts):
        assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == brute_base(text)
        base = {x for x in row.base_labels.split(",") if x}
        like = brute_labels(text)
        assert {x for x in row.labels.split(",") if x} == base | set(like)
        assert row.score == pytest.approx(1.0 if base else max(like.values(), default=0.0))
    assert licenses.license_report(df.limit(0)).count() == 0


def test_language_held_out_accuracy_and_cases(spark, sf):
    docs = table(spark, sf.replace("0.001", "0.01"), "documents")
    rows = language.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) > 0
    odd = docs.select("doc_id", "text", "lang").limit(100).union(spark.createDataFrame([(7, None, "en"), (8, "12 !?", "en"), (9, "", None), (None, "and the of", "fr")], "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in language.language_report(odd.withColumn("score", odd["doc_id"])).collect()[-4:]}
    assert [(got[i].lang_pred, got[i].score) for i in (7, 8, 9)] == [("und", 0.0)] * 3
    assert got[None].held_out is False and got[None].lang_pred != "und"
    assert language.language_report(odd.limit(0)).count() == 0


def brute_languages(net, text):
    """Mean probabilities by plain loops over windows, places and filters."""
    total, n = np.zeros(len(net.languages)), 0
    for at in range(0, len(text), language.WINDOW):
        part = text[at : at + language.WINDOW]
        x = part + bytes(language.WINDOW - len(part))
        hidden = []
        for w, table_, bias in zip(language.WIDTHS, net.filters, net.bias):
            for f in range(language.FILTERS):
                hidden.append(max(0.0, max(sum(float(table_[k][x[i + k]][f]) for k in range(w)) for i in range(language.WINDOW - w + 1)) + float(bias[f])))
        z = np.array(hidden) @ net.out.astype(float) + net.out_bias
        e = np.exp(z - z.max())
        total, n = total + len(part) * e / e.sum(), n + len(part)
    return total / max(n, 1)


def test_network_equals_plain_convolution(spark, sf):
    rng = np.random.default_rng(4)
    net = language.ByteNet(["a", "b", "c"])
    net.bias += rng.normal(0, 0.5, net.bias.shape).astype(np.float32)
    texts = ["", "a", "one two " * 40, "好" * 300, "é" * 128, *(r.text[:700] for r in table(spark, sf, "documents").limit(4).collect())]
    got = net.languages_of([t.encode() for t in texts])
    for row, text in zip(got, texts):
        assert np.allclose(row, brute_languages(net, text.encode()), atol=1e-5)


def test_gradients_equal_differences():
    rng = np.random.default_rng(6)
    net = language.ByteNet(["a", "b"], seed=3)
    x, wanted = rng.integers(0, 256, (3, language.WINDOW)).astype(np.uint8), np.array([0, 1, 1])
    params = net.parameters()
    for p in params:
        p += rng.normal(0, 0.1, p.shape).astype(np.float32)
    loss = lambda: -np.log(net.predict(x)[np.arange(3), wanted]).mean()
    grads = net._gradients(x, wanted)
    for p, g in list(zip(params, grads))[-3:]:
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at], up = old + 1e-2, None
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.05, abs=1e-4)


def test_training_sees_whole_texts(spark, monkeypatch):
    """Only the end of the texts tells the languages apart; all windows of a sampled document may be learned from."""
    rows = [(i, "0 1 2 3 " * 120 + (" und" if i % 2 else " the") * 300, "de" if i % 2 else "en") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.training_windows(docs, 120, 10_000).collect()
    per_doc = {r.lang: r.n for r in spark.createDataFrame(found).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    kept = docs.where(~language.is_held_out(F.col("doc_id"))).groupBy("lang").count().collect()
    assert per_doc == {r.lang: r["count"] * 9 for r in kept}
    assert len(language.training_windows(docs, 120, 50).collect()) == 50
    again = language.language_report(docs).collect()
    assert all(r.lang_pred == ("de" if r.doc_id % 2 else "en") for r in again)


def test_language_of_repeated_rows_long_texts_and_ties(spark):
    docs = spark.createDataFrame([(i, "und der die das " * 20, "de") for i in range(9)] + [(20 + i, "and the of to " * 20, "en") for i in range(9)] + [(50, "and the of to " * 40_000, None)] * 2, "doc_id long, text string, lang string")
    rows = language.language_report(docs).where("doc_id = 50").collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0].lang_pred == "en"
    net = language.ByteNet(["x", "y"])
    net.out[:] = 0  # equal probabilities: the first language by name
    told = docs.limit(2).select(language.predict_column(spark, F.col("text"), net).alias("p")).collect()
    assert {r.p.lang for r in told} == {"x"}


def test_filter_gradients_equal_differences():
    rng = np.random.default_rng(8)
    net = language.ByteNet(["a", "b"], seed=5)
    x, wanted = rng.integers(0, 256, (3, language.WINDOW)).astype(np.uint8), np.array([0, 1, 1])

    def loss():
        net.__dict__.pop("tables", None)  # made of the filters
        return -np.log(net.predict(x).astype(np.float64)[np.arange(3), wanted]).mean()

    grads = net._gradients(x, wanted)
    for p, g in zip(net.filters, grads):
        assert np.abs(g).max() > 0
        for at in zip(*np.unravel_index(np.argsort(-np.abs(g), axis=None)[:3], g.shape)):
            old, ends = p[at], []
            for step in (2e-3, -2e-3):  # small enough for the largest of a filter to stay where it is
                p[at] = old + np.float32(step)
                ends.append(loss())
            p[at] = old
            assert (ends[0] - ends[1]) / 4e-3 == pytest.approx(g[at], rel=0.1, abs=1e-3)
