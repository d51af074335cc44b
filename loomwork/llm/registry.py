"""The queries of this subpackage and their SQL.

op1, op3, op8, op9 and op10 have no SQL (XXH64, merges, a trained network, hashed permutations). Tests hold these
against brute force, the tokenizers library, and held-out labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm.alignment import alignment_report
from loomwork.llm.bpe import count_report, encoding_report
from loomwork.llm.divergence import divergence_report
from loomwork.llm.language import language_report
from loomwork.llm import licenses
from loomwork.llm.licenses import license_report
from loomwork.llm.mixing import mixing_report
from loomwork.llm.quality import quality_report
from loomwork.llm.recompress import repeat_report
from loomwork.llm.simhash import fingerprint_report
from loomwork.llm.tokenfile import token_file_report
from loomwork.llm.topk import top_k
from loomwork.llm.warc import archive_report
from loomwork.session import table


def _over(make: Callable[[DataFrame], DataFrame], name: str = "documents") -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: make(table(spark, sf, name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": _over(fingerprint_report),
        "op2_warc": _over(archive_report, "pages"),
        "op3_bpe": _over(encoding_report),
        "op4_topk": _over(top_k, "embeddings"),
        "op5_quality_rules": _over(quality_report),
        "op6_substring_dedup": _over(repeat_report),
        "op7_licenses": _over(license_report),
        "op8_token_counts": _over(count_report),
        "op9_language": _over(language_report),
        "op10_mixing": _over(mixing_report),
        "op11_token_files": _over(token_file_report),
        "op12_alignment": _over(alignment_report),
        "op13_divergence": _over(divergence_report),
    }


_WORDS = r"words AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents)"


def _license_sql() -> str:
    """Phrases by position; blocks of each notice by counting its distinct words."""
    values = lambda rows: ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)
    words = lambda text: [w.decode() for w in licenses.words_of(text)]
    phrases = [(label, len(words(p)), " ".join(words(p))) for p, label in licenses.PHRASES.items()]
    notices = {label: (words(text), [" ".join(words(x)) for x in names]) for label, (text, names) in licenses.TEMPLATES.items()}
    kinds = [(label, len(w), len(set(w)), licenses.Template(label, tuple(set(w)), len(w)).need, names[0], names[-1]) for label, (w, names) in notices.items()]
    return rf"""
        WITH w AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
        phrases(label, n, phrase) AS (VALUES {values(phrases)}),
        base AS (SELECT doc_id, count(*) AS n, min(i) - 1 AS a, max(i) - 1 AS b, list(DISTINCT label) AS labels FROM
          (SELECT doc_id, label, n, phrase, w, unnest(range(1, len(w) - n + 2)) AS i FROM w, phrases WHERE array_to_string(w, ' ') LIKE '%' || phrase || '%')
          WHERE array_to_string(list_slice(w, i, i + n - 1), ' ') = phrase GROUP BY doc_id),
        kinds(label, m, n, need, name, version) AS (VALUES {values(kinds)}),
        terms(label, word) AS (VALUES {values([(label, x) for label, (w, _) in notices.items() for x in sorted(set(w))])}),
        near AS (SELECT doc_id, label, m, n, need, name, version, w, unnest(range(0, greatest(1, CAST(ceil(len(w) / m) AS BIGINT)))) AS b FROM w, kinds
          WHERE array_to_string(w, ' ') LIKE '%' || name || '%'),
        block AS (SELECT doc_id, label, b, n, need, name, version, list_slice(w, b * m + 1, b * m + 2 * m) AS part FROM near),
        held AS (SELECT doc_id, label, b, n, need, count(*) AS found FROM
          (SELECT doc_id, label, b, n, need, unnest(list_distinct(part)) AS word FROM block
           WHERE ' ' || array_to_string(part, ' ') || ' ' LIKE '% ' || name || ' %' AND ' ' || array_to_string(part, ' ') || ' ' LIKE '% ' || version || ' %')
          JOIN terms USING (label, word) GROUP BY ALL HAVING count(*) >= need),
        best AS (SELECT doc_id, list(DISTINCT label) AS labels, max(found / CAST(n AS DOUBLE)) AS score FROM held GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(base.n, 0) AS n_base, a AS first_word, base.b AS last_word,
          coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
          array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(best.labels, [])))), ',') AS labels,
          CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(best.score, 0.0) END AS score
        FROM w LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op7_licenses": _license_sql(),
        "op2_warc": """
            WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
            q AS (SELECT page_id, octet_length(raw) AS n, sha256(raw) AS d FROM p),
            f AS (SELECT d, min(page_id) AS first FROM q WHERE n >= 100 GROUP BY d)
            SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
                   CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN first < page_id THEN first END AS refers_to
            FROM q LEFT JOIN f USING (d)""",
        "op4_topk": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS a FROM embeddings),
            s AS (SELECT q.vec_id AS query_id, r.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.a, r.a), lambda x: x[1] * x[2])) AS BIGINT) AS score
                  FROM v q, v r WHERE q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id)
            SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
              (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
        "op5_quality_rules": rf"""
            WITH {_WORDS},
            tri AS (SELECT doc_id, i, list_slice(w, i, i + 2) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
            twice AS (SELECT doc_id, k FROM tri GROUP BY ALL HAVING count(*) > 1),
            cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri JOIN twice USING (doc_id, k)) GROUP BY doc_id),
            m AS (SELECT doc_id, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM words),
            f AS (SELECT m.*, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
                    n_words < 50 OR 100 * coalesce(c.n, 0) > 50 * n_words AS base_failed FROM m LEFT JOIN cover c USING (doc_id))
            SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
              NOT (base_failed OR n_symbols > 0.1 * n_words OR n_dup_lines > 0.5 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words
                   OR length(t) - length(replace(t, '!', '')) > 0.3 * n_words OR len(regexp_extract_all(t, '\p{{Lu}}{{2,}}')) > 0.6 * n_words) AS kept
            FROM f""",
        "op6_substring_dedup": rf"""
            WITH {_WORDS},
            win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)),
            f AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k),
            gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN f USING (k), (SELECT unnest(range(0, 13)) AS j) WHERE first < doc_id),
            kept AS (SELECT s.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t
                     FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM words) s ANTI JOIN gone g ON s.doc_id = g.doc_id AND s.p = g.p GROUP BY s.doc_id)
            SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (doc_id)""",
        "op13_divergence": r"""
            WITH d AS (SELECT row_number() OVER () AS k, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
            w AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
            c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT k) AS docs FROM w GROUP BY ALL),
            kept AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
            g AS (SELECT DISTINCT lang, source FROM d),
            v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
            gc AS (SELECT g.lang, g.source, kept.term, CAST(coalesce(c.n, 0) AS HUGEINT) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
            p AS (SELECT lang, source, term, gc.n, 1 + (1000000000 * (gc.n + 1)) // (sum(gc.n) OVER (PARTITION BY lang, source) + v) AS p FROM gc JOIN v USING (lang)),
            q AS (SELECT lang, term, 1 + (1000000000 * (kept.n + 1)) // (v.n + v) AS q FROM kept JOIN v USING (lang)),
            parts AS (
              SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
              FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
              UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b USING (lang) WHERE a.source <> b.source AND a.lang NOT IN (SELECT lang FROM v)
              UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
            SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM
              (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts) WHERE part = 'pair' OR rank <= 200""",
    }
