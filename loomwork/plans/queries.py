"""Queries over the given tables, one for each operator, and the SQL that gives the same rows.

`documents` plays the pages: a document is a page of its source, in the order of doc_id. `benchmark` holds the
question texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.models import ExtractiveGenerator, TermEmbedder, embed_column, generate_column
from loomwork.functions.text import is_blank, is_pdf_name, term_counts_column, term_matrix, verdict, verdict_or_error
from loomwork.operators import answers, chunking, embedding, retrieval, summary
from loomwork.operators.textindex import TextIndex
from loomwork.operators.vectorindex import VectorIndex
from loomwork.plans.engine import Engine, judged
from loomwork.session import scratch, table
from loomwork.sources.pdf import pdf_pages, text_pages, write_pdfs
from loomwork.sources.store import ChunkStore, insert_if_absent
from loomwork.streaming.incremental import ingest_pdf_stream

Query = Callable[[SparkSession, str], DataFrame]

NAMES = ["a.pdf", "B.PDF", "c.txt", "d.pdf.txt", ".pdf", "e.Pdf", "f g.pdf", ""]
QUESTIONS = ["", " ", "\t\n", " a ", "what?", "\r\n\f", "a\tb", "\x1c \x1f", "\x1e?"]
VERDICTS = ["True", "not true, false", "False.", "it is TRUE", " false\n"]


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.page_chunk_ids(chunking.stride_chunks(text_pages(table(spark, sf, "documents"))))


def chunk_stride(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.stride_chunks(text_pages(table(spark, sf, "documents"))).select("source", "page", "chunk", F.md5("text").alias("text_md5"), F.length("text").alias("n"))


def chunk_recursive(spark: SparkSession, sf: str) -> DataFrame:
    found = chunking.page_chunk_ids(chunking.recursive_chunks(text_pages(table(spark, sf, "documents"))))
    return found.select("id", F.md5("text").alias("text_md5"), F.length("text").alias("n"))


def chunk_ids_runlength(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in order as chunks, their language as source and a missing or small number as page: pages recur."""
    page = F.when(F.col("n_chars") % 3 > 0, F.col("n_chars") % 3)
    rows = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("source"), page.alias("page"))
    return chunking.run_length_ids(rows, ["doc_id"]).select("doc_id", "id")


def _vector_of(text: Column) -> Column:
    return embed_column(text, TermEmbedder())


def _store(spark: SparkSession, chunks: DataFrame) -> ChunkStore:
    """A store in the shared folder to which the chunks were added."""
    store = ChunkStore(spark, f"{scratch(spark, 'store')}/chunks")
    store.add(chunks, _vector_of)
    return store


def ingest_new_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that aren't in a store which holds those of the documents with an even id already."""
    chunks = _chunks(spark, sf)
    return insert_if_absent(chunks, _store(spark, chunks.where(F.col("page") % 2 == 0)).read()).select("id", F.md5("text").alias("text_md5"))


def existing_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _store(spark, _chunks(spark, sf)).ids()


def store_count(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(_store(spark, _chunks(spark, sf)).count(),)], "document_count long")


def _engine(spark: SparkSession, **parts) -> Engine:
    folder = scratch(spark, "engine")
    return Engine(spark, f"{folder}/store", f"{folder}/data", split=chunking.stride_chunks, **parts)


def ingest_twice(spark: SparkSession, sf: str) -> DataFrame:
    """All documents ingested two times: what each adds, and the status after it."""
    engine, pages = _engine(spark), text_pages(table(spark, sf, "documents"))
    told = [(n, engine.ingest(pages), engine.status().first().document_count) for n in (1, 2)]
    return spark.createDataFrame(told, "run int, added long, document_count long")


def reset_store(spark: SparkSession, sf: str) -> DataFrame:
    """The status after ingest, after reset, after another reset, and after ingest with reset."""
    engine, pages = _engine(spark), text_pages(table(spark, sf, "documents"))
    told, count = [], lambda: engine.status().first().document_count
    for n, step in enumerate((lambda: engine.ingest(pages), engine.reset, engine.reset, lambda: engine.ingest(pages, reset=True))):
        step()
        told.append((n, count()))
    return spark.createDataFrame(told, "step int, document_count long")


def upload_and_index(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark's texts as pages of one PDF file that a task writes, uploaded, and uploaded again unchanged; the chunks
    that are then stored."""
    engine, folder = _engine(spark), scratch(spark, "upload")
    write_pdfs(table(spark, sf, "benchmark").select(F.lit("benchmark.pdf").alias("name"), F.col("item_id").alias("page"), "text"), folder)
    for _ in range(2):
        engine.upload_file(f"{folder}/benchmark.pdf")
    stored = engine.store.read()
    return stored.select(F.substring_index("source", "/", -1).alias("name"), F.col("page").cast("int").alias("page"), "chunk", F.md5("text").alias("text_md5"))


def _pdf_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as pages (name, page, text) of files, one for each source and 500 ids."""
    name = F.concat(F.regexp_replace(F.coalesce("source", F.lit("None")), "[^A-Za-z0-9]", "_"), F.lit("-"), F.floor(F.col("doc_id") / 500), F.lit(".pdf"))
    return table(spark, sf, "documents").select(name.alias("name"), F.col("doc_id").alias("page"), "text")


def _pdf_folder(spark: SparkSession, sf: str) -> str:
    """A folder with these files, written in tasks."""
    folder = f"{scratch(spark, 'pdf')}/data"
    write_pdfs(_pdf_rows(spark, sf), folder)
    return folder


def pdf_source(spark: SparkSession, sf: str) -> DataFrame:
    """Every page of a folder of PDF files."""
    name = F.substring_index("source", "/", -1).alias("name")
    return pdf_pages(spark, _pdf_folder(spark, sf)).select(name, "page", F.length("text").alias("n"), F.md5("text").alias("text_md5"), F.coalesce("error", F.lit("")).alias("error"))


def ingest_pdfs(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks in the store after an engine has ingested its data folder of PDF files, twice."""
    engine = Engine(spark, f"{scratch(spark, 'engine')}/store", _pdf_folder(spark, sf), split=chunking.stride_chunks)
    for _ in range(2):
        engine.ingest()
    return engine.store.read().select(F.substring_index("id", "/", -1).alias("id"), F.md5("text").alias("text_md5"))


def ingest_pdf_changes(spark: SparkSession, sf: str) -> DataFrame:
    """PDF files ingested as they come: those of even blocks of ids, then all, then nothing new. How many files each run
    parses, and the chunks that are stored after it."""
    folder = scratch(spark, "changes")
    engine, rows = Engine(spark, f"{folder}/store", f"{folder}/data", split=chunking.stride_chunks), _pdf_rows(spark, sf)
    even = F.floor(F.col("page") / 500) % 2 == 0
    told, files = [], [0]
    for run, come in enumerate((even, ~even, None), 1):
        if come is not None:
            write_pdfs(rows.where(come), f"{folder}/data")
        files[0] = 0

        def seen(batch: DataFrame) -> None:
            files[0] += batch.select("source").distinct().count()

        ingest_pdf_stream(engine, f"{folder}/checkpoint", seen).awaitTermination()
        told.append((run, files[0], engine.store.count()))
    return spark.createDataFrame(told, "run int, files long, document_count long")


def health(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(_engine(spark).health()["status"],)], "status string")


def embed_terms(spark: SparkSession, sf: str) -> DataFrame:
    counts = _chunks(spark, sf).select("id", F.posexplode(term_counts_column(F.col("text"))).alias("bucket", "n"))
    return counts.where("n > 0").select("id", "bucket", F.col("n").cast("long").alias("n"))


def embed_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """A vector of every document by term vectors that are fitted on all documents."""
    docs = table(spark, sf, "documents")
    model = embedding.Sent(spark.sparkContext.broadcast(embedding.fit(docs)))
    return docs.select("doc_id", embed_column(F.col("text"), model).alias("vector"))


def text_top5(spark: SparkSession, sf: str) -> DataFrame:
    rows = _chunks(spark, sf).select("id", F.col("text").alias("vector"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("vector"))
    return retrieval.nearest(rows, asked, distance=retrieval.unit_distances, encode=term_matrix, id_type="string")


def text_index_top5(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of text_top5 from an index with block maxima, which looks at part of the blocks."""
    index = TextIndex.build(_chunks(spark, sf), f"{scratch(spark, 'index')}/texts")
    return index.search(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.with_texts(text_top5(spark, sf), _chunks(spark, sf), retrieval.K * table(spark, sf, "benchmark").count())


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def knn_batch(spark: SparkSession, sf: str) -> DataFrame:
    rows = _vectors(spark, sf)
    return retrieval.nearest(rows, rows.where("id % 20 = 0").withColumnRenamed("id", "query_id"))


def knn_single(spark: SparkSession, sf: str) -> DataFrame:
    rows = _vectors(spark, sf)
    return retrieval.nearest_to_one(rows, rows.where("id = 0").first()["vector"])


def _indexed(spark: SparkSession, sf: str) -> DataFrame:
    rows = _vectors(spark, sf)
    index = VectorIndex.build(rows, f"{scratch(spark, 'index')}/vectors")
    return index.search(rows.where("id % 20 = 0").withColumnRenamed("id", "query_id"))


def knn_index(spark: SparkSession, sf: str) -> DataFrame:
    """The searches of knn_batch through the approximate index."""
    return _indexed(spark, sf)


def knn_index_recall(spark: SparkSession, sf: str) -> DataFrame:
    """How many queries the index answers, and whether it finds 95 of 100 of their exact neighbours."""
    exact = knn_batch(spark, sf).select("query_id", "id")
    told = exact.join(_indexed(spark, sf).select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return told.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("neighbours"), (F.count("hit") >= 0.95 * F.count("*")).alias("enough"))


def context_assembly(spark: SparkSession, sf: str) -> DataFrame:
    return answers.contexts(_hits(spark, sf))


def source_list(spark: SparkSession, sf: str) -> DataFrame:
    return answers.source_lists(text_top5(spark, sf)).select("query_id", F.array_join("sources", ",").alias("sources"))


def prompt_render(spark: SparkSession, sf: str) -> DataFrame:
    questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return answers.contexts(_hits(spark, sf)).join(questions, "query_id").select("query_id", answers.prompt(F.col("context"), F.col("question")).alias("prompt"))


def empty_result_answer(spark: SparkSession, sf: str) -> DataFrame:
    """Every question against a store without chunks."""
    questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    none = spark.createDataFrame([], "query_id long, rank int, id string, text string")
    ready = answers.assembled(questions, none)
    return ready.select("query_id", F.when(F.size("texts") == 0, answers.NOTHING_FOUND).alias("answer"), F.size("sources").alias("n_sources"))


def answer_extractive(spark: SparkSession, sf: str) -> DataFrame:
    questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    ready = answers.assembled(questions, _hits(spark, sf))
    return ready.select("query_id", generate_column(F.coalesce("prompt", F.lit("")), F.col("texts"), ExtractiveGenerator()).alias("answer"), F.array_join("sources", ",").alias("sources"))


def _stored(spark: SparkSession, sf: str) -> Engine:
    """An engine whose store holds all documents."""
    engine = _engine(spark)
    engine.ingest(text_pages(table(spark, sf, "documents")))
    return engine


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def engine_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers and sources of all benchmark texts by the engine, from its written store."""
    return _stored(spark, sf).answers(_questions(spark, sf)).select("query_id", "answer", F.array_join("sources", ",").alias("sources"))


def engine_query(spark: SparkSession, sf: str) -> DataFrame:
    """One question, the first of the benchmark, as the command line and the API's route ask it."""
    question = _questions(spark, sf).orderBy("query_id").first().question
    told = _stored(spark, sf).query(question)
    return spark.createDataFrame([(told.answer, ",".join(told.sources))], "answer string, sources string")


def answer_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Each benchmark text answered by the sentences of its hits that a graph of them ranks best."""
    engine, questions = _stored(spark, sf), _questions(spark, sf)
    ready = answers.assembled(questions, engine.hits(questions))
    return summary.summaries(ready, engine.store.read().select("text"))


def judged_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the engine's answer to each benchmark text has that text in it, as its judge says."""
    cases = _questions(spark, sf).withColumn("expected", F.col("question"))
    return judged(_stored(spark, sf), cases, strict=False).select("query_id", "passed", F.coalesce("error", F.lit("")).alias("error"))


def _asked_texts(spark: SparkSession, sf: str) -> DataFrame:
    """All texts that a user may send: of the benchmark, and of the conversations."""
    asked = table(spark, sf, "benchmark").select(F.lit("benchmark").alias("kind"), F.col("item_id").alias("id"), F.lit(0).cast("long").alias("turn"), "text")
    return asked.union(table(spark, sf, "conversations").select(F.lit("conversation"), "conv_id", F.col("turn").cast("long"), "text"))


def blank_guard_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The guard on all texts, on what each has before its first letter, and on its white space alone."""
    white = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^ \t\n\r\f]", "")
    texts = _asked_texts(spark, sf).select("kind", "id", "turn", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.col("text").alias("t")), F.struct(F.lit(1).alias("part"), white.alias("t")))).alias("x"))
    return texts.select("kind", "id", "turn", "x.part", (~is_blank(F.col("x.t"))).alias("accepted"))


def file_guard_names(spark: SparkSession, sf: str) -> DataFrame:
    """The guard on file names made of all urls, with endings in both cases and without one."""
    ending = F.element_at(F.array(*map(F.lit, (".pdf", ".PDF", "", ".pdf.txt"))), (F.pmod(F.col("page_id"), F.lit(4)) + 1).cast("int"))
    names = table(spark, sf, "pages").select("page_id", F.concat(F.coalesce("url", F.lit("")), ending).alias("name"))
    return names.select("page_id", is_pdf_name(F.col("name")).alias("accepted"))


def judge_verdict_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The verdict that each text would be; what is neither is an error."""
    said = F.when(F.col("id") % 3 == 0, F.concat("text", F.lit(" TRUE"))).when(F.col("id") % 3 == 1, F.concat("text", F.lit(" False."))).otherwise(F.col("text"))
    told = _asked_texts(spark, sf).select("kind", "id", "turn", verdict_or_error(said).alias("v"))
    return told.select("kind", "id", "turn", F.when(F.col("v.error").isNotNull(), "error").otherwise(F.col("v.passed").cast("string")).alias("verdict"))


def _values(spark: SparkSession, texts: list[str], name: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), f"case_id int, {name} string")


def blank_query_guard(spark: SparkSession, sf: str) -> DataFrame:
    return _values(spark, QUESTIONS, "question").select("case_id", (~is_blank(F.col("question"))).alias("accepted"))


def file_type_guard(spark: SparkSession, sf: str) -> DataFrame:
    return _values(spark, NAMES, "name").select("case_id", is_pdf_name(F.col("name")).alias("accepted"))


def judge_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return _values(spark, VERDICTS, "said").select("case_id", verdict(F.trim("said")).alias("verdict"))


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            embed_vectors, text_top5, text_index_top5, knn_single, knn_batch, knn_index, knn_index_recall, chunk_stride, chunk_recursive, chunk_ids_runlength, ingest_new_chunks, existing_ids, store_count, embed_terms,
            ingest_twice, reset_store, upload_and_index, pdf_source, ingest_pdfs, ingest_pdf_changes, health,
            context_assembly, source_list, prompt_render, empty_result_answer, answer_extractive, blank_query_guard, file_type_guard, judge_verdict,
            engine_answers, engine_query, answer_sentences, judged_answers, blank_guard_texts, file_guard_names, judge_verdict_texts,
        )
    }


# --- SQL ---------------------------------------------------------------------------------------------------------

_STRIDE = """chunks AS (
  SELECT source, doc_id AS page, CAST(g.i AS INTEGER) AS chunk, substr(text, g.i * 720 + 1, 800) AS text,
         coalesce(source, 'None') || ':' || doc_id || ':' || g.i AS id
  FROM (SELECT *, greatest(0, CAST(ceil((length(text) - 800) / 720.0) AS BIGINT)) AS last FROM documents WHERE text IS NOT NULL) d,
       LATERAL (SELECT unnest(range(0, d.last + 1)) AS i) g)"""


_PDF = """pdf AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY name ORDER BY doc_id) - 1 AS INTEGER) AS page FROM (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_replace(coalesce(source, 'None'), '[^A-Za-z0-9]', '_', 'g') || '-' || CAST(floor(doc_id / 500) AS BIGINT) || '.pdf' AS name FROM documents))"""


def _terms(name: str, table_: str, key: str) -> str:
    return f"""{name} AS (
  SELECT k, b, count(*) AS n FROM (
    SELECT k, CAST('0x' || substr(md5(t), 1, 6) AS BIGINT) % 256 AS b
    FROM (SELECT {key} AS k, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS t FROM {table_}) WHERE t <> '') GROUP BY k, b)"""


_TOP5 = f"""{_STRIDE}, {_terms("ct", "chunks", "id")}, {_terms("qt", "benchmark", "item_id")},
cn AS (SELECT c.id, coalesce(sum(n * n), 0) AS s FROM chunks c LEFT JOIN ct ON c.id = ct.k GROUP BY c.id),
qn AS (SELECT q.item_id, coalesce(sum(n * n), 0) AS s FROM benchmark q LEFT JOIN qt ON q.item_id = qt.k GROUP BY q.item_id),
dots AS (SELECT qt.k AS item_id, ct.k AS id, sum(qt.n * ct.n) AS dot FROM qt JOIN ct ON qt.b = ct.b GROUP BY 1, 2),
dists AS (
  SELECT qn.item_id AS query_id, cn.id,
         round(CASE WHEN qn.s > 0 AND cn.s > 0 THEN 2 - 2 * CAST(coalesce(dot, 0) AS DOUBLE) / (sqrt(CAST(cn.s AS DOUBLE)) * sqrt(CAST(qn.s AS DOUBLE)))
                    WHEN qn.s = 0 AND cn.s = 0 THEN 0.0 ELSE 1.0 END, 6) AS dist
  FROM qn CROSS JOIN cn LEFT JOIN dots ON dots.item_id = qn.item_id AND dots.id = cn.id),
top5 AS (
  SELECT query_id, CAST(rank AS INTEGER) AS rank, id, dist FROM
    (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM dists) WHERE rank <= 5)"""

# As _TOP5, by the vectors in the store: scaled to unit length, in 32 bits.
_STORED5 = f"""{_STRIDE}, {_terms("ct", "chunks", "id")}, {_terms("qt", "benchmark", "item_id")},
cw AS (SELECT k, b, CAST(CAST(n / sqrt(CAST(sum(n * n) OVER (PARTITION BY k) AS DOUBLE)) AS FLOAT) AS DOUBLE) AS w FROM ct),
qw AS (SELECT k, b, CAST(CAST(n / sqrt(CAST(sum(n * n) OVER (PARTITION BY k) AS DOUBLE)) AS FLOAT) AS DOUBLE) AS w FROM qt),
cn AS (SELECT c.id, coalesce(sum(w * w), 0) AS s FROM chunks c LEFT JOIN cw ON c.id = cw.k GROUP BY c.id),
qn AS (SELECT q.item_id, coalesce(sum(w * w), 0) AS s FROM benchmark q LEFT JOIN qw ON q.item_id = qw.k GROUP BY q.item_id),
dots AS (SELECT qw.k AS item_id, cw.k AS id, sum(qw.w * cw.w) AS dot FROM qw JOIN cw ON qw.b = cw.b GROUP BY 1, 2),
dists AS (SELECT qn.item_id AS query_id, cn.id, round(abs(qn.s + cn.s - 2 * coalesce(dot, 0)), 6) AS dist
  FROM qn CROSS JOIN cn LEFT JOIN dots ON dots.item_id = qn.item_id AND dots.id = cn.id),
top5 AS (
  SELECT query_id, CAST(rank AS INTEGER) AS rank, id, dist FROM
    (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM dists) WHERE rank <= 5),
answered AS (SELECT query_id, max(CASE WHEN rank = 1 THEN text END) AS answer, string_agg(id, ',' ORDER BY rank) AS sources FROM top5 JOIN chunks USING (id) GROUP BY query_id)"""

_ASKED = """asked AS (SELECT 'benchmark' AS kind, item_id AS id, CAST(0 AS BIGINT) AS turn, text FROM benchmark
  UNION ALL SELECT 'conversation', conv_id, turn, text FROM conversations)"""

_KNN = """SELECT {q} id, CAST(rank AS INTEGER) AS rank, dist FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM (
    SELECT q.vec_id AS query_id, r.vec_id AS id,
           round(list_sum(list_transform(list_zip(r.embedding, q.embedding), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)))), 6) AS dist
    FROM embeddings r, embeddings q WHERE {where})) WHERE rank <= 5"""


def _sql_values(texts: list[str]) -> str:
    escaped = [t.replace("\t", "'||chr(9)||'").replace("\n", "'||chr(10)||'").replace("\r", "'||chr(13)||'").replace("\f", "'||chr(12)||'") for t in texts]
    escaped = [re.sub("[\x1c-\x1f]", lambda m: f"'||chr({ord(m[0])})||'", t) for t in escaped]
    return "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(escaped)) + ") v(case_id, t)"


def oracle_sql() -> dict[str, str]:
    sep = answers.SEPARATOR.replace("\n", "'||chr(10)||'")
    context = f"SELECT query_id, string_agg(text, '{sep}' ORDER BY rank) AS context FROM top5 JOIN chunks USING (id) GROUP BY query_id"
    before, after = "Use only the passages below to answer.", "With these passages alone, answer this question: "
    nl = "chr(10)"
    return {
        "text_top5": f"WITH {_TOP5} SELECT * FROM top5",
        "text_index_top5": f"WITH {_TOP5} SELECT * FROM top5",
        "knn_single": _KNN.format(q="", where="q.vec_id = 0"),
        "knn_batch": _KNN.format(q="query_id,", where="q.vec_id % 20 = 0"),
        "knn_index_recall": f"SELECT count(DISTINCT query_id) AS queries, count(*) AS neighbours, true AS enough FROM ({_KNN.format(q='query_id,', where='q.vec_id % 20 = 0')})",
        "chunk_stride": f"WITH {_STRIDE} SELECT source, page, chunk, md5(text) AS text_md5, CAST(length(text) AS INTEGER) AS n FROM chunks",
        "chunk_ids_runlength": """
            SELECT doc_id, key || ':' || (row_number() OVER (PARTITION BY island ORDER BY doc_id) - 1) AS id FROM (
              SELECT *, sum(start) OVER (ORDER BY doc_id) AS island FROM (
                SELECT *, CASE WHEN key = lag(key) OVER (ORDER BY doc_id) THEN 0 ELSE 1 END AS start FROM (
                  SELECT doc_id, coalesce(lang, 'None') || ':' || coalesce(CAST(nullif(n_chars % 3, 0) AS VARCHAR), 'None') AS key FROM documents)))""",
        "ingest_new_chunks": f"WITH {_STRIDE} SELECT id, md5(text) AS text_md5 FROM chunks WHERE id NOT IN (SELECT id FROM chunks WHERE page % 2 = 0)",
        "existing_ids": f"WITH {_STRIDE} SELECT id FROM chunks",
        "store_count": f"WITH {_STRIDE} SELECT count(*) AS document_count FROM chunks",
        "ingest_twice": f"WITH {_STRIDE} SELECT CAST(run AS INTEGER) AS run, CASE WHEN run = 1 THEN n ELSE 0 END AS added, n AS document_count FROM (SELECT count(*) AS n FROM chunks), (VALUES (1), (2)) v(run)",
        "reset_store": f"WITH {_STRIDE} SELECT CAST(step AS INTEGER) AS step, CASE WHEN step IN (0, 3) THEN n ELSE 0 END AS document_count FROM (SELECT count(*) AS n FROM chunks), (VALUES (0), (1), (2), (3)) v(step)",
        "upload_and_index": """
            SELECT 'benchmark.pdf' AS name, CAST(page AS INTEGER) AS page, CAST(i AS INTEGER) AS chunk, md5(substr(text, i * 720 + 1, 800)) AS text_md5 FROM (
              SELECT page, text, unnest(range(0, greatest(0, CAST(ceil((length(text) - 800) / 720.0) AS BIGINT)) + 1)) AS i FROM (
                SELECT row_number() OVER (ORDER BY item_id) - 1 AS page, coalesce(text, '') AS text FROM benchmark))""",
        "pdf_source": f"WITH {_PDF} SELECT name, page, CAST(length(text) AS INTEGER) AS n, md5(text) AS text_md5, '' AS error FROM pdf",
        "ingest_pdfs": f"""WITH {_PDF}
            SELECT name || ':' || page || ':' || i AS id, md5(substr(text, i * 720 + 1, 800)) AS text_md5 FROM (
              SELECT name, page, text, unnest(range(0, greatest(0, CAST(ceil((length(text) - 800) / 720.0) AS BIGINT)) + 1)) AS i FROM pdf)""",
        "ingest_pdf_changes": f"""WITH {_PDF},
            file AS (SELECT name, floor(min(doc_id) / 500) % 2 AS odd, sum(greatest(0, CAST(ceil((length(text) - 800) / 720.0) AS BIGINT)) + 1) AS n FROM pdf GROUP BY name)
            SELECT CAST(run AS INTEGER) AS run, CAST(count(*) FILTER (WHERE odd = run - 1) AS BIGINT) AS files, CAST(coalesce(sum(n) FILTER (WHERE odd < run), 0) AS BIGINT) AS document_count
            FROM file, (VALUES (1), (2), (3)) v(run) GROUP BY run""",
        "health": "SELECT 'ok' AS status",
        "answer_extractive": f"""WITH {_TOP5}
            SELECT query_id, max(CASE WHEN rank = 1 THEN text END) AS answer, string_agg(id, ',' ORDER BY rank) AS sources FROM top5 JOIN chunks USING (id) GROUP BY query_id""",
        "embed_terms": f"WITH {_STRIDE}, {_terms('ct', 'chunks', 'id')} SELECT k AS id, CAST(b AS INTEGER) AS bucket, n FROM ct",
        "context_assembly": f"WITH {_TOP5} {context}",
        "source_list": f"WITH {_TOP5} SELECT query_id, string_agg(id, ',' ORDER BY rank) AS sources FROM top5 GROUP BY query_id",
        "prompt_render": f"""WITH {_TOP5}, c AS ({context})
            SELECT query_id, '{before}' || {nl} || {nl} || context || {nl} || {nl} || '---' || {nl} || {nl} || '{after}' || text || {nl} AS prompt
            FROM c JOIN benchmark ON item_id = query_id""",
        "empty_result_answer": f"SELECT item_id AS query_id, '{answers.NOTHING_FOUND}' AS answer, CAST(0 AS INTEGER) AS n_sources FROM benchmark",
        "engine_answers": f"WITH {_STORED5} SELECT * FROM answered",
        "engine_query": f"WITH {_STORED5} SELECT answer, sources FROM answered WHERE query_id = (SELECT min(item_id) FROM benchmark)",
        "blank_guard_texts": f"""WITH {_ASKED} SELECT kind, id, turn, part, part = 0 AND regexp_matches(coalesce(text, ''), '[^ \\t\\n\\r\\f\\x0b\\x1c-\\x1f]') AS accepted
            FROM asked, (VALUES (0), (1)) v(part)""",
        "file_guard_names": "SELECT page_id, suffix(coalesce(url, '') || CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' WHEN 2 THEN '' ELSE '.pdf.txt' END, '.pdf') AS accepted FROM pages",
        "judge_verdict_texts": f"""WITH {_ASKED}, said AS (SELECT kind, id, turn, lower(CASE id % 3 WHEN 0 THEN text || ' TRUE' WHEN 1 THEN text || ' False.' ELSE text END) AS s FROM asked)
            SELECT kind, id, turn, CASE WHEN contains(s, 'true') THEN 'true' WHEN contains(s, 'false') THEN 'false' ELSE 'error' END AS verdict FROM said""",
        "blank_query_guard": f"SELECT CAST(case_id AS INTEGER) AS case_id, regexp_matches(t, '[^ \\t\\n\\r\\f\\x0b\\x1c-\\x1f]') AS accepted FROM {_sql_values(QUESTIONS)}",
        "file_type_guard": f"SELECT CAST(case_id AS INTEGER) AS case_id, suffix(t, '.pdf') AS accepted FROM {_sql_values(NAMES)}",
        "judge_verdict": f"SELECT CAST(case_id AS INTEGER) AS case_id, CASE WHEN contains(lower(t), 'true') THEN true WHEN contains(lower(t), 'false') THEN false END AS verdict FROM {_sql_values(VERDICTS)}",
    }
