"""Embedding, vector search and keyword search on the driver tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tripweave.functions.stemming import stems_sql
from tripweave.functions.text import STOP_WORDS, is_stop_word, tokens
from tripweave.operators import postings, textsearch, vectors
from tripweave.plans.mapping import Tables
from tripweave.schemas import EMBEDDING_DIM
from tripweave.sources.tables import new_path

#: Cells that the registered queries probe of each vector's cells.
PROBES = 8
LANGUAGES = ("de", "en", "es", "fr")


def _texts(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", "text")


def embed_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Properties of the hashed vector of every document."""
    rows = vectors.embed(_texts(Tables(spark, folder)), "text", ["doc_id"])

    def square_sum(a):
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.select(
        "doc_id", F.size("embedding").alias("dimensions"),
        F.size(F.filter("embedding", lambda x: x > 0)).alias("used_buckets"),
        F.array_position("embedding", F.array_max("embedding")).alias("heaviest_bucket"),
        F.round(F.array_max("embedding").cast("double"), 5).alias("heaviest_weight"),
        F.round(F.sqrt(square_sum(F.col("embedding"))), 4).alias("length"))


def _vector_queries(t: Tables) -> DataFrame:
    """All vectors whose id is divisible by 50, searched among those of their label."""
    return t.raw("embeddings").filter(F.col("vec_id") % 50 == 0).withColumnRenamed("vec_id", "query_id")


def semantic_topk(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return vectors.cosine_top_k(t.raw("embeddings"), _vector_queries(t), ["label"], doc_id="vec_id")


def semantic_topk_batch(spark: SparkSession, folder: str) -> DataFrame:
    """All benchmark texts searched in the documents of one language each, both embedded
    here; the wished number of results runs from 0 to 12."""
    t = Tables(spark, folder)
    documents = vectors.embed(t.raw("documents"), "text", ["doc_id", "lang"]).withColumnsRenamed(
        {"doc_id": "activity_id", "lang": "destination_name"})
    about = t.raw("documents").select(
        F.col("doc_id").alias("activity_id"), F.col("lang").alias("destination_name"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("name"),
        F.col("source").alias("category"), (F.col("n_chars") % 2 == 0).alias("indoor"),
        F.col("lang").alias("description"))
    language = F.element_at(F.array(*[F.lit(x) for x in LANGUAGES]), (F.col("item_id") % 4 + 1).cast("int"))
    asked = vectors.embed(
        t.raw("benchmark").select(
            F.col("item_id").alias("query_id"), language.alias("destination_name"),
            (F.col("item_id") % 13).cast("int").alias("wished"), "text"),
        "text", ["query_id", "destination_name", "wished"])
    return vectors.semantic_search(documents, about, asked, limit="wished")


def _celled(t: Tables) -> tuple[DataFrame, np.ndarray]:
    """The vectors as a table by cell, and the learned cells."""
    every = t.raw("embeddings")
    middle = vectors.train_cells(every, "vec_id", "embedding")
    path = new_path(every.sparkSession, "cells")
    vectors.write_by_cell(every, path, "embedding", middle)
    schema = T.StructType([*every.schema.fields, T.StructField("cell", T.IntegerType())])
    return every.sparkSession.read.schema(schema).parquet(path), middle


def semantic_ann(spark: SparkSession, folder: str) -> DataFrame:
    """Approximate search in a table that is written by learned cells first."""
    t = Tables(spark, folder)
    celled, middle = _celled(t)
    return vectors.approximate_top_k(celled, _vector_queries(t), ["label"], middle, PROBES, doc_id="vec_id")


def ann_recall(spark: SparkSession, folder: str) -> DataFrame:
    """What the approximate search finds of the exact one's rows, and how many rows it reads."""
    t = Tables(spark, folder)
    celled, middle = _celled(t)
    near = vectors.approximate_top_k(celled, _vector_queries(t), ["label"], middle, PROBES, doc_id="vec_id")
    found = vectors.recall(semantic_topk(spark, folder), near, doc_id="vec_id")
    return found.join(vectors.rows_read(celled, _vector_queries(t), ["label"], middle, PROBES), "query_id")


def _keyword_queries(t: Tables) -> DataFrame:
    """A query per benchmark text, of six kinds: two words, a phrase, either word, one word
    without the other, without a word, and part of a part name; and a blank one for each."""
    words = F.filter(tokens(F.col("text")), lambda w: ~is_stop_word(w) & (F.length(w) > 3))
    a, b = F.try_element_at("w", F.lit(1)), F.try_element_at("w", F.lit(2))
    every = tokens(F.col("text"))
    kind = F.col("item_id") % 6
    q = (F.when(kind == 0, F.concat_ws(" ", a, b))
         .when(kind == 1, F.concat(F.lit('"'), F.concat_ws(" ", F.slice("every", 1, 2)), F.lit('"')))
         .when(kind == 2, F.concat(a, F.lit(" or "), b))
         .when(kind == 3, F.concat(a, F.lit(" -"), b))
         .when(kind == 4, F.concat(F.lit("-"), a))
         .otherwise(F.element_at(F.array(*[F.lit(x) for x in ("BOLT", "small g", "omo", "%d_w")]),
                                 (F.col("item_id") % 4 + 1).cast("int"))))
    asked = t.raw("benchmark").withColumns({"w": words, "every": every}).select(
        F.col("item_id").alias("query_id"), q.alias("q"))
    return asked.unionByName(asked.select((-F.col("query_id") - 1).alias("query_id"), F.lit(" \t").alias("q")))


SEARCH_COLUMNS = ("query_id", "rank", "activity_id", "name", "category", "indoor", "embedded", "relevance")


def _searched_documents(t: Tables) -> DataFrame:
    return t.raw("documents").select(
        F.col("doc_id").alias("activity_id"), F.col("text").alias("document_text"),
        F.when(F.col("lang") == "en", F.col("n_chars")).alias("embedding"))


def _text_search(t: Tables, stemmed: bool) -> DataFrame:
    found = textsearch.keyword_search(t.activities(), _searched_documents(t), _keyword_queries(t), stemmed=stemmed)
    return found.select(*SEARCH_COLUMNS)


def text_search(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword search with words as they are spelled, which SQL can repeat."""
    return _text_search(Tables(spark, folder), stemmed=False)


def text_search_stemmed(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword search by English stems; the twin runs the stemmer's steps as subqueries."""
    return _text_search(Tables(spark, folder), stemmed=True)


def text_search_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """The stemmed search from stored postings: all documents are indexed, those with an id
    divisible by seven under a text that is replaced in a second generation."""
    t = Tables(spark, folder)
    documents, path = _searched_documents(t), new_path(spark, "index")
    late = F.col("activity_id") % 7 == 0
    postings.add_documents(documents.withColumn("document_text", F.when(late, F.reverse("document_text")).otherwise(
        F.col("document_text"))), path)
    postings.add_documents(documents.filter(late), path)
    return postings.search(spark, path, t.activities(), _keyword_queries(t)).select(*SEARCH_COLUMNS)


QUERIES = {f.__name__: f for f in (
    embed_documents, semantic_topk, semantic_topk_batch, semantic_ann, ann_recall, text_search,
    text_search_stemmed, text_search_indexed)}

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_BUCKET = f"('0x' || substr(md5(term), 1, 8))::BIGINT % {EMBEDDING_DIM}"


def _vectors(name: str, table: str, key: str) -> str:
    """Non-zero components of the hashed unit vectors, as single-precision values."""
    return f"""
    {name}_counts AS (
        SELECT {key} AS id, {_BUCKET} AS bucket, CAST(count(*) AS DOUBLE) AS n
        FROM (SELECT {key}, unnest({_WORDS}) AS term FROM {table})
        WHERE term NOT IN ({_STOP}) GROUP BY 1, 2),
    {name} AS (
        SELECT id, bucket, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE) AS x
        FROM {name}_counts)"""


_VECTORS = """
    d AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    q AS (SELECT vec_id AS query_id, label, v FROM d WHERE vec_id % 50 = 0)"""

_EXACT = """
    exact AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER)
               AS rank, vec_id, round(score, 4) AS similarity
        FROM (SELECT query_id, vec_id, round(list_cosine_similarity(d.v, q.v), 9) AS score
              FROM q JOIN d ON d.label = q.label)
        QUALIFY rank <= 5)"""


def _nearest(source: str, cells: str, n: int) -> str:
    return f"""
        SELECT vec_id, cell FROM (SELECT u.vec_id, c.cell, round(list_dot_product(u.v, c.v), 9) AS s FROM {source} u, {cells} c)
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cell) <= {n}"""


def _cells_sql() -> str:
    """Units, the sample, the rounds of learning one after the other, and the cells of all vectors."""
    def rounded(v: str) -> str:
        return f"list_transform({v}, lambda x: round(x, {vectors.CELL_DECIMALS}))"
    parts = [f"""
    units AS (SELECT vec_id, list_transform(v, lambda x: x / n) AS v
              FROM (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM d) WHERE n > 0),
    sampled AS (SELECT vec_id, v FROM units ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id LIMIT {vectors.SAMPLE_ROWS}),
    cells0 AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS cell, {rounded("v")} AS v
               FROM (SELECT * FROM sampled ORDER BY vec_id LIMIT {vectors.CELLS}))"""]
    for n in range(vectors.ROUNDS):
        parts.append(f"""
    own{n} AS ({_nearest("sampled", f"cells{n}", 1)}),
    sums{n} AS (
        SELECT cell, list(s ORDER BY i) AS v FROM (
            SELECT cell, i, sum(x) AS s FROM (
                SELECT cell, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM sampled JOIN own{n} USING (vec_id))
            GROUP BY cell, i) GROUP BY cell),
    cells{n + 1} AS (
        SELECT c.cell, CASE WHEN s.v IS NULL THEN c.v
               ELSE list_transform(s.v, lambda x: round(x / sqrt(list_dot_product(s.v, s.v)), {vectors.CELL_DECIMALS})) END AS v
        FROM cells{n} c LEFT JOIN sums{n} s ON s.cell = c.cell)""")
    last = f"cells{vectors.ROUNDS}"
    parts.append(f"""
    celled AS ({_nearest("units", last, vectors.COPIES)}),
    asked AS ({_nearest("(SELECT * FROM units WHERE vec_id % 50 = 0)", last, PROBES)}),
    ann AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER)
               AS rank, vec_id, round(score, 4) AS similarity
        FROM (SELECT DISTINCT query_id, d.vec_id, round(list_cosine_similarity(d.v, q.v), 9) AS score
              FROM q JOIN d ON d.label = q.label JOIN celled c ON c.vec_id = d.vec_id
              JOIN asked a ON a.vec_id = q.query_id AND a.cell = c.cell)
        QUALIFY rank <= 5)""")
    return ",".join(parts)


_CELLS = _cells_sql()

# The six kinds of keyword query, spelled out: what has to be there, in which group, and
# what must not be there. Covers are found from the last place of each word before an end.
def _text_search_sql(stemmed: bool) -> str:
    if stemmed:
        every = f"""(SELECT unnest({_WORDS}) AS word FROM documents UNION ALL SELECT unnest({_WORDS}) FROM benchmark
                     UNION ALL SELECT unnest(['bolt', 'small', 'g', 'omo', 'd', 'w']))"""
        return _TEXT_SEARCH.replace("{_Q}", stems_sql(every) + """,
            q AS (SELECT x.*, s.stem AS a_term, t.stem AS c_term FROM asked x
                  JOIN stems s ON s.word = x.a JOIN stems t ON t.word = x.c)""").replace(
            "{_TERM}", "stem").replace("{_STEMS}", "JOIN stems USING (word)")
    return _TEXT_SEARCH.replace("{_Q}", "q AS (SELECT *, a AS a_term, c AS c_term FROM asked)").replace(
        "{_TERM}", "word").replace("{_STEMS}", "")


_TEXT_SEARCH = f"""
    WITH activities AS (
        SELECT p_partkey AS activity_id, p_name AS name, p_type AS category, p_size % 2 = 0 AS indoor FROM part),
    b AS (
        SELECT item_id AS query_id, item_id % 6 AS kind, {_WORDS} AS every FROM benchmark),
    picked AS (
        SELECT query_id, w, row_number() OVER (PARTITION BY query_id ORDER BY place) AS n
        FROM (SELECT query_id, unnest(every) AS w, generate_subscripts(every, 1) AS place FROM b)
        WHERE w NOT IN ({_STOP}) AND length(w) > 3),
    asked AS (
        SELECT b.query_id, kind, every[1] AS e1, every[2] AS e2, x.w AS a, y.w AS c,
               CASE b.query_id % 4 WHEN 0 THEN 'BOLT' WHEN 1 THEN 'small g' WHEN 2 THEN 'omo' ELSE '%d_w' END AS part,
               CASE kind WHEN 0 THEN x.w || ' ' || y.w WHEN 1 THEN '"' || every[1] || ' ' || every[2] || '"'
                    WHEN 2 THEN x.w || ' or ' || y.w WHEN 3 THEN x.w || ' -' || y.w WHEN 4 THEN '-' || x.w
                    ELSE CASE b.query_id % 4 WHEN 0 THEN 'BOLT' WHEN 1 THEN 'small g' WHEN 2 THEN 'omo'
                         ELSE '%d_w' END END AS q
        FROM b JOIN picked x ON x.query_id = b.query_id AND x.n = 1
        JOIN picked y ON y.query_id = b.query_id AND y.n = 2),
    {{_Q}},
    post AS (SELECT doc_id, pos, {{_TERM}} AS term FROM (
        SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
        FROM (SELECT doc_id, {_WORDS} AS w FROM documents)) {{_STEMS}}),
    spelled AS (
        SELECT query_id, kind, 0 AS grp, 0 AS item, a AS term FROM q WHERE kind IN (0, 2, 3)
        UNION ALL SELECT query_id, kind, CASE kind WHEN 2 THEN 1 ELSE 0 END, 1, c FROM q WHERE kind IN (0, 2)
        UNION ALL SELECT query_id, kind, 0, place, w FROM (
            SELECT query_id, kind, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS place FROM (
                SELECT query_id, kind, regexp_extract_all(lower(part), '[\\p{{L}}\\p{{N}}]+') AS w FROM q WHERE kind = 5))
        UNION ALL SELECT query_id, kind, 0, 0, e1 FROM q WHERE kind = 1 AND e1 NOT IN ({_STOP})
        UNION ALL SELECT query_id, kind, 0, 1, e2 FROM q WHERE kind = 1 AND e2 NOT IN ({_STOP})),
    terms AS (SELECT query_id, kind, grp, item, {{_TERM}} AS term FROM (
        SELECT query_id, kind, grp, item, term AS word FROM spelled WHERE term NOT IN ({_STOP})) {{_STEMS}}),
    sizes AS (SELECT query_id, grp, count(*) AS needed FROM terms GROUP BY 1, 2),
    places AS (
        SELECT t.query_id, t.kind, doc_id, t.grp, item, pos, needed
        FROM terms t JOIN sizes s ON s.query_id = t.query_id AND s.grp = t.grp JOIN post p ON p.term = t.term),
    numbered AS (
        SELECT *, dense_rank() OVER (PARTITION BY query_id, doc_id ORDER BY pos) AS nth,
               max(CASE WHEN item = 0 THEN pos END) OVER w AS last0,
               max(CASE WHEN item = 1 THEN pos END) OVER w AS last1,
               max(CASE WHEN item = 2 THEN pos END) OVER w AS last2
        FROM places WINDOW w AS (PARTITION BY query_id, doc_id, grp ORDER BY pos)),
    ends AS (
        SELECT DISTINCT query_id, kind, doc_id, grp, pos AS stop, nth AS stop_nth, needed,
               CASE WHEN needed = 1 THEN coalesce(last0, last1, last2)
                    ELSE least(coalesce(last0, pos), coalesce(last1, pos), coalesce(last2, pos)) END AS start
        FROM numbered
        WHERE (last0 IS NOT NULL)::INT + (last1 IS NOT NULL)::INT + (last2 IS NOT NULL)::INT = needed
              AND (kind <> 1 OR needed = 1 OR (item = 1 AND last0 = pos - 1))),
    covers AS (
        SELECT query_id, kind, doc_id, start, min(stop) AS stop, min(stop_nth) AS stop_nth, max(needed) AS needed
        FROM ends GROUP BY 1, 2, 3, 4),
    scored AS (
        SELECT c.query_id, c.kind, c.doc_id, needed,
               (stop - start) - (stop_nth - n.nth) AS noise
        FROM covers c JOIN (SELECT DISTINCT query_id, doc_id, pos, nth FROM numbered) n
             ON n.query_id = c.query_id AND n.doc_id = c.doc_id AND n.pos = c.start),
    ranked AS (
        SELECT s.query_id, s.doc_id, round(sum(0.1 / (1 + noise)), 6) AS relevance,
               bool_and(s.kind <> 3 OR x.doc_id IS NULL) AS matched
        FROM scored s JOIN q ON q.query_id = s.query_id
        LEFT JOIN (SELECT DISTINCT doc_id, term FROM post) x ON x.doc_id = s.doc_id AND x.term = q.c_term
        GROUP BY 1, 2),
    without AS (
        SELECT query_id, doc_id FROM q, documents d WHERE kind = 4
        AND NOT EXISTS (SELECT 1 FROM post p WHERE p.doc_id = d.doc_id AND p.term = q.a_term)),
    named AS (
        SELECT query_id, activity_id AS doc_id FROM q JOIN activities
        ON name ILIKE '%' || q || '%' OR category ILIKE '%' || q || '%'
        WHERE activity_id IN (SELECT doc_id FROM documents)),
    found AS (
        SELECT query_id, doc_id, max(relevance) AS relevance FROM (
            SELECT query_id, doc_id, relevance FROM ranked WHERE matched
            UNION ALL SELECT query_id, doc_id, 0.0 FROM without
            UNION ALL SELECT n.query_id, n.doc_id, coalesce(r.relevance, 0.0) FROM named n
                LEFT JOIN ranked r ON r.query_id = n.query_id AND r.doc_id = n.doc_id)
        GROUP BY 1, 2)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id
               ORDER BY relevance DESC, name, activity_id) AS INTEGER) AS rank,
           activity_id, name, category, indoor,
           (SELECT lang = 'en' FROM documents d WHERE d.doc_id = found.doc_id) AS embedded,
           CAST(relevance AS DOUBLE) AS relevance
    FROM found JOIN activities ON activity_id = doc_id
    QUALIFY rank <= 6"""

ORACLE = {
    "embed_documents": f"""
        WITH {_vectors("v", "documents", "doc_id")},
        best AS (SELECT id, max(x) AS top FROM v GROUP BY id)
        SELECT d.doc_id, {EMBEDDING_DIM} AS dimensions, CAST(count(x) AS INTEGER) AS used_buckets,
               coalesce(min(CASE WHEN x = top THEN bucket END) + 1, 1) AS heaviest_bucket,
               round(coalesce(max(x), 0.0), 5) AS heaviest_weight,
               round(sqrt(coalesce(sum(x * x), 0.0)), 4) AS length
        FROM documents d LEFT JOIN v ON v.id = d.doc_id LEFT JOIN best b ON b.id = d.doc_id
        GROUP BY d.doc_id""",
    "semantic_topk": f"WITH {_VECTORS}, {_EXACT} SELECT * FROM exact",
    "semantic_topk_batch": f"""
        WITH {_vectors("d", "documents", "doc_id")}, {_vectors("q", "benchmark", "item_id")},
        dn AS (SELECT id, sqrt(sum(x * x)) AS n FROM d GROUP BY id),
        qn AS (SELECT id, sqrt(sum(x * x)) AS n FROM q GROUP BY id),
        asked AS (
            SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'es' ELSE 'fr' END AS place,
                   greatest(1, least(10, item_id % 13)) AS wished FROM benchmark),
        dots AS (SELECT q.id AS qid, d.id AS did, sum(q.x * d.x) AS dot
                 FROM q JOIN d ON d.bucket = q.bucket GROUP BY 1, 2),
        scored AS (
            SELECT a.item_id, a.wished, c.doc_id, round(coalesce(dot, 0.0) / (dn.n * qn.n), 9) AS score
            FROM asked a JOIN qn ON qn.id = a.item_id JOIN documents c ON c.lang = a.place
            JOIN dn ON dn.id = c.doc_id LEFT JOIN dots ON qid = a.item_id AND did = c.doc_id)
        SELECT item_id AS query_id,
               CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, s.doc_id) AS INTEGER) AS rank,
               s.doc_id AS activity_id, source || '/' || CAST(s.doc_id AS VARCHAR) AS name,
               source AS category, n_chars % 2 = 0 AS indoor, lang AS description,
               round(score, 4) AS similarity
        FROM scored s JOIN documents x ON x.doc_id = s.doc_id QUALIFY rank <= wished""",
    "semantic_ann": f"WITH {_VECTORS}, {_CELLS} SELECT * FROM ann",
    "ann_recall": f"""
        WITH {_VECTORS}, {_EXACT}, {_CELLS},
        sizes AS (SELECT label, cell, count(*) AS n FROM celled JOIN d USING (vec_id) GROUP BY 1, 2),
        reads AS (
            SELECT a.vec_id AS query_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_read
            FROM asked a JOIN d USING (vec_id) LEFT JOIN sizes s ON s.label = d.label AND s.cell = a.cell GROUP BY 1),
        totals AS (SELECT label, CAST(sum(n) AS BIGINT) AS rows_all FROM sizes GROUP BY 1),
        hits AS (
            SELECT e.query_id, count(*) AS expected, count(a.vec_id) AS found
            FROM exact e LEFT JOIN ann a ON a.query_id = e.query_id AND a.vec_id = e.vec_id
            GROUP BY e.query_id)
        SELECT query_id, expected, found, rows_read, rows_all
        FROM hits JOIN reads USING (query_id) JOIN q USING (query_id) JOIN totals USING (label)""",
    "text_search": _text_search_sql(False),
    "text_search_stemmed": _text_search_sql(True),
    "text_search_indexed": _text_search_sql(True),
}
