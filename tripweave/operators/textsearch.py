"""Keyword search: word, phrase, `or` and minus queries, substring matches, cover rank.

Words are lower-case letter and digit runs; English stop words are skipped but keep their
positions. Words with the same English stem count as equal. The rank adds up, over the minimal covers of a query in a
document, 0.1 / (1 + number of other words inside the cover), after the cover-density
ranking of Clarke, Cormack and Tudhope (2000).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window, functions as F

from tripweave.functions.stemming import probe, with_stem
from tripweave.functions.text import contains_pattern, grams, is_stop_word, probe_gram, tokens
from tripweave.operators.covers import score_hits
from tripweave.operators.keyed import is_small, settle, top_per_key

RESULTS = 6
RANK_DECIMALS = 6
QUERY_BYTES = 4_000_000
PIECE_PATTERN = r'-?"[^"]*"?|[^\s"]+'
ANY_DOCUMENT = ""
PROBE_LETTERS = 6


def usable_queries(queries: DataFrame, query: str = "q") -> DataFrame:
    """Trimmed queries; blank ones give no results."""
    return queries.withColumn(query, F.trim(query)).filter(F.col(query) != "")


def search_terms(queries: DataFrame, query_id: str = "query_id", query: str = "q",
                 stemmed: bool = False) -> DataFrame:
    """One row per word of each query.

    A query is a list of groups joined by `or`; a document matches a group when it has all
    of its plain items and none of its minus items. An item is a word or a phrase: `item`
    tells items apart, `off` is a word's place in its item, `words` the item's word count
    and `needed` the group's number of plain items. A group of minus items only gets a plain
    item for the empty word, which every document has. `simple` marks queries in which one
    word is enough, `counted` the first use of a word in its query. With `stemmed` the terms
    are stems.
    """
    pieces = queries.select(
        query_id,
        F.posexplode(F.regexp_extract_all(F.col(query), F.lit(PIECE_PATTERN), F.lit(0))).alias("item", "piece"),
    ).withColumn("_or", (F.lower("piece") == "or").cast("int")).withColumn(
        "grp", F.sum("_or").over(Window.partitionBy(query_id).orderBy("item"))).filter("_or = 0")
    item = Window.partitionBy(query_id, "item")
    words = pieces.select(
        query_id, "grp", "item", F.col("piece").startswith("-").alias("minus"),
        F.posexplode(tokens(F.col("piece"))).alias("_place", "term"),
    ).filter(~is_stop_word(F.col("term"))).withColumns({
        "off": F.col("_place") - F.min("_place").over(item), "words": F.count("*").over(item).cast("int")})
    if stemmed:
        words = settle(with_stem(words, "term", "term"))

    group = Window.partitionBy(query_id, "grp")
    plain = F.count_if(~F.col("minus") & (F.col("off") == 0)).over(group).cast("int")
    leads = F.row_number().over(group.orderBy("item", "off")) == 1
    own = ["item", "minus", "off", "term", "words"]
    anywhere = F.struct(F.lit(-1).alias("item"), F.lit(False).alias("minus"), F.lit(0).alias("off"),
                        F.lit(ANY_DOCUMENT).alias("term"), F.lit(1).alias("words"))
    grouped = words.withColumns({"needed": plain, "_leads": leads}).withColumn(
        "_rows", F.when((F.col("needed") == 0) & F.col("_leads"), F.array(F.struct(*own), anywhere))
        .otherwise(F.array(F.struct(*own))))
    every = grouped.select(
        query_id, "grp", F.greatest("needed", F.lit(1)).alias("needed"), F.inline("_rows"))

    whole = Window.partitionBy(query_id)
    uses = F.row_number().over(Window.partitionBy(query_id, "minus", "term").orderBy("grp", "item"))
    return every.withColumns({
        "simple": (F.max("words").over(whole) == 1) & (F.max("needed").over(whole) == 1),
        "counted": uses == 1})


def with_forms(terms: DataFrame, documents: DataFrame, text: str, few: bool) -> DataFrame:
    """Stemmed terms replaced by all words of the texts that have the same stem.

    Only words that begin as a stem does are taken from the texts, made distinct in each task
    before they are shuffled, and stemmed. With very many terms all words are taken.
    """
    words = F.array_distinct(tokens(F.coalesce(text, F.lit(""))))
    if few:
        begins: dict[int, list[str]] = {}
        for (start,) in terms.filter(F.col("term") != ANY_DOCUMENT).select(
                probe(F.col("term"), PROBE_LETTERS)).distinct().collect():
            begins.setdefault(len(start), []).append(start)
        words = F.filter(words, lambda w: reduce(
            or_, [F.substring(w, 1, n).isin(*starts) for n, starts in begins.items()], F.lit(False)))
    every = F.concat(words, F.array(F.lit(ANY_DOCUMENT)))
    vocabulary = documents.select(F.explode(every).alias("_form")).distinct()
    forms = settle(with_stem(vocabulary, "_form", "term"))
    return forms.join(F.broadcast(terms) if few else terms, "term").drop("term").withColumnRenamed("_form", "term")


def word_hits(documents: DataFrame, terms: DataFrame, doc_id: str, text: str, few: bool,
              query_id: str = "query_id", name: str | None = None) -> DataFrame:
    """Places of the queries' words in the whole texts, read in one pass.

    The texts are split where they lie, and with a broadcast term list a document's hits stay
    there, next to each other. The place behind the last word stands for the empty word; a term
    for it without a query gives one row per document, with its name.
    """
    words = F.concat(tokens(F.coalesce(text, F.lit(""))), F.array(F.lit(ANY_DOCUMENT)))
    called = F.col(name) if name else F.lit(None).cast("string")
    posted = documents.select(doc_id, called.alias("name"), F.posexplode(words).alias("pos", "term"))
    hits = posted.join(F.broadcast(terms) if few else terms, "term")
    return with_rank_flag(hits.withColumn("name", F.when(F.col("term") == ANY_DOCUMENT, F.col("name"))))


def with_rank_flag(hits: DataFrame) -> DataFrame:
    """`ranked` tells the hits that count for the relevance: plain words, each once per query."""
    first_use = F.col("counted") | ~F.col("simple")
    return hits.withColumn("ranked", F.coalesce(~F.col("minus") & (F.col("term") != ANY_DOCUMENT) & first_use, F.lit(False)))


def rank(hits: DataFrame, doc_id: str, query_id: str = "query_id", together: bool = False) -> DataFrame:
    """Match flag and relevance per (query, document)."""
    return score_hits(hits, doc_id, query_id, together).withColumn("relevance", F.round("relevance", RANK_DECIMALS))


def _marker(terms: DataFrame, query_id: str) -> DataFrame:
    """The term that gives every document one row, in the layout of search terms."""
    values = {"term": F.lit(ANY_DOCUMENT), "simple": F.lit(False), "minus": F.lit(False), "counted": F.lit(False)}
    one = terms.sparkSession.range(1)
    return one.select(*[(F.lit(None) if f.name == query_id else values.get(f.name, F.lit(0))).cast(f.dataType).alias(f.name)
                        for f in terms.schema.fields])


def substring_matches(activities: DataFrame, queries: DataFrame, doc_id: str, columns: list[str],
                      few: bool, query_id: str = "query_id", query: str = "q") -> DataFrame:
    """(query, activity) pairs where a column contains the query, letter case ignored.

    Queries and values meet by a short substring that every match must share, and only
    those pairs are compared in full.
    """
    values = activities.select(doc_id, F.explode(F.array(*columns)).alias("_value"))
    offered = values.withColumn("_gram", F.explode(grams(F.col("_value"))))
    asked = queries.select(query_id, contains_pattern(F.col(query)).alias("_pattern"),
                           probe_gram(F.col(query)).alias("_gram"))
    return offered.join(F.broadcast(asked) if few else asked, "_gram").filter(
        F.ilike(F.col("_value"), F.col("_pattern"))).select(query_id, doc_id).distinct()


def keyword_search(activities: DataFrame, documents: DataFrame, queries: DataFrame,
                   doc_id: str = "activity_id", text: str = "document_text", name: str = "name",
                   category: str = "category", query_id: str = "query_id", query: str = "q",
                   results: int = RESULTS, stemmed: bool = True) -> DataFrame:
    """The best activities with a document for every query: full-text match, or a name or
    category that contains the query; by relevance, then name. `embedded` tells whether the
    document has a vector, which is looked up for the results only."""
    asked = usable_queries(queries, query)
    few = is_small(asked.select(query), QUERY_BYTES)
    terms = settle(search_terms(asked, query_id, query, stemmed))
    if stemmed:
        terms = settle(with_forms(terms, documents, text, is_small(terms, QUERY_BYTES)))
    few_terms = is_small(terms)
    names = activities.select(doc_id, name)
    texts = documents.select(doc_id, text).join(F.broadcast(names) if is_small(names) else names, doc_id)
    plain, anywhere = split_anywhere(terms, query_id, few_terms)
    hits = word_hits(texts, plain, doc_id, text, few_terms, query_id, name)
    return best_documents(hits, few_terms, anywhere, activities, documents, asked, few, doc_id, name, category,
                           query_id, query, results)


def split_anywhere(terms: DataFrame, query_id: str, few: bool) -> tuple[DataFrame, dict]:
    """Terms with a marker for every document. Few groups of minus items alone are taken out and
    listed, as every document would be a hit of each."""
    if not few:
        return terms.unionByName(_marker(terms, query_id)), {}
    anywhere: dict = {}
    for query, grp in terms.filter(F.col("term") == ANY_DOCUMENT).select(query_id, "grp").distinct().collect():
        anywhere.setdefault(query, set()).add(grp)
    return terms.filter(F.col("term") != ANY_DOCUMENT).unionByName(_marker(terms, query_id)), anywhere


def best_documents(hits: DataFrame, together: bool, anywhere: dict, activities: DataFrame, documents: DataFrame,
                    asked: DataFrame, few: bool, doc_id: str, name: str, category: str, query_id: str, query: str,
                    results: int) -> DataFrame:
    """The best activities of every query from the hits in their documents and in their names."""
    pair = [query_id, doc_id]
    named = settle(substring_matches(activities, asked, doc_id, [name, category], few, query_id, query).join(
        documents.select(doc_id), doc_id, "left_semi"))
    queries_with_names = {row[0] for row in named.select(query_id).distinct().collect()} if few else set()
    scored = settle(score_hits(hits, doc_id, query_id, together, anywhere, results if few else None, queries_with_names))
    relevance = F.round("relevance", RANK_DECIMALS).alias("relevance")
    called = named.join(activities.select(doc_id, F.col(name).alias("name")), doc_id).join(
        scored.select(*pair, "relevance"), pair, "left").select(
        *pair, "name", F.coalesce("relevance", F.lit(0.0)).alias("relevance"))
    found = scored.filter("matched").select(*pair, "name", "relevance").unionByName(called).groupBy(*pair).agg(
        F.max("name").alias("name"), F.max("relevance").alias("relevance")).withColumn("relevance", relevance)
    top = top_per_key(found, [query_id], [F.col("relevance").desc(), F.col("name").asc(), F.col(doc_id).asc()],
                      results, "rank").drop("name")
    top = settle(top)
    top = F.broadcast(top) if is_small(top) else top
    vectors = documents.select(doc_id, F.col("embedding").isNotNull().alias("embedded"))
    return top.join(activities, doc_id).join(vectors, doc_id)
