"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations alone.

The words of a corpus are shared out among its sources by weight. A document's expected
copies follow from its source's share; whole copies are taken for certain, and the rest is a
draw: documents are ranked by their random odds divided by their inclusion odds, and taken
in that order until the words of their source are as near its target as whole documents allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripweave.llm.common import written
from tripweave.operators.keyed import is_small

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
TILT = 0.25
SEED = "mix"
BINS = 4096
ROUNDING = 1e-9
WORD = r"[^\x20\x09-\x0D]+"


def _facts(docs: DataFrame) -> list[Column]:
    """What the mix needs of a document: a key of its source (null sources have one too), its
    size in words, the size's number of binary digits, and its random number in (0, 1)."""
    size = F.coalesce(F.regexp_count(docs["text"].cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")
    source = F.coalesce(F.concat(F.lit("="), docs["source"].cast("string")), F.lit(""))
    return [source.alias("_source"), size.alias("_size")]


def _drawn(rows: DataFrame, seed: str) -> DataFrame:
    """Adds the size class, the text of the id, and the random number, all functions of id and size."""
    doc_id = F.coalesce(F.col("_doc").cast("string"), F.lit("null"))
    digest = F.md5(F.concat_ws("|", F.lit(seed), doc_id, F.col("_size").cast("string")))
    number = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double")
    return rows.withColumns({
        "_class": F.length(F.bin("_size")), "_id": doc_id, "_u": (number + 0.5) / float(1 << 48)})


def _filled(rows: DataFrame, keys: list[str], total: str, cap: str, weight: str, order: list) -> DataFrame:
    """Adds `_share`: `total` dealt to the rows of each key by weight, none above its cap.

    In order of cap / weight, a row is full if its weight's part of what is left reaches its
    cap; the first that isn't sets the level for all behind it. `order` makes the order total.
    """
    by = Window.partitionBy(*keys)
    sequence = by.orderBy(F.col(cap) / F.col(weight), *order)
    before = F.coalesce(F.sum(cap).over(sequence.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    behind = F.sum(weight).over(sequence.rowsBetween(0, Window.unboundedFollowing))
    stepped = rows.withColumns({
        "_level": (F.col(total) - before) / behind, "_place": F.row_number().over(sequence)})
    short = F.col(cap) > F.col("_level") * F.col(weight)
    level = F.min_by(F.when(short, F.col("_level")), F.when(short, F.col("_place"))).over(by)
    return stepped.withColumn(
        "_share", F.least(F.col(cap), F.coalesce(level * F.col(weight), F.col(cap)))).drop("_level", "_place")


def _targets(sizes: DataFrame, weights: tuple, max_copies: int) -> DataFrame:
    """source_size and target per source. One row per source goes through one window."""
    everything = Window.partitionBy()
    named = sizes.groupBy("_source").agg(F.sum("_words").cast("double").alias("_words")).withColumn(
        "_number", F.row_number().over(Window.orderBy(F.col("_source") == "", "_source")))
    turns = F.array(*[F.lit(float(w)) for w in weights])
    ready = named.withColumns({
        "_weight": F.element_at(turns, (F.col("_number") - 1) % len(weights) + 1),
        "_cap": F.col("_words") * max_copies, "_total": F.sum("_words").over(everything)})
    return _filled(ready, [], "_total", "_cap", "_weight", [F.col("_number")]).select(
        "_source", F.col("_words").cast("bigint").alias("source_size"), F.col("_share").alias("target"))


def _copies(sizes: DataFrame, targets: DataFrame, max_copies: int, tilt: float) -> DataFrame:
    """Per source and size class: copies for certain, and the odds of one more.

    Expected copies grow with the class by `tilt` (a document of twice the size has 2^tilt
    as many), scaled so that the source's expected words are its target and none is above
    the most copies.
    """
    pull = F.pow(F.lit(2.0), F.col("_class") * F.lit(float(tilt)))
    ready = sizes.join(F.broadcast(targets) if is_small(targets) else targets, "_source").withColumns({
        "_pull": F.col("_words") * pull, "_cap": F.col("_words").cast("double") * max_copies})
    held = ready.filter("_words > 0")
    expected = F.least(F.lit(float(max_copies)), F.col("_share") / F.col("_words"))
    shared = _filled(held, ["_source"], "target", "_cap", "_pull", [F.col("_class")]).withColumn("_expected", expected)
    certain = F.floor(F.col("_expected") + ROUNDING)
    chance = F.col("_expected") - certain
    return shared.select("_source", "_class", "source_size", "target", "_words", certain.alias("_certain"),
                         F.when(chance > ROUNDING, chance / (1 - chance)).alias("_odds"))


def _ranked(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows with their class's copies and odds, and their rank variable (null: not drawn)."""
    joined = rows.join(F.broadcast(classes) if is_small(classes) else classes, ["_source", "_class"], "left")
    rank = F.col("_u") / (1 - F.col("_u")) / F.col("_odds")
    return joined.withColumn("_rank", F.when(F.col("_size") > 0, rank))


def _cuts(ranked: DataFrame, classes: DataFrame) -> DataFrame:
    """Per source the last place that is taken, as rank, size and id.

    Words are first added up in bins of the rank; only the rows of the one bin that holds a
    source's cut are put in order, so no window sees a whole source.
    """
    wanted = classes.groupBy("_source").agg(
        F.first("target").alias("_target"), F.sum(F.col("_certain") * F.col("_words")).alias("_sure")).select(
        "_source", (F.col("_target") - F.col("_sure")).alias("_wanted"))
    binned = ranked.filter("_rank IS NOT NULL").withColumn(
        "_bin", F.floor(F.col("_rank") / (1 + F.col("_rank")) * BINS).cast("int"))
    bins = binned.groupBy("_source", "_bin").agg(F.sum("_size").alias("_n"))
    running = Window.partitionBy("_source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    reached = bins.withColumn("_to", F.sum("_n").over(running)).join(wanted, "_source")
    last = Window.partitionBy("_source").orderBy("_bin")
    cut_bin = reached.filter("_to >= _wanted").withColumn("_first", F.row_number().over(last)).filter(
        "_first = 1").select("_source", "_bin", (F.col("_to") - F.col("_n")).alias("_before"), "_wanted")
    inside = binned.join(F.broadcast(cut_bin) if is_small(cut_bin) else cut_bin, ["_source", "_bin"])
    equal = inside.groupBy("_source", "_rank", "_size", "_id", "_before", "_wanted").agg(F.count("*").alias("_rows"))
    ahead = Window.partitionBy("_source").orderBy("_rank", "_size", "_id").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("_before") + F.sum(F.col("_size") * F.col("_rows")).over(ahead) - F.col("_size") * F.col("_rows")
    # a row is taken if its middle lies below what is wanted; of equal rows as many as do
    near = equal.withColumn("_take", F.least("_rows", F.floor((F.col("_wanted") - start) / F.col("_size") + 0.5)))
    taken = near.filter("_take >= 1").groupBy("_source").agg(
        F.max(F.struct("_rank", "_size", "_id")).alias("_cut"),
        F.max_by(F.struct("_take", "_rows"), F.struct("_rank", "_size", "_id")).alias("_last"))
    # where no row of the bin is taken, all bins before it are; a source without a cut is taken whole
    return cut_bin.select("_source", "_bin").join(taken, "_source", "left").withColumnRenamed("_bin", "_cut_bin")


def plan(docs: DataFrame, weights: tuple = WEIGHTS, max_copies: int = MAX_COPIES, tilt: float = TILT,
         seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """The documents' facts, stored, and the stored table of decisions by source and class."""
    facts = written(_drawn(docs.select(docs["doc_id"].alias("_doc"), *_facts(docs)), seed), "sizes")
    sizes = facts.groupBy("_source", "_class").agg(F.sum("_size").alias("_words"))
    targets = written(_targets(sizes, weights, max_copies), "targets")
    classes = written(_copies(sizes, targets, max_copies, tilt), "classes")
    cuts = _cuts(_ranked(facts, classes), classes)
    decided = classes.drop("source_size", "target", "_words").join(cuts, "_source", "left")
    every = sizes.select("_source", "_class").join(targets, "_source").join(decided, ["_source", "_class"], "left")
    return facts, written(every, "decisions")


def _taken(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Adds `_copies`, the copies the mix takes of each row.

    Rows equal in source, size and id stand at one place of the order. Where the cut goes through them, they
    are stored, numbered inside the parts they are stored in, and the counts of earlier parts added, so
    that exactly as many as reach the target are taken however many there are.
    """
    ranked = _ranked(rows, decisions)
    own_bin = F.floor(F.col("_rank") / (1 + F.col("_rank")) * BINS)
    place = F.struct("_rank", "_size", "_id")
    drawn = (F.col("_cut_bin").isNull() | (own_bin < F.col("_cut_bin"))
             | (own_bin == F.col("_cut_bin")) & (place <= F.col("_cut")))
    certain, more = F.coalesce(F.col("_certain"), F.lit(0)), F.col("_rank").isNotNull() & F.coalesce(drawn, F.lit(False))
    marked = ranked.withColumn("_copies", certain + F.when(more, 1).otherwise(0))
    parted = F.col("_last._take") < F.col("_last._rows")
    if decisions.filter(parted).isEmpty():
        return marked
    tied = F.coalesce(parted & (own_bin == F.col("_cut_bin")) & (place == F.col("_cut")), F.lit(False))
    stored = written(marked.filter(tied).withColumn("_part", F.spark_partition_id()), "tied")
    counts = stored.groupBy("_source", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_source", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    number = F.col("_offset") + F.row_number().over(Window.partitionBy("_source", "_part").orderBy("_id"))
    numbered = stored.join(F.broadcast(offsets) if is_small(offsets) else offsets, ["_source", "_part"]).withColumn(
        "_number", number).withColumn("_copies", certain + F.when(F.col("_number") <= F.col("_last._take"), 1).otherwise(0))
    return marked.filter(~tied).unionByName(numbered.select(*marked.columns))


def mix_counts(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every document.

    A null or empty text has size 0 and is never taken; null sources are one source. The draw
    depends on seed, id and size alone, so reruns agree; of rows equal in both as many are taken as
    reach the target. An empty table gives no rows; columns other than doc_id, source and text are
    not read.
    """
    facts, decisions = plan(docs, **settings)
    return _taken(facts, decisions).select(
        F.col("_doc").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target",
        (F.col("_size") * F.col("_copies")).cast("bigint").alias("taken"), F.col("_copies").cast("int").alias("copies"))


def mix_documents(docs: DataFrame, seed: str = SEED, **settings) -> DataFrame:
    """The mixed corpus: every document as often as it is taken, with all its columns.

    The decisions are few rows by source and size class, so the texts stay where they lie.
    """
    _, decisions = plan(docs, seed=seed, **settings)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_all"), docs["doc_id"].alias("_doc"), *_facts(docs))
    taken = _taken(_drawn(rows, seed), decisions).filter("_copies > 0")
    return taken.select("_all", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_all.*")


SQL = r"""
WITH facts AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
drawn AS (
  SELECT *, length(bin(size)) AS class, coalesce(doc_id::VARCHAR, 'null') AS id,
    (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null') || '|' || size), 1, 12))::BIGINT + 0.5::DOUBLE)
      / 281474976710656::DOUBLE AS u FROM facts),
sources AS (
  SELECT source, sum(size)::DOUBLE AS words, row_number() OVER (ORDER BY source NULLS LAST) AS number
  FROM drawn GROUP BY source),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][((number - 1) % 3 + 1)::INT]::DOUBLE AS weight, 3 * words AS cap, sum(words) OVER () AS total
  FROM sources),
steps AS (
  SELECT *, row_number() OVER o AS place,
    (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY cap / weight, number)),
targets AS (
  SELECT source, words, least(cap, coalesce((SELECT arg_min(level, place) FROM steps WHERE cap > level * weight) * weight, cap))
    AS target FROM steps),
classes AS (
  SELECT d.source, d.class, sum(d.size)::DOUBLE AS class_words, any_value(t.target) AS target,
    sum(d.size) * pow(2.0, d.class * 0.25) AS pull, 3.0 * sum(d.size) AS class_cap
  FROM drawn d JOIN targets t ON t.source IS NOT DISTINCT FROM d.source GROUP BY d.source, d.class HAVING sum(d.size) > 0),
class_steps AS (
  SELECT *, row_number() OVER o AS place,
    (target - coalesce(sum(class_cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(pull) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM classes WINDOW o AS (PARTITION BY source ORDER BY class_cap / pull, class)),
levels AS (
  SELECT source, arg_min(level, place) FILTER (class_cap > level * pull) AS fill FROM class_steps GROUP BY source),
expected AS (
  SELECT c.source, c.class, c.class_words, c.target,
    least(3.0, least(class_cap, coalesce(l.fill * pull, class_cap)) / class_words)::DOUBLE AS copies
  FROM classes c JOIN levels l ON l.source IS NOT DISTINCT FROM c.source),
certain AS (
  SELECT *, floor(copies + 1e-9) AS sure, copies - floor(copies + 1e-9) AS chance FROM expected),
wanted AS (
  SELECT source, any_value(target) - sum(sure * class_words) AS wanted FROM certain GROUP BY source),
ranked AS (
  SELECT d.*, c.sure, CASE WHEN size > 0 AND chance > 1e-9 THEN u / (1 - u) / (chance / (1 - chance)) END AS rank_value
  FROM drawn d LEFT JOIN certain c ON c.source IS NOT DISTINCT FROM d.source AND c.class = d.class),
placed AS (
  SELECT *, sum(CASE WHEN rank_value IS NOT NULL THEN size ELSE 0 END) OVER (
    PARTITION BY source ORDER BY rank_value NULLS LAST, size, id ROWS UNBOUNDED PRECEDING) - size / 2.0 AS middle FROM ranked)
SELECT p.doc_id, p.size, t.words::BIGINT AS source_size, t.target,
  (p.size * (coalesce(p.sure, 0) + CASE WHEN rank_value IS NOT NULL AND middle <= wanted THEN 1 ELSE 0 END))::BIGINT AS taken,
  (coalesce(p.sure, 0) + CASE WHEN rank_value IS NOT NULL AND middle <= wanted THEN 1 ELSE 0 END)::INT AS copies
FROM placed p JOIN targets t ON t.source IS NOT DISTINCT FROM p.source
LEFT JOIN wanted w ON w.source IS NOT DISTINCT FROM p.source
"""
