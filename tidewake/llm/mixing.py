"""Operator 10: mixing sources to target weights, in DataFrame operations only.

Sizes are summed per source (partial sums before the shuffle), the sums are turned into
targets by water filling, and a document is emitted ``floor(rate)`` times plus one more
time when a hash of its identifier falls below the fraction.

Water filling: all sources share ``budget`` by weight, no target passes ``max_repeat``
times its source's size, and what is cut off is shared again by weight. In closed form,
with sources in the order of cap / weight, the sources up to some place are cut and the
others get ``level * weight``; prefix sums over the sources give every level at once, so
nothing is iterated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewake.llm.common import NOT_SPACE

#: Weights by the rank of the source's name, repeating.
WEIGHTS = (3, 1, 2)
#: Up to so many sources the table of rates (under 100 bytes a row) is broadcast.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters that aren't ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def unit_draw(ident: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 52 bits of a SHA-256 of seed and identifier."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, budget_share: float = 1.5, max_repeat: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) to (source, source_size, target, rate).

    Sources are ranked by code point, null last; a source without words has target 0.
    ``budget_share`` beyond ``max_repeat`` leaves every source at its cap.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.lit(max_repeat) * F.col("source_size"))
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    filled = (
        ranked.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_from", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("budget", F.lit(budget_share) * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("budget") - F.col("cap_before")) / F.col("weight_from"))
        # the level of the first source that isn't cut holds for all after it
        .withColumn("free", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("k"), F.col("level")))).over(everything))
        .withColumn("target", F.when(F.col("free").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("free.level") * F.col("weight"))))
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return filled.select("source", "source_size", "target", rate.alias("rate"))


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget_share: float = 1.5, max_repeat: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix-1") -> DataFrame:
    """One row per document: its size, its source's size and target, and its copies.

    Columns: id, size, source_size, target, rate, copies. Null and empty texts have size 0
    and are taken ``copies`` times like others; a null identifier draws by the word
    ``null``; repeated identifiers draw alike. An empty table gives an empty table.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    return _with_copies(base, source_rates(base, budget_share, max_repeat, weights), seed)


def source_rates(sized: DataFrame, budget_share: float, max_repeat: float, weights: tuple[int, ...]) -> DataFrame:
    """Rates per source of (source, size) rows, behind a checkpoint: a few rows that every later step shares."""
    from tidewake.session import shared_folder

    shared_folder(sized.sparkSession)
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return source_targets(sums, budget_share, max_repeat, weights).checkpoint()


def _with_copies(sized: DataFrame, rates: DataFrame, seed: str) -> DataFrame:
    r = rates.withColumnRenamed("source", "rate_source")
    if rates.count() <= BROADCAST_SOURCES:
        r = F.broadcast(r)
    joined = sized.join(r, F.col("source").eqNullSafe(F.col("rate_source")), "left").drop("rate_source")
    whole = F.floor("rate")
    extra = F.when(unit_draw(F.col("doc_id"), seed) < F.col("rate") - whole, 1).otherwise(0)
    return joined.withColumn("copies", (whole + extra).cast("int"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget_share: float = 1.5, max_repeat: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix-1") -> DataFrame:
    """The mixed corpus: every document's whole row, as often as the mix takes it."""
    rates = source_rates(docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), budget_share, max_repeat, weights)
    row = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"))
    copies = _with_copies(row, rates, seed).filter(F.col("copies") > 0)
    return copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    from tidewake.llm.common import table

    plan = mixing_plan(table(spark, sf_dir, "documents"))
    taken = (F.col("size") * F.col("copies")).cast("long")
    return plan.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, (CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END) AS weight,
         2e0 * source_size AS cap
  FROM s
), f AS (
  SELECT *, cap / weight AS k,
         (1.5e0 * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0e0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0e0)) AS level
  FROM r
  WINDOW b AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, cap,
         CASE WHEN (SELECT min(level) FROM f WHERE level * weight <= cap) IS NULL THEN cap
              ELSE least(cap, (SELECT arg_min(level, k) FROM f WHERE level * weight <= cap) * weight) END AS target
  FROM f
), c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0e0 END AS rate,
         ('0x' || substr(sha256('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::UBIGINT::DOUBLE / 4503599627370496e0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
