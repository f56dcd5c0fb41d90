"""Mixing sources to target weights by systematic sampling; DataFrame and SQL functions only.

``target_sizes`` shares a total among the sources by weight, none above a
multiple of its own size, the excess reshared.  ``mix`` then draws: within a
source each document expects target / source size copies.  These are summed up
in a fixed order, one offset from the seed is added, and a document is taken
once for each whole number that its stretch of the sum crosses.

The order is (size class, cell, doc_id, size, hash of the text), with as many
cells as keep one below some ten thousand rows.  So the prefix sums need no task
to hold a source: sums within cells by window, sums of a class's cells by a
window over one row per cell, sums of a source's classes by one over these.
Size classes (the whole root of the size) stratify the draw, which holds each
source's taken words near its target.  All sums are of whole numbers (copies in
units of 2^-30), so the result depends neither on partitions nor on reruns.

Edge cases: a null text has size 0; documents of size 0 are drawn like others;
a null source is a source of its own, last in order; a null doc_id comes first
in its cell; repeated rows draw one after the other, rows of one doc_id and size
in an order of their texts; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
UNIT = 1 << 30
CELL_ROWS = 1 << 14
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def target_sizes(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds weight and target to (source, source_size); one row per source.

    In the order of the size that a unit of weight would need to reach the cap,
    a source is capped if its part of what the earlier capped ones leave would
    reach its cap.  That is what repeated resharing ends with.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    k = F.row_number().over(order)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(k - 1, F.lit(len(weights))) + 1)
    ranked = sources.withColumn("weight", weight)
    by_need = W.orderBy(F.expr(f"{most} * source_size / weight"), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(W.unboundedPreceding, -1)
    from_here = by_need.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(from_here)
    levels = ranked.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") < most * F.col("source_size"))
    first = F.min(F.when(F.col("free"), F.struct(F.expr(f"{most} * source_size / weight").alias("need"), F.col("level")))).over(whole)["level"]
    return levels.withColumn("first", first).select(
        "source", "source_size", "weight",
        F.when(F.col("first").isNull(), F.lit(float(most)) * F.col("source_size")).otherwise(F.least(F.lit(float(most)) * F.col("source_size"), F.col("first") * F.col("weight"))).alias("target"),
    )


def offset_units(source: Column, seed: str) -> Column:
    """The source's one random offset, in units of a copy."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(F.concat(F.lit("s"), source), F.lit("-")))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long"), F.lit(UNIT))


def copies(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies; and the columns ``keep``."""
    sized = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("tie_"), *keep)
    n_cells = max(1, -(-df.count() // CELL_ROWS))
    cells = sized.withColumns({
        "class": F.floor(F.sqrt("size")).cast("long"),
        "cell": F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long"), F.lit(n_cells)),
    })
    totals = cells.groupBy("source", "class", "cell").agg(F.count("*").alias("cell_rows"), F.sum("size").alias("cell_size"))
    sources = totals.groupBy("source").agg(F.sum("cell_size").alias("source_size"))
    rates = target_sizes(sources, weights, share, most).select(
        F.col("source"), "source_size", "target",
        F.coalesce(F.round(F.expr("try_divide(target, source_size)") * UNIT), F.lit(0)).cast("long").alias("rate"),
    )
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    classes = totals.groupBy("source", "class").agg(F.sum("cell_rows").alias("class_rows"))
    classes = classes.select(F.col("source").alias("c_source"), F.col("class").alias("c_class"), before(W.partitionBy("source").orderBy("class"), "class_rows").alias("class_before"))
    in_class = totals.withColumn("cell_before", before(W.partitionBy("source", "class").orderBy("cell"), "cell_rows"))
    prefix = in_class.join(classes, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("class") == F.col("c_class"))).withColumn("rows_before", F.col("class_before") + F.col("cell_before"))
    t, r = prefix.alias("t"), rates.alias("r")
    offsets = t.join(r, F.col("t.source").eqNullSafe(F.col("r.source"))).select(
        F.col("t.source").alias("o_source"), F.col("t.class").alias("o_class"), F.col("t.cell").alias("o_cell"), "source_size", "target", "rate",
        # only the part below a whole copy matters for the cell
        F.expr(f"cast(pmod(cast(rows_before as decimal(38,0)) * cast(rate as decimal(20,0)), {UNIT}) as bigint)").alias("start"),
    )
    within = W.partitionBy("source", "class", "cell").orderBy(F.col("doc_id").asc_nulls_first(), "size", "tie_")
    numbered = cells.withColumn("rank", F.row_number().over(within).cast("long"))
    d = numbered.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("class") == F.col("o_class")) & (F.col("cell") == F.col("o_cell")))
    base = F.col("start") + offset_units(F.col("source"), seed)
    crossed = F.shiftright(base + F.col("rank") * F.col("rate"), 30) - F.shiftright(base + (F.col("rank") - 1) * F.col("rate"), 30)
    return d.select("doc_id", "source", "size", "source_size", "target", crossed.cast("long").alias("copies"), *keep)


def mix(df: DataFrame, **options) -> DataFrame:
    """The mixed documents: each row as often as it is taken, with its own columns."""
    columns = df.columns
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row_"), *[F.col(c).alias(c) for c in ("doc_id", "source", "text")])
    drawn = copies(row, keep=("row_",), **options).where("copies > 0")
    return drawn.select("row_", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row_.*")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
n AS (SELECT greatest(1, (count(*) + {CELL_ROWS - 1}) // {CELL_ROWS}) AS n_cells FROM d),
c AS (
  SELECT doc_id, source, size, CAST(floor(sqrt(size)) AS BIGINT) AS class,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) % n_cells AS cell
  FROM d, n),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [{", ".join(f"{float(w)}" for w in WEIGHTS)}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1]::DOUBLE AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, ({SHARE}::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
     - {MOST} * CAST(coalesce(sum(source_size) OVER (ORDER BY {MOST} * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
     / sum(weight) OVER (ORDER BY {MOST} * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
f AS (SELECT arg_min(level, {MOST} * source_size / weight) AS first FROM l WHERE level * weight < {MOST} * source_size),
t AS (
  SELECT source, source_size,
         CASE WHEN first IS NULL THEN {MOST}.0::DOUBLE * source_size ELSE least({MOST}.0::DOUBLE * source_size, first * weight) END AS target
  FROM l, f),
r AS (
  SELECT *, CAST(coalesce(CASE WHEN source_size > 0 THEN round(target / source_size * {UNIT}) END, 0) AS BIGINT) AS rate,
         CAST('0x' || substr(md5('{SEED}:' || coalesce('s' || source, '-')), 1, 12) AS BIGINT) % {UNIT} AS u
  FROM t),
k AS (
  SELECT c.doc_id, c.size, r.source_size, r.target, r.rate, r.u,
         row_number() OVER (PARTITION BY c.source ORDER BY class, cell, doc_id NULLS FIRST, size) AS i
  FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       CAST(((u + i * rate) // {UNIT} - (u + (i - 1) * rate) // {UNIT}) * size AS BIGINT) AS taken
FROM k"""
