"""Text sources and sinks of count matrices: MatrixMarket, dense text, libsvm, word-count lines, topic files.

Readers take a line's number from its file's order where the format needs it;
such files are read with one row number over the lines.  Paths are opened by
Spark only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.matrix import CountMatrix
from ..operators.store import stored


def _placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): each line with its place; a folder's files go by name, whatever order Spark reads them in."""
    rows = spark.read.text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) by the order of the files: numbers within a block, and the blocks' counts, one row each, for what lies before."""
    rows = _placed_lines(spark, path)
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = blocks.select("file", "block", F.coalesce(F.sum("n").over(W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = rows.withColumn("own", F.row_number().over(W.partitionBy("file", "block").orderBy("at")) - 1)
    return own.join(before, ["file", "block"]).select((F.col("before") + F.col("own")).cast("long").alias("line"), "value")


def _words(c: str = "value"):
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def read_dense(spark: SparkSession, path: str) -> CountMatrix:
    """White-space matrix, one gene per line, one column per cell."""
    rows = numbered_lines(spark, path).where("trim(value) <> ''").withColumn("line", F.row_number().over(W.orderBy("line")) - 1)
    long = stored(rows.select(F.col("line").cast("long").alias("gene_id"), F.posexplode(_words()).alias("cell_id", "v")).select("gene_id", F.col("cell_id").cast("long"), F.col("v").cast("double").alias("value")))
    return CountMatrix.of(long, long.select("gene_id").distinct(), long.select("cell_id").distinct())


def read_matrix_market(spark: SparkSession, path: str) -> CountMatrix:
    """Coordinate format: ``%`` comments, a line of sizes, then 1-based row, column and value (1 for a pattern file)."""
    lines = _placed_lines(spark, path).where("value not like '\\\\%%' and trim(value) <> ''")
    words = lines.select(F.struct("file", "block", "at").alias("at"), _words().alias("w"))
    head = words.orderBy("at").first()
    genes, cells = int(head.w[0]), int(head.w[1])
    body = words.where((F.col("at.file") != head["at"].file) | (F.col("at.block") != head["at"].block) | (F.col("at.at") != head["at"]["at"])).select((F.col("w")[0].cast("long") - 1).alias("gene_id"), (F.col("w")[1].cast("long") - 1).alias("cell_id"), F.coalesce(F.get("w", F.lit(2)).cast("double"), F.lit(1.0)).alias("value"))
    ids = lambda n, name: spark.range(n).withColumnRenamed("id", name)
    return CountMatrix.of(body, ids(genes, "gene_id"), ids(cells, "cell_id"))


def write_matrix_market(m: CountMatrix, path: str) -> None:
    """One part file for the header and others for the entries; concatenated in name order they are the file."""
    genes, cells, n = m.genes.agg(F.max("gene_id")).first()[0] + 1, m.cells.agg(F.max("cell_id")).first()[0] + 1, m.entries.count()
    spark = m.entries.sparkSession
    head = spark.createDataFrame([("%%MatrixMarket matrix coordinate real general",), (f"{genes} {cells} {n}",)], "value string").coalesce(1)
    body = m.entries.select(F.concat_ws(" ", F.col("gene_id") + 1, F.col("cell_id") + 1, F.col("value")).alias("value"))
    head.union(body).write.mode("overwrite").text(path)


def libsvm_lines(m: CountMatrix) -> DataFrame:
    """(cell_id, line): ``1``, a tab, then ``gene:count `` of each entry, from gene 0, whole counts."""
    body = F.array_join(F.transform(F.arrays_zip("idx", "val"), lambda e: F.concat(e["idx"].cast("string"), F.lit(":"), e["val"].cast("long").cast("string"), F.lit(" "))), "")
    return m.packed_cells().select("cell_id", F.concat(F.lit("1\t"), body).alias("line"))


def word_lines(m: CountMatrix, include_zeros: bool = False) -> DataFrame:
    """(cell_id, line): ``G<gene> <count> `` pairs of each cell; with zeros, of all genes."""
    if include_zeros:
        rows = m.cells.crossJoin(m.genes).join(m.entries, ["gene_id", "cell_id"], "left").fillna(0.0, ["value"])  # the dense form asks for every pair
        packed = rows.groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct(F.col("gene_id").alias("idx"), F.col("value").alias("val")))).alias("e"))
    else:
        packed = m.packed_cells().select("cell_id", F.arrays_zip("idx", "val").alias("e"))
    body = F.array_join(F.transform("e", lambda e: F.concat(F.lit("G"), e["idx"].cast("string"), F.lit(" "), e["val"].cast("long").cast("string"), F.lit(" "))), "")
    return packed.select("cell_id", body.alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines in the order of their cells, as text."""
    lines.repartitionByRange("cell_id").sortWithinPartitions("cell_id").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def model_lines(factor: DataFrame, key: str, array: str) -> DataFrame:
    """(key, line): the id, then ``component:value `` for values of 0 and above."""
    parts = F.filter(F.transform(array, lambda v, j: F.when(v >= 0, F.concat(j.cast("string"), F.lit(":"), v.cast("string"), F.lit(" ")))), lambda s: s.isNotNull())
    return factor.select(F.col(key).alias("cell_id"), F.concat(F.col(key).cast("string"), F.lit(" "), F.array_join(parts, "")).alias("line"))


def dictionary_lines(spark: SparkSession, genes: int) -> DataFrame:
    return spark.range(genes).select(F.col("id").alias("cell_id"), F.format_string("%d\tG%d\t%d", "id", "id", F.col("id") + 1).alias("line"))


def read_topic_lines(spark: SparkSession, path: str, key: str = "gene_id") -> DataFrame:
    """(key, k, value) of lines ``id topic:value ...``"""
    rows = spark.read.text(path).where("trim(value) <> ''").select(_words().alias("w"))
    return rows.select(F.col("w")[0].cast("long").alias(key), F.explode(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0)))).alias("p")).select(key, F.split("p", ":")[0].cast("int").alias("k"), F.split("p", ":")[1].cast("double").alias("value"))


def read_word_topics(spark: SparkSession, path: str, included_genes: DataFrame | None = None) -> DataFrame:
    """(gene_id, k, value) of lines ``G<i> v v ...``; ``included_genes`` (i, gene_id) maps the file's numbers to the matrix's."""
    rows = spark.read.text(path).where("trim(value) <> ''").select(_words().alias("w"))
    long = rows.select(F.substring(F.col("w")[0], 2, 20).cast("long").alias("i"), F.posexplode(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0)))).alias("k", "v")).select("i", "k", F.col("v").cast("double").alias("value"))
    return long.withColumnRenamed("i", "gene_id") if included_genes is None else long.join(included_genes, "i").select("gene_id", "k", "value")


def read_document_topics(spark: SparkSession, path: str) -> DataFrame:
    """(cell_id, k, value) of a white-space matrix with a cell per line."""
    return numbered_lines(spark, path).where("trim(value) <> ''").select(F.col("line").alias("cell_id"), F.posexplode(_words()).alias("k", "v")).select("cell_id", "k", F.col("v").cast("double").alias("value"))


def read_word_counts(spark: SparkSession, path: str) -> DataFrame:
    """Entries (gene_id, cell_id, value) of lines of ``G<gene> <count>`` pairs, a cell per line."""
    rows = numbered_lines(spark, path).select("line", _words().alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(0), (F.size("w") / 2).cast("int") - 1), lambda j: F.struct(F.substring(F.get("w", 2 * j), 2, 20).cast("long").alias("g"), F.get("w", 2 * j + 1).cast("double").alias("v"))))
    return rows.select(F.col("line").alias("cell_id"), F.explode(pairs).alias("p")).select(F.col("p.g").alias("gene_id"), "cell_id", F.col("p.v").alias("value"))
