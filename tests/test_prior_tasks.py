"""A gene's levels on tables that are dealt to many tasks."""

import numpy as np
from pyspark.sql import functions as F

from tallymix.operators import prior
from tallymix.operators.matrix import CountMatrix


def _matrix(spark):
    x = np.random.default_rng(5).poisson(3.0, (40, 60)) * np.arange(1, 61)
    g, c = np.nonzero(x)
    entries = spark.createDataFrame([(int(a), int(b), float(x[a, b])) for a, b in zip(g, c, strict=True)], "gene_id long, cell_id long, value double")
    return CountMatrix(entries, spark.range(41).select(F.col("id").alias("gene_id")), spark.range(60).select(F.col("id").alias("cell_id")))


def test_more_rows_go_to_more_tasks(spark, monkeypatch):
    m = _matrix(spark)
    plan = prior.gene_levels(m, m.genes)
    assert "SortAggregate" not in plan._jdf.queryExecution().toString()  # which sorts all runs in the tasks that read them
    want = sorted(plan.collect())
    monkeypatch.setattr(prior, "TASK_ROWS", 64, raising=False)
    rows = prior.with_prefixes(prior.value_runs(m, m.genes))
    assert rows.rdd.getNumPartitions() >= rows.count() / 64
    assert sorted(prior.gene_levels(m, m.genes).collect()) == want
