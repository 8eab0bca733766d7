"""Keyed folds after a join on their keys."""

from pyspark.sql import functions as F

from matchloom.plans.stateful import fold_rows


def test_fold_after_a_join_on_its_keys_sees_whole_keys(spark, tmp_path):
    """The join turns into a broadcast at run time; a key's rows must still come to one task, in order."""
    df = spark.range(2_000_000).select((F.col("id") % 500).alias("k"), F.floor(F.col("id") / 500).alias("f"))
    small = df.groupBy("k").agg(F.min("f").alias("least"))
    count = fold_rows(df.join(small, "k"), ["k"], ["f"], lambda: 0, lambda n, row: (n + 1, []) if row else (n, [{"n": n}]), "k long, n long")
    assert [tuple(r) for r in count.groupBy("n").count().collect()] == [(4000, 500)]
