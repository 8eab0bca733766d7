"""The filter that holds rows back before a shuffle."""

from matchloom.llm.bloom import passing


def test_passing_keeps_every_key_few_others_and_no_python(spark):
    keys = spark.range(0, 300_000, 100).selectExpr("id AS k")
    rows = spark.range(-1000, 300_000).selectExpr("id AS k", "array(id, id + 1) AS wide")
    out = passing(rows, keys, "k")
    assert out.columns == ["k", "wide"] and out.join(keys, "k").count() == 3000
    assert 3000 <= out.count() < 9000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "PythonMapInArrow" not in plan  # wide rows are not sent through Python
    assert passing(rows, keys.where("k < 0"), "k").count() == 0
