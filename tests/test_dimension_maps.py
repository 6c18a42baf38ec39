"""Dimension maps: the greatest value of a type, nulls, repeated rows, and one grouping."""

import json

from pyspark.sql import functions as F

from strataloom.operators import catalogue


def test_the_greatest_value_counts_and_rows_are_grouped_once(spark):
    rows = [(1, 1, "b", "x"), (1, 1, "b", "z"), (1, 1, "b", "y"), (1, 1, "a", "q"), (1, 1, "a", "q"), (1, 2, "a", None), (1, 2, "c", None), (1, 2, "c", "v"), (2, 1, "a", "")]
    df = spark.createDataFrame(rows, "item long, version_no int, type string, value string")
    out = catalogue.dimension_maps(df)
    got = {(r.item, r.version_no): json.loads(r.d) for r in out.select("item", "version_no", F.to_json("dimensions", {"ignoreNullFields": "false"}).alias("d")).collect()}
    assert got == {(1, 1): {"a": "q", "b": "z"}, (1, 2): {"a": None, "c": "v"}, (2, 1): {"a": ""}}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
