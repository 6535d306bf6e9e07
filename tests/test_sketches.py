"""Sketches per file against exact counts, overlaps and ranks."""

import pytest
from pyspark.sql import functions as F

from roomledger.functions.parsing import as_number
from roomledger.operators.sketches import SketchStore

ORDERS, LINES = "/root/testdata/sf0.1/orders.parquet", "/root/testdata/sf0.1/lineitem.parquet"


def test_distinct_and_overlap_at_a_larger_scale(spark, folder):
    lines, orders = spark.read.parquet(LINES), spark.read.parquet(ORDERS)
    early = lines.where("l_orderkey % 3 != 0").withColumnRenamed("l_orderkey", "key").select("key", "l_extendedprice", "l_shipdate")
    early.repartition(5).write.parquet(folder + "/lines")
    orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("key")).repartition(3).write.parquet(folder + "/orders")
    store = SketchStore(spark, folder + "/sketches")
    left, right = spark.read.parquet(folder + "/lines"), spark.read.parquet(folder + "/orders")
    assert store.add(left, "lines", ["key"], ["l_extendedprice", "l_shipdate"]) == 5 and store.add(right, "orders", ["key"]) == 3
    for name, df in (("lines", left), ("orders", right)):
        exact = df.agg(F.count("*"), F.count_distinct("key")).first()
        got = store.distinct(name, "key").first()
        assert got.row_count == exact[0] and got.null_count == 0 and got.distinct_estimate == pytest.approx(exact[1], rel=0.03)
    a, b = (df.select("key").distinct() for df in (left, right))
    both, union = a.intersect(b).count(), a.union(b).distinct().count()
    got = store.overlap("lines", "orders", "key").first()
    assert abs(got.both - both) < 0.03 * union
    assert abs(got.left_only - a.subtract(b).count()) < 0.03 * union and abs(got.right_only - b.subtract(a).count()) < 0.03 * union
    total = left.count()
    for column in ("l_extendedprice", "l_shipdate"):
        for r in store.quantiles("lines", column, [0.01, 0.5, 0.8, 0.99]).collect():
            number = as_number(F.col(column), left.schema[column].dataType)
            below, upto = left.agg(F.count_if(number < r.value), F.count_if(number <= r.value)).first()
            assert below / total - 0.01 <= r.share <= upto / total + 0.01


def test_only_new_files_are_read(spark, folder):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 10).cast("double").alias("x"))
    rows.coalesce(1).write.parquet(folder + "/t")
    store = SketchStore(spark, folder + "/sketches")
    assert store.distinct("t", "k").first() == (0, 0, 0) and store.quantiles("t", "x", [0.5]).first().value is None
    assert store.overlap("t", "u", "k").first() == (0, 0, 0)
    assert store.add(spark.read.parquet(folder + "/t"), "t", ["k"], ["x"]) == 1
    assert store.add(spark.read.parquet(folder + "/t"), "t", ["k"], ["x"]) == 0
    more = spark.createDataFrame([("a", None), (None, 5.0), ("a", 5.0)], "k string, x double")
    more.coalesce(1).write.mode("append").parquet(folder + "/t")
    assert store.add(spark.read.parquet(folder + "/t"), "t", ["k"], ["x"]) == 1
    got = store.distinct("t", "k").first()
    assert (got.row_count, got.null_count) == (1003, 1) and got.distinct_estimate == pytest.approx(1001, rel=0.03)
    assert store.quantiles("t", "x", [0.0, 1.0]).toPandas().value.tolist() == [0.0, 9.0]


def test_columns_of_nulls_and_no_rows(spark, folder):
    empty = spark.createDataFrame([(None, None)], "k string, x double")
    empty.write.parquet(folder + "/nulls")
    empty.limit(0).write.parquet(folder + "/none")
    store = SketchStore(spark, folder + "/sketches")
    for name in ("nulls", "none"):
        store.add(spark.read.parquet(folder + "/" + name), name, ["k"], ["x"])
        assert store.distinct(name, "k").first().distinct_estimate == 0
        assert store.quantiles(name, "x", [0.5]).first().value is None
    assert store.overlap("nulls", "none", "k").first() == (0, 0, 0)


def test_numbers_of_dates_and_instants(spark):
    row = spark.sql("SELECT DATE '1970-01-03' d, TIMESTAMP_NTZ '1970-01-02 00:00:00.5' n, TIMESTAMP '1970-01-02 00:00:01Z' t, 2.5BD x, CAST(NULL AS TIMESTAMP_NTZ) z")
    got = row.select(*[as_number(F.col(c), row.schema[c].dataType).alias(c) for c in row.columns]).first()
    assert tuple(got) == (2.0, 86400.5, 86401.0, 2.5, None)
