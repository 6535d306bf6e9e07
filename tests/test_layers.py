"""The written layers: what crosses the network while they are built, and the order that they keep."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from roomledger.operators.serving import build_serving
from roomledger.plans.warehouse import Warehouse
from roomledger.schemas import SOURCE_SCHEMA
from roomledger.sources import star
from roomledger.sources.landing import csv_batch, headers


@pytest.fixture
def small(spark, folder):
    """Star-schema tables of 3,000 lines, with lines without an order and a customer without a nation."""
    day = lambda n: datetime(1996, 1 + n % 12, 1 + n % 28)
    lines = [(i % 800, i % 50, i % 20, i % 7, float(1 + i % 50), 900.0 + i, i % 11 / 100, i % 9 / 100, "NRA"[i % 3], "OF"[i % 2],
              None if i % 100 == 0 else day(i * 17)) for i in range(3000)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                          "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                          "l_shipdate timestamp").repartition(6).write.parquet(f"{folder}/lineitem.parquet")
    orders = [(i, i % 40, "OFP"[i % 3], 1.0, day(i * 5), "1-URGENT") for i in range(700)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, "
                          "o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    customers = [(i, f"c{i}", None if i == 3 else i % 3, 0.0, "BUILDING") for i in range(39)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
                          ).write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(0, "A"), (1, "B"), (2, "C")], "n_nationkey int, n_name string").write.parquet(f"{folder}/nation.parquet")
    return folder


def test_what_is_shuffled_is_narrow_and_clustered(spark, small):
    assert len(star.booked_lines(spark, small).columns) <= 16
    w = Warehouse(spark, small)
    drop = ["_ingested_at"]
    expected = star.bookings(spark, small).drop(*drop)
    assert w.bronze.drop(*drop).exceptAll(expected).isEmpty() and expected.exceptAll(w.bronze.drop(*drop)).isEmpty()
    plan = w.bronze._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    silver = w.silver
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    ends = silver.selectExpr("_metadata.file_path AS f", "hotel", "coalesce(arrival_date, date'0001-01-01') AS d").groupBy("f").agg(
        {"hotel": "min", "d": "min"}).count()
    assert ends == len(w.bronze.inputFiles())  # file by file: no two of bronze's in one of silver's
    spans = silver.selectExpr("_metadata.file_path AS f", "struct(hotel, coalesce(arrival_date, date'0001-01-01')) AS k").groupBy("f").agg(
        {"k": "min"}).join(silver.selectExpr("_metadata.file_path AS f", "struct(hotel, coalesce(arrival_date, date'0001-01-01')) AS k").groupBy(
            "f").agg({"k": "max"}), "f").orderBy("min(k)").collect()
    lows_highs = [(tuple(r["min(k)"]), tuple(r["max(k)"])) for r in spans]
    # hotels come in the order of the line's status; within a hotel the files' days do not overlap but at their ends
    for (_, high), (low, _) in zip(lows_highs, lows_highs[1:]):
        assert high[0] != low[0] or high[1] <= low[1]


def same_rows(left, right):
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def shuffled(frame):
    """Rows that the shuffles of a frame's plan wrote."""
    frame.collect()
    rows = []

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.startswith("ShuffleExchange"):
            rows.append(node.metrics().apply("shuffleRecordsWritten").value())
        if kind.endswith("QueryStageExec"):
            walk(node.plan())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(frame._jdf.queryExecution().executedPlan())
    return sum(rows)


def test_whole_layers_cost_no_order(spark, small):  # F17, F20, F21, F22
    """Risk and serving come from silver as it landed; serving needs no table of scores."""
    w = Warehouse(spark, small)
    serving = w.serving
    assert not {"bronze", "silver", "risk"} & set(vars(w))
    assert same_rows(serving, build_serving(w.risk, w.silver))
    drop = ["_ingested_at"]
    assert same_rows(w.silver_landed.drop(*drop), w.silver.drop(*drop))
    assert same_rows(w.bronze_landed.drop(*drop), w.bronze.drop(*drop))


def test_landing_reads_headers_without_a_shuffle_of_lines(spark, small):  # F23, F26, F28, F29, F32
    """Of the lines of a file only the first leaves its task, plain or compressed; both kinds land the same rows."""
    w = Warehouse(spark, small)
    for path in (w.csv, w.plain_csv):
        assert shuffled(headers(spark, path)) < 200 < w.bronze_landed.count()
    assert {f.rsplit(".", 2)[-1] for f in spark.read.text(w.csv).inputFiles()} == {"gz"}
    drop = ["_ingested_at", "_source_file"]
    landed = csv_batch(spark, w.csv).drop(*drop)
    assert same_rows(landed, csv_batch(spark, w.plain_csv).drop(*drop))
    assert same_rows(landed.drop("_rescued_data"), w.bronze.select(*SOURCE_SCHEMA.names))


def test_lines_unknown_to_a_mark(spark, small):  # F16
    """A missing status, flag or tax gives what no match gives."""
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    none = {c: F.lit(None).cast(t) for c, t in (("l_linestatus", "string"), ("l_returnflag", "string"), ("l_tax", "double"))}
    lines.withColumns(none).write.parquet(f"{small}/odd/lineitem.parquet")
    for name in ("orders", "customer", "nation"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{small}/odd/{name}.parquet")
    assert len(star.booked_lines(spark, f"{small}/odd").columns) < 16
    found = star.bookings(spark, f"{small}/odd").select(
        "hotel", "is_canceled", "deposit_type", "company", "reservation_status").distinct().collect()
    assert [tuple(r) for r in found] == [("Resort Hotel", 0, "Non Refund", None, "Check-Out")]
