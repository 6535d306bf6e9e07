import pytest

from roomledger.operators import governance as g
from roomledger.operators.silver import silver_bookings
from roomledger.schemas import ANALYST, CITY_MANAGER, ENGINEER, MASKED_COLUMNS, RESORT_MANAGER


@pytest.fixture
def silver(bronze_row):
    return silver_bookings(bronze_row(
        {"country": "PRT"}, {"hotel": "Resort Hotel", "country": "ESP"},
        {"hotel": "Resort Hotel", "country": None},
    ))


CASES = [
    ([], []),
    (["someone_else"], []),
    ([ENGINEER], ["City Hotel", "Resort Hotel", "Resort Hotel"]),
    ([ANALYST], ["City Hotel", "Resort Hotel", "Resort Hotel"]),
    ([CITY_MANAGER], ["City Hotel"]),
    ([RESORT_MANAGER], ["Resort Hotel", "Resort Hotel"]),
    ([CITY_MANAGER, RESORT_MANAGER], ["City Hotel", "Resort Hotel", "Resort Hotel"]),
    ([CITY_MANAGER, ANALYST], ["City Hotel", "Resort Hotel", "Resort Hotel"]),
]


@pytest.mark.parametrize("groups, hotels", CASES)
def test_rows(silver, groups, hotels):
    assert sorted(r.hotel for r in g.persona_view(silver, groups).collect()) == hotels


def test_masks(silver):
    seen = g.persona_view(silver, [ANALYST])
    assert seen.columns == silver.columns
    assert {tuple(r) for r in seen.select(*MASKED_COLUMNS).collect()} == {("***",) * 3}
    clear = {r.country for r in g.persona_view(silver, [ENGINEER]).collect()}
    assert clear == {"PRT", "ESP", None}


def test_filter_and_pruning_reach_the_scan(spark, silver, folder):
    silver.write.parquet(folder)
    view = g.persona_view(spark.read.parquet(folder), [CITY_MANAGER]).select("hotel", "country")
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(hotel,City Hotel)" in plan and "country" not in plan.split("ReadSchema")[1]


def test_visibility_in_one_pass(silver):
    personas = {"none": [], "eng": [ENGINEER], "city": [CITY_MANAGER], "resort": [RESORT_MANAGER]}
    df = g.visibility(silver, personas)
    got = {r.persona: (r.visible_rows, r.hotels, r.country_sample) for r in df.collect()}
    assert got == {
        "none": (0, 0, None), "eng": (3, 2, "PRT"), "city": (1, 1, "***"), "resort": (2, 1, "***")
    }


def test_comments_survive_a_write(spark, silver, folder):
    g.with_comments(silver, {"country": "Where the guest is from.", "no_such": "x"}).write.parquet(folder)
    assert spark.read.parquet(folder).schema["country"].metadata["comment"] == "Where the guest is from."


def test_tags_drive_the_masks(spark):
    assert g.tagged_columns("silver_bookings", "pii") == MASKED_COLUMNS
    assert g.tags(spark).where("key = 'layer'").count() == 3
    assert g.masks(spark).count() == 3 and g.row_filters(spark).count() == 1


def test_access(spark):
    matrix = g.access_matrix(spark)
    assert matrix.count() == 25
    tables = ["bronze_bookings", "silver_bookings", "gold_hotel_month"]
    requests = spark.createDataFrame(
        [(p, t) for p in [*g.PERSONAS, "stranger"] for t in tables], "persona string, table string"
    )
    granted = {tuple(r) for r in g.allowed(requests, matrix).collect()}
    assert {t for p, t in granted if p == ENGINEER} == set(tables)
    assert {t for p, t in granted if p == CITY_MANAGER} == set(tables[1:])
    assert not [p for p, _ in granted if p == "stranger"]


def test_lineage_closure(spark):
    got = {(r.upstream, r.downstream): r.depth for r in g.lineage_closure(g.lineage(spark)).collect()}
    assert got[("bronze_bookings", "gold_hotel_month")] == 2
    assert got[("silver_bookings", "reservation_risk_serving")] == 1
    assert got[("bronze_bookings", "reservation_risk_serving")] == 2
    assert len(got) == 8


def test_lineage_has_no_depth_and_cycles_end(spark):
    chain = spark.createDataFrame([(f"t{i:02d}", f"t{i + 1:02d}") for i in range(12)], "upstream string, downstream string")
    got = {(r.upstream, r.downstream): r.depth for r in g.lineage_closure(chain).collect()}
    assert len(got) == 78 and got["t00", "t12"] == 12
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "b")], "upstream string, downstream string")
    assert sorted(map(tuple, g.lineage_closure(ring).collect())) == [
        ("a", "a", 3), ("a", "b", 1), ("a", "c", 2), ("b", "a", 2), ("b", "b", 3), ("b", "c", 1),
        ("c", "a", 1), ("c", "b", 2), ("c", "c", 3)]


def test_described_columns(spark, silver):
    rows = {r.column: r for r in g.described_columns(spark, "silver_bookings", silver.schema).collect()}
    assert (rows["country"].mask, rows["country"].data_class) == ("mask_pii", "pii")
    assert rows["adr"].data_class == "financial" and rows["adr"].type == "decimal(10,2)"
    assert rows["meal"].mask is None
