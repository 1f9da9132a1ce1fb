"""The physical plans: one scan of each fact, no Python, no single task over raw rows."""

import re

import pytest

import __spark_entry__ as contract
from ordersight.plans import audits, operations, revenue
from ordersight.plans.registry import ANALYSES, STAR_PARAMETERS, analyse
from ordersight.sources import Tables, read_clean, star_tables, write_clean
from small import tables, values

SF = "/root/testdata/sf0.001"
JOIN_THRESHOLDS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.fixture
def settings(spark):
    """Change SQL settings for one test."""
    before = {}

    def change(**options):
        for name, value in options.items():
            name = name.replace("__", ".")
            before.setdefault(name, spark.conf.get(name, None))
            spark.conf.set(name, value)

    yield change
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def final_plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


@pytest.mark.parametrize("key", sorted(ANALYSES))
def test_plan_shape_without_small_tables(spark, settings, key):
    """With size-based broadcasts off, as if every table were large."""
    settings(**{name.replace(".", "__"): "-1" for name in JOIN_THRESHOLDS})
    plan = final_plan(contract.queries()[key](spark, SF))
    assert "Python" not in plan and "Pandas" not in plan
    assert "CartesianProduct" not in plan
    assert "FileScan parquet" in plan  # a plan without scans would prove nothing
    # A fact table is read once, whatever the number of branches.
    for fact in ("o_orderkey", "o_orderstatus", "o_custkey", "l_orderkey", "l_suppkey"):
        assert len(re.findall(rf"FileScan parquet \[{fact}\b", plan)) <= 1
    # Nested loops only ever meet the one row of a global aggregate.
    single_rows = [x for x in plan.splitlines() if "IdentityBroadcastMode" in x]
    assert plan.count("BroadcastNestedLoopJoin") == len(single_rows)
    made = [x for x in single_rows if "ReusedExchange" not in x]
    # A limited sort leaves one partition too, which an aggregate then needs no exchange for.
    assert len(made) <= plan.count("Exchange SinglePartition") + plan.count("TakeOrderedAndProject")


@pytest.mark.parametrize("key", sorted(ANALYSES))
def test_only_aggregates_meet_in_one_task(spark, key):
    """What feeds a single-task exchange is an aggregate, never rows of a scan."""
    df = contract.queries()[key](spark, SF)
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    assert any("FileScan parquet" in line for line in lines)
    for position, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = next(x for x in lines[position + 1 :] if "Project" not in x)
            assert "Aggregate" in below, below


@pytest.mark.parametrize("analysis", [operations.slowest_orders, revenue.agent_revenue_rank])
def test_building_a_plan_starts_no_job(spark, analysis):
    context = spark.sparkContext
    context.setJobGroup("building", "building")
    try:
        analysis(tables(spark))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert list(context.statusTracker().getJobIdsForGroup("building")) == []


def without_small_tables(spark, settings, key):
    settings(**{name.replace(".", "__"): "-1" for name in JOIN_THRESHOLDS})
    return final_plan(contract.queries()[key](spark, SF))


def test_pairs_of_customer_and_restaurant_meet_names_without_another_exchange(spark, settings):
    plan = without_small_tables(spark, settings, "q21_favourite_restaurant")
    made = [
        x
        for x in plan.splitlines()
        if "Exchange hashpartitioning(customer_id" in x and "ReusedExchange" not in x
    ]
    # By customer and restaurant, by customer for either side of the join, and the names.
    assert len(made) <= 4 and "ReusedExchange" in plan


def test_the_cities_come_before_the_first_count_of_orders(spark, settings):
    plan = without_small_tables(spark, settings, "q28_city_favourite_category")
    join = re.search(r"SortMergeJoin\S* \[customer_id", plan).start()
    assert plan.index("partial_count(order_id") < join  # parents stand above their inputs


def test_customers_are_counted_by_restaurant_before_the_join(spark, settings):
    plan = without_small_tables(spark, settings, "b6_city_frequency")
    assert "partial_count(1)" in plan[plan.index("SortMergeJoin") :]


def test_top_k_uses_a_bounded_sort(spark):
    plan = final_plan(contract.queries()["q03_top_spenders"](spark, SF))
    assert "TakeOrderedAndProject" in plan


def test_group_top_k_cuts_before_the_shuffle(spark):
    plan = final_plan(contract.queries()["q16_best_agent_per_city"](spark, SF))
    assert plan.count("WindowGroupLimit") == 2


def test_spikes_join_by_equality(spark):
    assert "NestedLoop" not in final_plan(contract.queries()["q37_revenue_spikes"](spark, SF))


def test_projection_reaches_the_scan(spark):
    plan = final_plan(contract.queries()["q08_orders_per_restaurant"](spark, SF))
    scan = next(x for x in plan.splitlines() if "FileScan" in x and "o_orderkey" in x)
    columns = scan.split("ReadSchema:")[1]
    assert "o_totalprice" not in columns and "o_orderdate" not in columns


def hot_tables(spark, n=60_000):
    """A third of the deliveries belong to one order, and a third of the orders to one customer."""
    orders = spark.range(n).selectExpr(
        "id as order_id",
        "if(id % 3 = 0, 7L, id % 997) as customer_id",
        "if(id % 3 = 1, 5L, id % 89) as restaurant_id",
        "cast(date_add(date '2024-01-01', cast(id % 90 as int)) as string) as order_date",
        "cast(id % 500 as decimal(12,2)) as order_amount",
        "if(id % 4 = 0, 'cancelled', 'Delivered') as status",
        "cast(id % 80 as int) as delivery_time_minutes",
    )
    deliveries = spark.range(2 * n).selectExpr(
        "id as delivery_id",
        f"if(id % 3 = 0, 8L, id % {n}) as order_id",
        "if(id % 3 = 2, 1L, id % 40) as agent_id",
        "'delivered' as delivery_status",
        "cast(id % 5 + 1 as int) as delivery_rating",
    )
    small = tables(
        spark,
        customers=[{"customer_id": i, "city": f"c{i % 5}"} for i in range(997)],
        restaurants=[{"restaurant_id": i, "city": f"c{i % 4}"} for i in range(89)],
        delivery_agents=[{"agent_id": i, "city": f"c{i % 6}"} for i in range(40)],
    )
    frames = {"orders": orders, "deliveries": deliveries}
    return Tables(lambda name: frames[name] if name in frames else small.load(name))


@pytest.fixture
def tiny_partitions(settings):
    """Thresholds under which the test data counts as skewed."""
    settings(
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="2KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="2KB",
        spark__sql__shuffle__partitions="16",
        **{name.replace(".", "__"): "-1" for name in JOIN_THRESHOLDS},
    )


@pytest.mark.parametrize(
    "analysis",
    [
        audits.cancelled_with_delivery,
        audits.cross_city_orders,
        audits.cross_city_agents,
        operations.agent_leaderboard,
    ],
)
def test_row_level_joins_split_a_hot_key(spark, tiny_partitions, analysis):
    plan = final_plan(analysis(hot_tables(spark)))
    assert "skew=true" in plan or "isSkewJoin=true" in plan


def test_hot_keys_change_no_result(spark, tiny_partitions, settings):
    t = hot_tables(spark)
    spread = values(operations.agent_leaderboard(t)), values(revenue.agent_revenue_rank(t))
    settings(spark__sql__adaptive__skewJoin__enabled="false", spark__sql__shuffle__partitions="1")
    assert values(operations.agent_leaderboard(t)) == spread[0]
    assert sorted(values(revenue.agent_revenue_rank(t))) == sorted(spread[1])


def test_hot_keys_arrive_pre_aggregated(spark):
    """A hot customer reaches its shuffle as at most one row per task."""
    df = revenue.frequency_segment_share(hot_tables(spark))
    plan = final_plan(df)
    first = plan.index("Exchange hashpartitioning(customer_id")
    assert "partial_sum(order_amount" in plan[first:]


@pytest.fixture(scope="module")
def clean(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("clean"))
    write_clean(star_tables(spark, SF), root, mode="overwrite")
    return read_clean(spark, root)


@pytest.mark.parametrize(
    "key", ["b6_city_frequency", "b7_city_restaurant_month", "q28_city_favourite_category", "q50_city_restaurant_pivot"]
)
def test_a_city_reduces_the_orders_before_their_first_shuffle(spark, settings, clean, key):
    """As for large tables: no broadcasts, and a fact that is worth a runtime filter."""
    plain = sorted(values(analyse(key, clean, **STAR_PARAMETERS[key])), key=str)
    settings(**{name.replace(".", "__"): "-1" for name in JOIN_THRESHOLDS})
    threshold = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    settings(**{threshold.replace(".", "__"): "0"})
    df = analyse(key, clean, **STAR_PARAMETERS[key])
    plan = final_plan(df)
    # The filter of the orders' own scan; every exchange lies above it.
    assert re.search(r"Filter \(+isnotnull\((status_key|customer_id)#\d+L?\).*might_contain", plan)
    assert sorted(values(df), key=str) == plain


def test_reorder_gaps_keep_two_days_of_a_key(spark, settings):
    """No array of all days; a rank limit of two on both sides of the shuffle."""
    settings(**{name.replace(".", "__"): "-1" for name in JOIN_THRESHOLDS})
    plan = final_plan(contract.queries()["q38_reorder_gap"](spark, SF))
    assert "collect_list" not in plan
    assert re.search(r"WindowGroupLimit .* 2, Partial", plan) and re.search(r"WindowGroupLimit .* 2, Final", plan)


def test_the_slowest_orders_are_cut_before_their_attempts_join(spark, settings):
    settings(**{name.replace(".", "__"): "-1" for name in JOIN_THRESHOLDS})
    plan = final_plan(contract.queries()["q24_slowest_orders"](spark, SF))
    made = [x for x in plan.splitlines() if re.search("Exchange (hash|range|Single)", x) and "Reused" not in x]
    assert len(made) <= 15  # 23 when the rank met the full join
    assert not re.search(r"Exchange hashpartitioning\(coalesce\(delivery_time_minutes", plan)
    cut = plan.index("BroadcastNestedLoopJoin")
    assert "Exchange hashpartitioning(order_id" in plan[:cut]  # the cut is below the exchange by order


def test_star_queries_leave_the_clock_alone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        shifted = values(star_tables(spark, SF).orders.select("order_month").distinct())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    usual = values(star_tables(spark, SF).orders.select("order_month").distinct())
    assert (None,) in usual  # unreadable dates
    assert set(shifted) == set(usual)
