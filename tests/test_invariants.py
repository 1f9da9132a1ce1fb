"""Facts that must hold between analyses, whatever the data."""

import pytest

from ordersight.plans.registry import STAR_PARAMETERS, analyse
from ordersight.sources import star_tables

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def run(spark):
    tables = star_tables(spark, SF)
    return lambda key, **more: analyse(key, tables, **{**STAR_PARAMETERS.get(key, {}), **more})


def column(df, name):
    return [r[0] for r in df.select(name).collect()]


def total(df, name):
    return sum(v for v in column(df, name) if v is not None)


@pytest.mark.parametrize(
    "key,share",
    [
        ("q19_rating_distribution", "delivery_pct"),
        ("q23_signup_cohorts", "order_volume_pct"),
        ("q23_signup_cohorts", "revenue_pct"),
        ("q44_frequency_segments", "revenue_share_pct"),
        ("d2_decline_concentration", "order_loss_pct"),
        ("d2_decline_concentration", "revenue_loss_pct"),
    ],
)
def test_shares_add_up(run, key, share):
    shares = column(run(key), share)
    assert float(sum(shares)) == pytest.approx(100, abs=0.005 * len(shares) + 1e-9)


def test_order_grain_revenue_is_total_revenue(run):
    inflated = run("q41_join_inflation").first()
    assert inflated.order_grain_revenue == run("q01_total_revenue").first()[0]
    assert inflated.naive_revenue >= inflated.order_grain_revenue


def test_monthly_revenue_adds_up_to_segments(run):
    assert total(run("b1_monthly_kpis"), "revenue") == total(
        run("q44_frequency_segments"), "segment_revenue"
    )


def test_regions_add_up_to_restaurant_revenue(run):
    lost = run("d8_top3_offline_impact").first()
    assert lost.top_revenue + lost.remaining_revenue == lost.total_revenue
    assert total(run("b5_revenue_region_month"), "revenue") == lost.total_revenue


def test_every_customer_is_in_one_repeat_bucket(run, spark):
    customers = spark.read.parquet(f"{SF}/customer.parquet").count()
    assert total(run("q13_repeat_buckets"), "customer_count") == customers


def test_lapsing_cities_add_up(run):
    assert total(run("d5_lapsing_by_city"), "lapsing_customers") == run(
        "q43_lapsing_high_value"
    ).count()


def test_repeat_spikes_list_each_restaurant_day_at_most_twice(run):
    spikes = run("q37_revenue_spikes")
    per_row = spikes.groupBy("detail_date", "restaurant_id").count()
    assert per_row.agg({"count": "max"}).first()[0] <= 2
    assert spikes.filter("detail_date = spike_date").count() == per_row.count()


def test_restaurant_order_counts_match_known_orders(run, spark):
    tables = star_tables(spark, SF)
    known = tables.orders.join(tables.restaurants, "restaurant_id", "left_semi").count()
    assert total(run("q08_orders_per_restaurant"), "order_count") == known
