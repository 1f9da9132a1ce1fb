from datetime import date

import pytest

from ordersight import schemas
from ordersight.plans import business_review, registry
from ordersight.sources import read_clean, read_raw, star_tables, write_clean
from small import table, tables, values

SF = "/root/testdata/sf0.001"


def executed_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def month_rows(spark):
    months = ("2024-01-05", "2024-02-05", "2024-02-06", "never")
    return tables(spark, orders=[{"order_date": d} for d in months])


def test_clean_layer_round_trip(spark, tmp_path):
    t = month_rows(spark)
    write_clean(t, str(tmp_path))
    stored = read_clean(spark, str(tmp_path))
    for name in schemas.CLEAN:
        frame = stored.table(name)
        assert set(frame.columns) == set(schemas.CLEAN[name].names)
        assert sorted(values(frame, *sorted(frame.columns)), key=str) == sorted(
            values(t.table(name), *sorted(frame.columns)), key=str
        )
    assert values(business_review.monthly_kpis(stored)) == values(business_review.monthly_kpis(t))


def test_filters_reach_the_clean_layer(spark, tmp_path):
    write_clean(month_rows(spark), str(tmp_path))
    stored = read_clean(spark, str(tmp_path))
    churned = registry.analyse("q31_churned_customers", stored)
    plan = executed_plan(churned)
    scan = next(x for x in plan.splitlines() if "FileScan" in x and "order_month" in x)
    assert "PartitionFilters: [" in scan and "order_month" in scan.split("PartitionFilters")[1]
    assert "EqualTo(status_key,delivered)" in scan
    assert "order_amount" not in scan.split("ReadSchema")[1]


def test_a_range_of_days_prunes_months(spark, tmp_path):
    write_clean(month_rows(spark), str(tmp_path))
    quarter = (date(2024, 1, 1), date(2024, 3, 31))
    lost = registry.analyse(
        "q48_cancel_leads_churn", read_clean(spark, str(tmp_path)), only=quarter[0], scope=quarter
    )
    scan = next(x for x in executed_plan(lost).splitlines() if "FileScan" in x)
    pruned = scan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "order_month" in pruned


def test_writing_twice_is_refused(spark, tmp_path):
    write_clean(month_rows(spark), str(tmp_path))
    with pytest.raises(Exception, match="already exists"):
        write_clean(month_rows(spark), str(tmp_path))


@pytest.mark.parametrize("fmt,options", [("csv", {"header": True}), ("json", {}), ("orc", {})])
def test_raw_tables_in_other_formats(spark, tmp_path, fmt, options):
    for name in schemas.RAW:
        table(spark, name, [{}]).write.format(fmt).options(**options).save(f"{tmp_path}/{name}")
    t = read_raw(spark, str(tmp_path), fmt, **options)
    assert values(business_review.monthly_kpis(t)) == [(date(2024, 1, 1), 100.0, 1, 100.0, 1)]
    assert values(t.agents) == [(1, "Ravi", "Chennai", "chennai")]


def test_star_tables_use_every_base_row(spark):
    t = star_tables(spark, SF)
    pairs = {
        "orders": "orders",
        "customers": "customer",
        "restaurants": "part",
        "deliveries": "lineitem",
        "delivery_agents": "supplier",
    }
    for name, base in pairs.items():
        assert t.table(name).count() == spark.read.parquet(f"{SF}/{base}.parquet").count()
        kept = [f.dataType for f in t.load(name).schema.fields]
        assert kept == [f.dataType for f in schemas.RAW[name].fields]


def test_star_tables_hold_the_dirt_the_analyses_need(spark):
    t = star_tables(spark, "/root/testdata/sf0.01")
    assert t.orders.select("status").distinct().count() == 4
    assert t.orders.filter("order_amount is null").count() > 0
    assert t.orders.filter("status_key = 'delivered' and delivery_time_minutes is null").count() > 0
    assert t.orders.filter("order_dt is null").count() == t.orders.filter("order_date = 'not known'").count()
    assert t.customers.filter("signup_dt is null").count() == 0
    assert t.customers.filter("city is null").count() > 0
    assert t.orders.join(t.restaurants, "restaurant_id", "left_anti").count() > 0
    assert t.restaurants.join(t.orders, "restaurant_id", "left_anti").count() > 0
    assert t.customers.join(t.orders, "customer_id", "left_anti").count() > 0
    assert t.deliveries.filter("delivery_rating is null").count() > 0


def test_orders_can_be_restricted(spark):
    t = month_rows(spark).with_orders(lambda o: o.filter("order_month = '2024-02-01'"))
    assert values(business_review.monthly_volume(t)) == [(date(2024, 2, 1), 2, 100.0)]


def test_the_views_hold_rows_for_every_outer_join(spark):
    t = star_tables(spark, "/root/testdata/sf0.001")
    assert t.orders.join(t.customers, "customer_id", "left_anti").count() > 0
    assert t.deliveries.join(t.agents, "agent_id", "left_anti").count() > 0
    assert t.deliveries.join(t.orders, "order_id", "left_anti").count() > 0
    assert t.agents.join(t.deliveries, "agent_id", "left_anti").count() > 0
    assert t.orders.filter("order_dt is null").count() > 0
