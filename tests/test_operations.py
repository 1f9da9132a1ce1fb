from pyspark.sql import functions as F

from ordersight.operators import conditional_rate
from ordersight.plans import audits, operations, revenue
from small import tables, values


def rated(agent, *ratings, **extra):
    return [{"agent_id": agent, "delivery_rating": r, **extra} for r in ratings]


def test_fan_out_inflates_a_naive_sum(spark):
    t = tables(spark, orders=[{"order_amount": 500}], deliveries=[{"order_id": 1}] * 3)
    assert values(audits.join_inflated_revenue(t)) == [(1500.0, 500.0, 1000.0)]


def test_inflation_keeps_orders_without_delivery(spark):
    t = tables(spark, orders=[{}, {"order_amount": None}, {}], deliveries=[{"order_id": 1}])
    assert values(audits.join_inflated_revenue(t)) == [(200.0, 200.0, 0.0)]


def test_missing_and_conflicting_deliveries(spark):
    orders = [{}, {"status": " CANCELLED"}, {"status": "DELIVERED "}, {"status": "cancelled"}]
    t = tables(spark, orders=orders, deliveries=[{"order_id": i} for i in (1, 2, 2)])
    assert values(audits.delivered_without_delivery(t)) == [(3, "delivered", None)]
    assert values(audits.cancelled_with_delivery(t)) == [("delivered", 2, " CANCELLED")] * 2


def test_cross_city_ignores_unknown_cities_and_resolves_aliases(spark):
    homes = [{"city": "Pondy"}, {"city": None}, {"city": " chennai"}]
    places = [{"city": "Pondicherry"}, {"city": "Chennai"}]
    orders = [{"customer_id": c, "restaurant_id": r} for c in (1, 2, 3, 9) for r in (1, 2, 8)]
    t = tables(spark, orders=orders, customers=homes, restaurants=places)
    assert values(audits.cross_city_orders(t)) == [
        (1, 2, "pondicherry", "chennai"),
        (3, 7, "chennai", "pondicherry"),
    ]


def test_cross_city_agents(spark):
    t = tables(
        spark,
        deliveries=[{"agent_id": 1}, {"agent_id": 2}, {"agent_id": 3}],
        delivery_agents=[{"city": "CHENNAI "}, {"city": "Madurai"}, {"city": None}],
        orders=[{}, {}, {}],
    )
    # The default delivery belongs to order 1.
    assert values(audits.cross_city_agents(t)) == [(1, 2, "madurai", "chennai")]


def test_uncleaned_label_error(spark):
    homes = [{"city": c} for c in ("Chennai", "CHENNAI", "chennai ", "Madurai")]
    t = tables(spark, orders=[{"customer_id": i} for i in (1, 2, 3, 4)], customers=homes)
    assert values(audits.uncleaned_city_error(t)) == [(300.0, 100.0, 200.0)]
    assert values(audits.uncleaned_city_error(t, spelling="Chenai")) == []


def test_one_rating_has_no_sample_variance_and_ranks_last(spark):
    t = tables(spark, deliveries=rated(1, 5) + rated(2, 1, 5) + rated(3, 3, 4) + rated(4, 4, 3))
    rows = sorted(values(operations.most_consistent_agents(t)))
    assert rows == [(3, 2, 0.5, 1), (4, 2, 0.5, 1)]


def test_leaderboard_scores(spark):
    deliveries = rated(1, 5, order_id=1) + rated(1, 5, order_id=1) + rated(1, 4, order_id=2)
    deliveries += rated(2, 1, order_id=3) + rated(2, 5, order_id=99) + rated(3, None, order_id=3)
    t = tables(spark, orders=[{}, {}, {}], deliveries=deliveries)
    rows = {r[0]: r[1:] for r in values(operations.agent_leaderboard(t))}
    # Agent 2 handled one known order; its variance 4 is the largest. Agent 3 is unrated.
    assert rows[1] == (2, 4.67, 0.222, 0.934, 1.0, 0.944, 0.956)
    assert rows[2] == (1, 3.0, 4.0, 0.6, 0.5, 0.0, 0.45)
    assert rows[3] == (1, None, None, None, 0.5, None, None)


def test_monthly_leaderboard_compares_within_the_month(spark):
    orders = [{}, {}, {"order_date": "2024-02-05"}]
    deliveries = rated(1, 5, order_id=1) + rated(1, 3, order_id=2) + rated(2, 4, order_id=3)
    t = tables(spark, orders=orders, deliveries=deliveries)
    rows = values(
        operations.agent_leaderboard(t, monthly=True), "agent_id", "volume_score"
    )
    assert sorted(rows) == [(1, 1.0), (2, 1.0)]


def test_speed_buckets(spark):
    minutes = [29, 30, 44, 45, 59, 60, None]
    t = tables(
        spark,
        orders=[{"delivery_time_minutes": m} for m in minutes],
        deliveries=[{"order_id": i, "delivery_rating": i % 5 + 1} for i in range(1, 8)],
    )
    rows = dict(values(operations.rating_by_speed(t).select("speed_bucket", "avg_rating")))
    assert rows == {
        "fast_delivery": 2.0,
        "medium_delivery": 3.5,
        "slow_delivery": 3.0,
        "very_slow_delivery": 2.0,
        "unknown": 3.0,
    }


def test_equal_restaurants_share_the_lead(spark):
    t = tables(
        spark,
        orders=[{"restaurant_id": r} for r in (1, 2)],
        restaurants=[{"restaurant_name": "a"}, {"restaurant_name": "b"}],
    )
    assert sorted(values(revenue.top_restaurant(t))) == [(1, "a", 100.0, 1), (2, "b", 100.0, 1)]
    assert values(revenue.top_city_revenue(t)) == [("Chennai", 200.0)]


def test_restaurant_without_sales_ranks_first_unless_nulls_last(spark):
    orders = [{"restaurant_id": r, "order_amount": a} for r, a in ((1, 300), (2, 100))]
    t = tables(spark, orders=orders, restaurants=[{}, {}, {}])
    first = sorted(values(revenue.top_restaurants_share(t, k=1), "restaurant_id", "revenue_pct"))
    assert first == [(3, None)]
    last = values(revenue.top_restaurants_share(t, k=1, nulls="last"), "restaurant_id", "revenue_pct")
    assert last == [(1, 75.0)]
    assert values(revenue.top_restaurants_offline(t, k=1)) == [(1, 400.0, 300.0, 100.0, 75.0)]


def test_unknown_restaurants_form_their_own_category(spark):
    orders = [{"restaurant_id": 9, "order_amount": 500}, {"restaurant_id": 1}]
    assert values(revenue.top_category_revenue(tables(spark, orders=orders))) == [(None, 500.0, 1)]


def test_slowest_orders_rank_attempts_and_count_recurrence(spark):
    orders = [{"delivery_time_minutes": m, "restaurant_id": r} for m, r in ((90, 1), (80, 2), (80, 1), (5, 1))]
    deliveries = [{"order_id": 1, "agent_id": 1}, {"order_id": 1, "agent_id": 2},
                  {"order_id": 2, "agent_id": 1}, {"order_id": 3, "agent_id": 3},
                  {"order_id": 3, "agent_id": 3, "delivery_status": "Failed"}, {"order_id": 4}]
    t = tables(spark, orders=orders, deliveries=deliveries, restaurants=[{}, {"city": "Madurai"}])
    rows = values(operations.slowest_orders(t, k=3).drop("restaurant_name", "city_key"))
    assert rows == [
        (1, 1, 1, 90, 3, 2, 3),
        (1, 1, 2, 90, 3, 1, 3),
        (2, 2, 1, 80, 1, 2, 1),
        (3, 1, 3, 80, 3, 1, 3),
    ]
    assert len(values(operations.slowest_orders(t, k=2))) == 2


def test_efficiency_at_both_grains_and_unknown_restaurants(spark):
    orders = [{}, {"status": "cancelled"}, {"restaurant_id": 7}, {"restaurant_id": 8}]
    deliveries = [{"order_id": 1, "delivery_rating": r} for r in (5, 4, None)]
    t = tables(spark, orders=orders, deliveries=deliveries)
    assert sorted(values(operations.restaurant_efficiency(t)), key=str) == [
        (1, 3, 4, 4.5, 3.38),
        (None, 2, 2, None, None),
    ]
    per_order = values(operations.restaurant_efficiency(t, grain="order"))
    assert (1, 1, 2, 4.5, 2.25) in per_order


def test_best_agent_by_raw_or_clean_city(spark):
    agents = [{"city": "Chennai"}, {"city": "chennai"}, {"city": "Chennai"}]
    t = tables(spark, delivery_agents=agents, deliveries=rated(1, 5, 4) + rated(2, 3))
    raw = sorted(values(operations.best_agent_per_city(t), "agent_id", "avg_rating"))
    assert raw == [(2, 3.0), (3, None)]
    clean = operations.best_agent_per_city(t, clean_city=True, nulls="last")
    assert values(clean, "agent_id", "city", "avg_rating") == [(1, "chennai", 4.5)]


def test_rating_distribution_counts_unrated_in_the_whole(spark):
    t = tables(spark, deliveries=rated(1, 1, 3, 5, None))
    assert values(operations.rating_distribution(t)) == [
        ("1", 1, 25.0, 50.0),
        ("3", 1, 25.0, 50.0),
        ("5", 1, 25.0, 50.0),
        ("unrated", 1, 25.0, 50.0),
    ]


def test_unrated_and_failed_per_agent(spark):
    deliveries = rated(1, 5, None) + rated(1, 2, delivery_status=" Failed")
    deliveries += rated(1, 1, delivery_status=None) + rated(2, 4) + rated(9, None)
    t = tables(spark, deliveries=deliveries, delivery_agents=[{}, {}, {}])
    assert values(operations.unrated_by_agent(t)) == [(1, "Ravi", 5.0, 1, 50.0)]
    assert values(operations.failed_by_agent(t), "agent_id", "failed_deliveries") == [
        (1, 1), (2, 0), (3, 0)
    ]
    # The unknown status keeps its rating, the failed one does not.
    assert values(operations.load_vs_rating(t)) == [(2, 1, 4.0), (1, 4, 3.0)]
    busiest = values(operations.busiest_agents(t, k=1), "agent_id", "delivery_count")
    assert busiest == [(1, 4)]


def test_zero_cancelled_and_missing_amounts(spark):
    orders = [{"restaurant_id": 1, "status": "cancelled"}, {"restaurant_id": 2},
              {"restaurant_id": 2, "order_amount": None}, {"restaurant_id": 3, "order_amount": None}]
    t = tables(spark, orders=orders)
    assert values(operations.zero_cancel_restaurants(t)) == [(2, 0), (3, 0)]
    assert sorted(values(revenue.missing_revenue_exposure(t))) == [
        (2, 100.0, 1, 100.0),
        (3, None, 1, None),
    ]


def test_pivot_counts_orders_once_and_weighs_averages(spark):
    orders = [{"order_date": d, "delivery_time_minutes": m} for d, m in
              (("2024-01-02", 10), ("2024-01-03", 30), ("2024-03-01", None))]
    deliveries = [{"order_id": 1, "delivery_rating": r} for r in (5, 2, None)]
    t = tables(spark, orders=orders, deliveries=deliveries)
    assert values(operations.city_restaurant_pivot(t)) == [(1, "Dosa Corner", 3.5, 15.0, 2, 0, 1)]


def test_high_value_orders(spark):
    amounts = ((1, 1500), (1, 1001), (2, 1000), (3, 2000))
    t = tables(spark, orders=[{"restaurant_id": r, "order_amount": a} for r, a in amounts])
    assert values(revenue.high_value_orders(t)) == [(1, 2, 3, 81.82), (3, 1, 3, 81.82)]


def test_city_favourite_category(spark):
    homes = [{"city": "Pondy"}, {"city": "Chennai "}, {"city": "Madurai"}]
    places = [{"category": "Cafe"}, {"category": "Pizza"}]
    pairs = [(1, 1), (1, 1), (1, 2), (2, 2), (2, 1), (3, 1)]
    orders = [{"customer_id": c, "restaurant_id": r} for c, r in pairs]
    t = tables(spark, orders=orders, customers=homes, restaurants=places)
    assert sorted(values(operations.city_favourite_category(t))) == [
        ("chennai", "Cafe", 1, 1),
        ("chennai", "Pizza", 1, 1),
        ("pondicherry", "Cafe", 2, 1),
    ]


def test_slowest_category_weighs_orders_by_attempts(spark):
    orders = [{"restaurant_id": 1, "delivery_time_minutes": 50},
              {"restaurant_id": 1, "delivery_time_minutes": 10}, {"restaurant_id": 2}]
    deliveries = [{"order_id": i} for i in (1, 1, 1, 2, 3)]
    places = [{"category": "Cafe"}, {"category": "Pizza"}]
    t = tables(spark, orders=orders, deliveries=deliveries, restaurants=places)
    assert values(operations.slowest_category(t)) == [("Cafe", 40.0, 1)]


def test_status_split_counts_other_statuses_in_the_whole(spark):
    statuses = ["Delivered", " delivered", "CANCELLED", "refunded", None]
    t = tables(spark, orders=[{"status": s} for s in statuses])
    assert values(operations.status_split(t)) == [(2, 1, 40.0, 20.0)]


def test_conditional_rate_per_key(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), ("a", 6), ("b", 2)], "k string, v int")
    rows = conditional_rate(df, ["k"], {"high": F.col("v") > 4})
    assert sorted(values(rows)) == [("a", 2, 66.67), ("b", 0, 0.0)]
