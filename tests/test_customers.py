from datetime import date

from ordersight.plans import business_review, customers, revenue
from small import tables, values


def orders_of(*pairs, **extra):
    return [{"customer_id": c, "order_date": d, **extra} for c, d in pairs]


def people(*ids):
    return [{"customer_id": i, "customer_name": f"c{i}"} for i in ids]


def test_churned_are_in_the_first_month_and_not_in_the_last(spark):
    orders = orders_of((1, "2024-01-05"), (1, "2024-01-06"), (2, "2024-01-31"), (2, "2024-03-01"),
                       (3, "2024-03-05"), (4, "2024-01-09"))
    cancelled_return = [{"customer_id": 4, "order_date": "2024-03-09", "status": "cancelled"}]
    t = tables(spark, orders=orders + cancelled_return, customers=people(1, 2, 3, 4))
    rows = sorted(values(customers.churned_customers(t)))
    assert rows == [(1, "c1", "churned_customer", 2), (4, "c4", "churned_customer", 2)]


def test_churn_profile_weighs_orders_by_attempts_or_not(spark):
    orders = orders_of((1, "2024-01-05"), order_amount=100, delivery_time_minutes=10)
    orders += orders_of((1, "2024-02-05"), order_amount=400, delivery_time_minutes=40)
    attempts = [{"order_id": 1, "delivery_rating": r} for r in (5, 5, 2)]
    t = tables(spark, orders=orders, deliveries=attempts)
    assert values(business_review.churn_vs_service(t)) == [("churned", 175.0, 4.0, 17.5)]
    assert values(business_review.churn_vs_service(t, grain="order")) == [
        ("churned", 250.0, 4.0, 25.0)
    ]


def test_segments(spark):
    orders = []
    for customer in (1, 2, 3, 4):
        orders += orders_of(*[(customer, "2024-01-05")] * customer)
    rows = sorted(values(revenue.frequency_segment_share(tables(spark, orders=orders))))
    assert rows == [
        ("Occasional_customer", 500.0, 50.0),
        ("One_time_customer", 100.0, 10.0),
        ("Regular_customer", 400.0, 40.0),
    ]


def test_repeat_buckets_count_customers_without_orders(spark):
    orders = orders_of((1, "2024-01-05"), (1, "2024-01-06"), (2, "2024-01-05"), (99, "2024-01-05"))
    t = tables(spark, orders=orders, customers=people(1, 2, 3, 4))
    assert sorted(values(customers.repeat_buckets(t))) == [("0", 2), ("=1", 1), (">1", 1)]


def test_reorder_gap_same_day_later_and_single(spark):
    orders = orders_of((1, "2024-01-05"), (1, "2024-01-05"), (1, "2024-02-05"),
                       (2, "2024-01-30"), (2, "2024-01-10"), (2, "2024-01-15"), (3, "2024-01-05"))
    t = tables(spark, orders=orders)
    gaps = {r[0]: (r[1].day, r[2] and r[2].day, r[4]) for r in values(customers.reorder_gaps(t))}
    assert gaps == {1: (5, 5, 0), 2: (10, 15, 5), 3: (5, None, None)}
    assert values(customers.average_reorder_gap(t)) == [(2, 2.5)]


def test_reorder_gap_ignores_unreadable_dates(spark):
    t = tables(spark, orders=orders_of((1, "soon"), (1, "2024-01-05")))
    assert values(customers.reorder_gaps(t)) == [(1, date(2024, 1, 5), None, 200.0, None)]


def test_lapsing_needs_both_spend_and_silence(spark):
    orders = orders_of((1, "2024-01-01"), (2, "2024-01-01"), (3, "2024-02-20"), order_amount=2001)
    orders += orders_of((2, "2024-03-01"), (4, "2024-01-01"), order_amount=2000)
    cities = [{"customer_id": 1, "city": "Pondy"}, {"customer_id": 3, "city": "Chennai"}]
    t = tables(spark, orders=orders, customers=cities)
    assert values(customers.lapsing_high_value(t)) == [(1,)]
    assert values(customers.lapsing_by_city(t)) == [("pondicherry", 1)]


def test_cancellation_before_churn_counts_one_month_customers(spark):
    orders = orders_of((1, "2024-01-05"), (2, "2024-01-05"), (2, "2024-02-05"), (3, "2024-01-06"))
    orders += [{"customer_id": 3, "order_date": "2024-01-20", "status": " Cancelled"}]
    orders += orders_of((1, "2025-06-01"))
    t = tables(spark, orders=orders)
    quarter = (date(2024, 1, 1), date(2024, 3, 31))
    assert values(customers.cancellation_before_churn(t, scope=quarter)) == [(2, 1, 50.0)]
    assert values(customers.cancellation_before_churn(t)) == [(1, 1, 100.0)]


def test_no_one_month_customers_gives_no_rate(spark):
    t = tables(spark, orders=orders_of((1, "2024-02-05")))
    assert values(customers.cancellation_before_churn(t)) == [(0, None, None)]


def test_cancel_rates_round_before_scaling_or_cut(spark):
    orders = [{"status": "cancelled"}, {"status": "CANCELLED "}, {}]
    t = tables(spark, orders=orders + [{"customer_id": 2}, {"customer_id": 77}])
    rates = {r[0]: r[2:] for r in values(customers.cancel_rate(t))}
    # Customers 2 and 77 are not in the customer table and share the NULL row.
    assert rates == {1: (3, 2, 67.0), None: (2, 0, 0.0)}
    assert values(customers.cancel_rate_min_orders(t)) == [(1, "Asha", 3, 2, 66)]


def test_favourites_keep_ties_and_need_a_second_order(spark):
    orders = [{"restaurant_id": r} for r in (1, 1, 2, 2, 3)] + [{"customer_id": 2}]
    t = tables(spark, orders=orders, customers=people(1, 2), restaurants=[{}, {}])
    assert sorted(values(customers.favourite_restaurant(t), "customer_id", "restaurant_id")) == [
        (1, 1),
        (1, 2),
    ]


def test_cohorts_share_the_whole(spark):
    signups = [("2021-05-01", 1), ("01-Jun-2022", 2), ("2022-01-01", 3)]
    t = tables(
        spark,
        orders=orders_of((1, "2024-01-05"), (2, "2024-01-05"), (2, "2024-01-06"))
        + [{"customer_id": 2, "order_amount": None}],
        customers=[{"customer_id": i, "signup_date": s} for s, i in signups],
    )
    assert sorted(values(customers.signup_cohorts(t))) == [
        (2021, 100.0, 100.0, 1, 25.0, 33.33),
        (2022, 200.0, 100.0, 3, 75.0, 66.67),
    ]


def test_peak_month_keeps_ties_over_years(spark):
    days = ["2021-03-01", "05-Mar-2021", "2022-01-01", "2022-01-09", "2022-07-01"]
    t = tables(spark, customers=[{"signup_date": d} for d in days])
    assert sorted(values(customers.peak_signup_month(t))) == [("January", 2), ("March", 2)]
    assert len(values(customers.signups_by_month(t))) == 3


def test_top_spenders_and_imputed_amounts(spark):
    orders = [{"customer_id": 1, "order_amount": 900}, {"customer_id": 2, "order_amount": None},
              {"customer_id": 2, "order_amount": 10},
              {"customer_id": 3, "order_amount": 5000, "status": "cancelled"}]
    t = tables(spark, orders=orders, customers=people(1, 2, 3))
    assert values(revenue.top_spenders(t, k=2)) == [(1, "c1", 900.0), (2, "c2", 10.0)]
    imputed = values(revenue.top_spenders(t, status=None, fill=5000))
    assert imputed == [(2, "c2", 5010.0), (3, "c3", 5000.0), (1, "c1", 900.0)]


def test_lifetime_value_counts_orders_without_amount(spark):
    orders = [{"customer_id": 1, "order_amount": 300}, {"customer_id": 1, "order_amount": None}]
    assert values(revenue.customer_lifetime_value(tables(spark, orders=orders))) == [
        (1, 150.0, 2, 300.0, 1)
    ]
