"""How the operation runs: statuses, delivery times, agents and restaurants."""

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.functions import (
    bucketize,
    mean,
    normalize_key,
    per_count,
    percent,
    sample_variance,
    variance,
)
from ordersight.operators import (
    conditional_rate,
    cut_to_ranks,
    distinct_in_periods,
    linear_fit,
    rank_table,
    rating_spread,
    top_k,
    weighted_score,
    with_group_sizes,
    with_total,
)
from ordersight.operators.branches import for_branches
from ordersight.plans.common import (
    CANCELLED,
    CITY_ALIASES,
    DELIVERED,
    FAILED,
    attempt_weight,
    delivered,
    delivered_attempts,
    is_cancelled,
    ratings_by,
    restaurant_names,
)
from ordersight.sources.tables import Tables


def status_split(t: Tables) -> DataFrame:
    """Delivered and cancelled orders, and their percentages of all orders."""
    status = F.col("status_key")
    return conditional_rate(
        t.orders, [], {"delivered": status == DELIVERED, "cancelled": status == CANCELLED}
    )


def average_delivery_time(t: Tables) -> DataFrame:
    return delivered(t.orders).agg(
        mean(F.col("delivery_time_minutes"), 2).alias("avg_delivery_minutes")
    )


def _agent_ratings(t: Tables, attempts: DataFrame, how: str, *agent_columns: str) -> DataFrame:
    """Attempts and rating sums per agent, with columns of the agent table."""
    agents = t.agents.select("agent_id", *agent_columns)
    joined = agents.join(ratings_by(attempts, "agent_id"), "agent_id", how)
    return joined.groupBy("agent_id", *agent_columns).agg(
        F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"),
        F.sum("rating_sum").alias("rating_sum"),
        F.coalesce(F.sum("rated"), F.lit(0)).alias("rated"),
    )


def agent_average_rating(t: Tables) -> DataFrame:
    """Average rating of delivered attempts per agent, best first."""
    ratings = _agent_ratings(t, delivered_attempts(t.deliveries), "inner", "agent_name")
    return ratings.select(
        "agent_id",
        "agent_name",
        per_count(F.col("rating_sum"), F.col("rated"), 1).alias("avg_rating"),
    ).orderBy(F.col("avg_rating").desc_nulls_first(), "agent_id")


def orders_per_restaurant(t: Tables) -> DataFrame:
    """Order count of every restaurant, zero included."""
    counts = t.orders.groupBy("restaurant_id").agg(F.count("order_id").alias("_orders"))
    return (
        restaurant_names(t.restaurants)
        .join(counts, "restaurant_id", "left")
        .groupBy("restaurant_id", "restaurant_name")
        .agg(F.coalesce(F.sum("_orders"), F.lit(0)).alias("order_count"))
        .orderBy("restaurant_id")
    )


def failed_by_agent(t: Tables) -> DataFrame:
    """Failed attempts of every agent, zero included."""
    failed = (
        t.deliveries.filter(F.col("delivery_status_key") == FAILED)
        .groupBy("agent_id")
        .agg(F.count("delivery_id").alias("_failed"))
    )
    return (
        t.agents.select("agent_id", "agent_name")
        .join(failed, "agent_id", "left")
        .groupBy("agent_id", "agent_name")
        .agg(F.coalesce(F.sum("_failed"), F.lit(0)).alias("failed_deliveries"))
        .orderBy(F.col("failed_deliveries").desc(), "agent_id")
    )


def busiest_agents(t: Tables, k: int = 5) -> DataFrame:
    """Agents whose delivery count ranks within ``k`` (dense); unknown agents under NULL."""
    counts = t.deliveries.groupBy("agent_id").agg(F.count("order_id").alias("_deliveries"))
    names = t.agents.select(F.col("agent_id").alias("_known"), "agent_name")
    named = (
        counts.join(names, F.col("agent_id") == F.col("_known"), "left")
        .groupBy(F.col("_known").alias("agent_id"), "agent_name")
        .agg(F.sum("_deliveries").alias("delivery_count"))
    )
    return top_k(named, "delivery_count", k, ties="dense")


def slowest_category(t: Tables) -> DataFrame:
    """Categories sharing the highest average minutes over delivered attempts."""
    attempts = (
        delivered_attempts(t.deliveries).groupBy("order_id").agg(F.count(F.lit(1)).alias("attempts"))
    )
    minutes = F.col("delivery_time_minutes")
    per_restaurant = (
        t.orders.select("order_id", "restaurant_id", "delivery_time_minutes")
        .join(attempts, "order_id")
        .groupBy("restaurant_id")
        .agg(
            F.sum(minutes * F.col("attempts")).alias("_minutes"),
            F.sum(F.when(minutes.isNotNull(), F.col("attempts"))).alias("_timed"),
        )
    )
    categories = t.restaurants.select("restaurant_id", "category")
    by_category = (
        per_restaurant.join(categories, "restaurant_id", "left")
        .groupBy("category")
        .agg(
            per_count(F.sum("_minutes"), F.sum("_timed"), 2).alias("avg_delivery_minutes")
        )
    )
    return top_k(by_category, "avg_delivery_minutes", 1)


def best_agent_per_city(
    t: Tables, clean_city: bool = False, nulls: str | None = None
) -> DataFrame:
    """Agents sharing the best average rating of their city, as spelled in the agent table.

    Agents without a rated delivery have a NULL average and win unless ``nulls='last'``.
    """
    city = "city_key" if clean_city else "city"
    ratings = _agent_ratings(t, delivered_attempts(t.deliveries), "left", "agent_name", city)
    averages = ratings.select(
        "agent_id",
        "agent_name",
        F.col(city).alias("city"),
        per_count(F.col("rating_sum"), F.col("rated"), 2).alias("avg_rating"),
    )
    return top_k(averages, "avg_rating", 1, within=["city"], nulls=nulls)


def rating_distribution(t: Tables, low: int = 3) -> DataFrame:
    """Deliveries per rating with their share, and the share of low ratings on every row.

    Unrated deliveries count in the whole of both shares.
    """
    per_rating = t.deliveries.groupBy("delivery_rating").agg(
        F.count("delivery_id").alias("delivery_count")
    )
    totals = with_total(
        per_rating,
        F.sum("delivery_count").alias("_all"),
        F.sum(F.when(F.col("delivery_rating") <= low, F.col("delivery_count"))).alias("_low"),
    )
    return totals.orderBy(F.col("delivery_rating").asc_nulls_last()).select(
        F.coalesce(F.col("delivery_rating").cast("string"), F.lit("unrated")).alias(
            "rating_bucket"
        ),
        "delivery_count",
        percent(F.col("delivery_count"), F.col("_all")).alias("delivery_pct"),
        percent(F.col("_low"), F.col("_all")).alias("low_rating_pct"),
    )


def unrated_by_agent(t: Tables) -> DataFrame:
    """Agents with unrated delivered attempts: average rating, unrated count and share."""
    ratings = _agent_ratings(t, delivered_attempts(t.deliveries), "inner", "agent_name")
    unrated = F.col("attempts") - F.col("rated")
    return ratings.filter(unrated > 0).select(
        "agent_id",
        "agent_name",
        per_count(F.col("rating_sum"), F.col("rated"), 2).alias("avg_rating"),
        unrated.alias("unrated_deliveries"),
        percent(unrated, F.col("attempts")).alias("unrated_pct"),
    )


def slowest_orders(t: Tables, k: int = 10, nulls: str | None = None) -> DataFrame:
    """Delivered attempts of the slowest orders, with how often place and agent recur there.

    Orders without minutes rank first unless ``nulls='last'``. The slowest minutes are found on orders weighted
    by their attempts; as one row they cut the orders before these meet attempts and restaurants' names. The
    rank and the rows read the same exchanges.
    """
    restaurants = t.restaurants.select("restaurant_id", "restaurant_name", "city_key")
    orders = for_branches(
        delivered(t.orders)
        .select("order_id", "restaurant_id", "delivery_time_minutes")
        .join(restaurants, "restaurant_id")
    )
    attempts = delivered_attempts(t.deliveries).select("order_id", "agent_id")
    timed = for_branches(orders.select("order_id", "delivery_time_minutes").join(attempts, "order_id"))
    ranks = rank_table(timed, "delivery_time_minutes", k, nulls=nulls)
    slow = cut_to_ranks(orders, ranks, "delivery_time_minutes").join(attempts, "order_id")
    out = with_group_sizes(
        for_branches(slow),
        count_by_restaurant="restaurant_id",
        count_by_agent="agent_id",
        count_by_city="city_key",
    )
    return out.select(
        "order_id",
        "restaurant_id",
        "restaurant_name",
        "agent_id",
        "city_key",
        "delivery_time_minutes",
        "count_by_restaurant",
        "count_by_agent",
        "count_by_city",
    ).orderBy(
        F.col("delivery_time_minutes").desc_nulls_last()
        if nulls == "last"
        else F.col("delivery_time_minutes").desc_nulls_first(),
        "order_id",
        "agent_id",
    )


def load_vs_rating(t: Tables) -> DataFrame:
    """Deliveries per known agent beside the average rating outside failed attempts.

    An attempt of unknown status keeps its rating.
    """
    failed = F.col("delivery_status_key") == FAILED
    kept = F.when(failed, F.lit(None)).otherwise(F.col("delivery_rating"))
    per_agent = t.deliveries.groupBy("agent_id").agg(
        F.count("order_id").alias("_deliveries"),
        F.sum(kept).alias("_rating_sum"),
        F.count(kept).alias("_rated"),
    )
    return (
        t.agents.select("agent_id")
        .join(per_agent, "agent_id")
        .groupBy("agent_id")
        .agg(
            F.sum("_deliveries").alias("delivery_count"),
            per_count(F.sum("_rating_sum"), F.sum("_rated"), 2).alias("avg_rating"),
        )
        .orderBy(F.col("avg_rating").desc_nulls_last(), "agent_id")
    )


def load_vs_rating_fit(t: Tables) -> DataFrame:
    """Whether busier agents are rated lower: slope and correlation over the agents of ``load_vs_rating``."""
    return linear_fit(load_vs_rating(t), "delivery_count", "avg_rating")


def speed_vs_rating_fit(t: Tables) -> DataFrame:
    """Whether slower orders are rated lower: slope and correlation over delivered orders."""
    ratings = ratings_by(t.deliveries, "order_id").select(
        "order_id", per_count(F.col("rating_sum"), F.col("rated"), 2).alias("avg_rating")
    )
    timed = delivered(t.orders).select("order_id", "delivery_time_minutes").join(ratings, "order_id")
    return linear_fit(timed, "delivery_time_minutes", "avg_rating")


def zero_cancel_restaurants(t: Tables) -> DataFrame:
    return (
        t.orders.groupBy("restaurant_id")
        .agg(F.count(F.when(is_cancelled(), F.col("order_id"))).alias("cancelled_orders"))
        .filter(F.col("cancelled_orders") == 0)
        .orderBy(F.col("restaurant_id").asc_nulls_last())
    )


def city_favourite_category(
    t: Tables,
    cities: Sequence[str] = ("chennai", "pondicherry"),
    aliases: Mapping[str, str] = CITY_ALIASES,
) -> DataFrame:
    """Categories ordered most often by the customers of each named city."""
    homes = t.customers.select(
        "customer_id", normalize_key(F.col("city"), aliases).alias("city")
    ).filter(F.col("city").isin(*cities))
    # The cities keep few orders, so they come before the first aggregate.
    per_restaurant = (
        t.orders.select("customer_id", "restaurant_id", "order_id")
        .join(homes, "customer_id")
        .groupBy("city", "restaurant_id")
        .agg(F.count("order_id").alias("_orders"))
    )
    per_category = (
        per_restaurant.join(t.restaurants.select("restaurant_id", "category"), "restaurant_id")
        .groupBy("city", "category")
        .agg(F.sum("_orders").alias("category_orders"))
    )
    return top_k(per_category, "category_orders", 1, within=["city"])


def most_consistent_agents(t: Tables, least: bool = False) -> DataFrame:
    """Agents sharing the lowest sample variance of delivered ratings, or the highest with ``least``.

    An unknown variance comes last.
    """
    attempts = delivered_attempts(t.deliveries)
    per_agent = attempts.groupBy("agent_id").agg(
        F.count("order_id").alias("delivery_count"), *rating_spread(attempts, "delivery_rating")
    )
    spread = sample_variance(F.col("rated"), F.col("rating_sum"), F.col("rating_squares"), 2)
    variances = per_agent.select("agent_id", "delivery_count", spread.alias("rating_variance"))
    return top_k(variances, "rating_variance", 1, ties="dense", descending=least, nulls="last")


# Labels of deliveries under 30, 45 and 60 minutes and above.
SPEED_LABELS = ("fast_delivery", "medium_delivery", "slow_delivery", "very_slow_delivery")


def rating_by_speed(t: Tables, labels: Sequence[str] = SPEED_LABELS) -> DataFrame:
    """Average rating of delivered orders by how long they took."""
    ratings = ratings_by(t.deliveries, "order_id")
    bucket = bucketize(F.col("delivery_time_minutes"), (30, 45, 60), labels, "unknown")
    return (
        delivered(t.orders)
        .select("order_id", bucket.alias("speed_bucket"))
        .join(ratings, "order_id", "left")
        .groupBy("speed_bucket")
        .agg(per_count(F.sum("rating_sum"), F.sum("rated"), 2).alias("avg_rating"))
        .orderBy(F.col("avg_rating").desc_nulls_first(), "speed_bucket")
    )


def restaurant_efficiency(t: Tables, grain: str = "delivery") -> DataFrame:
    """Delivered share times average rating per restaurant; unknown restaurants under NULL.

    ``grain='delivery'`` counts an order once per attempt, as the plain join does;
    ``'order'`` counts it once.
    """
    weight = attempt_weight() if grain == "delivery" else F.lit(1)
    per_order = t.orders.select("order_id", "restaurant_id", "status_key").join(
        ratings_by(t.deliveries, "order_id"), "order_id", "left"
    )
    per_restaurant = per_order.groupBy("restaurant_id").agg(
        F.sum(F.when(F.col("status_key") == DELIVERED, weight).otherwise(0)).alias("_delivered"),
        F.sum(weight).alias("_all"),
        F.sum("rating_sum").alias("_rating_sum"),
        F.sum("rated").alias("_rated"),
    )
    known = t.restaurants.select(F.col("restaurant_id").alias("_known"))
    scored = (
        per_restaurant.join(known, F.col("restaurant_id") == F.col("_known"), "left")
        .groupBy(F.col("_known").alias("restaurant_id"))
        .agg(
            F.sum("_delivered").alias("delivered_count"),
            F.sum("_all").alias("total_count"),
            per_count(F.sum("_rating_sum"), F.sum("_rated"), 2).alias("avg_rating"),
        )
    )
    return scored.withColumn(
        "efficiency_score",
        per_count(
            F.col("delivered_count").cast("decimal(20,0)") * F.col("avg_rating").cast("decimal(10,2)"),
            F.col("total_count"),
            2,
        ),
    )


# Weights of the agent score.
SCORE_WEIGHTS = {"quality_score": "0.50", "volume_score": "0.30", "consistency_score": "0.20"}


def agent_leaderboard(
    t: Tables, monthly: bool = False, weights: Mapping[str, str] = SCORE_WEIGHTS
) -> DataFrame:
    """Agents by a weighted score of rating, order volume and rating consistency.

    Volume and consistency are relative to the best agent, of the same month if ``monthly``.
    """
    keys = ["order_month"] if monthly else []
    orders = t.orders.select("order_id", *keys, F.lit(True).alias("_known"))
    # One row per agent and order: the join's partitioning by order serves this step too, and
    # counting its rows is the distinct count of orders.
    per_order = (
        t.deliveries.select("order_id", "agent_id", "delivery_rating")
        .join(orders, "order_id", "left")
        .groupBy(*keys, "agent_id", "order_id")
        .agg(F.max("_known").alias("_known"), *rating_spread(t.deliveries, "delivery_rating"))
    )
    metrics = (
        per_order.groupBy(*keys, "agent_id")
        .agg(
            F.count("_known").alias("order_volume"),
            F.sum("rated").alias("rated"),
            F.sum("rating_sum").alias("rating_sum"),
            F.sum("rating_squares").alias("rating_squares"),
        )
        .withColumn("avg_rating", per_count(F.col("rating_sum"), F.col("rated"), 2))
        .withColumn(
            "_variance",
            variance(F.col("rated"), F.col("rating_sum"), F.col("rating_squares")),
        )
    )
    best = [F.max("order_volume").alias("_top_volume"), F.max("_variance").alias("_top_variance")]
    if monthly:
        tops = metrics.groupBy(F.col("order_month").alias("_month")).agg(*best)
        beside = metrics.join(tops, F.col("order_month").eqNullSafe(F.col("_month")))
    else:
        beside = with_total(metrics, *best)
    steadiness = F.lit(1.0) - F.col("_variance") / F.nullif(F.col("_top_variance"), F.lit(0.0))
    scored = beside.select(
        *keys,
        "agent_id",
        "order_volume",
        "avg_rating",
        F.round(F.col("_variance").cast("decimal(20,12)"), 3).alias("rating_variance"),
        per_count(F.col("avg_rating"), F.lit(5), 3).alias("quality_score"),
        per_count(F.col("order_volume"), F.col("_top_volume"), 3).alias("volume_score"),
        F.round(steadiness.cast("decimal(20,12)"), 3).alias("consistency_score"),
    ).withColumn("agent_score", weighted_score(weights, 3))
    return scored.orderBy(*keys, F.col("agent_score").desc_nulls_first(), "agent_id")


def city_restaurant_pivot(
    t: Tables,
    city: str = "chennai",
    months: Sequence[date] = (date(2024, 1, 1), date(2024, 2, 1), date(2024, 3, 1)),
) -> DataFrame:
    """Rating, minutes and orders in three months for each restaurant of one city.

    Averages weigh an order by its attempts; the order counts are distinct.
    """
    restaurants = t.restaurants.filter(F.col("city_key") == city).select(
        "restaurant_id", "restaurant_name"
    )
    per_order = (
        delivered(t.orders)
        .select("order_id", "restaurant_id", "order_month", "delivery_time_minutes")
        .join(restaurants, "restaurant_id")
        .join(ratings_by(t.deliveries, "order_id"), "order_id", "left")
    )
    minutes = F.col("delivery_time_minutes")
    weighted = per_order.withColumns(
        {
            "_minutes": minutes * attempt_weight(),
            "_timed": F.when(minutes.isNotNull(), attempt_weight()),
        }
    )
    names = ("first_month_orders", "second_month_orders", "third_month_orders")
    per_restaurant = distinct_in_periods(
        weighted,
        ["restaurant_id", "restaurant_name"],
        "order_month",
        dict(zip(names, months)),
        "order_id",
        ["rating_sum", "rated", "_minutes", "_timed"],
    )
    return per_restaurant.select(
        "restaurant_id",
        "restaurant_name",
        per_count(F.col("rating_sum"), F.col("rated"), 2).alias("avg_rating"),
        per_count(F.col("_minutes"), F.col("_timed"), 2).alias("avg_delivery_minutes"),
        *names,
    ).orderBy("third_month_orders", "restaurant_id")
