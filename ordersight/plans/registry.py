"""Every analysis by key, and the parameters that fit the star-schema data."""

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordersight.plans import audits, business_review, customers, marts, operations, revenue
from ordersight.session import tune
from ordersight.sources import Tables, star_tables

ANALYSES: dict[str, Callable[..., DataFrame]] = {
    "q01_total_revenue": revenue.total_revenue,
    "q02_status_split": operations.status_split,
    "q03_top_spenders": revenue.top_spenders,
    "q03b_top_spenders_imputed": revenue.top_spenders,
    "q04_avg_delivery_time": operations.average_delivery_time,
    "q05_top_city_revenue": revenue.top_city_revenue,
    "q06_agent_avg_rating": operations.agent_average_rating,
    "q07_top_restaurant": revenue.top_restaurant,
    "q08_orders_per_restaurant": operations.orders_per_restaurant,
    "q09_peak_signup_month": customers.peak_signup_month,
    "q10_failed_by_agent": operations.failed_by_agent,
    "q11_top_category_revenue": revenue.top_category_revenue,
    "q12_busiest_agents": operations.busiest_agents,
    "q13_repeat_buckets": customers.repeat_buckets,
    "q14_monthly_revenue": revenue.monthly_revenue,
    "q15_slowest_category": operations.slowest_category,
    "q16_best_agent_per_city": operations.best_agent_per_city,
    "q16_best_rated_agent_per_city": operations.best_agent_per_city,
    "q17_cancel_rate": customers.cancel_rate,
    "q17b_cancel_rate_min_orders": customers.cancel_rate_min_orders,
    "q18_top_city_aov": revenue.top_city_order_value,
    "q19_rating_distribution": operations.rating_distribution,
    "q20_unrated_by_agent": operations.unrated_by_agent,
    "q21_favourite_restaurant": customers.favourite_restaurant,
    "q22_weekday_weekend": revenue.weekday_weekend,
    "q23_signup_cohorts": customers.signup_cohorts,
    "q24_slowest_orders": operations.slowest_orders,
    "q24_slowest_timed_orders": operations.slowest_orders,
    "q25_load_vs_rating": operations.load_vs_rating,
    "q26_high_value_orders": revenue.high_value_orders,
    "q27_zero_cancel_restaurants": operations.zero_cancel_restaurants,
    "q28_city_favourite_category": operations.city_favourite_category,
    "q29_delivered_without_delivery": audits.delivered_without_delivery,
    "q30_agent_revenue_rank": revenue.agent_revenue_rank,
    "q31_churned_customers": customers.churned_customers,
    "q32_top3_share": revenue.top_restaurants_share,
    "q32_top3_selling_share": revenue.top_restaurants_share,
    "q33_uncleaned_city_error": audits.uncleaned_city_error,
    "q34_clv_top10": revenue.customer_lifetime_value,
    "q35_most_consistent_agent": operations.most_consistent_agents,
    "q36_cancelled_with_delivery": audits.cancelled_with_delivery,
    "q37_revenue_spikes": revenue.revenue_spikes,
    "q37_spike_drivers": revenue.revenue_spike_drivers,
    "q38_reorder_gap": customers.reorder_gaps,
    "q39_cross_city_orders": audits.cross_city_orders,
    "q40_rating_by_speed_bucket": operations.rating_by_speed,
    "q41_join_inflation": audits.join_inflated_revenue,
    "q42_restaurant_efficiency": operations.restaurant_efficiency,
    "q42_restaurant_efficiency_per_order": operations.restaurant_efficiency,
    "q43_lapsing_high_value": customers.lapsing_high_value,
    "q44_frequency_segments": revenue.frequency_segment_share,
    "q45_missing_revenue_exposure": revenue.missing_revenue_exposure,
    "q46_cross_city_agents": audits.cross_city_agents,
    "q47_mom_growth_labelled": revenue.growth_labelled,
    "q48_cancel_leads_churn": customers.cancellation_before_churn,
    "q49_agent_leaderboard": operations.agent_leaderboard,
    "q50_city_restaurant_pivot": operations.city_restaurant_pivot,
    "b1_monthly_kpis": business_review.monthly_kpis,
    "b2_mom_growth": business_review.monthly_growth,
    "b3_volume_and_aov": business_review.monthly_volume,
    "b4_orders_region_month": business_review.orders_by_region,
    "b5_revenue_region_month": business_review.revenue_by_region,
    "b6_city_frequency": business_review.city_frequency,
    "b7_city_restaurant_month": business_review.city_restaurant_orders,
    "b8_churn_vs_service": business_review.churn_vs_service,
    "b8_churn_vs_service_per_order": business_review.churn_vs_service,
    "b9_weekly_kpis": business_review.kpis_by_period,
    "b10_quarterly_kpis": business_review.kpis_by_period,
    "b11_daily_growth": business_review.growth_by_period,
    "b12_orders_region_quarter": business_review.orders_by_region_period,
    "m1_monthly_kpis": marts.kpis_of_marts,
    "m2_quarterly_kpis": marts.kpis_of_marts,
    "m3_region_quarter_kpis": marts.regional_kpis_of_marts,
    "m4_city_frequency": marts.city_frequency_of_marts,
    "m5_city_frequency_by_quarter": marts.city_frequency_of_marts,
    "d1_driver_decomposition": business_review.driver_decomposition,
    "d2_decline_concentration": business_review.decline_concentration,
    "d3_full_signups_by_month": customers.signups_by_month,
    "d4_avg_reorder_gap": customers.average_reorder_gap,
    "d5_lapsing_by_city": customers.lapsing_by_city,
    "d6_growth_clean_vs_naive": revenue.growth_clean_vs_naive,
    "d7_monthly_leaderboard": operations.agent_leaderboard,
    "d8_top3_offline_impact": revenue.top_restaurants_offline,
    "d9_reorder_speed_vs_spend": customers.reorder_speed_vs_spend,
    "d10_clv_among_top_spenders": revenue.clv_among_top_spenders,
    "d11_least_consistent_agent": operations.most_consistent_agents,
    "d12_flagged_customers": customers.cancel_rate_min_orders,
    "d13_load_vs_rating_fit": operations.load_vs_rating_fit,
    "d14_speed_vs_rating_fit": operations.speed_vs_rating_fit,
    "d15_weekday_weekend_per_day": revenue.weekday_weekend_per_day,
    "d16_missing_revenue_policies": revenue.missing_revenue_policies,
    "d17_city_decline_by_restaurant": business_review.city_decline_by_restaurant,
}

FIRST, SECOND, THIRD = date(1995, 1, 1), date(1995, 2, 1), date(1995, 3, 1)
CITY = "africa"
ALIASES = {"mideast": "middle east"}
LAPSING = {"min_total": 2_000_000, "idle_days": 45}

# The defaults of the analyses are those of the original quarter; the star-schema data has
# other months, cities and price levels.
STAR_PARAMETERS: dict[str, dict] = {
    "q03b_top_spenders_imputed": {"status": None, "fill": 5000},
    "q16_best_rated_agent_per_city": {"clean_city": True, "nulls": "last"},
    "q24_slowest_timed_orders": {"nulls": "last"},
    "q26_high_value_orders": {"threshold": 400_000},
    "q28_city_favourite_category": {"cities": (CITY, "middle east"), "aliases": ALIASES},
    "q31_churned_customers": {"first": FIRST, "last": THIRD},
    "q32_top3_selling_share": {"nulls": "last"},
    "q33_uncleaned_city_error": {"spelling": "AFRICA", "canonical": CITY},
    "q39_cross_city_orders": {"aliases": ALIASES},
    "q42_restaurant_efficiency_per_order": {"grain": "order"},
    "q43_lapsing_high_value": LAPSING,
    "q47_mom_growth_labelled": {"second": SECOND, "third": THIRD},
    "q48_cancel_leads_churn": {"only": FIRST, "scope": (FIRST, date(1995, 3, 31))},
    "q50_city_restaurant_pivot": {"city": CITY, "months": (FIRST, SECOND, THIRD)},
    "b6_city_frequency": {"city": CITY},
    "b7_city_restaurant_month": {"city": CITY},
    "b8_churn_vs_service": {"first": FIRST, "last": THIRD},
    "b8_churn_vs_service_per_order": {"first": FIRST, "last": THIRD, "grain": "order"},
    "b10_quarterly_kpis": {"grain": "quarter", "every": True},
    "m2_quarterly_kpis": {"grain": "quarter"},
    "m4_city_frequency": {"city": CITY},
    "m5_city_frequency_by_quarter": {"city": CITY, "grain": "quarter"},
    "d2_decline_concentration": {"first": FIRST, "last": SECOND},
    "d5_lapsing_by_city": {**LAPSING, "aliases": ALIASES},
    "d7_monthly_leaderboard": {"monthly": True},
    "d11_least_consistent_agent": {"least": True},
    "d12_flagged_customers": {"above": 50},
    "d17_city_decline_by_restaurant": {"city": CITY, "first": FIRST, "last": SECOND},
}


def comparable(df: DataFrame) -> DataFrame:
    """Plain types any engine shares: DECIMAL becomes DOUBLE, every integer BIGINT."""
    plain = {T.DecimalType: "double", T.IntegerType: "long", T.ShortType: "long"}
    return df.select(
        *[
            F.col(f.name).cast(plain[type(f.dataType)]).alias(f.name)
            if type(f.dataType) in plain
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def analyse(key: str, tables: Tables, **parameters) -> DataFrame:
    """Run one analysis by key."""
    return ANALYSES[key](tables, **parameters)


def star_query(key: str) -> Callable[[SparkSession, str], DataFrame]:
    """The analysis as a function of a session and a star-schema directory."""

    def run(spark: SparkSession, directory: str) -> DataFrame:
        tables = star_tables(tune(spark), directory)
        return comparable(analyse(key, tables, **STAR_PARAMETERS.get(key, {})))

    return run
