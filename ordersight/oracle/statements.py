"""One statement per analysis key. NULL ordering is spelled out, ties follow rank windows."""


def ratio(n: str, d: str, places: int) -> str:
    """n / d for whole numbers, rounded half away from zero; NULL for d = 0."""
    scale = 10**places
    return (
        f"(case when ({d}) <> 0 then cast(sign({n}) * sign({d}) as bigint)"
        f" * ((2 * abs(cast({n} as hugeint)) * {scale} + abs({d})) // (2 * abs({d})))"
        f" / {scale}::double end)"
    )


def pct(n: str, d: str, places: int = 2) -> str:
    return ratio(f"100 * ({n})", d, places)


def money(cents: str) -> str:
    return f"(cast({cents} as double) / 100::double)"


def avg_money(where: str = "true") -> str:
    """Average amount over the rows that meet a condition."""
    return ratio(
        f"sum(cents) filter (where {where})", f"100 * count(cents) filter (where {where})", 2
    )


AVG_RATING = ratio("sum(rating)", "count(rating)", 2)
AVG_MINUTES = ratio("sum(minutes)", "count(minutes)", 2)
JAN, FEB, MAR = "date '1995-01-01'", "date '1995-02-01'", "date '1995-03-01'"


def best_by(source: str, value: str, columns: str, keep: str, *, rank: str = "rank", by: str = "",
            order: str = "desc nulls first") -> str:
    """Rows of a relation whose rank meets a condition, with the rank."""
    part = f"partition by {by} " if by else ""
    return (
        f"select {columns}, rnk from (select *, {rank}() over ({part}order by {value} {order})"
        f" as rnk from ({source})) where rnk {keep}"
    )


SPEND_BY_CUSTOMER = """
  select customer_id, customer_name, sum({value}) as cents
  from fd_orders join fd_customers using (customer_id) {where}
  group by all"""

RESTAURANT_REVENUE = """
  select r.restaurant_id, r.restaurant_name,
    (select sum(o.cents) from fd_orders o
     where o.restaurant_id = r.restaurant_id and o.is_delivered) as cents
  from fd_restaurants r"""

AGENT_CITY_RATING = f"""
  select a.agent_id, a.agent_name, a.{{city}} as city, {AVG_RATING} as avg_rating
  from fd_agents a left join fd_deliveries d on d.agent_id = a.agent_id and not d.is_failed
  group by all"""

ORDER_COUNTS = """
  select c.customer_id, c.customer_name, count(order_id) as total_orders,
    count(order_id) filter (where not is_delivered) as cancelled_orders
  from fd_orders o left join fd_customers c on c.customer_id = o.customer_id
  group by all"""

MONTHLY = """
  select month, sum(cents) as cents, count(order_id) as orders, count(cents) as priced,
    count(distinct customer_id) as customers
  from fd_orders where is_delivered group by month"""

REGION_MONTH = """
  select city_key as region, month, {fact}
  from fd_orders join fd_restaurants using (restaurant_id)
  where is_delivered group by all"""

def by_period(grain: str) -> str:
    """Cents, orders, priced orders and customers by period."""
    return f"""
  select cast(date_trunc('{grain}', day) as date) as period, sum(cents) as cents, count(order_id) as orders,
    count(cents) as priced, count(distinct customer_id) as customers
  from fd_orders where is_delivered group by 1"""


def period_kpis(grain: str) -> str:
    return f"""
select period, {money("cents")} as revenue, orders, {ratio("cents", "100 * priced", 2)} as avg_order_value,
  customers as active_customers from ({by_period(grain)})"""


def city_by(grain: str) -> str:
    return f"""
select cast(date_trunc('{grain}', day) as date) as period, count(distinct customer_id) as active_customers,
  count(*) as orders, {ratio("count(*)", "count(distinct customer_id)", 2)} as orders_per_customer
from fd_orders join fd_restaurants using (restaurant_id)
where is_delivered and city_key = 'africa' group by 1"""


def fit(rows: str) -> str:
    """Slope and correlation over rows of whole numbers x and y; y counts in hundredths."""
    return f"""
with pairs as ({rows}),
sums as (
  select count(*) as n, sum(x) as sx, sum(y) as sy, sum(x * x) as sxx, sum(x * y) as sxy, sum(y * y) as syy
  from pairs where x is not null and y is not null),
spreads as (select n, n * sxx - sx * sx as xx, n * sxy - sx * sy as xy, n * syy - sy * sy as yy from sums)
select n as pairs, {ratio("xy", "100 * xx", 4)} as slope,
  (xy / 100::double) / nullif(sqrt(cast(xx as double)) * sqrt(yy / 10000::double), 0) as correlation
from spreads"""


SLOWEST = """
with attempts as (
  select order_id, restaurant_id, restaurant_name, agent_id, city_key, minutes,
    rank() over (order by minutes desc nulls {nulls}) as place
  from fd_deliveries join fd_orders using (order_id) join fd_restaurants using (restaurant_id)
  where is_delivered and not is_failed),
slow as (select * from attempts where place <= 10)
select order_id, restaurant_id, restaurant_name, agent_id, city_key,
  cast(minutes as bigint) as delivery_time_minutes,
  count(*) over (partition by restaurant_id) as count_by_restaurant,
  count(*) over (partition by agent_id) as count_by_agent,
  count(*) over (partition by city_key) as count_by_city
from slow"""

EFFICIENCY = """
with joined as ({rows}),
scores as (
  select r.restaurant_id, sum(j.w) filter (where is_delivered) as good, sum(j.w) as total,
    sum(j.rating_sum) as rating_sum, sum(j.rated) as rated
  from joined j left join fd_restaurants r on r.restaurant_id = j.restaurant_id
  group by r.restaurant_id),
rated as (
  select restaurant_id, cast(coalesce(good, 0) as bigint) as delivered_count,
    cast(total as bigint) as total_count, {avg} as avg_rating
  from scores)
select *, {score} as efficiency_score from rated"""


def efficiency(per_order: bool) -> str:
    if per_order:
        rows = """select restaurant_id, is_delivered, 1 as w,
      (select sum(rating) from fd_deliveries d where d.order_id = o.order_id) as rating_sum,
      (select count(rating) from fd_deliveries d where d.order_id = o.order_id) as rated
      from fd_orders o"""
    else:
        rows = """select restaurant_id, is_delivered, 1 as w, rating as rating_sum,
      case when rating is null then 0 else 1 end as rated
      from fd_orders left join fd_deliveries using (order_id)"""
    return EFFICIENCY.format(
        rows=rows,
        avg=ratio("rating_sum", "rated", 2),
        score=ratio("delivered_count * cast(round(avg_rating * 100) as bigint)",
                    "100 * total_count", 2),
    )


def churn_profile(per_order: bool) -> str:
    months = "(select distinct customer_id from fd_orders where is_delivered and month = {m})"
    ratings = "left join fd_deliveries using (order_id)"
    who = f"""
with early as {months.format(m=JAN)}, late as {months.format(m=MAR)},
who as (select customer_id, case when customer_id in (select customer_id from late)
          then 'retained' else 'churned' end as customer_status from early)"""
    if not per_order:
        return f"""{who}
select customer_status, {avg_money()} as avg_order_value, {AVG_RATING} as avg_rating,
  {AVG_MINUTES} as avg_delivery_minutes
from who join fd_orders using (customer_id) {ratings}
where is_delivered group by customer_status"""
    return f"""{who},
by_order as (select customer_status, {avg_money()} as avg_order_value,
    {AVG_MINUTES} as avg_delivery_minutes
  from who join fd_orders using (customer_id) where is_delivered group by 1),
by_attempt as (select customer_status, {AVG_RATING} as avg_rating
  from who join fd_orders using (customer_id) {ratings} where is_delivered group by 1)
select customer_status, avg_order_value, avg_rating, avg_delivery_minutes
from by_order join by_attempt using (customer_status)"""


def leaderboard(monthly: bool) -> str:
    month = "o.month as order_month, " if monthly else ""
    shown = "order_month, " if monthly else ""
    over = "over (partition by order_month)" if monthly else "over ()"
    quality = ratio("cast(round(avg_rating * 100) as bigint)", "500", 3)
    volume = ratio("order_volume", f"max(order_volume) {over}", 3)
    score = ratio(
        "cast(round(quality_score * 1000) as bigint) * 50"
        " + cast(round(volume_score * 1000) as bigint) * 30"
        " + cast(round(consistency_score * 1000) as bigint) * 20",
        "100000",
        3,
    )
    return f"""
with metrics as (
  select {month}d.agent_id, count(distinct o.order_id) as order_volume, {AVG_RATING} as avg_rating,
    cast(count(rating) * sum(rating * rating) - sum(rating) * sum(rating) as double)
      / nullif(cast(count(rating) * count(rating) as double), 0) as spread
  from fd_deliveries d left join fd_orders o on o.order_id = d.order_id
  group by all),
scored as (
  select {shown}agent_id, order_volume, avg_rating,
    cast(round(cast(spread as decimal(20, 12)), 3) as double) as rating_variance,
    {quality} as quality_score, {volume} as volume_score,
    cast(round(cast(1 - spread / nullif(max(spread) {over}, 0) as decimal(20, 12)), 3) as double)
      as consistency_score
  from metrics)
select *, {score} as agent_score from scored"""


LAPSING = """
  select customer_id from fd_orders group by customer_id
  having sum(cents) > 200000000
    and (select max(day) from fd_orders) - max(day) > 45"""

REORDER = """
  select customer_id, min(day) as first_order_date,
    case when count(day) > 1 then list_sort(list(day) filter (where day is not null))[2] end as second_order_date,
    sum(cents) as cents
  from fd_orders where is_delivered group by customer_id"""

STATEMENTS = {
    "q01_total_revenue": f"select {money('sum(cents)')} as total_revenue from fd_orders",
    "q02_status_split": f"""
select count(*) filter (where is_delivered) as delivered_count,
  count(*) filter (where not is_delivered) as cancelled_count,
  {pct("count(*) filter (where is_delivered)", "count(*)")} as delivered_pct,
  {pct("count(*) filter (where not is_delivered)", "count(*)")} as cancelled_pct
from fd_orders""",
    "q03_top_spenders": f"""
select customer_id, customer_name, {money("cents")} as total_spend
from ({SPEND_BY_CUSTOMER.format(value="cents", where="where is_delivered")})
order by cents desc nulls first, customer_id limit 5""",
    "q03b_top_spenders_imputed": f"""
select customer_id, customer_name, {money("cents")} as total_spend
from ({SPEND_BY_CUSTOMER.format(value="coalesce(cents, 500000)", where="")})
order by cents desc nulls first, customer_id limit 5""",
    "q04_avg_delivery_time":
        f"select {AVG_MINUTES} as avg_delivery_minutes from fd_orders where is_delivered",
    "q05_top_city_revenue": f"""
select array_to_string([upper(x[1]) || x[2:] for x in
    regexp_extract_all(city_key, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+')], '') as city_name,
  {money("sum(cents)")} as total_revenue
from fd_orders join fd_restaurants using (restaurant_id) where is_delivered
group by city_key order by sum(cents) desc nulls first, 1 limit 1""",
    "q06_agent_avg_rating": f"""
select agent_id, agent_name, {ratio("sum(rating)", "count(rating)", 1)} as avg_rating
from fd_agents join fd_deliveries using (agent_id) where not is_failed group by all""",
    "q07_top_restaurant": best_by(
        """select restaurant_id, restaurant_name, sum(cents) as cents
        from fd_restaurants join fd_orders using (restaurant_id) where is_delivered group by all""",
        "cents", f"restaurant_id, restaurant_name, {money('cents')} as total_revenue", "= 1"),
    "q08_orders_per_restaurant": """
select r.restaurant_id, r.restaurant_name, count(o.order_id) as order_count
from fd_restaurants r left join fd_orders o on o.restaurant_id = r.restaurant_id group by all""",
    "q09_peak_signup_month": """
with months as (select date_trunc('month', signup) as m, count(*) as n from fd_customers group by m)
select strftime(m, '%B') as month_name, n as signup_count
from months where n = (select max(n) from months)""",
    "q10_failed_by_agent": """
select a.agent_id, a.agent_name, count(d.agent_id) as failed_deliveries
from fd_agents a left join fd_deliveries d on d.agent_id = a.agent_id and d.is_failed
group by all""",
    "q11_top_category_revenue": best_by(
        """select r.category, sum(o.cents) as cents
        from fd_orders o left join fd_restaurants r on r.restaurant_id = o.restaurant_id
        where o.is_delivered group by r.category""",
        "cents", f"category, {money('cents')} as total_revenue", "= 1"),
    "q12_busiest_agents": best_by(
        """select a.agent_id, a.agent_name, count(d.order_id) as delivery_count
        from fd_deliveries d left join fd_agents a on a.agent_id = d.agent_id group by all""",
        "delivery_count", "agent_id, agent_name, delivery_count", "<= 5", rank="dense_rank"),
    "q13_repeat_buckets": """
select case when n = 0 then '0' when n = 1 then '=1' else '>1' end as order_bucket,
  count(*) as customer_count
from (select c.customer_id, count(o.order_id) as n
  from fd_customers c left join fd_orders o on o.customer_id = c.customer_id group by 1)
group by 1""",
    "q14_monthly_revenue": f"""
select strftime(month, '%b') as month_name, {money("cents")} as monthly_revenue from ({MONTHLY})""",
    "q15_slowest_category": best_by(
        f"""select r.category, {AVG_MINUTES} as avg_delivery_minutes
        from fd_deliveries d join fd_orders o using (order_id)
        left join fd_restaurants r on r.restaurant_id = o.restaurant_id
        where not d.is_failed group by r.category""",
        "avg_delivery_minutes", "category, avg_delivery_minutes", "= 1"),
    "q16_best_agent_per_city": best_by(
        AGENT_CITY_RATING.format(city="city"), "avg_rating",
        "agent_id, agent_name, city, avg_rating", "= 1", by="city"),
    "q16_best_rated_agent_per_city": best_by(
        AGENT_CITY_RATING.format(city="city_key"), "avg_rating",
        "agent_id, agent_name, city, avg_rating", "= 1", by="city", order="desc nulls last"),
    "q17_cancel_rate": f"""
select *, round({ratio("cancelled_orders", "total_orders", 2)} * 100) as cancellation_rate_pct
from ({ORDER_COUNTS})""",
    "q17b_cancel_rate_min_orders": f"""
select *, cast(cancelled_orders * 100 // total_orders as bigint) as cancellation_rate_pct
from ({ORDER_COUNTS}) where total_orders >= 3""",
    "q18_top_city_aov": best_by(
        f"""select city_key, {avg_money()} as avg_order_value
        from fd_customers join fd_orders using (customer_id) where is_delivered group by 1""",
        "avg_order_value", "city_key, avg_order_value", "= 1"),
    "q19_rating_distribution": f"""
select coalesce(cast(rating as varchar), 'unrated') as rating_bucket, count(*) as delivery_count,
  {pct("count(*)", "(select count(*) from fd_deliveries)")} as delivery_pct,
  {pct("(select count(*) from fd_deliveries where rating <= 3)",
       "(select count(*) from fd_deliveries)")} as low_rating_pct
from fd_deliveries group by rating""",
    "q20_unrated_by_agent": f"""
select agent_id, agent_name, {AVG_RATING} as avg_rating,
  count(*) - count(rating) as unrated_deliveries,
  {pct("count(*) - count(rating)", "count(*)")} as unrated_pct
from fd_agents join fd_deliveries using (agent_id) where not is_failed
group by agent_id, agent_name having count(rating) < count(*)""",
    "q21_favourite_restaurant": best_by(
        """select *, sum(restaurant_orders) over (partition by customer_id) as all_orders
        from (select c.customer_id, c.customer_name, o.restaurant_id, r.restaurant_name,
            count(*) as restaurant_orders
          from fd_orders o join fd_customers c on c.customer_id = o.customer_id
          left join fd_restaurants r on r.restaurant_id = o.restaurant_id group by 1, 2, 3, 4)""",
        "restaurant_orders",
        "customer_id, customer_name, restaurant_id, restaurant_name, restaurant_orders",
        "= 1 and all_orders > 1", rank="dense_rank", by="customer_id"),
    "q22_weekday_weekend": f"""
select case when isodow(day) >= 6 then 'weekend' else 'weekday' end as day_type,
  count(*) as total_orders, {money("sum(cents)")} as total_revenue,
  {avg_money()} as avg_order_value
from fd_orders where is_delivered group by 1""",
    "q23_signup_cohorts": f"""
with facts as (select year(c.signup) as signup_year, o.order_id, o.cents from fd_customers c
  left join fd_orders o on o.customer_id = c.customer_id and o.is_delivered)
select signup_year, {money("sum(cents)")} as cohort_revenue, {avg_money()} as avg_order_value,
  count(order_id) as cohort_orders,
  {pct("count(order_id)", "(select count(order_id) from facts)")} as order_volume_pct,
  {pct("sum(cents)", "(select sum(cents) from facts)")} as revenue_pct
from facts group by signup_year""",
    "q24_slowest_orders": SLOWEST.format(nulls="first"),
    "q24_slowest_timed_orders": SLOWEST.format(nulls="last"),
    "q25_load_vs_rating": f"""
select agent_id, count(order_id) as delivery_count,
  {ratio("sum(rating) filter (where not is_failed)",
         "count(rating) filter (where not is_failed)", 2)} as avg_rating
from fd_agents join fd_deliveries using (agent_id) group by agent_id""",
    "q26_high_value_orders": f"""
with sold as (select restaurant_id, cents, cents > 40000000 as high from fd_orders where is_delivered)
select restaurant_id, count(*) as high_orders,
  (select count(*) from sold where high) as total_high_orders,
  {pct("(select sum(cents) from sold where high)", "(select sum(cents) from sold)")} as revenue_pct
from sold where high group by restaurant_id""",
    "q27_zero_cancel_restaurants": """
select restaurant_id, cast(0 as bigint) as cancelled_orders
from fd_orders group by restaurant_id having bool_and(is_delivered)""",
    "q28_city_favourite_category": best_by(
        """select home as city, category, count(*) as category_orders
        from fd_orders join fd_customers using (customer_id) join fd_restaurants using (restaurant_id)
        group by all""",
        "category_orders", "city, category, category_orders",
        "= 1 and city in ('africa', 'middle east')", by="city"),
    "q29_delivered_without_delivery": """
select order_id, 'delivered' as cleaned_status, cast(null as bigint) as delivery_id
from fd_orders where is_delivered and order_id not in (select order_id from fd_deliveries)""",
    "q30_agent_revenue_rank": best_by(
        """select agent_id, sum(cents) as cents
        from fd_orders join fd_deliveries using (order_id) where is_delivered group by agent_id""",
        "cents", f"agent_id, {money('cents')} as agent_revenue", ">= 1"),
    "q31_churned_customers": f"""
with gone as (select customer_id from fd_orders where is_delivered and month = {JAN}
  except select customer_id from fd_orders where is_delivered and month = {MAR})
select customer_id, customer_name, 'churned_customer' as retention_status,
  count(*) over () as churned_customers
from gone join fd_customers using (customer_id)""",
    "q32_top3_share": best_by(
        f"select *, sum(cents) over () as everything from ({RESTAURANT_REVENUE})", "cents",
        f"restaurant_id, restaurant_name, {money('cents')} as restaurant_revenue, "
        f"{pct('cents', 'everything')} as revenue_pct", "<= 3", rank="dense_rank"),
    "q32_top3_selling_share": best_by(
        f"select *, sum(cents) over () as everything from ({RESTAURANT_REVENUE})", "cents",
        f"restaurant_id, restaurant_name, {money('cents')} as restaurant_revenue, "
        f"{pct('cents', 'everything')} as revenue_pct", "<= 3", rank="dense_rank",
        order="desc nulls last"),
    "q33_uncleaned_city_error": f"""
select {money("sum(cents)")} as cleaned_revenue,
  {money("sum(cents) filter (where city = 'AFRICA')")} as naive_revenue,
  {money("sum(cents) - sum(cents) filter (where city = 'AFRICA')")} as undercount
from fd_orders join fd_customers using (customer_id) where city_key = 'africa'""",
    "q34_clv_top10": best_by(
        """select customer_id, sum(cents) as cents, count(*) as order_count
        from fd_orders where is_delivered group by customer_id""",
        "cents", f"customer_id, {money('cents')} / order_count as avg_order_value, order_count, "
        f"{money('cents')} as clv", "<= 10", rank="dense_rank"),
    "q35_most_consistent_agent": best_by(
        f"""select agent_id, count(*) as delivery_count, {ratio(
            "count(rating) * sum(rating * rating) - sum(rating) * sum(rating)",
            "count(rating) * (count(rating) - 1)", 2)} as rating_variance
        from fd_deliveries where not is_failed group by agent_id""",
        "rating_variance", "agent_id, delivery_count, rating_variance", "= 1",
        rank="dense_rank", order="asc nulls last"),
    "q36_cancelled_with_delivery": """
select delivery_status, order_id, status
from fd_orders join fd_deliveries using (order_id) where not is_delivered""",
    "q37_revenue_spikes": f"""
with sold as (select day, restaurant_id, count(*) as order_volume, sum(cents) as cents
  from fd_orders where is_delivered group by all),
days as (select day, sum(cents) as cents, lag(sum(cents)) over (order by day) as before
  from sold group by day)
select d.day as spike_date, {money("d.before")} as previous_revenue,
  {money("d.cents")} as current_revenue, {money("d.cents - d.before")} as absolute_change,
  {pct("d.cents - d.before", "d.before")} as change_pct, s.day as detail_date, s.restaurant_id,
  s.order_volume, {money("s.cents")} as detail_revenue
from days d join sold s on s.day = d.day or s.day = d.day - 1""",
    "q37_spike_drivers": f"""
with days as (select day as spike_date, count(*) as current_volume, sum(cents) as c from fd_orders
  where is_delivered and day is not null group by day),
beside as (select *, lag(current_volume) over (order by spike_date) as previous_volume,
  lag(c) over (order by spike_date) as b from days)
select spike_date, current_volume, {money("c")} as current_revenue, previous_volume,
  {money("b")} as previous_revenue, current_volume - previous_volume as volume_change,
  {pct("current_volume - previous_volume", "previous_volume")} as volume_change_pct,
  {money("c - b")} as revenue_change, {pct("c - b", "b")} as revenue_change_pct
from beside""",
    "q38_reorder_gap": f"""
select customer_id, first_order_date, second_order_date, {money("cents")} as total_spend,
  second_order_date - first_order_date as days_to_reorder
from ({REORDER})""",
    "q39_cross_city_orders": """
select customer_id, order_id, c.home as customer_city, r.city_key as restaurant_city
from fd_orders join fd_customers c using (customer_id) join fd_restaurants r using (restaurant_id)
where c.home <> r.city_key""",
    "q40_rating_by_speed_bucket": f"""
select case when minutes >= 60 then 'very_slow_delivery' when minutes >= 45 then 'slow_delivery'
    when minutes >= 30 then 'medium_delivery' when minutes >= 0 then 'fast_delivery'
    else 'unknown' end as speed_bucket,
  {AVG_RATING} as avg_rating
from fd_orders left join fd_deliveries using (order_id) where is_delivered group by 1""",
    "q41_join_inflation": f"""
with naive as (select sum(cents) as c from fd_orders left join fd_deliveries using (order_id)
    left join fd_agents using (agent_id)),
grain as (select sum(cents) as c from fd_orders)
select {money("naive.c")} as naive_revenue, {money("grain.c")} as order_grain_revenue,
  {money("naive.c - grain.c")} as inflation from naive, grain""",
    "q42_restaurant_efficiency": efficiency(False),
    "q42_restaurant_efficiency_per_order": efficiency(True),
    "q43_lapsing_high_value": LAPSING,
    "q44_frequency_segments": f"""
with spend as (select count(*) as n, sum(cents) as cents from fd_orders where is_delivered
  group by customer_id),
segments as (select case when n = 1 then 'One_time_customer' when n < 4 then 'Occasional_customer'
    else 'Regular_customer' end as customer_type, sum(cents) as cents from spend group by 1)
select customer_type, {money("cents")} as segment_revenue,
  {pct("cents", "(select sum(cents) from spend)")} as revenue_share_pct
from segments""",
    "q45_missing_revenue_exposure": f"""
select restaurant_id, {money("sum(cents)")} / nullif(count(cents), 0) as avg_order_amount,
  count(*) - count(cents) as missing_orders,
  {money("sum(cents)")} / nullif(count(cents), 0) * (count(*) - count(cents))
    as potential_missing_revenue
from fd_orders group by restaurant_id having count(cents) < count(*)""",
    "q46_cross_city_agents": """
select order_id, agent_id, a.city_key as agent_city, r.city_key as restaurant_city
from fd_orders join fd_deliveries using (order_id) join fd_agents a using (agent_id)
join fd_restaurants r using (restaurant_id) where a.city_key <> r.city_key""",
    "q47_mom_growth_labelled": f"""
with months as (select month, {money("cents")} as revenue,
    lag({money("cents")}) over (order by month) as before,
    {money("cents - lag(cents) over (order by month)")} as change from ({MONTHLY}))
select case month when {FEB} then 'jan-feb' when {MAR} then 'feb-march' end as cohort,
  100.0::double * change / nullif(before, 0) as revenue_growth
from months""",
    "q48_cancel_leads_churn": f"""
with quarter as (select * from fd_orders where day between {JAN} and date '1995-03-31'),
lost as (select customer_id, bool_or(not is_delivered) as cancelled from quarter
  group by customer_id having max(month) = {JAN})
select count(*) as one_month_customers, count(*) filter (where cancelled) as with_cancellation,
  {pct("count(*) filter (where cancelled)", "count(*)")} as cancellation_pct
from lost""",
    "q49_agent_leaderboard": leaderboard(False),
    "q50_city_restaurant_pivot": f"""
select restaurant_id, restaurant_name, {AVG_RATING} as avg_rating,
  {AVG_MINUTES} as avg_delivery_minutes,
  count(distinct order_id) filter (where month = {JAN}) as first_month_orders,
  count(distinct order_id) filter (where month = {FEB}) as second_month_orders,
  count(distinct order_id) filter (where month = {MAR}) as third_month_orders
from fd_restaurants join fd_orders using (restaurant_id) left join fd_deliveries using (order_id)
where city_key = 'africa' and is_delivered group by restaurant_id, restaurant_name""",
    "b1_monthly_kpis": f"""
select month, {money("cents")} as revenue, orders, {ratio("cents", "100 * priced", 2)}
  as avg_order_value, customers as active_customers from ({MONTHLY})""",
    "b2_mom_growth": f"""
select month, {money("cents")} as revenue,
  {pct("cents - lag(cents) over (order by month)", "lag(cents) over (order by month)")}
    as growth_rate_pct from ({MONTHLY})""",
    "b3_volume_and_aov": f"""
select month, orders, {ratio("cents", "100 * priced", 2)} as avg_order_value from ({MONTHLY})""",
    "b4_orders_region_month": REGION_MONTH.format(fact="count(order_id) as orders"),
    "b5_revenue_region_month": REGION_MONTH.format(fact=f"{money('sum(cents)')} as revenue"),
    "b6_city_frequency": f"""
select month, count(distinct customer_id) as active_customers, count(*) as orders,
  {ratio("count(*)", "count(distinct customer_id)", 2)} as orders_per_customer
from fd_orders join fd_restaurants using (restaurant_id)
where is_delivered and city_key = 'africa' group by month""",
    "b9_weekly_kpis": period_kpis("week"),
    "b10_quarterly_kpis": period_kpis("quarter"),
    "b11_daily_growth": f"""
with days as ({by_period("day")}),
calendar as (
  select cast(unnest(generate_series(min(period), max(period), interval 1 day)) as date) as period from days),
filled as (
  select period, case when d.orders is null then 0 else d.cents end as cents, coalesce(d.orders, 0) as orders
  from calendar left join days d using (period)
  union all select period, cents, orders from days where period is null)
select period, {money("cents")} as revenue, orders,
  {pct("cents - lag(cents) over w", "lag(cents) over w")} as growth_rate_pct
from filled window w as (order by period nulls last)""",
    "b12_orders_region_quarter": f"""
with found as (
  select city_key as region, cast(date_trunc('quarter', day) as date) as period, count(order_id) as orders,
    sum(cents) as cents
  from fd_orders join fd_restaurants using (restaurant_id) where is_delivered group by all),
calendar as (
  select cast(unnest(generate_series(min(period), max(period), interval 3 month)) as date) as period from found),
spine as (select * from (select distinct region from found), calendar
  union all select region, period from found where period is null)
select s.region, s.period, coalesce(f.orders, 0) as orders,
  {money("case when f.orders is null then 0 else f.cents end")} as revenue
from spine s left join found f on s.region = f.region and s.period is not distinct from f.period""",
    "m1_monthly_kpis": period_kpis("month"),
    "m2_quarterly_kpis": period_kpis("quarter"),
    "m3_region_quarter_kpis": f"""
select period, city_key, {money("cents")} as revenue, orders, {ratio("cents", "100 * priced", 2)} as avg_order_value,
  customers as active_customers
from (
  select cast(date_trunc('quarter', day) as date) as period, city_key, sum(cents) as cents, count(order_id) as orders,
    count(cents) as priced, count(distinct customer_id) as customers
  from fd_orders left join fd_restaurants using (restaurant_id) where is_delivered group by all)""",
    "m4_city_frequency": city_by("month"),
    "m5_city_frequency_by_quarter": city_by("quarter"),
    "b7_city_restaurant_month": """
select restaurant_id, restaurant_name, month, count(order_id) as orders
from fd_orders join fd_restaurants using (restaurant_id)
where is_delivered and city_key = 'africa' group by all""",
    "b8_churn_vs_service": churn_profile(False),
    "b8_churn_vs_service_per_order": churn_profile(True),
    "d1_driver_decomposition": f"""
with kpis as (select month, cents, orders, {ratio("cents", "priced", 0)} as aov_cents
  from ({MONTHLY}))
select month, {money("cents")} as revenue, orders, {money("aov_cents")} as avg_order_value,
  {money("cents - lag(cents) over w")} as revenue_change,
  orders - lag(orders) over w as orders_change,
  {money("aov_cents - lag(aov_cents) over w")} as avg_order_value_change
from kpis window w as (order by month)""",
    "d2_decline_concentration": f"""
with facts as (select city_key as region, cents, case month when {JAN} then 1 else -1 end as side
  from fd_orders join fd_restaurants using (restaurant_id)
  where is_delivered and month in ({JAN}, {FEB})),
losses as (select region, sum(side) as n, coalesce(sum(side * cents), 0) as c
  from facts group by region)
select region, cast(n as bigint) as order_loss, {pct("n", "sum(n) over ()")} as order_loss_pct,
  {money("c")} as revenue_loss, {pct("c", "sum(c) over ()")} as revenue_loss_pct
from losses""",
    "d3_full_signups_by_month": """
select cast(date_trunc('month', signup) as date) as signup_month, count(*) as signup_count
from fd_customers group by 1""",
    "d4_avg_reorder_gap": f"""
select count(gap) as avg_days_to_reorder_count, {ratio("sum(gap)", "count(gap)", 2)}
  as avg_days_to_reorder
from (select second_order_date - first_order_date as gap from ({REORDER}))""",
    "d5_lapsing_by_city": f"""
select home as city, count(*) as lapsing_customers
from ({LAPSING}) left join fd_customers using (customer_id) group by home""",
    "d6_growth_clean_vs_naive": f"""
with sums as (select month as order_month, sum(cents) as n,
  sum(cents) filter (where is_delivered) as c from fd_orders group by month)
select order_month, {money("n")} as naive_revenue, {money("c")} as clean_revenue,
  {pct("n - lag(n) over w", "lag(n) over w")} as naive_growth_pct,
  {pct("c - lag(c) over w", "lag(c) over w")} as clean_growth_pct
from sums window w as (order by order_month)""",
    "d7_monthly_leaderboard": leaderboard(True),
    "d8_top3_offline_impact": f"""
with ranked as (select *, dense_rank() over (order by cents desc nulls last) as place
  from ({RESTAURANT_REVENUE})),
sums as (select count(*) filter (where place <= 3) as k, sum(cents) as c,
  sum(cents) filter (where place <= 3) as top from ranked)
select k as top_restaurants, {money("c")} as total_revenue, {money("top")} as top_revenue,
  {money("c - top")} as remaining_revenue, {pct("top", "c")} as lost_pct from sums""",
    "d9_reorder_speed_vs_spend": f"""
select case when gap < 31 then 'soon' when gap < 91 then 'later' when gap >= 91 then 'late'
    else 'never' end as reorder_speed,
  count(*) as customers, {money("sum(cents)")} as total_spend,
  {ratio("sum(cents)", "count(cents) * 100", 2)} as avg_spend
from (select second_order_date - first_order_date as gap, cents from ({REORDER})) group by 1""",
    "d10_clv_among_top_spenders": f"""
with spend as (select customer_id, sum(cents) as cents from fd_orders where is_delivered group by 1),
clv as (select customer_id from spend
  qualify dense_rank() over (order by cents desc nulls first) <= 10),
top as (select customer_id from spend where customer_id in (select customer_id from fd_customers)
  order by cents desc nulls first, customer_id limit 5)
select (select count(*) from clv) as clv_customers, (select count(*) from top) as top_spenders,
  (select count(*) from clv join top using (customer_id)) as in_both""",
    "d11_least_consistent_agent": best_by(
        f"""select agent_id, count(*) as delivery_count, {ratio(
            "count(rating) * sum(rating * rating) - sum(rating) * sum(rating)",
            "count(rating) * (count(rating) - 1)", 2)} as rating_variance
        from fd_deliveries where not is_failed group by agent_id""",
        "rating_variance", "agent_id, delivery_count, rating_variance", "= 1",
        rank="dense_rank", order="desc nulls last"),
    "d12_flagged_customers": f"""
select *, cast(cancelled_orders * 100 // total_orders as bigint) as cancellation_rate_pct
from ({ORDER_COUNTS}) where total_orders >= 3 and cancelled_orders * 100 > total_orders * 50""",
    "d13_load_vs_rating_fit": fit(f"""
  select count(order_id) as x, cast(round(100 * {ratio("sum(rating) filter (where not is_failed)",
    "count(rating) filter (where not is_failed)", 2)}) as hugeint) as y
  from fd_agents join fd_deliveries using (agent_id) group by agent_id"""),
    "d14_speed_vs_rating_fit": fit(f"""
  select any_value(minutes) as x, cast(round(100 * {AVG_RATING}) as hugeint) as y
  from fd_orders join fd_deliveries using (order_id) where is_delivered group by order_id"""),
    "d15_weekday_weekend_per_day": f"""
select case when isodow(day) >= 6 then 'weekend' else 'weekday' end as day_type,
  count(distinct day) as active_days, {ratio("count(*)", "count(distinct day)", 2)} as orders_per_day,
  {ratio("sum(cents)", "100 * count(distinct day)", 2)} as revenue_per_day, {avg_money()} as avg_order_value
from fd_orders where is_delivered and day is not null group by 1""",
    "d16_missing_revenue_policies": f"""
with places as (
  select sum(cents) as cents, count(*) as n, count(cents) as priced,
    cast(round(100 * {ratio("sum(cents)", "100 * count(cents)", 2)}) as hugeint) as average
  from fd_orders group by restaurant_id),
totals as (
  select sum(cents) as cents, sum(n - priced) as missing, sum(n) as n, sum(priced) as priced,
    coalesce(sum(n - priced) filter (where priced = 0), 0) as without, sum(average * (n - priced)) as added
  from places)
select {money("cents")} as known_revenue, cast(missing as bigint) as missing_orders,
  {pct("missing", "n")} as missing_pct, cast(without as bigint) as orders_without_average,
  {money("cents + added")} as revenue_at_restaurant_average,
  {money(f"cents + missing * cast(round(100 * {ratio('cents', '100 * priced', 2)}) as hugeint)")}
    as revenue_at_overall_average
from totals""",
    "d17_city_decline_by_restaurant": f"""
with losses as (
  select restaurant_id, restaurant_name, sum(case month when {JAN} then 1 else -1 end) as n,
    coalesce(sum(case month when {JAN} then cents else -cents end), 0) as c
  from fd_orders join fd_restaurants using (restaurant_id)
  where is_delivered and city_key = 'africa' and month in ({JAN}, {FEB}) group by all)
select restaurant_id, restaurant_name, cast(n as bigint) as order_loss, {pct("n", "sum(n) over ()")} as order_loss_pct,
  {money("c")} as revenue_loss, {pct("c", "sum(c) over ()")} as revenue_loss_pct
from losses""",
}
