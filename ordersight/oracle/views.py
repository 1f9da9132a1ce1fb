"""The logical tables as common table expressions over the base tables."""

import re

VIEWS = {
    "fd_orders": """
  select o_orderkey as order_id,
    case when o_orderkey % 89 = 3 then -1 - o_orderkey % 2
         when o_custkey % 17 = 5 and o_orderpriority <> '1-URGENT'
         then o_custkey - 5 else o_custkey end as customer_id,
    case when o_orderkey % 97 = 13 then -1 - o_orderkey % 3
         when o_orderpriority in ('1-URGENT', '2-HIGH') then o_custkey
         else o_orderkey // 8 end as restaurant_id,
    case when o_orderkey % 300 <> 33 then cast(o_orderdate as date) end as day,
    case when o_orderkey % 300 <> 33 then cast(date_trunc('month', o_orderdate) as date) end as month,
    case when o_orderkey % 40 <> 7
         then cast(cast(o_totalprice as decimal(12, 2)) * 100 as bigint) end as cents,
    case when o_orderstatus = 'P' and o_orderkey % 10 <> 3 then 'CANCELLED'
         when o_orderstatus = 'F' then 'Delivered'
         when o_orderstatus = 'O' then ' delivered' else 'delivered ' end as status,
    o_orderstatus <> 'P' or o_orderkey % 10 = 3 as is_delivered,
    case when (o_orderstatus <> 'P' or o_orderkey % 10 = 3) and o_orderkey % 1000 <> 501
         then 10 + o_orderkey * 7 % 80 end as minutes
  from orders""",
    "fd_customers": """
  select c_custkey as customer_id, c_name as customer_name,
    case when c_custkey % 50 = 49 then null
         when n_regionkey = 4 and c_custkey % 2 = 0 then 'Mideast'
         when c_custkey % 3 = 0 then lower(r_name)
         when c_custkey % 3 = 1 then ' ' || r_name || ' '
         else r_name end as city,
    case when c_custkey % 50 = 49 then null
         when n_regionkey = 4 and c_custkey % 2 = 0 then 'mideast'
         else lower(r_name) end as city_key,
    case when c_custkey % 50 = 49 then null else lower(r_name) end as home,
    case when c_custkey % 2 = 0
         then make_date(2021 + c_custkey % 3, 1 + c_custkey % 9, 10 + c_custkey % 10)
         else make_date(2021 + c_custkey % 3, 1 + c_custkey % 3, 10 + c_custkey % 10)
         end as signup
  from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey""",
    "fd_restaurants": """
  select p_partkey as restaurant_id, p_name || ' #' || p_partkey as restaurant_name,
    p_type as category, lower(r_name) as city_key
  from part join region on r_regionkey = p_partkey % 5""",
    "fd_deliveries": """
  select l_orderkey * 10 + l_linenumber as delivery_id,
    case when l_orderkey % 71 = 5 and l_linenumber = 2 then -l_orderkey else l_orderkey end as order_id,
    case when l_suppkey % 10 = 7 then -1 else l_suppkey end as agent_id,
    case when l_returnflag = 'R' then 'Failed '
         when l_linestatus = 'O' then 'DELIVERED' else 'delivered' end as delivery_status,
    l_returnflag = 'R' as is_failed,
    case when l_partkey % 11 <> 0 and l_suppkey % 10 <> 9
         then 1 + cast(l_quantity as bigint) % 5 end as rating
  from lineitem""",
    "fd_agents": """
  select s_suppkey as agent_id, s_name as agent_name,
    case when s_suppkey % 2 = 0 then r_name else lower(r_name) end as city,
    lower(r_name) as city_key
  from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey""",
}


def with_views(body: str) -> str:
    """Put the views a statement names in front of it."""
    used = [name for name in VIEWS if re.search(rf"\b{name}\b", body)]
    heads = ",\n".join(f"{name} as ({VIEWS[name]})" for name in used)
    body = body.strip()
    if body.startswith("with "):
        return f"with {heads},\n{body[5:]}"
    return f"with {heads}\n{body}"
