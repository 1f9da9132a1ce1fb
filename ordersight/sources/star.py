"""The five logical tables derived from a star schema of orders, lineitems, parts and suppliers.

Every row of every base table is used; the expressions only re-shape columns so that the
dirt the plans must handle occurs: mixed spellings, padded text, two date formats, NULL
amounts and ratings, orders of unknown restaurants and customers, unreadable dates, customers and restaurants without
orders, agents without deliveries, deliveries of unknown agents and orders, and several deliveries per order. FIXTURES.md lists what each rule is there for.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ordersight.sources.tables import Tables

BASE = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "part": "p_partkey bigint, p_name string, p_type string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_returnflag string, l_linestatus string",
}

SHAPES = {
    "orders": [
        "o_orderkey as order_id",
        """case when o_orderkey % 89 = 3 then -1 - o_orderkey % 2
                when o_custkey % 17 = 5 and o_orderpriority != '1-URGENT' then o_custkey - 5
                else o_custkey end as customer_id""",
        """case when o_orderkey % 97 = 13 then -1 - o_orderkey % 3
                when o_orderpriority in ('1-URGENT', '2-HIGH') then o_custkey
                else o_orderkey div 8 end as restaurant_id""",
        """if(o_orderkey % 300 = 33, 'not known', cast(cast(o_orderdate as date) as string))
                as order_date""",
        """if(o_orderkey % 40 = 7, null, cast(o_totalprice as decimal(12,2)))
                as order_amount""",
        """case o_orderstatus when 'F' then 'Delivered' when 'O' then ' delivered'
                else if(o_orderkey % 10 = 3, 'delivered ', 'CANCELLED') end as status""",
        """case when o_orderstatus = 'P' and o_orderkey % 10 != 3 then null
                when o_orderkey % 1000 = 501 then null
                else cast(10 + o_orderkey * 7 % 80 as int) end as delivery_time_minutes""",
    ],
    "customers": [
        "c_custkey as customer_id",
        "c_name as customer_name",
        """case when c_custkey % 50 = 49 then null
                when n_regionkey = 4 and c_custkey % 2 = 0 then 'Mideast'
                when c_custkey % 3 = 0 then lower(r_name)
                when c_custkey % 3 = 1 then concat(' ', r_name, ' ') else r_name end as city""",
        """if(c_custkey % 2 = 0,
                concat(2021 + c_custkey % 3, '-0', 1 + c_custkey % 9, '-1', c_custkey % 10),
                concat('1', c_custkey % 10, '-', elt(1 + cast(c_custkey % 3 as int),
                  'Jan', 'Feb', 'Mar'), '-', 2021 + c_custkey % 3)) as signup_date""",
    ],
    "restaurants": [
        "p_partkey as restaurant_id",
        "concat(p_name, ' #', p_partkey) as restaurant_name",
        "p_type as category",
        "if(p_partkey % 2 = 0, r_name, concat(lower(r_name), ' ')) as city",
    ],
    "deliveries": [
        "l_orderkey * 10 + l_linenumber as delivery_id",
        "if(l_orderkey % 71 = 5 and l_linenumber = 2, -l_orderkey, l_orderkey) as order_id",
        "if(l_suppkey % 10 = 7, -1, l_suppkey) as agent_id",
        """case when l_returnflag = 'R' then 'Failed ' when l_linestatus = 'O' then 'DELIVERED'
                else 'delivered' end as delivery_status""",
        """if(l_partkey % 11 = 0 or l_suppkey % 10 = 9, null,
                1 + cast(l_quantity as int) % 5) as delivery_rating""",
    ],
    "delivery_agents": [
        "s_suppkey as agent_id",
        "s_name as agent_name",
        "if(s_suppkey % 2 = 0, r_name, lower(r_name)) as city",
    ],
}


def star_tables(spark: SparkSession, directory: str) -> Tables:
    """Tables over ``directory/<base table>.parquet``; only declared columns are read."""

    def base(name: str) -> DataFrame:
        schema = T.StructType.fromDDL(BASE[name])
        return spark.read.schema(schema).parquet(f"{directory}/{name}.parquet")

    def in_region(df: DataFrame, nation_key: str) -> DataFrame:
        nations = base("nation").withColumnRenamed("n_nationkey", nation_key)
        regions = base("region").withColumnRenamed("r_regionkey", "n_regionkey")
        return df.join(nations, nation_key).join(regions, "n_regionkey")

    def parts_in_region() -> DataFrame:
        parts = base("part").selectExpr("*", "cast(p_partkey % 5 as int) as r_regionkey")
        return parts.join(base("region"), "r_regionkey")

    rows: dict[str, Callable[[], DataFrame]] = {
        "orders": lambda: base("orders"),
        "customers": lambda: in_region(base("customer"), "c_nationkey"),
        "restaurants": parts_in_region,
        "deliveries": lambda: base("lineitem"),
        "delivery_agents": lambda: in_region(base("supplier"), "s_nationkey"),
    }
    return Tables(lambda name: rows[name]().selectExpr(*SHAPES[name]))
