"""The seven source tables derived from the generic test tables.

The texts follow FIXTURES.md section 3 and run unchanged in Spark SQL and in DuckDB. Every raw
row has a role: an order is a funding round (but for the customers
that have none), and an acquisition, an offering or an office by its key;
a line is a relationship, a supplier holds a degree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dealscope.sources.tables import SourceTables

# The columns of the raw tables that the derivations use. Declared, so that
# opening the files starts no job.
RAW_TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey bigint",
    "part": "p_partkey bigint",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_suppkey bigint, l_linenumber int",
}

# The derivations, with the raw tables as named placeholders.
DERIVATIONS = {
    "objects": """
select c_custkey as id, case when c_custkey % 10 = 0 then 'FinancialOrg' else 'Company' end as entity_type,
 cast(null as bigint) as parent_id,
 case when c_custkey % 13 = 0 then null else c_mktsegment end as category_code,
 case when c_custkey % 17 = 0 then null else cast('1994-01-01' as date) + cast((c_custkey * 37) % 2500 as int) end as founded_at,
 case when c_custkey % 11 = 0 then cast('1996-01-01' as date) + cast((c_custkey * 53) % 2000 as int) end as closed_at,
 case when c_nationkey < 8 then 'USA' when c_nationkey < 12 then 'NZL' when c_nationkey < 23 then 'GBR' end as country_code,
 case when c_custkey % 3 = 0 then 'CA' when c_custkey % 3 = 1 then 'NY' end as state_code,
 n_name as city, r_name as region
from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey
union all
select 1000000000 + p_partkey, 'Product', case when p_partkey % 5 = 0 then null else cast(floor(p_partkey / 3) as bigint) end,
 cast(null as varchar(10)), cast(null as date), cast(null as date), cast(null as varchar(10)), cast(null as varchar(10)),
 cast(null as varchar(10)), cast(null as varchar(10)) from {part}""",
    "funding_rounds": """
select o_orderkey as round_id, o_custkey as object_id,
 case when o_orderstatus = 'P' or o_custkey % 13 = 6 then null else o_totalprice end as raised_amount_usd,
 case when o_custkey % 11 = 4 then 0 else cast(substr(o_orderpriority, 1, 1) as int) - 1 end as participants
from {orders} where o_custkey % 12 <> 5""",
    "acquisitions": """
select o_custkey as acquired_object_id, cast(floor(o_orderkey / 40) as bigint) as acquiring_object_id,
 case when o_orderkey % 40 = 1 then null else cast(o_orderdate as date) end as acquired_at
from {orders} where o_orderkey % 8 = 1""",
    "ipos": """
select o_custkey as object_id, cast(o_orderdate as date) as public_at from {orders} where o_orderkey % 8 = 3""",
    "offices": """
select o_orderkey as office_id, o_custkey as object_id from {orders} where o_orderkey % 8 not in (1, 3)""",
    "relationships": """
select l_suppkey as person_object_id,
 case when l_orderkey % 97 = 0 then null else cast(floor(l_orderkey / 10) as bigint) end as relationship_object_id
from {lineitem}""",
    "degrees": """
select s_suppkey as object_id,
 case s_suppkey % 7 when 0 then 'MBA' when 1 then 'PhD' when 2 then 'ms' when 3 then 'BS' when 4 then 'mba' end as degree_type
from {supplier}
union all
select s_suppkey, 'MS' from {supplier} where s_suppkey % 2 = 0""",
}


def sample_tables(spark: SparkSession, folder: str) -> SourceTables:
    """Derive the source tables from the parquet files in ``folder``."""
    raw = {name: spark.read.schema(schema).parquet(f"{folder.rstrip('/')}/{name}.parquet")
           for name, schema in RAW_TABLES.items()}

    def derive(name: str) -> DataFrame:
        used = {table: df for table, df in raw.items() if f"{{{table}}}" in DERIVATIONS[name]}
        return spark.sql(DERIVATIONS[name], **used)

    return SourceTables.load(derive)


def sample_ctes() -> str:
    """The same derivations as a WITH prefix for an engine that knows the raw tables by name."""
    names = {name: name for name in RAW_TABLES}
    return "with " + ",\n".join(
        f"cb_{name} as ({text.format(**names)})" for name, text in DERIVATIONS.items())
