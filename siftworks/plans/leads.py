"""A table of messy leads, derived from the star schema by one SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LEADS = """
select c_custkey as row_number,
 case when c_custkey % 11 = 0 then '  ' || upper(c_name) || '  ' else c_name end as name,
 case c_custkey % 9 when 0 then '' when 1 then 'N/A' when 2 then 'USER' || cast(c_custkey as string) || '@Example.COM'
   when 3 then 'u' || cast(c_custkey as string) || '@a.io, v' || cast(c_custkey as string) || '@b.io'
   when 4 then 'user' || cast(c_custkey as string) || '@nodot'
   else 'user' || cast(c_custkey as string) || '@example.com' end as email,
 case c_custkey % 6 when 0 then '' when 1 then '98' || lpad(cast(c_custkey as string),8,'0')
   when 2 then '983-331-' || lpad(cast(c_custkey % 10000 as string),4,'0')
   when 3 then '12345' else '+91 98' || lpad(cast(c_custkey as string),8,'0') end as phone,
 n_name as country,
 case c_custkey % 5 when 0 then 'SALE_DONE' when 1 then 'Sale Done' when 2 then 'DNC' when 3 then 'good lead follow up' else null end as status,
 case c_custkey % 7 when 0 then '2026-01-15' when 1 then '15/01/2026' when 2 then '01/15/2026' when 3 then '05/06/2026'
   when 4 then '15-Jan-2026' when 5 then 'not a date' else '2026-02-30' end as created,
 cast(cast(c_acctbal as decimal(12,2)) as string) as budget_num,
 case c_custkey % 13 when 0 then '$12,345,678.90' when 1 then '0.0001%' when 2 then '1000000000000000000000' when 3 then '$0.00000012' when 4 then '-$5,000.50'
   when 5 then '12345678901234567890.5' else '$' || cast(cast(c_acctbal as decimal(12,2)) as string) end as budget,
 case c_custkey % 8 when 0 then 'Yes' when 1 then 'n' when 2 then 'TRUE' when 3 then 'f' when 4 then '' else 'maybe' end as interested,
 case when c_custkey % 4 = 0 then '“Call ’ later”   please' else 'note  ' || cast(c_custkey as string) end as remarks
from customer join nation on c_nationkey = n_nationkey
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that one task works on.
TASK_ROWS = 25_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to tasks of some ``TASK_ROWS`` rows, to twice as many tasks as there are cores at least, or to all shuffle partitions.

    A file of few bytes is read by one task, which would then do all the work
    on its rows; rows are cheap to move before that work, not after. The
    number of tasks grows with the rows, so time and memory of one don't.
    """
    spark = df.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(max(least, -(-df.count() // TASK_ROWS)), *keys)


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    # subqueries for the tables' names, so that no view of the session is replaced
    text = LEADS
    for name in ("customer", "nation"):
        text = text.replace(f"from {name} ", f"from {{{name}}} {name} ").replace(f"join {name} ", f"join {{{name}}} {name} ")
    return spark.sql(text, customer=spread(table(spark, sf_dir, "customer"), "c_custkey"), nation=table(spark, sf_dir, "nation"))
