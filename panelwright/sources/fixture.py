"""The test panel: dense instrument x session bars from lineitem, one SQL text for Spark and DuckDB."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BARS_SQL = """
with li as (
  select cast(l_suppkey % 20 as int) as inst, cast(date_trunc('week', l_shipdate) as date) as session,
         l_extendedprice / l_quantity as px, l_quantity as qty, l_extendedprice as amt,
         {row}(l_shipdate, l_orderkey, l_partkey, l_linenumber, l_extendedprice / l_quantity, l_quantity) as place
  from {lineitem} where l_quantity > 0),
b as (select inst, session, min_by(px, place) open, max(px) high, min(px) low, max_by(px, place) close, sum(qty) volume, sum(amt) amount
      from li group by inst, session),
cal as (select session, row_number() over (order by session) seq from (select distinct session from b)),
ins as (select distinct inst from b),
g as (select i.inst, c.session, c.seq from ins i cross join cal c)
select g.inst, g.session, cast(g.seq as int) seq, cast(b.open as double) open, cast(b.high as double) high, cast(b.low as double) low, cast(b.close as double) close, cast(b.volume as double) volume, cast(b.amount as double) amount
from g left join b on g.inst = b.inst and g.session = b.session"""


# One aggregate with partial sums on the map side gives the bars; the session numbers come from a window over the distinct
# sessions, a few hundred rows whatever the data.


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BARS_SQL.replace("{row}", "struct"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def oracle(body: str) -> str:
    """DuckDB SQL for `body` over the same bars."""
    return f"with bars as ({BARS_SQL.format(lineitem='lineitem', row='row')})\n{body}"
