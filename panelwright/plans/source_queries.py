"""Queries of sources, sinks, normalisation and predicates, with their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reference as N
from ..sources import ingest as I
from ..sources import tables as T
from ..sources.fixture import bars
from .base import QUERIES, panel, r
from .research_queries import _FACTS, facts, table


def orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").cast("double").alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


_O = "with o as (select cast(o_orderkey as bigint) k, cast(o_orderdate as date) as day, cast(o_totalprice as double) price, o_orderstatus status, o_orderpriority priority from orders)"


@table("a1_scan_panel", _O + " select cast(year(day) as bigint) y, cast(month(day) as bigint) m, count(*) n, round(sum(price), 2) + 0.0 total from o where year(day) in (1996, 1997) group by 1, 2", (), False)
def a1(spark, sf_dir):
    path = T.scratch(spark)
    T.write_panel(orders(spark, sf_dir), path, "day")
    x = T.scan_panel(spark, path, [1996, 1997])
    return x.groupBy(F.year("day").cast("long").alias("y"), F.month("day").cast("long").alias("m")).agg(F.count("*").alias("n"), r(F.sum("price"), 2).alias("total"))


@table("a3_scan_raw_json", _O + " select day, case when dayofyear(day) % 50 = 0 then 'row_count' when dayofyear(day) % 51 = 0 then 'partition_date' when dayofyear(day) % 53 = 0 then 'unreadable' else 'ok' end status, case when dayofyear(day) % 50 = 0 or dayofyear(day) % 51 = 0 or dayofyear(day) % 53 = 0 then 0 else count(*) end n, case when dayofyear(day) % 50 <> 0 and dayofyear(day) % 51 <> 0 and dayofyear(day) % 53 <> 0 then round(sum(price), 2) + 0.0 end total from o group by day", ("day",), False)
def a3(spark, sf_dir):
    y = F.dayofyear("day")
    named = F.when((y % 51 == 0) & (y % 50 != 0), F.date_add("day", 1)).otherwise(F.col("day"))
    payload = orders(spark, sf_dir).groupBy("day").agg(F.collect_list(F.struct("k", "price")).alias("items"))
    text = F.to_json(F.struct(F.date_format(named, "yyyyMMdd").alias("day"), (F.size("items") + F.when(y % 50 == 0, 1).otherwise(0)).cast("long").alias("n"), "items"))
    raw = payload.select("day", F.when((y % 53 == 0) & (y % 50 != 0) & (y % 51 != 0), F.substring(text, 1, 20)).otherwise(text).alias("payload"))
    rows = I.decode_payloads(raw, "payload", "struct<k: bigint, price: double>", "day")
    return rows.groupBy("day", "status").agg(F.count("item").alias("n"), r(F.sum("item.price"), 2).alias("total"))


@table("a4_normalize_types", _O + " select k, case when k % 7 <> 0 then day end as day, case when k % 11 <> 0 then round(price, 2) + 0.0 end price, coalesce(k % 7 <> 0 and k % 13 = 0, false) mismatch from o", ("day",), False)
def a4(spark, sf_dir):
    raw = orders(spark, sf_dir).select("k", F.when(F.col("k") % 13 == 0, F.date_add("day", 1)).otherwise(F.col("day")).alias("partition_day"), F.when(F.col("k") % 7 == 0, " ").otherwise(F.date_format("day", "yyyyMMdd")).alias("day"), F.when(F.col("k") % 11 == 0, "n/a").otherwise(F.col("price").cast("string")).alias("price"))
    x = I.normalize_types(raw, ["day"], ["price"])
    return x.select("k", "day", r("price", 2).alias("price"), F.coalesce(F.col("day") != F.col("partition_day"), F.lit(False)).alias("mismatch"))


@panel("a5_normalize_vendor_bars", "select lpad(cast(case when inst % 2 = 0 then 600000 else 0 end + inst as varchar), 6, '0') || case when inst % 2 = 0 then '.SH' else '.SZ' end code, session, round(volume, 2) + 0.0 shares, cast(session as timestamp) + interval 15 hours closed_at from bars where volume is not null", ("session", "closed_at"))
def a5(df):
    has = df.filter("volume is not null")
    one = has.filter("inst % 2 = 0").select(F.format_string("sh.%06d", 600000 + F.col("inst")).alias("symbol"), "session", (F.col("volume") / 100).alias("lots"))
    two = has.filter("inst % 2 = 1").select(F.format_string("%06d.SZ", "inst").alias("ts_code"), "session", F.col("volume").alias("vol"))
    both = I.vendor_bars(one, "symbol", F.col("lots") * 100, "session").unionByName(I.vendor_bars(two, "ts_code", F.col("vol"), "session"))
    return both.withColumn("shares", r("shares", 2))


@table("a6_normalize_bank_report", "select cast(c_custkey as bigint) k, case when c_custkey % 9 <> 0 then round(cast(c_acctbal as double), 2) + 0.0 end npl_ratio, round(cast(c_nationkey as double), 2) + 0.0 provision, concat_ws(',', case when c_custkey % 9 <> 0 and c_acctbal not between 0 and 5000 then 'npl_ratio_out_of_range' end, case when c_custkey % 9 <> 0 and c_acctbal > c_nationkey then 'npl_ratio_above_provision' end) flags from customer", (), False)
def a6(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    raw = c.select(F.col("c_custkey").cast("long").alias("k"), F.when(F.col("c_custkey") % 9 == 0, "--").otherwise(F.col("c_acctbal").cast("string")).alias("BLDKL"), F.col("c_nationkey").cast("string").alias("BBFGL"))
    x = I.report_metrics(raw, {"BLDKL": "npl_ratio", "BBFGL": "provision"}, {"npl_ratio": (0.0, 5000.0)}, [("npl_ratio", "provision")])
    return x.select("k", r("npl_ratio", 2).alias("npl_ratio"), r("provision", 2).alias("provision"), F.concat_ws(",", "flags").alias("flags"))


@table("a7_sink_parquet_sorted", _O + " select k, day, round(price, 2) + 0.0 price, cast(0 as bigint) disorder from o", ("day",), False)
def a7(spark, sf_dir):
    path = T.scratch(spark)
    T.write_sorted(orders(spark, sf_dir).withColumn("y", F.year("day")), path, ["day", "k"], ["y"])
    x = spark.read.parquet(path).withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id())
    from pyspark.sql import Window

    before = F.lag(F.struct("day", "k")).over(Window.partitionBy("file").orderBy("at"))
    return x.select("k", "day", r("price", 2).alias("price"), F.when(before > F.struct("day", "k"), 1).otherwise(0).cast("long").alias("disorder"))


@table("a8_records_to_json_values", _O + """ select k, '{"day":"' || strftime(day, '%Y-%m-%d') || '","priority":"' || priority || '","status":"' || status || '"}' as val from o""", (), False)
def a8(spark, sf_dir):
    values = F.create_map(F.lit("status"), F.col("status"), F.lit("day"), F.col("day").cast("string"), F.lit("priority"), F.col("priority"))
    return orders(spark, sf_dir).select("k", I.canonical_json(values).alias("val"))


@table("a9_row_content_hash_lineage", _O + " select k, sha256('=' || priority || '|' || '=' || status) content, sha256('=' || k || '|' || '=' || priority || '|' || '=' || status) with_lineage from o", (), False)
def a9_lineage(spark, sf_dir):
    h = T.lineage_hashes(["status", "priority"], ["k"])
    return orders(spark, sf_dir).select("k", *(c.alias(n) for n, c in h.items()))


_UNITS = [("open", "cny"), ("close", "cny"), ("volume", "shares"), ("amount", "cny")]


@panel("a10_inline_dictionary", f"u as (select * from (values {', '.join(map(str, _UNITS))}) u(col_name, unit)), l as (select 'open' col_name, open v from bars union all select 'close', close from bars union all select 'volume', volume from bars union all select 'amount', amount from bars) select col_name, unit, count(v) n, round(sum(v), 2) + 0.0 total from l join u using (col_name) group by 1, 2", ())
def a10(df):
    units = df.sparkSession.createDataFrame(_UNITS, "col_name string, unit string")
    long = df.unpivot([], [c for c, _ in _UNITS], "col_name", "v")
    return long.join(F.broadcast(units), "col_name").groupBy("col_name", "unit").agg(F.count("v").alias("n"), r(F.sum("v"), 2).alias("total"))


@table("a11_incremental_upsert_series", _O + " select k, day, round(case when k % 2 = 0 then price + 1 else price end, 2) + 0.0 price from o where k % 3 <> 0 or k % 2 = 0", ("day",), False)
def a11(spark, sf_dir):
    o = orders(spark, sf_dir).select("k", "day", "price")
    x = I.upsert(o.filter("k % 3 <> 0"), o.filter("k % 2 = 0").withColumn("price", F.col("price") + 1), ["k"])
    return x.select("k", "day", r("price", 2).alias("price"))


@table("a13_standard_input_cut", f"with {_FACTS}, c as (select inst, period_end, available > date '1998-06-30' late, available <= date '1998-06-30' and period_end > date '1998-03-31' beyond, case when k % 31 <> 0 then value end v from facts), g as (select inst, period_end, count(*) n, count(v) v from c where not late and not beyond group by 1, 2) select cast(sum(n) as bigint) kept, cast((select count(*) from c where late) as bigint) late, cast((select count(*) from c where beyond) as bigint) beyond, cast(sum(n - 1) as bigint) repeated_keys, cast(sum(n - v) as bigint) not_finite from g", (), False)
def a13(spark, sf_dir):
    f = facts(spark, sf_dir).withColumn("value", F.when(F.col("k") % 31 != 0, F.col("value")).when(F.col("k") % 2 == 0, float("inf")))
    return I.input_cut(f, ["inst", "period_end"], "available", "period_end", "value", F.lit("1998-06-30").cast("date"), F.lit("1998-03-31").cast("date"))


_PREFIX = ["600", "601", "688", "000", "300", "430", "900", "200"]
_SEC = f"sec as (select cast(s_suppkey as bigint) k, [{', '.join(repr(p) for p in _PREFIX)}][1 + cast(s_suppkey % 8 as int)] || lpad(cast(s_suppkey % 1000 as varchar), 3, '0') symbol, ['SSE', 'SSE', 'SSE', 'SZSE', 'SZSE', 'BSE', 'SSE', 'SZSE'][1 + cast(s_suppkey % 8 as int)] exchange, date '1995-01-02' + cast(s_suppkey % 300 as int) list_date, case when s_suppkey % 3 <> 0 then date '1995-01-02' + cast(s_suppkey % 300 + 700 as int) end delist_date from supplier)"


def securities(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("k"))
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("k") % 8).cast("int") + 1)
    day = lambda n: F.date_add(F.lit("1995-01-02").cast("date"), n.cast("int"))
    return s.select("k", F.concat(pick(_PREFIX), F.lpad((F.col("k") % 1000).cast("string"), 3, "0")).alias("symbol"), pick("SSE SSE SSE SZSE SZSE BSE SSE SZSE".split()).alias("exchange"), day(F.col("k") % 300).alias("list_date"), F.when(F.col("k") % 3 != 0, day(F.col("k") % 300 + 700)).alias("delist_date"))


@table("b3_a_share_flag", f"with {_SEC} select k, symbol, coalesce(exchange = 'BSE' or (exchange = 'SSE' and symbol like '6%') or (exchange = 'SZSE' and (symbol like '00%' or symbol like '30%')), false) is_a_share from sec", (), False)
def b3(spark, sf_dir):
    return securities(spark, sf_dir).select("k", "symbol", N.is_a_share(F.col("exchange"), F.col("symbol")).alias("is_a_share"))


@table("b4_universe_segments", f"with {_SEC} select k from sec where regexp_matches(symbol, '^(600|601|603|605|688|689)') and exchange = 'SSE' or regexp_matches(symbol, '^30[01]') and exchange = 'SZSE'", (), False)
def b4(spark, sf_dir):
    code = F.concat("symbol", F.lit("."), F.element_at(F.create_map(*map(F.lit, ("SSE", "SH", "SZSE", "SZ", "BSE", "BJ"))), F.col("exchange")))
    return securities(spark, sf_dir).filter(N.in_segments(code, ["SH_MAIN", "STAR", "CHINEXT"])).select("k")


_NAMES = ["Plain", "*ST Alpha", "ST Beta", "S*ST Gamma", "PT Delta", "STAR Corp", "Old 退", " sst eps"]


@table("b5_status_name_regex", f"with n as (select cast(c_custkey as bigint) k, [{', '.join(repr(n) for n in _NAMES)}][1 + cast(c_custkey % 8 as int)] as nm, c_custkey % 16 < 8 pit, c_custkey % 48 = 0 st from customer) select k, regexp_matches(upper(nm), '^(S\\*ST|\\*ST|ST|SST|PT)') is_st_name, st or (pit and k % 8 in (1, 2, 3, 4, 6)) or (pit and k % 8 = 7) abnormal from n", (), False)
def b5(spark, sf_dir):
    k = F.col("c_custkey").cast("long")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("k"), F.element_at(F.array(*map(F.lit, _NAMES)), (k % 8).cast("int") + 1).alias("name"))
    return c.select("k", N.is_st_name(F.col("name")).alias("is_st_name"), N.is_abnormal(F.col("name"), F.col("k") % 48 == 0, F.col("k") % 16 < 8).alias("abnormal"))


@table("b12_corporate_action_available", _O + " select k, case when status = 'F' then day + cast(k % 30 as int) else day end available from o", ("available",), False)
def b12(spark, sf_dir):
    o = orders(spark, sf_dir).withColumn("imp_ann_date", F.date_add("day", (F.col("k") % 30).cast("int")))
    return o.select("k", N.action_available(F.col("status") == "F", F.col("imp_ann_date"), F.col("day")).alias("available"))


@table("b13_pit_exception_rows", f"with {_FACTS} select k, case when k % 17 = 0 then 'missing_entity' when k % 19 = 0 then 'missing_period' when k % 23 = 0 then 'available_before_period_end' end reason from facts where k % 17 = 0 or k % 19 = 0 or k % 23 = 0", (), False)
def b13(spark, sf_dir):
    f = facts(spark, sf_dir).select("k", F.when(F.col("k") % 17 != 0, F.col("inst")).alias("inst"), F.when(F.col("k") % 19 != 0, F.col("period_end")).alias("period_end"), F.when(F.col("k") % 23 == 0, F.date_sub("available", 90)).otherwise(F.col("available")).alias("available"))
    return N.pit_exceptions(f, "inst", "period_end", "available").select("k", "reason")


@table("b14_exclude_label_domain", _O + " select case when k % 5 = 0 then 'label_domain' when k % 5 = 1 then 'holdout_domain' when day > date '1998-06-30' then 'after_cutoff' else 'visible' end outcome, count(*) n from o group by 1", (), False)
def b14(spark, sf_dir):
    o = orders(spark, sf_dir).withColumn("domain", F.when(F.col("k") % 5 == 0, "label").when(F.col("k") % 5 == 1, "holdout").otherwise("feature"))
    return N.feature_view(o, "domain", "day", "1998-06-30").groupBy("outcome").agg(F.count("*").alias("n"))


@panel("b15_active_factor_versions", "f as (select inst, 'open0' factor, 1 + inst % 2 as ver from bars union all select inst, 'high0', 1 + inst % 2 from bars union all select inst, 'low0', 1 + inst % 2 from bars) select factor, cast(ver as bigint) ver, count(*) n from f where not (factor = 'open0' and ver = 1) and not (factor = 'low0' and ver = 2) group by 1, 2", ())
def b15(df):
    long = df.withColumn("ver", (F.col("inst") % 2 + 1).cast("long")).unpivot(["ver"], [F.col("open").alias("open0"), F.col("high").alias("high0"), F.col("low").alias("low0")], "factor", "val")
    out = df.sparkSession.createDataFrame([("open0", 1, "superseded"), ("low0", 2, "diagnostic"), ("high0", 2, "active")], "factor string, ver long, disposition string")
    return N.active_versions(long, out, ["factor", "ver"]).groupBy("factor", "ver").agg(F.count("*").alias("n"))


__all__ = ["QUERIES", "bars", "securities", "orders"]
