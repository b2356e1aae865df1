"""Eras, holidays, business days."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewall.operators import calendar as C
from tidewall.plans.catalog import query
from tidewall.plans.views import load

ERA = "case when d >= date '2019-05-01' then 'Reiwa' when d >= date '1989-01-08' then 'Heisei' when d >= date '1926-12-25' then 'Showa' when d >= date '1912-07-30' then 'Taisho' when d >= date '1868-01-25' then 'Meiji' end"
FIRST = "case when d >= date '2019-05-01' then 2019 when d >= date '1989-01-08' then 1989 when d >= date '1926-12-25' then 1926 when d >= date '1912-07-30' then 1912 when d >= date '1868-01-25' then 1868 end"
DAYS = "d as (select o_orderkey, cast(cast(o_orderdate as date) + cast((o_orderkey % 130 - 100) * 400 as integer) as date) as d from orders)"


def moved(spark, d):
    return load(spark, d, "orders").selectExpr("o_orderkey", "date_add(to_date(o_orderdate), cast((o_orderkey % 130 - 100) * 400 as int)) as d")


@query("C1_to_era", f"with {DAYS} select o_orderkey, {ERA} as era_name, cast(year(d) - {FIRST} + 1 as bigint) as era_year from d where d >= date '1868-01-25'")
def _(spark, d):
    return C.to_era(moved(spark, d), "d").where("era_name is not null").select("o_orderkey", "era_name", "era_year")


@query(
    "C2_from_era",
    """with q as (select o_orderkey, case o_orderkey % 5 when 0 then 'R' when 1 then 'Heisei' when 2 then '昭和' when 3 then 'T' else 'Edo' end as era, 1 + o_orderkey % 70 as y, 1 + o_orderkey % 12 as m, 1 + o_orderkey % 31 as dd,
           case o_orderkey % 5 when 0 then 2019 when 1 then 1989 when 2 then 1926 when 3 then 1912 end as fy,
           case o_orderkey % 5 when 0 then date '2019-05-01' when 1 then date '1989-01-08' when 2 then date '1926-12-25' when 3 then date '1912-07-30' end as lo,
           case o_orderkey % 5 when 0 then date '9999-12-31' when 1 then date '2019-04-30' when 2 then date '1989-01-07' when 3 then date '1926-12-24' end as hi from orders),
       g as (select *, try_cast(concat(fy + y - 1, '-', m, '-', dd) as date) as g from q)
       select o_orderkey, case when fy is null then 'unknown_era' when g is null then 'invalid_date' when g < lo or g > hi then 'outside_era' else '' end as era_error,
         case when g between lo and hi then strftime(g, '%Y-%m-%d') end as gregorian from g""",
)
def _(spark, d):
    q = load(spark, d, "orders").selectExpr(
        "o_orderkey", "case o_orderkey % 5 when 0 then 'R' when 1 then 'Heisei' when 2 then '昭和' when 3 then 'T' else 'Edo' end as era",
        "1 + o_orderkey % 70 as y", "1 + o_orderkey % 12 as m", "1 + o_orderkey % 31 as dd",
    )
    return C.from_era(q, "era", "y", "m", "dd").select("o_orderkey", "era_error", F.col("gregorian").cast("string").alias("gregorian"))


def nth_monday(m: int, n: int) -> str:
    first = f"make_date(y, {m}, 1)"
    return f"{first} + cast((8 - isodow({first})) % 7 + {7 * (n - 1)} as integer)"


HOLIDAYS = (
    "hol as (select cast(h as date) as holiday, holiday_name from ("
    + " union all ".join(
        [f"select make_date(y, {m}, {d}) as h, '{name.replace(chr(39), chr(39) * 2)}' as holiday_name from range(2020, 2031) t(y)" for m, d, name in C.FIXED_HOLIDAYS]
        + [f"select {nth_monday(m, n)}, '{name}' from range(2020, 2031) t(y)" for m, n, name in C.MONDAY_HOLIDAYS]
        + ["select make_date(y, 9, case when y % 4 = 0 then 22 else 23 end), 'Autumn Equinox Day' from range(2020, 2031) t(y)"]
    )
    + ") x)"
)


@query(
    "C3_holidays",
    f"""with {HOLIDAYS}, e as (select strftime(ts, '%Y-%m-%d') as day, count(*) as n from events group by 1)
        select strftime(holiday, '%Y-%m-%d') as holiday, holiday_name, cast(coalesce(e.n, 0) as bigint) as events from hol left join e on e.day = strftime(holiday, '%Y-%m-%d')""",
)
def _(spark, d):
    e = load(spark, d, "events").groupBy(F.to_date("ts").alias("holiday")).agg(F.count(F.lit(1)).alias("events"))
    return C.holidays(spark).join(e, "holiday", "left").select(F.col("holiday").cast("string").alias("holiday"), "holiday_name", F.coalesce("events", F.lit(0)).alias("events"))


SOON = "n as (select o_orderkey, cast(cast(o_orderdate as date) + 10500 as date) as d from orders)"


def soon(spark, d):
    return load(spark, d, "orders").selectExpr("o_orderkey", "date_add(to_date(o_orderdate), 10500) as d")


@query(
    "C4_is_business_day",
    f"with {HOLIDAYS}, {SOON} select o_orderkey, strftime(d, '%Y-%m-%d') as d, isodow(d) <= 5 and d not in (select holiday from hol) and strftime(d, '%m-%d') <> '12-30' as business_day from n",
)
def _(spark, d):
    days = soon(spark, d)
    closed = days.where("date_format(d, 'MM-dd') = '12-30'").select(F.col("d").alias("holiday")).distinct()
    return C.is_business_day(days, "d", C.holidays(spark), closed).withColumn("d", F.col("d").cast("string"))


@query(
    "C5_holidays_between",
    f"""with {HOLIDAYS}, {SOON} select holiday_name, cast(count(*) as bigint) as orders from hol join n on n.d = hol.holiday where holiday between date '2022-01-01' and date '2024-06-30' group by 1""",
)
def _(spark, d):
    window = C.holidays_between(C.holidays(spark), "2022-01-01", "2024-06-30")
    return soon(spark, d).join(F.broadcast(window), F.col("d") == F.col("holiday")).groupBy("holiday_name").agg(F.count(F.lit(1)).alias("orders"))


NAME = "concat('doc_', case event_id % 5 when 0 then 'R' when 1 then 'H' when 2 then '令和' when 3 then '昭和' else 'x' end, cast(event_id % 64 as string), '.pdf')"


@query(
    "C6_era_in_filename",
    f"""with n as (select event_id, {NAME} as name from events)
        select event_id, name, cast(case when event_id % 5 = 0 and event_id % 64 >= 10 then 2018 + event_id % 64 when event_id % 5 = 1 and event_id % 64 >= 10 then 1988 + event_id % 64
          when event_id % 5 = 2 then 2018 + event_id % 64 when event_id % 5 = 3 then 1925 + event_id % 64 end as bigint) as gregorian_year from n""",
)
def _(spark, d):
    return load(spark, d, "events").selectExpr("event_id", f"{NAME} as name").withColumn("gregorian_year", C.era_in_filename(F.col("name")))


@query(
    "C7_business_days",
    f"""with {HOLIDAYS}, n as (select o_orderkey, cast(cast(o_orderdate as date) + 10500 as date) as a, cast(cast(o_orderdate as date) + 10500 + cast(o_orderkey % 40 - 3 as integer) as date) as b from orders),
        x as (select o_orderkey, cast(a + cast(i as integer) as date) as day from n, unnest(range(0, greatest(date_diff('day', a, b) + 1, 0))) as u(i))
        select n.o_orderkey, cast(count(x.day) as bigint) as business_days from n left join x on x.o_orderkey = n.o_orderkey and isodow(x.day) <= 5 and x.day not in (select holiday from hol) group by 1""",
)
def _(spark, d):
    q = load(spark, d, "orders").selectExpr(
        "o_orderkey", "date_add(to_date(o_orderdate), 10500) as a", "date_add(to_date(o_orderdate), cast(10500 + o_orderkey % 40 - 3 as int)) as b"
    )
    return C.business_days(q, "a", "b", [h for h, _ in C.holiday_list()]).select("o_orderkey", "business_days")
