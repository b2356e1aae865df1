"""Era years, holidays and business days."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: eras (kanji, name, letter, first day, last day, first year) and holidays ---
ERAS = (
    ("明治", "Meiji", "M", "1868-01-25", "1912-07-29", 1868),
    ("大正", "Taisho", "T", "1912-07-30", "1926-12-24", 1912),
    ("昭和", "Showa", "S", "1926-12-25", "1989-01-07", 1926),
    ("平成", "Heisei", "H", "1989-01-08", "2019-04-30", 1989),
    ("令和", "Reiwa", "R", "2019-05-01", None, 2019),
)
FIXED_HOLIDAYS = (
    (1, 1, "New Year's Day"),
    (2, 11, "National Foundation Day"),
    (2, 23, "Emperor's Birthday"),
    (3, 20, "Vernal Equinox Day"),
    (4, 29, "Showa Day"),
    (5, 3, "Constitution Memorial Day"),
    (5, 4, "Greenery Day"),
    (5, 5, "Children's Day"),
    (8, 11, "Mountain Day"),
    (11, 3, "Culture Day"),
    (11, 23, "Labor Thanksgiving Day"),
)
# month, n-th Monday, name
MONDAY_HOLIDAYS = (
    (1, 2, "Coming of Age Day"),
    (7, 3, "Ocean Day"),
    (9, 3, "Respect for the Aged Day"),
    (10, 2, "Sports Day"),
)
AUTUMN_EQUINOX = "Autumn Equinox Day"  # 22 September in years divisible by four, else the 23rd
HOLIDAY_YEARS = range(2020, 2031)
# --- end of fixed values ---


def era_frame(spark: SparkSession, eras=ERAS) -> DataFrame:
    return spark.createDataFrame(
        [(ja, en, ab, date.fromisoformat(a), date.fromisoformat(b) if b else None, y) for ja, en, ab, a, b, y in eras],
        "era_ja string, era_name string, era_letter string, first_day date, last_day date, first_year int",
    )


def era_name(day: Column, eras=ERAS) -> Column:
    """English era name of a date; null before the first era. Eras do not overlap, so first day decides."""
    out = F.lit(None).cast("string")
    for _, en, _, first, last, _ in eras:
        inside = day >= F.lit(first).cast("date")
        if last:
            inside = inside & (day <= F.lit(last).cast("date"))
        out = F.when(inside, F.lit(en)).otherwise(out)
    return out


def era_year(day: Column, eras=ERAS) -> Column:
    firsts = F.create_map(*[x for _, en, _, _, _, y in eras for x in (F.lit(en), F.lit(y))])
    return (F.year(day) - F.element_at(firsts, era_name(day, eras)) + 1).cast("bigint")


def to_era(df: DataFrame, day: str, eras=ERAS) -> DataFrame:
    """Add era_name and era_year. Five eras are five literal range tests, not a join."""
    d = F.col(day).cast("date")
    return df.withColumns({"era_name": era_name(d, eras), "era_year": era_year(d, eras)})


def from_era(df: DataFrame, era: str, year: str, month: str, day: str, eras=ERAS) -> DataFrame:
    """Add the Gregorian date of an era date and an error: unknown_era, invalid_date or outside_era.

    The era may be given as kanji, English name or letter.
    """
    rows = [
        (alias, first, last or "9999-12-31", y) for ja, en, ab, first, last, y in eras for alias in (ja, en, ab)
    ]
    names = [x for r in rows for x in (F.lit(r[0]), F.struct(F.lit(r[1]).alias("a"), F.lit(r[2]).alias("b"), F.lit(r[3]).alias("y")))]
    staged = df.withColumn("__era", F.element_at(F.create_map(*names), F.col(era)))
    made = F.try_make_timestamp(
        F.col("__era.y") + F.col(year).cast("int") - 1, F.col(month).cast("int"), F.col(day).cast("int"), F.lit(0), F.lit(0), F.lit(0)
    ).cast("date")
    staged = staged.withColumn("__day", made)
    inside = F.col("__day").between(F.col("__era.a").cast("date"), F.col("__era.b").cast("date"))
    return staged.withColumns(
        {
            "era_error": F.when(F.col("__era").isNull(), F.lit("unknown_era"))
            .when(F.col("__day").isNull(), F.lit("invalid_date"))
            .when(~inside, F.lit("outside_era"))
            .otherwise(F.lit("")),
            "gregorian": F.when(inside, F.col("__day")),
        }
    ).drop("__era", "__day")


def _nth_monday(year: int, month: int, n: int) -> date:
    first = date(year, month, 1)
    return first + timedelta(days=(-first.weekday()) % 7 + 7 * (n - 1))


def holiday_list(years=HOLIDAY_YEARS) -> list[tuple[date, str]]:
    out = []
    for y in years:
        out += [(date(y, m, d), name) for m, d, name in FIXED_HOLIDAYS]
        out += [(_nth_monday(y, m, n), name) for m, n, name in MONDAY_HOLIDAYS]
        out.append((date(y, 9, 22 if y % 4 == 0 else 23), AUTUMN_EQUINOX))
    return sorted(out)


def holidays(spark: SparkSession, years=HOLIDAY_YEARS) -> DataFrame:
    """The holiday table; a year adds sixteen rows."""
    return spark.createDataFrame(holiday_list(years), "holiday date, holiday_name string")


def holidays_between(table: DataFrame, start: str, end: str) -> DataFrame:
    return table.where(F.col("holiday").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def is_business_day(df: DataFrame, day: str, table: DataFrame, closed: DataFrame | None = None, out: str = "business_day") -> DataFrame:
    """Neither weekend nor holiday nor a closed day of the organisation (``closed``: holiday)."""
    off = table.select("holiday")
    if closed is not None:
        off = off.unionByName(closed.select("holiday"))
    off = off.distinct().withColumn("__off", F.lit(True))
    d = F.col(day).cast("date")
    joined = df.join(off, d == F.col("holiday"), "left")
    return joined.withColumn(out, (F.weekday(d) < 5) & F.col("__off").isNull()).drop("holiday", "__off")


def business_days(df: DataFrame, start: str, end: str, holiday_days: list[date], out: str = "business_days") -> DataFrame:
    """Business days from start to end, both included; 0 when the end comes first.

    Weekdays come from arithmetic and holidays from a sorted literal list, so there is no join
    between date ranges and days.
    """
    a, b = F.col(start).cast("date"), F.col(end).cast("date")

    def weekdays_before(d: Column) -> Column:
        # days since Monday 1969-12-29
        n = F.datediff(d, F.lit("1969-12-29").cast("date"))
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))

    week = weekdays_before(F.date_add(b, 1)) - weekdays_before(a)
    off = F.array(*[F.lit(d) for d in sorted(set(holiday_days)) if d.weekday() < 5]).cast("array<date>")
    free = F.size(F.filter(off, lambda h: h.between(a, b)))
    return df.withColumn(out, F.when(b < a, F.lit(0)).otherwise(week - free).cast("bigint"))


def era_in_filename(name: Column, eras=ERAS) -> Column:
    """Gregorian year of an era year in a filename: letter and two digits first, then kanji."""
    letters = F.create_map(*[x for _, _, ab, _, _, y in eras for x in (F.lit(ab), F.lit(y))])
    kanji = F.create_map(*[x for ja, _, _, _, _, y in eras for x in (F.lit(ja), F.lit(y))])
    by_letter, by_kanji = r"([RHSTM])(\d{2})", r"(令和|平成|昭和|大正|明治)(\d{1,2})"

    def year(table: Column, pattern: str) -> Column:
        key = F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
        return F.element_at(table, key) + F.regexp_extract(name, pattern, 2).try_cast("int") - 1

    return F.coalesce(year(letters, by_letter), year(kanji, by_kanji)).cast("bigint")
