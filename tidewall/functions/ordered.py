"""Ordered work that does not put a hot key into one task.

A window or fold per key sends all rows of the key to one task. Here a key is cut into buckets of
its order (an hour, a thousand chunks). The work runs per (key, bucket), and only one edge row per
bucket travels between the buckets of a key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidewall.session import cut_lineage

BUCKET = "__bucket"


def time_bucket(ts: Column, seconds: int = 3600) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / (seconds * 1_000_000)).cast("bigint")


def _join_carry(inner: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``__carry`` of the row's key and bucket; a null key is a key of its own."""
    by = [*keys, BUCKET]
    right = carry.select(*(F.col(k).alias(f"__r{i}") for i, k in enumerate(by)), "__carry")
    on = F.lit(True)
    for i, k in enumerate(by):
        on = on & F.col(k).eqNullSafe(F.col(f"__r{i}"))
    return inner.join(right, on, "left").drop(*(f"__r{i}" for i in range(len(by))))


def _neighbour(
    df: DataFrame, keys: list[str], order: list[str], values: dict[str, str], bucket: Column, forward: bool
) -> DataFrame:
    cols = [F.col(c).alias(c) for c in dict.fromkeys(values.values())]
    step, pick = (F.lead, F.min_by) if forward else (F.lag, F.max_by)
    cut = df.withColumn(BUCKET, bucket)
    w = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    inner = cut.withColumn("__near", step(F.struct(*cols)).over(w))
    edges = cut.groupBy(*keys, BUCKET).agg(pick(F.struct(*cols), F.struct(*order)).alias("__edge"))
    carry = edges.withColumn("__carry", step("__edge").over(Window.partitionBy(*keys).orderBy(BUCKET))).drop("__edge")
    joined = _join_carry(inner, carry, keys)
    near = F.coalesce("__near", "__carry")
    return joined.select(*df.columns, *[near[c].alias(out) for out, c in values.items()])


def with_previous(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str], bucket: Column) -> DataFrame:
    """Add the values of the row before, per key (``values``: new name -> column). ``order`` must be total."""
    return _neighbour(df, keys, order, values, bucket, forward=False)


def with_next(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str], bucket: Column) -> DataFrame:
    """Add the values of the row after."""
    return _neighbour(df, keys, order, values, bucket, forward=True)


def _running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], bucket: Column, fold: Callable, joint: Callable) -> DataFrame:
    """Folds the values of all rows up to this one: inside the bucket, and over the buckets before."""
    cut = df.withColumns({BUCKET: bucket} | {f"__v_{out}": v for out, v in values.items()})
    w = Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = cut.select(*cut.columns, *(fold(f"__v_{out}").over(w).alias(f"__part_{out}") for out in values))
    totals = cut.groupBy(*keys, BUCKET).agg(*(fold(f"__v_{out}").alias(f"__t_{out}") for out in values))
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, BUCKET, F.struct(*(fold(f"__t_{out}").over(before).alias(out) for out in values)).alias("__carry"))
    joined = _join_carry(inner, carry, keys)
    return joined.select(*df.columns, *(joint(F.col(f"__part_{out}"), F.col("__carry")[out]).alias(out) for out in values))


def with_running_sum(
    df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, bucket: Column
) -> DataFrame:
    """Add the sum of ``value`` from the first row of the key up to this row."""
    return _running(df, keys, order, {out: value}, bucket, F.sum, lambda a, b: a + F.coalesce(b, F.lit(0)))


def with_running_max(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, bucket: Column) -> DataFrame:
    """Add the largest ``value`` from the first row of the key up to this row; nulls are passed over."""
    return _running(df, keys, order, {out: value}, bucket, F.max, F.greatest)


def with_next_marked(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, bucket: Column) -> DataFrame:
    """Add the first ``value`` that is not null from this row of the key on."""
    cut = df.withColumns({BUCKET: bucket, "__v": value})
    down = [F.col(c).desc() for c in order]
    w = Window.partitionBy(*keys, BUCKET).orderBy(*down).rowsBetween(Window.unboundedPreceding, 0)
    inner = cut.withColumn("__near", F.last("__v", ignorenulls=True).over(w))
    place = F.when(F.col("__v").isNotNull(), F.struct(*order))
    firsts = cut.groupBy(*keys, BUCKET).agg(F.min_by("__v", place).alias("__first"))
    later = Window.partitionBy(*keys).orderBy(F.col(BUCKET).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = firsts.withColumn("__carry", F.last("__first", ignorenulls=True).over(later)).drop("__first")
    return _join_carry(inner, carry, keys).select(*df.columns, F.coalesce("__near", "__carry").alias(out))


def next_after(df: DataFrame, keys: list[str], order: list[str], ts: str, id_col: str, seconds: int, bucket_seconds: int) -> DataFrame:
    """id_col and ``next_id`` of every row: the first row of its key that lies at least ``seconds`` later (0: the next row)."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    if seconds <= 0:
        return with_next(df, keys, order, {"next_id": id_col}, time_bucket(F.col(ts), bucket_seconds)).select(id_col, "next_id")
    slim = df.select(*dict.fromkeys([*keys, *order, id_col]), micros.alias("__t"))
    ask = slim.withColumns({"__t": F.col("__t") + seconds * 1_000_000, "__row": F.lit(None).cast("bigint")})
    both = slim.withColumn("__row", F.col(id_col).cast("bigint")).unionByName(ask)  # of one time, the question comes first
    bucket = F.floor(F.col("__t") / (bucket_seconds * 1_000_000)).cast("bigint")
    both = both.withColumn("__is_row", F.col("__row").isNotNull())
    found = with_next_marked(both, keys, ["__t", "__is_row", *order], F.col("__row"), "next_id", bucket)
    return found.where("not __is_row").select(id_col, "next_id")


def reached(jumps: DataFrame, starts: DataFrame) -> DataFrame:
    """``at`` of all places on the ways from ``starts`` (at) along ``jumps`` (at, to), at most one jump from each place and no way twice to one.

    Jumps double: after k rounds the places up to 2^k jumps away are known and every jump is 2^k long, so rounds are the
    logarithm of the longest way. Ways that end leave the table; no way is walked by one task.
    """
    useful = jumps.where(F.col("to").isNotNull())
    targets = useful.select(F.col("to").alias("at")).unionByName(starts.select("at")).distinct()
    seen = Observation()
    jump = cut_lineage(useful.join(targets, "at", "left_semi").select("at", "to").observe(seen, F.count(F.lit(1)).alias("n")))
    known = cut_lineage(starts.select("at"))
    while seen.get["n"]:
        ahead = cut_lineage(jump.join(known, "at").select(F.col("to").alias("at")))
        known = known.unionByName(ahead)
        seen = Observation()
        twice = jump.join(jump.select(F.col("at").alias("to"), F.col("to").alias("__to")), "to").select("at", F.col("__to").alias("to"))
        jump = cut_lineage(twice.observe(seen, F.count(F.lit(1)).alias("n")))
    return known


def trailing_count(df: DataFrame, keys: list[str], ts: str, seconds: int, out: str, id_col: str) -> DataFrame:
    """Add the number of the key's rows in (ts − seconds, ts].

    Buckets are as long as the window, so a row's window touches its own bucket and the one before.
    Each row visits both, and its count is read in its own.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    span = seconds * 1_000_000
    cut = df.withColumns({"__t": micros, "__own": F.floor(micros / span).cast("bigint")})
    both = cut.withColumn(BUCKET, F.explode(F.array(F.col("__own"), F.col("__own") + 1)))
    w = Window.partitionBy(*keys, BUCKET).orderBy("__t").rangeBetween(-(span - 1), 0)
    return both.withColumn(out, F.count(F.lit(1)).over(w)).where(F.col(BUCKET) == F.col("__own")).select(*df.columns, out)


def fold_in_order(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    fold: Callable,
    output: str,
    start: str = "",
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """Sequential fold per key, for rules no window can state.

    ``fold(state, rows) -> (state, columns)`` walks rows of one key (a pandas frame in order) from a
    start state, given as text, and returns the end state and the new columns; ``output`` is their
    DDL. A key of at most ``hot_rows`` rows is one group. A hotter key is cut into buckets that run in
    parallel from a guessed start; a bucket whose true start differs from the guess runs again,
    until no start changes, so the result is that of the plain fold. Folds that forget (limits,
    breakers) settle after two or three rounds.
    """
    import pandas as pd

    key_ddl = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    row_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    out_names = [p.strip().split(" ")[0].strip("`") for p in _top_level_commas(output)]
    columns = list(df.columns)
    by = [*keys, BUCKET]

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(order, kind="stable")
        first = rows.iloc[0]
        state, _ = fold(first["__start"], rows)
        return pd.DataFrame([[*[first[c] for c in by], first["__start"], state]], columns=[*by, "__start", "__end"])

    def outputs(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(order, kind="stable")
        _, made = fold(rows["__start"].iloc[0], rows)
        out = rows[columns].reset_index(drop=True)
        for name in out_names:
            out[name] = made[name]
        return out

    out_ddl = f"{row_ddl}, {output}"
    hot = cut_lineage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows).select(*keys))
    if hot.isEmpty():
        return df.withColumn("__start", F.lit(start)).groupBy(*keys).applyInPandas(outputs, out_ddl)

    cold = df.join(hot, keys, "left_anti").withColumn("__start", F.lit(start)).groupBy(*keys).applyInPandas(outputs, out_ddl)
    cut = df.join(hot, keys, "left_semi").withColumn(BUCKET, bucket)
    per_key = Window.partitionBy(*keys).orderBy(BUCKET)

    def run(starts: DataFrame) -> DataFrame:
        ends_ddl = f"{key_ddl}, {BUCKET} bigint, __start string, __end string"
        return cut.join(starts.select(*by, "__start"), by).groupBy(*by).applyInPandas(ends, ends_ddl)

    known = cut_lineage(run(cut.select(*by).distinct().withColumn("__start", F.lit(start))))
    while True:
        true_start = F.coalesce(F.lag("__end").over(per_key), F.lit(start))
        moved = cut_lineage(
            known.withColumn("__true", true_start).where("__true <> __start").select(*by, F.col("__true").alias("__start"))
        )
        if moved.isEmpty():
            break
        known = cut_lineage(known.join(moved.select(*by), by, "left_anti").unionByName(run(moved)))
    return cold.unionByName(cut.join(known.select(*by, "__start"), by).groupBy(*by).applyInPandas(outputs, out_ddl))


def _top_level_commas(ddl: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in ddl:
        depth += ch in "<("
        depth -= ch in ">)"
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]
