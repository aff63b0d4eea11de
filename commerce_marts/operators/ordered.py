"""Ordered operators: running totals, exact ranks, rolling statistics, gap fill, top rows per key.

Windows without a partition are used only over calendar rows (one per day, week or month), whose
number does not grow with the data. Anything ordered over raw rows or entities goes through
:func:`running_total`, which splits the order into buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import as_col, growth_pct, ratio
from .onerow import beside


# --- running totals over any number of rows -------------------------------------------------

def value_bucket(c: str | Column) -> Column:
    """A coarse bucket that never decreases as the value grows (about 1 % wide)."""
    x = as_col(c).cast("double")
    return (F.signum(x) * F.floor(F.log2(F.abs(x) + 1) * 64)).cast("bigint")


def running_total(df: DataFrame, by: str, weight: Column, descending: bool = False) -> DataFrame:
    """Running sum of ``weight`` in the order of ``by``; equal values share one row and one total.

    Equal values are summed first, so ties cannot pile up in a task. The distinct values are split
    into value buckets; a prefix over the few bucket totals is added to a running sum inside each.
    Returns ``by, weight, running, total``.
    """
    values = df.groupBy(by).agg(F.sum(weight).alias("weight")).withColumn("_bucket", value_bucket(by))
    direction = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    upto = Window.orderBy(direction("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    buckets = (
        values.groupBy("_bucket")
        .agg(F.sum("weight").alias("_sum"))
        .select(
            "_bucket",
            F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_before"),
            F.sum("_sum").over(whole).alias("total"),
        )
    )
    inside = Window.partitionBy("_bucket").orderBy(direction(by)).rowsBetween(Window.unboundedPreceding, 0)
    return values.join(buckets, "_bucket").select(
        by, "weight", (F.col("_before") + F.sum("weight").over(inside)).alias("running"), "total"
    )


def values_at_ranks(df: DataFrame, col: str, ranks: dict[str, Column]) -> DataFrame:
    """One row with the exact value at each 1-based rank of ``col``; a rank may use the count ``n``."""
    ordered = running_total(df.filter(F.col(col).isNotNull()), col, F.lit(1)).withColumnRenamed("total", "n")
    picks = [F.min(F.when(F.col("running") >= rank, F.col(col))).alias(name) for name, rank in ranks.items()]
    return ordered.agg(*picks)


def index_quantile(q: float) -> Column:
    """Rank of the element ``sorted[int(n * q)]``."""
    return F.floor(F.col("n") * q) + 1


def disc_quantile(q: float) -> Column:
    """Rank of the discrete quantile: the first value whose share reaches ``q``."""
    return F.greatest(F.ceil(F.col("n") * q), F.lit(1))


def running_share(df: DataFrame, value: str, out: str = "cumulative_revenue_pct") -> DataFrame:
    """Add the running share of ``value`` from the largest down; ties share a value.

    Rows that add nothing take the full share directly instead of meeting in one join key.
    """
    gains = df.filter(F.col(value) > 0)
    rest = df.filter(~(F.col(value) > 0) | F.col(value).isNull())
    exact = F.col(value).cast("decimal(18,2)")
    shares = running_total(gains, value, exact, descending=True).select(
        F.col(value), (F.col("running").cast("double") / F.col("total").cast("double")).alias(out)
    )
    anything = gains.agg(F.max(value).alias("m")).scalar()
    return gains.join(shares, value, "left").unionByName(
        rest.withColumn(out, F.when(anything > 0, F.lit(1.0)))
    )


# --- calendar series -----------------------------------------------------------------------

def _keyed(keys: list[str]):
    return Window.partitionBy(*keys) if keys else Window


def add_growth(df: DataFrame, value: str, out: str, order: list[str], keys: list[str] = []) -> DataFrame:
    """Percent change to the previous row of the series, two decimals."""
    before = F.lag(value, 1).over(_keyed(keys).orderBy(*order))
    return df.withColumn(out, F.round(growth_pct(value, before), 2))


def add_pct_change(df: DataFrame, value: str, out: str, order: list[str], keys: list[str] = []) -> DataFrame:
    before = F.lag(value, 1).over(_keyed(keys).orderBy(*order))
    return df.withColumn(out, growth_pct(value, before))


def add_rolling(df: DataFrame, value: str, order: str, sizes: dict[str, tuple[str, int]], keys: list[str] = []) -> DataFrame:
    """Rolling statistics over the last n rows. ``sizes`` maps output name to ``(avg|std, n)``."""
    cols = {}
    for name, (stat, n) in sizes.items():
        w = _keyed(keys).orderBy(order).rowsBetween(-(n - 1), 0)
        cols[name] = (F.avg(value) if stat == "avg" else F.stddev_samp(value)).over(w)
    return df.withColumns(cols)


def zscore(value: str, mean: str, std: str, floor: float = 0.01) -> Column:
    """Distance to the mean in deviations; the floor also stands in for a missing deviation."""
    return (F.col(value) - F.col(mean)) / F.greatest(F.col(std), F.lit(floor))


def fill_both_ways(c: str, order: str, keys: list[str] = [], forward_first: bool = False) -> Column:
    """Nearest following value, else nearest preceding one (or the other way round)."""
    w = _keyed(keys).orderBy(order)
    after = F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    before = F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(before, after) if forward_first else F.coalesce(after, before)


def full_rolling_features(df: DataFrame, value: str, order: str, sizes: list[int] = [7, 14, 30], keys: list[str] = []) -> DataFrame:
    """Rolling mean and deviation on full windows only, then filled back and forward.

    A series shorter than the largest window keeps NULLs.
    """
    w_all = _keyed(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = df.withColumn("_n", F.count(F.lit(1)).over(w_all))
    names = []
    for n in sizes:
        w = _keyed(keys).orderBy(order).rowsBetween(-(n - 1), 0)
        full = (F.count(F.lit(1)).over(w) == n) & (F.col("_n") >= max(sizes))
        out = out.withColumns(
            {f"rolling_avg_{n}": F.when(full, F.avg(value).over(w)), f"rolling_std_{n}": F.when(full, F.stddev_samp(value).over(w))}
        )
        names += [f"rolling_avg_{n}", f"rolling_std_{n}"]
    return out.withColumns({c: fill_both_ways(c, order, keys) for c in names}).drop("_n")


def lag_features(df: DataFrame, value: str, order: str, lags: list[int] = [1, 7, 14], keys: list[str] = []) -> DataFrame:
    """Lagged values, filled back and forward, then 0; a series shorter than the largest lag gets 0."""
    w_all = _keyed(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = _keyed(keys).orderBy(order)
    out = df.withColumn("_n", F.count(F.lit(1)).over(w_all))
    out = out.withColumns({f"lag_{k}": F.when(F.col("_n") >= max(lags), F.lag(value, k).over(w)) for k in lags})
    filled = {f"lag_{k}": F.coalesce(fill_both_ways(f"lag_{k}", order, keys), F.lit(0.0)) for k in lags}
    return out.withColumns(filled).drop("_n")


def centred_anomalies(df: DataFrame, value: str, order: str, keys: list[str] = [], limit: float = 2.0) -> DataFrame:
    """Rows more than ``limit`` deviations from a centred 7-row mean; needs 10 rows in the series."""
    w = _keyed(keys).orderBy(order).rowsBetween(-3, 3)
    w_all = _keyed(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = (F.count(F.lit(1)).over(w) == 7) & (F.count(F.lit(1)).over(w_all) >= 10)
    scored = df.withColumns(
        {"expected": F.when(full, F.avg(value).over(w)), "_std": F.when(full, F.stddev_samp(value).over(w))}
    ).withColumn("z_score", F.abs(ratio(F.col(value) - F.col("expected"), "_std")))
    kind = F.when(F.col(value) > F.col("expected"), "high").otherwise("low")
    return scored.filter(F.col("z_score") > limit).withColumn("type", kind).drop("_std")


def densify_daily(df: DataFrame, date: str, values: list[str], keys: list[str] = [], whole_numbers: list[str] = []) -> DataFrame:
    """One row per day from the first to the last date of each series, gaps filled linearly.

    ``whole_numbers`` are truncated after interpolation.
    """
    span = df.groupBy(*keys).agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    days = span.filter(F.col("_lo").isNotNull()).select(*keys, F.explode(F.sequence("_lo", "_hi")).alias(date))
    out = days.join(df, [*keys, date], "left")
    back = _keyed(keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    ahead = _keyed(keys).orderBy(date).rowsBetween(0, Window.unboundedFollowing)
    cols = {}
    for v in values:
        stamp = F.when(F.col(v).isNotNull(), F.col(date))
        d0, d1 = F.last(stamp, True).over(back), F.first(stamp, True).over(ahead)
        v0, v1 = F.last(v, True).over(back), F.first(v, True).over(ahead)
        line = v0 + (v1 - v0) * ratio(F.datediff(date, d0), F.datediff(d1, d0))
        filled = F.coalesce(F.col(v).cast("double"), line, v0.cast("double"), v1.cast("double"))
        cols[v] = filled.cast("bigint") if v in whole_numbers else filled
    return out.withColumns(cols)


def tail_mean(df: DataFrame, value: str, order: str, n: int = 7, keys: list[str] = []) -> DataFrame:
    """Mean of the last ``n`` values of each series."""
    return last_n(df, keys, [order], n).groupBy(*keys).agg(F.avg(value).alias("moving_average"))


def expanding_folds(df: DataFrame, order: str, n_splits: int = 5) -> DataFrame:
    """Expanding-window splits of a calendar series: (fold, role, row) with role train or test."""
    w = Window.orderBy(order)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = df.withColumns({"_rn": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(whole)})
    size = F.floor(F.col("_n") / (n_splits + 1))
    folds = numbered.filter(F.col("_n") >= n_splits * 2).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    role = F.when(F.col("_rn") < size * (F.col("fold") + 1), "train").when(F.col("_rn") < size * (F.col("fold") + 2), "test")
    return folds.withColumn("role", role).filter(F.col("role").isNotNull()).drop("_rn", "_n")


def look_back_sequences(df: DataFrame, value: str, order: str, look_back: int, keys: list[str] = []) -> DataFrame:
    """The ``look_back`` preceding values as an array with the current value as target."""
    w = _keyed(keys).orderBy(order).rowsBetween(-look_back, -1)
    return (
        df.withColumn("sequence", F.collect_list(value).over(w))
        .filter(F.size("sequence") == look_back)
        .select(*keys, order, "sequence", F.col(value).alias("target"))
    )


def min_max_scaled(df: DataFrame, value: str, keys: list[str] = []) -> DataFrame:
    """Add ``<value>_scaled`` in [0, 1]; a constant series gives 0."""
    bounds = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.coalesce(ratio(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    if keys:
        return df.join(bounds, keys).withColumn(f"{value}_scaled", scaled).drop("_lo", "_hi")
    return beside(df, bounds).withColumn(f"{value}_scaled", scaled).drop("_lo", "_hi")


# --- top rows ------------------------------------------------------------------------------

def last_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each key in the order of ``order``."""
    return top_n(df, keys, [F.desc(c) for c in order], n)


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key. Spark limits each map partition before the shuffle, so a hot key
    ships at most ``n`` rows per partition."""
    if not keys and rank is None:
        return df.orderBy(*order).limit(n)
    if not keys:
        df = df.orderBy(*order).limit(n)
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(_keyed(keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def filled_key(df: DataFrame, key: str, *names: str) -> DataFrame:
    """Add a key without nulls as two columns, ``_k`` and ``_none`` or ``names``: plain joins and windows on both treat null as a key.

    A null-safe comparison would do the same, but its join keys are no columns, so rows that are dealt by the key move again.
    """
    kind = df.schema[key].dataType
    value, none = names or ("_k", "_none")
    return df.withColumns({value: F.coalesce(F.col(key), F.lit("0").cast(kind)), none: F.col(key).isNull()})


def prior_count(df: DataFrame, key: str, ts: str, out: str, tie: str | None = None) -> DataFrame:
    """How many earlier rows (strictly before in time) the same key has; null is a key, rows without a time come before none.

    Counted per key and hour first; the raw rows are only ordered inside their hour, so a key that
    holds a large share of all rows is spread over its hours.
    """
    keys = ["_k", "_none", "_hour"]
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    hour = F.coalesce(F.floor(F.col("_micros") / 3_600_000_000), F.lit(-(1 << 62)))
    rows = filled_key(df, key).withColumn("_micros", micros).withColumn("_hour", hour)
    before = Window.partitionBy("_k", "_none").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    # Rows without a time count for nobody.
    hours = rows.groupBy(*keys).agg(F.count("_micros").alias("_c")).select(*keys, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy("_micros").rangeBetween(Window.unboundedPreceding, -1)
    counted = rows.withColumn("_in", F.when(F.col("_micros").isNotNull(), F.count(F.lit(1)).over(inside)).otherwise(0))
    return counted.join(hours, keys).withColumn(out, F.col("_before") + F.col("_in")).drop(*keys, "_micros", "_in", "_before")


def trailing_count(df: DataFrame, key: str, ts: str, seconds: int, out: str, slot_seconds: int = 60) -> DataFrame:
    """Rows of the same key within the last ``seconds`` up to and including the current row; null is a key.

    The figure is a difference of two running counts: rows up to now, less rows before the start of
    the period. Equal times of a key are counted first; running counts are kept by (key, time slot)
    and completed inside a slot, so the work grows with the rows and a busy key is spread over its slots.
    """
    keys = ["_k", "_none"]
    rows = filled_key(df, key).withColumn("_micros", F.unix_micros(F.col(ts).cast("timestamp")))
    # Rows without a time share a time of their own, far before all others.
    rows = rows.withColumn("_at", F.coalesce("_micros", F.lit(-(1 << 62))))
    points = rows.groupBy(*keys, "_at").agg(F.count(F.lit(1)).alias("_n"))
    now = F.struct(F.col("_at").alias("at"), F.col("_n").alias("n"), F.lit(True).alias("now"))
    start = F.struct((F.col("_at") - seconds * 1_000_000).alias("at"), F.lit(0).cast("bigint").alias("n"), F.lit(False).alias("now"))
    marks = points.select(*keys, "_at", F.explode(F.array(now, start)).alias("_m")).select(*keys, "_at", "_m.*")
    marks = marks.withColumn("_slot", F.floor(F.col("at") / (slot_seconds * 1_000_000)))
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = marks.groupBy(*keys, "_slot").agg(F.sum("n").alias("_c")).select(*keys, "_slot", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_slot").orderBy("at")
    upto, below = inside.rangeBetween(Window.unboundedPreceding, 0), inside.rangeBetween(Window.unboundedPreceding, -1)
    reached = F.when(F.col("now"), F.sum("n").over(upto)).otherwise(-F.coalesce(F.sum("n").over(below), F.lit(0)))
    counted = marks.withColumn("_in", reached).join(slots, [*keys, "_slot"])
    total = F.sum(F.col("_in") + F.when(F.col("now"), F.col("_before")).otherwise(-F.col("_before")))
    found = counted.groupBy(*keys, "_at").agg(total.alias(out))
    return rows.join(found, [*keys, "_at"]).drop(*keys, "_micros", "_at")
