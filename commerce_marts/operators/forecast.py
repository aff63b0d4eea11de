"""Per-series forecasts from aggregates: trend, weekday-seasonal and first-order autoregressive.

A series is (keys, date, value) with one row per day. All parameters of all series come from grouped
aggregates, and each method has a closed form for every step ahead, so one job forecasts any number
of series without Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import ratio
from .onerow import beside
from .ordered import tail_mean

MODELS = ["trend", "seasonal", "autoregressive"]


def _indexed(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    w = (Window.partitionBy(*keys) if keys else Window).orderBy("date")
    return series.select(
        *keys, "date", F.col(value).cast("double").alias("y"), (F.row_number().over(w) - 1).cast("double").alias("t"), F.lag(value).over(w).cast("double").alias("y1")
    )


def _attach(rows: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(params, keys) if keys else beside(rows, params)


def series_params(series: DataFrame, keys: list[str], value: str = "revenue") -> DataFrame:
    """Size, mean, deviation, line, autoregression and last point of every series."""
    rows = _indexed(series, keys, value)
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"), F.regr_slope("y", "t").alias("_slope"),
        F.regr_slope("y", "y1").alias("_phi"), F.regr_intercept("y", "y1").alias("_c"), F.max("date").alias("last_date"), F.max_by("y", "date").alias("last_y"),
    )
    slope = F.when(F.col("n") >= 3, F.coalesce("_slope", F.lit(0.0))).otherwise(0.0)
    phi = F.when(F.col("n") >= 3, F.coalesce("_phi", F.lit(0.0))).otherwise(0.0)
    return out.withColumns({"slope": slope, "phi": phi}).withColumn(
        "c", F.when(F.col("phi") == 0, F.col("mean")).otherwise(F.col("_c"))
    ).drop("_slope", "_phi", "_c")


def weekday_index(series: DataFrame, keys: list[str], value: str = "revenue") -> DataFrame:
    """Mean of each weekday over the mean of the series."""
    per_day = series.groupBy(*keys, F.weekday("date").alias("weekday")).agg(F.sum(F.col(value).cast("double")).alias("_s"), F.count(value).alias("_n"))
    w = Window.partitionBy(*keys) if keys else Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = ratio(F.sum("_s").over(w), F.sum("_n").over(w))
    return per_day.select(*keys, "weekday", ratio(F.col("_s") / F.col("_n"), whole).alias("index"))


def trend_forecast(series: DataFrame, keys: list[str], periods: int = 30, value: str = "revenue") -> DataFrame:
    """Mean plus linear trend with a 95 % band, never below 0; needs two points."""
    params = series_params(series, keys, value).filter("n >= 2")
    steps = params.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    return _banded(steps.withColumn("raw", F.col("mean") + F.col("slope") * F.col("step")), keys).withColumn("model", F.lit("trend"))


def _banded(steps: DataFrame, keys: list[str]) -> DataFrame:
    yhat = F.greatest(F.lit(0.0), F.col("raw"))
    band = F.col("std") * 1.96
    return steps.select(
        *keys, "step", F.date_add("last_date", F.col("step")).alias("date"), yhat.alias("yhat"),
        F.greatest(F.lit(0.0), yhat - band).alias("yhat_lower"), (yhat + band).alias("yhat_upper"),
    )


def all_forecasts(series: DataFrame, keys: list[str], periods: int = 30, value: str = "revenue") -> DataFrame:
    """The three methods for every series with enough points (7) and any value."""
    params = series_params(series, keys, value).filter("n >= 7 AND mean <> 0")
    steps = params.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    steps = steps.withColumn("weekday", F.weekday(F.date_add("last_date", F.col("step"))))
    steps = steps.join(weekday_index(series, keys, value), [*keys, "weekday"], "left")
    line = F.col("mean") + F.col("slope") * ((F.col("n") - 1) / 2 + F.col("step"))
    centre = ratio("c", 1 - F.col("phi"))
    stable = F.abs("phi") < 1
    decay = F.when(stable, centre + F.pow("phi", "step") * (F.col("last_y") - centre)).otherwise(F.col("last_y"))
    raws = {"trend": F.col("mean") + F.col("slope") * F.col("step"), "seasonal": line * F.coalesce("index", F.lit(1.0)), "autoregressive": decay}
    options = F.array(*[F.struct(F.lit(m).alias("model"), raws[m].alias("raw")) for m in MODELS])
    long = steps.withColumn("o", F.explode(options)).select("*", "o.model", "o.raw")
    return _banded(long, [*keys, "model"])


def fitted_values(series: DataFrame, keys: list[str], value: str = "revenue") -> DataFrame:
    """In-sample values of the three methods as (keys, date, model, fitted)."""
    rows = _indexed(series, keys, value).withColumn("weekday", F.weekday("date"))
    rows = _attach(rows, series_params(series, keys, value), keys).join(weekday_index(series, keys, value), [*keys, "weekday"], "left")
    line = F.col("mean") + F.col("slope") * (F.col("t") - (F.col("n") - 1) / 2)
    fits = {"trend": line, "seasonal": line * F.coalesce("index", F.lit(1.0)), "autoregressive": F.col("c") + F.col("phi") * F.col("y1")}
    options = F.array(*[F.struct(F.lit(m).alias("model"), fits[m].alias("fitted")) for m in MODELS])
    return rows.select(*keys, "date", F.explode(options).alias("o")).select(*keys, "date", "o.model", "o.fitted").filter("fitted IS NOT NULL")


def join_actuals(fitted: DataFrame, series: DataFrame, keys: list[str], value: str = "revenue") -> DataFrame:
    actual = series.select(*keys, "date", F.col(value).cast("double").alias("actual"))
    return fitted.join(actual, [*keys, "date"])


def forecast_metrics(joined: DataFrame, keys: list[str]) -> DataFrame:
    """MAE, RMSE, MAPE and R² of ``fitted`` against ``actual`` per key and model."""
    error = F.col("actual") - F.col("fitted")
    sums = joined.groupBy(*keys, "model").agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), (F.avg(F.abs(error / (F.col("actual") + 1e-10))) * 100).alias("mape"),
        F.sum(error * error).alias("_res"), (F.var_pop("actual") * F.count(F.lit(1))).alias("_tot"),
    )
    return sums.withColumn("r2", F.coalesce(1 - ratio("_res", "_tot"), F.lit(0.0))).drop("_res", "_tot")


def compare_models(forecasts: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and variance of each forecast with its composite error score; ``best_model`` has the lowest."""
    shape = forecasts.groupBy(*keys, "model").agg(F.avg("yhat").alias("avg_forecast"), F.var_pop("yhat").alias("variance"))
    score = (F.col("mae") / 10000 + F.col("rmse") / 10000 + F.col("mape") / 100 + (1 - F.col("r2"))) / 4
    df = shape.join(metrics, [*keys, "model"]).withColumn("score", F.round(score, 4))
    best = df.groupBy(*keys).agg(F.min_by("model", F.struct("score", "model")).alias("best_model"))
    return _attach(df, best, keys)


def seasonal_levels(series: DataFrame, keys: list[str], value: str = "revenue", high: float = 1.2, low: float = 0.8) -> DataFrame:
    """Mean monthly total of each calendar month over the years, its level against the mean of all months, peak and low months marked."""
    months = series.groupBy(*keys, F.year("date").alias("_year"), F.month("date").alias("month")).agg(F.sum(F.col(value).cast("double")).alias("_total"))
    # Fixed-point totals, so that the mean does not depend on the order of rows.
    mean = F.round(F.avg("_total"), 6).cast("decimal(28,6)")
    means = months.groupBy(*keys, "month").agg(F.count(F.lit(1)).alias("years"), mean.alias("total"))
    every = Window.partitionBy(*keys)
    means = means.withColumn("_all", F.sum("total").over(every).cast("double") / F.count(F.lit(1)).over(every)).withColumn("total", F.col("total").cast("double"))
    level = F.try_divide(F.col("total"), F.col("_all"))
    kind = F.when(F.col("level") > high, "peak").when(F.col("level") < low, "low")
    return means.withColumn("level", level).drop("_all").withColumn("type", kind)


def forecast_bundle(series: DataFrame, keys: list[str], periods: int = 30, value: str = "revenue") -> dict[str, DataFrame]:
    """Forecasts, in-sample errors, comparison, outlying days and seasonal levels of the given series."""
    from .ordered import centred_anomalies

    forecasts = all_forecasts(series, keys, periods, value)
    errors = forecast_metrics(join_actuals(fitted_values(series, keys, value), series, keys, value), keys)
    return {
        "forecasts": forecasts, "metrics": errors, "comparison": compare_models(forecasts, errors, keys),
        "anomalies": centred_anomalies(series, value, "date", keys), "seasonal": seasonal_levels(series, keys, value),
    }


def best_forecast(series: DataFrame, keys: list[str], periods: int = 30, value: str = "revenue") -> DataFrame:
    """Rows of the best method with trend label, confidence from R² and mean bounds."""
    parts = forecast_bundle(series, keys, periods, value)
    best = parts["comparison"].filter("model = best_model").select(*keys, "model", "r2")
    rows = parts["forecasts"].join(best, [*keys, "model"])
    rows = _attach(rows, series_params(series, keys, value).select(*keys, "slope"), keys)
    w = Window.partitionBy(*keys, "model")
    confidence = F.when(F.col("r2") != 0, F.greatest(F.lit(0), F.least(F.lit(100), (F.col("r2") * 100).cast("int")))).otherwise(85)
    label = F.when(F.col("slope") > 0.01, "upward").when(F.col("slope") < -0.01, "downward").otherwise("stable")
    return rows.select(
        *keys, "model", "step", "date", "yhat", "yhat_lower", "yhat_upper", label.alias("trend"), confidence.alias("confidence"),
        F.avg("yhat_lower").over(w).alias("lower_bound"), F.avg("yhat_upper").over(w).alias("upper_bound"),
    )


def ma_projection(series: DataFrame, keys: list[str] = [], value: str = "revenue", days: int = 14, window: int = 7) -> DataFrame:
    """Mean of the last rows projected ahead with a five-step ripple."""
    base = tail_mean(series, value, "date", window, keys)
    step = F.col("step")
    return base.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(days)))).select(
        *keys, "step", F.round(F.col("moving_average") * (1 + (step % 5 - 2) * 0.025), 2).alias("projection")
    )


def series_fingerprint(series: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """One order-free digest per series: the combined hash of its rows with their number."""
    row = F.md5(F.to_json(F.struct(*cols)))
    return series.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.conv(F.substring(row, 1, 15), 16, 10).cast("bigint")).alias("digest"))
