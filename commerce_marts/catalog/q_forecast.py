"""Time-series features and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast, inventory, metrics, ordered
from ..plans import kpis
from .registry import add_cte, query


def series(t):
    return metrics.sales_series(t.orders, t.as_of, None)


def units(t):
    return metrics.product_series(t.orders, t.order_items, t.as_of, None)


def rnd(df, cols, digits=3):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def rsql(cols, digits=3):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


add_cte("s_units", """SELECT created_at::date AS date, product_id, sum(quantity)::bigint AS quantity FROM s_items_user
    WHERE status IN ('Delivered', 'Shipped') GROUP BY 1, 2""")
ROLL = [f"rolling_{k}_{n}" for n in (7, 14, 30) for k in ("avg", "std")]
add_cte("s_roll1", "SELECT *, " + ", ".join(
    f"CASE WHEN count(*) OVER w{n} = {n} AND count(*) OVER () >= 30 THEN avg(revenue) OVER w{n} END AS rolling_avg_{n}, "
    f"CASE WHEN count(*) OVER w{n} = {n} AND count(*) OVER () >= 30 THEN stddev_samp(revenue) OVER w{n} END AS rolling_std_{n}" for n in (7, 14, 30))
    + " FROM s_series WINDOW " + ", ".join(f"w{n} AS (ORDER BY date ROWS {n - 1} PRECEDING)" for n in (7, 14, 30)))


def fill_sql(c):
    return f"coalesce(first_value({c} IGNORE NULLS) OVER f, last_value({c} IGNORE NULLS) OVER b)"


FILL_WINDOWS = "WINDOW f AS (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), b AS (ORDER BY date ROWS UNBOUNDED PRECEDING)"


@query("W09_full_rolling_features", "SELECT date, revenue, orders, " + ", ".join(f"round({fill_sql(c)}, 3) AS {c}" for c in ROLL) + f" FROM s_roll1 {FILL_WINDOWS}")
def _(t):
    return rnd(ordered.full_rolling_features(series(t), "revenue", "date"), ROLL)


add_cte("s_lag1", "SELECT *, lag(revenue, 1) OVER w AS lag_1, lag(revenue, 7) OVER w AS lag_7, lag(revenue, 14) OVER w AS lag_14 FROM s_series WINDOW w AS (ORDER BY date)")


@query("W10_lag_features", "SELECT date, revenue, orders, " + ", ".join(f"coalesce({fill_sql(c)}, 0.0) AS {c}" for c in ("lag_1", "lag_7", "lag_14")) + f" FROM s_lag1 {FILL_WINDOWS}")
def _(t):
    return ordered.lag_features(series(t), "revenue", "date")


@query("W11_centred_anomalies", """WITH r AS (SELECT *, count(*) OVER w AS c, avg(revenue) OVER w AS m, stddev_samp(revenue) OVER w AS d, count(*) OVER () AS n FROM s_series
    WINDOW w AS (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) SELECT date, revenue, orders, round(m, 3) AS expected, round(abs((revenue - m) / d), 3) AS z_score,
    CASE WHEN revenue > m THEN 'high' ELSE 'low' END AS type FROM r WHERE c = 7 AND n >= 10 AND abs((revenue - m) / nullif(d, 0)) > 2""")
def _(t):
    return rnd(ordered.centred_anomalies(series(t), "revenue", "date"), ["expected", "z_score"])


add_cte("s_days", "SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::date AS date FROM s_series")
add_cte("s_dense0", """SELECT d.date, s.revenue, s.orders::double AS orders, max(s.date) OVER b AS d0, min(s.date) OVER f AS d1, last_value(revenue IGNORE NULLS) OVER b AS r0,
    first_value(revenue IGNORE NULLS) OVER f AS r1, last_value(s.orders IGNORE NULLS) OVER b AS o0, first_value(s.orders IGNORE NULLS) OVER f AS o1
    FROM s_days d LEFT JOIN s_series s ON d.date = s.date WINDOW b AS (ORDER BY d.date ROWS UNBOUNDED PRECEDING), f AS (ORDER BY d.date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")


@query("W12_densify_daily", """SELECT date, round(coalesce(revenue, r0 + (r1 - r0) * ((date - d0)::double / nullif(d1 - d0, 0)), r0, r1), 3) AS revenue,
    trunc(coalesce(orders, o0 + (o1 - o0) * ((date - d0)::double / nullif(d1 - d0, 0)), o0, o1))::bigint AS orders FROM s_dense0""")
def _(t):
    return rnd(ordered.densify_daily(series(t), "date", ["revenue", "orders"], whole_numbers=["orders"]), ["revenue"])


@query("W13_tail_mean", """SELECT product_id, avg(quantity) AS moving_average FROM (SELECT * FROM s_units QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY date DESC) <= 7) GROUP BY 1""")
def _(t):
    return ordered.tail_mean(units(t), "quantity", "date", 7, ["product_id"])


@query("W15_last_orders", """SELECT user_id, id, created_at FROM r_orders QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) <= 3""")
def _(t):
    return ordered.last_n(t.orders.select("user_id", "id", "created_at"), ["user_id"], ["created_at", "id"], 3)


@query("W16_demand_spikes", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY date DESC) AS rn FROM s_units),
    g AS (SELECT product_id, count(*) AS n, avg(quantity) AS a, sum(quantity) FILTER (rn <= 7) / 7 AS r FROM r GROUP BY 1)
    SELECT 'demand_spike' AS type, g.product_id, name, stock AS current_stock, round(r, 2) AS recent_avg_daily_sales, round(a, 2) AS overall_avg_daily_sales, 'high' AS severity
    FROM g JOIN r_products p ON g.product_id = p.id WHERE n >= 7 AND r > a * 1.2 AND stock < r * 7""")
def _(t):
    return inventory.demand_spikes(t.products, units(t), ratio_limit=1.2)


@query("W17_expanding_folds", """WITH s AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS rn, count(*) OVER () AS n FROM s_series), f AS (SELECT s.*, k AS fold, floor(n / 6) AS size
    FROM s, range(5) r(k) WHERE n >= 10) SELECT date, revenue, orders, fold::int AS fold, CASE WHEN rn < size * (fold + 1) THEN 'train' ELSE 'test' END AS role
    FROM f WHERE rn < size * (fold + 2)""")
def _(t):
    return ordered.expanding_folds(series(t), "date")


def forecast_ctes(p, source, keys, value):
    """SQL blocks for the forecasts of ``source``: params, weekday index, forecasts, fits and metrics."""
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    lead = "".join(f"{k}, " for k in keys)
    by = f"GROUP BY {', '.join(keys)}" if keys else ""
    on = lambda a, b: " AND ".join([f"{a}.{k} = {b}.{k}" for k in keys] or ["true"])
    add_cte(f"{p}_rows", f"SELECT {lead}date, {value}::double AS y, (row_number() OVER w - 1)::double AS t, lag({value}) OVER w::double AS y1 FROM {source} WINDOW w AS ({part} ORDER BY date)")
    add_cte(f"{p}_par0", f"""SELECT {lead}count(*) AS n, avg(y) AS mean, stddev_pop(y) AS std, coalesce(CASE WHEN count(*) >= 3 THEN regr_slope(y, t) END, 0) AS slope,
        coalesce(CASE WHEN count(*) >= 3 AND var_pop(y1) > 0 THEN regr_slope(y, y1) END, 0) AS phi, regr_intercept(y, y1) AS c0, max(date) AS last_date, arg_max(y, date) AS last_y FROM {p}_rows {by}""")
    add_cte(f"{p}_par", f"SELECT *, CASE WHEN phi = 0 THEN mean ELSE c0 END AS c FROM {p}_par0")
    add_cte(f"{p}_idx", f"""SELECT {lead}weekday, s / n / (sum(s) OVER ({part}) / sum(n) OVER ({part})) AS idx FROM (SELECT {lead}isodow(date) - 1 AS weekday, sum({value}::double) AS s,
        count(*) AS n FROM {source} GROUP BY {lead}isodow(date))""")
    add_cte(f"{p}_steps", f"SELECT *, last_date + step::int AS fdate FROM {p}_par, (SELECT unnest(range(1, 31)) AS step) WHERE n >= 7 AND mean <> 0")
    add_cte(f"{p}_raw", f"""SELECT s.*, mean + slope * step AS trend, (mean + slope * ((n - 1) / 2 + step)) * coalesce(idx, 1) AS seasonal,
        CASE WHEN abs(phi) < 1 THEN c / (1 - phi) + pow(phi, step) * (last_y - c / (1 - phi)) ELSE last_y END AS ar
        FROM {p}_steps s LEFT JOIN {p}_idx i ON {on('s', 'i')} AND i.weekday = isodow(s.fdate) - 1""")
    add_cte(f"{p}_long", " UNION ALL ".join(f"SELECT {lead}'{m}' AS model, step, fdate AS date, std, greatest(0, {c}) AS yhat FROM {p}_raw" for m, c in (("trend", "trend"), ("seasonal", "seasonal"), ("autoregressive", "ar"))))
    add_cte(f"{p}_fc", f"SELECT {lead}model, step::int AS step, date, yhat, greatest(0, yhat - std * 1.96) AS yhat_lower, yhat + std * 1.96 AS yhat_upper FROM {p}_long")
    add_cte(f"{p}_fit0", f"""SELECT r.*, mean + slope * (t - (n - 1) / 2) AS trend, (mean + slope * (t - (n - 1) / 2)) * coalesce(idx, 1) AS seasonal, c + phi * y1 AS ar
        FROM {p}_rows r JOIN {p}_par p ON {on('r', 'p')} LEFT JOIN {p}_idx i ON {on('r', 'i')} AND i.weekday = isodow(r.date) - 1""")
    add_cte(f"{p}_fit", " UNION ALL ".join(f"SELECT {lead}date, '{m}' AS model, {c} AS fitted, y AS actual FROM {p}_fit0 WHERE {c} IS NOT NULL" for m, c in (("trend", "trend"), ("seasonal", "seasonal"), ("autoregressive", "ar"))))
    add_cte(f"{p}_met", f"""SELECT {lead}model, avg(abs(actual - fitted)) AS mae, sqrt(avg((actual - fitted) ** 2)) AS rmse, avg(abs((actual - fitted) / (actual + 1e-10))) * 100 AS mape,
        coalesce(1 - sum((actual - fitted) ** 2) / nullif(var_pop(actual) * count(*), 0), 0) AS r2 FROM {p}_fit GROUP BY {lead}model""")
    add_cte(f"{p}_cmp0", f"""SELECT f.*, m.* EXCLUDE ({lead}model), round((mae / 10000 + rmse / 10000 + mape / 100 + (1 - r2)) / 4, 4) AS score FROM (SELECT {lead}model, avg(yhat) AS avg_forecast,
        var_pop(yhat) AS variance FROM {p}_fc GROUP BY {lead}model) f JOIN {p}_met m ON {on('f', 'm')} AND f.model = m.model""")
    add_cte(f"{p}_cmp", f"SELECT *, arg_min(model, (score, model)) OVER ({part}) AS best_model FROM {p}_cmp0")


forecast_ctes("s_fs", "s_series", [], "revenue")
forecast_ctes("s_fp", "s_units", ["product_id"], "quantity")
BAND = ["yhat", "yhat_lower", "yhat_upper"]


@query("P01_trend_forecast", f"SELECT step, date, {rsql(BAND)}, model FROM s_fs_fc WHERE model = 'trend'")
def _(t):
    return rnd(forecast.trend_forecast(series(t), []), BAND)


@query("P02_series_forecast", f"SELECT model, step, date, {rsql(BAND)} FROM s_fs_fc")
def _(t):
    return rnd(forecast.all_forecasts(series(t), []), BAND)


# Units are whole numbers, so forecasts can fall exactly between two roundings. A small shift before rounding keeps both engines on one side.
SHIFT = 0.0000037


@query("P02_product_forecast", "SELECT product_id, model, step, date, " + ", ".join(f"round({c} + {SHIFT}, 4) AS {c}" for c in BAND) + " FROM s_fp_fc")
def _(t):
    out = forecast.all_forecasts(units(t), ["product_id"], value="quantity")
    return out.withColumns({c: F.round(F.col(c) + SHIFT, 4) for c in BAND})


ERR = ["mae", "rmse", "mape", "r2"]


@query("P03_forecast_metrics", f"SELECT product_id, model, {rsql(ERR, 6)} FROM s_fp_met")
def _(t):
    s = units(t)
    joined = forecast.join_actuals(forecast.fitted_values(s, ["product_id"], "quantity"), s, ["product_id"], "quantity")
    return rnd(forecast.forecast_metrics(joined, ["product_id"]), ERR, 6)


@query("J20_join_actuals", "SELECT date, model, round(fitted, 3) AS fitted, actual FROM s_fs_fit")
def _(t):
    s = series(t)
    return rnd(forecast.join_actuals(forecast.fitted_values(s, []), s, []), ["fitted"])


COMPARE = ["avg_forecast", "variance", *ERR, "score"]


@query("P04_compare_models", f"SELECT model, {rsql(COMPARE)}, best_model FROM s_fs_cmp")
def _(t):
    return rnd(forecast.forecast_bundle(series(t), [])["comparison"], COMPARE)


@query("P05_forecast_bundle", "SELECT product_id, count(*) AS models, min(best_model) AS best_model FROM s_fp_cmp GROUP BY 1")
def _(t):
    parts = forecast.forecast_bundle(units(t), ["product_id"], value="quantity")
    return parts["comparison"].groupBy("product_id").agg(F.count(F.lit(1)).alias("models"), F.min("best_model").alias("best_model"))


@query("P05_seasonal_part", """WITH m AS (SELECT product_id, year(date) AS y, month(date)::int AS month, sum(quantity)::double AS total FROM s_units GROUP BY 1, 2, 3),
    a AS (SELECT product_id, month, count(*) AS years, round(avg(total), 6)::decimal(28,6) AS t FROM m GROUP BY 1, 2),
    l AS (SELECT *, t::double / (sum(t) OVER w::double / count(*) OVER w) AS v FROM a WINDOW w AS (PARTITION BY product_id))
    SELECT product_id, month, years, t::double AS total, round(v, 6) AS level, CASE WHEN v > 1.2 THEN 'peak' WHEN v < 0.8 THEN 'low' END AS type FROM l""")
def _(t):
    part = forecast.forecast_bundle(units(t), ["product_id"], value="quantity")["seasonal"]
    return part.withColumns({"total": F.round("total", 6), "level": F.round("level", 6)})


@query("P06_best_forecast", f"""SELECT f.model, step, date, {rsql(BAND)}, CASE WHEN slope > 0.01 THEN 'upward' WHEN slope < -0.01 THEN 'downward' ELSE 'stable' END AS trend,
    CASE WHEN r2 <> 0 THEN greatest(0, least(100, trunc(r2 * 100)))::int ELSE 85 END AS confidence, round(avg(yhat_lower) OVER (), 3) AS lower_bound,
    round(avg(yhat_upper) OVER (), 3) AS upper_bound FROM s_fs_fc f JOIN s_fs_cmp c ON f.model = c.model AND c.model = c.best_model, s_fs_par""")
def _(t):
    return rnd(forecast.best_forecast(series(t), []), [*BAND, "lower_bound", "upper_bound"])


@query("P07_run_rate", """SELECT round(v * 30, 2) AS predicted_revenue, round(v, 2) AS avg_daily_revenue, 30 AS prediction_days FROM (SELECT coalesce(msum(total_amount), 0) / 30 AS v
    FROM r_orders WHERE status IN ('Delivered', 'Shipped') AND created_at >= AS_OF - INTERVAL 30 DAY)""")
def _(t):
    return inventory.run_rate_prediction(t.orders, t.as_of)


@query("P08_ma_projection", """SELECT s::int AS step, round(m * (1 + (s % 5 - 2) * 0.025::double), 2) AS projection FROM (SELECT avg(revenue) AS m FROM (SELECT * FROM s_series ORDER BY date DESC LIMIT 7)),
    (SELECT unnest(range(1, 15)) AS s)""")
def _(t):
    return forecast.ma_projection(series(t))


@query("P09_min_max", """SELECT product_id, date, quantity, coalesce((quantity - min(quantity) OVER w) / nullif(max(quantity) OVER w - min(quantity) OVER w, 0), 0.0) AS quantity_scaled
    FROM s_units WINDOW w AS (PARTITION BY product_id)""")
def _(t):
    return ordered.min_max_scaled(units(t), "quantity", ["product_id"])


@query("P10_sequences", """SELECT product_id, date, target, seq AS sequence FROM (SELECT product_id, date, quantity AS target, array_to_string(list(quantity) OVER w, ',') AS seq, count(*) OVER w AS n
    FROM s_units WINDOW w AS (PARTITION BY product_id ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) WHERE n = 5""")
def _(t):
    return ordered.look_back_sequences(units(t), "quantity", "date", 5, ["product_id"]).withColumn("sequence", F.array_join(F.col("sequence").cast("array<string>"), ","))


@query("W21_week_buckets", """SELECT least((step - 1) // 7 + 1, 4)::bigint AS week, round(sum(yhat), 2) AS forecast, round(sum(yhat_lower), 2) AS lower, round(sum(yhat_upper), 2) AS upper
    FROM s_fs_fc WHERE model = 'trend' GROUP BY 1""")
def _(t):
    return rnd(kpis.week_buckets(forecast.trend_forecast(series(t), [])), ["forecast", "lower", "upper"], 2)
