"""Building blocks of the DuckDB statements the queries are compared with."""

from __future__ import annotations

PRICES = """prices AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE)
           / (count(*) * 100.0::DOUBLE) AS close,
         sum(l_quantity) AS volume
  FROM lineitem WHERE isodow(l_shipdate) < 6 GROUP BY 1, 2)"""

BRANDS = """brand_prices AS (
  SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE)
           / (count(*) * 100.0::DOUBLE) AS close
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE isodow(l_shipdate) < 6 GROUP BY 1, 2)"""


def _mean(column: str, condition: str = "TRUE") -> str:
    return (
        f"CAST(sum(CAST(round({column} * 100) AS BIGINT)) FILTER (WHERE {condition}) AS DOUBLE)"
        f" / nullif(count(*) FILTER (WHERE {condition}) * 100.0::DOUBLE, 0)"
    )


MARKET = f"""market AS (
  SELECT 'MKT' AS symbol, CAST(l_shipdate AS DATE) AS date,
         {_mean("l_extendedprice")} AS spy,
         {_mean("l_extendedprice", "l_returnflag = 'A'")} AS hyg,
         {_mean("l_extendedprice", "l_returnflag = 'N'")} AS shy,
         ln({_mean("l_extendedprice", "l_returnflag = 'R'")}) AS dxy,
         {_mean("l_extendedprice", "l_linestatus = 'O'")} AS oil,
         1000::DOUBLE * ({_mean("l_discount")}) AS vix,
         CAST(sum(CAST(round(l_tax * 100) AS BIGINT))
              - sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE)
           / CAST(count(*) AS DOUBLE) AS t10y2y,
         CAST(count(*) FILTER (WHERE l_linestatus = 'O') AS DOUBLE)
           / nullif(CAST(count(*) FILTER (WHERE l_linestatus = 'F') AS DOUBLE), 0) AS cpc
  FROM lineitem WHERE isodow(l_shipdate) < 6 GROUP BY 2)"""

CALENDAR = """calendar AS (
  SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE isodow(o_orderdate) < 6)"""

MACRO = f"""macro AS (
  SELECT 'PMI' AS symbol, CAST(min(o_orderdate) AS DATE) AS date,
         {_mean("o_totalprice")} AS value
  FROM orders GROUP BY date_trunc('month', o_orderdate))"""

RAW_LONG = PRICES + """, raw_long AS (
  SELECT symbol || '_close' AS symbol, date, close AS value FROM prices
  UNION ALL SELECT symbol || '_volume', date, volume FROM prices)"""

FORECASTS = PRICES + """, levels AS (
  SELECT *, CASE WHEN row_number() OVER w >= 63 THEN avg(close) OVER w63 END AS level,
         CASE WHEN row_number() OVER w >= 50 THEN avg(close) OVER w50 END AS sma50
  FROM prices
  WINDOW w AS (PARTITION BY symbol ORDER BY date),
         w63 AS (PARTITION BY symbol ORDER BY date ROWS 62 PRECEDING),
         w50 AS (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING)),
forecasts AS (
  SELECT symbol, date, CAST(year(date) AS INTEGER) AS fold_id, y_true, y_pred, ret, f1, f2, regime
  FROM (SELECT symbol, date,
               lead(level, 21) OVER w / level - 1 AS y_true,
               level / lag(level, 21) OVER w - 1 AS y_pred,
               level / lag(level, 1) OVER w - 1 AS ret,
               close / level - 1 AS f1, volume / 25.0::DOUBLE - 1 AS f2,
               CASE WHEN close > sma50 THEN 1 ELSE 0 END AS regime
        FROM levels WINDOW w AS (PARTITION BY symbol ORDER BY date))
  WHERE y_true IS NOT NULL AND y_pred IS NOT NULL)"""

RUNS = FORECASTS + """, runs AS (
  SELECT 'run_' || fold_id AS run_id, max(date) AS created_at, 'Ridge' AS model
  FROM forecasts GROUP BY fold_id)"""

ARRIVALS = """arrivals AS (
  SELECT CAST(o_custkey % 10 AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS date,
         o_orderkey AS ingest_seq, o_totalprice AS value FROM orders)"""

#: usual windows; WHERE the frames are longer than a series the gate gives null
W = "w AS (PARTITION BY symbol ORDER BY date)"


def frame(n: int, name: str | None = None, by: str = "symbol", order: str = "date") -> str:
    name = name or f"w{n}"
    return f"{name} AS (PARTITION BY {by} ORDER BY {order} ROWS {n - 1} PRECEDING)"


def gated(agg: str, column: str, n: int, min_periods: int | None = None, w: str | None = None) -> str:
    w = w or f"w{n}"
    return (
        f"CASE WHEN count({column}) OVER {w} >= {min_periods or n} "
        f"THEN {agg}({column}) OVER {w} END"
    )


def rounded(sql: str, keys: str, values: str, digits: int = 6, with_: str = "") -> str:
    """Outer select: keys as they are, values rounded, tiny values as zero."""
    half = 0.5 * 10.0 ** -digits
    cols = [k.strip() for k in keys.split(",") if k.strip()]
    cols += [
        f"CASE WHEN abs({v}) < {half:.12f} THEN 0.0::DOUBLE "
        f"ELSE round(CAST({v} AS DOUBLE), {digits}) END AS {v}"
        for v in (x.strip() for x in values.split(",")) if v
    ]
    return f"{'WITH ' + with_ if with_ else ''} SELECT {', '.join(cols)} FROM ({sql}) AS final_rows"


def spearman_cte(source: str, keys: str, out: str, x: str = "y_true", y: str = "y_pred") -> str:
    """CTE `out(keys, n, ic)`."""
    def rank(c: str) -> str:
        return (f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) + "
                f"(count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2.0")

    return f"""{out} AS (
  SELECT {keys}, count(*) AS n, CASE WHEN isfinite(corr(rx, ry)) THEN corr(rx, ry) ELSE 0.0 END AS ic
  FROM (SELECT {keys}, {rank(x)} AS rx, {rank(y)} AS ry FROM {source}
        WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY {keys})"""


def quantile_cte(source: str, keys: str, out: str) -> str:
    """CTEs ending in `out(keys, spread, tstat, ..., monotonicity)`."""
    def edges(k: int) -> str:
        # evenly spaced as j * (1 / k), the way numeric libraries space them
        return "quantile_cont(y_pred, [" + ", ".join(f"{j} * (1 / {k}.0::DOUBLE)" for j in range(k + 1)) + "])"

    on = " AND ".join(f"s.{k.strip()} = q.{k.strip()}" for k in keys.split(","))
    skeys = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    return f"""{out}_q AS (
  SELECT {keys}, count(*) AS total, CASE WHEN count(*) >= 20 THEN {edges(10)} WHEN count(*) >= 10 THEN {edges(5)}
         ELSE {edges(2)} END AS edges FROM {source} GROUP BY {keys}),
{out}_b AS (
  SELECT {skeys}, total, greatest(len(list_filter(list_distinct(edges), lambda e: e < y_pred)) - 1, 0) AS bin, y_true
  FROM {source} s JOIN {out}_q q ON {on}),
{out}_g AS (
  SELECT {keys}, bin, max(total) AS total, count(*) AS c, avg(y_true) AS m, var_samp(y_true) AS v
  FROM {out}_b GROUP BY {keys}, bin),
{out}_l AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY bin) - 1 AS label, count(*) OVER (PARTITION BY {keys}) AS k,
         rank() OVER (PARTITION BY {keys} ORDER BY m) AS r FROM {out}_g),
{out}_t AS (
  SELECT {keys}, max(total) AS total, max(k) AS k, max(m) FILTER (label = k - 1) AS m1, max(m) FILTER (label = 0) AS m2,
         max(c) FILTER (label = k - 1) AS n1, max(c) FILTER (label = 0) AS n2,
         max(v) FILTER (label = k - 1) AS v1, max(v) FILTER (label = 0) AS v2, corr(label, r) AS mono
  FROM {out}_l GROUP BY {keys}),
{out} AS (
  SELECT {keys}, CASE WHEN total < 4 THEN 0 ELSE m1 - m2 END AS spread,
    CASE WHEN total < 4 OR n1 < 2 OR n2 < 2 THEN 0 ELSE coalesce((m1 - m2) / nullif(sqrt(
      ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 0), 0) END AS tstat,
    CASE WHEN total < 4 THEN 0 ELSE m1 END AS top_mean, CASE WHEN total < 4 THEN 0 ELSE m2 END AS bottom_mean,
    CASE WHEN total < 4 THEN 0 ELSE n1 END AS top_count, CASE WHEN total < 4 THEN 0 ELSE n2 END AS bottom_count,
    CASE WHEN total < 4 OR k < 2 THEN 0 WHEN k >= 3 THEN CASE WHEN isfinite(mono) THEN mono ELSE 0 END
         WHEN m1 > m2 THEN 1 ELSE -1 END AS monotonicity
  FROM {out}_t)"""


HIT = ("coalesce(avg(CASE WHEN y_true = 0 THEN NULL WHEN sign(y_true) = sign(y_pred) THEN 1.0 ELSE 0.0 END), 0.0)")


def tail_select(t: float) -> str:
    def ratio(a: str, b: str) -> str:
        return f"coalesce(count(*) FILTER ({a} AND {b}) / nullif(CAST(count(*) FILTER ({b}) AS DOUBLE), 0), 0.0)"

    au, ad, pu, pd = f"y_true > {t}", f"y_true < -{t}", f"y_pred > {t}", f"y_pred < -{t}"
    return (f"{ratio(au, pu)} AS precision_up, {ratio(ad, pd)} AS precision_down, {ratio(pu, au)} AS recall_up, "
            f"{ratio(pd, ad)} AS recall_down, count(*) FILTER ({au}) AS actual_up, count(*) FILTER ({ad}) AS actual_down, "
            f"count(*) FILTER ({pu}) AS pred_up, count(*) FILTER ({pd}) AS pred_down")


POINT = ("count(*) AS n, sqrt(avg((y_true - y_pred) ** 2)) AS rmse, avg(abs(y_true - y_pred)) AS mae, "
         "100.0 * avg(CASE WHEN sign(y_true) = sign(y_pred) THEN 1.0 ELSE 0.0 END) AS dir_acc")


def curve_cte(source: str, keys: str, out: str, r: str) -> str:
    """CTE `out`: source rows with equity, peak and drawdown."""
    w = f"OVER (PARTITION BY {keys} ORDER BY date ROWS UNBOUNDED PRECEDING)"
    return f"""{out} AS (
  SELECT *, equity / peak - 1 AS drawdown FROM (
    SELECT *, max(equity) {w} AS peak FROM (SELECT *, product(1 + {r}) {w} AS equity FROM {source})))"""


def policy_cte(source: str, keys: str, out: str, ann: int = 252) -> str:
    """CTEs ending in `out`: policy statistics of rows with y_true, y_pred,
    position and strategy_return."""
    return f"""{out}_act AS (SELECT * FROM {source} WHERE position <> 0),
{spearman_cte(out + "_act", keys, out + "_ic")},
{quantile_cte(out + "_act", keys, out + "_sp")},
{curve_cte(source, keys, out + "_c", "strategy_return")},
{out}_s AS (
  SELECT {keys}, count(*) AS n_periods, count(*) FILTER (position <> 0) AS trade_count,
    arg_max(equity, date) - 1 AS total_return, avg(strategy_return) * {ann} AS ann_return,
    stddev_pop(strategy_return) * sqrt({ann}) AS ann_volatility, min(drawdown) AS max_drawdown,
    CASE WHEN stddev_pop(strategy_return) FILTER (position <> 0) = 0 THEN 0 ELSE
      avg(strategy_return) FILTER (position <> 0) / stddev_pop(strategy_return) FILTER (position <> 0) * sqrt({ann}) END AS sharpe,
    avg(CASE WHEN sign(position) = sign(y_true) THEN 1.0 ELSE 0.0 END) FILTER (position <> 0) AS hit_rate,
    avg(CASE WHEN strategy_return > 0 THEN 1.0 ELSE 0.0 END) FILTER (position <> 0) AS win_rate,
    avg(strategy_return) FILTER (position <> 0) AS avg_return_per_trade,
    count(*) FILTER (position <> 0) / count(*)::DOUBLE AS holding_frequency
  FROM {out}_c GROUP BY {keys}),
{out} AS (SELECT * FROM {out}_s LEFT JOIN (SELECT * EXCLUDE (n) FROM {out}_ic) USING ({keys})
  LEFT JOIN (SELECT {keys}, spread FROM {out}_sp) USING ({keys}))"""


POLICY_COUNTS = "n_periods, trade_count"
POLICY_VALUES = ("total_return, ann_return, ann_volatility, max_drawdown, sharpe, hit_rate, win_rate, "
                 "avg_return_per_trade, holding_frequency, ic, spread")


def position_sql(policy: str, p: str = "y_pred", t: str = "0.03", scale: str = "1") -> str:
    return {
        "long_flat": f"CASE WHEN {p} > 0 THEN 1.0::DOUBLE ELSE 0.0 END",
        "long_short": f"CAST(sign({p}) AS DOUBLE)",
        "thresholded": f"CASE WHEN {p} > {t} THEN 1.0::DOUBLE WHEN {p} < -({t}) THEN -1.0 ELSE 0.0 END",
        "continuous_sizing": f"least(greatest({p} / ({scale}), -1.0::DOUBLE), 1.0)",
    }[policy]


def risk_cte(source: str, keys: str, out: str, r: str = "pnl") -> str:
    """CTEs ending in `out`: the risk report of a daily return series."""
    w = f"OVER (PARTITION BY {keys} ORDER BY date ROWS UNBOUNDED PRECEDING)"
    return f"""{curve_cte(source, keys, out + "_c", r)},
{out}_i AS (SELECT *, sum(CASE WHEN drawdown < 0 THEN 0 ELSE 1 END) {w} AS island FROM {out}_c),
{out}_d AS (SELECT {keys}, max(length) AS dd_duration FROM (
  SELECT {keys}, island, count(*) FILTER (drawdown < 0) AS length FROM {out}_i GROUP BY {keys}, island) GROUP BY {keys}),
{out}_m AS (
  SELECT {keys}, arg_max(equity, date) - 1 AS total_return, avg({r}) * 252 AS ann_return,
    arg_max(equity, date) ** (252.0 / count(*)) - 1 AS cagr,
    stddev_samp({r}) * sqrt(252) AS volatility, min(drawdown) AS max_drawdown,
    avg(CASE WHEN {r} > 0 THEN 1.0 ELSE 0.0 END) AS win_rate,
    coalesce(sum({r}) FILTER ({r} > 0) / nullif(abs(sum({r}) FILTER ({r} < 0)), 0), 0) AS profit_factor,
    sqrt(avg({r} * {r}) FILTER ({r} < 0)) * sqrt(252) AS down
  FROM {out}_c GROUP BY {keys}),
{out} AS (
  SELECT * EXCLUDE (down), coalesce(ann_return / nullif(volatility, 0), 0) AS sharpe, ann_return / nullif(down, 0) AS sortino,
    coalesce(ann_return / nullif(abs(max_drawdown), 0), 0) AS calmar
  FROM {out}_m JOIN {out}_d USING ({keys}))"""


RISK_VALUES = "total_return, ann_return, cagr, volatility, sharpe, sortino, calmar, max_drawdown, win_rate, profit_factor"
