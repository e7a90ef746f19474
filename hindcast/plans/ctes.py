"""The adapters' tables as DuckDB common table expressions, for the oracle SQL."""

_WALK = """
{p}_r AS (SELECT *, (d - 0.05) * 0.4 AS ret FROM {p}_s),
{p}_c AS (SELECT *, 100 * exp(sum(ret) OVER (PARTITION BY symbol ORDER BY session_date ROWS UNBOUNDED PRECEDING)) AS close FROM {p}_r),
{p} AS (SELECT symbol, session_date, close * exp(-0.5 * ret) AS open, close * exp(abs(ret) + 0.1 * t) AS high, close * exp(-abs(ret) - 0.1 * t) AS low, close, volume,
  row_number() OVER (PARTITION BY symbol ORDER BY session_date) - 1 AS pos FROM {p}_c)"""

BARS = """bars_s AS (SELECT p_type AS symbol, CAST(l_shipdate AS DATE) AS session_date, avg(l_discount) AS d, avg(l_tax) AS t, sum(l_quantity) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE dayofweek(l_shipdate) BETWEEN 1 AND 5 GROUP BY 1, 2),""" + _WALK.format(p="bars")

PART_BARS = """part_bars_s AS (SELECT 'P' || lpad(CAST((l_partkey - 1) // 200 AS VARCHAR), 7, '0') AS symbol, CAST(l_shipdate AS DATE) AS session_date, avg(l_discount) AS d, avg(l_tax) AS t, sum(l_quantity) AS volume
  FROM lineitem WHERE ((l_partkey - 1) // 200) % 7 = 0 OR dayofweek(l_shipdate) BETWEEN 1 AND 5 GROUP BY 1, 2),""" + _WALK.format(p="part_bars")

RAW = """raw AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session_date) - 1 AS pos FROM (
  SELECT p_type AS symbol, CAST(l_shipdate AS DATE) AS session_date,
    arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) AS open,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) AS close, sum(l_quantity) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE dayofweek(l_shipdate) BETWEEN 1 AND 5 GROUP BY 1, 2))"""

WIDE = """wide_s AS (SELECT p_brand || '-' || l_returnflag AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS session_date, avg(l_discount) AS d, avg(l_tax) AS t, sum(l_quantity) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),""" + _WALK.format(p="wide")

CONTEXT = "context AS (SELECT session_date, avg(close) AS market, 100 * avg(high / low - 1) AS vix FROM bars GROUP BY 1)"

HASH = "('0x' || substr(md5({0}), 1, 8))::BIGINT"

LEDGER = """ledger_m AS (SELECT symbol, session_date AS as_of_date, pos AS signal_pos, ('0x' || substr(md5(symbol || '-' || CAST(session_date AS VARCHAR)), 1, 8))::BIGINT AS id FROM bars WHERE pos % 5 = 0),
ledger AS (SELECT *, 21 AS horizon_days, as_of_date + 30 AS horizon_date, CAST(35 + id % 31 AS DOUBLE) AS probability_up, CAST(47 + id % 7 AS DOUBLE) AS baseline_up_rate,
  CASE WHEN (35 + id % 31) - (47 + id % 7) >= 4 THEN 'long' WHEN (35 + id % 31) - (47 + id % 7) <= -4 THEN 'short' END AS side,
  CASE id % 3 WHEN 0 THEN 'strong' WHEN 1 THEN 'moderate' ELSE 'speculative' END AS tier,
  CASE WHEN id % 10 = 0 THEN NULL ELSE id % 10 >= 3 END AS eligible,
  CASE WHEN id % 4 <> 0 THEN (35 + id % 31) * 0.5 + 25 END AS calibrated_probability_up,
  CASE WHEN id % 11 <> 0 THEN 'v' || (id % 2) END AS model_version, 1 AS universe_id,
  CAST(as_of_date AS TIMESTAMP) + INTERVAL 17 HOUR AS created_at FROM ledger_m)"""

#: Forecasts graded by position: entry at the next open, outcome at the close of session +h.
GRADED = """graded AS (SELECT l.*, e.session_date AS entry_date, o.session_date AS outcome_date, e.open AS entry_price, o.close AS outcome_price,
  (o.close / e.open - 1) * 100 AS realized_return, CASE WHEN o.close IS NULL THEN 'pending' ELSE 'graded' END AS status
  FROM ledger l LEFT JOIN bars e ON e.symbol = l.symbol AND e.pos = l.signal_pos + 1 LEFT JOIN bars o ON o.symbol = l.symbol AND o.pos = l.signal_pos + l.horizon_days)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
