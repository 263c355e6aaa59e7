"""SQL of the derived tables, as leading common table expressions of the queries' DuckDB SQL."""

from __future__ import annotations

TRADES = """li AS (SELECT n_name AS ticker, r_name AS sector, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS p, l_extendedprice AS x,
  l_quantity AS q, l_orderkey, l_linenumber, l_suppkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_OHLC = """round(struct_extract(min({'a': l_orderkey, 'b': l_linenumber, 'p': p}), 'p'), 6) AS open, round(max(p), 6) AS high, round(min(p), 6) AS low,
  round(sum(x::DECIMAL(18, 2))::DOUBLE / sum(q), 6) AS close, sum(q) AS volume"""
BARS = f"WITH {TRADES}, b AS (SELECT ticker, sector, date, {_OHLC} FROM li GROUP BY ticker, sector, date)"
WEEKLY = f"""WITH li AS (SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_extendedprice / l_quantity AS p,
  l_extendedprice AS x, l_quantity AS q, l_orderkey, l_linenumber FROM lineitem), b AS (SELECT ticker, date, {_OHLC} FROM li GROUP BY ticker, date)"""
MINUTES = """WITH b AS (SELECT event_type AS ticker, to_timestamp(floor(epoch(ts) / 900) * 900)::TIMESTAMP AS ts,
  struct_extract(min({'a': ts, 'b': event_id, 'v': value}), 'v') AS open, max(value) AS high, min(value) AS low,
  struct_extract(max({'a': ts, 'b': event_id, 'v': value}), 'v') AS close, CAST(count(*) AS DOUBLE) AS volume FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"""
FACTS = """WITH who AS (SELECT c_custkey, n_name AS ticker, n_nationkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey),
 sh AS (SELECT ticker, count(*) AS shares, round(sum(c_acctbal), 2) AS equity FROM who GROUP BY ticker),
 f AS (SELECT q.ticker, q."end", CAST(q."end" + CAST(30 + n_nationkey AS INTEGER) AS DATE) AS filed, revenue, net_income, equity, shares FROM (
   SELECT ticker, n_nationkey, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS "end", round(sum(o_totalprice), 2) AS revenue,
     round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0.0 END) - 0.3 * sum(o_totalprice), 4) AS net_income
   FROM orders JOIN who ON o_custkey = c_custkey GROUP BY 1, 2, 3) q JOIN sh ON q.ticker = sh.ticker)"""
COMPANY = """co AS (SELECT n_name AS ticker, n_nationkey, CAST(o_orderdate AS DATE) AS od, o_totalprice::DECIMAL(18, 2) AS x, o_orderstatus AS st, left(o_orderpriority, 1) AS pr
   FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
 cf AS (SELECT ticker, "end", CAST("end" + CAST(30 + n_nationkey + CASE WHEN (year("end") * 4 + quarter("end")) % 5 = 0 THEN 200 ELSE 0 END AS INTEGER) AS DATE) AS filed, rev AS revenue,
   coalesce(f, 0.0::DOUBLE) - rev * 0.3::DOUBLE AS net_income, u * 0.4::DOUBLE AS operating_income, f * 0.25::DOUBLE AS operating_cash_flow, l * 0.1::DOUBLE AS capex FROM (
   SELECT ticker, n_nationkey, CAST(date_trunc('quarter', od) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS "end", sum(x)::DOUBLE AS rev, sum(CASE WHEN st = 'F' THEN x END)::DOUBLE AS f,
     sum(CASE WHEN pr IN ('1', '2') THEN x END)::DOUBLE AS u, sum(CASE WHEN pr = '5' THEN x END)::DOUBLE AS l FROM co GROUP BY 1, 2, 3)),
 cy AS (SELECT ticker, CAST(make_date(CAST(y + 1 AS INTEGER), 1, 1) + CAST(n_nationkey AS INTEGER) AS DATE) AS filed, shares, coalesce(m, 0.0::DOUBLE) * 0.5::DOUBLE - a * 0.09::DOUBLE AS equity FROM (
   SELECT ticker, n_nationkey, year(od) AS y, count(*) AS shares, sum(CASE WHEN pr = '3' THEN x END)::DOUBLE AS m, sum(x)::DOUBLE AS a FROM co GROUP BY 1, 2, 3))"""
STATEMENTS = """sy AS (SELECT n_name AS ticker, year(CAST(o_orderdate AS DATE)) AS year, o_totalprice::DECIMAL(18, 2) AS x, o_orderstatus AS st, left(o_orderpriority, 1) AS pr
   FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
 sx AS (SELECT ticker, year, sum(x)::DOUBLE AS revenue, sum(CASE WHEN st = 'F' THEN x END)::DOUBLE AS f, sum(CASE WHEN pr = '1' THEN x END)::DOUBLE AS p1, sum(CASE WHEN pr = '2' THEN x END)::DOUBLE AS p2,
   sum(CASE WHEN pr = '3' THEN x END)::DOUBLE AS p3, sum(CASE WHEN pr = '4' THEN x END)::DOUBLE AS p4, sum(CASE WHEN pr = '5' THEN x END)::DOUBLE AS p5, count(*) AS shares FROM sy GROUP BY 1, 2),
 st AS (SELECT ticker, year, revenue, f - revenue * 0.45::DOUBLE AS net_income, f * 0.25::DOUBLE AS cash_flow, p1 * 0.4::DOUBLE AS operating_income, p5 * 0.1::DOUBLE AS capex, p3 + p4 AS assets, p5 * 0.5::DOUBLE AS debt,
   p1 AS current_assets, p2 AS current_liabilities, p2 * 0.03::DOUBLE AS interest, p3 - p2 * 0.8::DOUBLE AS equity, shares FROM sx),
 yc AS (SELECT ticker, year(date) AS year, arg_max(close, date) AS close, min(low) AS low, max(high) AS high FROM b GROUP BY 1, 2)"""
O = "PARTITION BY ticker ORDER BY date"


def rows(n: int) -> str:
    """A trailing window of n rows."""
    return f"({O} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(n: int, value: str, over: int | None = None) -> str:
    """value over a trailing window, null until it has n rows."""
    w = rows(over or n)
    return f"CASE WHEN count(*) OVER {w} >= {n} THEN {value} OVER {w} END"
