"""Shared common table expressions for the check SQL (DuckDB)."""

from __future__ import annotations

ORDER = "row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"

_BAR = f"""arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, sum(q) AS volume"""

TICKS = f"""ticks AS (
  SELECT 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS p,
         l_quantity AS q, {ORDER} AS k, l_partkey
  FROM lineitem)"""

# ticker, date, open, high, low, close, volume
BARS = f"""{TICKS}, bars AS (
  SELECT ticker, date, {_BAR} FROM ticks GROUP BY ticker, date)"""

BRAND = f"""{TICKS}, brand AS (
  SELECT p_brand AS ticker, date, {_BAR} FROM ticks JOIN part ON l_partkey = p_partkey GROUP BY p_brand, date)"""

# numbered rows: t from 0
NUM = BARS + """, num AS (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS t FROM bars)"""

W = "WINDOW w AS (PARTITION BY ticker ORDER BY date)"


def win(n: int, key: str = "ticker", order: str = "date") -> str:
    return f"OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def run(key: str = "ticker", order: str = "date") -> str:
    return f"OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def lag(c: str, n: int = 1, key: str = "ticker", order: str = "date") -> str:
    return f"lag({c}, {n}) OVER (PARTITION BY {key} ORDER BY {order})"


def sma(c: str, n: int, key: str = "ticker", order: str = "date") -> str:
    least = max(1, n // 2)
    return (
        f"CASE WHEN count({c}) {win(n, key, order)} >= {least} THEN avg({c}) {win(n, key, order)} "
        f"ELSE avg({c}) {run(key, order)} END"
    )


def std0(c: str, n: int, key: str = "ticker", order: str = "date") -> str:
    return f"coalesce(stddev_samp({c}) {win(n, key, order)}, 0.0)"


def pct(c: str, n: int, key: str = "ticker", order: str = "date") -> str:
    return f"({c} / nullif({lag(c, n, key, order)}, 0) - 1)"


EVENT_BARS = """mbars AS (
  SELECT event_type AS ticker, date_trunc('{unit}', ts) AS ts, CAST(ts AS DATE) AS date,
         arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2, 3)"""


def event_bars(unit: str = "minute") -> str:
    return EVENT_BARS.format(unit=unit)


SECTORS = """sectors AS (
  SELECT 'S' || s_suppkey AS ticker, r_name AS sector
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

NEWS = """news AS (
  SELECT doc_id, 'S' || (doc_id % 100) AS ticker,
         CAST(DATE '1995-01-02' + CAST((doc_id * 7) % 2400 AS INTEGER) AS TIMESTAMP)
           + to_minutes(CAST((doc_id * 37) % 1440 AS INTEGER)) AS published_at,
         CAST(DATE '1995-01-02' + CAST((doc_id * 7) % 2400 AS INTEGER) AS DATE) AS date,
         regexp_extract(text, '^([^\\n]*)', 1) AS title, text AS body, concat_ws('/', source, CAST(doc_id AS VARCHAR)) AS url, source
  FROM documents)"""

VECTORS = """vectors AS (
  SELECT vec_id, 'S' || label AS ticker,
         CAST(DATE '1995-01-02' + CAST((vec_id * 7) % 2400 AS INTEGER) AS TIMESTAMP)
           + to_minutes(CAST((vec_id * 37) % 1440 AS INTEGER)) AS published_at,
         CAST(DATE '1995-01-02' + CAST((vec_id * 7) % 2400 AS INTEGER) AS DATE) AS date,
         exp(CAST(embedding[1] AS DOUBLE)) / z AS pos, exp(CAST(embedding[2] AS DOUBLE)) / z AS neg,
         exp(CAST(embedding[3] AS DOUBLE)) / z AS neu, CAST((vec_id * 131) % 5000 + 20 AS DOUBLE) AS art_len, embedding
  FROM (SELECT *, exp(CAST(embedding[1] AS DOUBLE)) + exp(CAST(embedding[2] AS DOUBLE)) + exp(CAST(embedding[3] AS DOUBLE)) AS z
        FROM embeddings))"""


def seeded_sql(seed: int, *cols: str) -> str:
    """The draw of a row: the first 15 hex digits of the md5 of its columns and the seed."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(f'CAST({c} AS VARCHAR)' for c in cols)}, '{seed}')), 1, 15) AS BIGINT)"
