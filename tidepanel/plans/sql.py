"""Common table expressions of the DuckDB equivalents."""

MONTHS = """
m AS (
  SELECT {key} AS ticker, last_day(l_shipdate::DATE) AS date, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT / 100.0::DOUBLE / sum(l_quantity::BIGINT)::BIGINT::DOUBLE AS close,
    sum(l_quantity::BIGINT)::BIGINT::DOUBLE AS volume, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT / 100.0::DOUBLE AS dv
  FROM lineitem GROUP BY 1, 2),
d AS (SELECT date, (row_number() OVER (ORDER BY date) - 1)::INT AS t FROM (SELECT DISTINCT date FROM m)),
p AS (SELECT t, date, ticker, close, volume, dv FROM d CROSS JOIN (SELECT DISTINCT ticker FROM m) LEFT JOIN m USING (date, ticker))"""
#: Suppliers by month, parts by month (sparse), suppliers' running price.
P1 = "WITH" + MONTHS.format(key="l_suppkey")
P2 = "WITH" + MONTHS.format(key="l_partkey")
P3 = (
    P1.replace("p AS (", "p0 AS (")
    + """,
p AS (
  SELECT t - 12 AS t, date, ticker, c AS close, volume, dv FROM (
    SELECT *, sum(dv) OVER w / sum(volume) OVER w AS c FROM p0 WINDOW w AS (PARTITION BY ticker ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  WHERE t >= 12)"""
)
#: Users by day: facts only.
P4 = """WITH e AS (
  SELECT user_id AS ticker, ts::DATE AS date, arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2)"""

#: Returns over gaps left open, and with prices carried forward.
RET_GAP = """,
r AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY t), 0) - 1 AS ret FROM p)"""
RET_PAD = """,
f AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS px FROM p),
r AS (SELECT * EXCLUDE (px), px / nullif(lag(px) OVER (PARTITION BY ticker ORDER BY t), 0) - 1 AS ret FROM f)"""
#: Padded returns, those above 3 dropped, winsorised.
RET_MODEL = (
    RET_PAD.replace("r AS (", "r0 AS (")
    + """,
r1 AS (SELECT * REPLACE (CASE WHEN ret <= 3.0 THEN ret END AS ret) FROM r0),
q AS (SELECT t, quantile_cont(ret, 0.01) AS lo, quantile_cont(ret, 0.99) AS hi FROM r1 GROUP BY t),
r AS (SELECT r1.* REPLACE (CASE WHEN ret IS NOT NULL THEN least(greatest(ret, lo), hi) END AS ret) FROM r1 JOIN q USING (t))"""
)
#: Raw features of every month.
FEATURES = """,
x0 AS (
  SELECT *, lag(ret) OVER w AS mom1,
    coalesce(product(1 + ret) OVER (w ROWS BETWEEN 3 PRECEDING AND 2 PRECEDING), 1) - 1 AS mom3,
    coalesce(product(1 + ret) OVER (w ROWS BETWEEN 6 PRECEDING AND 2 PRECEDING), 1) - 1 AS mom6,
    coalesce(product(1 + ret) OVER (w ROWS BETWEEN 9 PRECEDING AND 2 PRECEDING), 1) - 1 AS mom9,
    coalesce(product(1 + ret) OVER (w ROWS BETWEEN 12 PRECEDING AND 2 PRECEDING), 1) - 1 AS mom12,
    coalesce(product(1 + ret) OVER (w ROWS BETWEEN 18 PRECEDING AND 2 PRECEDING), 1) - 1 AS mom18,
    coalesce(product(1 + ret) OVER (w ROWS BETWEEN 6 PRECEDING AND 2 PRECEDING), 1) - coalesce(product(1 + ret) OVER (w ROWS BETWEEN 12 PRECEDING AND 7 PRECEDING), 1) AS accel,
    stddev_samp(ret) OVER (w ROWS BETWEEN 12 PRECEDING AND 2 PRECEDING) AS vol,
    sum(CASE WHEN ret > 0 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN 12 PRECEDING AND 2 PRECEDING)::DOUBLE / count(*) OVER (w ROWS BETWEEN 12 PRECEDING AND 2 PRECEDING) AS pos,
    lag(dv) OVER w AS size
  FROM r WINDOW w AS (PARTITION BY ticker ORDER BY t)),
x1 AS (
  SELECT *, (floor(coalesce(CASE WHEN size IS NOT NULL THEN
    ((rank() OVER (PARTITION BY t ORDER BY size ASC NULLS LAST)) + count(size) OVER (PARTITION BY t) - (rank() OVER (PARTITION BY t ORDER BY size DESC NULLS LAST)) + 1) / 2.0::DOUBLE
      / count(size) OVER (PARTITION BY t) END, 0.5) * 9.999::DOUBLE) + 1)::INT AS size_decile
  FROM x0)"""
RAW = ("mom1", "mom3", "mom6", "mom9", "mom12", "mom18", "accel", "vol", "pos")


def rounded(names, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def z_columns(names) -> str:
    return ", ".join(f"({n} - avg({n}) OVER (PARTITION BY t)) / (stddev_samp({n}) OVER (PARTITION BY t) + 1e-10) AS z{n}, avg({n}) OVER (PARTITION BY t) AS m{n}" for n in names)


#: Standardised features from month 19 on, rows with all of them.
MATRIX = FEATURES + f""",
x AS (
  SELECT t, date, ticker, {z_columns(RAW)}, {", ".join(f"(size_decile = {s})::INT::DOUBLE AS size_{s}" for s in range(1, 11))}, size_decile, ret FROM x1 WHERE t >= 19
  QUALIFY {" AND ".join(f"z{n} IS NOT NULL AND m{n} IS NOT NULL" for n in RAW)})"""
#: Ten labels a month.
LABELS = """,
l AS (
  SELECT t, ticker, ret, (9 - least((row_number() OVER (PARTITION BY t ORDER BY ret, ticker) - 1) * 10 // count(*) OVER (PARTITION BY t), 9))::INT AS label FROM r WHERE ret IS NOT NULL)"""
