"""DuckDB-side building blocks of the oracle SQL.

The oracle derives the rental roles from the raw test tables with plain SQL
(CTEs below) and then states each report from its definition, in another shape
than the Spark plans: flags and correlated EXISTS instead of anti joins, ranks as
one plus the number of larger values, DuckDB's own quantiles as medians.

DuckDB's decimal division and AVG return DOUBLE, so every rounded figure is
computed on integer cents and rounded half away from zero by integer
division, then turned into DOUBLE once.
"""

from __future__ import annotations

# Role CTEs.  Every money column has an integer-cents twin (``*_cents``).
ROLE_CTES = """
categories AS (
  SELECT CAST(row_number() OVER (ORDER BY p_type) AS BIGINT) AS category_id, p_type AS name
  FROM (SELECT DISTINCT p_type FROM part) d),
titles AS (
  SELECT p_partkey AS title_id, p_name AS title,
         CAST(CASE p_partkey % 3 WHEN 0 THEN 0.99 WHEN 1 THEN 2.99 ELSE 4.99 END AS DECIMAL(4,2)) AS rental_rate,
         CAST(CASE p_partkey % 3 WHEN 0 THEN 99 WHEN 1 THEN 299 ELSE 499 END AS BIGINT) AS rate_cents,
         CAST(3 + p_size % 5 AS INTEGER) AS rental_duration,
         CAST(CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE 45 + p_size * 2 END AS INTEGER) AS length,
         CAST(p_retailprice AS DECIMAL(8,2)) AS replacement_cost,
         CAST(round(p_retailprice * 100) AS BIGINT) AS cost_cents,
         CASE WHEN p_partkey % 89 = 0 THEN NULL
              ELSE ['G', 'PG', 'PG-13', 'R', 'NC-17'][p_size % 5 + 1] END AS rating
  FROM part),
title_cats AS (
  SELECT p.p_partkey AS title_id, c.category_id
  FROM part p JOIN categories c ON p.p_type = c.name),
casting AS (
  SELECT p_partkey AS title_id,
         CASE WHEN place = 0 AND p_partkey % 3 = 0 THEN 1
              ELSE 2 + (p_partkey * 7 + place * 131) % 996 END AS actor_id
  FROM part, range(4) AS places(place) WHERE place < p_partkey % 5),
actors AS (
  SELECT DISTINCT actor_id, 'Actor' AS first_name, lpad(CAST(actor_id AS VARCHAR), 9, '0') AS last_name
  FROM casting),
stores AS (SELECT CAST(r_regionkey AS BIGINT) AS store_id FROM region),
staffs AS (
  SELECT s_suppkey AS staff_id, CAST(n_regionkey AS BIGINT) AS store_id,
         split_part(s_name, '#', 1) AS first_name, split_part(s_name, '#', 2) AS last_name,
         TRUE AS active
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
copies AS (
  SELECT p_partkey * 1000 + n_nationkey AS copy_id, p_partkey AS title_id,
         CAST(n_regionkey AS BIGINT) AS store_id
  FROM part, nation),
customers AS (
  SELECT c_custkey AS customer_id, CAST(n_regionkey AS BIGINT) AS store_id,
         split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name,
         CASE WHEN c_custkey % 101 = 0 THEN NULL ELSE lower(c_name) END AS email,
         c_acctbal >= 0 AS active
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
lines AS (
  SELECT l.*, o.o_custkey, o.o_orderdate, s.s_nationkey,
         row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey,
             l.l_suppkey, l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax,
             l.l_returnflag, l.l_linestatus, l.l_shipdate) AS rn
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
       JOIN supplier s ON l.l_suppkey = s.s_suppkey),
rentals AS (
  SELECT l_orderkey * 16777216 + rn AS rental_id,
         o_orderdate + to_hours(l_suppkey % 24) AS rental_date,
         l_partkey * 1000 + s_nationkey AS copy_id,
         o_custkey AS customer_id,
         CASE WHEN l_linenumber = 7 AND l_returnflag = 'N' THEN NULL
              ELSE o_orderdate + to_hours(CAST(trunc(l_quantity) AS BIGINT) * 9 + l_partkey % 24)
         END AS return_date,
         l_suppkey AS staff_id
  FROM lines),
payments AS (
  SELECT l_orderkey * 16777216 + rn AS payment_id, o_custkey AS customer_id, l_suppkey AS staff_id,
         CASE WHEN l_linenumber = 1 AND l_returnflag = 'R' AND l_linestatus = 'O' THEN NULL
              ELSE l_orderkey * 16777216 + rn END AS rental_id,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS amount,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_cents,
         o_orderdate AS payment_date
  FROM lines)
"""


def with_roles(body: str, extra_ctes: str = "") -> str:
    """``WITH <role CTEs>[, extra] <body>`` -- body is the final SELECT."""
    ctes = ROLE_CTES.strip()
    if extra_ctes.strip():
        ctes += ",\n" + extra_ctes.strip()
    return f"WITH {ctes}\n{body.strip()}"


def rq(num: str, den: str, k: int) -> str:
    """ROUND(num / den, k) half away from zero as DOUBLE; num, den integers;
    NULL when den is 0 or NULL (den must be >= 0)."""
    n = f"CAST(({num}) AS HUGEINT)"
    d = f"CAST(nullif(({den}), 0) AS HUGEINT)"
    scale = 10 ** k
    return (f"(CAST(sign({n}) * ((2 * abs({n}) * {scale} + {d}) // (2 * {d})) AS DOUBLE)"
            f" / {scale})")


def cents(x: str) -> str:
    """Integer cents as DOUBLE money."""
    return f"(CAST(({x}) AS DOUBLE) / 100)"


def avg_scaled(sum_units: str, n: str, src_scale: int, k: int) -> str:
    """AVG of a decimal with ``src_scale`` decimals, from the sum of its
    integer units and the count: first to ``src_scale + 4`` decimals, then to
    ``k`` decimals (both half away from zero).  NULL when n is 0."""
    s = f"CAST(({sum_units}) AS HUGEINT)"
    c = f"CAST(nullif(({n}), 0) AS HUGEINT)"
    fine = f"(sign({s}) * ((2 * abs({s}) * 10000 + {c}) // (2 * {c})))"
    step = 10 ** (src_scale + 4 - k)
    return (f"(CAST(sign({fine}) * ((2 * abs({fine}) + {step}) // (2 * {step})) AS DOUBLE)"
            f" / {10 ** k})")


def avg_cents(sum_c: str, n: str, k: int = 2) -> str:
    """Mean of 2-decimal money from its cents sum and count."""
    return avg_scaled(sum_c, n, 2, k)


def div_round(num: str, den: str) -> str:
    """Integer num / den rounded half away from zero (den > 0), as HUGEINT."""
    n = f"CAST(({num}) AS HUGEINT)"
    d = f"CAST(({den}) AS HUGEINT)"
    return f"(sign({n}) * ((2 * abs({n}) + {d}) // (2 * {d})))"


def day_diff(start: str, end: str) -> str:
    """Calendar-day difference end - start (time of day ignored)."""
    return f"(CAST({end} AS DATE) - CAST({start} AS DATE))"


def elapsed_day_diff(start: str, end: str) -> str:
    """Whole elapsed days, truncated toward zero."""
    d = f"(epoch_us({end}) - epoch_us({start}))"
    return f"CAST(sign({d}) * (abs({d}) // 86400000000) AS BIGINT)"


def big(x: str) -> str:
    return f"CAST(({x}) AS BIGINT)"
