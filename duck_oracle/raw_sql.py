"""Oracle SQL: audit operators applied to the raw test tables."""


from .sqlkit import big, day_diff, rq

TABLE_COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
               "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                 "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}

KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"],
    "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"],
    "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"],
    "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"],
}

NULL_PROFILE_RAW = "\nUNION ALL\n".join(
    f"SELECT '{t}.{c}' AS field, {big(f'count(*) - count({c})')} AS nulls, "
    f"{rq(f'(count(*) - count({c})) * 100', 'count(*)', 2)} AS pct FROM {t}"
    for t, cols in TABLE_COLUMNS.items() for c in cols)

# The columns of whole numbers.
WHOLE = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"],
    "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"],
    "part": ["p_partkey", "p_size"], "orders": ["o_orderkey", "o_custkey"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
    "events": ["event_id", "user_id"], "documents": ["doc_id", "n_chars"],
    "embeddings": ["vec_id", "label"], "pages": ["page_id"], "benchmark": ["item_id"],
    "labels": ["doc_id", "quality", "toxic"], "conversations": ["conv_id", "turn"],
}

KEY_RANGES = "\nUNION ALL\n".join(
    f"SELECT '{t}.{c}' AS field, {big(f'min({c})')} AS low, {big(f'max({c})')} AS high FROM {t}"
    for t, cols in WHOLE.items() for c in cols)

DUPLICATE_KEYS_RAW = "\nUNION ALL\n".join(
    f"SELECT '{t}.{'+'.join(k)}' AS check_name, "
    f"{big(f'count(*) - count(DISTINCT ({', '.join(k)}))' if len(k) > 1 else f'count(*) - count(DISTINCT {k[0]})')} AS duplicates FROM {t}"
    for t, k in KEYS.items())

ORDERS_BY_MONTH = f"""
SELECT strftime(o_orderdate, '%Y-%m') AS month, {big('count(*)')} AS n FROM orders GROUP BY 1
"""

EVENT_DAILY_ANOMALIES = """
SELECT day, weekday, weekday_no, n,
       CAST((2 * ((2 * s1 * 10000 + days) // (2 * days)) + 1000) // 2000 AS DOUBLE) / 10 AS mean_daily,
       CASE WHEN dev > 0 AND dev * dev > 4 * var THEN 'Peak'
            WHEN dev < 0 AND dev * dev > 4 * var THEN 'Trough'
            ELSE 'Normal' END AS label,
       sign(z) * floor(abs(z) * 100 + 0.5) / 100 AS z
FROM (
  SELECT v.*, s.days, s.s1, s.days * v.n - s.s1 AS dev, s.days * s.s2 - s.s1 * s.s1 AS var,
         CAST(s.days * v.n - s.s1 AS DOUBLE)
           / sqrt(CAST(nullif(s.days * s.s2 - s.s1 * s.s1, 0) AS DOUBLE)) AS z
  FROM (SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, dayname(ts) AS weekday,
               CAST(dayofweek(ts) + 1 AS BIGINT) AS weekday_no, CAST(count(*) AS BIGINT) AS n
        FROM events GROUP BY 1, 2, 3) v
  CROSS JOIN (SELECT CAST(count(*) AS HUGEINT) AS days, CAST(sum(n) AS HUGEINT) AS s1,
                     CAST(sum(CAST(n AS HUGEINT) * n) AS HUGEINT) AS s2
              FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1) x) s) t
"""

SHIP_BEFORE_ORDER = f"""
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, o.o_orderdate, l.l_shipdate,
       {big(day_diff('o.o_orderdate', 'l.l_shipdate'))} AS diff_days
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE l.l_shipdate IS NOT NULL AND l.l_shipdate < o.o_orderdate
"""

SQL = {
    "q_null_profile_raw": NULL_PROFILE_RAW,
    "q_key_ranges": KEY_RANGES,
    "q_duplicate_keys_raw": DUPLICATE_KEYS_RAW,
    "q_orders_by_month": ORDERS_BY_MONTH,
    "q_event_daily_anomalies": EVENT_DAILY_ANOMALIES,
    "q_ship_before_order": SHIP_BEFORE_ORDER,
}

