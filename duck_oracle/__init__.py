"""DuckDB oracle SQL for every report that has a SQL form."""

from __future__ import annotations

from . import (customers_sql, quality_sql, raw_sql, revenue_sql, roadmap_sql, stores_sql,
               trends_sql)

_MODULES = [quality_sql, revenue_sql, customers_sql, trends_sql, stores_sql, raw_sql,
            roadmap_sql]


# V9: each published view read back and counted.
VIEW_KEYS = {
    "v_category_revenue": "q_v_category_revenue",
    "v_customer_segments": "q_v_customer_segments",
    "v_fee_loss": "q_v_fee_loss",
    "v_monthly_trend": "q_v_monthly_trend",
    "v_staff_performance": "q_v_staff_performance",
    "v_stock_utilisation": "q_v_stock_utilisation",
    "v_store_scorecard": "q_v_store_scorecard",
    "v_title_ranking": "q_v_title_ranking",
}


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out.update(m.SQL)
    out["q_view_inventory"] = "\nUNION ALL\n".join(
        f"SELECT '{v}' AS view_name, CAST(count(*) AS BIGINT) AS rows, 'created' AS status "
        f"FROM ({out[k]}) t" for v, k in VIEW_KEYS.items())
    return out
