"""Oracle SQL: stores, stock and staff."""

from .sqlkit import avg_scaled, big, cents, rq, with_roles

# What each rental brought in: one row per paid rental.
TILL = """
till AS (
  SELECT rental_id, sum(amount_cents) AS cash, count(*) AS slips
  FROM payments WHERE rental_id IS NOT NULL GROUP BY rental_id),
paid AS (
  SELECT r.*, t.cash, t.slips, s.store_id AS shop
  FROM rentals r, till t, staffs s
  WHERE t.rental_id = r.rental_id AND s.staff_id = r.staff_id)"""

# Every copy with its category and whether it ever went out.
SHELF = """
shelf AS (
  SELECT c.copy_id, c.store_id, t.title_id, t.title, t.rental_rate, t.replacement_cost,
         t.cost_cents, k.name AS category,
         c.copy_id IN (SELECT copy_id FROM rentals) AS went_out
  FROM copies c, titles t, title_cats tc, categories k
  WHERE t.title_id = c.title_id AND tc.title_id = t.title_id AND k.category_id = tc.category_id)"""

# Sales per shop from customer subtotals; stock per shop from flags.
ROLLUPS = TILL + f""",
buyers AS (
  SELECT shop, customer_id, count(*) AS trips, sum(cash) AS cash, sum(slips) AS slips
  FROM paid GROUP BY shop, customer_id),
shops AS (
  SELECT shop, {big('sum(trips)')} AS rentals, {big('count(customer_id)')} AS customers,
         sum(cash) AS cash, sum(slips) AS slips
  FROM buyers GROUP BY shop),
racks AS (
  SELECT store_id, {big('count(*)')} AS copies,
         {big('count(*) FILTER (went_out)')} AS moved
  FROM (SELECT store_id, copy_id IN (SELECT copy_id FROM rentals) AS went_out FROM copies) c
  GROUP BY store_id)"""

SHOP_FIGURES = f"""rentals, customers, {cents('cash')} AS revenue,
       {avg_scaled('cash', 'slips', 2, 2)} AS avg_ticket,
       {rq('cash', 'customers * 100', 2)} AS revenue_per_customer"""
SHOP_EXTRAS = f"""{rq('rentals', 'customers', 2)} AS rentals_per_customer,
       {rq('cash * 100', '(SELECT sum(cash) FROM {total})', 2)} AS share_pct"""

STORE_PERFORMANCE = with_roles(f"""
SELECT shop AS store_id, {SHOP_FIGURES}, {SHOP_EXTRAS.format(total='shops')}
FROM shops
""", ROLLUPS)


def _scorecard(view: bool) -> str:
    extras = SHOP_EXTRAS.format(total="shops WHERE shop IN (SELECT store_id FROM racks)") + ","
    return with_roles(f"""
SELECT store_id, {SHOP_FIGURES}, {extras if view else ''}
       copies, moved, copies - moved AS idle, {rq('moved * 100', 'copies', 2)} AS utilisation_pct
FROM racks, shops WHERE shop = store_id
""", ROLLUPS)


# A rank is one more than the number of larger values in the same group.
STORE_CATEGORY = with_roles(f"""
SELECT g.store_id, g.category, g.rentals, {cents('g.cash')} AS revenue,
       {big('1 + (SELECT count(*) FROM g h WHERE h.store_id = g.store_id AND h.cash > g.cash)')}
         AS rank_in_store
FROM g
""", TILL + f""",
g AS (
  SELECT paid.shop AS store_id, k.name AS category, {big('count(*)')} AS rentals,
         sum(paid.cash) AS cash
  FROM paid, copies c, title_cats tc, categories k
  WHERE c.copy_id = paid.copy_id AND tc.title_id = c.title_id AND k.category_id = tc.category_id
  GROUP BY ALL)""")


def _utilisation(labels: tuple[str, str, str]) -> str:
    high, middle, low = labels
    return with_roles(f"""
SELECT store_id, category, copies, moved, copies - moved AS idle,
       {rq('moved * 100', 'copies', 2)} AS utilisation_pct,
       if(moved * 10 >= copies * 9, '{high}', if(moved * 5 >= copies * 3, '{middle}', '{low}'))
         AS label
FROM (SELECT store_id, category, {big('count(*)')} AS copies,
             {big('count(*) FILTER (went_out)')} AS moved
      FROM shelf GROUP BY ALL) f
""", SHELF)


IDLE_STOCK = with_roles(f"""
SELECT store_id, title, category, CAST(rental_rate AS DOUBLE) AS rental_rate,
       CAST(replacement_cost AS DOUBLE) AS replacement_cost,
       {big('count(*)')} AS idle_copies, {cents('sum(cost_cents)')} AS immobilised
FROM shelf WHERE NOT went_out
GROUP BY store_id, title, category, rental_rate, replacement_cost
""", SHELF)

IDLE_VALUE_BY_CATEGORY = with_roles(f"""
SELECT category, {big('count(*)')} AS idle_copies, {cents('sum(cost_cents)')} AS immobilised,
       {rq('count(*) * 100', '(SELECT count(*) FROM shelf WHERE NOT went_out)', 2)}
         AS idle_share_pct
FROM shelf WHERE NOT went_out GROUP BY category
""", SHELF)

CLERKS = TILL + f""",
clerks AS (
  SELECT staff_id, {big('sum(trips)')} AS rentals, {big('count(customer_id)')} AS customers,
         sum(cash) AS cash, sum(slips) AS slips
  FROM (SELECT staff_id, customer_id, count(*) AS trips, sum(cash) AS cash, sum(slips) AS slips
        FROM paid GROUP BY staff_id, customer_id) b
  GROUP BY staff_id)"""

STAFF_PERFORMANCE = with_roles(f"""
SELECT s.staff_id, concat(s.first_name, ' ', s.last_name) AS staff_name, s.store_id,
       c.rentals, c.customers, {cents('c.cash')} AS revenue,
       {avg_scaled('c.cash', 'c.slips', 2, 2)} AS avg_ticket,
       {rq('c.cash * 100', '(SELECT sum(cash) FROM clerks)', 2)} AS share_pct,
       {big('1 + (SELECT count(*) FROM clerks d WHERE d.cash > c.cash)')} AS revenue_rank,
       {rq('c.cash', 'c.customers * 100', 2)} AS revenue_per_customer
FROM clerks c JOIN staffs s USING (staff_id)
""", CLERKS)

# Cash per rental and month of payment, so that a rental counts once a month.
STAFF_BY_MONTH = with_roles(f"""
SELECT strftime(month, '%Y-%m-%d') AS month, s.staff_id,
       concat(s.first_name, ' ', s.last_name) AS staff_name, s.store_id,
       m.rentals, {cents('m.cash')} AS revenue,
       {big('1 + (SELECT count(*) FROM m n WHERE n.month IS NOT DISTINCT FROM m.month AND n.cash > m.cash)')}
         AS rank_in_month
FROM m JOIN staffs s USING (staff_id)
""", f"""
m AS (
  SELECT month, staff_id, {big('count(*)')} AS rentals, sum(cash) AS cash
  FROM (SELECT date_trunc('month', payment_date) AS month, rental_id, sum(amount_cents) AS cash
        FROM payments WHERE rental_id IS NOT NULL GROUP BY ALL) q
  JOIN rentals USING (rental_id)
  GROUP BY month, staff_id)""")

PRICE_MIX_BY_STORE = with_roles(f"""
SELECT store_id, CAST(rental_rate AS DOUBLE) AS rental_rate, rentals,
       {rq('rentals * 100', '(SELECT sum(rentals) FROM mix n WHERE n.store_id = mix.store_id)', 2)}
         AS share_in_store_pct
FROM mix
""", TILL + f""",
mix AS (
  SELECT paid.shop AS store_id, t.rental_rate, {big('count(*)')} AS rentals
  FROM paid, copies c, titles t
  WHERE c.copy_id = paid.copy_id AND t.title_id = c.title_id GROUP BY ALL)""")

SQL = {
    "q_store_performance": STORE_PERFORMANCE,
    "q_store_category": STORE_CATEGORY,
    "q_stock_utilisation": _utilisation(("High utilisation", "Moderate utilisation",
                                         "Low utilisation")),
    "q_v_stock_utilisation": _utilisation(("High", "Moderate", "Low")),
    "q_idle_stock": IDLE_STOCK,
    "q_idle_value_by_category": IDLE_VALUE_BY_CATEGORY,
    "q_store_scorecard": _scorecard(False),
    "q_v_store_scorecard": _scorecard(True),
    "q_staff_performance": STAFF_PERFORMANCE,
    "q_v_staff_performance": STAFF_PERFORMANCE,
    "q_staff_by_month": STAFF_BY_MONTH,
    "q_price_mix_by_store": PRICE_MIX_BY_STORE,
}
