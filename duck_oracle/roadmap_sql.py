"""Oracle SQL: cohorts, price elasticity, length against lateness, calendar change."""

from .sqlkit import big, cents, day_diff, rq, with_roles

COHORT_RETENTION = with_roles(f"""
SELECT strftime(cohort, '%Y-%m-%d') AS cohort, {big("date_diff('month', cohort, month)")} AS months_since,
       {big('count(DISTINCT customer_id)')} AS customers,
       {big('max(size)')} AS cohort_size, {rq('count(DISTINCT customer_id) * 100', 'max(size)', 2)} AS retention_pct
FROM (SELECT customer_id, date_trunc('month', rental_date) AS month FROM rentals) r
JOIN (SELECT customer_id, cohort, count(*) OVER (PARTITION BY cohort) AS size
      FROM (SELECT customer_id, date_trunc('month', min(rental_date)) AS cohort
            FROM rentals GROUP BY customer_id) f) c USING (customer_id)
GROUP BY cohort, month
""")

PRICE_ELASTICITY = with_roles(f"""
SELECT CAST(a.rental_rate AS DOUBLE) AS rental_rate, a.titles, a.rentals,
       {cents('a.cash')} AS revenue,
       round(ln((a.rentals / a.titles) / (b.rentals / b.titles))
             / ln(CAST(a.rental_rate AS DOUBLE) / CAST(b.rental_rate AS DOUBLE)), 4) AS elasticity
FROM tiers a LEFT JOIN tiers b
  ON b.rental_rate = (SELECT max(rental_rate) FROM tiers c WHERE c.rental_rate < a.rental_rate)
""", f"""
tiers AS (
  SELECT t.rental_rate, {big('count(DISTINCT t.title_id)')} AS titles,
         {big('count(DISTINCT p.rental_id)')} AS rentals, sum(p.amount_cents) AS cash
  FROM payments p, rentals r, copies c, titles t
  WHERE r.rental_id = p.rental_id AND c.copy_id = r.copy_id AND t.title_id = c.title_id
    AND t.title_id IN (SELECT title_id FROM title_cats)
  GROUP BY t.rental_rate)
""")

LENGTH_LATENESS = with_roles(f"""
SELECT {big('count(*)')} AS titles, round(corr(length, rate), 6) AS correlation
FROM (SELECT t.title_id, t.length,
             avg(CAST(coalesce({day_diff('r.rental_date', 'r.return_date')} > t.rental_duration, FALSE)
                      AS DOUBLE)) AS rate
      FROM titles t, copies c, rentals r
      WHERE c.title_id = t.title_id AND r.copy_id = c.copy_id
        AND r.return_date IS NOT NULL AND t.length IS NOT NULL
      GROUP BY t.title_id, t.length) x
""")

MONTHLY_CALENDAR = with_roles(f"""
SELECT strftime(m.month, '%Y-%m-%d') AS month, {cents('m.cash')} AS revenue,
       {cents('m.cash - p.cash')} AS delta, {rq('(m.cash - p.cash) * 100', 'p.cash', 2)} AS growth_pct
FROM m LEFT JOIN m p ON p.month = m.month - INTERVAL 1 MONTH
""", """
m AS (SELECT date_trunc('month', payment_date) AS month, sum(amount_cents) AS cash
      FROM payments WHERE rental_id IS NOT NULL GROUP BY 1)
""")

# Every payment beside its title's cast as a list: the first cents mod n of the
# list (in order of the ids) get one cent more.
REVENUE_BY_ACTOR = with_roles(f"""
SELECT g.actor_id, a.first_name || ' ' || a.last_name AS actor_name, g.titles, g.payments,
       {cents('g.full_c')} AS full_credit, {cents('g.part_c')} AS split_revenue,
       {rq('g.part_c * 100', '(SELECT sum(amount_cents) FROM payments)', 2)} AS share_pct,
       CASE WHEN g.actor_id IS NOT NULL THEN
         {big('1 + (SELECT count(*) FROM g h WHERE h.actor_id IS NOT NULL AND h.part_c > g.part_c)')}
       END AS revenue_rank
FROM g LEFT JOIN actors a ON a.actor_id = g.actor_id
""", f"""
troupes AS (
  SELECT title_id, list(actor_id ORDER BY actor_id) AS troupe, count(*) AS size
  FROM casting GROUP BY title_id),
receipts AS (
  SELECT p.amount_cents AS c, i.title_id, coalesce(troupe, [NULL]) AS troupe, coalesce(size, 1) AS size
  FROM payments p LEFT JOIN rentals r ON r.rental_id = p.rental_id
       LEFT JOIN copies i ON i.copy_id = r.copy_id LEFT JOIN troupes t ON t.title_id = i.title_id),
g AS (
  SELECT actor_id, {big('count(DISTINCT title_id)')} AS titles, {big('count(*)')} AS payments,
         sum(c) AS full_c, sum(c // size + if(place <= c % size, 1, 0)) AS part_c
  FROM (SELECT title_id, c, size, unnest(troupe) AS actor_id, unnest(range(1, size + 1)) AS place
        FROM receipts) x
  GROUP BY actor_id)
""")

SQL = {
    "q_revenue_by_actor": REVENUE_BY_ACTOR,
    "q_cohort_retention": COHORT_RETENTION,
    "q_price_elasticity": PRICE_ELASTICITY,
    "q_length_lateness": LENGTH_LATENESS,
    "q_monthly_revenue_calendar": MONTHLY_CALENDAR,
}
