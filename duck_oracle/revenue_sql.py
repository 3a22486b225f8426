"""Oracle SQL: revenue and catalogue reports."""

from .sqlkit import avg_cents, big, cents, rq, with_roles

# What every title took, from the money of its copies' rentals, and its categories.
TAKINGS = """
till AS (
  SELECT rental_id, sum(amount_cents) AS cash, count(*) AS slips
  FROM payments WHERE rental_id IS NOT NULL GROUP BY rental_id),
takings AS (
  SELECT title_id, CAST(count(*) AS BIGINT) AS rentals, sum(cash) AS cash, sum(slips) AS slips
  FROM till JOIN rentals USING (rental_id) JOIN copies USING (copy_id) GROUP BY title_id),
genres AS (SELECT title_id, name AS category FROM title_cats JOIN categories USING (category_id)),
genre_takings AS (
  SELECT category, sum(rentals) AS rentals, count(*) AS titles, sum(cash) AS cash, sum(slips) AS slips
  FROM takings JOIN genres USING (title_id) GROUP BY category)
"""

# Ranks are one more than the number of larger figures.
REVENUE_BY_CATEGORY = with_roles(f"""
SELECT category, {big('rentals')} AS rentals, {big('titles')} AS titles, {cents('cash')} AS revenue,
       {avg_cents('cash', 'slips')} AS avg_ticket,
       {rq('cash * 100', '(SELECT sum(cash) FROM genre_takings)', 2)} AS share_pct,
       {big('1 + (SELECT count(*) FROM genre_takings h WHERE h.cash > g.cash)')} AS revenue_rank,
       {rq('cash', 'titles * 100', 2)} AS revenue_per_title
FROM genre_takings g
""", TAKINGS)

TITLE_RANKS = TAKINGS + f""",
listed AS (
  SELECT title_id, title, category, rental_rate, rating, rentals, cash
  FROM takings JOIN titles USING (title_id) JOIN genres USING (title_id)),
placed AS (
  SELECT title_id, title, category, CAST(rental_rate AS DOUBLE) AS rental_rate, rating, rentals,
         {cents('cash')} AS revenue,
         {big('(SELECT count(*) FROM listed o WHERE o.cash > l.cash) + 1')} AS rank_all,
         {big('(SELECT count(*) FROM listed o WHERE o.cash > l.cash AND o.category = l.category) + 1')}
           AS rank_in_category
  FROM listed l)
"""

TOP_TITLES = with_roles("""
FROM placed QUALIFY row_number() OVER (ORDER BY revenue DESC, title_id, category) <= 10
""", TITLE_RANKS)

TITLE_RANKING = with_roles("FROM placed", TITLE_RANKS)

TITLES_WITH_IDLE_COPIES = with_roles(f"""
SELECT title_id, title, name AS category, CAST(rental_rate AS DOUBLE) AS rental_rate, rating,
       idle_copies
FROM (SELECT title_id, {big('count(*)')} AS idle_copies FROM copies c
      WHERE NOT EXISTS (FROM rentals r WHERE r.copy_id = c.copy_id) GROUP BY title_id) idle
JOIN titles USING (title_id) JOIN title_cats USING (title_id) JOIN categories USING (category_id)
""")

UNRENTED_TITLES = with_roles(f"""
SELECT f.title_id, f.title, cat.name AS category, CAST(f.rental_rate AS DOUBLE) AS rental_rate,
       f.rating, o.copies
FROM (SELECT title_id, {big('count(*)')} AS copies FROM copies GROUP BY title_id) o
JOIN titles f ON o.title_id = f.title_id
JOIN title_cats fc ON f.title_id = fc.title_id
JOIN categories cat ON fc.category_id = cat.category_id
WHERE NOT EXISTS (SELECT 1 FROM copies i JOIN rentals r ON r.copy_id = i.copy_id
                  WHERE i.title_id = o.title_id)
""")

UNRENTED_STORE_TITLES = with_roles(f"""
SELECT o.store_id, f.title_id, f.title, cat.name AS category,
       CAST(f.rental_rate AS DOUBLE) AS rental_rate, f.rating, o.copies
FROM (SELECT store_id, title_id, {big('count(*)')} AS copies FROM copies GROUP BY store_id, title_id) o
JOIN titles f ON o.title_id = f.title_id
JOIN title_cats fc ON f.title_id = fc.title_id
JOIN categories cat ON fc.category_id = cat.category_id
WHERE NOT EXISTS (SELECT 1 FROM copies i JOIN rentals r ON r.copy_id = i.copy_id
                  WHERE i.title_id = o.title_id AND i.store_id = o.store_id)
""")

# Titles of one text count together.
TOP3_PER_CATEGORY = with_roles(f"""
SELECT category, title, rentals, {cents('cash')} AS revenue,
       {big('1 + ahead')} AS category_rank
FROM (SELECT a.*, (SELECT count(*) FROM texts b WHERE b.category = a.category AND b.cash > a.cash) AS ahead
      FROM texts a) x
WHERE ahead < 3
""", TAKINGS + f""",
texts AS (
  SELECT category, title, {big('sum(rentals)')} AS rentals, sum(cash) AS cash
  FROM takings JOIN titles USING (title_id) JOIN genres USING (title_id) GROUP BY category, title)
""")

REVENUE_BY_PRICE_TIER = with_roles(f"""
SELECT CAST(rental_rate AS DOUBLE) AS rental_rate, {big('count(*)')} AS titles,
       {big('sum(rentals)')} AS rentals, {cents('sum(cash)')} AS revenue,
       {avg_cents('sum(cash)', 'sum(slips)')} AS avg_ticket,
       {rq('sum(cash) * 100', '(SELECT sum(cash) FROM takings)', 2)} AS share_pct,
       {rq('sum(rentals)', 'count(*)', 1)} AS rentals_per_title
FROM takings JOIN titles USING (title_id) GROUP BY rental_rate
""", TAKINGS)

REVENUE_PER_COPY = with_roles(f"""
SELECT category, {cents('coalesce(cash, 0)')} AS revenue, copies,
       {rq('coalesce(cash, 0)', 'copies * 100', 2)} AS revenue_per_copy
FROM (SELECT category, {big('sum(copies)')} AS copies
      FROM (SELECT title_id, count(*) AS copies FROM copies GROUP BY title_id) c
      JOIN genres USING (title_id) GROUP BY category) s
LEFT JOIN genre_takings USING (category)
""", TAKINGS)

SQL = {
    "q_revenue_by_category": REVENUE_BY_CATEGORY,
    "q_v_category_revenue": REVENUE_BY_CATEGORY,
    "q_top_titles": TOP_TITLES,
    "q_v_title_ranking": TITLE_RANKING,
    "q_titles_with_idle_copies": TITLES_WITH_IDLE_COPIES,
    "q_unrented_titles": UNRENTED_TITLES,
    "q_unrented_store_titles": UNRENTED_STORE_TITLES,
    "q_top3_titles_per_category": TOP3_PER_CATEGORY,
    "q_revenue_by_price_tier": REVENUE_BY_PRICE_TIER,
    "q_revenue_per_copy": REVENUE_PER_COPY,
}
