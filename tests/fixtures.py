"""Hand-built role fixture.  Every expected value in the tests is worked out
by hand from these rows (see the comments next to each row).

Titles   t1 'Alpha' 4.99/3d Action, t2 'Beta' 0.99/5d Drama,
         t3 'Alpha' 2.99/4d Action (same text as t1), t4 'Gamma' 2.99/NULL Drama,
         t5 'Delta' 0.99/3d Drama (no copy)
Copies   c11 t1@1, c12 t1@1 (never rented), c21 t2@2, c31 t3@1, c41 t4@2,
         c99 t2@3 (never rented; store 3 has stock but no sales)
Customers u1 active@1, u2 active@2, u3 inactive@1, u4 active@2 (no rentals)
Staff    s1@1, s2@2
Rentals  r1 c11 u1 s2 2024-01-10 23:59 -> 2024-01-15 00:01 (calendar 5d, elapsed 4d)
         r2 c21 u1 s1 2024-01-20 10:00 -> open, unpaid
         r3 c31 u2 s1 2024-02-01 10:00 -> 2024-02-03 09:00 (on time)
         r4 c41 u3 s2 2024-02-05 08:00 -> 2024-02-25 08:00 (duration NULL)
         r5 c11 u2 s2 2024-03-01 12:00 -> 2024-03-20 12:00 (16 days late)
Payments p1 r1 4.99, p2 r1 1.00 (second payment), p3 r3 2.99, p4 r4 2.99,
         p5 NULL 5.00, p6 999 (dangling) 3.00, p7 r5 4.99
"""

from __future__ import annotations

from datetime import datetime as dt
from decimal import Decimal as D

from reelstat.sources.roles import Roles
from reelstat.sources.schemas import ROLE_SCHEMAS


def _df(spark, role, rows):
    return spark.createDataFrame(rows, ROLE_SCHEMAS[role])


def hand_roles(spark) -> Roles:
    return Roles(
        category=_df(spark, "category", [(1, "Action"), (2, "Drama")]),
        title=_df(spark, "title", [
            (1, "Alpha", D("4.99"), 3, 100, D("20.00"), "PG"),
            (2, "Beta", D("0.99"), 5, 90, D("10.00"), "G"),
            (3, "Alpha", D("2.99"), 4, None, D("15.00"), "R"),
            (4, "Gamma", D("2.99"), None, 80, D("12.00"), None),
            (5, "Delta", D("0.99"), 3, 70, D("9.00"), "G"),
        ]),
        title_category=_df(spark, "title_category", [(1, 1), (2, 2), (3, 1), (4, 2), (5, 2)]),
        store=_df(spark, "store", [(1, None, None), (2, None, None), (3, None, None)]),
        staff=_df(spark, "staff", [(1, 1, "Ann", "One", True), (2, 2, "Bob", "Two", True)]),
        copy=_df(spark, "copy", [(11, 1, 1), (12, 1, 1), (21, 2, 2), (31, 3, 1),
                                 (41, 4, 2), (99, 2, 3)]),
        customer=_df(spark, "customer", [
            (1, 1, "Una", "A", "una@x", True),
            (2, 2, "Dos", "B", None, True),
            (3, 1, "Tres", "C", "tres@x", False),
            (4, 2, "Cua", "D", "cua@x", True),
        ]),
        rental=_df(spark, "rental", [
            (1, dt(2024, 1, 10, 23, 59), 11, 1, dt(2024, 1, 15, 0, 1), 2),
            (2, dt(2024, 1, 20, 10, 0), 21, 1, None, 1),
            (3, dt(2024, 2, 1, 10, 0), 31, 2, dt(2024, 2, 3, 9, 0), 1),
            (4, dt(2024, 2, 5, 8, 0), 41, 3, dt(2024, 2, 25, 8, 0), 2),
            (5, dt(2024, 3, 1, 12, 0), 11, 2, dt(2024, 3, 20, 12, 0), 2),
        ]),
        payment=_df(spark, "payment", [
            (1, 1, 2, 1, D("4.99"), dt(2024, 1, 10)),
            (2, 1, 2, 1, D("1.00"), dt(2024, 1, 16)),
            (3, 2, 1, 3, D("2.99"), dt(2024, 2, 1)),
            (4, 3, 2, 4, D("2.99"), dt(2024, 2, 5)),
            (5, 2, 1, None, D("5.00"), dt(2024, 2, 10)),
            (6, 1, 1, 999, D("3.00"), dt(2024, 3, 1)),
            (7, 2, 2, 5, D("4.99"), dt(2024, 3, 1)),
        ]),
    )


def rows(df, *order):
    """Collect as a list of dicts, sorted by ``order`` columns."""
    out = [r.asDict() for r in df.collect()]
    if order:
        out.sort(key=lambda r: tuple((r[c] is None, r[c]) for c in order))
    return out
