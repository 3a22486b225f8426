"""Revenue attributed over a many-to-many bridge (titles and their actors).

A payment for a title with n actors can be credited to them in two ways: in
full to each (the credits then add up to more than the revenue), or split, so
that the parts add up to the payment.  The split is exact to the cent: all n
quotas are equal, so by largest remainder each actor gets the payment's cents
divided by n, rounded down, and the cents left over go one each to the actors
with the smallest ids.

Two payments of one amount for one title are split alike.  So payments are
first counted by copy and amount, then by title and amount, and only these
counts meet the bridge; an actor's place within a cast is ranked once per
bridge row, whatever the number of payments.  The rank is distributed, so a
title may have any number of actors, and an actor any number of titles.

Payments that lead to no cast (no rental, an unknown rental or copy, a title
without actors) are one row with NULL for the actor: the split adds up to the
revenue of all payments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import money_out
from ..functions.ranking import _buckets, _ordered_prefix, rank_desc, with_share
from ..session import stored
from ..sources.curated import derived
from ..sources.roles import Roles


def title_payments(roles: Roles) -> DataFrame:
    """(title_id, amount, n): payments by title and amount, NULL where a payment
    leads to no title."""
    named = roles.named_payments.select("rental_id", "amount").join(
        roles.rental.select("rental_id", "copy_id"), "rental_id", "left")
    unnamed = roles.payment.where(F.col("rental_id").isNull()).select(
        F.lit(None).cast("long").alias("copy_id"), "amount")
    by_copy = named.select("copy_id", "amount").unionByName(unnamed).groupBy(
        "copy_id", "amount").agg(F.count(F.lit(1)).alias("n"))
    titles = roles.copy.select("copy_id", "title_id")
    return by_copy.join(titles, "copy_id", "left").groupBy("title_id", "amount").agg(
        F.sum("n").alias("n"))


def cast_places(bridge: DataFrame, group: str, member: str, buckets: int | None = None) -> DataFrame:
    """(group, member, place, size): members of each group numbered from 0 by
    their ids.  Repeated and incomplete bridge rows count once and not at all."""
    pairs = bridge.where(F.col(group).isNotNull() & F.col(member).isNotNull()).select(
        group, member).distinct().withColumn("_one", F.lit(1))
    placed = _ordered_prefix(pairs, [group], F.col(member).asc(), "_one",
                             buckets or _buckets(bridge))
    sizes = pairs.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("size"))
    return placed.join(sizes, F.col(group) == F.col("_group")).select(
        group, member, F.col("_before").cast("long").alias("place"), "size")


def split_cents(cents, place, size) -> F.Column:
    """The share of the member at ``place`` in ``cents`` (also negative ones)."""
    left = F.pmod(cents, size)
    return F.call_function("div", cents - left, size) + (place < left).cast("long")


def attribute(amounts: DataFrame, bridge: DataFrame, group: str, member: str) -> DataFrame:
    """(member, groups, payments, full_cents, split_cents) over amounts
    (group, amount, n); the member is NULL for what no member is credited with."""
    cast = stored(cast_places(bridge, group, member), "cast")
    cents = (F.col("amount") * 100).cast("long")
    credited = amounts.join(cast, group, "left").select(
        member, group, "n", cents.alias("_cents"),
        F.when(F.col(member).isNull(), cents).otherwise(
            split_cents(cents, F.col("place"), F.col("size"))).alias("_part"))
    times = F.col("n").cast("decimal(20,0)")
    per = credited.groupBy(member, group).agg(
        F.sum("n").alias("payments"), F.sum(times * F.col("_cents")).alias("full_cents"),
        F.sum(times * F.col("_part")).alias("split_cents"))
    return per.groupBy(member).agg(
        F.count(group).alias("groups"), F.sum("payments").alias("payments"),
        F.sum("full_cents").alias("full_cents"), F.sum("split_cents").alias("split_cents"))


def revenue_by_actor(roles: Roles) -> DataFrame:
    """Per actor the titles that brought in payments, the payments, their
    revenue in full and split, share of all revenue and rank by split revenue.
    The row with NULL for the actor (no rank) holds what no cast shares."""
    per = derived(roles, "actor_revenue", lambda: attribute(
        title_payments(roles), roles.title_actor, "title_id", "actor_id"))
    per = with_share(per, "split_cents", "share_pct", scale=0)
    known = F.col("actor_id").isNotNull()
    ranked = rank_desc(per.where(known), "split_cents", "revenue_rank").unionByName(
        per.where(~known).withColumn("revenue_rank", F.lit(None).cast("long")))
    names = roles.actor.select("actor_id", F.concat("first_name", F.lit(" "), "last_name")
                               .alias("actor_name"))
    return ranked.join(names, "actor_id", "left").select(
        "actor_id", "actor_name", F.col("groups").alias("titles"), "payments",
        money_out(F.col("full_cents") / 100).alias("full_credit"),
        money_out(F.col("split_cents") / 100).alias("split_revenue"),
        F.col("share_pct").cast("double").alias("share_pct"), "revenue_rank")
