"""Exposed users and as many matched controls, per app."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.operators.ranking import PREFIX, first_by_hash, md5_key, numbered
from footfall.sources.staging import stage

PAIR = ["imei", "appname"]
BLOCK = 4096  # neighbouring users on the ring that are joined and sorted together


def active_pairs(use: DataFrame, days: tuple[int, int]) -> DataFrame:
    """(user, app) pairs with any use in a closed day range."""
    return use.where(F.col("dayno").between(*days)).select(*PAIR).distinct()


def active_exposed(exposed: DataFrame, use: DataFrame, days: tuple[int, int]) -> DataFrame:
    """Exposed pairs with use."""
    return exposed.join(active_pairs(use, days), PAIR, "left_semi").distinct()


def inactive_exposed(exposed: DataFrame, use: DataFrame, days: tuple[int, int], quota: DataFrame) -> DataFrame:
    """Exposed pairs without use, up to ``quota`` per app."""
    idle = exposed.join(active_pairs(use, days), PAIR, "left_anti").distinct()
    return first_by_hash(idle, ["appname"], PAIR, quota).select(*PAIR)


def cohort_sizes(exposed: DataFrame, active: DataFrame) -> DataFrame:
    """Per app with active users: users seen, active ones, and the controls that match the exposed side."""
    seen = exposed.select(*PAIR).distinct().groupBy("appname").agg(F.count("*").alias("n_seen"))
    sizes = active.groupBy("appname").agg(F.count("*").alias("n_active")).join(seen, "appname")
    idle = F.least("n_active", F.col("n_seen") - F.col("n_active"))
    return sizes.withColumn("n_controls", F.col("n_active") + idle)


def _ring_start(app: Column, size: Column) -> Column:
    return F.conv(F.substring(F.md5(app), 1, 8), 16, 10).cast("long") % size


def unexposed_controls(population: DataFrame, exposed: DataFrame, sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per app, up to ``n_controls`` users of the population that never saw its ads.

    Users stand on a ring in md5 order and every app reads on from its own hashed start. Among the first
    ``n_controls + n_seen`` users there are ``n_controls`` unexposed ones, or the ring is used up, so each
    app meets only that many users instead of the whole population.
    """
    users = population.select("imei").distinct().withColumn("_md5", md5_key("imei"))
    users = stage(users, "ring_users")
    ring = numbered(
        users, [], {"_bucket": F.substring("_md5", 1, PREFIX + 1)}, [F.col("_md5"), F.col("imei")], "_pos"
    ).select("imei", (F.col("_pos") - 1).alias("pos"))
    size = F.lit(users.count())

    seen = exposed.select(*PAIR).distinct()
    reach = (
        sizes.withColumn("size", size)
        .where(F.col("size") > 0)
        .withColumn("start", _ring_start(F.col("appname"), F.col("size")))
        .withColumn("reach", F.least(F.col("n_controls") + F.col("n_seen"), F.col("size")))
        .where(F.col("reach") > 0)
    )
    stop = F.col("start") + F.col("reach")
    arcs = F.array(
        F.struct(F.col("start").alias("lo"), F.least(stop, F.col("size")).alias("hi")),
        F.struct(F.lit(0).cast("long").alias("lo"), (stop - F.col("size")).alias("hi")),
    )
    blocks = (
        reach.withColumn("arc", F.explode(arcs))
        .where(F.col("arc.hi") > F.col("arc.lo"))
        .withColumn("block", F.explode(F.expr(f"sequence(arc.lo div {block}, (arc.hi - 1) div {block})")))
        .select("appname", "start", "size", "block", "arc.lo", "arc.hi")
    )
    met = (
        ring.withColumn("block", F.expr(f"pos div {block}"))
        .join(blocks, "block")
        .where((F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi")))
        .select(*PAIR, ((F.col("pos") - F.col("start") + F.col("size")) % F.col("size")).alias("step"))
    )
    free = met.join(seen, PAIR, "left_anti")
    steps = {"_steps": F.expr(f"step div {block}")}
    quota = sizes.select("appname", F.col("n_controls").alias("quota"))
    return numbered(free, ["appname"], steps, [F.col("step")], "_rn", quota).select(*PAIR)


def matched_cohort(exposed: DataFrame, use: DataFrame, population: DataFrame, days: tuple[int, int]) -> DataFrame:
    """Per app: exposed users with use, as many without, and as many unexposed users as both together.

    ``exposed`` has every pair once. What several steps read (pairs with use, the active side, the sizes, the ring of
    users) is written once.
    """
    pairs = stage(active_pairs(use, days), "active_pairs")
    exposed = exposed.select(*PAIR)
    active = stage(exposed.join(pairs, PAIR, "left_semi"), "active_exposed")
    sizes = stage(cohort_sizes(exposed, active), "cohort_sizes")
    quota = sizes.select("appname", F.col("n_active").alias("quota"))
    idle = first_by_hash(exposed.join(pairs, PAIR, "left_anti"), ["appname"], PAIR, quota).select(*PAIR)
    treated = active.unionByName(idle)
    controls = unexposed_controls(population, exposed, sizes)
    return treated.withColumn("is_expose", F.lit(1)).unionByName(controls.withColumn("is_expose", F.lit(0)))
