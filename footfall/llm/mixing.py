"""Mixing sources to target weights, as a flow of least cost from groups of documents to source quotas.

Documents are aggregated by the set of sources they belong to. A group can give each of its words up to ``epochs``
times; the first time is cheap and each repetition dearer, so the flow that fills the quotas at least cost repeats as
little as it can and leaves documents of many sources to the quotas that need them. What a group gives is then cut into
documents: whole rounds of the group, and a seeded selection for the rest.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.sources.staging import stage

#: Words are runs of other characters than these (fixed value).
WORD = r"[^\x20\x09-\x0D]+"
#: Buckets that one level of the selection cuts a group into, and documents that a last bucket may hold on average.
BUCKETS, LAST = 4096, 512
#: Units on either side of the edge among which the nearest sum is looked for.
WINDOW = 32
#: Distinct sets of sources and sources that the flow accepts. They are names, whose number does not grow with the rows.
MOST_GROUPS = 100_000


def word_count(text: Column) -> Column:
    """Runs of characters that are not white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shares(sizes: dict[str | None, int], cap: float = 3.0, cycle: tuple[int, ...] = (1, 2, 3), total: float | None = None) -> dict[str | None, float]:
    """Targets by weight. Sources by code point, null last, take the weights of ``cycle`` in turn and share ``total`` (the
    sum of sizes); a source stops at ``cap`` times its size, and the others share what is left over by weight."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    left, target, open_ = float(sum(sizes.values()) if total is None else total), {}, list(names)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > cap * sizes[s]]
        if not over:
            return target | {s: unit * weight[s] for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ = [s for s in open_ if s not in target]
    return target


def least_cost_flow(groups: list[tuple[tuple, int]], quota: dict[str | None, float], epochs: int = 3) -> list[float]:
    """Words that each group gives: a flow from groups (members, words) to their sources that fills the quotas as far as
    the links allow, at least total cost.

    The n-th use of a word costs 2n - 1, which grows with n. Shortest augmenting paths with node prices: a path may take
    back what an earlier one sent from a group to another source, so the result is optimal.
    """
    sources = list(quota)
    g, s = len(groups), len(sources)
    node = {name: g + 1 + i for i, name in enumerate(sources)}
    end = g + s + 1
    graph: list[list[int]] = [[] for _ in range(end + 1)]
    to, room, cost = [], [], []

    def arc(a: int, b: int, capacity: float, price: float) -> int:
        for head, free, c, tail in ((b, capacity, price, a), (a, 0.0, -price, b)):
            graph[tail].append(len(to))
            to.append(head)
            room.append(free)
            cost.append(c)
        return len(to) - 2

    uses = []
    for i, (members, words) in enumerate(groups, 1):
        uses.append([arc(0, i, float(words), 2.0 * n + 1) for n in range(epochs)])
        for m in dict.fromkeys(members):
            arc(i, node[m], float("inf"), 0.0)
    for name, amount in quota.items():
        arc(node[name], end, amount, 0.0)
    price, tiny = [0.0] * (end + 1), 1e-9 * max(1.0, sum(quota.values()))
    while True:
        far, via = [float("inf")] * (end + 1), [-1] * (end + 1)
        far[0], queue = 0.0, [(0.0, 0)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for e in graph[a]:
                if room[e] > tiny and (n := d + cost[e] + price[a] - price[to[e]]) < far[to[e]] - 1e-12:
                    far[to[e]], via[to[e]] = n, e
                    heapq.heappush(queue, (n, to[e]))
        if via[end] < 0:
            break
        price = [p + min(d, far[end]) for p, d in zip(price, far, strict=True)]
        path, b = [], end
        while b:
            path.append(via[b])
            b = to[via[b] ^ 1]
        sent = min(room[e] for e in path)
        for e in path:
            room[e] -= sent
            room[e ^ 1] += sent
    return [sum(room[e ^ 1] for e in own) for own in uses]


def _buckets(n: int) -> int:
    """Buckets for a group of n documents: one if it is small, else so many that one holds about ``LAST``."""
    return 1 if n <= 8 * LAST else min(BUCKETS, 1 << (n // LAST).bit_length())


def nearest_subset(sizes: list[int], need: float) -> list[bool]:
    """Which of a few sizes add up nearest to ``need``, earlier ones first; sums are the bits of one number.

    Beyond four million bits the sizes are rounded to a coarser unit.
    """
    unit = max(1, sum(sizes) >> 22)
    steps = [round(s / unit) for s in sizes]
    sums = [1]
    for s in steps:
        sums.append(sums[-1] | sums[-1] << s)
    goal = min(max(0, round(need / unit)), sum(steps))
    below = (sums[-1] & ((1 << goal + 1) - 1)).bit_length() - 1
    more = sums[-1] >> goal
    above = goal + (more & -more).bit_length() - 1
    at = below if goal - below <= above - goal else above
    taken = []
    for s, before in zip(reversed(steps), reversed(sums[:-1]), strict=True):
        taken.append(not before >> at & 1)
        at -= s * taken[-1]
    return taken[::-1]


def select(units: DataFrame, need: DataFrame) -> DataFrame:
    """``group, place, size``: units (documents of one place) that add up to nearly ``need`` words of their group.

    Units stand in the order of a seeded hash (``place``). The first buckets of that order go in whole; only the bucket
    where the need is met is looked at closer, cut again and again until it is small. There, the units around the edge are
    chosen so that the sum comes nearest.
    """
    spark = units.sparkSession
    group = units.schema["group"].dataType.simpleString()
    shape = f"group {group}, left double, low long, width long"
    rest, chosen = units, units.select("group", "place", "size").limit(0)
    counted = units.groupBy("group").agg(F.sum("n").alias("n")).join(need, "group").collect()  # one row per group
    state = [(r.group, r.need, 0, 1 << 62, r.n) for r in counted]
    while any(n > 8 * LAST and width > 1 for *_, width, n in state):
        finer = [(g, left, low, max(1, width // _buckets(n))) for g, left, low, width, n in state]
        inside = rest.join(F.broadcast(spark.createDataFrame(finer, shape)), "group")
        inside = inside.withColumn("bucket", F.expr("(place - low) div width"))
        sums = inside.groupBy("group", "bucket", "left", "low", "width").agg(F.sum("words").alias("words"), F.sum("n").alias("n"))
        before = "sum(words) OVER (PARTITION BY group ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        reach = sums.withColumn("before", F.expr(f"coalesce({before}, 0)")).where(F.col("before") <= F.col("left"))
        # The last bucket that begins within the need is cut again.
        edge = reach.groupBy("group").agg(F.max_by(F.struct("bucket", "before", "n", "left", "low", "width"), "bucket").alias("e"))
        edges = [(r.group, *r.e) for r in edge.collect()]
        cut = inside.drop("left", "low", "width").join(F.broadcast(spark.createDataFrame([e[:2] for e in edges], f"group {group}, at long")), "group")
        chosen = chosen.unionByName(cut.where(F.col("bucket") < F.col("at")).select("group", "place", "size"))
        rest = stage(cut.where(F.col("bucket") == F.col("at")).select("group", "place", "size", "words", "n"), "mix-edge")
        state = [(g, left - before, low + bucket * width, width, n) for g, bucket, before, n, left, low, width in edges]

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "size"])
        left, words = float(rows["left"].iloc[0]), rows["words"].tolist()
        edge = int((rows["words"].cumsum() <= left).sum())
        low = max(0, edge - WINDOW)
        taken = [True] * low + nearest_subset(words[low : edge + WINDOW], left - sum(words[:low]))
        taken += [False] * (len(words) - len(taken))
        return rows.loc[taken, ["group", "place", "size"]]

    last = rest.join(F.broadcast(spark.createDataFrame([s[:2] for s in state], f"group {group}, left double")), "group")
    fitted = last.groupBy("group").applyInPandas(fit, f"group {group}, place long, size long")
    return chosen.unionByName(fitted)


def mix(docs: DataFrame, sources: str, size: str, epochs: int = 3, seed: int = 17, id_col: str = "doc_id") -> DataFrame:
    """All rows and columns of ``docs`` with ``source_size long, target double, times int, taken long``.

    ``sources`` names an array of the sources a document belongs to (a null element is a source of its own; a null or
    empty array belongs to none and is not taken), ``size`` its words. ``source_size`` and ``target`` are those of the
    first source of the array. A document is taken ``times`` times, 0 to ``epochs``, always whole, and repeated rows of
    an id are taken alike; documents without words are taken once, as they cost nothing. Targets are met up to about one
    small document per group, if the documents that belong to a source suffice.
    """
    spark = docs.sparkSession
    members = F.coalesce(F.col(sources), F.array().cast("array<string>"))
    key = F.to_json(F.struct(F.sort_array(F.array_distinct(members)).alias("m")), {"ignoreNullFields": "false"})
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col).cast("string")), 2)
    rows = docs.select("*", key.alias("__group"), place.alias("__place"))
    totals = rows.groupBy("__group").agg(F.first(members).alias("m"), F.sum(size).alias("words")).limit(MOST_GROUPS + 1).collect()
    if len(totals) > MOST_GROUPS:
        raise ValueError(f"documents form more than {MOST_GROUPS} sets of sources")
    totals.sort(key=lambda r: r["__group"])
    sizes: dict[str | None, int] = {}
    for r in totals:
        for m in dict.fromkeys(r.m):
            sizes[m] = sizes.get(m, 0) + r.words
    target = shares(sizes, float(epochs), total=sum(r.words for r in totals if r.m))
    flow = least_cost_flow([(tuple(r.m), r.words) for r in totals], target, epochs)
    plan = []
    for r, given in zip(totals, flow, strict=True):
        whole = min(int(given // r.words) if r.words else 0, epochs)
        rest = given - whole * r.words
        if r.words and rest < 1e-6 * r.words:
            rest = 0.0
        elif r.words and rest > r.words * (1 - 1e-6) and whole < epochs:
            whole, rest = whole + 1, 0.0
        plan.append((r["__group"], whole, float(rest)))
    # One row per set of sources, which MOST_GROUPS bounds: small enough for every task.
    plan_df = F.broadcast(spark.createDataFrame(plan, "group string, whole int, need double"))

    counted = rows.where(F.col(size) > 0).join(plan_df.where("need > 0"), F.col("__group") == F.col("group"))
    units = counted.groupBy("group", F.col("__place").alias("place"), F.col(size).alias("size"))
    units = stage(units.agg(F.sum(size).alias("words"), F.count("*").alias("n")), "mix-units")
    if any(need > 0 for _, _, need in plan):
        extra = select(units, plan_df.where("need > 0").select("group", "need"))
    else:
        extra = units.select("group", "place", "size")
    extra = extra.select(F.col("group").alias("__g"), F.col("place").alias("__p"), F.col("size").alias("__s"), F.lit(1).alias("__more"))
    known = [(s, n, float(target[s])) for s, n in sizes.items()]
    known = F.broadcast(spark.createDataFrame(known, "__source string, source_size long, target double"))
    first = F.get(members, F.lit(0))
    out = (
        rows.drop("source_size", "target", "times", "taken")
        .join(plan_df.select(F.col("group").alias("__pg"), F.col("whole").alias("__whole")), F.col("__group") == F.col("__pg"), "left")
        .join(extra, (F.col("__group") == F.col("__g")) & (F.col("__place") == F.col("__p")) & (F.col(size) == F.col("__s")), "left")
        .join(known, first.eqNullSafe(F.col("__source")) & (F.size(members) > 0), "left")
    )
    times = F.when(F.size(members) == 0, 0).when(F.col(size) == 0, 1).otherwise(F.col("__whole") + F.coalesce("__more", F.lit(0)))
    out = out.withColumn("times", times.cast("int")).withColumn("taken", (F.col("times") * F.col(size)).cast("long"))
    own = [c for c in docs.columns if c not in ("source_size", "target", "times", "taken")]
    return out.select(*own, "source_size", "target", "times", "taken")

