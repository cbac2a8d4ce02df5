"""Topic models of user-days: fits, terms, daily shares and the topic calendar of a user."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from footfall.functions.numeric import first_argmax
from footfall.operators import variational
from footfall.operators.features import USER_DAY, feature_vectors
from footfall.sources.staging import stage, staging_path

# The settings of the original fits.
SEED = 36
MAX_ITER = 50
SWEEP = range(3, 21)
TOP_TERMS = 20
NO_TOPIC = -1
BATCH = 0.05  # share of the rows that MLlib draws, with replacement, in a round

RUN = 65536  # places numbered from one row
LIKELIHOOD_TASKS = 4  # per core
BOUND_ROWS = 256  # whose topics x terms are held at a time, so that they fit a cache


def vector_rows(scaled: DataFrame, names: list[str]) -> DataFrame:
    """Feature vectors, written once because every fit and the mixes of its model read them."""
    return stage(feature_vectors(scaled, names, USER_DAY), "training_rows")


def dealt(vectors: DataFrame, n_partitions: int) -> DataFrame:
    """Written vectors in a fixed layout, to fit on.

    How written files are read back depends on the number of cores, and the fits draw their samples per partition. So
    the rows are dealt and sorted again on the way in: ``n_partitions`` belongs to the model, like its seed. What a model says
    of a row does not depend on the layout; mixes are taken from the written rows, by as many tasks as there are cores.
    """
    return vectors.repartition(n_partitions, "imei").sortWithinPartitions(*USER_DAY)


def training_rows(scaled: DataFrame, names: list[str], n_partitions: int) -> DataFrame:
    """Feature vectors, written and dealt out to fit on."""
    return dealt(vector_rows(scaled, names), n_partitions)


@contextmanager
def _cached(rows: DataFrame) -> Iterator[DataFrame]:
    """Keep the rows in memory while fits read them; a lost executor reads and deals its part again."""
    rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield rows
    finally:
        rows.unpersist()


def _fit(rows: DataFrame, k: int, max_iter: int, seed: int = SEED) -> LDAModel:
    return LDA(k=k, seed=seed, maxIter=max_iter, optimizer="online").fit(rows)


def fit_topics(rows: DataFrame, k: int, max_iter: int = MAX_ITER, seed: int = SEED) -> LDAModel:
    with _cached(rows):
        return _fit(rows, k, max_iter, seed)


def sweep(
    rows: DataFrame,
    ks: Iterable[int] = SWEEP,
    max_iter: int = MAX_ITER,
    parallelism: int = 4,
    keep: Callable[[int, LDAModel], None] | None = None,
) -> DataFrame:
    """Log likelihood and log perplexity for each number of topics.

    All models of a sweep draw the same user-days in a round, so a round is one job for all of them, and so are the likelihoods.
    ``keep`` is handed every fitted model, to write what should stay of it; such models are MLlib's, and several fits run side
    by side.
    """
    ks = list(ks)
    if keep or not ks:
        found, weight = _sweep_kept(rows, ks, max_iter, parallelism, keep)
    else:
        found, weight = _sweep_together(rows, ks, max_iter, parallelism)
    fits = [(k, -value / weight, value) for k, value in zip(ks, found, strict=True)]
    return rows.sparkSession.createDataFrame(fits, "k int, log_perplexity double, log_likelihood double")


def _total(rows: DataFrame) -> float:
    return float(rows.agg(Summarizer.sum(F.col("features"))).first()[0].toArray().sum())


def _sweep_kept(
    rows: DataFrame, ks: list[int], max_iter: int, parallelism: int, keep: Callable[[int, LDAModel], None] | None
) -> tuple[list[float], float]:
    def likelihood(k: int) -> float:
        model = _fit(rows, k, max_iter)
        keep(k, model)
        return model.logLikelihood(rows)

    with _cached(rows), ThreadPool(parallelism) as pool:
        weight = _total(rows)
        return pool.map(inheritable_thread_target(rows.sparkSession)(likelihood), ks), weight


def _sweep_together(rows: DataFrame, ks: list[int], max_iter: int, parallelism: int) -> tuple[list[float], float]:
    """The scores of MLlib's fits, from its draws and its rules.

    MLlib gives the topics to start from. The driver holds topics and sums over a round, as in MLlib; rows are read by all cores.
    """
    spark = rows.sparkSession
    numbered = stage(rows.select(F.monotonically_increasing_id().alias("id"), "features"), "sweep_rows")
    weight = _total(numbered)
    terms = len(numbered.first()["features"])
    one = spark.createDataFrame([(Vectors.sparse(terms, []),)], ["features"])

    def start(k: int) -> tuple[variational.Topics, int]:
        model = _fit(one, k, 0)
        weights = model.topicsMatrix().toArray().T.copy()
        seed = model._java_obj.oldLocalModel().getSeed()  # likelihoods have their own, which Python does not show
        return variational.Topics(k, weights, model.estimatedDocConcentration().toArray(), 1.0 / k), seed

    with ThreadPool(parallelism) as pool:
        begun = pool.map(inheritable_thread_target(spark)(start), ks)
    models = [m for m, _ in begun]
    seeds, drawn, size = _batches(numbered, max_iter)
    for i, seed in seeds:
        batch = _arrays(drawn.where(F.col("round") == i))
        parts = batch.mapInArrow(variational.round_sums(models, seed), variational.STATS).collect()
        for j, m in enumerate(models):
            mine = [p for p in parts if p["model"] == j]
            stat = sum((np.array(p["stat"]) for p in mine), np.zeros(m.weights.size)).reshape(m.weights.shape)
            logs = sum((np.array(p["log_theta"]) for p in mine), np.zeros(m.k))
            m.learn(sum(p["n"] for p in mine), stat, logs, size, BATCH)
    spread = numbered.repartition(LIKELIHOOD_TASKS * spark.sparkContext.defaultParallelism, "id")
    bounds = _arrays(spread).mapInArrow(variational.bound_sums(models, begun[0][1]), variational.BOUNDS)
    sums = {r["model"]: r["bound"] for r in bounds.groupBy("model").agg(F.sum("bound").alias("bound")).collect()}
    return [sums.get(j, 0.0) + m.topics_bound() for j, m in enumerate(models)], weight


def _arrays(rows: DataFrame) -> DataFrame:
    return rows.select("id", vector_to_array("features").alias("x"))


def _batches(numbered: DataFrame, max_iter: int) -> tuple[list[tuple[int, int]], DataFrame, int]:
    """The rows that every round draws, as MLlib draws them, written by round: rounds with their seeds, rows, size of the corpus.

    A sample depends on the places of the rows in their partitions, so places are drawn and meet their rows in one join. A round
    that draws nothing is left out.
    """
    spark = numbered.sparkSession
    part = F.shiftright("id", variational.ID_BITS)
    counts = {r[0]: r[1] for r in numbered.groupBy(part).count().collect()}
    sizes = F.array(*(F.lit(counts.get(p, 0)).cast("long") for p in range(max(counts) + 1)))
    runs = spark.range(0, max(counts) + 1, 1, max(counts) + 1).select("id", sizes[F.col("id").cast("int")].alias("n"))
    firsts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long")))
    cut = runs.where("n > 0").select("id", "n", firsts.alias("lo"))
    place = F.explode(F.sequence("lo", F.least(F.col("lo") + RUN, F.col("n")) - 1, F.lit(1).cast("long"))).alias("place")
    ids = cut.select("id", place).select((F.shiftleft("id", variational.ID_BITS) + F.col("place")).alias("id"))
    places, shape = ids._jdf.javaRDD(), ids._jdf.schema()
    draw = spark._jvm.java.util.Random(SEED)
    draw.nextLong()  # what the topics started from
    seeds, samples = [], []
    for i in range(max_iter):
        sample = places.sample(True, BATCH, draw.nextLong())
        if sample.isEmpty():
            continue
        seeds.append((i, draw.nextLong()))
        found = DataFrame(spark._jsparkSession.createDataFrame(sample, shape), spark)
        samples.append(found.select(F.lit(i).alias("round"), "id"))
    if not samples:
        return [], numbered, sum(counts.values())
    drawn = reduce(DataFrame.unionAll, samples).join(numbered, "id").select("id", "features", "round")
    path = staging_path(spark, "sweep_batches")
    drawn.write.partitionBy("round").parquet(path)
    return seeds, spark.read.schema(drawn.schema).parquet(path), sum(counts.values())


def topic_terms(model: LDAModel, names: list[str], n_terms: int = TOP_TERMS) -> DataFrame:
    """The heaviest categories of every topic with weights to two digits."""
    terms = model.describeTopics(n_terms).select(
        "topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("pos", "t")
    )
    labels = F.array(*(F.lit(c) for c in names))
    return terms.select(
        "topic",
        (F.col("pos") + 1).alias("rank"),
        labels[F.col("t.termIndices")].alias("term"),
        F.round("t.termWeights", 2).alias("weight"),
    )


def term_weights(model: LDAModel, names: list[str]) -> DataFrame:
    """The weight of every category in every topic; a topic's weights add up to 1."""
    terms = model.describeTopics(len(names)).select("topic", F.explode(F.arrays_zip("termIndices", "termWeights")).alias("t"))
    labels = F.array(*(F.lit(c) for c in names))
    return terms.select("topic", labels[F.col("t.termIndices")].alias("term"), F.col("t.termWeights").alias("weight"))


def heaviest_terms(weights: DataFrame, n_terms: int = TOP_TERMS) -> DataFrame:
    """Rank, category and rounded weight of the heaviest categories, from the whole weights."""
    rank = F.row_number().over(W.partitionBy("topic").orderBy(F.desc("weight"), "term"))
    ranked = weights.withColumn("rank", rank).where(F.col("rank") <= n_terms)
    return ranked.select("topic", "rank", "term", F.round("weight", 2).alias("weight"))


def likelihood_bounds(mixes: DataFrame, weights: DataFrame, names: list[str]) -> DataFrame:
    """How likely every user-day is under a model: ``size, likelihood, bound, one_topic``, from its mix and the terms alone.

    ``mixes`` are user-days with their ``features`` and ``mix``. ``likelihood`` adds up the logarithms of the categories'
    probabilities. ``bound`` is Jensen's bound with the share of each topic in each category, which meets the likelihood when the
    shares belong to the mix; ``one_topic`` is the likelihood under the categories' overall shares, which is what a model
    without topics says. Weights and overall shares are read at once; the rows go to NumPy in blocks, as Spark's functions on arrays
    take each of a row's topics x terms through an interpreter. Every row has its features and mix.
    """
    by_topic = F.array_sort(F.collect_list(F.struct("topic", "weight")))
    listed = weights.groupBy("term").agg(F.transform(by_topic, lambda t: t["weight"]).alias("w"))
    position = F.array_position(F.array(*map(F.lit, names)), F.col("term"))
    table = listed.agg(F.array_sort(F.collect_list(F.struct(position.alias("pos"), "w"))).alias("all"))
    beta = table.select(F.transform("all", lambda t: t["w"])).first()[0]  # names x topics
    rows = mixes.select(*USER_DAY, vector_to_array("features").alias("x"), "mix")
    sums = rows.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("v"))
    ordered = sums.agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("all"), F.sum("v").alias("total"))
    shares = ordered.select(F.transform("all", lambda t: t["v"] / F.col("total"))).first()[0]
    keys = [rows.schema[c] for c in USER_DAY]
    found = [StructField(c, DoubleType()) for c in ("size", "likelihood", "bound", "one_topic")]
    return rows.mapInArrow(_row_bounds(np.array(beta), np.array(shares)), StructType([*keys, *found]))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _logs(amounts: np.ndarray, chances: np.ndarray) -> pa.Array:
    """Logarithms of the chances of a row's terms, as often as they occur; null if a term that occurs has no chance."""
    there = ~(amounts <= 0)
    found = np.multiply(amounts, np.log(chances, where=there, out=np.zeros(there.shape)), where=there, out=np.zeros(there.shape))
    return pa.array(found.sum(axis=1), mask=(there & (chances <= 0)).any(axis=1))


def _row_bounds(beta: np.ndarray, shares: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sizes, likelihoods and bounds of the rows of a task, a block of rows x terms x topics at a time."""

    def jensen(joint: np.ndarray, p: np.ndarray) -> np.ndarray:
        there = ~(joint <= 0)
        part = np.divide(joint, p[:, :, None], where=there, out=np.ones(joint.shape))
        logs = np.divide(joint, part, where=there, out=np.ones(joint.shape))
        return np.einsum("rtk,rtk->rt", part, np.log(logs, out=logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BOUND_ROWS):
                piece = batch.slice(at, BOUND_ROWS)
                x, mix = _matrix(piece, "x"), _matrix(piece, "mix")
                joint = beta * mix[:, None, :]
                p = joint.sum(axis=2)
                with np.errstate(divide="ignore", invalid="ignore"):
                    bound = (x * jensen(joint, p)).sum(axis=1)
                    likelihood, one_topic = _logs(x, p), _logs(x, np.broadcast_to(shares, x.shape))
                columns = [*map(piece.column, USER_DAY), pa.array(x.sum(axis=1)), likelihood, pa.array(bound), one_topic]
                yield pa.RecordBatch.from_arrays(columns, [*USER_DAY, "size", "likelihood", "bound", "one_topic"])

    return run


def topic_mix(model: LDAModel, rows: DataFrame) -> DataFrame:
    """Topic weights of every user-day as an array."""
    return model.transform(rows).select(*USER_DAY, vector_to_array("topicDistribution").alias("mix"))


def topic_share(mix: DataFrame, by: list[str], k: int, values: str = "mix") -> DataFrame:
    """Share of each topic in the summed weights of a group, such as a city and day."""
    sums = mix.groupBy(*by).agg(*(F.sum(F.col(values)[i]).alias(f"t{i}") for i in range(k)))
    total = sum((F.col(f"t{i}") for i in range(1, k)), F.col("t0"))
    return sums.select(*by, *((F.col(f"t{i}") / F.nullif(total, F.lit(0.0))).alias(f"topic{i}") for i in range(k)))


def dominant_topic(mix: DataFrame, values: str = "mix", alias: str = "topic") -> DataFrame:
    """Position of the heaviest topic; the first one if several are equal."""
    return mix.withColumn(alias, first_argmax(F.col(values))).drop(values)


def topic_calendar(days_of_user: DataFrame, days: list[int]) -> DataFrame:
    """One row per user with the topic of every day in ``days``; -1 marks a day without use."""
    entries = F.collect_list(F.struct("dayno", "topic"))
    wanted = days_of_user.where(F.col("dayno").isin(days))
    users = wanted.groupBy("city", "imei").agg(F.map_from_entries(entries).alias("by_day"))
    cells = [F.coalesce(F.col("by_day")[F.lit(d)], F.lit(NO_TOPIC)) for d in days]
    return users.select("city", "imei", F.array(*cells).alias("calendar"))


def calendar_columns(calendar: DataFrame, days: list[int]) -> DataFrame:
    """The calendar array as one column per day."""
    return calendar.select("city", "imei", *(F.col("calendar")[i].alias(f"d{d}") for i, d in enumerate(days)))
