"""All pairs of vectors with a cosine of at least a threshold, by a pigeonhole over subspaces.

Unit vectors are rotated and split into blocks of a few dimensions. Two vectors whose squared distance is within a budget
have at least one block whose squared distance is within that block's share of it, so a range join per block finds every
pair. In a block the join runs over slabs of its first coordinate, as wide as the block's radius: a vector lies at home in
one slab and visits the next. Large slabs are cut into chunks, and a task compares two chunks tile by tile: one product in
single precision, with slack for its rounding, leaves the pairs that may lie within the block's budget; double precision
decides on those. A pair that several blocks find is taken in the first, and its cosine is worked out anew from the given
vectors.

Tasks return sums and spanning trees of what they link, never the pairs, so a dense group costs no more rows than its
vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.arrow import map_slices
from footfall.llm.graph import components
from footfall.llm.vectors import matrix, usable
from footfall.sources.staging import stage

#: Dimensions of a block, vectors of a chunk, and rows and columns that are compared at once.
BLOCK, CHUNK, TILE = 16, 32768, (256, 1024)
#: Added to a block's budget, so that rounding loses no pair.
SLACK = 1e-9
#: Added in single precision: its products of two blocks of unit vectors and their norms err by less.
COARSE = 1e-4


def rotation(dim: int) -> np.ndarray:
    """A random rotation, the same for every task."""
    return np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))[0]


def budgets(dim: int, cosine: float, block: int = BLOCK) -> tuple[list[slice], np.ndarray]:
    """The blocks, and the share of each in the squared distance that the cosine allows, by its dimensions."""
    cuts = [slice(a, min(a + block, dim)) for a in range(0, dim, block)]
    share = np.array([s.stop - s.start for s in cuts]) / dim
    return cuts, 2 * (1 - cosine) * share + SLACK


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component is brought to 1 first, so that squares neither vanish nor overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def slabs(vectors: DataFrame, cosine: float) -> DataFrame:
    """``rep, n, vector, dim, slabs``: for each block the slab a vector lies in."""
    kind = vectors.schema["vector"].dataType.simpleString()
    rep = vectors.schema["rep"].dataType.simpleString()

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            dims = batch.column("dim").to_pylist()
            out: list = [None] * batch.num_rows
            for dim in set(dims):
                at = [i for i, d in enumerate(dims) if d == dim]
                cuts, budget = budgets(dim, cosine)
                first = unit(matrix(batch.column("vector").take(pa.array(at)))) @ rotation(dim)[:, [c.start for c in cuts]]
                for i, own in zip(at, np.floor(first / np.sqrt(budget)).astype(int).tolist(), strict=True):
                    out[i] = own
            columns = [batch.column(c) for c in ("rep", "n", "vector", "dim")]
            return pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.list_(pa.int32()))], ["rep", "n", "vector", "dim", "slabs"])

        return work

    return map_slices(vectors.withColumn("dim", F.size("vector")), make, f"rep {rep}, n long, vector {kind}, dim int, slabs array<int>")


def tasks(placed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``dim, block, slab, i, j, side, rep, n, vector``: each vector in every pair of chunks it belongs to.

    In a slab, chunks at home meet each other (i <= j) and the visitors from the slab before (side 1, counted on after
    the chunks at home).
    """
    spread = placed.select("rep", "n", "vector", "dim", F.posexplode("slabs").alias("block", "slab"))
    # A slab is as wide as its block's radius and a unit vector lies within 1 of the origin, so this table is bounded.
    counts = spread.groupBy("dim", "block", "slab").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    counts = {(r.dim, r.block, r.slab): r.chunks for r in counts.collect()}
    shape = "dim int, block int, slab int, home int, own int, guests int"
    rows = [(d, b, s, s, n, counts.get((d, b, s - 1), 0)) for (d, b, s), n in counts.items()]
    rows += [(d, b, s, s - 1, n, counts[d, b, s - 1]) for (d, b, s), n in counts.items() if (d, b, s - 1) in counts]
    layout = placed.sparkSession.createDataFrame(rows, shape)
    met = spread.withColumnRenamed("slab", "home").join(layout, ["dim", "block", "home"])
    is_guest = F.col("home") != F.col("slab")
    own = F.pmod(F.xxhash64("rep"), F.when(is_guest, F.col("guests")).otherwise(F.col("own"))).cast("int")
    met = met.withColumn("c", own)
    pair = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    c, n, g = F.col("c"), F.col("own"), F.col("guests")
    upto = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    zero = F.lit(0)
    home = F.concat(
        F.transform(upto(c, n), lambda j: pair(c, j, 0)),
        F.transform(upto(zero, c), lambda i: pair(i, c, 1)),
        F.transform(upto(zero, g), lambda j: pair(c, n + j, 0)),
    )
    guest = F.transform(upto(zero, n), lambda i: pair(i, n + c, 1))
    met = met.withColumn("t", F.explode(F.when(is_guest, guest).otherwise(home)))
    return met.select("dim", "block", "slab", "t.i", "t.j", "t.side", "rep", "n", "vector")


def _roots(labels: np.ndarray) -> np.ndarray:
    while True:
        up = labels[labels]
        if (up == labels).all():
            return labels
        labels = up


def _join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of nodes after links a-b: every component has its least node."""
    while True:
        labels = _roots(labels)
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        labels = labels.copy()
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))


def _gaps(own: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = own[a] - own[b]
    return np.einsum("ij,ij->i", gap, gap)


def near_pairs(own: np.ndarray, left: np.ndarray, right: np.ndarray, budget: float):
    """Pairs of row numbers, one of ``left`` and one of ``right`` (each pair once if they are the same rows), whose squared
    distance in a block is within the budget; those of some tiles at a time.

    A row carries half its negative squared norm and a one, so that a product of two rows is half their negative squared
    distance.
    """
    same, (high, wide) = left is right, TILE
    half = -np.einsum("ij,ij->i", own, own)[:, None] / 2
    one = np.ones_like(half)
    rows = np.hstack([own, half, one]).astype(np.float32)[left]
    columns = np.hstack([own, one, half]).astype(np.float32)[right]
    least = np.float32(-(budget + COARSE) / 2)
    products, hits = np.empty(high * wide, np.float32), np.empty(high * wide, bool)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    for i in range(0, len(rows), high):
        part = rows[i : i + high]
        for j in range(i // wide * wide if same else 0, len(columns), wide):
            other = columns[j : j + wide]
            shape, size = (len(part), len(other)), len(part) * len(other)
            product = np.matmul(part, other.T, out=products[:size].reshape(shape))
            hit = np.flatnonzero(np.greater_equal(product, least, out=hits[:size].reshape(shape)))
            a, b = i + hit // shape[1], j + hit % shape[1]
            if same:
                a, b = a[a < b], b[a < b]
            if len(a):
                a, b = left[a], right[b]
                within = _gaps(own, a, b) <= budget
                found.append((a[within], b[within]))
                waiting += len(found[-1][0])
            if waiting >= high * wide:
                yield tuple(map(np.concatenate, zip(*found, strict=True)))
                found, waiting = [], 0
    if waiting:
        yield tuple(map(np.concatenate, zip(*found, strict=True)))


def compare(cosine: float):
    """For two chunks: ``rep, links, root``, the number of vectors linked to each here, and the least it reaches here."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        dim, block, i, j = (key[k].as_py() for k in (0, 1, 3, 4))
        order = np.argsort(np.asarray(rows.column("rep")), kind="stable")
        rows = rows.take(pa.array(order))
        rep, n, side = (np.asarray(rows.column(c)) for c in ("rep", "n", "side"))
        x = unit(matrix(rows.column("vector")))
        cuts, budget = budgets(dim, cosine)
        turned = x @ rotation(dim)
        left = np.flatnonzero(side == 0)
        right = left if i == j else np.flatnonzero(side == 1)
        links, labels = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for p, q in near_pairs(turned[:, cuts[block]], left, right, budget[block]):
            for cut, limit in zip(cuts[:block], budget[:block], strict=True):  # an earlier block has the pair
                later = _gaps(turned[:, cut], p, q) > limit
                p, q = p[later], q[later]
            linked = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
            p, q = p[linked], q[linked]
            if len(p):
                np.add.at(links, p, n[q])
                np.add.at(links, q, n[p])
                labels = _join_labels(labels, p, q)
        hit = np.flatnonzero(links)
        return pa.table({"rep": pa.array(rep[hit]), "links": pa.array(links[hit]), "root": pa.array(rep[_roots(labels)[hit]])})

    return run


def linked_vectors(rows: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector: str = "embedding", chunk: int = CHUNK) -> DataFrame:
    """``id, n_links long, component_id, kept boolean`` for every row.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; so do rows without an
    id, whose component is null and which are kept. Vectors of different lengths do not link. Copies of a vector are
    compared once, with their number; rows that repeat an id and its vector are one vector.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    good = rows.where(usable(F.col(vector)) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("vector")).distinct()
    copies = stage(good.groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "vectors")
    placed = stage(slabs(copies.select("rep", "n", "vector"), cosine), "slabs")
    pairs = tasks(placed, chunk).groupBy("dim", "block", "slab", "i", "j")
    found = stage(pairs.applyInArrow(compare(cosine), f"rep {kind}, links long, root {kind}"), "links")
    total = found.groupBy("rep").agg(F.sum("links").alias("links"))
    label = components(found.where("rep <> root"), "rep", "root").withColumnRenamed("id", "rep")
    known = copies.join(total, "rep", "left").join(label, "rep", "left")
    member = good.join(known.withColumnRenamed("vector", "v"), F.col("vector") == F.col("v"))
    member = member.select(
        "id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component")
    )
    member = member.groupBy("id").agg(F.sum("links").alias("links"), F.min("component").alias("component"))
    out = rows.select(id_col).join(member, F.col(id_col) == F.col("id"), "left")
    component = F.coalesce("component", id_col)
    return out.select(
        id_col,
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (component.isNull() | (component == F.col(id_col))).alias("kept"),
    )


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (
  SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.b, r.root FROM reach r JOIN pairs p ON p.a = r.id),
least AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id),
degree AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least ON id = vec_id LEFT JOIN degree ON a = vec_id
"""
