"""Near-duplicate documents by BagMinHash signatures of their word shingles.

A document is a bag of shingles of five words, each with its number of occurrences as weight. For every shingle and
every dyadic piece of the weight axis a Poisson process sends points, in the order of time, to the components of the
signature; a component keeps its earliest point. Two bags agree in a component with the probability of their weighted
Jaccard similarity. Late points cannot matter, so a process stops as soon as all components have an earlier one: a long
document costs about one point per shingle, whatever the length of the signature.

Bands of components that agree make candidates, and the bags of the texts decide. Exact copies are put together first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.arrow import map_slices, slices, texts
from footfall.llm.graph import components
from footfall.sources.staging import stage

SHINGLE, SIMILARITY = 5, 0.8
#: 24 bands of 5 components: a pair at similarity 0.8 is missed with probability 7e-5, one at 0.85 with 1e-6.
BANDS, ROWS = 24, 5
#: Members of a bucket that all others are compared with first; members of a chunk of a large bucket, and their shingles.
HUBS, CHUNK, LOAD = 2, 2048, 1 << 20
#: Signatures that agree in fewer components than the similarity less this are not looked at closer. At similarity 0.8
#: and 120 components that is five standard deviations: one pair in a million is lost.
MARGIN = 0.18
#: Ids that are broadcast at most, to pick their texts in the scan: 16 MB.
SHORT_LIST = 1_000_000
#: Words whose hash a task keeps, and bytes of text it shingles at once: a byte of text takes some 50 of memory on its way.
CACHED, PIECE = 1 << 16, 1 << 20
U64 = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits look independent (splitmix64)."""
    x = (x + U64(0x9E3779B97F4A7C15)).astype(U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Bags:
    """The bags of many texts, flat: the text a shingle belongs to, its 64 bits and its count, by text and shingle."""

    def __init__(self, of: np.ndarray, shingles: np.ndarray, counts: np.ndarray, n: int):
        self.of, self.shingles, self.counts, self.n = of, shingles, counts, n
        self.ends = np.searchsorted(of, np.arange(n + 1))

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.ends[i], self.ends[i + 1])
        return self.shingles[own], self.counts[own]


class Shingler:
    """Texts to bags. Words are runs of letters, digits and underscores in small letters; a text of fewer than five words
    is one shingle, and one without words an empty bag."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.words, self.hashes = size, re.compile(r"\w+").findall, {}

    def __call__(self, batch: list[str]) -> Bags:
        split = [self.words(text.lower()) for text in batch]
        if len(self.hashes) > CACHED:
            self.hashes.clear()
        hashes, length = self.hashes, np.fromiter(map(len, split), np.int64, len(split))
        for word in set(chain.from_iterable(split)).difference(hashes):
            hashes[word] = xxhash.xxh64_intdigest(word)
        codes = np.fromiter(map(hashes.__getitem__, chain.from_iterable(split)), U64, int(length.sum()))
        # A shingle begins at every word that has enough words after it, and at the first of a short text.
        begin = np.cumsum(length) - length
        place = np.arange(len(codes)) - np.repeat(begin, length)
        room = np.repeat(length, length) - place
        starts = np.flatnonzero((room >= self.size) | (place == 0))
        rolled, room = codes[starts], room[starts]
        for i in range(1, self.size):
            more = room > i
            rolled[more] = mixed(rolled[more] ^ codes[starts[more] + i])
        of = np.repeat(np.arange(len(split)), length)[starts]
        order = np.lexsort((rolled, of))
        of, rolled = of[order], rolled[order]
        first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (rolled[1:] != rolled[:-1])][: len(of)])
        return Bags(of[first], rolled[first], np.diff(np.r_[first, len(of)]), len(split))


def signature(bags: Bags, size: int) -> np.ndarray:
    """The BagMinHash signatures of bags: for every component the time of its earliest point, infinite for empty bags.

    Weight w takes the pieces [0, 1), [1, 2), [2, 4), [4, 8) ... up to w. The process of a piece has its length as rate.
    The last piece may lie within the weight only in part; its points have places, halved again and again by the bits
    of a hash, and those beyond the weight are left out. All processes make their next point together. One ends with its
    first point beyond the time at which the components of its bag are very likely filled; a bag that is not is done
    again with more time.
    """
    keys, rates, rooms, owners = [], [], [], []
    level, low = 0, 0
    while (inside := bags.counts > low).any():
        high = max(1, 2 * low)
        keys.append(mixed(bags.shingles[inside] ^ mixed(np.array([0xA0761D6478BD642F + level], U64))))
        rates.append(np.full(len(keys[-1]), float(high - low)))
        rooms.append(np.minimum(bags.counts[inside] - low, high - low) / (high - low))
        owners.append(bags.of[inside])
        level, low = level + 1, high
    best = np.full(bags.n * size, np.inf)
    if not keys:
        return best.reshape(bags.n, size)
    key, rate, room, owner = map(np.concatenate, (keys, rates, rooms, owners))
    weight, horizon = np.maximum(np.bincount(bags.of, bags.counts, bags.n), 1.0), np.log(size) + 3.0
    redo = np.ones(bags.n, bool)
    while redo.any():
        limit, live, n = horizon / weight, np.flatnonzero(redo[owner]), 0
        time = np.zeros(len(live))
        while len(live):
            n += 1
            bits = mixed(key[live] + U64(n * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
            time = time - np.log1p(-((bits >> U64(11)) * 2.0**-53)) / (rate[live] * size)
            on = time <= limit[owner[live]]
            live, time, more = live[on], time[on], mixed(bits[on])
            counted = ((more >> U64(32)) * 2.0**-32) < room[live]
            at = owner[live] * size + ((more & U64(0xFFFFFFFF)) % U64(size)).astype(np.int64)
            np.minimum.at(best, at[counted], time[counted])
        redo = ~np.isfinite(best.reshape(bags.n, size)).all(axis=1) & (np.diff(bags.ends) > 0)
        horizon += 6.0
    return best.reshape(bags.n, size)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Sizes of the intersection and union of two bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    return common, int(a[1].sum() + b[1].sum()) - common


def signatures(docs: DataFrame, id_col: str, text: str, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """``doc, f1, f2, bands, mini, weight``: a 128-bit fingerprint of the bag, a key per band, 16 bits of every component,
    and the size of the bag. Empty bags and null ids have no row."""

    def make():
        bags_of = Shingler(shingle)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            bags = bags_of(texts(batch))
            full = np.flatnonzero(np.diff(bags.ends))
            prints = []
            for x in (bags.shingles, ~bags.shingles):
                sums = np.cumsum(np.r_[U64(0), mixed(x) * bags.counts.astype(U64)], dtype=U64)  # modulo 2^64
                prints.append((sums[bags.ends[1:]] - sums[bags.ends[:-1]])[full].view(np.int64))
            own = signature(bags, bands * rows).view(U64).reshape(bags.n, bands, rows)[full]
            key = np.tile(np.arange(bands, dtype=U64), (len(full), 1))
            for r in range(rows):
                key = mixed(key ^ own[:, :, r])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1) * bands, pa.int32()), pa.array(key.ravel().view(np.int64)))
            mini = pa.array([x.tobytes() for x in mixed(own.reshape(len(full), bands * rows)).astype(np.uint16)], pa.binary())
            weight = pa.array(np.add.reduceat(np.r_[bags.counts, 0], bags.ends[:-1])[full].astype(np.int64))
            columns = [batch.column("doc").take(pa.array(full)), pa.array(prints[0]), pa.array(prints[1]), lists, mini, weight]
            return pa.RecordBatch.from_arrays(columns, ["doc", "f1", "f2", "bands", "mini", "weight"])

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text).alias("text"))
    return map_slices(named, make, f"doc {kind}, f1 long, f2 long, bands array<long>, mini binary, weight long", PIECE)


def likely(pairs: DataFrame, minis: DataFrame, least: float) -> DataFrame:
    """Those of ``a, b`` whose signatures agree in a share of at least ``least``; ``minis`` has ``doc, mini``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("x", "y"))
                near = (x == y).mean(axis=1) >= least
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near))

    kind = minis.schema["doc"].dataType.simpleString()
    both = pairs.join(minis.select(F.col("doc").alias("a"), F.col("mini").alias("x")), "a")
    both = both.join(minis.select(F.col("doc").alias("b"), F.col("mini").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, f"a {kind}, b {kind}")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of every value of ``keys``, which come one after the other, as one table each."""
    held: pa.Table | None = None
    for batch in chain(batches, [None]):
        table = held if batch is None else pa.Table.from_batches([*(held.to_batches() if held else []), batch])
        if table is None or not table.num_rows:
            continue
        work = np.stack([table.column(k).to_numpy() for k in keys])
        cuts = np.r_[0, np.flatnonzero((work[:, 1:] != work[:, :-1]).any(axis=0)) + 1, table.num_rows].tolist()
        if batch is not None:  # the last group may go on
            held = table.slice(cuts[-2])
            cuts.pop()
        for low, high in zip(cuts, cuts[1:]):
            yield table.slice(low, high - low).combine_chunks()


class Members:
    """One task's work: members of two chunks of a bucket, the left ones first, or of one chunk."""

    def __init__(self, rows: pa.Table, similarity: float):
        n = rows.num_rows
        self.least, self.similarity = similarity - MARGIN, similarity
        self.key, self.places = rows.column("key")[0].as_py(), np.arange(n)
        #: Labels of the classes known so far.
        self.label = np.unique(rows.column("component").to_numpy(), return_inverse=True)[1]
        right, self.alone = rows.column("right").to_numpy(), rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
        self.left, self.right = (self.places, self.places) if self.alone else (self.places[~right], self.places[right])
        self.mini = np.frombuffer(b"".join(rows.column("mini").to_pylist()), np.uint16).reshape(n, -1)
        self.bands = pc.list_flatten(rows.column("bands")).to_numpy().reshape(n, -1)
        self.weight = rows.column("weight").to_numpy()

    def partners(self, i: int) -> np.ndarray:
        """Members of other classes than ``i`` that it is to be compared with here: their signatures are alike, their
        sizes allow the similarity, and this is the first bucket that both are in."""
        with_ = self.right[self.right > i] if self.alone else self.right
        with_ = with_[self.label[with_] != self.label[i]]
        low, high = np.minimum(self.weight[with_], self.weight[i]), np.maximum(self.weight[with_], self.weight[i])
        with_ = with_[low >= self.similarity * high - 1e-9]
        with_ = with_[(self.mini[with_] == self.mini[i]).mean(axis=1) >= self.least]
        same = self.bands[with_] == self.bands[i]
        return with_[~same.any(axis=1) | (self.bands[i][same.argmax(axis=1)] == self.key)]


def close_members(members: DataFrame, profiles: DataFrame, similarity: float, chunk: int = CHUNK, load: int = LOAD) -> DataFrame:
    """The members of a bucket that have a partner in it: ``key, i, j, right, rep, component, mini, bands, weight``.

    ``members`` has ``key, rep, component, weight``, ``profiles`` has ``doc, mini, bands, weight``. Rows of a bucket come to
    one task one after the other; a bucket of more than ``chunk`` members or ``load`` shingles is cut, and every two of its
    chunks, ``i`` and ``j``, are a task's work. Members leave a task once, however many partners they have.
    """
    n_chunks = F.ceil(F.greatest(F.count("*") / chunk, F.sum("weight") / load)).cast("int")
    sizes = members.groupBy("key").agg(n_chunks.alias("chunks"))
    c = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(j, "c").alias("i"), F.greatest(j, "c").alias("j"), (j < F.col("c")).alias("right")))
    dealt = members.drop("weight").join(sizes, "key").withColumn("c", c).withColumn("t", F.explode(others)).select("key", "t.*", "rep", "component")
    dealt = dealt.join(profiles.withColumnRenamed("doc", "rep"), "rep").select("key", "i", "j", "right", "rep", "component", "mini", "bands", "weight")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "right", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ["key", "i", "j"]):
            work, close = Members(rows, similarity), np.zeros(rows.num_rows, bool)
            if work.label.max() == 0:
                continue
            for i in work.left:
                found = work.partners(i)
                close[found] = True
                close[i] |= len(found) > 0
            yield from rows.filter(pa.array(close)).to_batches()

    return dealt.mapInArrow(run, dealt.schema)


def flat_bags(named: DataFrame, shingle: int) -> DataFrame:
    """``doc, shingles, counts``: the bags of ``doc, text`` as bytes."""

    def make():
        bags_of = Shingler(shingle)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            bags = bags_of(texts(batch))
            own = [bags[i] for i in range(bags.n)]
            flat = [pa.array([x.tobytes() for x, _ in own], pa.binary()), pa.array([n.astype(np.uint32).tobytes() for _, n in own], pa.binary())]
            return pa.RecordBatch.from_arrays([batch.column("doc"), *flat], ["doc", "shingles", "counts"])

        return work

    return map_slices(named, make, f"doc {named.schema['doc'].dataType.simpleString()}, shingles binary, counts binary", PIECE)


def bucket_links(close: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: links of similar bags that join up what is linked within a task's work; ``close`` as of ``close_members``,
    ``bags`` as of ``flat_bags``.

    A task looks at every pair of partners whose classes it has not joined yet, and returns a link only where it joins two:
    fewer links than members, however many pairs are alike or compared in vain.
    """
    kind = close.schema["rep"].dataType.simpleString()
    dealt = close.join(bags.where(F.octet_length("counts") > 0).withColumnRenamed("doc", "rep"), "rep")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "right", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ["key", "i", "j"]):
            work = Members(rows, similarity)
            size = pc.binary_length(rows.column("counts")).to_numpy() // 4
            end = np.cumsum(size, dtype=np.int64)
            begin = end - size
            counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.uint32).astype(np.int64)
            shingles = np.unique(np.frombuffer(b"".join(rows.column("shingles").to_pylist()), U64), return_inverse=True)[1]
            total, own, a, b = np.add.reduceat(counts, begin), np.zeros(len(counts), np.int64), [], []
            for i in work.left:
                with_ = work.partners(i)
                if not len(with_):
                    continue
                here = slice(begin[i], end[i])
                own[shingles[here]] = counts[here]
                offset = np.cumsum(size[with_]) - size[with_]
                flat = np.repeat(begin[with_] - offset, size[with_]) + np.arange(int(size[with_].sum()))
                common = np.add.reduceat(np.minimum(counts[flat], own[shingles[flat]]), offset)
                own[shingles[here]] = 0
                alike = with_[common >= similarity * (total[i] + total[with_] - common) - 1e-9]
                joined, first = np.unique(work.label[alike], return_index=True)
                a += [i] * len(first)
                b += alike[first].tolist()
                work.label[np.isin(work.label, joined)] = work.label[i]
            if a:
                rep = rows.column("rep").combine_chunks()
                yield pa.RecordBatch.from_arrays([rep.take(pa.array(x)) for x in (a, b)], ["a", "b"])

    return dealt.select(*close.columns, "shingles", "counts").mapInArrow(run, f"a {kind}, b {kind}")


def texts_of(named: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc, text`` of the given ``doc``; a short list of ids is broadcast, so that other texts do not move."""
    few = ids.limit(SHORT_LIST + 1).count() <= SHORT_LIST
    return named.join(F.broadcast(ids) if few else ids, "doc", "left_semi").groupBy("doc").agg(F.min("text").alias("text"))


def verified(pairs: DataFrame, named: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Those of ``a, b`` whose bags are similar enough; ``named`` has ``doc, text``. Pairs of one ``a`` come together, so
    that its bag is made once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags_of = Shingler(shingle)
        for batch in batches:
            for piece in slices(batch, size=PIECE):
                a, left = piece.column("a").to_pylist(), texts(piece, "left")
                fresh = [i for i in range(len(a)) if not i or a[i] != a[i - 1]]
                place = np.cumsum([not i or a[i] != a[i - 1] for i in range(len(a))]) - 1
                lefts, rights, good = bags_of([left[i] for i in fresh]), bags_of(texts(piece, "right")), []
                for i in range(len(a)):
                    common, union = overlap(lefts[place[i]], rights[i])
                    good.append(common >= similarity * union - 1e-9)
                yield pa.RecordBatch.from_arrays([piece.column("a"), piece.column("b")], ["a", "b"]).filter(pa.array(good))

    kind = named.schema["doc"].dataType.simpleString()
    rights = pairs.join(named.select(F.col("doc").alias("b"), F.col("text").alias("right")), "b")
    both = rights.join(named.select(F.col("doc").alias("a"), F.col("text").alias("left")), "a")
    return both.select("a", "b", "left", "right").mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    shingle: int = SHINGLE,
) -> DataFrame:
    """``id, class_id, kept``: the smallest id that a document reaches over links of similarity, one row per document.

    First all members of a bucket are compared with two of them, so that a bucket of near copies becomes one class with
    few pairs. Then every two members of a bucket that are in different classes are compared inside the tasks: by their
    signatures, and by their bags where those are alike. Tasks return links that join classes, never all pairs.

    Documents without words are classes of their own, and so are rows without an id, whose ``class_id`` is null and
    which are kept. Rows of one id are one document.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sketch = stage(signatures(docs, id_col, text, bands, rows, shingle), "signatures")
    classes = sketch.groupBy("f1", "f2").agg(F.min("doc").alias("rep"), *(F.first(c).alias(c) for c in ("bands", "mini", "weight")))
    classes = stage(classes, "classes")
    keys = classes.select("rep", "weight", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = stage(keys.join(shared, "key"), "buckets")
    profiles = classes.groupBy(F.col("rep").alias("doc")).agg(F.min(F.struct("mini", "bands", "weight")).alias("p")).select("doc", "p.*")
    named = docs.select(F.col(id_col).alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull())

    def texts_for(ids: DataFrame) -> DataFrame:
        return texts_of(named, stage(ids.distinct(), "pair-ids"))

    place = F.row_number().over(Window.partitionBy("key").orderBy("rep"))
    hubs = members.withColumn("place", place).where(F.col("place") <= HUBS).select("key", F.col("rep").alias("a"))
    stars = members.join(hubs, "key").where("a < rep").select("a", F.col("rep").alias("b")).distinct()
    pairs = stage(likely(stars, profiles.select("doc", "mini"), similarity - MARGIN), "pairs")
    ends = pairs.select(F.col("a").alias("doc")).union(pairs.select("b"))
    links = stage(verified(pairs, stage(texts_for(ends), "pair-texts"), similarity, shingle), "links")
    label = stage(components(links), "labels")
    known = members.join(label, F.col("rep") == F.col("id"), "left").select("key", "rep", "weight", F.coalesce("component", "rep").alias("component"))
    several = known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    open_ = stage(known.join(several.select("key"), "key", "left_semi"), "open-buckets")
    close = stage(close_members(open_, profiles, similarity), "close-members")
    bags = flat_bags(texts_for(close.select(F.col("rep").alias("doc"))), shingle)
    more = stage(bucket_links(close, bags, similarity), "links")
    label = stage(components(links.unionByName(more)), "labels")
    member = sketch.select("doc", "f1", "f2").join(classes.select("f1", "f2", "rep"), ["f1", "f2"])
    member = member.join(label, F.col("rep") == F.col("id"), "left").select("doc", F.coalesce("component", "rep").alias("class"))
    member = member.groupBy("doc").agg(F.min("class").alias("class"))
    out = docs.select(id_col).join(member, F.col(id_col) == F.col("doc"), "left")
    class_id = F.coalesce("class", id_col)
    return out.select(id_col, class_id.alias("class_id"), (class_id.isNull() | (class_id == F.col(id_col))).alias("kept"))
