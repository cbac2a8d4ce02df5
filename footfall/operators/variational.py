"""Online variational Bayes for many topic models at once, in NumPy blocks inside Spark tasks.

MLlib fits one model at a time and infers one document at a time. Here a task infers blocks of documents, for all models of a
sweep, from one reading. Draws are MLlib's (same documents in a round, same starting points), and so is the rule that stops, so
that a sweep says of every model what MLlib says of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 4096  # documents inferred together: few calls, and arrays that fit a cache
SEEDED = 8192  # documents whose starting points are drawn together
SHAPE = 100.0  # starting points are gamma(100, 1/100)
SETTLED = 1e-3  # mean change of a document's topic weights at which it is done
TINY = 1e-100
ID_BITS = 33  # rows are numbered within their partition, which stands above these bits
LEARNING_OFFSET, LEARNING_DECAY = 1024.0, 0.51
STATS = "model int, n long, stat array<double>, log_theta array<double>"
BOUNDS = "model int, bound double"


def _shifted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``y`` and ``s`` with digamma(x) = ln(y) + s: six steps of its recurrence, then its series."""
    u = x * (x + 5.0)
    steps = (2.0 * x + 5.0) * ((3.0 * u + 20.0) * u + 24.0)
    steps /= u * (u + 4.0) * (u + 6.0)
    y = x + 6.0
    r = 1.0 / y
    z = r * r
    s = z * (1.0 / 240.0)
    s -= 1.0 / 252.0
    s *= z
    s += 1.0 / 120.0
    s *= z
    s -= 1.0 / 12.0
    s *= z
    r *= 0.5
    s -= r
    s -= steps
    return y, s


def digamma(x: np.ndarray) -> np.ndarray:
    y, s = _shifted(x)
    return np.log(y) + s


def exp_digamma(x: np.ndarray) -> np.ndarray:
    """exp(digamma(x)), without a logarithm."""
    y, s = _shifted(x)
    np.exp(s, out=s)
    s *= y
    return s


def trigamma(x: np.ndarray) -> np.ndarray:
    steps = sum(1.0 / (x + i) ** 2 for i in range(10))
    y = x + 10.0
    z = 1.0 / (y * y)
    return steps + 1.0 / y + z / 2.0 + z / y * (1.0 / 6.0 - z * (1.0 / 30.0 - z * (1.0 / 42.0 - z / 30.0)))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive values."""
    u = x * (x + 5.0)
    y = x + 6.0
    z = 1.0 / (y * y)
    series = (1.0 / 12.0 - z * (1.0 / 360.0 - z * (1.0 / 1260.0 - z / 1680.0))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2.0 * np.pi) + series - np.log(u) - np.log(u + 4.0) - np.log(u + 6.0)


def expected_logs(weights: np.ndarray) -> np.ndarray:
    """Expected logarithms under Dirichlet distributions, one per row."""
    return digamma(weights) - digamma(weights.sum(axis=-1, keepdims=True))


def _words(seeds: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` 32-bit words of a Mersenne twister for every 64-bit seed, one column per seed."""
    bits = seeds.astype(np.int64).view(np.uint64)
    keys = [(bits >> np.uint64(32)).astype(np.uint32), bits.astype(np.uint32)]
    if n > 624 - 397:  # beyond the first words the state turns over
        twisters = (np.random.RandomState(np.array(k)) for k in zip(*keys, strict=True))
        return np.stack([t.randint(0, 1 << 32, n, np.uint32) for t in twisters], axis=1)
    state = np.empty((624, len(seeds)), np.uint32)
    first = np.random.RandomState(19650218).get_state()[1]
    add = [keys[0], keys[1] + np.uint32(1)]
    t = np.empty(len(seeds), np.uint32)

    def mix(at: int, before: int, by: int) -> None:
        np.right_shift(state[before], np.uint32(30), out=t)
        np.bitwise_xor(t, state[before], out=t)
        np.multiply(t, np.uint32(by), out=t)
        np.bitwise_xor(t, state[at], out=state[at])

    state[:] = first[:, None]
    for step in range(624):
        at = step % 623 + 1
        mix(at, at - 1, 1664525)
        state[at] += add[step % 2]
        if at == 623:
            state[0] = state[623]
    for step in range(623):
        at = (step + 1) % 623 + 1
        mix(at, at - 1, 1566083941)
        state[at] -= np.uint32(at)
        if at == 623:
            state[0] = state[623]
    state[0] = np.uint32(0x80000000)
    both = (state[:n] & np.uint32(0x80000000)) | (state[1 : n + 1] & np.uint32(0x7FFFFFFF))
    out = state[397 : 397 + n] ^ (both >> np.uint32(1)) ^ ((both & np.uint32(1)) * np.uint32(0x9908B0DF))
    out ^= out >> np.uint32(11)
    out ^= (out << np.uint32(7)) & np.uint32(0x9D2C5680)
    out ^= (out << np.uint32(15)) & np.uint32(0xEFC60000)
    out ^= out >> np.uint32(18)
    return out


def _accepted(x: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gamma variates from normal and uniform ones, and which of them are kept (Marsaglia and Tsang)."""
    d = SHAPE - 1.0 / 3.0
    root = 1.0 + x / np.sqrt(9.0 * d)
    v = root * root * root  # a power's last digit is not the same for arrays and single numbers on every processor
    x2 = x * x
    with np.errstate(divide="ignore", invalid="ignore"):
        kept = (v > 0) & ((u < 1.0 - 0.0331 * x2 * x2) | (np.log(u) < 0.5 * x2 + d * (1.0 - v + np.log(v))))
    return d * v / SHAPE, kept


def _one_by_one(uniform: np.ndarray, k: int) -> np.ndarray | None:
    """Starting point of one document with variates that were not kept; ``None`` if the numbers run out."""
    out, spare, at = [], None, 0
    while len(out) < k:
        if at + 3 > len(uniform):
            return None
        if spare is None:
            r, angle = np.sqrt(-2.0 * np.log(uniform[at + 1])), 2.0 * np.pi * uniform[at]
            x, spare, at = r * np.cos(angle), r * np.sin(angle), at + 2
        else:
            x, spare = spare, None
        if 1.0 + x / np.sqrt(9.0 * (SHAPE - 1.0 / 3.0)) <= 0:
            continue
        value, kept = _accepted(np.float64(x), uniform[at])
        at += 1
        if kept:
            out.append(value)
    return np.array(out)


def starting_points(seeds: np.ndarray, k: int) -> np.ndarray:
    """``k`` gamma variates for every seed, one row per seed. Fewer topics start from the first of them."""
    pairs = (k + 1) // 2

    def uniform_of(some: np.ndarray, n: int) -> np.ndarray:
        w = _words(some, 2 * n) >> np.uint32(6)
        return (w[0::2] * 67108864.0 + w[1::2]) * 2.0**-52

    uniform = uniform_of(seeds, 4 * pairs + 8)
    drawn = uniform[: 4 * pairs].reshape(pairs, 4, -1)
    r, angle = np.sqrt(-2.0 * np.log(drawn[:, 1])), 2.0 * np.pi * drawn[:, 0]
    x = np.stack([r * np.cos(angle), r * np.sin(angle)], axis=1).reshape(2 * pairs, -1)
    found, kept = _accepted(x, drawn[:, 2:].reshape(2 * pairs, -1))
    out = np.ascontiguousarray(found[:k].T)
    for i in np.flatnonzero(~kept[:k].all(axis=0)):
        n, again = 4 * pairs + 8, _one_by_one(uniform[:, i], k)
        while again is None:
            n = max(2 * n, 128)
            again = _one_by_one(uniform_of(seeds[i : i + 1], n)[:, 0], k)
        out[i] = again
    return out


@dataclass
class Topics:
    """One model between rounds: ``weights`` of terms (topics x terms), ``alpha`` of topics, ``eta`` of terms."""

    k: int
    weights: np.ndarray
    alpha: np.ndarray
    eta: float
    rounds: int = 0

    def learn(self, n: int, stat: np.ndarray, log_theta: np.ndarray, size: int, fraction: float) -> None:
        """One round's step, from the sums over its ``n`` documents that hold anything; ``size`` is that of the corpus."""
        self.rounds += 1
        if not n:
            return
        rate = (LEARNING_OFFSET + self.rounds) ** -LEARNING_DECAY
        scaled = stat * np.exp(expected_logs(self.weights)) * (size / np.ceil(fraction * size))
        self.weights = (1.0 - rate) * self.weights + rate * (scaled + self.eta)
        gradient = n * (log_theta / n - expected_logs(self.alpha))
        c, q = n * trigamma(self.alpha.sum()), -n * trigamma(self.alpha)
        b = (gradient / q).sum() / (1.0 / c + (1.0 / q).sum())
        alpha = self.alpha - rate * (gradient - b) / q
        if (alpha > 0).all():
            self.alpha = alpha

    def topics_bound(self) -> float:
        """The part of the likelihood's bound that belongs to the topics."""
        w, n_terms = self.weights, self.weights.shape[1]
        eta = np.float64(self.eta)
        bound = ((eta - w) * expected_logs(w)).sum() + (log_gamma(w) - log_gamma(eta)).sum()
        return float(bound + (log_gamma(eta * n_terms) - log_gamma(w.sum(axis=1))).sum())


def infer(x: np.ndarray, beta: np.ndarray, alpha: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Topic weights of a block of documents (rows of ``x``), ``exp_digamma`` of them, and the chances of all terms.

    ``beta`` is topics x terms. A document is done when its weights change by no more than ``SETTLED`` on average, whatever the
    others do.
    """
    n, k = start.shape
    back = np.ascontiguousarray(beta.T)
    gammas, thetas, chances = np.empty((n, k)), np.empty((n, k)), np.empty(x.shape)
    which, gamma = np.arange(n), start
    theta = exp_digamma(gamma)
    # MLlib divides ``theta`` by what its topics have in common, which cancels out.
    chance = theta @ beta + TINY
    while len(which):
        last = gamma
        gamma = (x / chance) @ back
        gamma *= theta
        gamma += alpha
        theta = exp_digamma(gamma)
        chance = theta @ beta
        chance += TINY
        change = gamma - last
        np.abs(change, out=change)
        live = change @ np.ones(k) > SETTLED * k
        done = ~live
        if done.any():
            at = which[done]
            gammas[at], thetas[at], chances[at] = gamma[done], theta[done], chance[done]
            which, x, gamma, theta, chance = which[live], x[live], gamma[live], theta[live], chance[live]
    return gammas, thetas, chances


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and values of the documents that hold anything."""
    for batch in batches:
        values = batch.column("x").flatten().to_numpy(zero_copy_only=False)
        x = values.reshape(batch.num_rows, -1)
        full = (x != 0).any(axis=1)
        ids = batch.column("id").to_numpy(zero_copy_only=False)[full]
        x = x[full]
        for i in range(0, len(ids), SEEDED):
            yield ids[i : i + SEEDED], x[i : i + SEEDED]


def round_sums(models: list[Topics], seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's sums for one round of all models; documents of a partition share their starting point."""
    most = max(m.k for m in models)
    given = [(m.k, np.exp(expected_logs(m.weights)), m.alpha) for m in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, stats, logs = 0, [np.zeros(beta.shape) for _, beta, _ in given], [np.zeros(k) for k, _, _ in given]
        for ids, x in _blocks(batches):
            n += len(ids)
            parts, part = np.unique(ids >> ID_BITS, return_inverse=True)
            with np.errstate(over="ignore"):
                start = starting_points(parts + np.int64(seed), most)[part]
            for i in range(0, len(ids), BLOCK):
                docs, first = x[i : i + BLOCK], start[i : i + BLOCK]
                for j, (k, beta, alpha) in enumerate(given):
                    gamma, theta, chance = infer(docs, beta, alpha, first[:, :k])
                    stats[j] += theta.T @ (docs / chance)
                    logs[j] += expected_logs(gamma).sum(axis=0)
        if n:
            columns = [range(len(given)), [n] * len(given), [s.ravel() for s in stats], logs]
            doubles = pa.list_(pa.float64())
            kinds = [pa.int32(), pa.int64(), doubles, doubles]
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["model", "n", "stat", "log_theta"])

    return run


def bound_sums(models: list[Topics], seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's part of the likelihood's bound under every model; every document has its own starting point."""
    most = max(m.k for m in models)
    given = [(m.k, np.exp(expected_logs(m.weights)), m.alpha) for m in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [0.0] * len(given)
        for ids, x in _blocks(batches):
            with np.errstate(over="ignore"):
                start = starting_points(ids + np.int64(seed), most)
            for i in range(0, len(ids), BLOCK):
                docs, first = x[i : i + BLOCK], start[i : i + BLOCK]
                for j, (k, beta, alpha) in enumerate(given):
                    gamma, _, chance = infer(docs, beta, alpha, first[:, :k])
                    total = gamma.sum(axis=1)
                    logs = expected_logs(gamma)
                    terms = (docs * np.log(chance)).sum() - (docs.sum(axis=1) * digamma(total)).sum()
                    theta = ((alpha - gamma) * logs).sum() + (log_gamma(gamma) - log_gamma(alpha)).sum()
                    sums[j] += terms + theta + (log_gamma(alpha.sum()) - log_gamma(total)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(given)), pa.int32()), pa.array(sums)], ["model", "bound"])

    return run
