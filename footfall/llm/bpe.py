"""Byte-level BPE with a minimal acyclic transducer as lexicon.

Frequent words of the corpus are compiled, with the ids they encode to, into an automaton whose equal endings are
shared. The automaton is one flat file that every worker maps into memory. Words outside it are merged pair by pair, so
the result is that of the merge rules for any text.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
import struct
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from footfall.llm.arrow import give_back, map_slices, slices, texts
from footfall.llm.files import publish
from footfall.sources.staging import stage

#: The split of byte-level BPE before merging (fixed value).
SPLIT = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept in the lexicon, and their longest length in bytes.
LEXICON_WORDS, LEXICON_BYTES = 131_072, 48
#: Distinct words that a task keeps at once outside the lexicon.
CACHED = 131_072


def newer_ranges() -> str:
    """Ranges of code points that ``regex`` calls letters or numbers and the tokenizers library, which knows an older Unicode,
    does not: it is asked whether each stays with a letter or number before it. The driver finds them, tasks are told."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    unsure = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    ask = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    cut = [{end for _, (_, end) in ask("".join(f"\n{mark}{c}" for c in unsure))} for mark in "x1"]
    new = [ord(c) for i, c in enumerate(unsure) if all(3 * i + 2 in ends for ends in cut)]
    cuts = [i for i in range(1, len(new)) if new[i] != new[i - 1] + 1]
    return "".join(f"\\U{new[a]:08x}-\\U{new[b - 1]:08x}" for a, b in zip([0, *cuts], [*cuts, len(new)], strict=True) if b)


class Splitter:
    """Cuts texts into the added tokens they hold and the words that are merged on their own. ``new`` are the ranges of
    ``newer_ranges``; how a text is cut depends on nothing but the text."""

    def __init__(self, new: str, added: Iterable[str] = ()):
        self.words = regex.compile(SPLIT).findall
        ascii_split = SPLIT.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(r"\s", " \\t\n\\x0b\f\r")
        ascii_split = ascii_split.replace(" ?A-Za-z+", " ?[A-Za-z]+").replace(" ?0-9+", " ?[0-9]+")
        ascii_split = ascii_split.replace("| \\t\n\\x0b\f\r+", "|[ \\t\n\\x0b\f\r]+").replace(r"(?!\S)", "(?![^ \\t\n\\x0b\f\r])")
        self.ascii_words = re.compile(ascii_split).findall
        self.new = re.compile(f"[{new}]").search if new else lambda _: None
        strict = SPLIT.replace(r"\p{L}+", rf"[\p{{L}}--[{new}]]+").replace(r"\p{N}+", rf"[\p{{N}}--[{new}]]+")
        strict = strict.replace(r"[^\s\p{L}\p{N}]", rf"[^\s[[\p{{L}}\p{{N}}]--[{new}]]]")
        self.strict = regex.compile(strict, regex.V1).findall if new else self.words
        self.added = sorted(added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.added)) + ")").split if self.added else None

    def __call__(self, text: str) -> list[str]:
        words = self.ascii_words if text.isascii() else self.strict if self.new(text) else self.words
        if self.cut and any(a in text for a in self.added):
            return [w for i, part in enumerate(self.cut(text)) for w in ([part] if i % 2 else words(part))]
        return words(text)


class Merger:
    """The merge rules of a tokenizer file: bytes of one word to ids, and ids to bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        # Bytes that print stand for themselves; the others, in order, are shifted beyond 255 (fixed values).
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}
        vocab = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.bytes_of = {i: token for token, i in vocab.items()} | {i: a.encode() for a, i in self.added.items()}
        self.byte_ids = [vocab[bytes([b])] for b in range(256)]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (bytes(byte_of[c] for c in part) for part in (pair.split(" ") if isinstance(pair, str) else pair))
            self.ranks.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))

        order = sorted(self.ranks, key=lambda p: p[0] << 32 | p[1])
        self.pair_keys = np.array([a << 32 | b for a, b in order], np.int64)
        self.pair_ranks = np.array([self.ranks[p][0] for p in order], np.int32)
        self.pair_ids = np.array([self.ranks[p][1] for p in order], np.int32)

    def __call__(self, word: bytes) -> list[int]:
        """Merge the lowest rank first, the leftmost of equals; a heap keeps long words near-linear."""
        ids, ranks = [self.byte_ids[b] for b in word], self.ranks
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(ranks[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != left or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = ranks[left, right][1], -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (p := (ids[a], ids[b])) in ranks:
                    heapq.heappush(heap, (ranks[p][0], a, *p))
        return [i for i in ids if i >= 0]

    def many(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of many words: short ones are merged side by side, a step of all at a time."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((0, 8), (8, 12), (12, 18), (18, 32)):
            rows = np.flatnonzero((size > low) & (size <= high))
            for part in np.array_split(rows, len(rows) // 65_536 + 1):
                if len(part):
                    ids, length = self._side_by_side([words[i] for i in part], size[part], high)
                    for i, own, n in zip(part.tolist(), ids, length.tolist(), strict=True):
                        out[i] = own[:n].copy()
        for i in np.flatnonzero(size > 32).tolist():
            out[i] = np.array(self(words[i]), np.int32)
        return out

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (right >= 0), at, -1)

    def _side_by_side(self, words: list[bytes], length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        never = np.iinfo(np.int32).max
        cols = np.arange(width)
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(-1, width)
        ids = np.where(cols < length[:, None], np.array(self.byte_ids, np.int32)[raw], -1)
        rank = np.full(ids.shape, never, np.int32)
        at = self._lookup(ids[:, :-1], ids[:, 1:])
        rank[:, :-1] = np.where(at >= 0, self.pair_ranks[at], never)
        done, length, live = np.empty_like(ids), length.copy(), np.arange(len(ids))
        while len(live):
            spot = rank.argmin(axis=1)
            row = np.arange(len(live))
            go = rank[row, spot] != never
            if not go.all():
                done[live[~go]] = ids[~go]
                ids, rank, live, spot = ids[go], rank[go], live[go], spot[go]
                row = row[: len(live)]
                if not len(live):
                    break
            merged = self.pair_ids[self._lookup(ids[row, spot], ids[row, spot + 1])]
            source = np.minimum(cols + (cols > spot[:, None]), width - 1)
            last = ids[:, -1] >= 0
            ids, rank = np.take_along_axis(ids, source, 1), np.take_along_axis(rank, source, 1)
            ids[last, -1], rank[:, -1] = -1, never
            ids[row, spot] = merged
            length[live] -= 1
            for side in (spot - 1, spot):
                ok = (side >= 0) & (side + 1 < width)
                r, c = row[ok], side[ok]
                at = self._lookup(ids[r, c], ids[r, c + 1])
                rank[r, c] = np.where(at >= 0, self.pair_ranks[at], never)
        return done, length


def compile_lexicon(words: Iterable[bytes], encode: Callable[[list[bytes]], list[np.ndarray]]) -> bytes:
    """The minimal acyclic automaton of the words, numbered, with the ids of word n at ``starts[n]:starts[n + 1]``.

    Words are added in order. A state that no later word can change is replaced by an equal one met before. The number
    of a word is the count of words that its path leaves aside to the left, which every edge carries as ``skip``.
    """
    words = sorted(set(words))
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    path: list[list] = [[False, []]]  # [final, [(byte, state)]] of the open states along the last word

    def close(depth: int, last: bytes) -> None:
        while len(path) > depth + 1:
            final, edges = path.pop()
            key = (final, tuple(edges))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            path[-1][1].append((last[len(path) - 1], register[key]))

    last = b""
    for word in words:
        same = next((i for i, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
        close(same, last)
        path += [[False, []] for _ in word[same:]]
        path[-1][0], last = True, word
    close(0, last)
    states.append((path[0][0], tuple(path[0][1])))

    size = [0] * len(states)
    keys, to, skip = [], [], []
    for s, (final, edges) in enumerate(states):  # targets come before their sources
        size[s] = int(final)
        for byte, target in edges:
            keys.append(s << 8 | byte)
            to.append(target)
            skip.append(size[s])
            size[s] += size[target]
    ids = encode(words)
    starts = np.cumsum([0, *map(len, ids)])
    arrays = [
        np.array(keys, "<i8"), np.array(to, "<i4"), np.array(skip, "<i4"), np.array([f for f, _ in states], "<i1"),
        starts.astype("<i4"), np.concatenate([*ids, np.zeros(0)]).astype("<i4"),
    ]
    return struct.pack("<6q", *map(len, arrays)) + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A compiled lexicon, mapped into memory from its file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            data = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        at, out = 48, []
        for n, kind in zip(struct.unpack_from("<6q", data), ("<i8", "<i4", "<i4", "<i1", "<i4", "<i4"), strict=True):
            out.append(np.frombuffer(data, kind, n, at))
            at += out[-1].nbytes
        self.keys, self.to, self.skip, self.final, self.starts, self.ids = out

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of every word, -1 for those outside; all words walk the automaton side by side."""
        found = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not words:
            return found
        length = np.fromiter(map(len, words), np.int64, len(words))
        short = np.flatnonzero((length > 0) & (length <= LEXICON_BYTES))
        grid = np.frombuffer(b"".join([words[i].ljust(LEXICON_BYTES, b"\0") for i in short]), np.uint8).reshape(-1, LEXICON_BYTES)
        length, state, number = length[short], np.full(len(short), len(self.final) - 1, np.int64), np.zeros(len(short), np.int64)
        live = np.arange(len(short))
        for step in range(int(length.max(initial=0))):
            live = live[length[live] > step]
            key = state[live] << 8 | grid[live, step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            state[live[~hit]] = -1
            live, at = live[hit], at[hit]
            number[live] += self.skip[at]
            state[live] = self.to[at]
        good = (state >= 0) & (self.final[state] == 1)
        found[short[good]] = number[good]
        return found


class Encoder:
    """Texts to ids, word by word: the words met before, then the lexicon, then the merge rules."""

    def __init__(self, merger: Merger, lexicon: Lexicon | None, new: str):
        self.merger, self.lexicon, self.split = merger, lexicon, Splitter(new, merger.added)
        self.reset()

    def reset(self) -> None:
        added = list(self.merger.added.values())
        self.index: dict[str, int] = {a: n for n, a in enumerate(self.merger.added)}
        self.table, self.length = np.array(added, np.int32), np.ones(len(added), np.int64)

    def learn(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        known = self.lexicon.numbers(raw) if self.lexicon else np.full(len(raw), -1)
        inside, outside = np.flatnonzero(known >= 0).tolist(), np.flatnonzero(known < 0).tolist()
        merged = self.merger.many([raw[i] for i in outside])
        order = [words[i] for i in inside] + [words[i] for i in outside]
        self.index.update(zip(order, range(len(self.length), len(self.length) + len(order)), strict=True))
        parts = [self.table]
        if inside:
            own = np.diff(self.lexicon.starts)
            parts.append(_gather(self.lexicon.ids, own.astype(np.int64), known[known >= 0])[0])
            self.length = np.concatenate([self.length, own[known[known >= 0]]])
        self.table = np.concatenate(parts + merged)
        self.length = np.concatenate([self.length, np.fromiter(map(len, merged), np.int64, len(merged))])

    def __call__(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and the offsets of each text."""
        if len(self.index) > CACHED:
            self.reset()
        split = [self.split(t) for t in batch]
        new = set(chain.from_iterable(split)).difference(self.index)
        if new:
            self.learn(list(new))
        counts = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        flat, ends = _gather(self.table, self.length, at)
        word_ends = np.concatenate([[0], np.cumsum(counts)])
        return flat, np.concatenate([[0], ends])[word_ends]


def _gather(table: np.ndarray, length: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries ``at`` of a ragged table, one after the other, and where each ends."""
    starts, own = np.cumsum(length) - length, length[at]
    ends = np.cumsum(own)
    return table[np.repeat(starts[at] - (ends - own), own) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


class Decoder:
    """Ids to text: the bytes of all tokens in a row, read as UTF-8 with replacement of what is not."""

    def __init__(self, bytes_of: dict[int, bytes]):
        tokens = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        self.table = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.fromiter(map(len, tokens), np.int64, len(tokens))

    def __call__(self, flat: np.ndarray, offsets: np.ndarray) -> list[str]:
        data, ends = _gather(self.table, self.length, flat)
        cuts, data = np.concatenate([[0], ends])[offsets].tolist(), data.tobytes()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, n``: how often every word of the split occurs in all texts, added up in the tasks first.

    A text is cut at blanks before it is counted; the pieces are split afterwards, each with its count.
    """

    new = newer_ranges()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pieces = Splitter(new), Counter()

        def counted() -> pa.RecordBatch:
            words: Counter[str] = Counter()
            for piece, n in pieces.items():
                for word in split(" " + piece):
                    words[word] += n
            pieces.clear()
            return pa.RecordBatch.from_pydict({"word": list(words), "n": list(words.values())})

        for batch in batches:
            for part in slices(batch):
                pieces.update(chain.from_iterable(t.split(" ") for t in texts(part, text)))
                if len(pieces) > CACHED:
                    yield counted()
        if pieces:
            yield counted()
        split = batch = part = None
        give_back()

    return docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer: str, text: str = "text", words: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words of all texts, up to ``words``, and hand the file to the executors; its name is
    returned.

    Frequencies fall into classes, 16 for every doubling; the lexicon takes the highest classes that have no more than
    ``words`` words together. So the driver gets a few hundred counts and then a list of bounded length.
    """
    short = (F.octet_length("word") <= LEXICON_BYTES) & (F.col("n") > 1)
    rank = F.floor(F.log2("n") * 16).cast("int")
    counts = stage(word_counts(docs, text).where(short).select("word", rank.alias("rank")), "word-counts")
    least, left = None, words
    for r in sorted(counts.groupBy("rank").count().collect(), reverse=True):
        left -= r["count"]
        if left < 0:
            break
        least = r["rank"]
    top = counts.where(F.col("rank") >= least).collect() if least is not None else []
    return publish(docs.sparkSession, compile_lexicon((r.word.encode() for r in top), Merger(tokenizer).many), "lexicon")


def encode(docs: DataFrame, tokenizer: str, lexicon: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, ids array<int>`` of every whole text; a null or empty text has no ids.

    Strings of added tokens inside a text become their ids, as in the tokenizers library. Columns other than the two
    named ones are ignored, so clashing names do no harm. Repeated rows give repeated results.
    """
    kind, new = docs.schema[id_col].dataType.simpleString(), newer_ranges()

    def make():
        encoder = Encoder(Merger(tokenizer), Lexicon(SparkFiles.get(lexicon)) if lexicon else None, new)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            flat, offsets = encoder(texts(batch, text))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            return pa.RecordBatch.from_arrays([batch.column(id_col), ids], [id_col, "ids"])

        return work

    return map_slices(docs.select(id_col, text), make, f"{id_col} {kind}, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id") -> DataFrame:
    """``id, ids, decoded string``: the text that the ids stand for; null ids give an empty text."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def make():
        decoder = Decoder(Merger(tokenizer).bytes_of)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column("ids")
            length = np.nan_to_num(np.asarray(ids.value_lengths().fill_null(0)), nan=0).astype(np.int64)
            flat = np.asarray(ids.flatten()).astype(np.int64)
            decoded = decoder(flat, np.concatenate([[0], np.cumsum(length)]))
            return pa.RecordBatch.from_arrays([batch.column(id_col), ids, pa.array(decoded, pa.string())], [id_col, "ids", "decoded"])

        return work

    return map_slices(encoded.select(id_col, "ids"), make, f"{id_col} {kind}, ids array<int>, decoded string")


def round_trip(docs: DataFrame, tokenizer: str, lexicon: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, ids, decoded`` of every whole text: ``decode(encode(...))`` by one Python worker instead of two, with one copy of
    the merge rules."""
    kind, new = docs.schema[id_col].dataType.simpleString(), newer_ranges()

    def make():
        merger = Merger(tokenizer)
        encoder, decoder = Encoder(merger, Lexicon(SparkFiles.get(lexicon)) if lexicon else None, new), Decoder(merger.bytes_of)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            flat, offsets = encoder(texts(batch, text))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            return pa.RecordBatch.from_arrays(
                [batch.column(id_col), ids, pa.array(decoder(flat, offsets), pa.string())], [id_col, "ids", "decoded"]
            )

        return work

    return map_slices(docs.select(id_col, text), make, f"{id_col} {kind}, ids array<int>, decoded string")


def digest(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` of what ``decode`` gives."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
