"""Token counts by a finite-state transducer compiled from a BPE piece model.

The tokens of a prefix change only at its end when a character is added, so a bounded memory decides what comes next:
for every piece that the text may be in the middle of, the token before it and how many tokens ended there. That memory
is the state; a transition carries the change of the token count. States and transitions are made on demand and kept.

A long text is cut into chunks. Every chunk becomes a map from entry states to exit states and counts, and the maps of a
text are composed by a prefix scan, so no chunk waits for the one before it.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from footfall.llm.arrow import map_slices, texts

#: What a blank becomes in pieces (fixed value).
BLANK = "▁"
#: Characters of a chunk; transitions and counted words that a task keeps.
CHUNK, TRANSITIONS, WORDS = 16_384, 800_000, 600_000
START = 0


class Pieces:
    """The pieces of a model with their scores, and the merge procedure for short strings."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model.serialized_model_proto())
        norm, train = spec.normalizer_spec, spec.trainer_spec
        if train.model_type != train.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or train.treat_whitespace_as_suffix:
            raise ValueError("only BPE models without normalisation, with a dummy prefix, are compiled")
        plain = [p for p in spec.pieces if p.type == p.NORMAL]
        if any(BLANK in p.piece.lstrip(BLANK) for p in plain) or any(p.type in (p.USER_DEFINED, p.UNUSED) for p in spec.pieces):
            raise ValueError("only models whose pieces begin with their blanks, without pieces of the user, are compiled")
        self.score = {p.piece: p.score for p in plain}
        self.byte_fallback = any(p.type == p.BYTE for p in spec.pieces)
        self._known: dict[tuple, object] = {}
        self.prefixes = {p[:n] for p in self.score for n in range(1, len(p))}

    def known(self, what: Callable, *about: object) -> object:
        """The result of a method of this object, worked out once."""
        key = (what.__name__, *about)
        if key not in self._known:
            self._known[key] = what(*about)
        return self._known[key]

    def stays(self, piece: str) -> bool:
        return self.merge(piece) == [piece]

    def edge(self, piece: str, side: int) -> list[tuple[str, float, float]] | None:
        """The symbols at the left (0) or right (1) edge while a piece forms, with the cost at which each is made and
        used up. None if the costs do not rise, so that they say nothing about the order of merges."""
        out, used = [], float("inf")
        while True:
            made = -self.score[piece] if len(piece) > 1 else float("-inf")
            if made >= used or not self.known(self.stays, piece):
                return None
            out.append((piece, made, used))
            if len(piece) == 1:
                return out
            piece, used = self.known(self.last_merge, piece)[side], made

    def last_merge(self, piece: str) -> tuple[str, str]:
        made: list[tuple[str, str]] = []
        self.merge(piece, made)
        return made[-1]

    def stay(self, left: str, right: str) -> bool:
        """Whether two tokens in a row are not merged over their border.

        The border falls if a symbol at the end of the left token and one at the start of the right token exist at the
        same time, and joining them is cheaper than what else uses them up; of equal costs the left goes first.
        """
        ends, starts = self.known(self.edge, left, 1), self.known(self.edge, right, 0)
        if ends is None or starts is None:
            return self.merge(left + right) == [left, right]
        for a, made_a, used_a in ends:
            for b, made_b, used_b in starts:
                if (joined := self.score.get(a + b)) is not None:
                    cost = -joined
                    if made_a >= used_b or made_b >= used_a:
                        continue  # never there together
                    if cost < min(used_a, used_b):
                        if cost > max(made_a, made_b):
                            return False
                        return self.merge(left + right) == [left, right]
                    if cost in (used_a, used_b):
                        return self.merge(left + right) == [left, right]
        return True

    def merge(self, text: str, made: list[tuple[str, str]] | None = None) -> list[str]:
        """Merge the pair of the best score first, the leftmost of equals; ``made`` receives the pairs."""
        parts, after, before = list(text), [*range(1, len(text)), -1], [*range(-1, len(text) - 1)]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (both := parts[i] + parts[j]) in self.score:
                heapq.heappush(heap, (-self.score[both], i, j, both))

        for i in range(len(text) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if after[i] != j or not parts[i] or parts[i] + parts[j] != both:
                continue
            if made is not None:
                made.append((parts[i], parts[j]))
            parts[i], parts[j], after[i] = both, "", after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p]


class Transducer:
    """States reached so far, and for each the next state and emitted tokens by character.

    A state is its memory: for every end of the text that begins a piece, that end, the token before it (none at the
    start of a word or after an unknown character) and the tokens counted there, relative to now. A negative emission
    takes back tokens that the new character has merged.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.reset()

    def reset(self) -> None:
        start = (("", None, 0),)
        self.states, self.number = [start], {(start, False): START}
        self.inside = [False]  # whether the last character was not a blank
        #: state and character to the next state and emitted tokens, each pair packed in one number
        self.move: dict[int, int] = {}
        self.fits: dict[tuple[str | None, str], bool] = {}

    def _fits(self, left: str | None, right: str) -> bool:
        """Whether two tokens next to each other stay as they are."""
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            known = self.fits[key] = self.pieces.stays(right) if left is None else self.pieces.stay(left, right)
        return known

    def _state(self, memory: tuple, inside: bool) -> int:
        key = (memory, inside)
        at = self.number.get(key)
        if at is None:
            at = self.number[key] = len(self.states)
            self.states.append(memory)
            self.inside.append(inside)
        return at

    def step(self, key: int) -> int:
        """Make the transition from a state by a character."""
        at, char = key >> 21, chr(key & 0x1FFFFF)
        score, prefixes, memory = self.pieces.score, self.pieces.prefixes, self.states[at]
        if char == BLANK and self.inside[at]:  # no piece goes on over the end of a word
            hit = self.move.get(ord(char)) or self.step(ord(char))
        elif char not in score:
            emitted = len(char.encode("utf-8", "surrogatepass")) if self.pieces.byte_fallback else 1
            hit = self._state((("", None, 0),), True) << 8 | emitted + 128
        else:
            grown = [(own + char, last, count) for own, last, count in memory]
            found = [g for g in grown if g[0] in score and self._fits(g[1], g[0])]
            if len(found) != 1:
                raise ValueError(f"the pieces do not give one tokenization after {memory}: {found}")
            token, emitted = found[0][0], found[0][2] + 1
            kept = [(own, last, count - emitted) for own, last, count in grown if own in prefixes]
            kept.append(("", token, 0))
            hit = self._state(tuple(kept), char != BLANK) << 8 | emitted + 128
        self.move[key] = hit
        return hit

    def run(self, at: int, text: str) -> tuple[int, int]:
        """Exit state and emitted tokens of a text read from a state."""
        total, move = 0, self.move
        for char in text:
            key = at << 21 | ord(char)
            hit = move.get(key) or self.step(key)
            at, total = hit >> 8, total + (hit & 255) - 128
        return at, total

    def run_all(self, words: list[str]) -> np.ndarray:
        """Emitted tokens of many words from the start; all are read side by side, each distinct move looked up once."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        begin, size = (np.cumsum(size) - size)[order], size[order]
        state, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        live = len(words)
        for place in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size[:live], -place, "left"))
            keys, back = np.unique(state[:live] << 21 | flat[begin[:live] + place], return_inverse=True)
            move, step = self.move, self.step
            hits = np.fromiter((move.get(k) or step(k) for k in keys.tolist()), np.int64, len(keys))[back]
            state[:live] = hits >> 8
            total[:live] += (hits & 255) - 128
        out = np.empty(len(words), np.int64)
        out[order] = total
        return out


class Counter:
    """Token counts of texts: words are read by the transducer once, chunks are composed."""

    def __init__(self, pieces: Pieces, chunk: int = CHUNK):
        self.transducer, self.chunk = Transducer(pieces), chunk
        self.counts: dict[str, int] = {}
        self.words = re.compile(f"{BLANK}+[^{BLANK}]*").findall
        self.border = re.compile(f"[^{BLANK}]{BLANK}").search

    def __call__(self, batch: list[str]) -> list[int]:
        if len(self.counts) > WORDS:
            self.counts.clear()
        if len(self.transducer.move) > TRANSITIONS:
            self.transducer.reset()
        chunks, heads, first = [], [], []
        for text in batch:
            first.append(len(chunks))
            whole = BLANK + text.replace(" ", BLANK) if text else ""
            for at in range(0, len(whole), self.chunk):
                part = whole[at : at + self.chunk]
                cut = 0 if at == 0 else found.start() + 1 if (found := self.border(part)) else len(part)
                heads.append(part[:cut])
                chunks.append(self.words(part, cut))
        new = list(set(chain.from_iterable(chunks)).difference(self.counts))
        self.counts.update(zip(new, self.transducer.run_all(new).tolist(), strict=True))
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        flat = np.fromiter(map(self.counts.__getitem__, chain.from_iterable(chunks)), np.int64, int(size.sum()))
        ends = np.concatenate([[0], np.cumsum(flat)])[np.concatenate([[0], np.cumsum(size)])]
        body = np.diff(ends).tolist()
        out = []
        for a, b in zip(first, [*first[1:], len(chunks)], strict=True):
            out.append(sum(body[a:b]) if b - a < 2 else self.compose(heads[a:b], [c[-1] if c else None for c in chunks[a:b]], body[a:b]))
        return out

    def compose(self, heads: list[str], tails: list[str | None], body: list[int]) -> int:
        """Count a text from the state maps of its chunks.

        A chunk in which a word begins leaves in a state that does not depend on where it was entered; only its head,
        the rest of the word before, does. The maps are tables over all states in which some chunk can leave.
        """
        run = self.transducer.run
        leaves = [None if t is None else run(START, t)[0] for t in tails]
        entries = list(dict.fromkeys([START, *(s for s in leaves if s is not None)]))
        through = [h for h, s in zip(heads, leaves, strict=True) if s is None]
        place = {s: n for n, s in enumerate(entries)}
        for state in entries if through else ():  # the list grows while chunks without a border lead to new states
            for head in through:
                if (end := run(state, head)[0]) not in place:
                    place[end] = len(entries)
                    entries.append(end)
        exits = np.empty((len(heads), len(entries)), np.int64)
        counts = np.empty_like(exits)
        for c, (head, leave, n) in enumerate(zip(heads, leaves, body, strict=True)):
            for e, state in enumerate(entries):
                end, emitted = run(state, head)
                exits[c, e], counts[c, e] = place[end if leave is None else leave], emitted + n
        step = 1
        while step < len(heads):  # inclusive scan: every map takes in the one `step` before it
            before, own = exits[:-step], counts[:-step]
            late = np.arange(len(heads) - step)[:, None]
            joined, total = exits[step:][late, before], own + counts[step:][late, before]
            exits, counts = np.concatenate([exits[:step], joined]), np.concatenate([counts[:step], total])
            step *= 2
        return int(counts[-1, place[START]])


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` of every whole text, as sentencepiece counts without added tokens.

    A null or empty text has 0 bytes and 0 tokens. Other columns are ignored; repeated rows give repeated results.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        count = Counter(Pieces(model))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            counted = pa.array(count(texts(batch, text)), pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("n_bytes"), counted], [id_col, "n_bytes", "n_tokens"])

        return work

    sized = docs.select(id_col, text, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    counted = map_slices(sized, make, f"{id_col} {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
