"""Byte-level BPE encoding by speculation and verification.

Words are first cut greedily into the longest tokens. A sequence of tokens is
the BPE encoding of its bytes exactly when every adjacent pair of tokens is the
encoding of the pair's own bytes, so one vectorised look-up of all adjacent
pairs of a batch tells which words are right; a pair not met before is settled
once by exact merging of its few bytes. Only words with a failing pair are
merged exactly, by a heap, in time ``n log n`` of the word.

The vocabulary is read on the driver from a path parameter and broadcast (one
fixed megabyte); workers keep the tokens of words they have met.

Defined cases: null and empty text give the empty list; every other text, in
whatever script and of whatever length, is encoded whole; strings of special
tokens are ordinary text; repeated rows are encoded alike.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary lies, and the pattern that cuts texts into words before merging.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose tokens, and pairs of tokens whose verdict, a worker keeps; bounds of memory only.
KEPT_WORDS, KEPT_PAIRS = 500_000, 1_000_000


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes and their ranks from ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Encodes texts with the ranks of a byte-level BPE vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.words = regex.compile(pattern)
        self.known: dict[str, array] = {}
        self.pairs = np.empty(0, np.int64)  # settled pairs in order, and whether they are compatible
        self.fits = np.empty(0, bool)
        # the longest token that starts with a given pair of bytes bounds the greedy search
        self.reach: dict[bytes, int] = {}
        for token in ranks:
            if len(token) > 1:
                self.reach[token[:2]] = max(self.reach.get(token[:2], 0), len(token))

    def merged(self, data: bytes) -> list[int]:
        """Exact encoding of one word: always the adjacent pair of lowest rank, leftmost first."""
        ranks, n = self.ranks, len(data)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))  # of the part that begins at i; 0 once it is swallowed
        heap = [(ranks[data[i : i + 2]], i, i + 2) for i in range(n - 1) if data[i : i + 2] in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or not end[j] or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            after[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i and (p := before[i]) >= 0 and (r := ranks.get(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def greedy(self, data: bytes) -> list[int]:
        """The longest token at each place."""
        ranks, out, i, n = self.ranks, [], 0, len(data)
        if (whole := ranks.get(data)) is not None:
            return [whole]
        while i < n:
            for j in range(min(n, i + self.reach.get(data[i : i + 2], 1)), i, -1):
                if (r := ranks.get(data[i:j])) is not None:
                    out.append(r)
                    i = j
                    break
        return out

    def _compatible(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens encodes its own bytes."""
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs, self.fits = np.empty(0, np.int64), np.empty(0, bool)
        wanted, back = np.unique(pairs, return_inverse=True)
        at = np.searchsorted(self.pairs, wanted)
        met = np.zeros(len(wanted), bool) if not len(self.pairs) else self.pairs[np.minimum(at, len(self.pairs) - 1)] == wanted
        if not met.all():
            fresh = wanted[~met]
            fit = np.array([self.merged(self.tokens[a] + self.tokens[b]) == [a, b] for a, b in zip((fresh >> 32).tolist(), (fresh & 0xFFFFFFFF).tolist())], bool)
            self.pairs = np.concatenate([self.pairs, fresh])
            self.fits = np.concatenate([self.fits, fit])
            order = np.argsort(self.pairs, kind="stable")
            self.pairs, self.fits = self.pairs[order], self.fits[order]
        return self.fits[np.searchsorted(self.pairs, wanted)][back]

    def learn(self, fresh: list[str]) -> None:
        """Encodes words not met before: speculate, verify all pairs at once, mend the rest."""
        data = [w.encode() for w in fresh]
        guesses = [self.greedy(d) for d in data]
        sizes = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter((t for g in guesses for t in g), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(guesses)), sizes)
        inside = owner[1:] == owner[:-1]
        fits = self._compatible(((flat[:-1] << 32) | flat[1:])[inside])
        failing = np.unique(owner[1:][inside][~fits])
        for i in failing.tolist():
            guesses[i] = self.merged(data[i])
        for word, ids in zip(fresh, guesses):
            self.known[word] = array("i", ids)

    def encode_batch(self, texts: list[str | None]) -> tuple[array, list[int]]:
        """All ids of the texts one after another, and where each text's ids end."""
        cut = [self.words.findall(t) if t else [] for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        if fresh := list({w for words in cut for w in words} - self.known.keys()):
            self.learn(fresh)
        known, flat, ends = self.known, array("i"), []
        for words in cut:
            for w in words:
                flat.extend(known[w])
            ends.append(len(flat))
        return flat, ends


_ENCODERS: dict[str, Encoder] = {}


def encoded(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, ids`` of each row, ``ids`` being the tokens of its whole text; columns in ``keep`` pass through in the same batches."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    name = uuid.uuid4().hex
    names = ["_text", "_key", *(f"_keep{i}" for i in range(len(keep))), "_ids"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[name] = Encoder(shared.value, pattern)
        encoder = _ENCODERS[name]
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                flat, ends = encoder.encode_batch(part.column(0).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], ids], names=names[1:])

    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip((text, key, *keep), names)])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    out = rows.mapInArrow(encode, f"{kinds}, _ids array<int>")
    return out.select(*[F.col(n).alias(c) for c, n in zip((key, *keep, "ids"), names[1:])])
