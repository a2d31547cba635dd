"""Best-fit packing by length patterns.

Every document becomes token ids in tasks; only those longer than a sequence are
cut. How many pieces have which length is a histogram of bounded size, and the
packing is worked out on it alone: patterns of two or three lengths that fill a
sequence exactly are enumerated, how often each is used is fitted to the
histogram by non-negative least squares and rounded, and what that leaves is
packed by best fit, longest first. The outcome says which of the pieces of one
length (by number) lie where; its size depends on the sequence length and not on
the number of documents. Pieces are numbered per length and task, so that any
length may hold any share of all pieces.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfare.llm.common import SLICE_BYTES, in_batches, written
from wayfare.llm.token_counts import SETTLED, SPECIAL

LIMIT = 2048
#: Characters of a long text that are encoded at a time.
PIECE = 1 << 18
#: The id behind every document, and bits for the number of pieces of one length.
END = bytes(4)
RANK_BITS = 44
#: Tried for the fewest sequences: patterns of three lengths per shortest length; fits, each on what rounding left of the one before.
TRIPLES = (0, 4, 12)
FITS = (1, 4)
SWEEPS = 60


# Token ids


class Ids:
    """Token ids of texts as little-endian 32-bit numbers, as the library for ``tokenizer`` gives them.

    A text of none but settled characters is encoded from the same vocabulary as
    ranks, which gives the same ids some times faster; any other by the library.
    """

    def __init__(self, tokenizer: str, ranks: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        with open(public_tokenizers.path(ranks), "rb") as lines:
            vocabulary = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.ranked = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens={})
        self.special = array("I", [self.library.token_to_id(SPECIAL)]).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if SETTLED.search(text):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(array("I", self.ranked.encode_ordinary(p)).tobytes() for p in _pieces(text))

    def text(self, text: str) -> bytes:
        return self.special.join(map(self.encode, text.split(SPECIAL))) if SPECIAL in text else self.encode(text)


def _pieces(text: str) -> Iterator[str]:
    """A long text in pieces; a space before anything but white space always begins a pre-token."""
    start = 0
    while len(text) - start > PIECE:
        found = _SAFE_CUT.search(text, start + PIECE)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


_SAFE_CUT = re.compile(r" (?=\S)")


# The packing of a histogram


class Slots(NamedTuple):
    """Pieces ``rank .. rank + count - 1`` of ``length`` lie at ``offset`` of the sequences from ``sequence`` on, one in each."""

    length: np.ndarray
    rank: np.ndarray
    count: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


def exact_patterns(present: np.ndarray, limit: int, triples: int) -> np.ndarray:
    """Rows of three lengths (0: none) that add up to ``limit``: all pairs, and for every shortest length ``triples`` evenly spread ones."""
    lengths = np.flatnonzero(present[:limit])
    low = lengths[2 * lengths <= limit]
    pairs = low[present[limit - low]]
    out = [np.stack([pairs, limit - pairs, np.zeros_like(pairs)], 1)]
    for a in lengths[3 * lengths <= limit]:
        b = low[(low >= a) & (2 * low <= limit - a)]
        b = b[present[limit - a - b]]
        b = b[np.linspace(0, len(b) - 1, min(len(b), triples)).round().astype(int)]
        out.append(np.stack([np.full_like(b, a), b, limit - a - b], 1))
    return np.concatenate(out)


def fit(patterns: np.ndarray, wanted: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """How often to use each pattern: non-negative least squares against the counts ``wanted``, by accelerated projected gradient."""
    size = len(wanted)

    def used(x: np.ndarray) -> np.ndarray:
        total = np.bincount(patterns.ravel(), np.repeat(x, patterns.shape[1]), size)
        total[0] = 0.0
        return total

    x = np.ones(len(patterns))
    step = 1.0
    for _ in range(20):  # the largest eigenvalue bounds the step
        x = used(x)[patterns].sum(1).astype(float)
        step = 1 / np.linalg.norm(x)
        x *= step
    step *= 0.98
    x = np.zeros(len(patterns))
    ahead, pace = x, 1.0
    for _ in range(sweeps):
        after = np.maximum(0.0, ahead - step * (used(ahead) - wanted)[patterns].sum(1))
        faster = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        ahead, x, pace = after + (pace - 1) / faster * (after - x), after, faster
    return x


class _Plan:
    def __init__(self, counts: np.ndarray, limit: int):
        self.left, self.limit, self.sequences = counts.astype(np.int64).copy(), limit, 0
        self.next_rank = np.zeros(limit + 1, np.int64)
        self.slots: list[tuple[int, int, int, int, int]] = []

    def put(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.slots.append((length, int(self.next_rank[length]), count, sequence, offset))
        self.next_rank[length] += count
        self.left[length] -= count

    def use(self, pattern: np.ndarray, times: int) -> int:
        lengths, each = np.unique(pattern[pattern > 0], return_counts=True)
        times = min(times, int((self.left[lengths] // each).min()))
        if times > 0:
            offset = 0
            for length in pattern[pattern > 0].tolist():
                self.put(length, times, self.sequences, offset)
                offset += length
            self.sequences += times
        return max(times, 0)

    def best_fit(self) -> None:
        """Best fit of all that is left, longest first; sequences filled alike are handled together."""
        room: dict[int, list[tuple[int, int]]] = {}  # free places -> first sequence, how many
        sizes: list[int] = []

        def keep(free: int, first: int, n: int) -> None:
            if free and n:
                if free not in room:
                    room[free] = []
                    insort(sizes, free)
                room[free].append((first, n))

        for length in np.flatnonzero(self.left)[::-1].tolist():
            while self.left[length]:
                at = bisect_left(sizes, length)
                if at < len(sizes):
                    free = sizes[at]
                    first, n = room[free].pop()
                    if not room[free]:
                        del room[free], sizes[at]
                else:
                    free, first = self.limit, self.sequences
                    n = -(-int(self.left[length]) // (free // length))
                    self.sequences += n
                each, count = free // length, int(self.left[length])
                full = min(n, count // each)
                for k in range(each if full else 0):
                    self.put(length, full, first, self.limit - free + k * length)
                keep(free - each * length, first, full)
                some = min(count - full * each, each) if full < n else 0
                for k in range(some):
                    self.put(length, 1, first + full, self.limit - free + k * length)
                if some:
                    keep(free - some * length, first + full, 1)
                keep(free, first + full + bool(some), n - full - bool(some))


def plan(counts: np.ndarray, limit: int = LIMIT) -> tuple[Slots, int]:
    """Where the pieces of every length go, and into how many sequences; ``counts[l]``: pieces of length l.

    Several sets of patterns are fitted, and the one that needs the fewest
    sequences is kept; among them are those that change nothing about best fit.
    """
    tried = [_planned(counts, limit, triples, fits) for triples in TRIPLES for fits in FITS]
    best = min(tried, key=lambda work: work.sequences)
    found = np.array(sorted(best.slots), np.int64).reshape(-1, 5)
    return Slots(*found.T), best.sequences


def _planned(counts: np.ndarray, limit: int, triples: int, fits: int) -> _Plan:
    work = _Plan(counts, limit)
    work.use(np.array([limit]), int(work.left[limit]))
    for _ in range(fits):
        wanted = work.left.copy()
        patterns = exact_patterns(wanted > 0, limit, triples)
        if not len(patterns):
            break
        times = np.floor(fit(patterns, wanted.astype(float))).astype(np.int64)
        order = np.argsort(-times, kind="stable")[: int((times > 0).sum())]
        if not sum([work.use(patterns[i], int(times[i])) for i in order]):
            break
    work.best_fit()
    return work


# Documents


def pieces_of(documents: DataFrame, limit: int, tokenizer: str, ranks: str, with_ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), with part and number: the piece's task, and its number among those of its length there."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Ids(tokenizer, ranks), TaskContext.get().partitionId()
        seen = [0] * (limit + 1)
        for batch in batches:
            row, piece, start, length, crc, number, kept = [], [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = memoryview((encoder.text(text) if text else b"") + END)
                total, at = len(ids) // 4, 0
                size = (total - 1) % limit + 1
                for k in range(-(-total // limit)):
                    own = ids[4 * at : 4 * (at + size)]
                    row.append(i), piece.append(k), start.append(at), length.append(size), crc.append(zlib.crc32(own)), number.append(seen[size])
                    if with_ids:
                        kept.append(bytes(own))
                    seen[size] += 1
                    at, size = at + size, limit
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())),
                    "piece": pa.array(piece, pa.int32()),
                    **{n: pa.array(v, pa.int64()) for n, v in (("start", start), ("length", length), ("ids_crc32", crc))},
                    "part": pa.array([part] * len(row), pa.int32()),
                    "number": pa.array(number, pa.int64()),
                    **({"ids": pa.array(kept, pa.binary())} if with_ids else {}),
                }
            )

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, number long" + ", ids binary" * with_ids
    return in_batches(documents.select("doc_id", "text"), cut, schema, SLICE_BYTES)


def pack(
    documents: DataFrame, limit: int = LIMIT, tokenizer: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", with_ids: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row of ``documents``.

    Needs doc_id and text; other columns are ignored. A document is the ids of its
    text and id 0; one longer than ``limit`` is cut from its end, so that only its
    first piece may be shorter. NULL and empty texts are id 0 alone; NULL ids are
    kept; repeated rows are packed each for itself; no rows give none. With
    ``with_ids`` the ids of each piece are in ``ids``, for ``sequences``. Which of
    the pieces of one length takes which place follows the order of the rows.
    """
    found = written(pieces_of(documents, limit, tokenizer, ranks, with_ids))
    shares = found.groupBy("part", "length").agg(F.count(F.lit(1)).alias("here"))
    in_order = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shares = written(shares.withColumn("before", F.coalesce(F.sum("here").over(in_order), F.lit(0))))
    counts = np.zeros(limit + 1, np.int64)
    for length, count in shares.groupBy("length").agg(F.sum("here").alias("count")).collect():  # at most ``limit`` rows
        counts[length] = count
    slots = documents.sparkSession.sparkContext.broadcast(plan(counts, limit)[0])
    ranked = found.join(shares, ["part", "length"]).withColumn("rank", F.col("number") + F.col("before")).drop("part", "number", "here", "before")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = slots.value
        first = known.length << RANK_BITS | known.rank
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(first, length << RANK_BITS | rank, "right") - 1
            columns = {c: batch.column(c) for c in names}
            columns["sequence_id"] = pa.array(known.sequence[at] + rank - known.rank[at])
            columns["offset"] = pa.array(known.offset[at])
            yield pa.RecordBatch.from_pydict(columns)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(*names).schema)
    return in_batches(ranked.select(*names, "rank"), place, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids (little-endian 32-bit) of every sequence, from ``pack(..., with_ids=True)``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(parts, F.lit(b""), lambda ids, p: F.concat(ids, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), whole.alias("ids"))
