"""Benchmark decontamination with one FM-index per shard of the training texts.

A shard is a run of documents of one partition. Its words become numbers of the
benchmark's vocabulary; runs of such words that are too short to hold any window
can hold no occurrence and are left out, the rest is one sequence with separators.
The windows are searched backward through the ranks of a wavelet tree over the
Burrows-Wheeler transform, all at once in numpy; occurrences are located from
sampled suffix positions and merged into spans.

The benchmark is cut into blocks of bounded size by Spark tasks and stored in the
shared folder. Executors fetch the files; a task holds one block at a time. Neither
the driver nor a broadcast ever holds the benchmark.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wayfare.llm.common import fold, in_batches, without, written

WINDOW = 10
SHARD_WORDS = 1_000_000
SAMPLE_STEP = 16
#: Benchmark words of one block. A larger benchmark is searched block by block, so
#: that a task holds a few hundred MB of it at most, whatever its size.
BLOCK_WORDS = 1_000_000

#: A word: letters, digits and everything beyond ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Ranks:
    """A bit vector with counts of ones before each position."""

    __slots__ = ("sums",)

    def __init__(self, bits: np.ndarray):
        self.sums = np.zeros(len(bits) + 1, np.int32)
        np.cumsum(bits, out=self.sums[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        return self.sums[at]


class WaveletTree:
    """Ranks of symbols in a sequence; level by level, zeros before ones."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.depth = max(1, int(size - 1).bit_length())
        self.levels: list[tuple[Ranks, int]] = []
        row = symbols
        for level in range(self.depth - 1, -1, -1):
            bits = ((row >> level) & 1).astype(bool)
            self.levels.append((Ranks(bits), int(len(row) - bits.sum())))
            row = np.concatenate([row[~bits], row[bits]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbols[i]`` occurs before position ``at[i]``."""
        low, high = np.zeros_like(at), at.copy()
        for i, (ranks, zeros) in enumerate(self.levels):
            bit = ((symbols >> (self.depth - 1 - i)) & 1).astype(bool)
            a, b = ranks.ones(low), ranks.ones(high)
            low = np.where(bit, zeros + a, low - a)
            high = np.where(bit, zeros + b, high - b)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out, at = np.zeros_like(at), at.copy()
        for i, (ranks, zeros) in enumerate(self.levels):
            before = ranks.ones(at)
            bit = ranks.ones(at + 1) - before
            out = (out << 1) | bit
            at = np.where(bit.astype(bool), zeros + before, at - before)
        return out


class FMIndex:
    """Backward search over a sequence of symbols from 1; 0 ends it and separates its parts.

    Positions are sampled every SAMPLE_STEP and at every separator, so that a walk
    to a sampled one stays inside its part.
    """

    def __init__(self, text: np.ndarray, size: int):
        self.text_length = len(text)
        order = _suffixes(text)
        previous = text[order - 1]
        self.tree = WaveletTree(previous, size)
        counts = np.bincount(text, minlength=size)
        self.first = np.concatenate([[0], np.cumsum(counts)])[:size].astype(np.int64)
        kept = (order % SAMPLE_STEP == 0) | (previous == 0)
        self.kept = Ranks(kept)
        self.places = order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each pattern (right-aligned, padded)."""
        width = patterns.shape[1]
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.text_length, np.int64)
        for step in range(width):
            live = np.flatnonzero((step < lengths) & (low < high))
            if not len(live):
                break
            symbols = patterns[live, width - 1 - step]
            base = self.first[symbols]
            low[live], high[live] = base + self.tree.rank(symbols, low[live]), base + self.tree.rank(symbols, high[live])
        high = np.maximum(low, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by walking back to sampled ones."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live, rows = np.arange(len(rows)), rows.astype(np.int64)
        while len(live):
            before = self.kept.ones(rows)
            hit = self.kept.ones(rows + 1) > before
            out[live[hit]] = self.places[before[hit]] + steps[live[hit]]
            live, rows = live[~hit], rows[~hit]
            steps[live] += 1
            symbols = self.tree.access(rows)
            rows = self.first[symbols] + self.tree.rank(symbols, rows)
        return out


def _suffixes(text: np.ndarray) -> np.ndarray:
    """Positions in suffix order, by prefix doubling until all suffixes are told apart.

    Separators count as distinct, which ends the doubling within the longest part.
    """
    n = len(text)
    ends = text == 0
    rank = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + int(ends.sum()))
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        ordered = rank[order]
        if step > 1 and (ordered[1:] != ordered[:-1]).all():
            return order
        following = np.zeros(n, np.int64)
        following[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (int(rank.max()) + 2) + following
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = new
        step *= 2


def windows(words: list[str], width: int = WINDOW) -> list[tuple[str, ...]]:
    if not words:
        return []
    if len(words) < width:
        return [tuple(words)]
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]


class Benchmark:
    """One block of benchmark items: a vocabulary, distinct windows, and the items of each."""

    def __init__(self, items: list[tuple[object, str]], width: int = WINDOW):
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[str, int] = {}
        owners: dict[tuple[int, ...], list[int]] = {}
        for place, (_, text) in enumerate(items):
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in WORD.findall(fold(text or ""))]
            for window in dict.fromkeys(windows(words, width)):
                owners.setdefault(window, []).append(place)
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.patterns = np.zeros((len(owners), width), np.int64)
        for i, window in enumerate(owners):
            self.patterns[i, width - len(window) :] = window
        self.owners = list(owners.values())
        self.shortest = int(self.lengths.min()) if len(owners) else 0

    def row(self) -> dict[str, list]:
        """The block as one row of the table of blocks: see ``_BLOCK``."""
        return {
            "words": [list(self.vocabulary)],
            "patterns": [self.patterns.astype(np.int32).ravel()],
            "lengths": [self.lengths.astype(np.int32)],
            "owned": [np.fromiter(map(len, self.owners), np.int32, len(self.owners))],
            "owners": [np.fromiter((place for places in self.owners for place in places), np.int32)],
            "ids": [self.ids],
        }

    @classmethod
    def of_row(cls, row: pa.RecordBatch, width: int) -> Benchmark:
        """The block that ``row`` made a row of."""
        values = {name: row.column(name)[0].values for name in row.schema.names}
        block = cls([], width)
        block.ids = values["ids"].to_pylist()
        block.vocabulary = {word: place for place, word in enumerate(values["words"].to_pylist(), 1)}
        block.patterns = values["patterns"].to_numpy().astype(np.int64).reshape(-1, width)
        block.lengths = values["lengths"].to_numpy().astype(np.int64)
        ends = np.cumsum(values["owned"].to_numpy())
        block.owners = [places.tolist() for places in np.split(values["owners"].to_numpy(), ends[:-1])] if len(ends) else []
        block.shortest = int(block.lengths.min()) if len(block.lengths) else 0
        return block

    def hits(self, texts: list[str]) -> list[tuple[int, list[tuple[int, int]], list[object]]]:
        """For each text of a shard: its number of words, merged spans of hit words, items found."""
        get, shortest = self.vocabulary.get, self.shortest
        sizes, parts, places = [], [], []
        for doc, text in enumerate(texts):
            words = WORD.findall(fold(text)) if text else []
            sizes.append(len(words))
            if not shortest or len(words) < shortest:
                continue
            known = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
            gaps = np.flatnonzero(known == 0)
            starts, ends = np.concatenate([_END, gaps + 1]), np.append(gaps, len(words))
            long = ends - starts >= shortest
            for a, b in zip(starts[long], ends[long]):
                parts.append(known[a:b])
                places.append((doc, int(a)))
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        found: list[set[int]] = [set() for _ in texts]
        if parts:
            text = np.concatenate([x for p in parts for x in (p, _END)])
            begins = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
            index = FMIndex(text, len(self.vocabulary) + 1)
            low, high = index.search(self.patterns, self.lengths)
            times = high - low
            which = np.repeat(np.arange(len(times)), times)
            rows = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
            at = index.locate(rows)
            part = np.searchsorted(begins, at, side="right") - 1
            for w, p, offset in zip(which.tolist(), part.tolist(), (at - begins[part]).tolist()):
                doc, start = places[p]
                spans[doc].append((start + offset, start + offset + int(self.lengths[w])))
                found[doc].update(self.owners[w])
        return [(n, _merged(s), [self.ids[i] for i in sorted(f)]) for n, s, f in zip(sizes, spans, found)]


_END = np.zeros(1, np.int64)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _pieces(text: str | None, most: int, width: int) -> Iterator[tuple[int, str | None]]:
    """A text whole, or its words in pieces of at most ``most`` whose windows are those of the whole; with their sizes."""
    words = WORD.findall(fold(text)) if text else []
    if len(words) <= most:
        yield len(words), text
        return
    for at in range(0, len(words) - width + 1, most - width + 1):
        piece = words[at : at + most]
        yield len(piece), " ".join(piece)


#: One row a block: its words by number, its windows (right-aligned, one after the other), their lengths, how many items
#: own each and which (places in ``ids``).
_BLOCK = "words array<string>, patterns array<int>, lengths array<int>, owned array<int>, owners array<int>, ids array<{kind}>"


def benchmark_blocks(benchmark: DataFrame, width: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The table of blocks of ``benchmark`` (item_id, text), made by tasks; see ``_BLOCK``.

    As many tasks as blocks are expected read the distinct rows, so that blocks are full
    however many partitions a shuffle has; a task begins a new block when one is full, and
    a text longer than a block is cut where no window is lost.
    """
    kind = benchmark.schema["item_id"].dataType
    ids = pa.list_(to_arrow_type(kind))
    most = max(block_words, 2 * width)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            numbers = pa.list_(pa.int32())
            kinds = {"words": pa.list_(pa.string()), "patterns": numbers, "lengths": numbers, "owned": numbers, "owners": numbers, "ids": ids}
            return pa.RecordBatch.from_pydict({name: pa.array(value, kinds[name]) for name, value in Benchmark(block, width).row().items()})

        block, size = [], 0
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                for words, piece in _pieces(text, most, width):
                    if block and size + words > most:
                        yield made()
                        block, size = [], 0
                    block.append((item, piece))
                    size += words
        if block:
            yield made()

    rows = benchmark.select("item_id", "text")
    # Words are at least two characters with what parts them; texts of short words fill a second block.
    size = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    dealt = rows.dropDuplicates().coalesce(max(1, -(-size // (4 * block_words))))
    return in_batches(dealt, pack, _BLOCK.format(kind=kind.simpleString()))


def find_overlaps(documents: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``documents`` with hit_words, hit_spans (start, end in words, merged) and hit_items.

    All input columns but those of these names stay. NULL and empty texts have no words and no hits; NULL
    or empty items have no windows; without items nothing is hit. Repeated rows
    give repeated rows. Items of several rows with one id count as one item. The
    blocks of the benchmark are written when this is called, everything else is lazy.
    """
    documents = without(documents, "n_words", "hit_words", "hit_spans", "hit_items")
    kind = benchmark.schema["item_id"].dataType.simpleString()
    added = f"n_words long, hit_spans array<struct<start:long,end:long>>, hit_items array<{kind}>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    item = to_arrow_type(benchmark.schema["item_id"].dataType)
    blocks = written(benchmark_blocks(benchmark, width, block_words))
    count = blocks.count()
    files = blocks.inputFiles() if count else []
    for path in files:
        documents.sparkSession.sparkContext.addFile(path)
    names = [path.rsplit("/", 1)[1] for path in files]

    def stored() -> Iterator[Benchmark]:
        for name in names:
            for row in pq.ParquetFile(SparkFiles.get(name)).iter_batches(batch_size=1):
                yield Benchmark.of_row(row, width)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = list(stored()) if count == 1 else None
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            sizes = pc.utf8_length(column).fill_null(0).to_numpy()
            start = 0
            while start < batch.num_rows or (start == 0 == batch.num_rows):
                total = np.cumsum(sizes[start:])
                stop = start + max(1, int(np.searchsorted(total, 5 * SHARD_WORDS)))
                part = batch.slice(start, stop - start)
                start = max(stop, 1)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                rows: list[tuple[int, list, set]] = [(len(WORD.findall(fold(t))) if t else 0, [], set()) for t in texts] if not count else []
                for block in only or stored():
                    got = block.hits(texts)
                    rows = [(n, s + (rows[i][1] if rows else []), set(f) | (rows[i][2] if rows else set())) for i, (n, s, f) in enumerate(got)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array([n for n, _, _ in rows], pa.int64()),
                        pa.array([[{"start": a, "end": b} for a, b in _merged(s)] for _, s, _ in rows], _SPANS),
                        pa.array([sorted(f, key=str) for _, _, f in rows], pa.list_(item)),
                    ],
                    names=[*part.schema.names, "n_words", "hit_spans", "hit_items"],
                )

    rows = in_batches(documents, search, f"{schema}, {added}")
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.withColumn("hit_words", hit)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def overlap_report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document its words, hit words, number of items found, a digest of their ids."""
    found = find_overlaps(documents.select("doc_id", "text"), benchmark)
    items = F.array_sort(F.transform("hit_items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        F.col("hit_words").alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("hit_words") > 0).alias("contaminated"),
    )


def without_overlaps(documents: DataFrame, benchmark: DataFrame, most: float = 0.5) -> DataFrame:
    """``documents`` with hit words cut out of the texts, and without rows of which more than ``most`` is hit.

    Columns stay as they are (n_chars follows the text). A removed span goes from
    its first word's start to its last word's end; rows without hits are untouched.
    """
    columns = documents.columns
    # Columns with names of the result step aside meanwhile.
    aside = {c: f"_own_{c}" for c in columns if c.lower() in ("n_words", "hit_words", "hit_spans", "hit_items")}
    found = find_overlaps(documents.withColumnsRenamed(aside), benchmark).filter(F.col("hit_words") <= most * F.col("n_words"))

    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        return pd.Series([_cut(t, s) if t and len(s) else t for t, s in zip(texts, spans)], dtype=object)

    cleaned = F.when(F.col("hit_words") > 0, cut("text", "hit_spans")).otherwise(F.col("text"))
    found = found.withColumn("text", cleaned)
    if "n_chars" in columns:
        found = found.withColumn("n_chars", F.when(F.col("hit_words") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*(F.col(aside.get(c, c)).alias(c) for c in columns))


def _cut(text: str, spans) -> str:
    # Spans count the words of the folded text, whose places are those of the text.
    places = [(m.start(), m.end()) for m in WORD.finditer(fold(text))]
    parts, at = [], 0
    for span in spans:
        parts.append(text[at : places[span["start"]][0]])
        at = places[span["end"] - 1][1]
    return "".join([*parts, text[at:]])


def digest(ids: list[object]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
