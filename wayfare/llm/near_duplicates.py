"""Near-duplicate documents: MinHash with banding, verified links, connected components.

Texts with one shingle set form a class. Classes that share a band of minima are
compared; within a band's bucket every class meets the smallest one first, which
settles buckets of true copies in linear work. Only buckets whose classes are then
still in several components are compared further, in blocks. Every link counts
only after its full shingle sets have been compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.llm.common import SLICE_BYTES, in_batches, written
from wayfare.llm.components import components

SHINGLE = 5
#: Similarity as a whole ratio: PERCENT * union <= 100 * intersection.
PERCENT = 75
#: A pair at 0.75 shares no band with a chance of (1 - 0.75**4)**32 = 5e-6.
BANDS, ROWS = 32, 4
#: Pairs whose signatures agree on less are not compared in full. At a similarity of 0.75 agreement
#: has a standard deviation of 0.038, so that this is more than five of them below.
LEAST_AGREEMENT = 0.55
BLOCK = 512
_CACHE = 400_000

_rng = np.random.default_rng(20240611)
_A = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_STEPS = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle sets as sorted 64-bit hashes; word hashes are kept in a bounded cache."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}

    def set_of(self, text: str | None) -> np.ndarray:
        # Of bytes, lower() folds A-Z alone and split() cuts at the six ASCII white-space characters alone.
        words = text.encode().lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        known = self.words
        found = list(map(known.get, words))
        if None in found:
            if len(known) > _CACHE:
                known.clear()
            for i, value in enumerate(found):
                if value is None:
                    found[i] = known[words[i]] = xxhash.xxh3_64_intdigest(words[i])
        hashes = np.array(found, np.uint64)
        width = min(SHINGLE, len(words))
        count = len(words) - width + 1
        total = np.full(count, width, np.uint64)
        for i in range(width):
            total += hashes[i : i + count] * _STEPS[i]
        return np.unique(_mixed(total))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of the universal hashes a * x + b over a set, in 32 bits."""
    low = np.full(len(_A), np.iinfo(np.uint32).max, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 2048):
        part = np.multiply.outer(_A, short[at : at + 2048])
        part += _B[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return _mixed(low.astype(np.uint64))


def _mark(low: np.ndarray) -> bytes:
    """A signature of 16 bits a minimum."""
    return (low >> np.uint64(48)).astype(np.uint16).tobytes()


def signatures(documents: DataFrame) -> DataFrame:
    """doc_id, set_a, set_b (128 bits that name the shingle set), n_shingles, bands, signature."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            names, sizes, bands, marks = [], [], [], []
            for text in batch.column("text").to_pylist():
                shingles = shingler.set_of(text)
                sizes.append(len(shingles))
                names.append(xxhash.xxh3_128_intdigest(shingles.tobytes()) if len(shingles) else 0)
                if not len(shingles):
                    bands.append(None), marks.append(None)
                    continue
                low = minima(shingles)
                bands.append(_mixed((low.reshape(BANDS, ROWS) * _BAND).sum(axis=1, dtype=np.uint64)).astype(np.int64))
                marks.append(_mark(low))
            halves = [[(n >> shift & (1 << 64) - 1) - (1 << 63) for n in names] for shift in (64, 0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(h, pa.int64()) for h in halves), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                names=["doc_id", "set_a", "set_b", "n_shingles", "bands", "signature"],
            )

    return in_batches(documents.select("doc_id", "text"), sign, f"doc_id {kind}, set_a long, set_b long, n_shingles long, bands array<long>, signature binary", SLICE_BYTES)


def _verified(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose full shingle sets are similar enough. One text per class is read."""
    texts = documents.select("doc_id", "text")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    kind = pairs.schema["a"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        last: tuple[str | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            keep = []
            for one, other in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
                if other != last[0]:
                    last = (other, shingler.set_of(other))
                mine = shingler.set_of(one)
                shared = len(np.intersect1d(mine, last[1], assume_unique=True))
                keep.append(100 * shared >= PERCENT * (len(mine) + len(last[1]) - shared) and shared > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # Repeated ids can bring a pair more than once.
    return in_batches(both.select("a", "b", "text_a", "text_b"), compare, f"a {kind}, b {kind}", SLICE_BYTES).distinct()


@F.pandas_udf(T.DoubleType())
def _agreement(one, other):
    import pandas as pd

    return pd.Series([float((np.frombuffer(x, np.uint16) == np.frombuffer(y, np.uint16)).mean()) for x, y in zip(one, other)], dtype=float)


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose signatures agree enough to be compared in full."""
    marks = classes.select("class", "signature")
    both = pairs.join(marks.select(F.col("class").alias("a"), F.col("signature").alias("mark_a")), "a").join(marks.select(F.col("class").alias("b"), F.col("signature").alias("mark_b")), "b")
    return both.filter(_agreement("mark_a", "mark_b") >= LEAST_AGREEMENT).select("a", "b")


def _agreeing(left, right) -> np.ndarray:
    """Whether signatures of the two lists agree on LEAST_AGREEMENT of their places, for each with each."""
    one, two = (np.frombuffer(b"".join(side), np.uint16).reshape(len(side), -1) for side in (left, right))
    equal = np.zeros((len(one), len(two)), np.uint16)
    for place in range(one.shape[1]):
        equal += one[:, place, None] == two[:, place]
    return equal >= LEAST_AGREEMENT * one.shape[1]


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets, as products of 0/1 rows over the elements that several sets have."""
    sizes = [*map(len, left), *map(len, right)]
    elements, place, times = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    wide = (times > 1)[place]
    owner, column = owner[wide], column[place[wide]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [first, first + 4096])
        table = np.zeros((len(sizes), 4096), np.float32)
        table[owner[a:b], column[a:b] - first] = 1
        out += table[: len(left)] @ table[len(left) :].T
    return out


def _across(shared: DataFrame, found: DataFrame, documents: DataFrame) -> DataFrame:
    """Links between classes that share a band and are in different components.

    Documents around one long passage fill a bucket without being near-duplicates,
    so that its pairs are many and its links few. A bucket is compared in blocks of
    about BLOCK classes, every block with every other. In the task, the classes whose
    signatures agree enough with one of another component are compared in full, and
    only links leave it.
    """
    known = shared.join(found, shared["class"] == found["node"], "left").select("band", "class", F.coalesce("component", "class").alias("component"))
    open_ = known.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).filter("low <> high")
    rows = written(known.join(open_.select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "band"))
    kind = shared.schema["class"].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            found = [shingler.set_of(t) for t in batch.column("text").to_pylist()]
            columns = (pa.array([make(x) for x in found], pa.binary()) for make in (np.ndarray.tobytes, lambda x: _mark(minima(x))))
            yield pa.RecordBatch.from_arrays([batch.column("class"), *columns], names=["class", "shingles", "signature"])

    texts = documents.select(F.col("doc_id").alias("class"), "text").join(written(rows.select("class").distinct()), "class", "left_semi")
    full = in_batches(texts, sets, f"class {kind}, shingles binary, signature binary", SLICE_BYTES).dropDuplicates(["class"])
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int").alias("own")
    placed = rows.join(full, "class").select("band", "class", "component", "shingles", "signature", "blocks", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = placed.select("band", "class", "component", "shingles", "signature", "own", other).select(
        "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "component", "shingles", "signature"
    )

    def compare(key, frame):
        import pandas as pd

        left, right = frame[frame["own"] == key[1]], frame[frame["own"] == key[2]]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []})
        likely = _agreeing(left["signature"], right["signature"]) & (left["component"].to_numpy()[:, None] != right["component"].to_numpy())
        left, right, likely = left[likely.any(axis=1)], right[likely.any(axis=0)], likely[likely.any(axis=1)][:, likely.any(axis=0)]
        if not len(left):
            return pd.DataFrame({"a": [], "b": []})
        one, two = ([np.frombuffer(x, np.uint64) for x in side["shingles"]] for side in (left, right))
        common = _shared(one, two)
        union = np.array([*map(len, one)])[:, None] + np.array([*map(len, two)]) - common
        a, b = np.nonzero(likely & (100 * common >= PERCENT * union))
        a, b = left["class"].to_numpy()[a], right["class"].to_numpy()[b]
        return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return spread.groupBy("band", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}").distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``documents``.

    Needs doc_id and text; other columns are ignored. A text that is NULL or has
    no word has an empty set and is linked with nothing. A text of fewer than
    five words has one shingle, the whole of it. Rows with one doc_id count as
    one document where they share a set. A NULL id is kept and takes no part in
    links. The component is named by its smallest id; no rows give none.
    """
    signed = written(signatures(documents))
    full = signed.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    names = full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("class"))
    members = written(
        signed.select("doc_id", "set_a", "set_b", "n_shingles")
        .join(names, ["set_a", "set_b"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("class")).alias("class"))
    )
    leaders = members.filter(F.col("doc_id") == F.col("class")).select("class").distinct()
    classes = written(full.withColumn("class", F.col("doc_id")).join(leaders, "class", "left_semi").select("class", "bands", "signature"))

    rows = classes.select("class", F.explode("bands").alias("band"))
    heads = rows.groupBy("band").agg(F.min("class").alias("head"), F.max("class").alias("tail")).filter(F.col("head") != F.col("tail")).select("band", "head")
    shared = written(rows.join(heads, "band").select("band", "class", "head"))
    stars = shared.filter(F.col("class") != F.col("head")).select(F.col("class").alias("a"), F.col("head").alias("b")).distinct()
    links = written(_verified(_likely(stars, classes), documents))
    found = components(links)
    rest = written(_across(shared.select("band", "class"), found, documents))
    if not rest.isEmpty():
        found = components(links.unionByName(rest))
    named = members.join(found, members["class"] == found["node"], "left")
    component = F.coalesce("component", "class", "doc_id")
    return named.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
