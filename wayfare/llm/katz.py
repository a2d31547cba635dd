"""Scores of texts under a bigram model with Katz backoff.

Documents are cut into shards: one row each, with the shard's distinct words, its
tokens as numbers of these, and the training counts. Words, and then word pairs,
go to hash buckets as packed arrays, one per shard and bucket; the bucket adds up
counts over all shards and answers every shard in the order it asked. A shard so
learns what it needs of the whole corpus, and no row per token is ever shuffled.

* Words: count, and a number that names the word in the next step.
* Pairs: count, and for each history the counts of counts and the lower-order
  mass of what has followed it, which make its backoff weight. Pairs are dealt out
  by history, the pairs of frequent histories by their second word as well; the
  parts of such a history are added up in a small table.

The shard then scores its documents: Good-Turing discounted pair counts, else the
history's weight times the word's probability, else the probability of an unknown
word. Everything sums to one over the vocabulary and the unknown word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import WORD, fold, in_batches, shared_folder, ship, written

SHARD_TOKENS = 1_500_000
BUCKET_ENTRIES = 500_000
LEAST_BUCKETS = 64
#: Counts up to this are discounted (Katz's k).
DISCOUNTED = 5
_START, _END = " start", " end"  # no word has a space


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes; those of one significance stand together, which compresses counts and sorted numbers well."""
    parts = []
    for a in arrays:
        raw = zstandard.compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 1) if len(a) else b""
        parts += [np.array([len(a), len(raw)], np.int64).tobytes(), a.dtype.str.encode().ljust(8), raw]
    return b"".join(parts)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, size = np.frombuffer(data, np.int64, 2, at)
        kind = np.dtype(data[at + 16 : at + 24].decode().strip())
        at += 24
        raw = np.frombuffer(zstandard.decompress(data[at : at + size]), np.uint8) if n else np.zeros(0, np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel() if n else np.zeros(0, kind))
        at += int(size)
    return out


def _small(a: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest type that holds them."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def discounts(of_counts: list[int] | np.ndarray) -> np.ndarray:
    """Katz's d_1..d_k from the numbers of types seen 1..k+1 times.

    Where Good-Turing gives none between 0 and 1 (tiny or odd corpora), (r - 0.5) / r stands in.
    """
    n = np.asarray(of_counts, float)
    r = np.arange(1, DISCOUNTED + 1)
    with np.errstate(all="ignore"):
        common = (DISCOUNTED + 1) * n[DISCOUNTED] / n[0]
        d = ((r + 1) * n[1:] / n[:-1] / r - common) / (1 - common)
    return np.where((d > 0) & (d < 1), d, (r - 0.5) / r)


def _effective(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return counts * np.concatenate([[0.0], d, [1.0]])[np.minimum(counts, DISCOUNTED + 1)]


def shards(documents: DataFrame) -> DataFrame:
    """shard, n_words, n_tokens, ids, lengths, held, words, tokens: one row per shard of (doc_id, text, held_out)."""
    kind = documents.schema["doc_id"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 24
        made = 0

        def fresh():
            known: dict = defaultdict()
            known.default_factory = known.__len__
            return known, [], [], [], []

        def row(known, ids, lengths, held, tokens) -> pa.RecordBatch:
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
            words, place = np.unique(hashes, return_inverse=True)
            every = place[np.concatenate(tokens)].astype(np.int32)
            return pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([first + made], pa.int64()),
                    "n_words": pa.array([len(words)], pa.int64()),
                    "n_tokens": pa.array([len(every)], pa.int64()),
                    "ids": pa.array([ids], pa.list_(batch.schema.field("doc_id").type)),
                    "text": pa.array([pack(_small(np.array(lengths, np.int64)), np.array(held, np.uint8), words, every)], pa.binary()),
                }
            )

        state = fresh()
        total = 0
        for batch in batches:
            for doc, text, out in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("held_out").to_pylist()):
                words = WORD.findall(fold(text)) if text else []
                words.append(_END)
                known, ids, lengths, held, tokens = state
                tokens.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
                ids.append(doc), lengths.append(len(words)), held.append(out)
                total += len(words)
                if total >= SHARD_TOKENS:
                    yield row(*state)
                    made, total, state = made + 1, 0, fresh()
        if state[1]:
            yield row(*state)

    return in_batches(documents.select("doc_id", "text", "held_out"), cut, f"shard long, n_words long, n_tokens long, ids array<{kind.simpleString()}>, text binary")


class Shard:
    """What one row of ``shards`` holds, and what follows from it alone."""

    def __init__(self, text: bytes):
        self.lengths, held, self.words, self.tokens = unpack(text)
        self.lengths, self.held = self.lengths.astype(np.int64), held.astype(bool)
        self.train = np.repeat(~self.held, self.lengths)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.train], minlength=len(self.words)).astype(np.int64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Histories, words and training counts of the distinct pairs, and each token's pair. len(words) is the start."""
        before = np.empty(len(self.tokens), np.int64)
        before[1:] = self.tokens[:-1]
        before[np.concatenate([[0], np.cumsum(self.lengths)[:-1]])] = len(self.words)
        keys, place = np.unique(before * (len(self.words) + 1) + self.tokens, return_inverse=True)
        counts = np.bincount(place[self.train], minlength=len(keys)).astype(np.int64)
        return keys // (len(self.words) + 1), keys % (len(self.words) + 1), counts, place


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_answers(rows: DataFrame, buckets: int) -> DataFrame:
    """shard, bucket, answer (numbers and training counts of the shard's words there), stats.

    stats, once per bucket on a row without shard: tokens, types, and types seen 1..k+1 times.
    """
    width = (1 << 64) // buckets + 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, text in zip(batch.column("shard").to_pylist(), batch.column("text").to_pylist()):
                own = Shard(text)
                counts = own.word_counts()
                edges = np.searchsorted(own.words, np.array([b * width for b in range(1, buckets)], np.uint64))
                for b, (w, c) in enumerate(zip(np.split(own.words, edges), np.split(counts, edges))):
                    if len(w):
                        yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "shard": pa.array([shard], pa.int64()), "part": pa.array([pack(w, _small(c))], pa.binary())})

    def add(f: pd.DataFrame) -> pd.DataFrame:
        bucket = int(f["bucket"].iloc[0])
        parts = [unpack(p) for p in f["part"]]
        words, place = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([c for _, c in parts]), len(words)).astype(np.int64)
        edges = np.cumsum([len(w) for w, _ in parts])[:-1]
        answers = [pack(_small(p * buckets + bucket), _small(counts[p])) for p in np.split(place, edges)]
        stats = [int(counts.sum()), int((counts > 0).sum()), *(int((counts == r).sum()) for r in range(1, DISCOUNTED + 2))]
        return pd.DataFrame({"shard": [*f["shard"], None], "bucket": bucket, "answer": [*answers, None], "stats": [None] * len(f) + [stats]}).astype({"shard": "Int64"})

    asked = in_batches(rows.select("shard", "text"), ask, "bucket int, shard long, part binary")
    return asked.groupBy("bucket").applyInPandas(add, "shard long, bucket int, answer binary, stats array<long>")


class Model:
    """The sizes and constants that every task knows."""

    def __init__(self, stats: list[int], documents: int, buckets: int):
        self.total, self.types = stats[0], stats[1]
        self.d = discounts(stats[2:])
        self.documents, self.buckets = documents, buckets
        #: A history with more tokens than this is dealt out by its second word too.
        self.frequent = max(20_000, self.total // (4 * buckets))
        seen = [n * r * d for n, r, d in zip(stats[2:], range(1, DISCOUNTED + 1), self.d)]
        rest = self.total - sum(n * r for n, r in zip(stats[2 : 2 + DISCOUNTED], range(1, DISCOUNTED + 1)))
        left = 1.0 - (sum(seen) + rest) / self.total if self.total else 1.0
        # Without rare words discounting leaves nothing; an unknown word then has a token's share all the same.
        self.unknown = max(left, 1.0 / (self.total + 1))
        self.scale = (1.0 - self.unknown) / (1.0 - left) if left < 1.0 else 1.0

    def word(self, counts: np.ndarray) -> np.ndarray:
        """Probability of words by training count; the unknown word has what discounting leaves, or a token's share."""
        p = _effective(counts, self.d) / max(1, self.total) * self.scale
        return np.where(counts > 0, p, self.unknown)

    def parts(self, history_counts: np.ndarray) -> np.ndarray:
        return np.maximum(1, -(-history_counts // self.frequent))


def _requests(own: Shard, numbers: np.ndarray, counts: np.ndarray, model: Model):
    """The shard's distinct pairs by bucket, history and word; the same order whenever it is made."""
    h, w, c, place = own.pairs()
    # The start is history 0, a word's number counts from 1.
    names, times = np.append(numbers + 1, 0), np.append(counts, model.documents)
    bucket = _mixed(names[h] * 64 + 1) + np.where(model.parts(times[h]) > 1, _mixed(_mixed(names[w]) % model.parts(times[h]).astype(np.uint64) + np.uint64(1)), np.uint64(0))
    bucket = (bucket % np.uint64(model.buckets)).astype(np.int64)
    order = np.lexsort((names[w], names[h], bucket))
    return bucket[order], names[h][order], names[w][order], times[h][order], times[w][order], c[order], order, place


def _answered(f: pd.DataFrame) -> list[np.ndarray]:
    """A shard's answers, arrays put together in the order of buckets."""
    parts = [unpack(a) for a in f.sort_values("bucket")["answer"]]
    return [np.concatenate([p[i] for p in parts]) for i in range(len(parts[0]))]


def _histories(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and number of each run of equal histories."""
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(h)))


def pair_answers(rows: DataFrame, words: DataFrame, model: Model) -> DataFrame:
    """shard, bucket, answer; history, sums (parts of frequent histories); stats (types seen 1..k+1 times).

    An answer holds the count of every pair asked for and, per history, the types
    seen 1..k times, the tokens of types seen oftener, and the words' summed probability.
    """
    k = DISCOUNTED

    def ask(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"bucket": [], "shard": [], "part": []}
        for shard, text in zip(left["shard"], left["text"]):
            numbers, counts = (x.astype(np.int64) for x in _answered(right))
            bucket, h, w, ch, cw, c, _, _ = _requests(Shard(text), numbers, counts, model)
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            for a, b in zip(edges, [*edges[1:], len(bucket)]):
                first, runs = _histories(h[a:b])
                heads = h[a:b][first]
                out["bucket"].append(int(bucket[a])), out["shard"].append(shard)
                out["part"].append(pack(_small(np.diff(heads, prepend=0)), _small(runs), _small(ch[a:b][first]), _small(w[a:b]), _small(cw[a:b]), _small(c[a:b])))
        return pd.DataFrame(out)

    def add(f: pd.DataFrame) -> pd.DataFrame:
        bucket = int(f["bucket"].iloc[0])
        asked, sizes = [], []
        for part in f["part"]:
            steps, runs, ch, w, cw, c = (x.astype(np.int64) for x in unpack(part))
            asked.append((np.repeat(np.cumsum(steps), runs), w, np.repeat(ch, runs), cw, c))
            sizes.append(len(w))
        h, w, ch, cw, c = (np.concatenate(x) for x in zip(*asked))
        if max(h.max(), w.max()) >= 1 << 31:
            raise ValueError("more than 2**31 word types")
        keys, where, place = np.unique(h << 32 | w, return_index=True, return_inverse=True)
        counts = np.bincount(place, c, len(keys)).astype(np.int64)
        first, runs = _histories(keys >> 32)
        kinds = [np.add.reduceat(counts == r, first).astype(np.int64) for r in range(1, k + 1)]
        rest = np.add.reduceat(np.where(counts > k, counts, 0), first)
        mass = np.add.reduceat(np.where(counts > 0, model.word(cw[where]), 0.0), first)
        group = np.repeat(np.arange(len(first)), runs)[place]
        edges = np.cumsum(sizes)[:-1]
        answers = []
        for pairs, groups, own in zip(np.split(place, edges), np.split(group, edges), np.split(h, edges)):
            g = groups[_histories(own)[0]]
            answers.append(pack(_small(counts[pairs]), *(_small(x[g]) for x in kinds), _small(rest[g]), mass[g]))
        split = np.flatnonzero(model.parts(ch[where][first]) > 1)
        sums = [[*(float(x[i]) for x in kinds), float(rest[i]), float(mass[i])] for i in split]
        n, m = len(f), len(split)
        stats = [int((counts == r).sum()) for r in range(1, k + 2)]
        return pd.DataFrame(
            {
                "shard": [*f["shard"], *[None] * (m + 1)],
                "bucket": bucket,
                "answer": [*answers, *[None] * (m + 1)],
                "history": [*[None] * n, *(keys[first[split]] >> 32), None],
                "sums": [*[None] * n, *sums, None],
                "stats": [*[None] * (n + m), stats],
            }
        ).astype({"shard": "Int64", "history": "Int64"})

    answers = words.filter(F.col("shard").isNotNull()).select("shard", "bucket", "answer")
    asked = rows.select("shard", "text").groupBy("shard").cogroup(answers.groupBy("shard")).applyInPandas(ask, "bucket int, shard long, part binary")
    return asked.groupBy("bucket").applyInPandas(add, "shard long, bucket int, answer binary, history long, sums array<double>, stats array<long>")


def _weights(kinds: np.ndarray, rest: np.ndarray, mass: np.ndarray, times: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Denominators and backoff weights of histories.

    The weight is what discounting leaves of a history, over the lower-order mass
    of what never followed it. Where nothing is discounted, one more token in the
    denominator leaves its share.
    """
    r = np.arange(1, DISCOUNTED + 1)
    whole = np.maximum(times + (kinds.sum(axis=0) == 0), 1)
    used = ((kinds * (r * d)[:, None]).sum(axis=0) + rest) / whole
    return whole, np.where(times > 0, (1 - used) / np.maximum(1 - mass, 1e-12), 1.0)


def katz_scores(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Needs doc_id, text and held_out (a held-out row teaches nothing); other
    columns are ignored. A NULL or empty text is its end alone. NULL ids are kept;
    repeated rows are scored, and learned from, as often as they come; no rows
    give none. Without any training row everything is unknown, with probability 1.
    """
    spark = documents.sparkSession
    ship(spark)
    cut = shards(documents)
    name = "katz_" + shared_folder(spark).rsplit("-", 1)[1]
    # Rows of one shard, asked for twice by shard: a table in buckets spares their shuffle.
    cut.write.bucketBy(max(1, documents.rdd.getNumPartitions()), "shard").option("path", shared_folder(spark)).option("compression", "uncompressed").saveAsTable(name)
    rows = spark.table(name)
    size = rows.agg(F.sum("n_words").alias("words"), F.sum("n_tokens").alias("tokens")).first()
    words = written(word_answers(rows, max(LEAST_BUCKETS, (size.words or 0) // BUCKET_ENTRIES)))

    def summed(frame: DataFrame, length: int) -> list[int]:
        got = frame.filter(F.col("stats").isNotNull()).agg(*(F.sum(F.col("stats")[i]) for i in range(length))).first()
        return [int(x or 0) for x in got]

    documents_learned = documents.filter(~F.col("held_out")).count()
    model = Model(summed(words, DISCOUNTED + 3), documents_learned, max(LEAST_BUCKETS, (size.tokens or 0) // BUCKET_ENTRIES))
    pairs = written(pair_answers(rows, words, model))
    d2 = discounts(summed(pairs, DISCOUNTED + 1))
    # At most total / frequent histories have parts: some thousands here, and never more than four per bucket.
    parts = pairs.filter(F.col("history").isNotNull()).groupBy("history").agg(*(F.sum(F.col("sums")[i]) for i in range(DISCOUNTED + 2)))
    split = spark.sparkContext.broadcast(np.array([list(map(float, r)) for r in parts.orderBy("history").collect()]).reshape(-1, DISCOUNTED + 3))

    def score(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ids, text in zip(left["ids"], left["text"]):
            own = Shard(text)
            numbers, counts = (x.astype(np.int64) for x in _answered(right[right["of"] == 1]))
            got = _answered(right[right["of"] == 2])
            bucket, h, _, ch, cw, _, order, place = _requests(own, numbers, counts, model)
            seen, kinds, rest, mass = got[0].astype(np.int64), np.stack(got[1 : DISCOUNTED + 1]).astype(float), got[DISCOUNTED + 1].astype(float), got[DISCOUNTED + 2]
            # Histories were told apart within each bucket.
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (bucket[1:] != bucket[:-1])]))
            if len(split.value):
                at = np.searchsorted(split.value[:, 0], h[first])
                at = np.minimum(at, len(split.value) - 1)
                is_split = split.value[at, 0] == h[first]
                whole = split.value[at[is_split], 1:].T
                kinds[:, is_split], rest[is_split], mass[is_split] = whole[:DISCOUNTED], whole[DISCOUNTED], whole[DISCOUNTED + 1]
            whole, weight = (np.repeat(x, np.diff(np.append(first, len(h)))) for x in _weights(kinds, rest, mass, ch[first], d2))
            p = np.where(seen > 0, _effective(seen, d2) / whole, weight * model.word(cw))
            logs = np.empty(len(p))
            logs[order] = np.log10(p)
            doc = np.repeat(np.arange(len(own.lengths)), own.lengths)
            known = counts[own.tokens]
            n = len(own.lengths)
            out.append(
                pd.DataFrame(
                    {
                        "doc_id": list(ids),
                        "held_out": own.held,
                        "n_tokens": own.lengths,
                        "n_known": np.bincount(doc, known > 0, n).astype(np.int64),
                        "train_tokens": model.total,
                        "base_score": np.bincount(doc, np.log10((known + 1) / (model.total + model.types + 1)), n),
                        "score": np.bincount(doc, logs[place], n),
                    }
                )
            )
        return pd.concat(out)

    answers = words.filter(F.col("shard").isNotNull()).select("shard", "bucket", "answer", F.lit(1).alias("of"))
    answers = answers.unionByName(pairs.filter(F.col("shard").isNotNull()).select("shard", "bucket", "answer", F.lit(2).alias("of")))
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.select("shard", "ids", "text").groupBy("shard").cogroup(answers.groupBy("shard")).applyInPandas(score, schema)
