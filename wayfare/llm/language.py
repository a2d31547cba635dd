"""Language identification as inference of a mixture.

Every document is taken as a mixture of languages; expectation-maximisation over
its character trigrams estimates the proportions, and the set of languages is the
one with the best likelihood less a penalty per language. Trigram counts per
language are learned from its labelled rows, or from a sample where it has many.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import SLICE_BYTES, in_batches, without

#: A language of up to so many labelled rows is learned from all of them, another from about so many.
SAMPLE_ROWS = 40_000
SLOTS = 1 << 17
SMOOTHING = 0.1
ROUNDS = 12
#: Neighbouring trigrams overlap, so that a text holds about a third as much evidence as trigrams.
EVIDENCE = 1 / 3
#: What another language has to gain, in units of log(trigrams); a few foreign-looking words do not.
PENALTY = 4.0


_GAP = np.zeros(1, np.uint64)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the letter trigrams of a text, lower-cased, with counts; other characters are one gap."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(_letters()[codes], codes, 0)
    if not codes.any():
        return np.zeros(0, np.int64), np.zeros(0)
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])].astype(np.uint64)
    codes = np.concatenate([codes, _GAP]) if codes[-1] else codes
    codes = np.concatenate([_GAP, codes]) if codes[0] else codes
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    mixed = (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + c * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93)
    slots, counts = np.unique((mixed >> np.uint64(47)).astype(np.int64), return_counts=True)
    return slots, counts.astype(float)


def learn(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (language, slot) from the labelled rows of (doc_id, text, lang).

    A language of at most ``sample_rows`` rows gives all of them, another one about
    so many, picked by hash. At most ``SLOTS`` counts per language reach the driver.
    Rows without text or language teach nothing.
    """
    labelled = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("rows"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                slots, counts = trigrams(text)
                if lang not in sums:
                    sums[lang] = np.zeros(SLOTS)
                sums[lang][slots] += counts
        for lang, total in sums.items():
            slots = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(slots), pa.string()), pa.array(slots, pa.int64()), pa.array(total[slots].astype(np.int64), pa.int64())],
                names=["lang", "slot", "n"],
            )

    sampled = labelled.join(F.broadcast(sizes), "lang").filter(F.pmod(F.xxhash64("doc_id", "text"), F.col("rows")) < sample_rows).select("lang", "text")
    sums = in_batches(sampled, gather, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    packed = sums.groupBy("lang").agg(F.collect_list(F.struct("slot", "n")).alias("cells")).orderBy("lang").collect()
    counts = np.zeros((len(packed), SLOTS))
    for i, row in enumerate(packed):
        for slot, n in row.cells:
            counts[i, slot] = n
    used = max(1, int(counts.any(axis=0).sum()))
    return [r.lang for r in packed], np.log((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * (used + 1)))


def _expectation_maximisation(p: np.ndarray, counts: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions and log likelihood of ``counts`` under a mixture of the rows of ``p``."""
    total = counts.sum()
    for _ in range(ROUNDS):
        mixed = share @ p
        new = share * (p @ (counts / mixed)) / total
        if np.abs(new - share).max() < 1e-3:
            share = new
            break
        share = new
    return share, float(counts @ np.log(share @ p))


def proportions(slots: np.ndarray, counts: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Proportion of each language; zero outside the selected set."""
    k = len(logs)
    rows = logs[:, slots]
    top = rows.max(axis=0)
    p = np.exp(rows - top)
    best = np.zeros(k)
    single = p.copy()
    np.log(single, out=single, where=single > 0)
    singles = (rows - top) @ counts
    first = int(singles.argmax())
    best[first] = 1.0
    value, fee = EVIDENCE * singles[first], PENALTY * np.log(counts.sum() + 1)
    if k == 1 or value > -fee:  # no mixture can gain more than -value
        return best
    share, _ = _expectation_maximisation(p, counts, np.full(k, 1 / k))
    order = np.argsort(-share, kind="stable")
    for size in range(2, k + 1):
        chosen = order[:size]
        part, likelihood = _expectation_maximisation(p[chosen], counts, share[chosen] / share[chosen].sum())
        new = EVIDENCE * likelihood - fee * (size - 1)
        if new <= value:
            break
        value, best = new, np.zeros(k)
        best[chosen] = part
    return best


def identify(documents: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``documents`` with lang_pred, score and lang_mix (language to proportion, the selected set).

    All input columns but those of these names stay; only ``text`` is read. A text that is NULL or has no
    letter gets ``und``, score 0 and an empty map; with no language learned every
    text does. Repeated rows give repeated rows. Ties go to the first language by name.
    """
    documents = without(documents, "lang_pred", "score", "lang_mix")
    names, logs = model
    sent = documents.sparkSession.sparkContext.broadcast((names, logs.astype(np.float32)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs = sent.value
        entries = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        logs = logs.astype(float)
        for batch in batches:
            labels, scores, mixes = [], [], []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                slots, counts = trigrams(text or "") if names and text else ((), ())
                if not len(slots):
                    labels.append("und"), scores.append(0.0), mixes.append([])
                    continue
                share = proportions(slots, counts, logs)
                top = int(share.argmax())
                labels.append(names[top]), scores.append(min(1.0, float(share[top])))
                mixes.append([{"lang": names[i], "share": float(share[i])} for i in np.flatnonzero(share)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(mixes, entries)],
                names=[*batch.schema.names, "lang_pred", "score", "lang_mix"],
            )

    found = in_batches(documents, predict, f"{schema}, lang_pred string, score double, lang_mix array<struct<lang:string,share:double>>", SLICE_BYTES)
    return found.withColumn("lang_mix", F.map_from_entries("lang_mix"))


def held_out(divisor: int = 4, rest: int = 2):
    """Whether crc32 of the id as text leaves ``rest``; a NULL id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(divisor)) == rest
