"""Periodic runs of words by a dictionary of basic factors.

All stretches of 1, 2, 4, 8, ... words get a number per length, equal stretches of
a document the same one: a stretch of double length is a pair of numbers. Where
a stretch begins again within twice its length, the distance is a candidate for a
period; positions in a row with one distance form a progression, which says where
the candidate holds. Each is extended as far as words agree, and the same run
found from several lengths is kept once.

A run with period q has 3 q words or more, so a stretch of the next power of two
from q on lies in it twice, at distance q and no nearer: no run is missed. And a
progression contains a whole stretch and its successor, so no smaller distance is
a period of what grows from it. As a run has 24 words at least, those of periods
up to 8 all show in stretches of 8 words.

Texts are worked on in batches of whole texts inside tasks; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import SLICE_BYTES, in_batches

LEAST_WORDS = 24
LEAST_TIMES = 3


class Run(NamedTuple):
    start: int
    length: int
    period: int


def numbers_of(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All words as numbers, equal for equal words of one document only; and where each document begins."""
    offsets = np.zeros(len(documents) + 1, np.int64)
    np.cumsum([len(words) for words in documents], out=offsets[1:])
    numbers = np.empty(offsets[-1], np.int64)
    known = 0
    for words, first in zip(documents, offsets):
        table = {w: known + i for i, w in enumerate(set(words))}
        known += len(table)
        numbers[first : first + len(words)] = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
    return numbers, offsets


def _renamed(places: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose name occurs again, with names from 0; sorted by name, then place."""
    order = np.argsort(names, kind="stable")
    places, names = places[order], names[order]
    new = np.ones(len(names) + 1, bool)
    new[1:-1] = names[1:] != names[:-1]
    again = ~(new[:-1] & new[1:])
    return places[again], (np.cumsum(new[:-1]) - 1)[again]


def proposals(numbers: np.ndarray, least: int = LEAST_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """First place, last place and period of progressions, length by length."""
    factor_of = np.full(len(numbers), -1, np.int64)
    places, names = _renamed(np.arange(len(numbers)), numbers)
    width = 1
    while len(places):
        # Periods up to a third of the least run show in the first width from there on.
        if width >= least // LEAST_TIMES:
            gap = places[1:] - places[:-1]
            near = (names[1:] == names[:-1]) & (gap <= 2 * width)
            start, period = places[:-1][near], gap[near]
            order = np.argsort(start)
            start, period = start[order], period[order]
            breaks = np.flatnonzero((start[1:] != start[:-1] + 1) | (period[1:] != period[:-1])) + 1
            first, last = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(start)]]) - 1
            if len(start):
                yield start[first], start[last] + width - 1, period[first]
        factor_of[:] = -1
        factor_of[places] = names
        on = places + width < len(numbers)
        right = np.where(on, factor_of[np.where(on, places + width, 0)], -1)
        pairs = right >= 0
        places, names = _renamed(places[pairs], names[pairs] * (len(numbers) + 1) + right[pairs])
        width *= 2


def _agreeing(numbers: np.ndarray, period: int, place: int, end: int, step: int) -> int:
    """How many places from ``place`` on, up to ``end``, in direction ``step``, agree with the word a period later."""
    size, total = 64, 0
    while (count := min(size, (end - place) * step)) > 0:
        low = place if step > 0 else place - count + 1
        equal = numbers[low : low + count] == numbers[low + period : low + count + period]
        wrong = np.flatnonzero(~equal[::step])
        if len(wrong):
            return total + int(wrong[0])
        total, place, size = total + count, place + step * count, size * 2
    return total


def runs_of(documents: list[list[bytes]], least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> list[list[Run]]:
    """The runs of every document, by start and period. ``times`` is 3 or more."""
    if times < LEAST_TIMES:
        raise ValueError("a run must hold its period three times")
    numbers, offsets = numbers_of(documents)
    known: dict[int, list[tuple[int, int]]] = {}
    found: list[list[Run]] = [[] for _ in documents]
    for firsts, lasts, periods in proposals(numbers, least):
        order = np.lexsort((firsts, periods))
        done: tuple[int, int, int] = (0, 0, 0)  # period, start and end of the last run looked at
        for i in order:
            first, last, period = int(firsts[i]), int(lasts[i]), int(periods[i])
            if done[0] == period and first < done[2] - period:
                continue
            at = int(np.searchsorted(offsets, first, "right")) - 1
            low, high = int(offsets[at]), int(offsets[at + 1])
            start = first - _agreeing(numbers, period, first - 1, low - 1, -1)
            end = last + 1 + _agreeing(numbers, period, last + 1, high - period, 1) + period
            done = (period, start, end)
            if end - start >= max(least, times * period):
                found[at].append(Run(start - low, end - start, period))
    return [sorted(set(runs), key=lambda r: (r.start, r.period)) for runs in found]


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """``words`` without those that a run repeats, that is, all of it after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for run in runs:
        keep[run.start + run.period : run.start + run.length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def strongest(runs: list[Run]) -> Run | None:
    """The run with most repetitions; of equal ones that with the smallest start, then period."""
    return max(runs, key=lambda r: (Fraction(r.length, r.period), -r.start, -r.period), default=None)


def repeated(words: list[bytes], code: int) -> list[bytes]:
    """``words`` with a periodic tail, where the contract's code of the document asks for one."""
    n = len(words)
    if code % 10 or not n:
        return words
    a = code // 10 % n
    p = 1 + (n - a) // (3 + code // 10 % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def periodic_runs(documents: DataFrame, tail_code: Column | None = None) -> DataFrame:
    """doc_id, n_runs, the strongest run, runs_sha256, collapsed_sha256 and collapsed (the text that is left) of every row.

    Needs doc_id and text; other columns are ignored. ``tail_code`` (long) asks for
    a periodic tail put into the words first, as ``repeated`` does. NULL, empty and
    short texts have no run; columns of the strongest run are then NULL. NULL ids
    are kept; repeated rows give repeated rows; no rows give none. Texts of any
    length are worked on whole.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [(t or b"").split() for t in batch.column("words").to_pylist()]
            words = [w if code is None else repeated(w, code) for w, code in zip(words, batch.column("code").to_pylist())]
            every = runs_of(words)
            best = [strongest(runs) for runs in every]
            left = [b" ".join(collapsed(w, runs)) for w, runs in zip(words, every)]
            listed = ["".join(f"{r.start},{r.length},{r.period}\n" for r in runs) for runs in every]
            numbers = {
                "start": [r and r.start for r in best],
                "length": [r and r.length for r in best],
                "period": [r and r.period for r in best],
                "exponent_milli": [r and 1000 * r.length // r.period for r in best],
            }
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_runs": pa.array(list(map(len, every)), pa.int64()),
                    **{c: pa.array(v, pa.int64()) for c, v in numbers.items()},
                    "runs_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in listed]),
                    "collapsed_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in left]),
                    "collapsed": pa.array(left, pa.binary()).cast(pa.string()),
                }
            )

    code = F.lit(None).cast("long") if tail_code is None else tail_code.cast("long")
    rows = documents.select("doc_id", F.col("text").cast("binary").alias("words"), code.alias("code"))
    schema = f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string"
    return in_batches(rows, search, schema, SLICE_BYTES)
