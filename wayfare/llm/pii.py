"""Personal data: base patterns plus spans that a conditional random field adds.

The field reads the neighbourhoods of words that hold a digit, an '@' or a
bracketed 'at' or 'dot', or are one of these two, in any case; every other word is outside by definition. A span it
finds is added where no base span overlaps it and its digits fit its kind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm import pii_crf
from wayfare.llm.common import in_batches, without
from wayfare.llm.pii_rules import KINDS, base_spans, luhn, valid_ip

CONTEXT = 2
_CUE = re.compile(r"[0-9@]+|[\[(](?i:at|dot)[\])]|(?<!\S)(?i:at|dot)(?!\S)")
_SPACE = re.compile(r"\s")
_WORD = re.compile(r"\S+")
_DIGIT = re.compile(r"[0-9]")
_OUTER = re.compile(r"[^0-9A-Za-z+(]*(.*?)[^0-9A-Za-z]*", re.S)


def _neighbourhoods(text: str) -> Iterator[list[re.Match]]:
    """Runs of words that stand within CONTEXT words of a cue, whole texts, in linear time."""
    pending: list[re.Match] = []  # the last words seen before a cue
    run: list[re.Match] = []
    quiet = 0
    cue = _CUE.search(text)
    if cue is None:
        return
    at = max(0, text.rfind(" ", 0, cue.start()))
    for _ in range(4 * CONTEXT):  # start a few words before the first cue
        at = max(0, max(text.rfind(" ", 0, at), text.rfind("\n", 0, at)))
    for word in _WORD.finditer(text, at):
        if cue is not None and word.end() > cue.start():
            run += [*pending, word] if not run else [word]
            pending, quiet = [], 0
            cue = _CUE.search(text, word.end())
        elif run:
            quiet += 1
            run.append(word)
            if quiet == 2 * CONTEXT:
                yield run[:-CONTEXT]
                run, pending = [], run[-CONTEXT:]
                if cue is None:
                    return
        else:
            if cue is None:
                return
            pending = [*pending, word][-CONTEXT:]
    if run:
        yield run


def _fits(kind: str, text: str) -> bool:
    digits = "".join(_DIGIT.findall(text))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        quad = re.fullmatch(r"([0-9]+(?:\.[0-9]+){3})(?::[0-9]+)?", text)
        return bool(quad) and valid_ip(quad[1])
    if kind == "phone":
        return 7 <= len(digits) <= 15 and not re.search(r"[A-Za-z]", text)
    return bool(re.search(r"@|\bat\b", text, re.I)) and bool(re.search(r"\.|\bdot\b", text, re.I))


def added_spans(field: pii_crf.Field, texts: list[str], base: list[list[tuple[int, int, str]]]) -> list[list[tuple[int, int, str]]]:
    """For each text the field's spans that overlap no base span, by start."""
    places, sequences = [], []
    for i, text in enumerate(texts):
        for run in _neighbourhoods(text):
            places.append((i, run))
            sequences.append([m[0] for m in run])
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for (i, run), path in zip(places, field.decode(sequences)):
        if not any(path):
            continue
        tags = [pii_crf.TAGS[p] for p in path]
        t = 0
        while t < len(tags):
            if tags[t] == "O":
                t += 1
                continue
            kind, u = tags[t][2:], t + 1
            while u < len(tags) and tags[u] == f"I-{kind}":
                u += 1
            inner = _OUTER.fullmatch(texts[i], run[t].start(), run[u - 1].end())
            t = u
            if inner is None or inner.start(1) == inner.end(1):
                continue
            span = (inner.start(1), inner.end(1), kind)
            if _fits(kind, inner[1]) and not any(a < span[1] and span[0] < b for a, b, _ in base[i]):
                out[i].append(span)
    return out


def joined(spans: Iterable[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each span, or each group of overlapping spans, replaced by its first kind in brackets."""
    parts, end = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))):
        if a >= end:
            parts += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*parts, text[end:]])


def find_pii(documents: DataFrame, field: pii_crf.Field | None = None, text: str = "text") -> DataFrame:
    """``documents`` with pii_base and pii_added (arrays of start, end, kind) and pii_redacted.

    Every column of the input but those of these names stays; a NULL text has no spans and stays NULL, an
    empty one has none. Repeated rows give repeated rows. Offsets are code points,
    end exclusive. ``field`` defaults to one trained on the 600 rows of
    ``pii_crf.labelled_table()``, and any other table can be trained on.
    """
    documents = without(documents, "pii_base", "pii_added", "pii_redacted")
    field = field or pii_crf.default_field()
    model = documents.sparkSession.sparkContext.broadcast((field.names, field.emit, field.step))
    spans = "array<struct<start:int,end:int,kind:string>>"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pii_crf.Field(*model.value)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                given = part.column(part.schema.get_field_index(text)).to_pylist()
                texts = [t or "" for t in given]
                base = [base_spans(t) for t in texts]
                added = added_spans(own, texts, base)
                clean = [g if g is None or not (b or a) else redacted(g, b + a) for g, b, a in zip(given, base, added)]
                as_rows = [[[dict(zip(("start", "end", "kind"), s)) for s in row] for row in rows] for rows in (base, added)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(as_rows[0], kind), pa.array(as_rows[1], kind), pa.array(clean, pa.string())],
                    names=[*part.schema.names, "pii_base", "pii_added", "pii_redacted"],
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return in_batches(documents, find, f"{schema}, pii_base {spans}, pii_added {spans}, pii_redacted string")


def pii_report(documents: DataFrame, field: pii_crf.Field | None = None) -> DataFrame:
    """Per document the number of base spans by kind, a digest of them, and all spans as text."""
    found = find_pii(documents.select("doc_id", "text"), field).drop("text", "pii_redacted")

    def listed(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    order = F.array(*(F.lit(k) for k in KINDS))
    by_start = F.transform(
        F.array_sort(
            F.transform(
                F.concat("pii_base", "pii_added"),
                lambda s: F.struct(s["start"], F.array_position(order, s["kind"]).alias("place"), s["end"], s["kind"]),
            )
        ),
        lambda s: F.struct(s["start"], s["end"], s["kind"]),
    )
    return found.withColumn("every", by_start).select(
        "doc_id",
        *(count(k) for k in KINDS),
        F.sha2(listed("pii_base").cast("binary"), 256).alias("base_sha256"),
        listed("every").alias("spans"),
        F.size("pii_added").cast("long").alias("n_added"),
    )
