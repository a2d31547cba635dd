"""Token counts by a map-side look-up in two tiers.

A byte-level BPE never joins across pre-tokens, so a text has as many tokens as
its pre-tokens have together. Tier one is a broadcast table with the lengths of
frequent pre-tokens, gathered from a bounded sample of rows; tier two is a cache
in each Python worker that is filled by encoding what tier one misses. Neither
tier changes a result, whatever the sample holds, and no pre-token is shuffled.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import in_batches

SAMPLE_ROWS = 4000
TABLE_SIZE = 60_000
CACHE_SIZE = 300_000
PIECE = 1 << 20

#: The pre-token pattern and the special token of byte_bpe_50k.json.
PRE_TOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    r"| ?[^\s\p{L}\p{N}\x1c-\x1f]+| ?[\x1c-\x1f]+"
    r"|[^\S\x1c-\x1f]+(?![^\s\x1c-\x1f])(?![\x1c-\x1f])|[^\S\x1c-\x1f]+"
)
SPECIAL = "<|endoftext|>"

#: Scripts whose letters and digits are the same in every Unicode version in use.
#: A text with any other character is encoded as a whole by the library.
SETTLED = regex.compile(
    "[^\x00-\x1b\x20-ԧא-תؠ-يऄ-हก-ะḀ-ỿ"
    " -⁤₠-₵℀-ↄ←-⏳─-⛿　-〩ぁ-ゖァ-ヺ"
    "一-龥가-힣！-ﾟ\U0001f300-\U0001f5ff]"
)
CUT = regex.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def _pieces(text: str) -> Iterator[str]:
    """A long text in pieces, cut where a letter, a space and a letter meet.

    A pre-token always begins at such a space, so pieces change nothing.
    """
    start = 0
    while len(text) - start > PIECE:
        found = CUT.search(text, start + PIECE)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


class Counts:
    """Token counts of texts with one tokenizer file, in one Python worker."""

    def __init__(self, tokenizer: str, frequent: bytes = b""):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        self.frequent = dict(json.loads(zlib.decompress(frequent))) if frequent else {}
        self.lengths = dict(self.frequent)

    def encode(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.library.encode_batch(texts, add_special_tokens=False)]

    def segment(self, text: str) -> int:
        if not text:
            return 0
        if SETTLED.search(text):
            return self.encode([text])[0]
        total = 0
        for piece in _pieces(text):
            tokens = PRE_TOKEN.findall(piece)
            found = list(map(self.lengths.get, tokens))
            if None in found:
                missing = list({t for t, n in zip(tokens, found) if n is None})
                if len(self.lengths) + len(missing) > CACHE_SIZE + len(self.frequent):
                    self.lengths = dict(self.frequent)
                new = dict(zip(missing, self.encode(missing)))
                total += sum(new[t] if n is None else n for t, n in zip(tokens, found))
                self.lengths.update(new)
            else:
                total += sum(found)
        return total

    def text(self, text: str) -> int:
        if SPECIAL not in text:
            return self.segment(text)
        parts = text.split(SPECIAL)
        return len(parts) - 1 + sum(map(self.segment, parts))


def frequent_pre_tokens(
    documents: DataFrame, tokenizer: str, sample_rows: int = SAMPLE_ROWS, size: int = TABLE_SIZE
) -> bytes:
    """Tier one: the most frequent pre-tokens of about ``sample_rows`` rows with their lengths.

    At most ``size`` rows reach the driver; each pre-token is cut off at 64 characters.
    """
    step = max(1, documents.count() // sample_rows)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for piece in _pieces(text or ""):
                    counts.update(t for t in PRE_TOKEN.findall(piece) if len(t) <= 64)
        names = [t for t, n in counts.items() if n > 1]
        yield pa.RecordBatch.from_pydict({"token": pa.array(names, pa.string()), "n": pa.array([counts[t] for t in names], pa.int64())})

    sampled = documents.filter(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).select("text")
    rows = (
        in_batches(sampled, gather, "token string, n long")
        .groupBy("token")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "token")
        .limit(size)
        .collect()
    )
    counter = Counts(tokenizer)
    names = [r.token for r in rows if not SETTLED.search(r.token)]
    return zlib.compress(json.dumps(list(zip(names, counter.encode(names) if names else []))).encode())


def token_counts(documents: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``documents``.

    Needs doc_id and text; other columns are ignored. NULL text counts as empty
    (0 bytes, 0 tokens); NULL ids are kept; repeated rows give repeated rows; no
    rows give none. Texts of any length are counted whole.
    """
    known = documents.sparkSession.sparkContext.broadcast(frequent_pre_tokens(documents, tokenizer))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counts(tokenizer, known.value)
        for batch in batches:
            numbers = [counter.text(t) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(numbers, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    rows = documents.select(
        "doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    )
    kind = documents.schema["doc_id"].dataType.simpleString()
    return in_batches(rows, count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
