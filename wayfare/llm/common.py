"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wayfare.session import use_checkpoint_dir

#: A word is a run of anything but the six ASCII white-space characters.
WORD_CLASS = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_CLASS)

#: Texts that a task turns into Python objects at a time.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(text: str) -> str:
    """Lower-case A-Z only, as bytes.lower() does; str.lower() would change other scripts too."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp()), "wayfare-code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("wayfare", os.path.relpath(full, root)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def in_batches(frame: DataFrame, function, schema: str, most_bytes: int | None = None) -> DataFrame:
    """``frame.mapInArrow`` with this package's code at hand on the executors.

    With ``most_bytes``, batches are cut to about that size, which bounds what
    ``function`` makes of one batch of texts. A worker that is done gives its free
    memory back, as it waits for a minute beside the workers of the next stage.
    """
    ship(frame.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches if most_bytes is None else smaller(batches, most_bytes))
        finally:
            give_back()

    return frame.mapInArrow(run, schema)


def give_back() -> None:
    """Return free memory of Arrow and, where the C library can do so, of malloc to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def smaller(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most_bytes``, a row at least."""
    for batch in batches:
        rows = max(1, batch.num_rows * most_bytes // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def without(frame: DataFrame, *names: str) -> DataFrame:
    """``frame`` without the columns that bear one of ``names``, in any case."""
    taken = {n.lower() for n in names}
    return frame.select(*(f"`{c}`" for c in frame.columns if c.lower() not in taken))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names."""
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/llm-{uuid.uuid4().hex}"


def written(frame: DataFrame) -> DataFrame:
    """The same rows, read back from a table in the shared folder.

    Later jobs neither repeat the work behind it nor depend on an executor's disk.
    """
    path = shared_folder(frame.sparkSession)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
