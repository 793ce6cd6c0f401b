"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Java regex and character list of the white space that separates words.
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder of spark.checkpoint.dir and cut its lineage.

    The folder is only made up here for a local master, where nothing is shared anyway.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="dwell-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def tidy(run: Callable) -> Callable:
    """``run`` over a task's batches, after which freed memory goes back to the system, as workers outlive tasks."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the usual C library only
        if trim is not None:
            trim(0)

    return whole


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def spark_words(text: Column) -> Column:
    """Array of the words of ``text`` (runs of anything but ASCII white space); null text: none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_RUN)
    return F.filter(parts, lambda w: w != "")


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns)
    )


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending uint64 values as compressed byte planes of their differences."""
    deltas = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    planes = np.ascontiguousarray(deltas.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def sorted_runs(batches: Iterator[pa.RecordBatch], key: list[str], most: int):
    """Yield (key arrays' run, long) over batches sorted by ``key``; runs reach over batches.

    Yields numpy columns of one or more whole runs with their bounds: (columns, starts, ends, state).
    A run longer than ``most`` rows comes in several pieces, with state "more" for its pieces, so
    that memory stays bounded.
    """
    held: dict[str, np.ndarray] | None = None
    open_key = None  # key of a run that is already known to be long

    def split(columns):
        n = len(columns[key[0]])
        change = np.zeros(n, bool)
        change[0] = True
        for k in key:
            change[1:] |= columns[k][1:] != columns[k][:-1]
        starts = np.flatnonzero(change)
        return starts, np.append(starts[1:], n)

    for b in batches:
        if b.num_rows == 0:
            continue
        new = {name: b.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(b.schema.names)}
        columns = new if held is None else {k: np.concatenate([held[k], new[k]]) for k in new}
        starts, ends = split(columns)
        if open_key is not None:
            if tuple(columns[k][0] for k in key) == open_key:
                yield {k: v[: ends[0]] for k, v in columns.items()}, np.array([0]), np.array([ends[0]]), "more"
                columns = {k: v[ends[0] :] for k, v in columns.items()}
                starts, ends = starts[1:] - ends[0], ends[1:] - ends[0]
                if not len(starts):
                    held = None
                    continue
            open_key = None
        last = starts[-1]
        if last:
            head = {k: v[:last] for k, v in columns.items()}
            long = np.flatnonzero(ends[:-1] - starts[:-1] > most)
            short = np.flatnonzero(ends[:-1] - starts[:-1] <= most)
            if len(short):
                yield head, starts[short], ends[short], "whole"
            for i in long:
                yield {k: v[starts[i] : ends[i]] for k, v in head.items()}, np.array([0]), np.array([ends[i] - starts[i]]), "more"
        held = {k: v[last:].copy() for k, v in columns.items()}
        if len(held[key[0]]) > most:
            open_key = tuple(held[k][0] for k in key)
            yield held, np.array([0]), np.array([len(held[key[0]])]), "more"
            held = None
    if held is not None:
        yield held, np.array([0]), np.array([len(held[key[0]])]), "whole"


def offsets(column: pa.Array) -> np.ndarray:
    """The first byte of each text of a string column, and the end."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
