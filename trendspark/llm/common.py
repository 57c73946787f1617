"""What the operators share: bounded Arrow batches, contiguous groups within sorted partitions, spanning stars."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: long texts must not fill a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
#: Bytes of texts, and texts, that array operations take at once.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 256


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session, unless its own bounds are lower."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not str(now).isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until df has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def slices(texts: list[bytes], most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[list[bytes]]:
    """The texts in order, in lists of at most `rows` texts and `most` bytes or of one text; at least one list, if only an empty one."""
    some: list[bytes] = []
    size = 0
    for t in texts:
        if some and (size + len(t) > most or len(some) >= rows):
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    yield some


def as_batch(arrays: dict[str, pa.Array | np.ndarray | list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in arrays.values()], names=list(arrays))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of equal keys in a partition that is sorted by them; a group may span batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        change = np.zeros(t.num_rows, dtype=bool)
        for k in keys:
            x = t[k].to_numpy()
            change[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), t.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(t[k][a].as_py() for k in keys)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held)


def link(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the nodes a[i] and b[i] in labels, which maps each node to the smallest one of its set, in place."""
    while len(a):
        ra, rb = labels[a], labels[b]
        if not (open_ := ra != rb).any():
            return
        ra, rb, a, b = ra[open_], rb[open_], a[open_], b[open_]
        np.minimum.at(labels, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


def in_groups(df: DataFrame, keys: list[str], partitions: int, work: Callable, schema: str, then: list[str] = ()) -> DataFrame:
    """work over a partition that holds whole groups of the keys, sorted by them and then by `then`."""
    return df.repartition(partitions, *keys).sortWithinPartitions(*keys, *then).mapInArrow(work, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
