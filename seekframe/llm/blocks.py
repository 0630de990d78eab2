"""Arrow string columns as byte blocks, with vectorised words and word hashes.

A word is a run of bytes outside 0x20 and 0x09-0x0D.  UTF-8 never uses those bytes inside a
longer character, so byte runs and code point runs are the same words.  Hashes ignore the case
of A-Z only.  Everything works on one block of half a megabyte at a time, so memory follows the
block (or the longest single text), never the partition.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Text bytes that are worked on at once, and bytes of an Arrow batch that Spark hands to Python (or one row).
BLOCK_BYTES, BATCH_BYTES = 1 << 19, 8 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_SYMBOLS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLDED_SYMBOLS = _SYMBOLS[_FOLD]
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums of symbols spread over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    text = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return text[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is a range of its own."""
    _, at = raw(column)
    begin, n = 0, len(at) - 1
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
        yield begin, end
        begin = end


class Words:
    """The words of a block: ``start`` and ``end`` in ``data``, and ``first[d]:first[d + 1]`` of document d."""

    def __init__(self, data: np.ndarray, at: np.ndarray, separator: np.ndarray = _SEPARATOR):
        self.data, self.at = data, at
        inside = ~separator[data]
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        after = np.empty(len(data), bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        edge = at[(at > 0) & (at < len(data))]
        before[edge] = False
        after[edge - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, at)

    def __len__(self) -> int:
        return len(self.start)

    def document(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.first))

    def hashes(self, fold: bool = True) -> np.ndarray:
        """A 64-bit hash of each word."""
        return span_hashes(self.data, self.start, self.end, fold)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each span: a polynomial from running sums, shifted to the span's start and mixed with its length."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_FOLDED_SYMBOLS if fold else _SYMBOLS)[data] * _power_table(_MULTIPLIER, n), out=total[1:])
    value = (total[end] - total[start]) * _power_table(_INVERSE, n + 1)[start]
    return mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_of(word: bytes, fold: bool = True) -> int:
    """The hash that ``span_hashes`` gives a span with these bytes."""
    data = np.frombuffer(word, np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]), fold)[0])


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles and n + 1 offsets; with ``short``, a document of fewer words has its whole sequence as one."""
    n = np.diff(first)
    counts = np.maximum(n - width + 1, (n > 0) if short else 0)
    at = np.concatenate(([0], np.cumsum(counts)))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _power_table(_MULTIPLIER, max(len(words), 1))[: len(words)], out=total[1:])
    begin = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], counts)
    end = np.minimum(begin + width, np.repeat(first[1:], counts))
    value = (total[end] - total[begin]) * _power_table(_INVERSE, len(words) + 1)[begin]
    return mix(value + (end - begin).astype(np.uint64)), at


def crc32(ids: list) -> np.ndarray:
    """CRC-32 of each id written as text (a null counts as the text ``null``)."""
    import zlib

    return np.array([zlib.crc32(("null" if i is None else str(i)).encode()) for i in ids], np.int64)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it; a temporary one only on a local master that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            return own.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="seekframe-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(frame: DataFrame, name: str, partition: str | None = None) -> DataFrame:
    """The frame, written to the shared folder and read again: lineage ends here, and a lost executor loses nothing."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    (frame.write.partitionBy(partition) if partition else frame.write).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def _give_back() -> None:
    """What Python has freed goes back to the system: an idle worker stays for a minute, beside its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def mapped(frame: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """mapInArrow by batches of bounded bytes, not of 10,000 rows whatever their texts; a session that sets a bound keeps its own."""
    conf = frame.sparkSession.conf
    if conf.get(_BATCH_BYTES, None) is None:
        conf.set(_BATCH_BYTES, str(BATCH_BYTES))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return frame.mapInArrow(bounded, schema)


#: Runs of ASCII letters and of bytes of longer characters.
LETTER_BREAK = np.ones(256, bool)
LETTER_BREAK[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def letter_runs(data: np.ndarray, at: np.ndarray, most: int | None = None) -> Words:
    """Letter runs of a block; runs longer than ``most`` bytes are cut into pieces of that many."""
    runs = Words(data, at, LETTER_BREAK)
    if most is not None and len(runs) and (runs.end - runs.start).max() > most:
        pieces = -(-(runs.end - runs.start) // most)
        number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        end = np.repeat(runs.end, pieces)
        runs.start = np.repeat(runs.start, pieces) + number * most
        runs.end = np.minimum(runs.start + most, end)
        runs.first = np.searchsorted(runs.start, at)
    return runs


def sampled(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, the same ones each time: those with the smallest hashes of the key.

    Rows are counted by the hash's first bits beforehand, so that each task passes on only the parts that hold the
    smallest; however often a key repeats, ``most`` rows remain where there are as many.
    """
    from pyspark.sql import functions as F

    part = F.shiftright(F.xxhash64(key), 50)  # 2^14 parts: as many rows on the driver at most
    last, seen = None, 0
    for last, n in sorted(map(tuple, rows.groupBy(part.alias("part")).count().collect())):
        seen += n
        if seen >= most:
            break
    near = rows if last is None else rows.where(part <= last)
    return near.orderBy(F.xxhash64(key), key).limit(most)
