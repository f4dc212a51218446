"""Session folders and the byte-level kit shared by the operators.

Texts are handled as the flat byte buffer of an Arrow column: words, hashes and n-grams of
a whole batch come from a few numpy passes, never from a Python loop over words.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.shared import shared_dir

#: Word characters are all bytes but these (fixed values: space and \t \n \v \f \r).
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: The same as a regular expression of Java, DuckDB and Python.
WORD = r"[^\x20\x09-\x0D]+"

_BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def release(spark: SparkSession) -> None:
    """A hint to collect garbage, which lets Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def gathered(df: DataFrame, size: int, per: int = 100_000) -> DataFrame:
    """df in no more partitions than `size` rows or bytes need, `per` each, and twice the cores of the cluster at least.

    Without it, a small table is written as a file for each of hundreds of shuffle partitions.
    """
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // per)))


def cut(df: DataFrame, rows: int | None = None, per: int = 100_000) -> DataFrame:
    """df, written to the shared checkpoint folder: later plans start from there. rows: a bound of its rows, for gathered()."""
    shared_dir(df.sparkSession)
    release(df.sparkSession)
    return (df if rows is None else gathered(df, rows, per)).checkpoint(eager=True)


#: Column of a table of keys: how many rows of the other side a join by the key will find.
MEMBERS = "__lectern_members"


def join_hot(left: DataFrame, right: DataFrame, on: list[str], rows: int, how: str = "inner") -> DataFrame:
    """left joined (inner or left) with right, which has a row a key and says in MEMBERS how many of at most `rows` rows of left have it.

    Keys of more than a two-thousandth of all rows are few, 2,000 at most: they are broadcast, and
    their rows stay where they are. The rows of any other key go to one task.
    """
    limit = max(1_000, rows // 2_000)
    hot, cold = right.where(F.col(MEMBERS) > limit).drop(MEMBERS), right.where(F.col(MEMBERS) <= limit).drop(MEMBERS)
    if not hot.limit(1).count():
        return left.join(right.drop(MEMBERS), on, how)
    few = F.broadcast(hot)
    return left.join(few, on).unionByName(left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path that scratch_path() gave."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that a piece holds about `most` bytes of `column` and `rows` rows (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        end = _offsets(_strings(b.column(b.schema.get_field_index(column))))[1:]
        i = 0
        while i < b.num_rows:
            base = end[i - 1] if i else 0
            j = max(i + 1, min(i + rows, int(np.searchsorted(end, base + most, "right"))))
            yield b.slice(i, j - i)
            i = j
    pa.default_memory_pool().release_unused()


def _strings(col: pa.Array) -> pa.Array:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    binary = pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type)
    col = col.cast(pa.large_binary() if binary else pa.large_string())
    return col.fill_null(b"" if binary else "") if col.null_count else col


def _offsets(col: pa.Array) -> np.ndarray:
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    return off - off[0]


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offsets of its rows; null counts as empty."""
    col = _strings(col)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def binary_column(buf: np.ndarray, off: np.ndarray) -> pa.Array:
    """A binary column from its bytes and offsets."""
    off = np.ascontiguousarray(off, np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(np.ascontiguousarray(buf).tobytes())]).cast(pa.binary())


def words_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words before each row (with the total last)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~IS_SPACE[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] = word[edge]
    last[edge - 1] = word[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n + 1 of each."""
    have = _powers.get(0)
    if have is None or len(have[0]) <= n:
        size = max(1 << 20, 1 << int(n).bit_length())
        up, down = np.full(size + 1, _BASE, np.uint64), np.full(size + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _powers[0] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(buf)
    up, down = power_tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of every span of bytes, alike wherever the span stands.

    Long buffers are gone through piece by piece, so that memory follows the piece and the longest span.
    """
    if len(buf) <= 2 * piece or not len(start):
        return _span_hashes(buf, start, end)
    order = np.argsort(start, kind="stable")
    out, first = np.empty(len(start), np.uint64), start[order]
    i = 0
    while i < len(order):
        j = int(np.searchsorted(first, first[i] + piece))
        these = order[i:j]
        lo, hi = int(first[i]), int(end[these].max())
        out[these] = _span_hashes(buf[lo:hi], start[these] - lo, end[these] - lo)
        i = j
    return out


def ngrams(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows that lie within one row, and the row of each.

    words: hashes of words; counts: words before each row, the total last.
    """
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = words[:m].copy()
    for k in range(1, n):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[k : k + m])
    row = np.repeat(np.arange(len(counts) - 1), np.diff(counts))
    whole = row[:m] == row[n - 1 :]
    return h[whole], row[:m][whole]


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows again, sorted by key as they are, in tables that divide no group of equal keys."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        keys = held[key].to_numpy()
        earlier = np.flatnonzero(keys != keys[-1])
        if len(earlier):
            yield held.slice(0, earlier[-1] + 1)
            held = held.slice(earlier[-1] + 1)
    if held is not None and held.num_rows:
        yield held


def group_bounds(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal keys."""
    cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)])).tolist()
    return zip(cuts[:-1], cuts[1:], strict=True)


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest label reachable from every label, by links a[i] - b[i]; labels: 0, 1, 2, ..."""
    while True:
        new = labels.copy()
        np.minimum.at(new, a, labels[b])
        np.minimum.at(new, b, labels[a])
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


#: A column that holds the columns which an operator carries along, whatever their names and types.
KEEP = "__lectern_keep"


def quoted(name: str) -> str:
    """A column's name as part of a path."""
    return "`" + name.replace("`", "``") + "`"


def carried(docs: DataFrame, names: tuple[str, ...]) -> list[Column]:
    """The named columns of docs as one column KEEP; none where there are no names."""
    return [F.struct(*(docs[quoted(c)].alias(f"c{i}") for i, c in enumerate(names))).alias(KEEP)] if names else []


def kept_apart(out: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """out with columns keep_<name> instead of KEEP."""
    return out.select(*(c for c in out.columns if c != KEEP), *(F.col(f"{KEEP}.c{i}").alias(f"keep_{c}") for i, c in enumerate(names)))


def text_columns(docs: DataFrame, *more: str | Column) -> DataFrame:
    """doc_id as long, text as string and the named columns: all that an operator reads, so that extra columns of any name do no harm."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
