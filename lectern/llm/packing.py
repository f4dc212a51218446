"""Token ids packed into rows of equal length.

Texts are tokenised; what is longer than a row is split into full rows and a rest, without loss. The rests and
the shorter sequences are packed best-fit-decreasing: from the longest, each into the row that
has the least room which still suffices. A segment tree over the amounts of free room finds
it. A packed row holds its padded ids, the cumulative lengths of its segments and, in effect,
positions that start from 0 in every segment.

Packing goes group by group. A document's group follows from its doc_id and text, and the number of groups from the
bytes of all texts, about GROUP tokens each: the same table gives the same packs however it is partitioned.
Token ids, not texts, are shuffled, once.

Cases: null and empty texts have no tokens and no segment; repeated rows are packed repeatedly, in one group;
null doc_ids are kept as such; a very long text fills rows of its own group, which then is as large as its ids; an empty table gives an
empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, mix, slices, span_hashes, text_columns

LENGTH, GROUP = 2048, 2_000_000
#: Bytes of text that a token stands for when the number of groups is set.
BYTES_A_TOKEN = 4

FIELDS = "pack long, row int, n_tokens int, doc_ids array<long>, parts array<int>, cu_seqlens array<int>, ids binary, positions binary"


class Room:
    """Bins by free room; a segment tree of counts over the amounts finds the least that suffices."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, bin_: int, free: int) -> None:
        self.bins[free].append(bin_)
        self._change(free, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """A bin with the least free room of at least need, removed, and its room."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not self.count[node]:
                    node += 1
        free = node - self.leaves
        self._change(free, -1)
        return self.bins[free].pop(), free

    def _change(self, free: int, by: int) -> None:
        node = free + self.leaves
        while node:
            self.count[node] += by
            node >>= 1


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of indices of sizes (1 to length), each row's sum at most length."""
    rows: list[list[int]] = []
    room = Room(length)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = room.take(sizes[i])
        if found is None:
            found = len(rows), length
            rows.append([])
        rows[found[0]].append(i)
        if found[1] > sizes[i]:
            room.put(found[0], found[1] - sizes[i])
    return rows


@functools.lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("packed", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pack_group(pack: int, ids: list[int | None], tokens: list[np.ndarray], length: int, pad: int) -> pa.RecordBatch:
    """The packed rows of one group of documents, in an order that does not hang on that of its documents."""
    kind = np.dtype("<u2" if pad < 1 << 16 else "<u4")
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, tokens[i].tobytes()))
    pieces = [(ids[i], k // length, tokens[i][k : k + length]) for i in order for k in range(0, len(tokens[i]), length)]
    rows = best_fit_decreasing([len(p[2]) for p in pieces], length)
    matrix = np.full((len(rows), length), pad, kind)
    positions = np.zeros((len(rows), length), np.dtype("<u2" if length <= 1 << 16 else "<u4"))
    bounds = []
    for r, members in enumerate(rows):
        at = [0]
        for i in members:
            t = pieces[i][2]
            matrix[r, at[-1] : at[-1] + len(t)] = t
            positions[r, at[-1] : at[-1] + len(t)] = np.arange(len(t))
            at.append(at[-1] + len(t))
        bounds.append(at)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([pack] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32()), pa.array([b[-1] for b in bounds], pa.int32()),
            pa.array([[pieces[i][0] for i in m] for m in rows], pa.list_(pa.int64())), pa.array([[pieces[i][1] for i in m] for m in rows], pa.list_(pa.int32())), pa.array(bounds, pa.list_(pa.int32())),
            pa.array([x.tobytes() for x in matrix], pa.binary()), pa.array([x.tobytes() for x in positions], pa.binary()),
        ],
        names=[f.split()[0] for f in FIELDS.split(", ")],
    )


def pack(docs: DataFrame, path: str, pattern: str, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Packed rows: pack and row number, n_tokens, doc_ids and parts (number of the piece of its document) of the segments, cu_seqlens, ids (little-endian, padded with the first free id), positions."""

    total = text_columns(docs).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(1, -(-total // (group * BYTES_A_TOKEN)))

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(path, pattern)
        kind = "<u2" if enc.n_vocab < 1 << 16 else "<u4"
        for b in slices(batches, "text"):
            buf, off = flat(b["text"])
            full = np.flatnonzero(np.diff(off))
            if not len(full):
                continue
            b = b.take(pa.array(full))
            h = mix(span_hashes(buf, off[full], off[full + 1]) ^ mix(b["doc_id"].fill_null(-1).to_numpy().view(np.uint64)))
            tokens = [np.asarray(enc.encode_to_numpy(t, disallowed_special=())).astype(kind).tobytes() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array((h % np.uint64(groups)).astype(np.int64)), b["doc_id"], pa.array(tokens, pa.binary())], names=["pack", "doc_id", "tokens"])

    def packed(t: pa.Table) -> pa.Table:
        n_vocab = tokenizer(path, pattern).n_vocab
        kind = "<u2" if n_vocab < 1 << 16 else "<u4"
        batch = pack_group(t["pack"][0].as_py(), t["doc_id"].to_pylist(), [np.frombuffer(x, kind) for x in t["tokens"].to_pylist()], length, n_vocab)
        return pa.Table.from_batches([batch])

    return text_columns(docs).mapInArrow(tokenised, "pack long, doc_id long, tokens binary").groupBy("pack").applyInArrow(packed, FIELDS)


def write(packed: DataFrame, path: str) -> None:
    """Write the packs as Parquet: a record holds one row of the id matrix, one of the positions, and the cumulative lengths."""
    packed.write.parquet(path)


def matrices(rows: pa.Table, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The id matrix and the matrix of positions of rows of a written pack."""
    return tuple(np.frombuffer(b"".join(data), f"<u{len(data[0]) // length}" if data else "<u2").reshape(-1, length) for data in (rows["ids"].to_pylist(), rows["positions"].to_pylist()))


def digests(packed: DataFrame) -> DataFrame:
    """packed with hashes instead of the matrices."""
    return packed.select("pack", "row", "n_tokens", "doc_ids", "parts", "cu_seqlens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"))
