"""Suffix-array removal of byte strings that an earlier document has already.

Every byte is removed that is covered by a string of SPAN bytes which also starts in a
document with a smaller doc_id. Comparing all suffixes of a corpus is needless: a string can
only stand twice if its anchor does. The anchor of a string is the least of the hashes of its
GRAM-byte substrings (winnowing, Schleimer et al. 2003), so equal strings have equal anchors
at equal places, and neighbouring strings mostly share one. The strings of one anchor form a
run, and the bytes they cover its context.

1. Documents are packed into blocks. Runs of one block with equal contexts, byte by byte, are one
   entry. Each block sends a hash of every entry's anchor to a bucket of that hash.
2. A bucket answers which anchors it met more than once. Hashes only choose candidates: whatever
   is removed later was compared byte by byte.
3. Every entry of such an anchor is sent with its context, and the contexts are sorted: multikey
   quicksort, eight bytes a step, to a shallow depth; then groups that agree so far are compared to their ends,
   and blind tries order those that do not agree. Of equal contexts the first document is
   known. Where an anchor has contexts that differ, their suffixes, cut to SPAN bytes, are sorted in the same way, and
   neighbours that share SPAN bytes are one string. Every block learns which strings of its entries stand in an
   earlier document.
4. Each block removes the covered bytes.

Anchors with more than HOT entries send their strings one by one, dealt by the string, so that no
anchor's contexts need to fit into one task. Blocks grow with the corpus, so that there are 16,000 or
so at most below a corpus of 1 TB; a string that all of them hold makes as many short rows in one task.

Cases: null text is empty; texts shorter than SPAN lose nothing; equal doc_ids do not remove
each other's bytes; rows with a null doc_id neither lose nor remove anything; very long texts are
handled in pieces, their strings all the same; columns to carry may have any name and type; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEEP, binary_column, carried, cut, flat, gathered, kept_apart, mix, power_tables, release, slices, span_hashes, text_columns

SPAN, GRAM = 50, 19
WINDOW = SPAN - GRAM + 1
SHALLOW = 32
#: Bytes of text of a block: a 16,000th of the corpus within these bounds.
BLOCK, LARGE_BLOCK, BLOCKS = 2 << 20, 64 << 20, 16_000
HOT = 20_000
#: Bits of the hashes of contexts by which runs of one block are compared.
CONTEXT_BITS = 48
#: Bytes of compressed text for each bucket of anchors and of contexts.
ANCHOR_BUCKET, CONTEXT_BUCKET = 8 << 20, 2 << 20
_SALT = np.uint64(0xA0761D6478BD642F)


def compressed(data: bytes) -> bytes:
    """Texts are compressed once and shuffled several times: a middle level of zstd."""
    return pa.Codec("zstd", compression_level=6).compress(data, asbytes=True)


class Runs:
    """Runs of strings with one anchor: first and last start, anchor's place, row, hash of anchor, hash of context, hash of both."""

    def __init__(self, first, last, place, row, anchor, context):
        self.first, self.last, self.place, self.row, self.anchor, self.context = first, last, place, row, anchor, context
        self.key = mix(anchor * np.uint64(0xD6E8FEB86659FD93) + context)


def _winnow(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    n = len(buf)
    up, down = power_tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    gram = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    bits = np.uint64(max(24, int(n).bit_length()))
    least = ((gram >> bits) << bits) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while width * 2 <= WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < WINDOW:
        least = np.minimum(least[: len(least) - (WINDOW - width)], least[WINDOW - width :])
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, off[:-1], 1)
    np.add.at(step, np.maximum(off[:-1], off[1:] - SPAN + 1), -1)
    valid = np.cumsum(step, dtype=np.int32)[: len(least)] > 0
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    change = np.ones(len(at) + 1, bool)
    change[1:-1] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
    first, last = np.flatnonzero(change[:-1] & valid), np.flatnonzero(change[1:] & valid)
    place = at[first]
    anchor = mix(gram[place] + _SALT) >> np.uint64(24)
    context = (total[last + SPAN] - total[first]) * down[first]
    context = mix(mix(context + (last - first).astype(np.uint64)) + (place - first).astype(np.uint64)) >> np.uint64(16)
    return first, last, place, np.searchsorted(off, first, "right") - 1, anchor, context


def runs_of(buf: np.ndarray, off: np.ndarray, piece: int = 1 << 20) -> Runs:
    """The runs of all rows, in order; worked out piece by piece to bound memory."""
    found, i, rows = [], 0, len(off) - 1

    def add(lo: int, at: np.ndarray, row: int) -> None:
        f, l, p, r, a, c = _winnow(buf[lo : lo + at[-1]], at)
        found.append((f + lo, l + lo, p + lo, r + row, a, c))

    while i < rows:
        j = max(i + 1, int(np.searchsorted(off, off[i] + piece, "right")) - 1)
        lo, hi = int(off[i]), int(off[j])
        if hi - lo > 2 * piece:
            # One long text: its strings are divided. A run that is cut counts as two, with contexts of their own.
            for at in range(lo, hi - SPAN + 1, piece):
                add(at, np.array([0, min(piece + SPAN - 1, hi - at)]), i)
        elif hi - lo >= SPAN:
            add(lo, off[i : j + 1] - lo, i)
        i = j
    if not found:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    return Runs(*(np.concatenate(x) for x in zip(*found, strict=True)))


def blind_trie(strings: list[bytes]) -> list[list[int]]:
    """The numbers of strings of one length in order, equal ones together, by a blind trie.

    A node holds only the number of the first bit in which its two branches differ. A string goes down
    by its bits at those places alone, is compared once, with the string of the leaf it
    reaches, and joins it or is inserted where the two differ.
    """
    width = 8 * len(strings[0])
    numbers = [int.from_bytes(s, "big") for s in strings]
    same: dict[int, list[int]] = {0: [0]}
    root: list | int = 0
    for i in range(1, len(numbers)):
        x, node = numbers[i], root
        while not isinstance(node, int):
            node = node[1 + (x >> (width - 1 - node[0]) & 1)]
        if x == numbers[node]:
            same[node].append(i)
            continue
        same[i] = [i]
        differ = width - (x ^ numbers[node]).bit_length()
        above, node = None, root
        while not isinstance(node, int) and node[0] < differ:
            above, node = (node, side := 1 + (x >> (width - 1 - node[0]) & 1)), node[side]
        fresh = [differ, node, i] if x >> (width - 1 - differ) & 1 else [differ, i, node]
        if above is None:
            root = fresh
        else:
            above[0][above[1]] = fresh
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, int):
            out.append(same[node])
        else:
            stack += [node[2], node[1]]
    return out


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """The order of strings of one length."""
    return [i for leaf in blind_trie(strings) for i in leaf]


def _heads(new: np.ndarray) -> np.ndarray:
    """The place of the last set flag at or before each place."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def multikey_quicksort(buf: np.ndarray, start: np.ndarray, group: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """place of every string, where its class begins in the order, and the strings that did not part within `limit` bytes, class by class.

    Strings are compared within their groups, the eight bytes at a group's depth at a time. Each step divides every
    group in three by the word of its middle string: less, equal, more; where equal, the depth grows. buf ends with 8 bytes of padding.
    """
    eight = np.lib.stride_tricks.sliding_window_view(buf, 8)
    place, deep = np.zeros(len(start), np.int64), []
    active = np.argsort(group, kind="stable")
    new = np.ones(len(active), bool)
    new[1:] = group[active][1:] != group[active][:-1]
    base, depth = _heads(new), np.zeros(len(active), np.int64)
    place[active] = base

    def several(*columns: np.ndarray) -> list[np.ndarray]:
        size = np.diff(np.append(np.flatnonzero(new), len(new)))
        keep = np.repeat(size > 1, size)
        return [c[keep] for c in columns]

    active, base, depth = several(active, base, depth)
    while len(active):
        new = np.ones(len(active), bool)
        new[1:] = base[1:] != base[:-1]
        word = np.ascontiguousarray(eight[start[active] + depth]).view(">u8").ravel().astype(np.uint64)
        first = np.flatnonzero(new)
        number = np.cumsum(new) - 1
        pivot = word[first + np.diff(np.append(first, len(new))) // 2][number]
        side = 3 * number + 1 + (word > pivot) - (word < pivot)
        o = np.argsort(side, kind="stable")
        old, side = _heads(new), side[o]
        new[1:] = side[1:] != side[:-1]
        active, depth = active[o], depth[o] + 8 * (side % 3 == 1)
        base = base + _heads(new) - old
        place[active] = base
        active, base, depth = several(active, base, depth)
        done = depth >= limit
        deep.append(active[done])
        active, base, depth = active[~done], base[~done], depth[~done]
    deep = np.concatenate(deep) if deep else np.zeros(0, np.int64)
    return place, deep[np.argsort(place[deep], kind="stable")]


def same_strings(buf: np.ndarray, start: np.ndarray, length: np.ndarray | None = None, group: np.ndarray | None = None) -> np.ndarray:
    """Sort strings and number the distinct ones of each group in their order. buf ends with 8 bytes of padding.

    length: SPAN by default, and at least that; one length a group. group: numbers that equal strings share; one group by default.
    Deep-shallow: a multikey quicksort to depth SHALLOW; classes that did not part are compared with their first
    string to the end, and those not all equal are ordered by a blind trie.
    """
    length = np.full(len(start), SPAN) if length is None else length
    place, deep = multikey_quicksort(buf, start, np.zeros(len(start), np.int64) if group is None else group, SHALLOW)
    if not len(deep):
        return place
    new = np.ones(len(deep), bool)
    new[1:] = place[deep][1:] != place[deep][:-1]
    head = deep[_heads(new)]
    rest = np.arange(int(length[deep].max()) - SHALLOW)
    equal = np.ones(len(deep), bool)
    for lo in range(0, len(deep), 1 << 14):
        mine, other = deep[lo : lo + (1 << 14)], head[lo : lo + (1 << 14)]
        # What lies beyond a string's end is compared with itself.
        at = np.minimum(rest, (length[mine] - SHALLOW - 1)[:, None]) + SHALLOW
        equal[lo : lo + (1 << 14)] = (buf[start[mine][:, None] + at] == buf[start[other][:, None] + at]).all(1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(deep))
    parted = np.flatnonzero(np.logical_and.reduceat(equal, first) == 0)
    text = buf.tobytes() if len(parted) else b""
    for lo, hi in zip(first[parted].tolist(), last[parted].tolist(), strict=True):
        mine = deep[lo:hi]
        at = int(place[mine[0]])
        for leaf in blind_trie([text[p + SHALLOW : p + n] for p, n in zip(start[mine].tolist(), length[mine].tolist(), strict=True)]):
            place[mine[leaf]] = at
            at += len(leaf)
    return place


def _narrow(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _wide(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _bytes_at(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of n bytes from each of first on, one after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Block:
    """The documents of a block in order of doc_id, and what all steps derive from them alike.

    entry: the number of each run's entry; runs of one entry have equal contexts. where: the first run of each entry.
    """

    def __init__(self, row: dict, context_bits: int = CONTEXT_BITS):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.off = np.frombuffer(row["off"], np.int64)
        size = int(self.off[-1])
        self.buf = np.frombuffer(pa.decompress(row["data"], size, codec="zstd"), np.uint8) if size else np.zeros(0, np.uint8)
        self.runs = runs = runs_of(self.buf, self.off)
        key = mix(runs.anchor * np.uint64(0xD6E8FEB86659FD93) + (runs.context >> np.uint64(48 - context_bits)))
        _, self.where, self.entry = np.unique(key, return_index=True, return_inverse=True)
        self._part()
        #: The first document of each entry.
        self.first_doc = self.ids[runs.row[self.where]]

    def _part(self) -> None:
        """Give runs an entry of their own whose bytes are not those of their entry's first run, although their hashes are."""
        runs, head = self.runs, self.where[self.entry]
        again = np.flatnonzero(head != np.arange(len(head)))
        size = runs.last - runs.first + SPAN
        equal = size[again] == size[head[again]]
        equal &= runs.place[again] - runs.first[again] == (runs.place - runs.first)[head[again]]
        for lo in range(0, len(again), 1 << 14):
            part = slice(lo, lo + (1 << 14))
            i = np.flatnonzero(equal[part]) + lo
            n = size[again[i]]
            same = self.buf[_bytes_at(runs.first[again[i]], n)] == self.buf[_bytes_at(runs.first[head[again[i]]], n)]
            if len(i):
                equal[i] = np.logical_and.reduceat(same, np.cumsum(n) - n)
        other = again[~equal]
        self.entry[other] = len(self.where) + np.arange(len(other))
        self.where = np.concatenate((self.where, other))

    def dealt(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The entries, dealt to buckets by their anchors, and where those of each bucket end."""
        bucket = (mix(self.runs.anchor[self.where]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _pack(docs: DataFrame, size: int, most: int) -> DataFrame:
    """Blocks: block (its partition and its number there), ids, off, data (compressed), more (the carried column). size: bytes of all texts."""
    carry = [c for c in docs.columns if c == KEEP]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, partition, numbers = [], 0, TaskContext.get().partitionId(), count()

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            by_id = np.argsort(t["doc_id"].to_numpy(), kind="stable")
            t = t.take(pa.array(by_id))
            buf, off = flat(t["text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.select(carry).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(t.select(carry))
            ids, data = t["doc_id"].to_numpy().tobytes(), compressed(buf.tobytes())
            return pa.RecordBatch.from_pydict({"block": [partition << 32 | next(numbers)], "ids": [ids], "off": [off.astype(np.int64).tobytes()], "data": [data], "more": [sink.getvalue().to_pybytes()]})

        for b in slices(batches, "text", most // 8):
            held.append(b)
            size += len(flat(b["text"])[0])
            if size >= most:
                yield block()
                held, size = [], 0
        if held:
            yield block()

    # Few partitions make whole blocks of small tables too.
    return gathered(docs.where("doc_id IS NOT NULL"), size, 16 << 20).mapInArrow(run, "block long, ids binary, off binary, data binary, more binary")


def _dealt(bucket: np.ndarray, n: int, columns: list[Callable[[np.ndarray], list]]) -> dict:
    """Rows by bucket: for each bucket that has any, what the columns make of its places."""
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(n + 1))
    used = [b for b in range(n) if ends[b] < ends[b + 1]]
    return {"bucket": used} | {k: [f(order[ends[b] : ends[b + 1]]) for b in used] for k, f in columns.items()}


def _anchors(blocks: DataFrame, buckets: int, width: int, bits: int | None) -> DataFrame:
    """For each block and bucket the anchors of its entries, `width` bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                k = Block(row)
                order, ends = k.dealt(buckets)
                h = _hashed(k.runs.anchor[k.where[order]], bits)
                used = np.flatnonzero(np.diff(ends))
                data = [_narrow(h[ends[i] : ends[i + 1]], width) for i in used]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int64()), "block": pa.array([row["block"]] * len(used), pa.int64()), "data": pa.array(data, pa.binary())})

    return blocks.select("block", "ids", "off", "data").mapInArrow(run, "bucket long, block long, data binary")


def _hashed(anchor: np.ndarray, bits: int | None) -> np.ndarray:
    """The part of an anchor's hash by which anchors are met; fewer bits, for tests, make unlike anchors meet."""
    return anchor if bits is None else anchor & np.uint64((1 << bits) - 1)


def _judge_anchors(hot: int, width: int) -> Callable[[pa.Table], pa.Table]:
    """Which entries of each block have an anchor that another entry has too (met), and which anchors have more than `hot` (hot); bits in the order sent."""

    def judge(t: pa.Table) -> pa.Table:
        data = t["data"].to_pylist()
        h = np.concatenate([_wide(x, width) for x in data])
        ends = np.cumsum([len(x) // width for x in data])
        o = np.argsort(h, kind="stable")
        new = np.ones(len(o), bool)
        new[1:] = h[o][1:] != h[o][:-1]
        many = np.empty(len(o), np.int64)
        many[o] = np.diff(np.append(np.flatnonzero(new), len(o)))[np.cumsum(new) - 1]
        pieces = [many[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        some = [i for i, m in enumerate(pieces) if (m > 1).any()]
        bits = lambda f: pa.array([np.packbits(f(pieces[i])).tobytes() for i in some], pa.binary())
        return pa.table({"block": t["block"].take(pa.array(some, pa.int64())), "bucket": t["bucket"].take(pa.array(some, pa.int64())), "met": bits(lambda m: m > 1), "hot": bits(lambda m: m > hot)})

    return judge


#: What a block sends of its entries: for each its number, first document, strings, the place of its anchor, what it is grouped by, and its bytes.
SENT = T.StructType([T.StructField(n, T.LongType() if n in ("bucket", "block", "n") else T.BinaryType()) for n in ("bucket", "block", "n", "entries", "docs", "shift", "strings", "anchor", "sort", "text")])
_SENT = pa.schema([(f.name, pa.int64() if f.dataType == T.LongType() else pa.binary()) for f in SENT.fields])


def _contexts(buckets: int, anchor_buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [_SENT.empty_table()]
        told = {r["bucket"]: r for r in right.to_pylist()}
        for row in left.to_pylist() if told else []:
            k = Block(row)
            runs = k.runs
            order, ends = k.dealt(anchor_buckets)
            met, hot = np.zeros(len(order), bool), np.zeros(len(order), bool)
            for i, r in told.items():
                a, b = ends[i], ends[i + 1]
                for flags, name in ((met, "met"), (hot, "hot")):
                    flags[order[a:b]] = np.unpackbits(np.frombuffer(r[name], np.uint8), count=b - a).astype(bool)
            whole, single = np.flatnonzero(met & ~hot), np.flatnonzero(hot)
            run, one = k.where[whole], k.where[single]
            count = runs.last[one] - runs.first[one] + 1
            number = _bytes_at(np.zeros(len(one), np.int64), count)
            one, single = np.repeat(one, count), np.repeat(single, count)
            first = np.concatenate((runs.first[run], runs.first[one] + number))
            strings = np.concatenate((runs.last[run] - runs.first[run] + 1, np.ones(len(one), np.int64)))
            shift = np.concatenate((np.zeros(len(run), np.int64), number))
            anchor = np.concatenate((runs.place[run], runs.place[one])) - first
            # Equal strings have equal anchors, so that strings are only ever compared within one.
            deal = np.concatenate((mix(runs.anchor[run]), mix(span_hashes(k.buf, first[len(run) :], first[len(run) :] + SPAN) + _SALT)))
            entry = np.concatenate((whole, single))
            fields = {"entries": (entry, "<u4"), "docs": (k.first_doc[entry], "<i8"), "shift": (shift, "u1"), "strings": (strings, "u1"), "anchor": (anchor, "u1"), "sort": (deal >> np.uint64(32), "<u4")}

            def text(i, first=first, n=strings + SPAN - 1, buf=k.buf):
                return compressed(buf[_bytes_at(first[i], n[i])].tobytes())

            columns = {c: lambda i, x=x, kind=kind: x[i].astype(kind).tobytes() for c, (x, kind) in fields.items()}
            rows = _dealt((deal % np.uint64(buckets)).astype(np.int64), buckets, {"n": lambda i, n=strings: int((n[i] + SPAN - 1).sum()), **columns, "text": text})
            out.append(pa.table({"bucket": rows["bucket"], "block": [row["block"]] * len(rows["bucket"])} | {c: rows[c] for c in _SENT.names[2:]}, schema=_SENT))
        return pa.concat_tables(out)

    return send


def _earlier(place: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of equal things by document, the first of each class in it, and the least document of everything's class."""
    o = np.lexsort((doc, place))
    new = np.ones(len(o), bool)
    new[1:] = place[o][1:] != place[o][:-1]
    first = o[np.flatnonzero(new)]
    least = np.empty(len(o), np.int64)
    least[o] = doc[first][np.cumsum(new) - 1]
    return o, first, least


def _sort_contexts(t: pa.Table) -> pa.Table:
    """Which strings of each entry stand in a document before its own, as bits."""
    block = t["block"].to_numpy()
    join = lambda name, kind: np.frombuffer(b"".join(t[name].to_pylist()), kind)
    entry, doc, shift, strings, anchor, sort = join("entries", "<u4"), join("docs", np.int64), join("shift", np.uint8), join("strings", np.uint8).astype(np.int64), join("anchor", np.uint8).astype(np.int64), join("sort", "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(block)), [len(x) for x in t["shift"].to_pylist()])
    size = strings + SPAN - 1
    base = np.cumsum(size) - size
    texts = [np.frombuffer(pa.decompress(x, n, codec="zstd"), np.uint8) for x, n in zip(t["text"].to_pylist(), t["n"].to_pylist(), strict=True)]
    buf = np.concatenate((*texts, np.zeros(8, np.uint8)))
    del texts
    # Whole contexts first: of equal ones, all but those of the first document are known.
    place = same_strings(buf, base, size, (sort << 14) + (strings << 7) + anchor)
    _, first, least = _earlier(place, doc)
    bits = np.where(least < doc, (np.uint64(1) << strings.astype(np.uint64)) - np.uint64(1), np.uint64(0))
    # Then the strings of contexts that differ, where an anchor has several.
    several = np.bincount(np.unique(sort[first], return_inverse=True)[1])[np.unique(sort[first], return_inverse=True)[1]] > 1 if len(first) else np.zeros(0, bool)
    one = first[several]
    ctx = np.repeat(one, strings[one])
    number = _bytes_at(np.zeros(len(one), np.int64), strings[one])
    if len(ctx):
        place_of = same_strings(buf, base[ctx] + number, None, (sort[ctx] << 7) + anchor[ctx] - number + 32)
        before = _earlier(place_of, least[ctx])[2]
        # What stands before the first document of a context stands before all of them; and in the first itself only if it is earlier.
        found = np.zeros(len(size), np.uint64)
        np.bitwise_or.at(found, ctx[before < least[ctx]], np.uint64(1) << number[before < least[ctx]].astype(np.uint64))
        of_class = np.zeros(int(place.max()) + 1, np.uint64)
        of_class[place[one]] = found[one]
        bits |= of_class[place]
    bits = (bits << shift.astype(np.uint64)).astype(np.uint32)
    use = np.flatnonzero(bits)
    rows = _dealt(owner[use], len(block), {"entries": lambda i: entry[use[i]].tobytes(), "bits": lambda i: bits[use[i]].tobytes()})
    return pa.table({"block": pa.array(block[rows["bucket"]]), "entries": pa.array(rows["entries"], pa.binary()), "bits": pa.array(rows["bits"], pa.binary())})


def _covered(k: Block, entries: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which bytes of the block's text are covered by strings of earlier documents. found: bits of the strings of entries."""
    bits = np.zeros(len(k.where), np.uint32)
    np.bitwise_or.at(bits, entries, found)
    runs = k.runs
    full = ((np.uint64(1) << (runs.last - runs.first + 1).astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    mine = np.where(k.ids[runs.row] > k.first_doc[k.entry], full, bits[k.entry])
    whole = mine == full
    step = np.zeros(len(k.buf) + 1, np.int32)
    np.add.at(step, runs.first[whole], 1)
    np.add.at(step, runs.last[whole] + SPAN, -1)
    part = np.flatnonzero(~whole & (mine > 0))
    for i in range(WINDOW):
        on = part[(mine[part] >> np.uint32(i)) & np.uint32(1) > 0]
        np.add.at(step, runs.first[on] + i, 1)
        np.add.at(step, runs.first[on] + i + SPAN, -1)
    return np.cumsum(step[:-1], dtype=np.int32) > 0


def whole_characters(buf: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """gone, less the bytes of characters that it holds only in part."""
    if not len(buf):
        return gone
    char = np.cumsum((buf & 0xC0) != 0x80, dtype=np.int32)
    return gone & ~np.bincount(char[~gone], minlength=char[-1] + 1).astype(bool)[char]


def _running(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each place, the total last."""
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, dtype=np.int32, out=out[1:])
    return out


def _finish(texts: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        join = lambda name, kind: np.frombuffer(b"".join(right[name].to_pylist()), kind)
        out = []
        for row in left.to_pylist():
            k = Block(row)
            gone = _covered(k, join("entries", "<u4"), join("bits", np.uint32))
            total = _running(gone)
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            edge = k.off[1:-1][k.off[1:-1] < len(gone)]
            begins[edge] = gone[edge]
            begun = _running(begins)
            cutting = whole_characters(k.buf, gone) if texts else gone
            left_off = k.off - _running(cutting)[k.off]
            kept = k.buf[~cutting]
            cols = {"doc_id": pa.array(k.ids), "n_bytes": np.diff(k.off), "n_removed": np.diff(total[k.off]).astype(np.int64), "n_spans": np.diff(begun[k.off]).astype(np.int64)}
            if texts:
                cols["kept_text"] = pa.array(binary_column(kept, left_off).cast(pa.string()))
            else:
                data = kept.tobytes()
                cols["kept_sha256"] = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(left_off[:-1].tolist(), left_off[1:].tolist(), strict=True)]
            more = pa.ipc.open_stream(row["more"]).read_all()
            out.append(pa.table(cols | {c: more[c].combine_chunks() for c in more.column_names}))
        return pa.concat_tables(out)

    return finish


def _resolve(blocks: DataFrame, buckets: int, hot: int, width: int, bits: int | None) -> DataFrame:
    return cut(_anchors(blocks, buckets, width, bits).groupBy("bucket").applyInArrow(_judge_anchors(hot, width), "block long, bucket long, met binary, hot binary"), buckets, 2)


def _resolve_rest(blocks: DataFrame, told: DataFrame, buckets: int, anchor_buckets: int) -> DataFrame:
    texts = blocks.select("block", "ids", "off", "data")
    contexts = texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_contexts(buckets, anchor_buckets), SENT)
    return cut(contexts.groupBy("bucket").applyInArrow(_sort_contexts, "block long, entries binary, bits binary"), buckets, 2)


def remove_repeats(docs: DataFrame, *carry: str, texts: bool = False, block: int | None = None, hot: int = HOT, bits: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of docs, then columns keep_<c> of `carry`.

    With texts, kept_text stands instead of the hash: the rest as a text, in which characters that are only partly
    covered stay. block: bytes of a block's text. bits: of the hashes of anchors that are compared, all by default; fewer bits cost time and change nothing.
    """
    slim = text_columns(docs, *carried(docs, carry))
    total = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = cut(_pack(slim, total, block or max(BLOCK, min(LARGE_BLOCK, total // BLOCKS))))
    size = blocks.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    # Anchors are met by so many bytes of their hash that few unlike ones meet.
    width = max(5, -(-(int(total) // 16).bit_length() // 8) + 1)
    anchor_buckets = max(64, size // ANCHOR_BUCKET)
    told = _resolve(blocks, anchor_buckets, hot, width, bits)
    late = _resolve_rest(blocks, told, max(64, size // CONTEXT_BUCKET), anchor_buckets)
    release(docs.sparkSession)
    last = T.StructField("kept_text" if texts else "kept_sha256", T.StringType())
    fields = [*(T.StructField(c, T.LongType()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")), last, *(f for f in slim.schema.fields if f.name == KEEP)]
    out = blocks.groupBy("block").cogroup(late.groupBy("block")).applyInArrow(_finish(texts), T.StructType(fields))
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = text.alias("kept_text") if texts else F.sha2(text, 256).alias("kept_sha256")
    zero = F.lit(0).cast("long")
    rest = slim.where("doc_id IS NULL").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), kept, *([KEEP] if carry else []))
    return kept_apart(out.unionByName(rest), carry)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM t)
), d AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM w) WHERE first < doc_id
), g AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM d
), n AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g
), spans AS (
  SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY doc_id, k
), gaps AS (
  SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM (SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, -1, 0 FROM t)
), kept AS (
  SELECT gaps.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, length(h) // 2) - a)), '' ORDER BY a) AS h FROM gaps JOIN t USING (doc_id) GROUP BY gaps.doc_id
), c AS (
  SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM spans GROUP BY doc_id
)
SELECT doc_id, (length(t.h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM t JOIN kept USING (doc_id) LEFT JOIN c USING (doc_id)
"""
