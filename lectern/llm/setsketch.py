"""Near-duplicates by SetSketch registers (Ertl 2021).

A document is the set of its word shingles. A register keeps the largest
floor(1 - log_b h(x)) over the set, h(x) being exponential: the minimum of h on a scale of
powers of b, truncated to whole steps. Registers of a union are the larger of both, and equal registers
are as likely as the sets are alike. Documents with equal sets form a class, represented by
one of its rows; all else works on classes.

1. Bands of registers put classes into buckets. Every class is compared with one centre,
   the smallest class in any of its buckets: as many pairs as classes.
2. Confirmed links give components. Buckets whose members fell into several components are
   looked at again, in tiles of bounded size: pairs between components are estimated by the
   likelihood of the registers given the set sizes, each pair in the first bucket that it
   shares; those that may reach the threshold are confirmed on the full sets within the tile.
   A tile returns one link for each component that it joins to another, not its pairs. Members of a bucket's main
   component meet those of other components only.
   So a link is only lost if its documents share no bucket (at the threshold: (1 - 0.8^5)^32,
   two in a million) or by registers 5 standard errors off.

Links are confirmed on the full sets, from the whole texts.

Cases: null, empty or wordless texts have empty sets, link with nothing and are kept; texts with
fewer words than a shingle have one, of all their words; very long texts are sets like others, a task holding a few at a time; equal rows form a class and share
its component; rows with a null doc_id link with nothing, have no component and are kept;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import LOWER, MEMBERS, cut, flat, group_bounds, join_hot, joined, mix, ngrams, slices, span_hashes, text_columns, whole_groups, words_of
from .components import connected

WORDS, PERCENT = 5, 80
BANDS, WIDTH = 32, 5
REGISTERS = BANDS * WIDTH
#: Base, rate and number of steps of the registers.
BASE, RATE, STEPS = 1.02, 20.0, 65_534
#: A pair is ruled out if its best likelihood at the threshold or above is lower than the best of all by e to this power.
DOUBT = 12.5
TILE = 512
MEMBERS_OF_CLASS = "__lectern_copies"

_rng = np.random.default_rng(20210101)
_FACTOR = (_rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFT = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)


def shingle_sets(buf: np.ndarray, off: np.ndarray, n: int) -> np.ndarray:
    """The distinct shingles of all rows: row number in the upper 16 bits, 48 bits of hash below, sorted."""
    buf = LOWER[buf]
    start, end, counts = words_of(buf, off)
    words = span_hashes(buf, start, end)
    h, row = ngrams(words, counts, n)
    sizes = np.diff(counts)
    few = np.flatnonzero((sizes > 0) & (sizes < n))
    if len(few):
        whole = np.zeros(len(few), np.uint64)
        for k in range(n - 1):
            on = sizes[few] > k
            whole[on] = mix(whole[on] * np.uint64(0xD6E8FEB86659FD93) + words[counts[few[on]] + k] + np.uint64(0x9E37))
        h, row = np.concatenate((h, whole)), np.concatenate((row, few))
    return np.unique((row.astype(np.uint64) << np.uint64(48)) | (mix(h) >> np.uint64(16)))


def registers(keys: np.ndarray, rows: int) -> np.ndarray:
    """Registers of `rows` sets, 0 throughout for an empty one."""
    out = np.zeros((rows, REGISTERS), np.uint16)
    starts = np.searchsorted(keys, np.arange(rows, dtype=np.uint64) << np.uint64(48))
    full = np.flatnonzero(np.diff(np.append(starts, len(keys))))
    if not len(full):
        return out
    low = np.full((len(full), REGISTERS), 0xFFFFFFFF, np.uint32)
    x = mix(keys << np.uint64(16)).astype(np.uint32)
    at = starts[full]
    step = 1 << 16
    for lo in range(0, len(x), step):
        part = x[lo : lo + step]
        i, j = np.searchsorted(at, lo, "right") - 1, np.searchsorted(at, lo + len(part))
        cuts = np.maximum(at[i:j] - lo, 0)
        h = np.empty_like(part)
        for k in range(REGISTERS):
            np.multiply(part, _FACTOR[k], out=h)
            h += _SHIFT[k]
            found = np.minimum.reduceat(h, cuts)
            np.minimum(low[i:j, k], found, out=low[i:j, k])
    h = -np.log1p(-(low + 0.5) / 4294967296.0) / RATE
    out[full] = np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, STEPS + 1).astype(np.uint16)
    return out


def likely(reg_a: np.ndarray, reg_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which pairs may be as alike as asked: maximum likelihood of the Jaccard similarity given registers and sizes."""
    above, below = (reg_a > reg_b).sum(1), (reg_a < reg_b).sum(1)
    equal = reg_a.shape[1] - above - below
    u = (size_a / (size_a + size_b))[:, None]
    grid = np.linspace(0, 1, 101)[None]
    j = np.minimum(grid, np.minimum(u / (1 - u), (1 - u) / u))
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = p(u - (1 - u) * j), p((1 - u) - u * j)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    score = above[:, None] * log(more) + below[:, None] * log(less) + equal[:, None] * log(1 - more - less)
    score = np.where(grid <= j + 1e-9, score, -np.inf)
    wanted = grid[0] * 100 >= percent - 1
    return score[:, wanted].max(1) >= score.max(1) - DOUBT


def set_hashes(keys: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and hash of every set."""
    at = np.searchsorted(keys, np.arange(rows + 1, dtype=np.uint64) << np.uint64(48))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(keys << np.uint64(16)))))
    sizes = np.diff(at)
    return sizes, mix((total[at[1:]] - total[at[:-1]]) + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_hash, bands (hashes), regs (packed) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = b.num_rows
            keys = shingle_sets(*flat(b["text"]), words)
            sizes, whole = set_hashes(keys, rows)
            regs = registers(keys, rows)
            bands = np.zeros((rows, BANDS), np.uint64)
            for k in range(WIDTH):
                bands = mix(bands * np.uint64(0xD6E8FEB86659FD93) + regs.reshape(rows, BANDS, WIDTH)[:, :, k].astype(np.uint64) + np.uint64(1))
            bands = mix(bands + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
            yield pa.RecordBatch.from_arrays(
                [
                    b["doc_id"], pa.array(sizes), pa.array(whole),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, rows * BANDS + 1, BANDS), pa.int32()), pa.array(bands.view(np.int64).ravel())),
                    pa.array([r.tobytes() for r in regs], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_hash", "bands", "regs"],
            )

    return text_columns(docs).mapInArrow(run, "doc_id long, n_shingles long, set_hash long, bands array<long>, regs binary")


def confirm(pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """u, v of the rows (u, v, text_u, text_v) whose full sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(slices(batches, "text_u"), "text_v"):
            mine, other = (shingle_sets(*flat(b[c]), words) for c in ("text_u", "text_v"))
            row = lambda k: np.bincount((k >> np.uint64(48)).astype(np.int64), minlength=b.num_rows)
            both = np.sort(np.concatenate((mine, other)))
            shared = row(both[1:][both[1:] == both[:-1]])
            union = row(mine) + row(other) - shared
            yield pa.RecordBatch.from_arrays([b["u"], b["v"]], names=["u", "v"]).filter(pa.array(100 * shared >= percent * union))

    return pairs.select("u", "v", "text_u", "text_v").mapInArrow(run, "u long, v long")


def _tile_links(sets: list[np.ndarray], node: np.ndarray, comp: np.ndarray, size: np.ndarray, side: np.ndarray, band: int, regs: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) of nodes that join the components of one tile as its confirmed pairs do."""
    names, c = np.unique(comp, return_inverse=True)
    i, j = np.triu_indices(len(node), 1)
    fits = (c[i] != c[j]) & ((side[i] != side[j]) | (side[i] == 2)) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
    i, j = i[fits], j[fits]
    able = np.zeros(len(i), bool)
    for lo in range(0, len(i), 1024):
        a, b = i[lo : lo + 1024], j[lo : lo + 1024]
        same = (regs[a] == regs[b]).reshape(len(a), BANDS, WIDTH).all(2)
        here = np.flatnonzero(same.argmax(1) == band)
        able[lo + here[likely(regs[a[here]], regs[b[here]], size[a[here]], size[b[here]], percent)]] = True
    i, j = i[able], j[able]
    if not len(i):
        return names[:0], names[:0]
    # Sets as rows of bits; elements of one set alone are in no intersection.
    used = np.unique(np.concatenate((i, j)))
    elements, count = np.unique(np.concatenate([sets[k] for k in used]), return_counts=True)
    elements = elements[count > 1]
    width = -(-len(elements) // 64)
    bits = np.zeros((len(node), max(1, width) * 64), bool)
    for k in used:
        found = np.isin(sets[k], elements, assume_unique=True)
        bits[k, np.searchsorted(elements, sets[k][found])] = True
    bits = np.packbits(bits, axis=1).view(np.uint64)
    ok = np.zeros(len(i), bool)
    step = max(1, (1 << 20) // bits.shape[1])
    for lo in range(0, len(i), step):
        a, b = i[lo : lo + step], j[lo : lo + step]
        shared = np.bitwise_count(bits[a] & bits[b]).sum(1, dtype=np.int64)
        ok[lo : lo + step] = 100 * shared >= percent * (size[a] + size[b] - shared)
    root = joined(np.arange(len(names)), c[i[ok]], c[j[ok]])
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[moved], names[root[moved]]


def _between_components(members: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (u, v) between components, enough to join those that pairs of one tile join.

    members: tile (a key), band, side (0, 1, or 2 where both), node, component, size, regs, text.
    """

    def compare(held: pa.Table) -> pa.RecordBatch:
        sets = []
        for b in slices(iter(held.combine_chunks().to_batches()), "text"):
            keys = shingle_sets(*flat(b["text"]), words)
            at = np.searchsorted(keys, np.arange(b.num_rows + 1, dtype=np.uint64) << np.uint64(48))
            keys &= np.uint64((1 << 48) - 1)
            sets += [keys[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
        tile, node, comp, size, side, band = (held[c].to_numpy() for c in ("tile", "node", "component", "size", "side", "band"))
        regs = np.frombuffer(b"".join(held["regs"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
        found = [_tile_links(sets[x:y], node[x:y], comp[x:y], size[x:y], side[x:y], int(band[x]), regs[x:y], percent) for x, y in group_bounds(tile)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_groups(slices(batches, "text"), "tile"):
            yield compare(held)

    cols = ("tile", "band", "side", "node", "component", "size", "regs", "text")
    return members.select(*cols).repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "u long, v long").distinct()


def _texts(docs: DataFrame, classes: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """node, text of every class (node, rep) of classes: the text of a row of rep with that set."""
    found = text_columns(docs).join(classes, F.col("doc_id") == F.col("rep")).select("node", "text")
    if not ids.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return found

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            mine = set_hashes(shingle_sets(*flat(b["text"]), words), b.num_rows)[1]
            yield b.filter(pa.array(mine == b["node"].to_numpy()))

    return found.mapInArrow(own, "node long, text string").groupBy("node").agg(F.first("text").alias("text"))


def with_set_hash(docs: DataFrame, name: str, words: int = WORDS) -> DataFrame:
    """docs with the hash of each row's set as a column of this name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            own = set_hashes(shingle_sets(*flat(b["text"]), words), b.num_rows)[1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, hashes: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for every row of docs; with hashes, also set_hash, null where a row links with nothing."""
    n = docs.count()
    sketched = cut(sketch(docs, words), n, 5_000)
    ids = sketched.select("doc_id", "n_shingles", "set_hash")
    real = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL").withColumnRenamed("set_hash", "node")
    classes = cut(real.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"), F.first("regs").alias("regs")), n, 20_000)
    banded = classes.select("node", "rep", F.posexplode("bands").alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("members")).where("members > 1")
    member = cut(banded.join(shared, "bucket"), BANDS * n)

    centred = member.groupBy("node", "rep").agg(F.min("centre").alias("centre"))
    texts = cut(_texts(docs, centred.select("node", "rep"), ids, words), n, 5_000)

    found = centred.where("node != centre").select(F.col("centre").alias("u"), F.col("node").alias("v"))
    found = found.join(texts.withColumnsRenamed({"node": "v", "text": "text_v"}), "v").join(texts.withColumnsRenamed({"node": "u", "text": "text_u"}), "u")
    first = cut(confirm(found, words, percent), n, 5_000)
    label = connected(first, n)

    placed = member.select("bucket", "band", "node").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = cut(placed, BANDS * n)
    # Of every torn bucket, the component with the most members is the main one: pairs within it need no look.
    sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    torn = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("b"), F.sum("n").alias(MEMBERS), F.count("*").alias("parts")).where("parts > 1")
    torn = cut(torn.select("bucket", F.col("b.component").alias("main"), F.col("b.n").alias("most"), MEMBERS))
    # A main component that fits into one tile needs no slices of its own.
    torn = torn.withColumn("main", F.when(F.col("most") > TILE, F.col("main"))).withColumn("most", F.when(F.col("most") > TILE, F.col("most")).otherwise(0))
    rest = join_hot(placed, torn.withColumn("others", F.col(MEMBERS) - F.col("most")), ["bucket"], BANDS * n)
    # Slices of main members and slices of others: every slice of others meets itself, the other slices of others,
    # and those of main members. One outlier in a bucket of m so costs a copy of each text, not m / TILE of them.
    few, many = F.ceil(F.col("others") / TILE).cast("int"), F.ceil(F.col("most") / TILE).cast("int")
    odd = F.col("main").isNull() | (F.col("component") != F.col("main"))
    rest = rest.withColumn("mine", F.pmod(F.xxhash64("node"), F.when(odd, few).otherwise(many)).cast("int") + F.when(odd, 0).otherwise(few))
    meets = F.when(odd, F.sequence(F.lit(0), few + many - 1)).otherwise(F.sequence(F.lit(0), few - 1))
    rest = rest.withColumn("other", F.explode(meets)).join(classes.select("node", "size", "regs"), "node").join(texts, "node")
    tile = F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other"))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    second = cut(_between_components(rest.withColumn("tile", tile).withColumn("side", side.cast("long")), words, percent), BANDS * n)
    more = second.count()
    final = connected(first.unionByName(second), n + more) if more else label

    placed = cut(classes.select("node", "rep", F.col("copies").alias(MEMBERS_OF_CLASS)).join(final, "node", "left").withColumn("component", F.coalesce("component", "node")), n)
    smallest = placed.groupBy("component").agg(F.min("rep").alias("found"), F.count("*").alias(MEMBERS))
    reps = join_hot(placed, smallest, ["component"], n).select(F.col("node").alias("set_hash"), "found", MEMBERS_OF_CLASS)
    linkable = F.coalesce((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.lit(False))
    # Copies of one set may be a third of all rows, and so may rows that link with nothing: the latter need no join.
    reps = reps.withColumnRenamed(MEMBERS_OF_CLASS, MEMBERS)
    out = join_hot(ids.where(linkable), reps, ["set_hash"], n)
    alone = ids.where(~linkable).select(F.lit(None).cast("long").alias("set_hash"), "doc_id", "n_shingles", F.lit(None).cast("long").alias("found"))
    out = out.select("set_hash", "doc_id", "n_shingles", "found").unionByName(alone)
    component = F.coalesce("found", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), *(["set_hash"] if hashes else []))
