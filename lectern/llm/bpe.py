"""Byte-level BPE encoding by overlapping chunks, and decoding.

A text is cut into chunks that overlap. Every chunk is pre-tokenised and encoded by itself,
in parallel. A chunk that starts inside a pre-token is out of step at first; neighbours are
stitched at the first place in their overlap where both begin a pre-token, because from a
common boundary on the pattern, which looks back at nothing, finds the same pre-tokens. If an
overlap holds no common boundary (one pre-token longer than the overlap), the text from the
last certain boundary is pre-tokenised again, together with the next chunk. Decoding joins
the bytes of the ids.

Cases: null and empty texts have no ids; repeated rows give repeated rows; the vocabulary's
special tokens are ordinary text; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_columns

CHUNK, OVERLAP = 32_768, 1_024
#: Code points that the installed regex library counts as letters or numbers but the
#: tokenizer library, made for an earlier Unicode version, does not (fixed values).
NEWER_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA),
    (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F),
    (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
NEWER_NUMBERS = ((0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16FF4, 0x16FF6))
#: A boundary this close to a chunk's end may hang on what follows it.
MARGIN = 4


class Codec(dict):
    """The ids of every pre-token met so far; unknown ones are encoded when first asked for."""

    most = 200_000

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.core = tiktoken.Encoding("chunked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.decimal = [str(i) for i in range(len(self.bytes))]
        spell = lambda ranges: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)
        self.split = regex.compile(pattern)
        self.newer = regex.compile(f"[{spell(NEWER_LETTERS + NEWER_NUMBERS)}]")
        strict = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{spell(NEWER_LETTERS + NEWER_NUMBERS)}])")
        strict = strict.replace(r"?\p{L}+", rf"?[\p{{L}}--[{spell(NEWER_LETTERS)}]]+").replace(r"?\p{N}+", rf"?[\p{{N}}--[{spell(NEWER_NUMBERS)}]]+")
        self.split_strictly = regex.compile(f"(?V1){strict}")

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        ids = self[piece] = tuple(self.core.encode_single_piece(piece.encode()))
        return ids

    def pieces(self, text: str) -> list[str]:
        """The matches of the pattern, in order. Its last alternatives leave no character out."""
        if not text.isascii() and self.newer.search(text):
            return self.split_strictly.findall(text)
        return self.split.findall(text)

    def encode(self, pieces: list[str]) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


class Part:
    """A chunk's pre-tokens: where each begins in the whole text, and its ids."""

    def __init__(self, start: int, text: str, ends: np.ndarray, counts: np.ndarray, ids: np.ndarray):
        self.start, self.text, self.ids = start, text, ids
        self.bounds = np.concatenate(([0], ends)) + start
        self.tokens = np.concatenate(([0], np.cumsum(counts)))

    @classmethod
    def of(cls, c: Codec, start: int, text: str) -> Part:
        pieces = c.pieces(text)
        found = [c[p] for p in pieces]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return cls(start, text, np.cumsum(sizes), counts, np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum())))

    def between(self, a: int, b: int) -> np.ndarray:
        """The ids of the pre-tokens from boundary a to boundary b."""
        i, j = np.searchsorted(self.bounds, (a, b))
        return self.ids[self.tokens[i] : self.tokens[j]]


def stitch(c: Codec, parts: list[Part]) -> np.ndarray:
    """The ids of the whole text from its overlapping parts, in order."""
    out, current, at = [], parts[0], 0
    for following in parts[1:]:
        limit = current.start + len(current.text) - MARGIN
        sure = current.bounds[(current.bounds >= max(at, following.start)) & (current.bounds <= limit)]
        common = np.intersect1d(sure, following.bounds)
        if len(common):
            out.append(current.between(at, int(common[0])))
            current, at = following, int(common[0])
            continue
        sure = current.bounds[(current.bounds >= at) & (current.bounds <= limit)]
        last = int(sure[-1]) if len(sure) else at
        out.append(current.between(at, last))
        held = current.text[last - current.start :]
        known = current.start + len(current.text)
        current, at = Part.of(c, last, held + following.text[known - following.start :]), last
    out.append(current.between(at, current.start + len(current.text)))
    return np.concatenate(out)


def chunks_of(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """(start, text) of overlapping chunks; the last reaches the end."""
    starts = range(0, max(1, len(text) - overlap), size)
    return [(s, text[s : s + size + overlap] if s + size < len(text) - overlap else text[s:]) for s in starts]


def digests(c: Codec, ids: list[int]) -> tuple:
    """n_tokens, ids_sha256, decoded_sha256."""
    return len(ids), hashlib.sha256(",".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()


def id_bytes(c: Codec, ids: list[int]) -> tuple:
    """n_tokens, ids as little-endian 32-bit numbers."""
    return len(ids), np.asarray(ids, "<i4").tobytes()


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"
IDS = "n_tokens long, ids binary"


def _arrow(fields: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in f"doc_id long, {fields}".split(", "))])


def encode(docs: DataFrame, path: str, pattern: str, finish=id_bytes, fields: str = IDS, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and what `finish` makes of the ids, for every row of docs.

    path: the vocabulary's file, present on every machine. Texts of one chunk end where they
    are read. The chunks of longer ones are dealt out over the cluster and meet again only as
    ids, one document at a time.
    """
    schema = _arrow(fields)

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*found), schema, strict=True)], schema=schema)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in slices(batches, "text"):
            yield rows([(i, *finish(c, c.encode(c.pieces(t or "")))) for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            for i, t, h in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["h"].to_pylist(), strict=True):
                found = chunks_of(t, chunk, overlap)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([i] * len(found), pa.int64()), "h": [h] * len(found), "start": [s for s, _ in found], "part": [x for _, x in found]})

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in slices(batches, "part"):
            parts = [Part.of(c, s, t) for s, t in zip(b["start"].to_pylist(), b["part"].to_pylist(), strict=True)]
            packed = lambda f: pa.array([np.asarray(f(p), np.int32).tobytes() for p in parts], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, packed(lambda p: p.bounds[1:] - p.start), packed(lambda p: np.diff(p.tokens)), packed(lambda p: p.ids)], names=["doc_id", "h", "start", "part", "ends", "counts", "ids"])

    def join(table: pa.Table) -> pa.Table:
        c = codec(path, pattern)
        t = table.sort_by("start")
        ints = lambda name: [np.frombuffer(x, np.int32) for x in t[name].to_pylist()]
        parts, copies = {}, 0
        for s, x, e, n, ids in zip(t["start"].to_pylist(), t["part"].to_pylist(), ints("ends"), ints("counts"), ints("ids"), strict=True):
            parts[s] = Part(s, x, e, n, ids)
            copies += s == 0  # equal rows
        done = finish(c, stitch(c, list(parts.values())).tolist())
        return pa.Table.from_batches([rows([(t["doc_id"][0].as_py(), *done)] * copies)], schema=schema)

    texts, out = text_columns(docs), f"doc_id long, {fields}"
    fits = F.coalesce(F.length("text"), F.lit(0)) <= chunk
    few = texts.filter(fits).mapInArrow(short, out)
    many = texts.filter(~fits).withColumn("h", F.xxhash64("text")).mapInArrow(cut, "doc_id long, h long, start long, part string")
    many = many.repartition("doc_id", "h", "start").mapInArrow(pretokenise, "doc_id long, h long, start long, part string, ends binary, counts binary, ids binary")
    return few.unionByName(many.groupBy("doc_id", "h").applyInArrow(join, out))


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes of column ids (as encode() gives them); null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "bytes": pa.array([c.decode(np.frombuffer(x or b"", "<i4").tolist()) for x in b["ids"].to_pylist()], pa.binary())})

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")
