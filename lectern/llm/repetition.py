"""Quality rules from the repeated substrings of a document.

The words of a batch of documents form one sequence of numbers; its suffix array comes from
prefix doubling over all documents at once (a suffix ends with its document). Neighbours in
the array and their longest common prefixes (LCP) give the LCP intervals. A suffix's deepest
interval is bounded by the larger LCP with its two neighbours, and its first words, as many
as that LCP, are the longest substring at that place that stands elsewhere too: a maximal
repeat, or the tail of one that begins further left. The union of these spans, where they
have MIN_REPEAT words at least, is what is covered by repetition.

A document is rejected if it has too few words, if too many words lie in repeated 3-word
windows, if repeats cover too large a share of it, or if one repeat is too long.

Cases: null and empty texts have no words and are rejected; equal rows are judged alike;
documents never share suffixes; a very long text is a batch of its own, whose arrays take some 20 bytes a
word and 4 more for every doubling of its longest repeat; columns to carry may have any name and type; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import IS_SPACE, KEEP, carried, flat, kept_apart, mix, slices, span_hashes, text_columns, words_of

MIN_WORDS, MAX_WINDOW_PERCENT = 50, 50
MIN_REPEAT, MAX_COVERED_PERCENT, MAX_REPEAT = 8, 30, 100
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def suffix_array(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of all rows in order (row by row), and their ranks by the first 1, 2, 4, ... words.

    words: a number per word, equal for equal words; counts: words before each row, the total last.
    """
    n = len(words)
    row = np.repeat(np.arange(len(counts) - 1), np.diff(counts))
    number = np.unique(words, return_inverse=True)[1]
    key = row * (int(number.max()) + 1) + number if n else number
    order = np.argsort(key, kind="stable")

    def heads(sorted_key: np.ndarray, base: np.ndarray) -> np.ndarray:
        """The place of the first of each run of equal keys."""
        new = np.ones(len(sorted_key), bool)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        return base[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]

    rank = np.full(n + 1, -1, np.int64)
    place = np.arange(n)
    rank[order] = heads(key[order], place)
    levels, h, end = [rank.astype(np.int32)], 1, counts[1:][row]
    while True:
        at = rank[order]
        tied = np.zeros(n, bool)
        same = at[1:] == at[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        where = np.flatnonzero(tied)
        if not len(where):
            return order, levels
        sub = order[where]
        nxt = sub + h
        second = np.where(nxt < end[sub], rank[np.minimum(nxt, n)] + 1, 0)
        key = rank[sub] * (n + 2) + second
        o = np.argsort(key, kind="stable")
        order[where] = sub[o]
        rank[sub[o]] = heads(key[o], where)
        levels.append(rank.astype(np.int32))
        h *= 2


def neighbour_lcp(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """LCP in words of each suffix in `order` with the one before it (0 for the first)."""
    n = len(order)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    pair = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b = order[pair], order[pair - 1]
    length = np.zeros(len(pair), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = np.minimum(a + length, n), np.minimum(b + length, n)
        length += np.where((levels[k][i] == levels[k][j]) & (i < n) & (j < n), 1 << k, 0)
    out[pair] = length
    return out


def longest_repeats(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For every word: the length of the longest substring beginning there that occurs elsewhere in its row."""
    n = len(words)
    best = np.zeros(n, np.int64)
    if n:
        order, levels = suffix_array(words, counts)
        lcp = neighbour_lcp(order, levels)
        best[order] = np.maximum(lcp, np.concatenate((lcp[1:], [0])))
    return best


def covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a span."""
    step = np.bincount(start, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def measure(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every row of a text column."""
    start, end, counts = words_of(buf, off)
    words = span_hashes(buf, start, end)
    rows = len(off) - 1
    per_row = lambda flags, at: np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[at])
    best = longest_repeats(words, counts)
    windows, repeats = np.flatnonzero(best >= 3), np.flatnonzero(best >= MIN_REPEAT)
    longest = np.zeros(rows, np.int64)
    full = np.flatnonzero(np.diff(counts))
    if len(full):
        longest[full] = np.maximum.reduceat(best, counts[full])

    inside = ~IS_SPACE[buf]
    before = np.concatenate(([0], np.cumsum(inside, dtype=np.int64)))
    breaks = np.flatnonzero(buf == 0x0A)
    # The k-th line begins at the k-th of these places and ends at the k-th of those.
    first, last = np.sort(np.concatenate((off[:-1], breaks + 1))), np.sort(np.concatenate((breaks, off[1:])))
    wordy = before[last] > before[first]
    first, last = first[wordy], last[wordy]
    line_row = np.searchsorted(off, first, "right") - 1
    line = mix(span_hashes(buf, first, last) + line_row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    once = np.unique(line, return_index=True)[1]
    dup_lines = np.bincount(line_row, minlength=rows) - np.bincount(line_row[once], minlength=rows)
    return {
        "n_words": np.diff(counts),
        "word_chars": per_row(inside & ((buf & 0xC0) != 0x80), off),
        "n_symbols": per_row(_SYMBOL[buf], off),
        "n_dup_lines": dup_lines,
        "n_repeat_words": per_row(covered(windows, np.full(len(windows), 3), len(words)), counts),
        "covered_words": per_row(covered(repeats, best[repeats], len(words)), counts),
        "longest_repeat": longest,
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def judge(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row of docs.

    keep: columns of docs to carry along, in their own form, after the verdict.
    """
    slim = text_columns(docs, *carried(docs, keep))
    more = [KEEP] if keep else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            m = measure(*flat(b["text"]))
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(m[c]) for c in COUNTS), *(b[c] for c in more)], names=["doc_id", *COUNTS, *more])

    fields = [T.StructField(c, T.LongType()) for c in ("doc_id", *COUNTS)]
    out = kept_apart(slim.mapInArrow(run, T.StructType([*fields, *(slim.schema[c] for c in more)])), keep)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_WINDOW_PERCENT * F.col("n_words"))
    repetitive = (100 * F.col("covered_words") > MAX_COVERED_PERCENT * F.col("n_words")) | (F.col("longest_repeat") > MAX_REPEAT)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~repetitive)


ORACLE = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS rid FROM documents
), p AS (
  SELECT rid, unnest(range(1, len(w) + 1)) AS i, w FROM t
), spans AS (
  SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM p, (VALUES (3), ({MIN_REPEAT}), ({MAX_REPEAT + 1})) v(k) WHERE i + k - 1 <= len(w)
), twice AS (
  SELECT rid, k, unnest(list(i)) AS i FROM spans GROUP BY rid, k, s HAVING count(*) > 1
), places AS (
  SELECT DISTINCT rid, k, i + o AS i FROM twice, unnest(range({MAX_REPEAT + 1})) u(o) WHERE o < k
), r AS (
  SELECT rid, count(*) FILTER (k = 3) AS n3, count(*) FILTER (k = {MIN_REPEAT}) AS n8, count(*) FILTER (k = {MAX_REPEAT + 1}) AS nlong FROM places GROUP BY rid
), l AS (
  SELECT rid, count(*) - count(DISTINCT line) AS dup FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(n3, 0)::BIGINT AS n_repeat_words,
    coalesce(n8, 0) AS n8, coalesce(nlong, 0) AS nlong
  FROM t LEFT JOIN r USING (rid) LEFT JOIN l USING (rid)
), b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_WINDOW_PERCENT} * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * n8 <= {MAX_COVERED_PERCENT} * n_words AND nlong = 0 AS kept FROM b
"""
