"""Evaluation texts leaking into training text (problem 8): greedy string tiling.

Words are blank-separated strings reduced to their letters and digits, compared without case and Unicode form;
strings with none are skipped. Every run of ``seed`` words of the test items is hashed with a rolling
Karp-Rabin hash into a sorted index; each document is hashed the same way in one pass and looked up. Where a seed is no longer
than a tile, the words of the item that lie in shared seeds bound what tiles can cover, so only pairs that may
pass are tiled and none is lost. A pair is tiled by marking the longest common run not yet marked, again
and again, down to ``min_tile`` words. Tiles may come in any order, so reordered passages still cover the item.

The test items are the query set: they are read in blocks of at most ``block_words`` words, each block
against all documents, so the index that is sent to the executors has a fixed bound whatever the size of the
test sets. Every document is read whole. Null and blank texts leak nothing; an item that stands twice in
the items counts once per item_id; no pair is dropped, however many documents hold one passage.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M32 = np.uint64(0xFFFFFFFF)


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    out = []
    for w in text.split():
        if w.isalnum():
            out.append(w)
        elif w := "".join(c for c in w if c.isalnum()):
            out.append(w)
    return out


def _numbers(ws: list[str], memo: dict[str, int]) -> np.ndarray:
    """A 64-bit number for each word, equal on every machine."""
    import xxhash

    out = np.empty(len(ws), np.uint64)
    for i, w in enumerate(ws):
        h = memo.get(w)
        if h is None:
            if len(memo) > 500_000:
                memo.clear()
            h = memo[w] = xxhash.xxh3_64_intdigest(w)
        out[i] = h
    return out


def rolling(nums: np.ndarray, k: int) -> np.ndarray:
    """The Karp-Rabin hash of each run of k numbers, modulo 2**64, of all runs at once."""
    n = len(nums) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * _BASE + nums[j : j + n]
    return out ^ (out >> np.uint64(29))


def tile(doc: list[str], item: list[str], min_tile: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: non-overlapping (doc_at, item_at, length), longest first.

    Runs of ``min_tile`` words of the item are indexed by their hash; the unmarked part of the document is scanned,
    hits are extended word by word, and in each round all matches of the greatest length are marked, in order of
    position, as long as none of their words is marked.
    """
    memo: dict[str, int] = {}
    dh = rolling(_numbers(doc, memo), min_tile)
    ih = rolling(_numbers(item, memo), min_tile)
    at: dict[int, list[int]] = defaultdict(list)
    for j, h in enumerate(ih.tolist()):
        at[h].append(j)
    seeds = [(i, j) for i in np.flatnonzero(np.isin(dh, ih)).tolist() for j in at[int(dh[i])]]
    done_d, done_i = bytearray(len(doc)), bytearray(len(item))
    tiles: list[tuple[int, int, int]] = []
    while seeds:
        best, found, alive, covered = min_tile, [], [], set()
        for i, j in seeds:
            if (i - 1, j - 1) in covered:  # inside a match that begins further left
                covered.add((i, j))
                if not (done_d[i] or done_i[j]):
                    alive.append((i, j))
                continue
            n = 0
            while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not done_d[i + n] and not done_i[j + n]:
                n += 1
            if n < min_tile:
                continue
            alive.append((i, j))
            covered.add((i, j))
            if n > best:
                best, found = n, []
            if n == best:
                found.append((i, j))
        marked = False
        for i, j in found:
            if not any(done_d[i : i + best]) and not any(done_i[j : j + best]):
                done_d[i : i + best] = done_i[j : j + best] = b"\1" * best
                tiles.append((i, j, best))
                marked = True
        if not marked:
            break
        seeds = [(i, j) for i, j in alive if not done_d[i] and not done_i[j]]
    return tiles


def _block_index(rows: list[tuple[object, list[str]]], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all runs of ``seed`` words in order, and the item and place of each."""
    memo: dict[str, int] = {}
    hashes, owner, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for n, (_, ws) in enumerate(rows):
        h = rolling(_numbers(ws, memo), seed)
        hashes.append(h)
        owner.append(np.full(len(h), n, np.int32))
        place.append(np.arange(len(h), dtype=np.int32))
    h, o, p = np.concatenate(hashes), np.concatenate(owner), np.concatenate(place)
    order = np.argsort(h, kind="stable")
    return h[order], o[order], p[order]


def _bounds(owner: np.ndarray, place: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(items, covered, longest) of the seeds that a document hits: the words that they hold of each item, and the longest run of them."""
    order = np.lexsort((place, owner))
    o, p = owner[order], place[order]
    first = np.concatenate([[True], o[1:] != o[:-1]])  # of an item
    gap = np.concatenate([[seed], np.diff(p)])
    new = np.where(first, seed, np.minimum(gap, seed))
    at = np.flatnonzero(first)
    runs = np.flatnonzero(first | (gap != 1))
    length = np.diff(np.append(runs, len(o))) + seed - 1
    longest = np.maximum.reduceat(length, np.searchsorted(runs, at))
    return o[at], np.add.reduceat(new, at), longest


def _item_blocks(items: DataFrame, key: str, text: str, block_words: int) -> Iterator[list[tuple[object, list[str]]]]:
    """Test items as lists of at most ``block_words`` words (one item at least), streamed through the driver."""
    block, size = [], 0
    for r in items.select(key, text).where(F.col(text).isNotNull()).toLocalIterator():
        ws = words(r[1])
        if block and size + len(ws) > block_words:
            yield block
            block, size = [], 0
        block.append((r[0], ws))
        size += len(ws)
    if block:
        yield block


def leaked(
    docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", item_text: str = "text",
    seed: int = 5, min_tile: int = 5, min_run: int = 12, min_coverage: float = 0.5, block_words: int = 2_000_000,
) -> DataFrame:
    """(doc_key, item_key, longest, covered, coverage, tiles): pairs that pass the run or the coverage threshold.

    A pair is looked at if it shares ``seed`` words in a row (with ``seed`` over ``min_tile``, pairs of shorter tiles only are not); it is reported if its longest tile has ``min_run`` words or its tiles
    cover ``min_coverage`` of the item. With ``min_coverage`` over 1 only the run counts.
    """
    spark = docs.sparkSession
    dk, ik = docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"doc_key {dk}, item_key {ik}, longest int, covered int, coverage double, tiles int"
    base = spread(docs.select(doc_key, text).where(F.col(text).isNotNull()), doc_key)
    out = None
    for block in _item_blocks(items, item_key, item_text, block_words):
        shared = spark.sparkContext.broadcast((block, *_block_index(block, seed)))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            rows, hashes, owner, place = shared.value
            sizes = np.array([len(ws) for _, ws in rows], np.int64)
            memo: dict[str, int] = {}
            for b in batches:
                found = []
                for k, t in zip(b.iloc[:, 0], b.iloc[:, 1]):
                    ws = words(t)
                    h = rolling(_numbers(ws, memo), seed)
                    if not len(h) or not len(hashes):
                        continue
                    h = np.unique(h)
                    lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
                    hit = hi > lo
                    if not hit.any():
                        continue
                    lo, many = lo[hit], (hi - lo)[hit]
                    at = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
                    near, most, run_most = _bounds(owner[at], place[at], seed)
                    if seed <= min_tile:  # else shorter tiles may add to what the seeds show
                        near = near[(run_most >= min_run) | (most >= min_coverage * sizes[near])]
                    for n in near.tolist():
                        item = rows[n][1]
                        got = tile(ws, item, min(min_tile, seed))
                        longest, covered = max((x[2] for x in got), default=0), sum(x[2] for x in got)
                        if longest >= min_run or covered >= min_coverage * len(item):
                            found.append((k, rows[n][0], longest, covered, covered / len(item), len(got)))
                yield pd.DataFrame(found, columns=["doc_key", "item_key", "longest", "covered", "coverage", "tiles"])

        part = base.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    out = spark.createDataFrame([], schema) if out is None else out
    return out.withColumnRenamed("doc_key", doc_key).withColumnRenamed("item_key", item_key)
