"""Benchmark passages in documents: a prefix-filtered join of shingle sets with exact checks.

An item is cut into windows of ten consecutive words (an item with fewer words is one window), and a window into
shingles of three words. A document that holds a window holds all of its shingles, so one of them is a sufficient
prefix: the one that is rarest over all documents, which keeps candidates few. Where a document has a prefix shingle,
the shingle's place in the window gives the only start the window can have; starts outside the document are dropped by
that bound, and the rest are compared word for word. Words inside any window found are hit.

Documents are read twice, for the rarity of the benchmark's shingles and for the search, and never shuffled. Windows go to
the tasks in blocks of a fixed size, so a benchmark of any size is searched whole, one block after the other.

Results in odd cases: NULL and blank texts have no words and no hits. An item without words has no windows. An item
without an id marks words but is not counted or listed. Items with equal texts are all listed. Repeated documents each get
their row. With no benchmark rows nothing is hit; further input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeflow.llm.shared import memo, pieces, stored

WINDOW = 10
SHINGLE = 3
#: Windows in a block.
BLOCK = 100_000
#: A-Z become a-z, other bytes below 128 that are no digit or letter become spaces; bytes from 128 on belong to words.
_LETTERS = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_FILTER_BITS = 20


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """A text's words in order, in lists of bounded size."""
    for piece in pieces((text or "").encode().translate(_LETTERS)):
        yield piece.split()


def _shingles(found: list[bytes], width: int) -> np.ndarray:
    """A hash for each run of `width` words."""
    known = memo(xxhash.xxh3_64_intdigest)
    hashes = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    total = np.full(max(0, len(found) - width + 1), width, np.uint64)
    for i in range(width):
        total += hashes[i : len(found) - width + 1 + i] * _PLACE[i] if len(total) else 0
    return (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            found = [x for part in words_of(batch.column("text")[row].as_py()) for x in part]
            width = min(WINDOW, len(found))
            cut = {b" ".join(found[i : i + width]).decode() for i in range(len(found) - width + 1)} if found else ()
            yield pa.RecordBatch.from_arrays(
                [pa.array(sorted(cut), pa.string()), pa.array([batch.column("item_id")[row].as_py()] * len(cut), pa.string())], ["window", "item_id"])


class _Lookup:
    """Which of an array's hashes are in a set: a small bit table first, then the sorted set."""

    def __init__(self, hashes: set[int]):
        self.sorted = np.array(sorted(hashes), np.uint64)
        self.table = np.zeros(1 << _FILTER_BITS, bool)
        self.table[(self.sorted >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def places(self, hashes: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.table[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        if not len(maybe) or not len(self.sorted):
            return maybe[:0]
        at = np.minimum(np.searchsorted(self.sorted, hashes[maybe]), len(self.sorted) - 1)
        return maybe[self.sorted[at] == hashes[maybe]]


def _overlapping(text: str | None, keep: int) -> Iterator[tuple[int, list[bytes]]]:
    """Lists of words with the place of their first; each repeats the last `keep` words of the one before."""
    start, tail = 0, []
    for found in words_of(text):
        found = tail + found
        yield start, found
        tail = found[-keep:] if keep else []
        start += len(found) - len(tail)


def _frequencies(by_width: dict[int, set[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = {width: _Lookup(hashes) for width, hashes in by_width.items()}
        counts: dict[int, int] = defaultdict(int)
        for batch in batches:
            for text in batch.column("text"):
                seen = set()
                for _, found in _overlapping(text.as_py(), SHINGLE - 1):
                    for width, lookup in lookups.items():
                        hashes = _shingles(found, width)
                        seen.update(hashes[lookup.places(hashes)].tolist())
                for x in seen:
                    counts[x] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(list(counts), np.uint64).view(np.int64)), pa.array(list(counts.values()), pa.int64())], ["shingle", "n"])

    return run


def _block(rows: list, documents: DataFrame) -> tuple[dict, dict]:
    """A block's windows by their rarest shingle (width and hash): the shingle's offset, the words, the item ids."""
    windows = [(row["window"].encode().split(), [x for x in row["items"]]) for row in rows]
    cut = [(min(SHINGLE, len(found)), _shingles(found, min(SHINGLE, len(found))).tolist()) for found, _ in windows]
    by_width: dict[int, set[int]] = defaultdict(set)
    for width, hashes in cut:
        by_width[width].update(hashes)
    counted = documents.select("text").mapInArrow(_frequencies(dict(by_width)), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    often = {row["shingle"] % (1 << 64): row["n"] for row in counted.collect()}
    index: dict[tuple[int, int], list] = defaultdict(list)
    for (found, items), (width, hashes) in zip(windows, cut, strict=True):
        n, rarest, offset = min((often.get(x, 0), x, i) for i, x in enumerate(hashes))
        if n:  # a shingle that no document has needs no search
            index[width, rarest].append((offset, found, items))
    return dict(index), {width: {x for w, x in index if w == width} for width in by_width}


def _lookups(by_width: dict[int, set[int]]) -> dict[int, _Lookup]:
    return {width: _Lookup(hashes) for width, hashes in by_width.items() if hashes}


def _hits(text: str | None, index: dict, lookups: dict[int, _Lookup]) -> Iterator[tuple[int, tuple[int, int] | None, list]]:
    """Number of words up to here, and each window found: its first word and the one after its last, with the window's item ids.

    Each part of the text ends with its size and no window.
    """
    for start, found in _overlapping(text, WINDOW - 1):
        for width, lookup in lookups.items():
            hashes = _shingles(found, width)
            for place in lookup.places(hashes).tolist():
                for offset, window, ids in index[width, int(hashes[place])]:
                    first = place - offset
                    if first >= 0 and first + len(window) <= len(found) and found[first : first + len(window)] == window:
                        yield start + len(found), (start + first, start + first + len(window)), ids
        yield start + len(found), None, []


def _search(index: dict, by_width: dict[int, set[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = _lookups(by_width)
        for batch in batches:
            counts, hits, items = [], [], []
            for text, before, listed in zip(batch.column("text"), batch.column("hit"), batch.column("items"), strict=True):
                spans, named, size = [], set(listed.as_py()), 0
                for size, span, ids in _hits(text.as_py(), index, lookups):  # noqa: B007
                    if span:
                        spans.append(span)
                        named.update(ids)
                mask = before.as_py()
                if spans:
                    bits = np.unpackbits(np.frombuffer(mask, np.uint8), count=size).copy() if mask else np.zeros(size, np.uint8)
                    for first, end in spans:
                        bits[first:end] = 1
                    mask = np.packbits(bits).tobytes()
                counts.append(size)
                hits.append(mask)
                items.append(sorted(named))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.array(counts, pa.int64()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))],
                ["doc_id", "text", "n_words", "hit", "items"])

    return run


def _unhit(index: dict, by_width: dict[int, set[int]]):
    """Rows whose text holds no window of the block, unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = _lookups(by_width)
        for batch in batches:
            clean = [all(span is None for _, span, _ in _hits(text.as_py(), index, lookups)) for text in batch.column("text")]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit = [int(np.unpackbits(np.frombuffer(x.as_py(), np.uint8)).sum()) if x.as_py() else 0 for x in batch.column("hit")]
        items = batch.column("items").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
             pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array([x > 0 for x in hit])],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _blocks(documents: DataFrame, benchmark: DataFrame, block: int) -> Iterator[tuple[bool, dict, dict]]:
    """For each block of windows whether it is the last, and its index."""
    cut = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(_windows, "window string, item_id string")
    windows = stored(cut.groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.min(F.xxhash64("window")).alias("order")), "windows")
    number = windows.count()
    blocks = max(1, -(-number // block))
    # Blocks of about equal size; their number follows the benchmark, each one's size does not.
    windows = windows.withColumn("block", F.pmod("order", F.lit(blocks)))
    for i in range(blocks):
        yield i + 1 == blocks, *_block(windows.where(F.col("block") == i).select("window", "items").collect(), documents)


def marked(documents: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, text, n_words, hit (a bit for each word of the text, NULL if none is hit) and items (sorted ids found)."""
    rows = documents.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("hit"), F.array().cast("array<string>").alias("items"))
    schema = rows.schema
    for last, index, by_width in _blocks(documents, benchmark, block):
        rows = rows.mapInArrow(_search(index, by_width), schema)
        if not last:
            rows = stored(rows, "marked")
    return rows


def contaminated(documents: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    id_type = documents.schema["doc_id"].dataType.simpleString()
    return marked(documents, benchmark, block).select("doc_id", "n_words", "hit", "items").mapInArrow(
        _digest, f"doc_id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def without_contaminated(documents: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents without any hit word. Each row is judged by its own text, whatever its id."""
    rows = documents
    for last, index, by_width in _blocks(documents, benchmark, block):
        rows = rows.mapInArrow(_unhit(index, by_width), documents.schema)
        if not last:
            rows = stored(rows, "clean")
    return rows
