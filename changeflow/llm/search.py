"""Ranked lexical search over all documents, in which documents with the same bag are scored once.

Terms are runs of digits, letters and characters above 127, A-Z in lower case. A document is cut down to the terms that
items use: its bag is the sorted list of (term, occurrences) it has left, and with its length mark m the bag decides its
score for every item. Documents with the same bag and mark are one class: grouped by hash, with bag and mark themselves
among the keys, so that only identical ones share a class. Each class is scored once against every item, a task keeps the
best classes per item, and the best of these over all tasks are expanded into members by ascending id. No class beyond an
item's first `top`, ordered by score and smallest member, can hold one of its first `top` documents: each class before it
has a member that comes first.

Documents are read once for a block of items and never shuffled; bags are shuffled once, after copies inside a task have
been folded. A block holds whole items with about BLOCK_TERMS different terms together, which bounds what a task is sent:
terms above 32 bytes travel as digests. A benchmark of any size is searched whole, one block after the other.

Results in odd cases: NULL or blank texts have no terms; such documents are in no result and do not count. An item without
terms gets no rows, one without an id or with the id of another item gets its own rows. Documents without an id come after
those with one at equal scores; repeated documents each take their rank. Empty tables give no rows. Further input columns
are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changeflow.llm.decontam import words_of
from changeflow.llm.shared import stored

#: Results for an item.
TOP = 20
#: Different terms of items searched together.
BLOCK_TERMS = 200_000
#: Scores, and uses of terms in items, held at once in a task.
CELLS = 1_000_000
#: Bytes of winning classes that a broadcast may hold.
BROADCAST_BYTES = 32 << 20
#: Longer terms are known by a digest.
LONG_TERM = 32


def _known(term: bytes) -> bytes:
    """The term, or for a long one a digest that no term can equal."""
    return term if len(term) <= LONG_TERM else b" " + hashlib.md5(term).digest()


def _counted(text: str | None) -> Counter:
    counts: Counter = Counter()
    for found in words_of(text):
        counts.update(found)
    return counts


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [Counter({_known(term): n for term, n in _counted(text.as_py()).items()}) for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("item"), batch.column("item_id"), pa.array([list(x) for x in counts], pa.list_(pa.binary())),
             pa.array([list(x.values()) for x in counts], pa.list_(pa.int64()))], ["item", "item_id", "terms", "times"])


def _bags(shipped):
    """Per document its number of terms and its bag: pairs of term number and occurrences, by term number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shipped.value
        for batch in batches:
            sizes, bags = [], []
            for text in batch.column("text"):
                counts = _counted(text.as_py())
                sizes.append(counts.total())
                pairs = sorted((numbers[x], n) for term, n in counts.items() if (x := _known(term)) in numbers)
                bags.append(np.array(pairs, "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(bags, pa.binary())], ["doc_id", "n", "bag"])

    return run


def _decoded(bags: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term numbers and occurrences of all bags in a row, and the number of pairs of each."""
    whole = [x.as_py() for x in bags]
    pairs = np.frombuffer(b"".join(whole), "<u4").reshape(-1, 2).astype(np.int64)
    return pairs[:, 0], pairs[:, 1], np.array([len(x) // 8 for x in whole], np.int64)


def _holding(terms: int):
    """Number of documents that hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(terms, np.int64)
        for batch in batches:
            counts += np.bincount(_decoded(batch.column("bag"))[0], minlength=terms)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["term", "df"])

    return run


def _spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _cuts(bags: pa.Array, starts: np.ndarray, items: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose scores and uses of terms, which a common term has many of, are about CELLS together."""
    if not len(bags):
        return
    term, _, lengths = _decoded(bags)
    uses = np.concatenate([[0], np.cumsum(starts[term + 1] - starts[term])])
    ends = np.cumsum(lengths)
    place = np.cumsum(uses[ends] - uses[ends - lengths] + items) // CELLS
    edges = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(bags)]
    yield from zip(edges, edges[1:], strict=False)


def _best(shipped, items: int, top: int):
    """The best classes of each item in this task, with their scores."""

    def last_nulls(entry):
        return -entry[0], entry[1] is None, entry[1], entry[2], entry[3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, starts, holders, times = shipped.value
        kept: list[list] = [[] for _ in range(items)]
        least = np.ones(items, np.int64)
        kind = None
        for batch in batches:
            kind = batch.column("first").type
            for cut, end in _cuts(batch.column("bag"), starts, items):
                part = batch.slice(cut, end - cut)
                term, tf, lengths = _decoded(part.column("bag"))
                m = np.repeat(np.asarray(part.column("m"), np.int64), lengths)
                share = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
                degree = starts[term + 1] - starts[term]
                place = np.repeat(starts[term], degree) + _spread(degree)
                scores = np.zeros((part.num_rows, items), np.int64)
                rows = np.repeat(np.repeat(np.arange(part.num_rows), lengths), degree)
                np.add.at(scores.reshape(-1), rows * items + holders[place], np.repeat(share, degree) * times[place])
                floor = least
                if part.num_rows > top:
                    floor = np.maximum(least, np.partition(scores, part.num_rows - top, axis=0)[part.num_rows - top])
                found, which = np.nonzero(scores >= floor)
                bags, first, marks = part.column("bag"), part.column("first"), part.column("m")
                for row, item in zip(found.tolist(), which.tolist(), strict=True):
                    kept[item].append((int(scores[row, item]), first[row].as_py(), marks[row].as_py(), bags[row].as_py()))
                for item in set(which.tolist()):
                    kept[item] = sorted(kept[item], key=last_nulls)[:top]
                    if len(kept[item]) == top:
                        least[item] = kept[item][-1][0]
        for item, entries in enumerate(kept):
            if entries:
                score, first, marks, bags = zip(*entries, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(entries), pa.int32()), pa.array(score, pa.int64()), pa.array(first, kind), pa.array(marks, pa.int64()), pa.array(bags, pa.binary())],
                    ["item", "score", "first", "m", "bag"])

    return run


def _weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def ranked(documents: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of each item's `top` best documents with a score above 0."""
    spark = documents.sparkSession
    doc_type, item_type = documents.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    cut = stored(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text").mapInArrow(
        _items, f"item long, item_id {item_type}, terms array<binary>, times array<long>"), "items").where(F.size("terms") > 0)
    blocks = math.ceil((cut.agg(F.sum(F.size("terms"))).first()[0] or 0) / block_terms)
    found = [
        _searched(documents, cut.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block), doc_type, top) for block in range(blocks)]
    found = [x for x in found if x is not None]
    if not found:
        return spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {doc_type}, score long")
    return functools.reduce(DataFrame.unionAll, found)


def _searched(documents: DataFrame, block: DataFrame, doc_type: str, top: int) -> DataFrame | None:
    """The result for one block of items; None if it has no items or there are no documents with terms."""
    spark = documents.sparkSession
    rows = block.collect()
    numbers = {term: i for i, term in enumerate(sorted({bytes(x) for row in rows for x in row["terms"]}))}
    if not rows:
        return None
    bags = stored(documents.select("doc_id", "text").mapInArrow(
        _bags(spark.sparkContext.broadcast(numbers)), f"doc_id {doc_type}, n long, bag binary"), "bags")
    count, length = bags.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    if not count:
        return None
    bags = bags.where("octet_length(bag) > 0")
    holding = np.zeros(len(numbers), np.int64)
    for row in bags.select("bag").mapInArrow(_holding(len(numbers)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        holding[row["term"]] = row["df"]
    weights = np.array([_weight(count, int(x)) for x in holding], np.int64)
    uses = sorted((numbers[bytes(term)], i, n) for i, row in enumerate(rows) for term, n in zip(row["terms"], row["times"], strict=True))
    term, holders, times = (np.array(x, np.int64) for x in zip(*uses, strict=True))
    shipped = spark.sparkContext.broadcast((weights, np.searchsorted(term, np.arange(len(numbers) + 1)), holders, times))

    # Whole numbers of 38 digits: 25 * n * N may pass 64 bits before it is divided.
    marked = bags.withColumn("m", F.expr(f"75 + (CAST(n AS DECIMAL(19, 0)) * {25 * count}BD) div {length}BD"))
    marked = marked.withColumn("h", F.xxhash64("m", "bag")).select("h", "m", "bag", "doc_id")
    classes = marked.groupBy("h", "m", "bag").agg(F.min("doc_id").alias("first"))
    best = stored(classes.select("first", "m", "bag").mapInArrow(
        _best(shipped, len(rows), top), f"item int, score long, first {doc_type}, m long, bag binary"), "best")
    by_first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("first"), "m", "bag")
    winners = best.withColumn("place", F.row_number().over(by_first)).where(F.col("place") <= top).withColumn("h", F.xxhash64("m", "bag"))
    chosen = stored(winners.groupBy("h", "m", "bag").agg(F.collect_list(F.struct("item", "score")).alias("wins")).withColumn("class", F.monotonically_increasing_id()), "winners")
    narrow = chosen.select("h", "m", "bag", "class")
    size = chosen.agg(F.sum(F.octet_length("bag") + 64)).first()[0] or 0
    members = marked.join(F.broadcast(narrow) if size <= BROADCAST_BYTES else narrow, ["h", "m", "bag"]).select("class", "doc_id")
    by_id = Window.partitionBy("class").orderBy(F.asc_nulls_last("doc_id"))
    members = members.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= top).drop("place")
    wins = chosen.select("class", F.inline("wins"))
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "class")
    names = spark.createDataFrame([(i, row["item_id"]) for i, row in enumerate(rows)], f"item int, item_id {block.schema['item_id'].dataType.simpleString()}")
    return members.join(wins, "class").withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= top).join(names, "item").select(
        "item_id", "rank", "doc_id", "score")
