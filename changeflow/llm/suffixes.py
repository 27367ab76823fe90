"""Removal of repeated byte strings by suffix buckets and a difference cover.

Two suffixes of the corpus repeat 100 bytes if they agree that far, so suffixes are compared to that depth and never beyond
the end of their document. Sorting all of them at once would cost many times the text. Instead:

1. A difference cover modulo 57 (eight residues whose differences give all others) selects one position in seven. Any two
   suffixes have an offset below 57 at which both are cover positions, so if they agree in 100 bytes, two cover positions
   in these agree in the 44 bytes left at the least. The cover positions are sorted first, one bucket of fingerprints at a
   time, and each learns whether it is tied with another.
2. A suffix without a tied cover position among its first 57 bytes repeats nothing. The others form stretches of text, cut
   where a hash of the next bytes says so and thus alike in equal texts. Equal stretches need no further order: all but the
   first of them are repeats as a whole.
3. Stretches are numbered in the order of their documents and starts. The suffixes of the first ones are sorted to the full
   depth, one bucket at a time; of equal suffixes the one from the lowest number is kept. Stretches that are much alike lie in
   one block (by their smallest hash of a short window), so most equal suffixes have met before anything is sent.

Order among unequal suffixes does not matter here, so buckets are sorted by fingerprints instead of letters: those of cover
positions have twelve bits more than it takes to number them (a false tie costs time only), those of whole windows enough
that any two different windows share one with a chance below one in 100000 for the whole corpus. What is sorted travels as sorted runs of fingerprints
for a block and a bucket, about three bytes for a cover position and eight for a window, and what returns is one bit each. A task holds one block of
text or one bucket. A block sends each fingerprint once however often it occurs, so no key is hot. Texts are packed once and
read four times.

Results in odd cases: a NULL text counts as empty. Texts below 100 bytes keep all. Documents come in the order of their ids,
those without one last, those with equal ids by a digest of their text; of repeated rows the first stays and the rest are
repeats. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from changeflow.llm.shared import stored

#: Bytes of a repeat.
LENGTH = 100
#: A difference cover: every number below the modulus is a difference of two of its residues.
MODULUS = 57
COVER = np.array([0, 1, 3, 13, 32, 36, 43, 52])
#: Bytes that two equal windows have left at the cover position they share, at the least.
SAMPLE = LENGTH - MODULUS + 1
#: Bytes of text in a block (whole documents) and in one whose every suffix is sorted, fingerprints in a bucket, bytes hashed at once.
BLOCK_BYTES = 4 << 20
LAYOUT_BYTES = 1 << 20
BUCKET_ROWS = 4 << 20
PIECE = 1 << 20
LEAST_BUCKET_BITS = 6
#: Times that windows are sent, each time those of some of the buckets, and the number of windows from which on they are not sent at once.
#: What is sent is twice the text and the most that disks hold here; another time costs one more hash of each window.
TIMES = 2
ONCE = 16 << 20
#: Bits of a cover position's fingerprint beyond those that number all of them; of a window's beyond those that number all pairs.
SPARE_BITS = 12
PAIR_BITS = 16
#: Bits of a window's second fingerprint.
MORE_BITS = 32
#: Bytes of the short windows whose smallest hash says which stretches are alike.
SHINGLE = 16
#: Windows in a stretch, on average.
STRETCH = 512
#: Bytes that a broadcast may hold.
BROADCAST_BYTES = 32 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Fingerprints:
    """Hashes of windows from sums of weighted bytes modulo 2^64: the weights are powers of an odd base, so a window's own
    sum is the difference of two running sums times an inverse power."""

    def __init__(self, seed: int, base: int):
        self.bytes = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        inverse = pow(base, -1, 1 << 64)
        self.powers, self.inverses = (np.cumprod(np.array([1] + [x] * (PIECE + LENGTH), np.uint64)) for x in (base, inverse))

    def at(self, data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the windows at ascending starts."""
        out = np.empty(len(starts), np.uint64)
        cuts = np.searchsorted(starts, np.arange(0, len(data) + PIECE, PIECE))
        for number, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if low < high:
                part = data[number * PIECE : (number + 1) * PIECE + length]
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(self.bytes[part] * self.powers[: len(part)], out=sums[1:])
                at = starts[low:high] - number * PIECE
                out[low:high] = (sums[at + length] - sums[at]) * self.inverses[at]
        return _mixed(out)


@functools.cache
def _first() -> _Fingerprints:
    return _Fingerprints(1, 0xD1342543DE82EF95)


@functools.cache
def _second() -> _Fingerprints:
    return _Fingerprints(7919, 0xAF251AF3B0F025B5)


def _squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _loosened(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers as one plane for each of their bytes: planes that hardly change shrink to nothing."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_loosened(data), np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def _run(values: np.ndarray) -> bytes:
    """Ascending numbers by their gaps."""
    return _planes(np.diff(values, prepend=np.uint64(0)))


def _values(run: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(run), dtype=np.uint64)


def _spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one: a batch of blocks is never unpacked as a whole."""
    for batch in batches:
        for row in range(batch.num_rows):
            yield batch.slice(row, 1).to_pylist()[0]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole documents in blocks: ids, sizes and digests beside the squeezed texts."""
    ids, texts, held, kind = [], [], 0, None

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(kind)), pa.array([[len(x) for x in texts]], pa.list_(pa.int64())),
             pa.array([[hashlib.sha256(x).digest()[:16] for x in texts]], pa.list_(pa.binary())), pa.array([_squeezed(b"".join(texts))], pa.binary())],
            ["ids", "sizes", "digests", "blob"])

    for batch in batches:
        kind = batch.column("doc_id").type
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            ids.append(doc_id.as_py())
            texts.append((text.as_py() or "").encode())
            held += len(texts[-1])
            if held >= BLOCK_BYTES:
                yield block()
                ids, texts, held = [], [], 0
    if ids:
        yield block()


def _cover(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All cover positions of a block's documents that can lie in a window, and their documents."""
    starts = np.cumsum(sizes) - sizes
    reach = np.where(sizes >= LENGTH, sizes - SAMPLE + 1, 0)
    counts = len(COVER) * (reach // MODULUS) + np.searchsorted(COVER, reach % MODULUS)
    place = _spread(counts)
    document = np.repeat(np.arange(len(sizes)), counts)
    return starts[document] + MODULUS * (place // len(COVER)) + COVER[place % len(COVER)], document


def _samples(data: np.ndarray, sizes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, document = _cover(sizes)
    return at, document, _first().at(data, at, SAMPLE) >> np.uint64(64 - bits)


def _by_bucket(values: np.ndarray, bits: int, bucket_bits: int) -> Iterator[tuple[int, slice]]:
    """The bucket numbers of ascending values, with the place of each one's values."""
    bucket = (values >> np.uint64(bits - bucket_bits)).astype(np.int64)
    edges = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(values)]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        yield int(bucket[low]), slice(low, high)


def _sent_samples(bits: int, bucket_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            data, sizes = np.frombuffer(_loosened(row["blob"]), np.uint8), np.array(row["sizes"], np.int64)
            values = np.unique(_samples(data, sizes, bits)[2])
            cut = [(bucket, _run(values[part])) for bucket, part in _by_bucket(values, bits, bucket_bits)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in cut], pa.int32()), pa.array([row["block"]] * len(cut), pa.int64()), pa.array([x for _, x in cut], pa.binary())], ["bucket", "block", "run"])

    return run


def _answers(table: pa.Table, flags: list[np.ndarray]) -> pa.Table:
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "bits": pa.array([np.packbits(x).tobytes() for x in flags], pa.binary())})


def _tied(table: pa.Table) -> pa.Table:
    """One bucket: which fingerprints of each block another block has too."""
    runs = [_values(x.as_py()) for x in table.column("run")]
    values = np.sort(np.concatenate(runs))
    again = values[1:][values[1:] == values[:-1]]
    if not len(again):
        return _answers(table, [np.zeros(len(x), bool) for x in runs])
    return _answers(table, [again[np.minimum(np.searchsorted(again, x), len(again) - 1)] == x for x in runs])


def _returned(answers: list[dict] | None, sizes: list[int]) -> np.ndarray:
    """The bits that came back for a block's values, buckets in order; `sizes` are those of the block's own buckets."""
    parts = [np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=n).astype(bool) for x, n in zip(sorted(answers or [], key=lambda x: x["bucket"]), sizes, strict=True)]
    return np.concatenate([np.zeros(0, bool), *parts])


def _stretches(bits: int, bucket_bits: int, kind: pa.DataType):
    """Places of suffixes with a tied cover position, in stretches that reach down to their full depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            whole, sizes = _loosened(row["blob"]), np.array(row["sizes"], np.int64)
            data = np.frombuffer(whole, np.uint8)
            at, document, hashes = _samples(data, sizes, bits)
            values, place, counts = np.unique(hashes, return_inverse=True, return_counts=True)
            tied = counts > 1
            tied |= _returned(row["answers"], [x.stop - x.start for _, x in _by_bucket(values, bits, bucket_bits)])
            chosen = tied[place]
            at, document = at[chosen], document[chosen]
            ends = np.cumsum(sizes)
            low = np.maximum(at - MODULUS + 1, (ends - sizes)[document])
            high = np.minimum(at, ends[document] - LENGTH)
            low, high = low[low <= high], high[low <= high]
            if not len(low):
                continue
            new = np.concatenate([[True], low[1:] > high[:-1] + 1])
            low, high = low[new], high[np.concatenate([new[1:], [True]])]
            starts = np.repeat(low, high - low + 1) + _spread(high - low + 1)
            short = _second().at(data, np.minimum(starts, len(data) - SHINGLE), SHINGLE)
            fresh = np.ones(len(starts), bool)
            fresh[1:] = (np.diff(starts) > 1) | (short[1:] % np.uint64(STRETCH) == 0)
            first = np.flatnonzero(fresh)
            first = np.unique(np.concatenate([first, *(np.arange(a, b, PIECE) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(starts)], strict=True) if b - a > PIECE)]))
            begin, end = starts[first], starts[np.concatenate([first[1:], [len(starts)]]) - 1] + LENGTH
            number = np.searchsorted(ends, begin, side="right")
            same = [hashlib.sha256(whole[a:b]).digest()[:16] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(begin), row["block"])), pa.array(number, pa.int32()), pa.array(begin - (ends - sizes)[number]), pa.array(end - begin), pa.array(same, pa.binary()),
                 pa.array([row["ids"][i] for i in number.tolist()], kind), pa.array([row["digests"][i] for i in number.tolist()], pa.binary()),
                 pa.array((np.minimum.reduceat(short, first) >> np.uint64(1)).astype(np.int64))],
                ["block", "number", "start", "size", "same", "doc_id", "digest", "alike"])

    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of the stretches that were first of their kind."""
    for row in _rows(batches):
        whole, begins = _loosened(row["blob"]), np.cumsum([0, *row["sizes"]]).tolist()
        columns = {name: [x[name] for x in row["firsts"]] for name in ("rank", "number", "start", "size", "alike")}
        texts = [whole[begins[i] + start : begins[i] + start + size] for i, start, size in zip(columns["number"], columns["start"], columns["size"], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns["rank"], pa.int64()), pa.array([row["block"]] * len(texts), pa.int64()), *(pa.array(columns[x], pa.int64()) for x in ("number", "start", "size", "alike")),
             pa.array(texts, pa.binary())], ["rank", "block", "number", "start", "size", "alike", "bytes"])


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches in blocks, by their rank within each."""
    names, held, size = ["rank", "block", "number", "start", "size"], [], 0

    def block() -> pa.RecordBatch:
        rows = sorted(held, key=lambda row: row["rank"])
        return pa.RecordBatch.from_arrays(
            [*(pa.array([[row[name] for row in rows]], pa.list_(pa.int64())) for name in names), pa.array([size - (LENGTH - 1) * len(rows)], pa.int64()),
             pa.array([_squeezed(b"".join(row["bytes"] for row in rows))], pa.binary())], ["ranks", "blocks", "numbers", "starts", "sizes", "windows", "blob"])

    for batch in batches:
        for row in batch.to_pylist():
            held.append(row)
            size += row["size"]
            if size >= LAYOUT_BYTES:
                yield block()
                held, size = [], 0
    if held:
        yield block()


def _sorted_windows(row: dict, bits: int, bucket_bits: int = 0, buckets: range | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of a block's windows by fingerprint (equal ones by place), both fingerprints in that order, whether each is the
    first of its kind here, and the stretch of each window; of the windows in these buckets only, if any are named."""
    data, sizes = np.frombuffer(_loosened(row["blob"]), np.uint8), np.array(row["sizes"], np.int64)
    counts = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(counts), dtype=np.uint32), counts)
    starts = (np.cumsum(sizes) - sizes)[owner] + _spread(counts)
    one = _first().at(data, starts, LENGTH) >> np.uint64(64 - bits)
    if buckets is not None:
        bucket = one >> np.uint64(bits - bucket_bits)
        mine = (bucket >= buckets.start) & (bucket < buckets.stop)
        owner, starts, one = owner[mine], starts[mine], one[mine]
    two = (_second().at(data, starts, LENGTH) >> np.uint64(64 - MORE_BITS)).astype(np.uint32)
    order = np.argsort(one, kind="stable")
    a, b = one[order], two[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, a, b, fresh, owner


def _sent_windows(bits: int, bucket_bits: int, buckets: range):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            order, a, b, fresh, owner = _sorted_windows(row, bits, bucket_bits, buckets)
            if not len(a):
                continue
            a, b, owner = a[fresh], b[fresh], owner[order[fresh]]
            ranks = _run(np.array(row["ranks"], np.uint64))
            cut = [(bucket, _run(a[part]), b[part].astype("<u4").tobytes(), _planes(owner[part])) for bucket, part in _by_bucket(a, bits, bucket_bits)]
            bucket, runs, more, owners = zip(*cut, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.int32()), pa.array([row["block"]] * len(cut), pa.int64()), pa.array(runs, pa.binary()), pa.array(more, pa.binary()),
                 pa.array(owners, pa.binary()), pa.array([ranks] * len(cut), pa.binary())], ["bucket", "block", "run", "more", "owners", "ranks"])

    return run


def _later(table: pa.Table) -> pa.Table:
    """One bucket: which windows of each block a stretch of lower rank in another block has too."""
    runs = [_values(x.as_py()) for x in table.column("run")]
    one = np.concatenate(runs)
    two = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("more")])
    rank = np.concatenate([_values(x.as_py())[_from_planes(owners.as_py())] for x, owners in zip(table.column("ranks"), table.column("owners"), strict=True)])
    order = np.argsort(one)
    a = one[order]
    again = np.zeros(len(a), bool)
    again[1:] = a[1:] == a[:-1]
    again[:-1] |= again[1:]
    order = order[again]
    order = order[np.lexsort((rank[order], two[order], one[order]))]
    a, b = one[order], two[order]
    later = np.zeros(len(one), bool)
    later[order[1:]] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    return _answers(table, np.split(later, np.cumsum([len(x) for x in runs])[:-1]))


def _repeats(bits: int, bucket_bits: int):
    """Bytes of each stretch that lie in a window that starts earlier too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            order, a, _, fresh, _ = _sorted_windows(row, bits)
            counts = np.array(row["sizes"], np.int64) - LENGTH + 1
            kept = a[fresh]
            later = _returned(row["answers"], [x.stop - x.start for _, x in _by_bucket(kept, bits, bucket_bits)])
            repeated = np.empty(len(a), bool)
            repeated[order] = ~fresh | later[np.cumsum(fresh) - 1]
            out = []
            for block, number, start, part in zip(row["blocks"], row["numbers"], row["starts"], np.split(repeated, np.cumsum(counts)[:-1]), strict=True):
                if part.any():
                    edges = np.flatnonzero(np.diff(part.astype(np.int8), prepend=0, append=0)) + start
                    out.append((block, number, edges[::2], edges[1::2] + LENGTH - 1))
            if out:
                block, number, begin, end = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block, pa.int64()), pa.array(number, pa.int32()), pa.array(begin, pa.list_(pa.int64())), pa.array(end, pa.list_(pa.int64()))],
                    ["block", "number", "begins", "ends"])

    return run


def _kept(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Removed bytes, removed runs, and the rest."""
    parts, removed, runs, at = [], 0, 0, 0
    for begin, end in sorted(spans):
        if begin > at or not runs:
            parts.append(text[at:begin])
            runs += 1
        removed += max(0, end - max(begin, at))
        at = max(at, end)
    return removed, runs, b"".join([*parts, text[at:]])


def _cleaned(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            whole, spans, at, out = _loosened(row["blob"]), {}, 0, []
            for x in row["spans"] or []:
                spans.setdefault(x["number"], []).extend(zip(x["begins"], x["ends"], strict=True))
            for number, size in enumerate(row["sizes"]):
                removed, runs, rest = _kept(whole[at : at + size], spans.get(number, []))
                out.append((size, removed, runs, rest))
                at += size
            sizes, removed, runs, rest = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], kind), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in rest]), pa.array(rest, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _bucket_bits(rows: int) -> int:
    return max(LEAST_BUCKET_BITS, (rows // BUCKET_ROWS).bit_length())


def _with(blocks: DataFrame, extra: DataFrame, size: int, how: str = "left") -> DataFrame:
    """Blocks with what belongs to them, which is broadcast only if its stored bytes are few."""
    return blocks.join(F.broadcast(extra) if size <= BROADCAST_BYTES else extra, "block", how)


def _sorted_by_bucket(sent: list[DataFrame], sort, label: str) -> tuple[DataFrame, int]:
    """One row per block with the answers of all buckets, and their bytes. What is sent is sorted one after the other."""
    answers = functools.reduce(DataFrame.unionByName, [
        stored(part.groupBy("bucket").applyInArrow(sort, "block long, bucket int, bits binary"), label) for part in sent])
    size = answers.agg(F.sum(F.octet_length("bits") + 16)).first()[0] or 0
    return answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers")), size


def packed(documents: DataFrame) -> DataFrame:
    """Documents in numbered blocks, written once."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    blocks = documents.select("doc_id", "text").mapInArrow(_packed, f"ids array<{kind}>, sizes array<long>, digests array<binary>, blob binary")
    return stored(blocks.withColumn("block", F.monotonically_increasing_id()), "texts")


def repeated_spans(blocks: DataFrame) -> DataFrame:
    """Per block and document number, the bytes covered by strings of LENGTH bytes that also start earlier."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    total = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    samples = total * len(COVER) // MODULUS + 1
    bits, bucket_bits = min(63, max(24, samples.bit_length() + SPARE_BITS)), _bucket_bits(samples)
    texts = blocks.select("block", "sizes", "blob")
    answers, size = _sorted_by_bucket([texts.mapInArrow(_sent_samples(bits, bucket_bits), "bucket int, block long, run binary")], _tied, "ties")
    stretches = stored(_with(blocks, answers, size).mapInArrow(
        _stretches(bits, bucket_bits, to_arrow_type(blocks.schema["ids"].dataType.elementType)),
        f"block long, number int, start long, size long, same binary, doc_id {kind}, digest binary, alike long"), "stretches")

    place = ["block", "number", "start"]
    order = [F.col("doc_id").isNull(), "doc_id", "digest", *place]
    ranked = stretches.repartitionByRange(*order).sortWithinPartitions(*order).select(
        *place, "size", "same", "alike", F.monotonically_increasing_id().alias("rank"))
    ranked = stored(ranked, "ranks")
    firsts = stored(ranked.groupBy("same").agg(F.min(F.struct("rank", *place, "size", "alike")).alias("first")).select("first.*"), "firsts")
    copies = ranked.join(firsts.select("rank"), "rank", "left_anti").select(
        "block", "number", F.array("start").alias("begins"), F.array(F.col("start") + F.col("size")).alias("ends"))
    by_block = firsts.groupBy("block").agg(F.collect_list(F.struct("rank", "number", "start", "size", "alike")).alias("firsts"))
    near = _with(texts, by_block, 40 * firsts.count(), "inner").mapInArrow(_cut_out, "rank long, block long, number long, start long, size long, alike long, bytes binary")
    near = near.repartitionByRange("alike", "rank").sortWithinPartitions("alike", "rank")
    lists = ", ".join(f"{x} array<long>" for x in ("ranks", "blocks", "numbers", "starts", "sizes"))
    layout = near.mapInArrow(_laid_out, f"{lists}, windows long, blob binary")
    layout = stored(layout.withColumn("block", F.monotonically_increasing_id()), "layout")
    total = layout.agg(F.sum("windows")).first()[0] or 0
    bits, bucket_bits = min(64, max(24, 2 * total.bit_length() + PAIR_BITS - MORE_BITS)), _bucket_bits(total)
    cuts = [(1 << bucket_bits) * n // times for times in [TIMES if total > ONCE else 1] for n in range(times + 1)]
    windows = [
        layout.select("block", "ranks", "sizes", "blob").mapInArrow(
            _sent_windows(bits, bucket_bits, range(low, high)), "bucket int, block long, run binary, more binary, owners binary, ranks binary")
        for low, high in zip(cuts[:-1], cuts[1:], strict=True)]
    answers, size = _sorted_by_bucket(windows, _later, "repeats")
    repeats = _with(layout, answers, size).mapInArrow(_repeats(bits, bucket_bits), "block long, number int, begins array<long>, ends array<long>")
    return repeats.unionByName(copies)


def cleaned(documents: DataFrame) -> DataFrame:
    """doc_id, sizes, and the bytes that are left of every document, with their digest."""
    blocks = packed(documents)
    spans = stored(repeated_spans(blocks), "spans")
    size = spans.agg(F.sum(16 * F.size("begins") + 24)).first()[0] or 0
    spans = spans.groupBy("block").agg(F.collect_list(F.struct("number", "begins", "ends")).alias("spans"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return _with(blocks.drop("digests"), spans, size).mapInArrow(
        _cleaned(to_arrow_type(documents.schema["doc_id"].dataType)), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def removed_repeats(documents: DataFrame) -> DataFrame:
    """Per document its bytes, the bytes and runs removed, and a digest of what is left."""
    return cleaned(documents).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
