"""Near-duplicate documents by HyperMinHash: compressed registers, banding, corrected estimates, exact checks.

A document is the set of its distinct five-word shingles. Each shingle has a 64-bit hash; its first bits choose one of
128 registers, and a register keeps its smallest hash as a count of leading zeros and ten mantissa bits. Four registers
in a row are a band, in which an empty register repeats a used one that its place decides. Documents that agree in a band are candidates, an estimate from all registers (less the agreements
that chance gives) drops the hopeless ones, and the rest are compared on their full sets.

Equal sets are one class before anything is compared. The pivot of a band is the member that shares bands with most others.
Every member is compared with the most central of its pivots, then with the pivots that this has left in other components, then with the most central member outside the pivot's component where the band still holds
several. Members that no pivot joined are strays. A shingle that only one stray has cannot be common to two of them, so a
stray with more than a quarter of such shingles links to no other and goes; larger sets are judged by those shingles whose
hash ends in two zero bits, with the same margin as an estimate. The rest meet in cells of some hundred members,
where the same bound, the registers and 512 finer ones rule pairs out; only hopeful pairs leave a cell, from the first band
that the two share. A pair's sets are made from the texts where they are read, and meet once, dealt by pivot. Components come
from written edge tables, contracted until they are stars.

Results in odd cases: NULL or blank text has an empty set, links to nothing and is kept under its own id. Texts with
fewer than five words are one shingle. Repeated rows are copies of each other; all rows with the smallest id are kept.
Rows without an id join a component but never name it; where no row of a component has an id, the component is NULL and
its rows are kept. Further input columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.llm.shared import few, memo, pieces, row_key, stored, unused
from changeflow.operators.few import salted_join

WORDS = 5
#: Pairs of one pivot from which on they are dealt under a salt.
HEAVY = 1 << 14
PERCENT = 75
REGISTER_BITS = 7
REGISTERS = 1 << REGISTER_BITS
MANTISSA_BITS = 10
#: For strays, 512 registers more.
FINE_BITS = 9
BAND = 4
#: A candidate is compared in full unless its estimate is this many standard errors below the threshold.
MARGIN = 5.0
#: Members of a band in one part; two parts are compared at a time.
CELL = 512
#: Pairs of one pivot that are compared in one part.
PART = 1024
#: Sets up to this size are judged by all their shingles when strays are ruled out, larger ones by one in four.
WHOLE = 64
ONE_IN = 4
#: Chance that two large sets without common elements agree in a register, times 2 to the mantissa bits (published).
COLLISION = 0.169919487159739093975315012348
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit mixing step, so that sums of word hashes spread over all bits."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; A-Z are lower-cased, words are cut at white space."""
    known = memo(xxhash.xxh3_64_intdigest)
    parts = []
    for piece in pieces((text or "").encode().lower()):
        found = piece.split()
        parts.append(np.fromiter(map(known.__getitem__, found), np.uint64, len(found)))
    hashes = np.concatenate(parts)
    size = len(hashes)
    if not size:
        return hashes
    width = min(size, WORDS)
    total = np.full(size - width + 1, width, np.uint64)
    for i in range(width):
        total += hashes[i : size - width + 1 + i] * _PLACE[i]
    return np.unique(_mixed(total))


def registers(elements: np.ndarray, bits: int = REGISTER_BITS) -> np.ndarray:
    """Leading-zero count and mantissa of each register's smallest hash; 0 where a register has none."""
    out = np.zeros(1 << bits, np.uint16)
    if len(elements):
        value_bits = 64 - bits
        place = (elements >> np.uint64(value_bits)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        smallest = elements[first] & np.uint64((1 << value_bits) - 1)
        fraction, power = np.frexp(smallest.astype(np.float64))
        mantissa = np.clip((fraction * 2 - 1) * (1 << MANTISSA_BITS), 0, (1 << MANTISSA_BITS) - 1).astype(np.int64)
        out[place[first]] = ((value_bits + 1 - power) << MANTISSA_BITS) + mantissa
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates from rows of registers, corrected for chance agreement, and the registers each rests on."""
    used = ((a > 0) | (b > 0)).sum(axis=1)
    agree = ((a == b) & (a > 0)).sum(axis=1)
    ratio = np.maximum(n_a, n_b) / np.maximum(1, np.minimum(n_a, n_b))
    chance = COLLISION * a.shape[1] * 2.0**-MANTISSA_BITS * 4 * ratio / (1 + ratio) ** 2
    # Small sets leave registers empty, and an empty register cannot agree by chance.
    chance = chance * (used / a.shape[1])
    return np.maximum(0, agree - chance) / np.maximum(1, used), used


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, rows = [], [], []
        for text in batch.column("text"):
            elements = shingle_set(text.as_py())
            counts.append(len(elements))
            digests.append(xxhash.xxh3_128_digest(elements.tobytes()) if len(elements) else None)
            rows.append(registers(elements).tobytes() if len(elements) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("key"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(rows, pa.binary())],
            ["doc_id", "key", "n_shingles", "digest", "registers"])


def _asked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Row and set of each text that has the wanted set."""
    last, elements, digest = object(), None, None
    for row in range(batch.num_rows):
        if (text := batch.column("text")[row].as_py()) != last:
            last, elements = text, shingle_set(text)
            digest = xxhash.xxh3_128_digest(elements.tobytes())
        if digest == batch.column("digest")[row].as_py():
            yield row, elements


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pair (a, b) and its part, with the sorted set of b."""

    def made(batch: pa.RecordBatch, rows: list[int], sets: list[bytes]) -> pa.RecordBatch:
        names = ["a", "b", "part"]
        taken = [batch.column(x).take(pa.array(rows, pa.int64())) for x in names]
        return pa.RecordBatch.from_arrays([*taken, pa.array(sets, pa.binary())], [*names, "elements"])

    for batch in batches:
        rows, sets, held = [], [], 0
        for row, elements in _asked(batch):
            rows.append(row), sets.append(elements.tobytes())
            held += elements.nbytes
            if held >= 1 << 23:
                yield made(batch, rows, sets)
                rows, sets, held = [], [], 0
        yield made(batch, rows, sets)


def _may_link(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    guess, used = estimate(a, b, n_a, n_b)
    used = np.maximum(1, used)
    share = PERCENT / 100
    # Registers sample the union without putting back, so the estimate is the surer the more of the union they hold (published).
    others = np.maximum(1.0, (n_a + n_b) / (1 + share) - 1)
    spread = np.maximum(0.0, (1 + 1 / others) / used - 1 / others)
    # Agreement by chance has a spread of its own, and two registers more allow for sets of a few shingles.
    chance = COLLISION * a.shape[1] * 2.0**-MANTISSA_BITS
    return guess >= share - MARGIN * np.sqrt(share * (1 - share) * spread + chance / used**2) - 2 / used


def _rows(column: pa.Array, bits: int = REGISTER_BITS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, 1 << bits)


def _judging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles by which sets are judged, with their number in the set. Links join sizes up to a third apart, so sets a third above
    WHOLE still show all shingles, for the smaller sets to meet, but are judged (number above 0) by one in four."""
    for batch in batches:
        for row, elements in _asked(batch):
            size, lot = len(elements), elements % ONE_IN == 0
            shown = np.full(size, size) if size <= WHOLE else np.where(lot, lot.sum(), 0)
            if 100 * WHOLE < PERCENT * size:
                elements, shown = elements[lot], shown[lot]
            for start in range(0, len(elements), 1 << 16):
                part = elements[start : start + (1 << 16)].view(np.int64)
                cid = np.full(len(part), batch.column("cid")[row].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cid, shown[start : start + (1 << 16)].astype(np.int64), part)], ["cid", "judged", "shingle"])


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(row, registers(elements, FINE_BITS).tobytes()) for row, elements in _asked(batch)]
        cid = batch.column("cid").take(pa.array([row for row, _ in found], pa.int64()))
        yield pa.RecordBatch.from_arrays([cid, pa.array([fine for _, fine in found], pa.binary())], ["cid", "fine"])


def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            numbers = (batch.column(x).to_numpy() for x in ("n_a", "n_b"))
            keep = _may_link(_rows(batch.column("registers_a")), _rows(batch.column("registers_b")), *numbers)
            yield batch.filter(pa.array(keep)).select(["a", "b"])


def _hopeful_in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hopeful pairs of each cell, for rows sorted by cell. A cell holds two parts of a band's members, or one part twice."""

    def pairs(cell: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(cell).combine_chunks()
        cid, root, part, n, common = (rows[x].to_numpy() for x in ("cid", "root", "part", "n_shingles", "common"))
        mine, fine, place = _rows(rows["registers"]), _rows(rows["fine"], FINE_BITS), rows["place"][0].as_py()
        filled = _filled(mine)
        one = rows["low"][0].as_py() == rows["high"][0].as_py()
        left, right = [], []
        for i in range(len(cid)):
            most = np.minimum(common[i], common)
            at = np.flatnonzero((cid > cid[i]) & (root != root[i]) & (one | (part != part[i])) & (100 * most >= PERCENT * (n[i] + n - most)))
            if place and len(at):
                # Pairs that share an earlier band have met there.
                before = slice(0, place * BAND)
                met = (filled[at, before] == filled[i, before]).reshape(-1, place, BAND).all(axis=2)
                at = at[~met.any(axis=1)]
            for sketch in (mine, fine):
                at = at[_may_link(sketch[i : i + 1], sketch[at], n[i : i + 1], n[at])] if len(at) else at
            left.append(np.full(len(at), cid[i])), right.append(cid[at])
        both = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in both], ["a", "b"])

    last, cell = None, []
    for batch in batches:
        keys = list(zip(*(batch.column(x).to_pylist() for x in ("band", "low", "high")), strict=True))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                if keys[start] != last and cell:
                    yield pairs(cell)
                    cell = []
                last = keys[start]
                cell.append(batch.slice(start, i - start))
                start = i
    if cell:
        yield pairs(cell)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows sorted by pivot and part. Each part begins with the pivot's own set, as the pair of it with itself."""
    pivot, left = None, None
    for batch in batches:
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        keep = np.zeros(batch.num_rows, bool)
        for row in range(batch.num_rows):
            right = np.frombuffer(batch.column("elements")[row].as_buffer(), np.uint64)
            if a[row] == b[row]:
                pivot, left = a[row], right.copy()
                continue
            if a[row] != pivot:
                raise ValueError(f"the set of {a[row]} is missing")
            common = len(np.intersect1d(left, right, assume_unique=True))
            keep[row] = 100 * common >= PERCENT * (len(left) + len(right) - common)
        yield batch.filter(pa.array(keep)).select(["a", "b"])


#: For each register all of them in an order of its own, itself first.
_OTHERS = np.concatenate([np.arange(REGISTERS)[:, None], np.array([
    sorted(set(range(REGISTERS)) - {i}, key=lambda j: (i * 0x9E3779B1 + j * 0x85EBCA77) * 0xC2B2AE3D27D4EB4F % (1 << 64) >> 20) for i in range(REGISTERS)])], axis=1)


def _filled(rows: np.ndarray) -> np.ndarray:
    """Registers in which an empty one repeats the first used one of its own order. Else a band of a small set would rest on a
    single shingle or two, and common shingles would make candidates of sets that have nothing else in common."""
    out = rows.copy()
    for start in range(0, len(rows), 256):
        part = rows[start : start + 256]
        source = np.take_along_axis(_OTHERS[None], (part > 0)[:, _OTHERS].argmax(axis=2)[:, :, None], axis=2)[:, :, 0]
        out[start : start + 256] = np.take_along_axis(part, source, axis=1)
    return out


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place and hash of each band."""
    count = REGISTERS // BAND
    for batch in batches:
        if batch.num_rows:
            joined = np.ascontiguousarray(_filled(_rows(batch.column("registers")))).view(np.uint64).reshape(-1, count)
            hashes = _mixed(joined + np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.asarray(batch.column("cid")), count)), pa.array(np.tile(np.arange(count, dtype=np.int32), batch.num_rows)),
                 pa.array(hashes.view(np.int64).reshape(-1))], ["cid", "place", "band"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b) but the roots; root is the smallest node of a component.

    Every node's neighbours are tied to their smallest one, first the larger neighbours, then the smaller, until the
    edges are stars: no node has two roots, and no root has one. Each round is a written table, so the lineage stays short.
    """
    stars = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct()
    ends = F.array(F.struct(F.col("node").alias("id"), F.lit(1).alias("under")), F.struct(F.col("root").alias("id"), F.lit(0).alias("under")))
    while True:
        stars = stored(stars, "stars")
        seen = stars.select(F.inline(ends)).groupBy("id").agg(F.sum("under").alias("under"), F.count("*").alias("n"))
        if not seen.agg(F.count_if(F.expr("under > 0 and n > 1"))).first()[0]:
            return stars
        both = stars.unionByName(stars.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.least("node", F.min("root")).alias("least"))
        large = both.join(least, "node").where("root > node").select(F.col("root").alias("node"), F.col("least").alias("root")).distinct()
        least = large.groupBy("node").agg(F.min("root").alias("least"))
        small = large.join(least, "node").select(F.explode(F.array(
            F.struct(F.col("node").alias("node"), F.col("least").alias("root")),
            F.struct(F.col("root").alias("node"), F.col("least").alias("root")))).alias("edge")).select("edge.*")
        stars = small.where("node <> root").distinct()


class _Pairs:
    """Compares candidate pairs of classes, once each."""

    def __init__(self, documents: DataFrame, signed: DataFrame, classes: DataFrame):
        self.classes, self.done = classes, None
        # A class is read from the one row that its key names; of rows that repeat both id and text, from one of them.
        self.documents = documents.withColumn("key", row_key())
        many = classes.where("copies > 1").select(F.col("first.key").alias("key"))
        again = signed.where("digest is not null").groupBy("key").count().where("count > 1").select("key")
        again = stored(again.join(few(many), "key", "left_semi"), "again")
        if again.take(1):
            repeated = few(again)
            once = stored(self.documents.join(repeated, "key", "left_semi").dropDuplicates(["key"]), "once")
            self.documents = self.documents.join(repeated, "key", "left_anti").unionByName(once)

    def texts(self, rows: DataFrame, cid: str) -> DataFrame:
        """The rows, each with the text and set digest of the class that `cid` names."""
        known = self.classes.select(F.col("cid").alias(cid), "digest", F.col("first.key").alias("key"))
        wanted = stored(rows.join(known, cid), "wanted")
        return self.documents.join(few(wanted), "key").select(*rows.columns, "digest", "text")

    def links(self, pairs: DataFrame, hopeful: bool = False) -> DataFrame:
        """Of candidate pairs (a, b), those not compared before that link on their full sets. hopeful: already estimated.

        `a` is the side that many pairs have in common. Its pairs are dealt into parts, and its set goes to each of them.
        """
        ends = [F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")]
        pairs = pairs.groupBy(*ends).agg(F.max("a").alias("a"))
        if self.done is not None:
            pairs = pairs.join(self.done.select(*ends), ["low", "high"], "left_anti")
        pairs = stored(pairs.select("a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b")), "pairs")
        if not pairs.take(1):
            return pairs
        self.done = pairs if self.done is None else self.done.unionByName(pairs)
        side = lambda x: self.classes.select(F.col("cid").alias(x), F.col("registers").alias(f"registers_{x}"), F.col("n_shingles").alias(f"n_{x}"))
        if not hopeful:
            both = salted_join(pairs.join(side("b"), "b"), side("a"), ["a"], by="b", heavy=HEAVY).select("a", "b", "registers_a", "registers_b", "n_a", "n_b")
            pairs = stored(both.mapInArrow(_hopeful, "a long, b long"), "hopeful")
        parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
        members = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
        pivots = parts.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        sets = self.texts(members.unionByName(pivots), "b").mapInArrow(_elements, "a long, b long, part int, elements binary")
        dealt = sets.repartition("a", "part").sortWithinPartitions("a", "part", F.col("a") != F.col("b"))
        return stored(dealt.mapInArrow(_linked, "a long, b long"), "links")


def _labelled(rows: DataFrame, stars: DataFrame) -> DataFrame:
    named = stars.select(F.col("node").alias("cid"), "root")
    return rows.join(named, "cid", "left").withColumn("root", F.coalesce("root", "cid"))


def _joined(stars: DataFrame, more: DataFrame) -> DataFrame:
    """The components after more links."""
    return components(stars.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)) if more.take(1) else stars


def _open(shared: DataFrame, stars: DataFrame) -> DataFrame:
    """Members of bands that still hold more than one component, with that component and the band's second pivot."""
    rows = stored(_labelled(shared, stars), "members")
    tops = stored(rows.groupBy("band", "root").agg(F.max("central").alias("top"), F.max("size").alias("size")), "tops")
    first = tops.groupBy("band").agg(F.max_by("root", "top").alias("first"))
    rest = tops.where("size > 2").join(first, "band").where("root <> first")
    several = stored(rest.groupBy("band").agg((-F.max("top")["minus"]).alias("second")), "several")
    return rows.join(several, "band")


def _strays(members: DataFrame, compare: _Pairs) -> DataFrame:
    """Members that may link to another member: those with enough shingles that some other member has as well."""
    ids = stored(members.select("cid").distinct(), "ids")
    shown = compare.texts(ids, "cid").mapInArrow(_judging, "cid long, judged long, shingle long")
    seen = shown.groupBy("shingle").agg(F.count("*").alias("n"), F.min("cid").alias("cid"), F.min("judged").alias("judged"))
    alone = seen.where("n = 1 and judged > 0").groupBy("cid").agg(F.count("*").alias("alone"), F.max("judged").alias("judged"))
    known = compare.classes.join(few(ids), "cid").select("cid", "registers", "n_shingles").join(alone, "cid", "left")
    n, alone = F.col("n_shingles"), F.coalesce("alone", F.lit(0))
    likely = n * (1 - alone / F.col("judged") + MARGIN / 2 / F.sqrt("judged"))
    common = F.when(n <= WHOLE, n - alone).otherwise(F.coalesce(F.least(n, F.ceil(likely)), n))
    known = known.withColumn("common", common).drop("alone", "judged")
    known = stored(known.where(F.col("common") * 100 >= F.col("n_shingles") * PERCENT), "known")
    fine = compare.texts(known.select("cid"), "cid").mapInArrow(_refined, "cid long, fine binary").dropDuplicates(["cid"])
    return members.join(stored(known.join(fine, "cid"), "strays"), "cid")


def _across(strays: DataFrame) -> DataFrame:
    """Hopeful pairs of strays of one band and different components.

    A band's strays are dealt into parts, and every two parts meet in a cell of their own, so that no task has more than a cell at once.
    """
    names = strays.select("band", "root")
    sizes = stored(names.groupBy("band").agg(F.count("*").alias("n"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y"), "sizes")
    parts = F.ceil(F.col("n") / CELL).cast("int")
    rows = strays.join(sizes.select("band", parts.alias("parts")), "band")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "band", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "place", "part", "cid", "root",
        "registers", "fine", "n_shingles", "common")
    return cells.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high").mapInArrow(_hopeful_in_cells, "a long, b long")


def _grouped(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, key (of id and text), n_shingles, component_id and winner, the key that stays of its component.

    winner is NULL where a row is alone in its component.
    """
    documents = documents.select("doc_id", "text")
    id_type = documents.schema["doc_id"].dataType
    schema = f"doc_id {id_type.simpleString()}, key binary, n_shingles long, digest binary, registers binary"
    signed = stored(documents.withColumn("key", row_key()).mapInArrow(_signed, schema), "signed")
    # The first row of a class has its smallest id; rows without an id come last.
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    classes = signed.where("digest is not null").groupBy("digest").agg(
        F.min(first).alias("first"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    bands = classes.select("cid", "registers").mapInArrow(_bands, "cid long, place int, band long")
    sizes = stored(bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    shared = stored(bands.join(sizes, "band"), "shared")
    # The most central member: most company in all its bands, then the smallest cid.
    company = shared.groupBy("cid").agg(F.sum("size").alias("company"))
    central = F.struct("company", (-F.col("cid")).alias("minus")).alias("central")
    shared = stored(shared.join(company, "cid").select("cid", "place", "band", "size", central), "central")
    pivots = stored(shared.groupBy("band").agg(F.max("central").alias("top")).withColumn("pivot", -F.col("top")["minus"]), "pivots")
    shared = stored(shared.join(pivots, "band"), "members")
    compare = _Pairs(documents, signed, classes)
    # First every member with the most central of its bands' pivots, then with those that are in another component still.
    best = shared.where("cid <> pivot").groupBy("cid").agg(F.max("top").alias("top"))
    stars = components(compare.links(best.select((-F.col("top")["minus"]).alias("a"), F.col("cid").alias("b"))))
    apart = _labelled(pivots.select("band", F.col("pivot").alias("cid")), stars).select("band", F.col("root").alias("pivot_root"))
    left = _labelled(shared.where("cid <> pivot").select("band", "cid", "pivot"), stars).join(apart, "band").where("root <> pivot_root")
    stars = _joined(stars, compare.links(left.select(F.col("pivot").alias("a"), F.col("cid").alias("b"))))
    # A second pivot where a band still holds several components, then all that no pivot has joined.
    members = _open(shared, stars)
    more = compare.links(members.where("cid <> second and cid <> pivot").select(F.col("second").alias("a"), F.col("cid").alias("b")))
    stars = _joined(stars, more)
    members = stored(_open(shared, stars).where("cid <> pivot").select("band", "place", "cid", "root"), "rest")
    stars = _joined(stars, compare.links(_across(_strays(members, compare)), hopeful=True))
    # Only classes with copies or links need a name other than the document's own id.
    rooted = _labelled(classes.select("cid", "digest", "first", "copies"), stars)
    named = rooted.groupBy("root").agg(F.min("first").alias("of"), F.count("*").alias("linked"), F.sum("copies").alias("n"))
    groups = stored(named.where("n > 1").select("root", F.col("of.doc_id").alias("component"), F.col("of.key").alias("winner")), "groups")
    named = stored(rooted.join(groups, "root").select("digest", "component", "winner"), "named")
    # Rows without a set get a key of their own, so that they do not all meet in one task.
    key = F.coalesce("digest", F.encode(F.concat(F.lit("none "), F.coalesce(F.col("doc_id").cast("string"), F.uuid())), "utf-8"))
    rows = signed.select("doc_id", "key", "n_shingles", key.alias("digest")).join(named, "digest", "left")
    return rows.select("doc_id", "key", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "winner")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id of its component), kept."""
    return _grouped(documents).select("doc_id", "n_shingles", "component_id").withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def without_near_duplicates(documents: DataFrame) -> DataFrame:
    """The documents that stay: one row of each component, the one with the smallest id, also where no row has an id or ids are shared.

    Rows are judged one by one, by id and text. Rows without words are components of their own; repeats of one that has an id go.
    """
    found = stored(_grouped(documents).select("key", "winner", F.col("doc_id").isNotNull().alias("named")), "verdicts")
    gone = stored(found.where("winner <> key").select("key").distinct(), "gone")
    often = stored(found.where("winner = key or winner is null and named").groupBy("key").count().where("count > 1").select("key"), "often")
    name = unused(documents.columns, "_key")
    keyed = documents.withColumn(name, row_key())
    stay = keyed.join(few(gone.withColumnRenamed("key", name)), name, "left_anti")
    if not often.take(1):
        return stay.select(*documents.columns)
    repeated = few(often.withColumnRenamed("key", name))
    once = stay.join(repeated, name, "left_anti")
    return once.unionByName(stay.join(repeated, name, "left_semi").dropDuplicates([name])).select(*documents.columns)
