"""WARC archives with revisits, and a two-level index of their captures.

Records are written by Spark's text writer, whose line separator is the blank lines that end a record. Reading takes whole
files of bounded size and cuts them by their content lengths, so nothing inside a payload can be mistaken for a record.

The index holds one line per capture, sorted by reversed-host URL key, in compressed blocks. A sparse directory has the
first key of every block, one directory per part of the sort, and the first key of every part stands above them. A look-up
searches the parts, then the part's directory, unpacks one block and searches its lines, and reads only the record's own bytes.
Look-ups are dealt to where a directory or a block is and follow it in the task, so neither is copied for each of them.
Revisits are resolved in this way: their payload is that of the response they refer to.

Results in odd cases: NULL html is an empty payload. A NULL or empty URL has no target header and an empty key; other URLs are written
as they are, but for control characters and blanks, which become percent codes. Ids may hold any character. Payloads under
`SMALLEST` bytes are never revisits. Rows that repeat the smallest id of a payload are responses as well. A row without an id refers to
the smallest id; where all rows of a payload are without one, all are responses. Further input columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm.shared import stored
from changeflow.session import run_folder

SMALLEST = 100
#: Bytes of a file on average, and at most whatever the order of large pages.
FILE_BYTES, MOST_BYTES = 32 << 20, 1 << 30
#: Pages above this many bytes go to files of their own, so that they do not set how many of the others fit in a file.
LARGE_BYTES = 1 << 20
#: Text that a broadcast may hold.
BROADCAST_BYTES = 32 << 20
#: Captures in a compressed block of the index.
BLOCK = 1000
CRLF = "\r\n"
#: What a record of a page without an id is called, and characters that no header value holds.
NO_ID, UNFIT = "<urn:page-without-id>", r"[\x00-\x20\x7F]"
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture
CAPTURE = "id string, type string, url string, digest string, refers_to string, refers_url string, payload_bytes long, file string, offset long, length long"


def _light(rows: DataFrame) -> DataFrame:
    """Stored rows, marked for broadcast only if their measured text is within the limit."""
    size = F.lit(100)
    for name, kind in rows.dtypes:
        size = size + F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0))
    return F.broadcast(rows) if (rows.agg(F.sum(size.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES else rows


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, html and what becomes of it: payload_bytes, payload_digest, record_type, refers_to, refers_url."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).select(
        "page_id", "url", "html", F.octet_length("html").cast("long").alias("payload_bytes"), F.sha2("html", 256).alias("payload_digest"))
    large = rows.where(F.col("payload_bytes") >= SMALLEST).select("payload_digest", F.struct("page_id", "url").alias("at"))
    # min over structs takes the smallest id; NULL ids come first there, so they are left out.
    first = large.groupBy("payload_digest").agg(F.count("*").alias("n"), F.min(F.when(F.col("at.page_id").isNotNull(), F.col("at"))).alias("first"))
    first = stored(first.where("n > 1 and first is not null").select("payload_digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")), "repeated")
    joined = rows.join(_light(first), "payload_digest", "left")
    again = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return joined.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("refers_to")).alias("refers_to"), F.when(again, F.col("refers_url")).alias("refers_url"))


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise("")


def _uri(page_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(page_id.cast("string")), F.lit(">")), F.lit(NO_ID))


def target(url: Column) -> Column:
    """The URL as a header can hold it; NULL for none. Most URLs are unchanged."""
    coded = F.transform(F.split(url, ""), lambda c: F.when(c.rlike(UNFIT), F.concat(F.lit("%"), F.lpad(F.hex(c), 2, "0"))).otherwise(c))
    return F.when(url != "", F.when(url.rlike(UNFIT), F.array_join(coded, "")).otherwise(url))


def write_archive(plan: DataFrame) -> str:
    """Writes a record per row of `planned` and returns the folder, below spark.checkpoint.dir."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    again = F.col("record_type") == "revisit"
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), _header("WARC-Type", F.col("record_type")), _header("WARC-Record-ID", _uri(F.col("page_id"))), _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Target-URI", target(F.col("url"))), _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(again, F.concat(
            F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}"),
            _header("WARC-Refers-To", _uri(F.col("refers_to"))), _header("WARC-Refers-To-Target-URI", target(F.col("refers_url"))))).otherwise(""),
        F.lit(f"Content-Type: application/http;msgtype=response{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block)
    large = F.col("payload_bytes") > LARGE_BYTES
    sizes = plan.groupBy(large.alias("large")).agg(F.avg("payload_bytes").alias("mean"), F.max("payload_bytes").alias("most")).collect()
    folder = run_folder(plan.sparkSession, "warc")
    for size in sizes or [{"large": False, "mean": 0, "most": 0}]:
        rows = max(1, min(int(FILE_BYTES / (size["mean"] + 500)), int(MOST_BYTES / (size["most"] + 500))))
        part = plan.where(large if size["large"] else ~large).select(record.alias("value"))
        part.write.mode("append").option("lineSep", CRLF * 2).option("maxRecordsPerFile", rows).text(folder)
    return folder


def records(content: memoryview) -> Iterator[tuple[dict[str, str], int, int, int, int]]:
    """Headers of each record, with the start and end of the record and of its payload."""
    at = 0
    while at < len(content):
        end = at
        # Headers are short; they are looked for in growing steps so that no payload is copied.
        step = 2048
        while (end := bytes(content[at : at + step]).find(b"\r\n\r\n")) < 0:
            if at + step >= len(content):
                raise ValueError("a record breaks off")
            step *= 4
        lines = bytes(content[at : at + end]).decode().split(CRLF)
        headers = dict(line.split(": ", 1) for line in lines[1:])
        body = at + end + 4
        stop = body + int(headers["Content-Length"])
        payload = body + bytes(content[body : min(stop, body + 512)]).find(b"\r\n\r\n") + 4
        if not lines[0].startswith("WARC/") or bytes(content[stop : stop + 4]) != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        yield headers, at, stop + 4, payload, stop
        at = stop + 4


def _id(uri: str | None) -> str | None:
    return None if uri is None or uri == NO_ID else unquote(uri[len("<urn:page:") : -1].replace("+", " "))


def _captured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in CAPTURE.split(", ")]
    kinds = [pa.int64() if x.endswith("long") else pa.string() for x in CAPTURE.split(", ")]

    def found(path: str, content: memoryview) -> Iterator[tuple]:
        for headers, start, end, payload, stop in records(content):
            digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
            size = None
            if headers["WARC-Type"] == "response":
                size = stop - payload
                if hashlib.sha256(content[payload:stop]).hexdigest() != digest:
                    raise ValueError("a payload differs from its digest")
            yield (_id(headers["WARC-Record-ID"]), headers["WARC-Type"], headers.get("WARC-Target-URI"), digest, _id(headers.get("WARC-Refers-To")),
                   headers.get("WARC-Refers-To-Target-URI"), size, path, start, end - start)

    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            rows = found(path.as_py(), memoryview(content.as_buffer()))
            while part := list(islice(rows, 4096)):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*part, strict=True), kinds, strict=True)], names)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record of the archive's files, without the payloads, whose digests are checked."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    return files.mapInArrow(_captured, CAPTURE)


def url_key(url: Column) -> Column:
    """The host's labels reversed, then port, path and query: com,example,www)/path?query. Empty for a URL without a host."""
    rest = F.regexp_replace(F.substring_index(F.trim(F.coalesce(url, F.lit(""))), "#", 1), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    place = F.lower(F.substring_index(F.regexp_extract(rest, r"(?s)^[^/?]*", 0), "@", -1))
    path = F.regexp_replace(rest, r"(?s)^[^/?]*", "")
    host, port = F.substring_index(place, ":", 1), F.regexp_extract(place, r"(?s):.+$", 0)
    labels = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.when(host == "", "").otherwise(F.concat(labels, port, F.lit(")"), F.when(path == "", "/").otherwise(path)))


def _line(row: dict) -> str:
    return json.dumps([row["key"], row["id"] or "", row["file"], row["offset"], row["length"]])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed blocks of sorted lines; a block's number rises with its first key."""
    part, number, lines, first = TaskContext.get().partitionId(), 0, [], None

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([first[0]]), pa.array([first[1]]), pa.array([zlib.compress("\n".join(lines).encode())], pa.binary())],
            ["part", "block", "key", "id", "data"])

    for batch in batches:
        for row in batch.to_pylist():
            first = first or (row["key"], row["id"] or "")
            lines.append(_line(row))
            if len(lines) == BLOCK:
                yield packed()
                number, lines, first = number + 1, [], None
    if lines:
        yield packed()


def built_index(captures: DataFrame) -> DataFrame:
    """The index of all captures: part, block, first key and id, compressed lines; stored in the shared folder."""
    lines = captures.select(url_key(F.col("url")).alias("key"), F.coalesce("id", F.lit("")).alias("id"), "file", "offset", "length")
    # Captures of one URL differ in id, so even one URL with a large share of all is cut into several parts.
    return stored(lines.repartitionByRange("key", "id").sortWithinPartitions("key", "id").mapInArrow(_blocks, "part int, block int, key string, id string, data binary"), "index")


def _searched(batches: Iterator[pa.RecordBatch], fields: list[tuple[str, pa.DataType]], found) -> Iterator[pa.RecordBatch]:
    """What `found` gives for the rows of each batch, as rows of the fields."""
    for batch in batches:
        if out := found(batch.to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, (_, kind) in zip(zip(*out, strict=True), fields, strict=True)], [name for name, _ in fields])


def _in_part(first: list[tuple[str, str]], parts: list[int]):
    """The part whose range holds a key and id."""

    def found(rows: list[dict]) -> list[tuple]:
        places = ((bisect_right(first, (row["key"], row["id"])) - 1, row) for row in rows)
        return [(parts[at], row["key"], row["id"]) for at, row in places if at >= 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _searched(batches, [("part", pa.int32()), ("key", pa.string()), ("id", pa.string())], found)

    return run


def _in_directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a part: its directory in order, then its look-ups, which get the block that may hold them."""
    part, firsts, blocks = None, [], []

    def found(rows: list[dict]) -> list[tuple]:
        nonlocal part, firsts, blocks
        out = []
        for row in rows:
            if row["part"] != part:
                part, firsts, blocks = row["part"], [], []
            if row["block"] is not None:
                firsts.append((row["key"], row["id"])), blocks.append(row["block"])
            elif firsts:
                out.append((part, row["key"], row["id"], blocks[max(0, bisect_right(firsts, (row["key"], row["id"])) - 1)]))
        return out

    return _searched(batches, [("part", pa.int32()), ("key", pa.string()), ("id", pa.string()), ("block", pa.int32())], found)


def _in_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block: its lines, unpacked once, then its look-ups."""
    at, lines, firsts = None, [], []

    def found(rows: list[dict]) -> list[tuple]:
        nonlocal at, lines, firsts
        out = []
        for row in rows:
            if row["data"] is not None:
                at = row["part"], row["block"]
                lines = [json.loads(x) for x in zlib.decompress(row["data"]).decode().split("\n")]
                firsts = [(x[0], x[1]) for x in lines]
            elif at == (row["part"], row["block"]):
                i = bisect_right(firsts, (row["key"], row["id"])) - 1
                if i >= 0 and firsts[i] == (row["key"], row["id"]):
                    out.append((row["id"], *lines[i][2:]))
        return out

    return _searched(batches, [("id", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())], found)


def looked_up(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """File, offset and length for each (url, id) in the index."""
    heads = index.where("block = 0").select("key", "id", "part").orderBy("key", "id").collect()  # one row per part of the sort
    find = _in_part([(row["key"], row["id"]) for row in heads], [row["part"] for row in heads])
    keyed = wanted.select(url_key(F.col("url")).alias("key"), "id").mapInArrow(find, "part int, key string, id string")
    directory = index.select("part", "key", "id", "block", F.lit(0).alias("order"))
    asked = directory.unionByName(keyed.select("part", "key", "id", F.lit(None).cast("int").alias("block"), F.lit(1).alias("order")))
    asked = asked.repartition("part").sortWithinPartitions("part", "order", "key", "id")
    placed = asked.mapInArrow(_in_directory, "part int, key string, id string, block int")
    blocks = index.select("part", "block", "key", "id", "data", F.lit(0).alias("order"))
    asked = blocks.unionByName(placed.select("part", "block", "key", "id", F.lit(None).cast("binary").alias("data"), F.lit(1).alias("order")))
    asked = asked.repartition("part", "block").sortWithinPartitions("part", "block", "order")
    return asked.mapInArrow(_in_block, "id string, file string, offset long, length long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Only the bytes of the wanted records, file by file."""
    name, file, system = None, None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["file"] != name:
                name = row["file"]
                place = name if "://" in name else name.replace(":/", ":///", 1)
                system, path = pyarrow.fs.FileSystem.from_uri(quote(place, safe=":/%"))
                file = system.open_input_file(path)
            content = memoryview(file.read_at(row["length"], row["offset"]))
            for _, _, _, payload, stop in records(content):
                out.append((row["id"], stop - payload, hashlib.sha256(content[payload:stop]).hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], ["refers_to", "found_bytes", "found_digest"])


def resolved(captures: DataFrame, index: DataFrame) -> DataFrame:
    """Captures with the payload size and digest that each has in full, for revisits those of the record referred to."""
    again = captures.where("type = 'revisit'")
    wanted = stored(again.select(F.col("refers_url").alias("url"), F.col("refers_to").alias("id")).distinct(), "wanted")
    places = stored(looked_up(index, wanted), "places")
    payloads = stored(places.sortWithinPartitions("file", "offset").mapInArrow(_read, "refers_to string, found_bytes long, found_digest string").dropDuplicates(["refers_to"]), "payloads")
    joined = captures.join(_light(payloads), "refers_to", "left")
    first = F.col("type") == "response"
    return joined.select(
        "id", F.when(first, F.col("payload_bytes")).otherwise(F.col("found_bytes")).alias("payload_bytes"),
        F.when(first, F.col("digest")).otherwise(F.col("found_digest")).alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def archived(pages: DataFrame) -> DataFrame:
    """Writes all pages, indexes the archive and reads it back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    id_type = pages.schema["page_id"].dataType
    folder = write_archive(planned(pages))
    captures = stored(read_archive(pages.sparkSession, folder), "captures")
    rows = resolved(captures, built_index(captures))
    return rows.select(F.col("id").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type).alias("refers_to"))
