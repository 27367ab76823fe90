"""Helpers that several of these operators use: written tables, size-checked joins, words."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.session import run_folder, write_parquet

#: Rows of one or two numbers that a broadcast may hold; beyond it the same join shuffles.
BROADCAST_ROWS = 2_000_000
#: White space that separates words.
SPACES = r"[\x20\x09-\x0D]+"
#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20
#: Words kept in a worker's memory of hashes before it starts anew.
MEMO_WORDS = 150_000


def stored(rows: DataFrame, label: str) -> DataFrame:
    """Rows written to a new folder below spark.checkpoint.dir and read back: computed once, and safe from lost executors."""
    folder = run_folder(rows.sparkSession, label)
    write_parquet(rows, folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of bounded size from now on. By number alone, a batch of whole texts takes tens of
    megabytes in the JVM and again in each worker, once as it comes and once as it goes back."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def few(rows: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Stored narrow rows, marked for broadcast only if their count is within the limit."""
    return F.broadcast(rows) if rows.count() <= limit else rows


def unused(columns: list[str], name: str) -> str:
    """The name, lengthened until no column has it (in any case of letters)."""
    taken = {x.lower() for x in columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A digest of id and text, NULLs included: rows that share it are copies in both."""
    name = F.coalesce(F.concat(F.length(F.col(doc_id).cast("string")), F.lit(" "), F.col(doc_id).cast("string"), F.lit(" ")), F.lit("none "))
    return F.unhex(F.md5(F.concat(name, F.coalesce(F.concat(F.lit("text "), F.col(text)), F.lit("none"))).cast("binary")))


def words(text: Column) -> Column:
    """Words between white space, in order; none for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda word: word != "")


def pieces(data: bytes, size: int = 1 << 20):
    """The bytes cut at white space into pieces of about `size`, so that a very long text never becomes one list of words."""
    start = 0
    while len(data) - start > size:
        end = start + size
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield data[start:end]
        start = end
    yield data[start:]


class Memo(dict):
    """What a function gave for recent keys; starts anew when full, so its size is bounded."""

    def __init__(self, function, limit: int = MEMO_WORDS):
        super().__init__()
        self.function, self.limit = function, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.function(key)
        return value


@functools.cache
def memo(function) -> Memo:
    """One memory per worker and function."""
    return Memo(function)
