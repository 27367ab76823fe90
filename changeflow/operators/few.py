"""Joining many rows to a side with few, when one of the few may match a large share of the many.

The few are written to the shared folder, so that their size is known and not guessed. Up to
BROADCAST_BYTES of text they are broadcast. Above that they are joined by shuffle, and those of keys
that many rows share are copied SALTS times under a salt, so a hot key meets its partner in many
partitions, which adaptive execution splits further where they stay large.

Nothing else written here is broadcast: the planner knows of files only their compressed size, and takes
a million alike rows, or the copies made of them, for a few megabytes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.session import freed_shuffles, run_folder, write_parquet

#: Rows of a key from which on it is likely to be found heavy.
HEAVY = 1_000_000
#: The same where every key was salted before it was looked at.
SPREAD_HEAVY = 100_000
BROADCAST_BYTES = 32 * 1024 * 1024
SALTS = 32
SALT = "_salt"
#: Codec of what is written: ids are hashes in hexadecimal digits, which Spark's own leaves at twice their bytes.
CODEC = "zstd"


def shuffled(rows: DataFrame) -> DataFrame:
    """Rows that are joined by shuffle unless broadcast by name, however few their compressed files seem to hold."""
    return rows.hint("merge")


def store(rows: DataFrame, label: str) -> DataFrame:
    """Rows written to a new shared folder and read back: computed once, and safe from lost executors."""
    folder = run_folder(rows.sparkSession, label)
    write_parquet(rows, folder, codec=CODEC)
    return shuffled(rows.sparkSession.read.schema(rows.schema).parquet(folder))


def text_bytes(rows: DataFrame) -> int:
    with freed_shuffles(rows.sparkSession):
        return rows.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0


def spread_join(
    many: DataFrame, few: DataFrame, on: list[str], by: str, how: str = "inner", limit: int = BROADCAST_BYTES
) -> DataFrame:
    """`many` joined to `few`; `by` is a column of `many` that differs from row to row."""
    stored = store(few, "few")
    if text_bytes(stored) <= limit:
        return many.join(F.broadcast(stored), on, how)
    return salted_join(many, stored, on, by, how, SPREAD_HEAVY)


def salted_join(many: DataFrame, few: DataFrame, on: list[str], by: str, how: str = "inner", heavy: int = HEAVY) -> DataFrame:
    """`many` joined to `few` by a plan that nothing has to run for before: only keys with many rows are copied under a salt.

    One row of `many` in `heavy` is looked at, chosen by the hash of `by`, so the keys found are at most as many and are
    broadcast; a key with ten times `heavy` rows is missed once in twenty thousand runs. Rows without a key meet nothing and
    are dealt out like a heavy one.
    """
    keys = many.where(F.pmod(F.xxhash64(*on, by), F.lit(heavy)) == 0).groupBy(*on).agg(F.lit(True).alias("_heavy"))
    spread = reduce(Column.__or__, (F.col(key).isNull() for key in on), F.coalesce("_heavy", F.lit(False)))
    salt = F.when(spread, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0)
    copies = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = many.join(F.broadcast(keys), on, "left").withColumn(SALT, salt).drop("_heavy")
    copied = few.join(F.broadcast(keys), on, "left").withColumn(SALT, F.explode(copies)).drop("_heavy")
    return salted.join(shuffled(copied), [*on, SALT], how).drop(SALT)
