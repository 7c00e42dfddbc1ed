"""Small helpers that several operators share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"
#: Runs of letters and numerals that are no digits, such as a half or a Roman eight, and runs of letters alone, which take
#: twice the time to find; all those numerals lie below U+20000.
WORDLIKE = re.compile(r"[^\W\d_]+")
LETTERS = re.compile("[^\\W\\d_" + "".join(c for c in map(chr, range(0x20000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal()) + "]+")


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What a Python worker remembers between tasks, by its owner; only one owner at a time.
_HELD: dict[str, object] = {}


def held(owner: str, make: Callable[[], object]):
    """The memory of ``owner`` in this Python worker. Another owner's is dropped first, so memories don't add up."""
    if owner not in _HELD:
        _HELD.clear()
        _HELD[owner] = make()
    return _HELD[owner]


def letter_runs(text: str) -> tuple[list[str], re.Pattern]:
    """All runs of letters of a text, and the pattern that finds them."""
    words = WORDLIKE.findall(text)
    if not words or "".join(words).isalpha():
        return words, WORDLIKE
    return LETTERS.findall(text), LETTERS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null keys give null."""
    return F.crc32(key.cast("string").cast("binary")) % n
