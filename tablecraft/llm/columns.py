"""Column expressions over texts that several operators share."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANK = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kind(df: DataFrame, name: str = "doc_id") -> str:
    """The type of a column, to be named in a schema."""
    return df.schema[name].dataType.simpleString()


def beside(needed: tuple[str, ...], added: tuple[str, ...]) -> Callable:
    """For operators f(docs, ...) that return the columns of `docs` and `added`: f sees all but the `needed` columns under names that no
    operator uses, so columns of any name pass through unchanged. Given columns named like an added one, in any case, are replaced."""

    def decorate(f):
        @functools.wraps(f)
        def wrapped(docs: DataFrame, *args, **kwargs) -> DataFrame:
            given = docs.columns
            spots = {n: given.index(n) if n in given else [c.lower() for c in given].index(n) for n in needed}
            inside = [f"given column {i}" for i in range(len(given))]
            for n, i in spots.items():
                inside[i] = n
            replaced = {a.lower() for a in added}
            kept = [i for i, c in enumerate(given) if c.lower() not in replaced or i in spots.values()]
            aside = docs.toDF(*inside).select(*(f"`{inside[i]}`" for i in kept))
            out = f(aside, *args, **kwargs)
            return out.select(*(F.col(f"`{inside[i]}`").alias(given[i]) for i in kept), *added)

        return wrapped

    return decorate


def whole(text: Column) -> Column:
    """The text, empty where it is missing."""
    return F.coalesce(text, F.lit(""))


def lower_az(text: Column) -> Column:
    """A-Z in lower case, other letters unchanged; pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def blank_words(text: Column) -> Column:
    """Words between blanks, in order, unchanged."""
    return F.array_remove(F.split(F.translate(whole(text), BLANK, " " * len(BLANK)), " "), "")


def plain_words(text: Column) -> Column:
    """Lower-cased words of ASCII letters, digits and any character beyond ASCII."""
    return F.array_remove(F.split(F.regexp_replace(lower_az(whole(text)), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), " "), "")


def hex_sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def wide_hash(*columns: Column) -> list[Column]:
    """Two differently seeded 64-bit hashes: 128 bits together."""
    return [F.xxhash64(F.lit(11), *columns).alias("h1"), F.xxhash64(F.lit(97), *columns).alias("h2")]


def training_row(doc_id: Column, parts: int, held: int) -> Column:
    """True for rows outside the held-out fold, which is crc32 of the id's text modulo `parts` equal to `held`; a missing id trains."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts != held, F.lit(True))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where the body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def grams(words: Column, k: int, value) -> Column:
    """value(slice of k consecutive words) for every position; empty where there are fewer words."""
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: value(F.slice(words, i, k)))).otherwise(F.array().cast("array<bigint>"))
