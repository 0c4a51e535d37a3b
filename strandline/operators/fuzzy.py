"""Digests of bytes that stay near when bytes change little, their distance, and all near pairs.

Every three bytes in a row fall into one of 128 buckets. A digest says of each bucket in which quarter of
the buckets' counts its own lies: a number from 0 to 3, written as so many ones in three planes of bits.
The distance of two digests, the sum of the differences, is then the number of bits that differ.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 128
#: Distances below this are found: of 11 differing bits one quarter of a digest has two at most, which leave
#: three of its five pieces equal.
LIMIT = 12
QUARTERS, PIECES, WHOLE = 4, 5, 3
#: The quarters take bits from all over a digest, as neighbouring buckets and planes say much the same.
STRIDE = 101


@F.pandas_udf(T.ArrayType(T.LongType()))
def digest(content: pd.Series) -> pd.Series:
    """Six numbers of 64 bits; null for less than three bytes."""

    def one(data) -> list[int] | None:
        if data is None or len(data) < 3:
            return None
        b = np.frombuffer(data, np.uint8).astype(np.int64)
        counts = np.bincount((5 * b[:-2] + 37 * b[1:-1] + 101 * b[2:]) % BUCKETS, minlength=BUCKETS)
        edges = np.sort(counts)[[31, 63, 95]]
        return np.packbits(counts[None, :] > edges[:, None], axis=1, bitorder="little").view("<i8").ravel().tolist()

    return content.map(one)


def distance(a: Column, b: Column) -> Column:
    """The sum of the buckets' differences: 0 to 384; null where either digest is."""
    return sum((F.bit_count(F.get(a, k).bitwiseXOR(F.get(b, k))) for k in range(1, 6)), F.bit_count(F.get(a, 0).bitwiseXOR(F.get(b, 0)))).cast("int")


def _key_bits() -> np.ndarray:
    """Bits of each of the 40 keys, 64 each: three pieces of a quarter, then the key's own number. Behind the 384 bits of
    a digest stand a 0 and a 1."""
    keys = []
    for quarter in np.array_split(np.arange(384) * STRIDE % 384, QUARTERS):
        for whole in combinations(np.array_split(quarter, PIECES), WHOLE):
            bits = np.concatenate(whole)
            number = [384 + (len(keys) >> i & 1) for i in range(6)]
            keys.append(np.concatenate([bits, np.full(58 - len(bits), 384), number]))
    return np.array(keys).ravel()


KEY_BITS = _key_bits()


@F.pandas_udf(T.ArrayType(T.LongType()))
def near_keys(digests: pd.Series) -> pd.Series:
    """Forty numbers, of which two digests with a distance below LIMIT have one in common."""
    if not len(digests):
        return pd.Series([], dtype=object)
    own = np.stack(digests.to_numpy()).astype("<i8")
    bits = np.unpackbits(own.view(np.uint8).reshape(len(own), 48), axis=1, bitorder="little")
    bits = np.concatenate([bits, np.zeros((len(own), 1), np.uint8), np.ones((len(own), 1), np.uint8)], axis=1)
    keys = np.ascontiguousarray(np.packbits(bits[:, KEY_BITS], axis=1, bitorder="little")).view("<i8")
    return pd.Series(list(keys))


def near(rows: DataFrame, key: str, most: int = LIMIT - 1) -> tuple[DataFrame, DataFrame]:
    """(pairs, classes): pairs a < b of keys whose digests have a distance of most at most, 11 or less, where a key
    stands for all with its digest; and the class of each key.

    rows: key, digest. Rows of one digest are one class, named by its least key, so that copies are not
    paired. Two digests that are so near have one of forty keys in common, so that no pair is lost; what
    several keys find is one pair.
    """
    if most >= LIMIT:
        raise ValueError(f"keys find distances below {LIMIT}")
    own = rows.where("digest IS NOT NULL").select(F.col(key).alias("key"), "digest")
    heads = own.groupBy("digest").agg(F.min("key").alias("head"))
    classes = own.join(heads, "digest").select("key", "head")
    cut = heads.select("head", "digest", F.explode(near_keys("digest")).alias("value"))
    side = lambda n: cut.select(F.col("head").alias(n), F.col("digest").alias(f"d{n}"), "value")
    pairs = side("a").join(side("b"), "value").where("a < b").withColumn("distance", distance(F.col("da"), F.col("db")))
    return pairs.where(F.col("distance") <= most).select("a", "b", "distance").distinct(), classes
