"""Vectorised text helpers shared by the text operators."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
_M1, _M2, _G = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> U(30))) * _M1
    h = (h ^ (h >> U(27))) * _M2
    return h ^ (h >> U(31))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points end to end and the offsets of each text (one more than texts)."""
    blob = "".join(texts)
    a = np.frombuffer(blob.encode("utf-32-le", "surrogatepass"), np.uint32)
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    return a, off


def window_hashes(a: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of n symbols in ``a`` (len(a) - n + 1 values)."""
    m = max(0, len(a) - n + 1)
    h = np.zeros(m, U)
    w = a.astype(U)
    for i in range(n):
        h = h * _G + w[i : i + m] + U(1)
    return mix(h)


def squeeze(text: str) -> str:
    """Lower case, white space runs as one blank, ends trimmed."""
    return " ".join(text.lower().split())


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores: a small table in one file would be the work of one
    task.  A table that has enough partitions is left as it is."""
    k = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= k else df.repartition(k)


def as_signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


@dataclass(frozen=True)
class Bits:
    """A bit map over the top bits of 64-bit hashes: what it lets through may be in the set, what it stops is not."""

    words: np.ndarray

    @staticmethod
    def of(rows: DataFrame, column: str, log2: tuple[int, int]) -> "Bits":
        """Of a column of hashes: 16 bits or more a distinct value, between 2 ** log2[0] and 2 ** log2[1] bits in all."""
        n = rows.agg(F.approx_count_distinct(column)).first()[0]
        bits = min(max(int(16 * n).bit_length(), log2[0]), log2[1])
        slot = f"shiftrightunsigned({column}, {64 - bits})"
        words = rows.where(f"{column} is not null").select(F.expr(f"cast(shiftright({slot}, 6) as int)").alias("w"), F.expr(f"shiftleft(1L, cast({slot} % 64 as int))").alias("b"))
        got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # at most 2 ** (bits - 6) rows
        out = np.zeros(1 << (bits - 6), np.int64)
        out[got.w.to_numpy(np.int64)] = got.b.to_numpy(np.int64)
        return Bits(out.view(U))

    def has(self, h: np.ndarray) -> np.ndarray:
        """For hashes as unsigned 64-bit numbers."""
        slot = h >> U(64 - len(self.words).bit_length() - 5)
        return (self.words[(slot >> U(6)).astype(np.int64)] >> (slot & U(63))) & U(1) != 0


def partitions_for(df: DataFrame, each: int = 16 << 20) -> int:
    """Partitions for a table that was written: by its bytes, and at least the session's shuffle partitions and cores."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-size // each))
