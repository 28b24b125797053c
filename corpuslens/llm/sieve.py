"""Filters of bounded size over hashes or ids, for tasks that must not join or shuffle what they read."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.hashing import lean, mix

#: Bits of the largest filter (8 MB).
MOST_BITS = 1 << 26
#: Keys up to which a table of them is sent to every task (16 bytes each).
SENT_KEYS = 1 << 20


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; null for a null one."""
    return F.unhex(F.md5(text.cast("binary")))


def free_name(wanted: str, columns: list[str]) -> str:
    """``wanted``, with underscores until no column has it (in any case)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def without_texts(docs: DataFrame, keys: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns, in order) whose text's key is not in the written table ``keys`` of (key).

    Texts are not shuffled while there are at most ``SENT_KEYS`` keys; beyond, the join is Spark's choice.
    """
    keys = F.broadcast(keys) if keys.count() <= SENT_KEYS else keys
    mine, other = free_name("key", docs.columns), free_name("other", docs.columns)
    keyed = docs.withColumn(mine, text_key(F.col(text_col)))
    return keyed.join(keys.toDF(other), F.col(mine) == F.col(other), "left_anti").drop(mine)


def id_filter(ids: DataFrame, *, bits_each: int = 16, most_bits: int = MOST_BITS) -> Callable[[np.ndarray], np.ndarray]:
    """A Bloom filter of at most ``most_bits`` bits over the column ``id`` (long), as a function of an array of ids.

    The bits are set by a partially aggregated groupBy over 32-bit words of the filter. Beyond its bound the
    filter lets more ids through; what it lets through only costs work.
    """
    n = ids.agg(F.approx_count_distinct("id")).first()[0]
    bits = min(most_bits, 1 << max(10, (n * bits_each).bit_length()))

    def place(x: np.ndarray, k: int) -> np.ndarray:
        """The k-th of three bits of each id."""
        h = mix(x.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        h = h if k == 0 else mix(h) if k == 1 else mix(h) >> np.uint64(32)
        return (h & np.uint64(bits - 1)).astype(np.int64)

    def mark(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in rows:
            at = np.unique(np.concatenate([place(batch.column("id").to_numpy().astype(np.int64), k) for k in range(3)]))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], names=["at", "bit"])

    marked = ids.where("id IS NOT NULL").mapInArrow(mark, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("w")).toArrow()
    table = np.zeros(bits >> 5, np.uint32)
    table[marked.column("at").to_numpy()] = marked.column("w").to_numpy().astype(np.uint32)
    sent = ids.sparkSession.sparkContext.broadcast(table)

    def has(x: np.ndarray) -> np.ndarray:
        """Whether each id may be among them. What the first place rules out is not looked at again."""
        table, found, left = sent.value, np.zeros(len(x), bool), np.arange(len(x))
        for k in range(3):
            at = place(x[left], k)
            left = left[(table[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) == 1]
            if not len(left):
                return found
        found[left] = True
        return found

    return has
