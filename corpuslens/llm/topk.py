"""Exact top-k inner products by no-random-access aggregation (operator 3).

Vectors are dealt into blocks of bounded size; a block holds, for each dimension, its distinct vectors
sorted by that component. For one query the lists are read from the end that its component's sign makes
best, all to the same depth. What has been read gives each vector a lower bound (unread components at
their list's worst value) and an upper bound (unread components at the value last read). Reading stops
when no vector outside the k best lower bounds can reach them; the few left have their scores resolved.

The rows are dealt into parts of at most about ``HELD`` components, each a task's: it lays out its vectors in
blocks and then answers one query after another, so memory is bounded by a part and a batch of queries. Vectors are
shuffled once, each query once a part, and k rows a query and part go to the merge. Nothing is joined, broadcast or
sent to the driver. Equal vectors
in a block are one entry with their smallest k + 1 distinct ids, each with up to k of its rows: whichever
of them is the query's own, the others fill a result of k. So groups of copies cost nothing.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part, as
queries or as candidates; vectors of different lengths never meet (each length is searched by itself);
ties go to the smaller id; repeated ids are separate rows, as candidates and as queries (each repeated
query row has its own k rows), but a query never returns its own id; fewer than k candidates give all of
them; components and scores that 64 bits cannot hold are computed exactly for the order and returned as the
nearest value they can hold; ids that are no whole numbers are refused (TypeError); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from corpuslens.llm.hashing import bound_batches
from corpuslens.plans.lineage import cut

#: Sums of products up to this size are exact in a double.
EXACT = 1 << 53
#: Components of the vectors that one task holds (28 bytes each, laid out).
HELD = 1 << 22


class SortedLists:
    """The sorted lists of one block. Of the i-th distinct vector, ``ids[i]`` holds the smallest distinct ids and ``rows[i]`` how many rows (``keep`` at most) each has."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, keep: int) -> None:
        self.vectors, inverse = np.unique(vectors, axis=0, return_inverse=True)
        pairs, rows = np.unique(np.stack([inverse.reshape(-1), ids], axis=1), axis=0, return_counts=True)
        of, ids = pairs[:, 0], pairs[:, 1]
        nth = np.arange(len(ids)) - np.searchsorted(of, np.arange(len(self.vectors)))[of]
        self.ids, self.rows = np.zeros((2, len(self.vectors), keep + 1), np.int64)
        on = nth <= keep
        self.ids[of[on], nth[on]], self.rows[of[on], nth[on]] = ids[on], np.minimum(rows[on], keep)
        names, often = np.unique(ids, return_counts=True)
        #: Distinct vectors of each id that has more than one.
        self.several = dict(zip(names[often > 1].tolist(), often[often > 1].tolist(), strict=True))
        self.order = np.argsort(self.vectors, axis=0, kind="stable").T.astype(np.int32)  # dimension x rank
        self.sorted = np.take_along_axis(self.vectors.T, self.order, axis=1)
        self.real = self.vectors.astype(float)
        self.top = max(int(self.vectors.max(initial=0)), -int(self.vectors.min(initial=0)))

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows that don't have the query's own id; ties to the smaller id."""
        # vectors that only the query's own id may have are looked for besides
        left, score = self.search(query, k + self.several.get(query_id, 1))
        at, nth = np.nonzero((self.rows[left] > 0) & (self.ids[left] != query_id))
        each = self.rows[left][at, nth]
        ids, score = np.repeat(self.ids[left][at, nth], each), np.repeat(score[at], each)
        first = np.lexsort((ids, -score))[:k]
        return ids[first], np.clip(score[first], -(1 << 63), (1 << 63) - 1).astype(np.int64)

    def search(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of distinct vectors that may be among the k best, and their exact scores."""
        n, dims = self.vectors.shape
        most = dims * self.top * max(int(query.max(initial=0)), -int(query.min(initial=0)))
        if most >= 1 << 63:  # whole numbers of any size
            return np.arange(n), self.vectors.astype(object) @ query.astype(object)
        if n <= 2 * k:
            return np.arange(n), self.vectors @ query
        if most >= EXACT:
            return np.arange(n), self.vectors @ query
        weight = query.astype(float)
        rising = (query < 0)[:, None]  # read from the small end
        worst = np.where(query < 0, self.sorted[:, -1], self.sorted[:, 0]) * weight
        dim = np.arange(dims)
        unread, known = np.ones(n * dims), np.zeros(n)
        depth, step = 0, max(2 * k, n // 4)
        while True:
            # every list on to the same depth, each time twice as deep
            to = min(n, depth + step)
            step = to
            low, high = slice(depth, to), slice(n - to, n - depth)
            rows = np.where(rising, self.order[:, low], self.order[:, high][:, ::-1])
            add = np.where(rising, self.sorted[:, low], self.sorted[:, high][:, ::-1]) * weight[:, None]
            known += np.bincount(rows.ravel(), weights=add.ravel(), minlength=n)
            depth = to
            if depth == n:  # all is read: the sums are the scores
                left = np.flatnonzero(known >= np.partition(known, n - k)[n - k])
                return left, np.rint(known[left]).astype(np.int64)
            unread[(rows * np.int32(dims) + dim[:, None]).ravel()] = 0
            open_ = unread.reshape(n, dims)
            least, most_ = known + open_ @ worst, known + open_ @ add[:, -1]
            bar = np.partition(least, n - k)[n - k]
            left = np.flatnonzero(most_ >= bar)
            if len(left) <= 4 * k:
                return left, np.rint(self.real[left] @ weight).astype(np.int64)


def _usable(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as long (the nearest one beyond 64 bits), or null if the vector takes no part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & (F.size(vector) > 0)
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(9.2e18)), F.lit(-9.2e18))).cast("long")))


class Part:
    """The vectors that one task holds, in blocks of about ``block`` rows."""

    def __init__(self, block: int, k: int) -> None:
        self.block, self.k, self.waiting, self.lists = block, k, [], []

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.waiting.append((ids.copy(), vectors.copy()))
        if sum(len(x) for x, _ in self.waiting) >= 8 * self.block:
            self.close()

    def close(self) -> None:
        """Lay out what waits, in blocks of one size."""
        if self.waiting:
            ids, vectors = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
            self.waiting, n = [], max(1, round(len(ids) / self.block))
            self.lists += [SortedLists(x, v, self.k) for x, v in zip(np.array_split(ids, n), np.array_split(vectors, n), strict=True)]

    def best(self, ids: np.ndarray, queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the part's k best rows for each query. All queries go to one block after another."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
        for one in self.lists:
            for i, (q, v) in enumerate(zip(ids.tolist(), queries, strict=True)):
                x, score = (np.concatenate(both) for both in zip(found[i], one.best(q, v, self.k), strict=True))
                first = np.lexsort((x, ~score))[: self.k]  # ~: the falling order, and no overflow
                found[i] = x[first], score[first]
        return found


def exact_topk(vectors: DataFrame, queries: Column, *, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 4096, group: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``queries`` holds, its k best other rows."""
    if not isinstance(vectors.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers")
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), _usable(F.col(vector_col), scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where("v IS NOT NULL AND id IS NOT NULL")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    n, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    parts = max(1, min(-(-n // block), 4 * spark.sparkContext.defaultParallelism), -(-n * (dims or 0) // HELD))
    rows = rows.withColumn("dims", F.size("v"))
    # dealt by the row's number, so that copies of a row are spread too
    data = rows.select(F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"), "dims", F.lit(False).alias("asks"), "id", "row", "v")
    # every query goes to every part: rows of a union, as a join would be planned by the queries' size before they are copied
    asks = rows.where("asks").select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "dims", "asks", "id", "row", "v")
    work = data.unionByName(asks).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "dims", "asks")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, Part(block, k)
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("part", "dims", "asks")], axis=1)
            start = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]).any(axis=1)]))
            for lo, hi in zip(start, np.append(start[1:], batch.num_rows), strict=True):
                if last != tuple(at[lo, :2]):
                    last, held = tuple(at[lo, :2]), Part(block, k)
                piece = batch.slice(lo, hi - lo)
                ids, v = piece.column("id").to_numpy(), piece.column("v").flatten().to_numpy().reshape(hi - lo, -1)
                if not at[lo, 2]:
                    held.add(ids, v)
                    continue
                held.close()
                row = piece.column("row").to_numpy()
                for some in (slice(x, x + group) for x in range(0, hi - lo, group)):
                    found = held.best(ids[some], v[some])
                    size = [len(x) for x, _ in found]
                    columns = [np.repeat(ids[some], size), np.repeat(row[some], size), *(np.concatenate(x) for x in zip(*found, strict=True))]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["query_id", "query_row", "vec_id", "score"])

    best = work.mapInArrow(search, "query_id long, query_row long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
