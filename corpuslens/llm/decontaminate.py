"""Benchmark decontamination by spaced-seed hashing (operator 9).

A seed is a fixed mask over consecutive words that looks at some of them and ignores the others, so a hash
of the words looked at survives substitutions at the ignored places. ``MASKS`` together catch every
window of ``WINDOW`` words with up to two substitutions (shown by enumeration in the tests). A shorter item
is verified as a whole, and ``item_masks`` adds a mask of its length for each permitted pattern of
substitutions that no other mask survives.

Benchmark items become a table of seeds. One pass over the training texts hashes every position and keeps
those that a filter of bounded size, made from the benchmark's seeds, lets through: a segment of words around
them, and their hashes. These are joined with the seeds by hash. Each pair that meets lays the item along the
segment, and the overlap is verified: some aligned window of ``WINDOW`` words (the whole item if it is
shorter) must agree in at least ``similarity`` of its words. Texts are not shuffled, and a benchmark of any
size is one join.

Of a text's seeds with equal hash and equal ``REACH`` words on both sides one stands for all, on either side of
the join: a word repeated thousands of times is a handful of seeds, so periodic texts cost no product.

Defined results: null and empty texts and items match nothing; an item too short for a substitution
(under five words at 0.8) is matched word by word; repeated items and documents each give their rows; empty tables give
an empty result; only A-Z is lower-cased; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.hashing import bound_batches, lean, mix, small_batches, words
from corpuslens.llm.sieve import id_filter, text_key, without_texts
from corpuslens.plans.lineage import written

WINDOW = 13
#: Words on each side of a seed's first word that a window around it can reach.
REACH = WINDOW - 1
#: 1: a word looked at; 0: a word that may differ.
MASKS = ("11111", "110111", "1100111")
#: Bits of the filter over the benchmark's seeds (32 MB at most).
FILTER_BITS = 1 << 28


def seed_hashes(hashes: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the words looked at, for each place of the mask in the text."""
    n = len(hashes) - len(mask) + 1
    out = np.full(max(n, 0), int(mask, 2), np.uint64)
    if n > 0:
        for k in np.flatnonzero(np.frombuffer(mask.encode(), np.uint8) == ord("1")):
            out = mix(out + hashes[k : n + k] * np.uint64(2 * int(k) + 3))
    return out


def survives(mask: str, gone: tuple[int, ...], length: int) -> bool:
    """Whether the mask has a place in an item of ``length`` words where it looks at none of the words ``gone``."""
    return any(all(m == "0" or i + k not in gone for k, m in enumerate(mask)) for i in range(length - len(mask) + 1))


@functools.cache
def item_masks(length: int, similarity: float) -> tuple[str, ...]:
    """Masks of an item's own length for the permitted substitutions that ``MASKS`` don't survive."""
    if length >= WINDOW or not length:
        return ()
    most = max(s for s in range(length) if s == 0 or length - s >= similarity * length)
    found: list[str] = []
    for gone in itertools.combinations(range(length), most):
        if not any(survives(mask, gone, length) for mask in (*MASKS, *found)):
            found.append("".join("0" if k in gone else "1" for k in range(length)))
    return tuple(found)


class Seeds:
    """The seeds of the texts whose words follow each other in ``hashes``; text k has those from ``firsts[k]`` on.

    ``hash``, ``at`` (place of the first word) and ``of`` (text) of one seed for each kind of surroundings, in order of place.
    """

    def __init__(self, hashes: np.ndarray, firsts: np.ndarray, masks: tuple[str, ...], passes: Callable[[np.ndarray], np.ndarray] | None = None) -> None:
        text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for mask in masks:
            h = seed_hashes(hashes, mask)
            inside = text[: len(h)] == text[len(mask) - 1 : len(mask) - 1 + len(h)]
            here = np.flatnonzero(inside if passes is None else inside & passes(h))
            at.append(here)
            found.append(h[here])
        self.at, self.hash = np.concatenate(at), np.concatenate(found)
        self.of = text[self.at]
        low, high = firsts[self.of], firsts[self.of + 1]
        around = self.hash.copy()
        for k in range(-REACH, REACH + 1):
            there = self.at + k
            on = (there >= low) & (there < high)
            around = mix(around + np.where(on, hashes[np.clip(there, 0, max(len(hashes) - 1, 0))], 0) * np.uint64(2 * (k + REACH) + 3)) if len(around) else around
        order = np.lexsort((self.at, around, self.of))
        same = np.concatenate([[False], (around[order][1:] == around[order][:-1]) & (self.of[order][1:] == self.of[order][:-1])]) if len(order) else np.zeros(0, bool)
        order = order[~same]
        order = order[np.lexsort((self.at[order], self.of[order]))]
        self.at, self.hash, self.of = self.at[order], self.hash[order], self.of[order]
        self.low = np.maximum(self.at - REACH, firsts[self.of])
        self.high = np.minimum(self.at + WINDOW, firsts[self.of + 1])

    def segments(self) -> np.ndarray:
        """Index of the first seed of each segment: seeds whose reach is connected share one."""
        if not len(self.at):
            return np.zeros(0, np.int64)
        return np.flatnonzero(np.concatenate([[True], (self.low[1:] > self.high[:-1]) | (self.of[1:] != self.of[:-1])]))


def overlap(item: np.ndarray, segment: np.ndarray, shift: int, similarity: float) -> tuple[int, int, int] | None:
    """(first word of the segment, words compared, words equal) of the item laid along the segment, if a window agrees enough."""
    lo, hi = max(0, -shift), min(len(item), len(segment) - shift)
    width = min(WINDOW, len(item))
    if hi - lo < width:
        return None
    same = np.concatenate([[0], np.cumsum(item[lo:hi] == segment[lo + shift : hi + shift])])
    if (same[width:] - same[:-width]).max() < similarity * width:
        return None
    return lo + shift, hi - lo, int(same[-1])


def _number() -> int:
    """A number that only this task gives, to count rows from."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 36


def benchmark_seeds(benchmark: DataFrame, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """A row an item: (item, row, words, hashes, places): its id, a number, its words, and its seeds."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        row = _number()
        for batch in (b for whole in rows for b in small_batches(whole)):
            hashes, _, _, firsts, _ = words(batch.column("text").cast(pa.binary()).to_pylist())
            numbers, out = [], []
            for lo, hi in zip(firsts[:-1], firsts[1:], strict=True):
                mine = hashes[lo:hi]
                seeds = Seeds(mine, np.array([0, len(mine)]), tuple(dict.fromkeys((*MASKS, *item_masks(len(mine), similarity)))))
                out.append((mine.tobytes(), seeds.hash.view(np.int64), seeds.at))
                numbers.append(row)
                row += 1
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(numbers, pa.int64()), pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.list_(pa.int64())), pa.array(columns[2], pa.list_(pa.int64()))], names=["item", "row", "words", "hashes", "places"])

    kind = benchmark.schema[id_col].dataType.simpleString()
    items = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    return items.mapInArrow(batches, f"item {kind}, row long, words binary, hashes array<long>, places array<long>")


def text_segments(texts: DataFrame, passes: Callable[[np.ndarray], np.ndarray], masks: tuple[str, ...]) -> DataFrame:
    """A row a segment: (key, id, doc, segment, start, words, hashes, places) from rows of (key, id, text); places count from the segment's start."""
    names = ["key", "id", "doc", "segment", "start", "words", "hashes", "places"]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        doc = segment = _number()
        for batch in (b for whole in rows for b in small_batches(whole)):
            hashes, _, _, firsts, _ = words(batch.column("text").cast(pa.binary()).to_pylist())
            seeds = Seeds(hashes, firsts, masks, passes)
            first = seeds.segments()
            if len(first):
                last = np.append(first[1:], len(seeds.at)) - 1
                of, low = seeds.of[first], seeds.low[first]
                size = last - first + 1
                at = seeds.at - np.repeat(low, size)
                spans = [hashes[a:b].tobytes() for a, b in zip(low, seeds.high[last], strict=True)]
                offsets = pa.array(np.append(first, len(at)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (seeds.hash.view(np.int64), at)]
                row = pa.array(of)
                numbers = [pa.array(doc + of), pa.array(segment + np.arange(len(first))), pa.array(low - firsts[of])]
                yield pa.RecordBatch.from_arrays([batch.column("key").take(row), batch.column("id").take(row), *numbers, pa.array(spans, pa.binary()), *lists], names=names)
            doc += batch.num_rows
            segment += len(first)

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(batches, f"key binary, id {kind}, doc long, segment long, start long, words binary, hashes array<long>, places array<long>")


def _overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str | None, text_col: str, item_col: str, item_text_col: str, similarity: float) -> DataFrame:
    """(key, id, doc, item, row, start, compared, equal) of every verified alignment of a segment and an item."""
    spark = docs.sparkSession
    bound_batches(spark)
    items = written(benchmark_seeds(benchmark, similarity, item_col, item_text_col), "items")
    seeds = items.select("row", F.explode(F.arrays_zip("hashes", "places")).alias("s")).select("row", F.col("s.hashes").alias("hash"), F.col("s.places").alias("place"))
    passes = id_filter(seeds.select(F.col("hash").alias("id")), bits_each=64, most_bits=FILTER_BITS)
    # at most one row for each length below the window's
    short = [r.n for r in items.select((F.octet_length("words") / 8).cast("int").alias("n")).where(f"n < {WINDOW}").distinct().collect()]
    masks = tuple(dict.fromkeys([*MASKS, *(m for n in sorted(short) for m in item_masks(n, similarity))]))
    given = F.lit(None).cast("long") if id_col is None else F.col(id_col)
    texts = docs.where(F.col(text_col).isNotNull()).select(text_key(F.col(text_col)).alias("key"), given.alias("id"), F.col(text_col).alias("text"))
    found = written(text_segments(texts, passes, masks), "segments")

    hits = found.select("segment", F.explode(F.arrays_zip("hashes", "places")).alias("s")).select("segment", F.col("s.hashes").alias("h"), F.col("s.places").alias("at"))
    shifts = hits.join(seeds, F.col("h") == F.col("hash")).select("segment", "row", (F.col("at") - F.col("place")).alias("shift")).distinct()
    laid = shifts.join(items.select("row", "item", F.col("words").alias("x")), "row").join(found.select("segment", "key", "id", "doc", "start", "words"), "segment")
    kinds = {c: laid.schema[c].dataType.simpleString() for c in ("id", "item")}

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            item, segment = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("x", "words"))
            got = [overlap(a, b, s, similarity) for a, b, s in zip(item, segment, batch.column("shift").to_pylist(), strict=True)]
            row = pa.array([k for k, g in enumerate(got) if g], pa.int64())
            out = [batch.column(c).take(row) for c in ("key", "id", "doc", "item", "row")]
            starts = batch.column("start").take(row).to_numpy()
            numbers = np.array([g for g in got if g], np.int64).reshape(-1, 3)
            numbers[:, 0] += starts
            yield pa.RecordBatch.from_arrays([*out, *(pa.array(numbers[:, k]) for k in range(3))], names=["key", "id", "doc", "item", "row", "start", "compared", "equal"])

    return laid.mapInArrow(verify, f"key binary, id {kinds['id']}, doc long, item {kinds['item']}, row long, start long, compared long, equal long")


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """(doc_id, item_id, start, compared, equal): every pair of a document and a benchmark item with a verified overlap, with its best alignment.

    ``start`` is the first word compared; ``compared`` words around the seeds were laid along the item and ``equal`` of them agree.
    """
    laid = _overlaps(docs, benchmark, id_col, text_col, item_col, item_text_col, similarity)
    best = F.max_by(F.struct("id", "item", "start", "compared", "equal"), F.struct("equal", -F.col("start"), "compared"))
    pairs = laid.groupBy("doc", "row").agg(best.alias("b"))
    return pairs.select(F.col("b.id").alias(id_col), F.col("b.item").alias(item_col), "b.start", "b.compared", "b.equal")


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text has no verified overlap. Equal texts are judged alike, so a text's digest is the key."""
    bad = written(_overlaps(docs, benchmark, None, text_col, item_col, item_text_col, similarity).select("key").distinct(), "contaminated")
    return without_texts(docs, bad, text_col=text_col)
