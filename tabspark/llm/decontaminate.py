"""Benchmark decontamination: MinHash containment search, partitioned by size, then exact shingle containment.

An item's MinHash signature is its m shingles of least value under one permutation (a bottom-m sketch), a uniform sample; the
share of it that a document holds estimates the share of the item that it contains. The document's length doesn't matter to
that estimate, unlike to one of Jaccard similarity, so a document's shingles are all looked up. Items are partitioned by size:
each partition has its own signatures and is skipped for documents that are too short to hold enough of any of its items. A
document that contains an item lacks at most e of its shingles, so of a signature of SAMPLE + e values it holds SAMPLE at
least: what holds fewer is no candidate, and no item is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.llm.lean import lean
from tabspark.llm.store import materialize
from tabspark.llm.text import as_bytes, mix, shingle_sets

#: A signature has so many values more than the shingles of its item that a document may lack.
SAMPLE = 64
#: Items and bytes of items that are searched for at once; more are searched for in further blocks.
BLOCK_ITEMS = 50_000
BLOCK_BYTES = 64 << 20
_FILTER_BITS = 22
_SEED = np.uint64(0x2545F4914F6CDD1D)


class SizePartition:
    """Items of sizes low to 2 * low - 1, indexed by the shingles that are a minimum of theirs."""

    def __init__(self, low: int, items: list[tuple[int, np.ndarray]], least: float) -> None:
        self.low, self.items = low, items
        value, item = [], []
        self.needed = np.empty(len(items), np.int64)
        for i, (_, f) in enumerate(items):
            lacking = int((1 - least) * len(f) + 1e-9)
            m = min(len(f), SAMPLE + lacking)
            minima = f[np.argpartition(mix(f ^ _SEED), m - 1)[:m]]
            value.append(minima)
            item.append(np.full(m, i))
            self.needed[i] = m - lacking
        order = np.argsort(v := np.concatenate(value), kind="stable")
        self.item = np.concatenate(item)[order]
        self.value, start = np.unique(v[order], return_index=True)
        self.start = np.append(start, len(v))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.value >> np.uint64(64 - _FILTER_BITS)] = True

    def candidates(self, f: np.ndarray, short: np.ndarray) -> np.ndarray:
        """Numbers of the items whose signature the set f hits often enough; short: the top bits of f."""
        maybe = f[self.filter[short]]
        if not len(maybe):
            return maybe
        at = np.minimum(np.searchsorted(self.value, maybe), len(self.value) - 1)
        at = at[self.value[at] == maybe]
        if not len(at):
            return at
        places = np.concatenate([np.arange(self.start[a], self.start[a + 1]) for a in at])
        found, hits = np.unique(self.item[places], return_counts=True)
        return found[hits >= self.needed[found]]


def build_index(items: list[tuple[int, bytes | None]], k: int, least: float) -> list[SizePartition]:
    by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
    for (item_id, _), f in zip(items, shingle_sets((text for _, text in items), k), strict=True):
        if len(f):
            by_size.setdefault(1 << (len(f).bit_length() - 1), []).append((item_id, f))
    return [SizePartition(low, found, least) for low, found in sorted(by_size.items())]


def search(index: list[SizePartition], f: np.ndarray, least: float) -> Iterator[tuple[int, int, int]]:
    """(item id, its shingles, how many of them are in the sorted set f) for at least `least` of them."""
    short = (f >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)
    for part in index:
        if part.low * least > len(f):
            return
        for i in part.candidates(f, short):
            item_id, g = part.items[i]
            at = np.minimum(np.searchsorted(f, g), len(f) - 1)
            shared = int((f[at] == g).sum())
            if shared >= least * len(g) - 1e-9:
                yield item_id, len(g), shared


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment: documents that hold at least `least` of an item's k-word shingles.

    docs: doc_id, text; benchmark: item_id, text. A text of fewer than k words is one shingle, its whole sequence, so a
    short item is found only as a document of the same words. Null and empty texts hold nothing and are in nothing. Repeated
    rows and items, and null ids, give rows of their own. No items or documents give no rows; extra columns are ignored.

    One pass over the documents for each block of items, without a shuffle. A block's size is bounded, and so is what is
    sent to the executors, whatever the size of the benchmark.
    """
    spark = docs.sparkSession
    items = benchmark.selectExpr("cast(item_id as long) item_id", "text")
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / BLOCK_ITEMS), math.ceil(size / BLOCK_BYTES))
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    out = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast(build_index([(r.item_id, r.text.encode("utf-8", "surrogatepass") if r.text else None) for r in rows], k, least))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                found = []
                for doc_id, f in zip(batch.column(0).to_pylist(), shingle_sets(as_bytes(batch.column(1)), k), strict=True):
                    if len(f):
                        found += [(doc_id, *x) for x in search(index, f, least)]
                cols = zip(*found, strict=True) if found else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "n_item", "n_shared"])

        part = texts.mapInArrow(lean(run), "doc_id long, item_id long, n_item long, n_shared long")
        if blocks > 1:  # one block's index at a time is with the executors
            part = materialize(part, "found")
            shared.unpersist()
        out = part if out is None else out.union(part)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))
