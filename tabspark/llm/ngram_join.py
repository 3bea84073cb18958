"""Jaccard similarity join of documents on word n-grams with PartEnum signatures.

Sets fall into bands of nearly equal size. Two sets that reach the threshold differ in at most k shingles, k known for each
band. The domain of shingles is partitioned in two levels, n1 x n2; some first-level partition then holds at most k2 of the
differences, so of its n2 parts some subset of n2 - k2 agrees. A set's signatures are the hashes of what it has in each such
subset: similar sets share at least one. All pairs that share one are then verified exactly, or shown to be connected.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabspark.llm.lean import lean
from tabspark.llm.packing import pack, unpack
from tabspark.llm.store import by_keys, drop, materialize
from tabspark.llm.text import as_bytes, mix, set_hash, shingle_sets

#: No text has so many shingles.
LARGEST = 1 << 40
#: From this threshold on bands span an octave and a signature takes two of three parts of a first-level partition; below it
#: sets of one band differ more, so bands are narrower and a signature takes one of two parts.
DENSE = 85
#: Signatures of a block of documents, and bytes of text for each bucket of signatures.
BLOCK = 1_500_000
BUCKET_BYTES = 8 << 20
#: Fewest and most numbers of a set's profile, powers of two; between them a set has two to four shingles a number.
CELLS, MOST_CELLS = 64, 4096
#: In a bucket of more sets, those not yet connected are joined by what sets them apart from its center.
CROWD = 32
_SPREAD, _HALF = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(32)
#: Columns of a set's odd bits, 64 in each.
ODD = ("odd0", "odd1", "odd2", "odd3")
#: Odd factors of the parts in a signature.
_MESSAGE = [("to", pa.int64()), ("kind", pa.int32()), ("block", pa.int64()), ("data", pa.binary())]
#: Kinds of messages: what a block's rows are, and signatures.
ROWS, SIGNATURES = 0, 1
_TIMES = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Band:
    low: int
    high: int
    n1: int = 0
    n2: int = 0
    keep: int = 0  # n2 - k2


def most_apart(a: int, b: int, percent: int) -> int:
    """Most shingles by which similar sets of these sizes differ: |A ^ B| <= (a + b)(1 - t)/(1 + t)."""
    return (a + b) * (100 - percent) // (100 + percent)


def _good(size: int, n1: int, n2: int, keep: int) -> tuple[float, float]:
    """Mean and deviation of the partitions of a set of this size that leave none of their subsets empty, by chance."""
    gone = math.exp(-size / (n1 * n2))
    full = (1 - gone) ** n2 if keep == 1 else 1 - math.comb(n2, keep) * gone**keep
    full = min(1.0, max(0.0, full))
    return n1 * full, math.sqrt(n1 * full * (1 - full))


@cache
def bands(percent: int) -> tuple[Band, ...]:
    """All bands for |A & B| * 100 >= percent * |A | B|. A set's similar ones are in its own band or one beside it.

    A band has first-level partitions enough for the largest sets in it: of d // 2 + 1 partitions one holds at most one of d
    differences. Somewhat more make up for partitions that a set leaves empty by chance.
    """
    out, low = [], 1
    while low < LARGEST:
        if not most_apart(low, low * 100 // percent, percent):
            out.append(Band(low, low))  # only equal sets are similar
            low += 1
            continue
        high = max(low * 100 // percent, 2 * low - 1 if percent >= DENSE else low * 3 // 2)
        differ = most_apart(high, high, percent)
        if differ <= 2:
            out.append(Band(low, high, 1, differ + 2, 2))
        else:
            n2 = 3 if percent >= DENSE else 2
            n1 = base = differ // 2 + 1
            while n1 < 2 * base:
                sizes = (high, max(1, high * percent // 100))
                if all(m - 4 * dev >= most_apart(x, min(high, x * 100 // percent), percent) // 2 + 1 for x in sizes for m, dev in [_good(x, n1, n2, n2 - 1)]):
                    break
                n1 += max(1, n1 // 50)
            out.append(Band(low, high, n1, n2, n2 - 1))
        low = high + 1
    return tuple(out)


@cache
def _lows(percent: int) -> list[int]:
    return [b.low for b in bands(percent)]


def _sums(part: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """64-bit sums of values by part; the halves are summed as doubles, exact for up to 2**21 values."""
    if len(part) >= 1 << 21:
        out = np.zeros(n, np.uint64)
        np.add.at(out, part, value)
        return out
    low = np.bincount(part, weights=value & np.uint64(0xFFFFFFFF), minlength=n).astype(np.uint64)
    return low + (np.bincount(part, weights=value >> np.uint64(32), minlength=n).astype(np.uint64) << np.uint64(32))


def signatures(f: np.ndarray, percent: int) -> np.ndarray:
    """PartEnum signatures of a sorted set of 64-bit shingles, for its own band and the next one that a similar set may be in.

    A set that differs from each similar one in at most d shingles gives the subsets of its first d // 2 + 1 good partitions,
    those none of whose subsets it leaves empty, and of all that lie between. Of two similar sets take the one whose prefix
    ends first: one of its good partitions holds at most one difference, so one of its subsets is the same in both, holds
    something, and lies in the other's prefix too. A set with too few good partitions gives all subsets, the empty ones as
    well: if both are such, an empty one may be all that they share.
    """
    size, found = len(f), []
    if not size:
        return f
    own = bisect_right(_lows(percent), size) - 1
    largest = size * 100 // percent
    for i in (own, own + 1):
        band = bands(percent)[i]
        if i > own and largest < band.low:
            continue
        d = most_apart(size, min(band.high, largest), percent)
        if not band.n1 or not d:
            continue
        seed = mix(np.array([0x9E3779B97F4A7C15 + i], np.uint64))
        parts, subsets = band.n1 * band.n2, [list(x) for x in combinations(range(band.n2), band.keep)]
        part = (((f ^ seed) * _SPREAD >> _HALF) * np.uint64(parts) >> _HALF).astype(np.int64)
        empty = np.bincount(part, minlength=parts).reshape(band.n1, band.n2) == 0
        none = np.stack([empty[:, x].all(1) for x in subsets], 1)
        good = np.cumsum(~none.any(1))
        needed = 1 if band.n1 == 1 else d // 2 + 1
        enough = good[-1] >= needed
        n = int(np.searchsorted(good, needed)) + 1 if enough else band.n1
        held = _sums(part, f, parts).reshape(band.n1, band.n2)[:n]
        sig = np.empty((n, len(subsets)), np.uint64)
        place = np.arange(1, n + 1, dtype=np.uint64) * _SPREAD + seed
        for j, chosen in enumerate(subsets):
            sig[:, j] = place + np.uint64(j)
            for c in chosen:
                sig[:, j] += held[:, c] * np.uint64(_TIMES[c])
        sig = mix(sig)
        found.append(sig[~none[:n]] if enough else sig.ravel())
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _cells(sizes: np.ndarray) -> np.ndarray:
    """How many numbers the profiles of sets of these sizes have: the power of two up to half the size, within bounds."""
    return np.left_shift(1, np.clip(np.frexp(np.maximum(sizes, 1))[1] - 2, CELLS.bit_length() - 1, MOST_CELLS.bit_length() - 1)).astype(np.int64)


def _profile(f: np.ndarray) -> np.ndarray:
    """How many shingles of a sorted set lie in each of equal parts of the domain (255: at least so many)."""
    cells = int(_cells(np.array([len(f)]))[0])
    return np.minimum(np.bincount((f >> np.uint64(65 - cells.bit_length())).astype(np.int64), minlength=cells), 255).astype(np.uint8)


def _least_apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Shingles by which the sets of each row's profiles differ at least; 0 where a number is at its bound.

    Parts of the finer profiles are added up to those of the coarser. Sets differ in no fewer shingles than such sums do.
    """
    full = (p == 255).any(1) | (q == 255).any(1)
    cells = min(p.shape[1], q.shape[1])
    p, q = (x.reshape(len(x), cells, -1).sum(2, dtype=np.int32) for x in (p, q))
    return np.where(full, 0, np.abs(p - q).sum(1))


def sign(docs: DataFrame, k: int, percent: int, buckets: int) -> DataFrame:
    """Messages of blocks of documents: what each row is (ROWS), and to each bucket the block's signatures and whose they are.

    buckets is a power of two. Equal sets of one task give their signatures once.
    """
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, seen = TaskContext.get().partitionId(), 0, set()
        rows, profiles, sigs, size = [], [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal number, size
            block = (task << 24) + number
            doc_id, has_id, n, c, no = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            yield _messages([(-1 - block, ROWS, block, pack(doc_id, has_id.astype(np.int8), n, c, no.astype(np.int32), np.concatenate([*profiles, np.zeros(0, np.uint8)])))])
            all_, whose = np.concatenate([*sigs, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sigs), dtype=np.uint32), [len(x) for x in sigs])
            by = np.argsort(all_)
            all_, whose = all_[by], whose[by]
            ends = np.searchsorted(all_ >> shift if buckets > 1 else np.zeros(len(all_), np.uint64), np.arange(buckets + 1, dtype=np.uint64))
            for i in range(0, buckets, 64):
                out = [(to, SIGNATURES, block, pack(np.diff(all_[ends[to] : ends[to + 1]], prepend=np.uint64(0)), whose[ends[to] : ends[to + 1]])) for to in range(i, min(buckets, i + 64)) if ends[to + 1] > ends[to]]
                if out:
                    yield _messages(out)
            rows.clear(), profiles.clear(), sigs.clear()
            number, size = number + 1, 0

        for batch in batches:
            for doc_id, f in zip(batch.column(0).to_pylist(), shingle_sets(as_bytes(batch.column(1)), k), strict=True):
                c, no = set_hash(f) if len(f) else 0, -1
                if len(f) and doc_id is not None and c not in seen:
                    seen.add(c)
                    no = len(sigs)
                    sigs.append(signatures(f, percent))
                    profiles.append(_profile(f))
                    size += len(sigs[-1])
                rows.append((doc_id or 0, doc_id is not None, len(f), c, no))
                if size >= BLOCK or len(rows) >= BLOCK // 10:
                    yield from close()
        if rows:
            yield from close()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(run), "to long, kind int, block long, data binary")


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _MESSAGE, strict=True)], schema=pa.schema(_MESSAGE))


def meet(messages: DataFrame) -> DataFrame:
    """kind, block, sig, no, data: each signature that several messages to its bucket hold, and whose it is; ROWS as they are."""
    schema = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("sig", pa.int64()), ("no", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, got = None, []

        def close() -> pa.RecordBatch:
            sig, no = (np.concatenate(x) for x in zip(*[(np.cumsum(d, dtype=np.uint64), w) for _, (d, w) in got], strict=True))
            block = np.repeat(np.array([b for b, _ in got]), [len(w) for _, (_, w) in got])
            got.clear()
            by = np.argsort(sig)
            x = sig[by]
            like = x[1:] == x[:-1]
            by = by[np.concatenate([like, [False]]) | np.concatenate([[False], like])]
            n = len(by)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, SIGNATURES, np.int32)), pa.array(block[by]), pa.array(_signed(sig[by])), pa.array(no[by].astype(np.int32)), pa.nulls(n, pa.binary())], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                to, kind, block, data = (batch.column(j)[i].as_py() for j in range(4))
                if kind == ROWS:
                    yield pa.RecordBatch.from_pylist([{"kind": ROWS, "block": block, "data": data}], schema=schema)
                    continue
                if got and to != current:
                    yield close()
                current = to
                got.append((block, unpack(data)))
        if got:
            yield close()

    return messages.repartition("to").sortWithinPartitions("to").mapInArrow(lean(run, None), "kind int, block long, sig long, no int, data binary")


def signed_rows(met: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id (a hash of the set; null without shingles), block, no, profile; a row per row of docs.

    block, no and profile are null but for the row that gave its class's signatures.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class_id", pa.int64()), ("block", pa.int64()), ("no", pa.int32()), ("profile", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_id, has_id, n, c, no, profiles = unpack(data)
                ends = np.concatenate([[0], np.cumsum(_cells(n[no >= 0]))])
                for i in range(0, len(n), 20_000):
                    part = slice(i, i + 20_000)
                    mine = no[part]
                    profile = [profiles[ends[j] : ends[j + 1]].tobytes() if j >= 0 else None for j in mine]
                    blocks = pa.array(np.full(len(mine), block), mask=mine < 0)
                    yield pa.RecordBatch.from_arrays([pa.array(doc_id[part], mask=has_id[part] == 0), pa.array(n[part]), pa.array(c[part], mask=n[part] == 0), blocks, pa.array(mine, mask=mine < 0), pa.array(profile, pa.binary())], schema=schema)

    return met.where(F.col("kind") == ROWS).select("block", "data").mapInArrow(lean(run, None), "doc_id long, n_shingles long, class_id long, block long, no int, profile binary")


def _odd(f: np.ndarray) -> np.ndarray:
    """A bit for each of equal parts of the domain: whether a set has an odd number of shingles there.

    Two sets differ in at least one shingle of each part where their bits do, so in no fewer shingles than bits.
    """
    cells = 64 * len(ODD)
    held = np.bincount((f >> np.uint64(65 - cells.bit_length())).astype(np.int64), minlength=cells)
    return np.packbits((held & 1).astype(np.uint8)).view(np.int64)


def class_sets(docs: DataFrame, k: int) -> DataFrame:
    """class_id, f (the sorted shingles), odd0 to odd3 (see _odd) of the rows of docs; equal sets of one task give one."""
    schema = pa.schema([("class_id", pa.int64()), ("f", pa.list_(pa.int64())), *((x, pa.int64()) for x in ODD)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for i in range(0, len(texts), 256):
                found = [(c, f) for f in shingle_sets(texts[i : i + 256], k) if (c := set_hash(f)) not in seen and not seen.add(c)]
                ends = np.cumsum([0, *(len(f) for _, f in found)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed(np.concatenate([*(f for _, f in found), np.zeros(0, np.uint64)]))))
                odd = np.array([_odd(f) for _, f in found], np.int64).reshape(-1, len(ODD))
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), lists, *(pa.array(x) for x in odd.T)], schema=schema)

    return docs.select("text").mapInArrow(lean(run), f"class_id long, f array<long>, {', '.join(f'{x} long' for x in ODD)}")


def components(edges: DataFrame) -> DataFrame:
    """id, label (the smallest id connected to it) of all ids in edges (a, b): least neighbours, then labels of labels.

    Labels only fall, so repeating until none changes ends with one label for a component. Every round is written to the
    shared folder; minima are taken before the shuffle, so a hub with very many edges is no single task's work.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.id == near.a).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = lower.select(F.col("id").alias("label"), F.col("label").alias("next"))
        after = materialize(lower.join(jump, "label").select("id", "old", F.col("next").alias("label")), "labels")
        labels = after.select("id", "label")
        if after.where("old <> label").isEmpty():
            return labels


def _close(size_a: Column, size_b: Column, percent: int) -> Column:
    """Sizes that similar sets can have."""
    return (size_a * 100 >= size_b * percent) & (size_b * 100 >= size_a * percent)


def _alike(p: str, q: str, percent: int) -> Column:
    """Pairs whose odd bits don't already differ in more than similar sets of their sizes do."""
    bits = sum((F.bit_count(F.col(f"{p}.{x}").bitwiseXOR(F.col(f"{q}.{x}"))) for x in ODD), F.lit(0))
    return bits * (100 + percent) <= (F.col(f"{p}.n_shingles") + F.col(f"{q}.n_shingles")) * (100 - percent)


def _only(sets: DataFrame, of: DataFrame, name: str) -> DataFrame:
    """name, f: those of the sets that a column of another table names, so that a join moves no others."""
    named = materialize(of.select(F.col(name).alias("class_id")).distinct(), "named")
    return by_keys(sets, named, "class_id", "left_semi").select(F.col("class_id").alias(name), "f")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) whose sets reach the threshold. The rows of one set aren't gathered: they meet its shingles in a join."""
    left = pairs.join(_only(sets, pairs, "b").withColumnRenamed("f", "g"), "b")
    both = left.join(_only(sets, pairs, "a"), "a")
    inter = F.size(F.array_intersect("f", "g"))
    return both.where(inter * 100 >= (F.size("f") + F.size("g") - inter) * percent).select("a", "b").distinct()


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) whose profiles don't already differ in more than similar sets of their sizes do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            p, q = (_cells(batch.column(i).to_numpy()) for i in (2, 3))
            near = np.zeros(len(size), bool)
            for kind in np.unique(p * (2 * MOST_CELLS) + q):
                m, n = (int(x) for x in divmod(kind, 2 * MOST_CELLS))
                alike, step = np.flatnonzero((p == m) & (q == n)), max(1, (1 << 22) // max(m, n))
                for i in range(0, len(alike), step):
                    these = alike[i : i + step]
                    u, v = (np.frombuffer(b"".join(batch.column(j).take(pa.array(these)).to_pylist()), np.uint8).reshape(len(these), -1) for j in (4, 5))
                    near[these] = _least_apart(u, v) * (100 + percent) <= size[these] * (100 - percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near))

    side = lambda x: classes.select(F.col("class_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("profile").alias(f"profile_{x}"))
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")
    return both.select("a", "b", "n_a", "n_b", "profile_a", "profile_b").mapInArrow(lean(run, None), "a long, b long")


def _crowd_pairs(many: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets of different labels that may be similar, among those of one center, without comparing all pairs.

    many: center, center_label, class_id, n_shingles, label. With D the shingles in which a set and its center differ, two sets differ in
    what their D don't share, so similar ones share at least t = (|D| + |D'| - k) / 2 of it, where k is how much similar sets
    of such sizes may differ. Then the first |D| - t + 1 shingles of each D, in one order, have one in common. What the center
    lacks comes first in that order: it is rare, so unlike sets seldom meet. A set is far if its D alone exceeds every k that
    it can have; that bounds t from below for it (|D| - k) and for any set that meets it ((|D| + 1) / 2). Pairs of which
    neither is far are few, as nearly all such sets are linked with the center; these are taken as they are, and so are those
    of a set and the center. Shingles that many of a crowd's sets share (a common passage that the center lacks) make unlike
    sets meet all the same; the join leaves out pairs whose odd bits already differ too much (see _odd).
    """
    most = lambda n: F.floor((n + F.floor(n * 100 / percent)) * (100 - percent) / (100 + percent)).cast("int")
    d = many.join(sets, "class_id").join(_only(sets, many, "center").withColumnRenamed("f", "g"), "center")
    d = d.select("center", "class_id", "n_shingles", "label", *ODD, F.concat(F.array_except("f", "g"), F.array_except("g", "f")).alias("d"))
    far = F.size("d") > most(F.col("n_shingles"))
    length = F.when(far, most(F.col("n_shingles")) + 1).otherwise(F.size("d") - F.floor((F.size("d") + 2) / 2) + 1).cast("int")
    d = materialize(d.select("center", "class_id", "n_shingles", "label", *ODD, far.alias("far"), F.slice("d", F.lit(1), length).alias("d")), "apart")
    x = d.select("center", "class_id", "n_shingles", "label", *ODD, "far", F.explode("d").alias("e"))
    met = x.groupBy("center", "e").agg(F.min("label").alias("u"), F.max("label").alias("v")).where("u < v").select("center", "e")
    x = materialize(x.join(met, ["center", "e"]), "met")
    p, q = x.alias("p"), x.alias("q")
    unlike = (F.col("p.center") == F.col("q.center")) & (F.col("p.label") < F.col("q.label")) & _close(F.col("p.n_shingles"), F.col("q.n_shingles"), percent) & _alike("p", "q", percent)
    pair = [F.col("p.class_id").alias("a"), F.col("q.class_id").alias("b")]
    found = p.join(q, unlike & (F.col("p.e") == F.col("q.e")) & (F.col("p.far") | F.col("q.far"))).select(*pair)
    found = found.union(many.where("label <> center_label").select(F.col("center").alias("a"), F.col("class_id").alias("b")))
    near = d.where("not far").drop("d")
    p, q = near.alias("p"), near.alias("q")
    return found.union(p.join(q, unlike).select(*pair))


def similar_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for each row of docs (doc_id, text); k words a shingle.

    Documents link if 100 * |A & B| >= percent * |A | B| for their sets of shingles. component_id is the smallest doc_id that
    links lead to. n_links counts the verified links of the document's class of equal sets to other classes (each document
    of a component is on at least one, or equals one that is); it isn't the number of all similar pairs, as pairs whose
    connection is known already aren't verified.

    Null and empty texts have no shingles and link with nothing; a text of fewer than k words has one shingle. Rows without
    doc_id have a null component and link with nothing. Rows of one doc_id with different texts are one document, which links
    where any of them does; repeated rows link as equals. No documents give no rows; extra columns are ignored.

    Equal sets are one class from the first step on, so copies cost nothing more. Signatures are sent in blocks to where equal
    ones meet, and only those that several sets share go on. Pairs are left out without a look at their sets where their
    profiles already differ too much. In a bucket of sets that share a signature
    all are verified against the one that shares most with the rest of them (a star, not all pairs). Only where a bucket still
    has sets of several components, pairs of different ones are verified: in a small bucket each such pair, in a crowd those
    that share enough of what sets them apart from its center (see _crowd_pairs). So no link can be missed.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    met = materialize(meet(sign(docs, k, percent, 1 << max(0, (size // BUCKET_BYTES).bit_length()))), "met")
    base = materialize(signed_rows(met), "rows")
    given = base.where("no is not null")
    classes = given.groupBy("class_id").agg(F.max("n_shingles").alias("n_shingles"), F.max("profile").alias("profile"), F.min(F.struct("block", "no")).alias("at"))
    classes = materialize(classes, "classes")
    # copies in several blocks are one class, whose signatures are taken from the first of them
    rows = met.where(F.col("kind") == SIGNATURES).join(classes.select("at.block", "at.no", "class_id", F.col("n_shingles").cast("int").alias("n_shingles")), ["block", "no"])
    rows = materialize(rows.select("sig", "class_id", "n_shingles"), "signatures")
    shared = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("width")).where("width > 1")
    buckets = materialize(rows.join(shared, "sig"), "buckets")
    drop(met, rows)

    # the center of a bucket: the set that has the largest buckets on the whole
    fame = materialize(buckets.groupBy("class_id").agg(F.sum("width").alias("fame")), "fame")
    ranked = materialize(buckets.drop("width").join(fame, "class_id"), "ranked")
    center = ranked.groupBy("sig").agg(F.max(F.struct("fame", "class_id", "n_shingles")).alias("c"))
    center = materialize(center.select("sig", F.col("c.class_id").alias("a"), F.col("c.n_shingles").alias("n_a")), "centers")
    stars = ranked.join(center, "sig").where((F.col("class_id") != F.col("a")) & _close(F.col("n_shingles"), F.col("n_a"), percent))
    stars = materialize(stars.select("a", F.col("class_id").alias("b")).distinct(), "stars")
    drop(ranked)

    named = materialize(base.where("class_id is not null and doc_id is not null").groupBy("class_id").agg(F.min("doc_id").alias("doc_id")), "named")

    def sets_of(wanted: DataFrame) -> DataFrame:
        wanted = materialize(wanted.distinct(), "wanted")
        ids = materialize(by_keys(named, wanted, "class_id", "left_semi").select("doc_id").distinct(), "ids")
        texts = by_keys(docs.selectExpr("cast(doc_id as long) doc_id", "text"), ids, "doc_id", "left_semi")
        return materialize(by_keys(class_sets(texts, k), wanted, "class_id", "left_semi"), "sets")

    def of_pairs(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("class_id")).union(pairs.select("b"))

    near = materialize(_possible(stars, classes, percent), "near")
    sets = sets_of(of_pairs(near))
    edges = materialize(_verified(near, sets, percent), "links")
    drop(sets)
    labels = components(edges)

    labelled = buckets.join(labels.withColumnRenamed("id", "class_id"), "class_id", "left")
    labelled = materialize(labelled.select("sig", "class_id", "n_shingles", F.coalesce("label", "class_id").alias("label")), "labelled")
    drop(buckets)
    mixed = labelled.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("sets")).where("x < y").select("sig", "sets")
    open_ = materialize(labelled.join(mixed, "sig"), "open")
    few = open_.where(F.col("sets") <= CROWD)
    p, q = few.alias("p"), few.alias("q")
    apart = (F.col("p.sig") == F.col("q.sig")) & (F.col("p.label") < F.col("q.label")) & _close(F.col("p.n_shingles"), F.col("q.n_shingles"), percent)
    rest = p.join(q, apart).select(F.col("p.class_id").alias("a"), F.col("q.class_id").alias("b"))
    # crowds whose centers are connected are one: its center is the one of most fame among all that these are connected with
    of = labelled.select("class_id", "label").distinct().join(fame, "class_id").groupBy("label").agg(F.max(F.struct("fame", "class_id")).alias("top"))
    of = of.select(F.col("label").alias("center_label"), F.col("top.class_id").alias("center"))
    own = labelled.select(F.col("class_id").alias("a"), F.col("label").alias("center_label")).distinct()
    crowds = open_.where(F.col("sets") > CROWD)
    heads = crowds.select("sig").distinct().join(center.select("sig", "a"), "sig").join(own, "a").join(of, "center_label")
    heads = materialize(heads.select("sig", "center", "center_label"), "heads")  # a row for each crowd
    many = crowds.join(heads, "sig")
    many = many.where("class_id <> center").select("center", "center_label", "class_id", "n_shingles", "label").distinct()
    many = materialize(many, "crowds")
    drop(labelled)
    if not many.isEmpty():
        sets = sets_of(many.select("class_id").union(many.select("center")))
        rest = rest.union(_crowd_pairs(many, sets, percent))
        drop(sets)
    done = stars.union(stars.select("b", "a"))
    rest = materialize(_possible(rest.distinct().join(done, ["a", "b"], "left_anti"), classes, percent), "rest")
    drop(open_)
    if not rest.isEmpty():
        edges = materialize(edges.union(_verified(rest, sets_of(of_pairs(rest)), percent)), "links")
        labels = components(edges)

    links = edges.union(edges.select("b", "a")).distinct().groupBy(F.col("a").alias("class_id")).agg(F.count(F.lit(1)).alias("n_links"))
    known = base.where("class_id is not null and doc_id is not null")
    joined = known.join(labels.withColumnRenamed("id", "class_id"), "class_id", "left").withColumn("label", F.coalesce("label", "class_id"))
    # an id of several texts ties their classes together
    several = known.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("a < b")
    if not several.isEmpty():
        tie = known.join(several, "doc_id").where("class_id <> a").select("a", F.col("class_id").alias("b")).distinct()
        labels = components(edges.union(tie))
        joined = known.join(labels.withColumnRenamed("id", "class_id"), "class_id", "left").withColumn("label", F.coalesce("label", "class_id"))
    smallest = joined.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_class = joined.select("class_id", "label").distinct().join(smallest, "label").select("class_id", "component_id")
    out = base.join(of_class, "class_id", "left").join(links, "class_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
