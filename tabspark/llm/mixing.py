"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabspark.llm.store import BROADCAST_KEYS, materialize
from tabspark.llm.text import n_words

#: Cells for a doubling of the keys, and finer cells that the one that a target cuts is divided into.
COARSE, FINE = 16, 4096


def uniform(id_col: Column, seed: str) -> Column:
    """A number in (0, 1), fixed by id and seed: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: Sequence[float], total: float, most: float) -> DataFrame:
    """source, source_size, target. sizes: source, source_size, one row each.

    Sources by code point, null last, take the weights in turn and share `total` of all sizes. No target is above `most`
    times its source's size; the excess goes to the others by weight until none is above. That ends where every source has
    min(cap, level * weight): with sources in order of cap / weight, the first whose level fits under its cap sets it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", pick).withColumn("cap", F.col("source_size") * float(most))
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_first())
    before, onward = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * float(total) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumn("place", F.row_number().over(up)).withColumn("level", left / F.sum("weight").over(onward))
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))).over(everything)
    s = s.withColumn("level", first["level"])
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), "cap")).alias("target"))


def _cut(rows: DataFrame, sources: DataFrame, cell: str, tag: str) -> DataFrame:
    """sources with the cell of rows that its `rest` ends in, and the words `ahead` of it. A source has few cells."""
    sums = materialize(rows.groupBy("source", cell).agg(F.sum("size").alias("words")), tag)
    up = Window.partitionBy("source").orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("words").over(up))
    both = sums.alias("a").join(sources.drop("ahead").alias("s"), F.expr("a.source <=> s.of"))
    start = F.col("s.start") if "start" in sources.columns else F.lit(0.0)
    found = both.where((F.col("words") > 0) & (start + F.col("upto") >= F.col("rest")) & (F.col("rest") > 0))
    first = found.groupBy("s.of").agg(F.min(F.struct(F.col(f"a.{cell}").alias("at"), (start + F.col("upto") - F.col("words")).alias("ahead"))).alias("cut"))
    kept = [f"s.{c}" for c in sources.columns if c not in ("start", "ahead")]
    out = sources.alias("s").join(first.alias("c"), F.expr("s.of <=> c.of"), "left")
    return materialize(out.select(*kept, F.col("c.cut.at").alias(f"cut_{cell}"), F.col("c.cut.ahead").alias("start")), f"{tag}-cut")


def mix(
    docs: DataFrame,
    quality: Column,
    weights: Sequence[float] = (5, 2, 1),
    total: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    carry: bool = False,
) -> DataFrame:
    """Mixes whole documents: doc_id, source, size, source_size, target, taken; one row per row of docs. With `carry` all
    columns of docs, then size, source_size, target and taken, which replace columns of these names.

    Each source repeats all its documents for floor(target / source_size) complete epochs; what its target has left is
    filled with documents in rising order of -log(u) / quality (which is the falling order of u ** (1 / quality), the keys of
    Efraimidis and Spirakis, but never underflows), up to the document that would overshoot by more than half its size.
    `quality` is a positive weight over doc_id, source, text and size; null or not positive counts as the smallest weight.
    u is fixed by doc_id, or by the text where that is null. Size is the words of the text; a null text has none. A null
    source is a source. Ties and repeated rows go by doc_id and size; no documents give no rows; other columns are ignored
    or carried. The same rows always give the same result.

    Keys fall into cells of their logarithms, whatever the scale of the weights. Word counts of cells are summed before the
    shuffle; the cell that a target cuts is divided once more, and only that part, some millionths of a source, is sorted.
    So no source, however large, goes to one task. Of texts nothing is shuffled but those of that part.
    """
    weight = F.when(quality > 0, quality).otherwise(F.lit(1e-6))
    u = uniform(F.coalesce(F.col("doc_id").cast("string"), F.col("text")), seed)

    def keyed(rows: DataFrame) -> DataFrame:
        sized = rows.withColumn("size", n_words(F.col("text"))).withColumn("key", -F.log(u) / weight)
        place = F.log2("key") * COARSE
        return sized.withColumn("coarse", F.floor(place)).withColumn("fine", F.floor((place - F.floor(place)) * FINE))

    sized = materialize(keyed(docs.select("doc_id", "source", "text")).drop("text"), "sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total, most)
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    sources = sources.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "of")
    sources = materialize(sources, "targets")
    few = sources.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS // 8
    side = lambda x: F.broadcast(x) if few else x

    sources = _cut(sized, sources, "coarse", "coarse")
    cut = sized.join(side(sources.select("of", "cut_coarse")), F.expr("source <=> of and coarse = cut_coarse")).drop("of", "cut_coarse")
    sources = _cut(cut, sources, "fine", "fine")

    rows = sized
    if carry:
        names = ("size", "source_size", "target", "taken")
        own = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns if c not in names]).alias("own")
        rows = keyed(docs.select("doc_id", "source", "text", own)).drop("text")
    joined = rows.join(side(sources), F.expr("source <=> of"))
    inside = F.expr("rest > 0 and coarse <=> cut_coarse and fine <=> cut_fine")
    before = F.expr("rest > 0 and (cut_coarse is null or coarse < cut_coarse or (coarse = cut_coarse and (cut_fine is null or fine < cut_fine)))")
    by_key = Window.partitionBy("of").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    sorted_ = joined.where(inside).withColumn("whole", F.col("start") + F.coalesce(F.sum("size").over(by_key), F.lit(0)) + F.col("size") / 2 < F.col("rest"))
    both = joined.where(~inside).withColumn("whole", before).unionByName(sorted_)
    kept = ["own.*"] if carry else ["doc_id", "source"]
    return both.select(*kept, "size", "source_size", "target", (F.col("size") * (F.col("epochs") + F.col("whole").cast("long"))).alias("taken"))
