"""Order MinHash fingerprints, with DataFrame functions only.

The elements of a text are its word pairs, each numbered by how often it came before. A hash deals the elements to 32 bins;
from each bin the two elements of smallest hash stay, in the order of the text, and the hash of that ordered pair is the
bin's part of the fingerprint. So a part agrees only if content and order agree, which follows edit distance. (Bins of one
hash stand for independent permutations, as in one-permutation MinHash.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabspark.llm.store import materialize

#: Texts of fewer words are cut into characters instead.
FEW_WORDS = 8
BIN_BITS = 5
_POSITION = 20  # low bits of an element: where in the text it is; above them 43 bits of hash
_PLACE = (1 << _POSITION) - 1
_BIN = 63 - BIN_BITS


def _pack(hash_: Column, place: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(hash_, 64 - (63 - _POSITION)), _POSITION).bitwiseOR(place)


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, _BIN)


def _rank(x: Column) -> Column:
    return F.shiftrightunsigned(x, _POSITION)


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_PLACE).cast("long"))


def with_signature(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`, an array of longs bin * 2**32 + hash, one for each bin that has elements.

    Each step is a column of its own, used more than once by the next, so that it is worked out once a row. Elements are
    longs, so that both sorts are of plain arrays.
    """
    t, e = f"{out}_t", f"{out}_e"
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    df = df.withColumn(t, words)
    letters = F.filter(F.split(F.col(text), ""), lambda x: x != "")
    df = df.withColumn(t, F.when(F.size(t) < FEW_WORDS, letters).otherwise(F.col(t)))
    pair = lambda x, i: _pack(F.xxhash64(x, F.get(t, i + 1)), F.least(i, F.lit(_PLACE)).cast("long"))
    df = df.withColumn(e, F.sort_array(F.transform(t, pair)))

    def occurrence(x: Column, i: Column) -> Column:
        # equal pairs stand side by side: steps back by falling powers of two find how many come before
        same = lambda back: _rank(F.get(e, i - back)) == _rank(x)
        powers = F.array(*[F.lit(1 << b) for b in range(23, -1, -1)])
        return F.when(same(F.lit(1)), F.aggregate(powers, F.lit(0), lambda o, b: F.when(same(o + b), o + b).otherwise(o))).otherwise(F.lit(0))

    df = df.withColumn(t, F.sort_array(F.transform(e, lambda x, i: _pack(F.xxhash64(_rank(x), occurrence(x, i)), _place(x)))))
    df = df.withColumn(e, F.filter(t, lambda x, i: (i < 2) | (_bin(F.get(t, i - 2)) != _bin(x))))

    def part(x: Column, i: Column) -> Column:
        other = F.get(e, i - 1)
        two = F.when(_place(other) <= _place(x), F.xxhash64(_rank(other), _rank(x))).otherwise(F.xxhash64(_rank(x), _rank(other)))
        both = F.when(_bin(other) == _bin(x), two).otherwise(F.xxhash64(_rank(x)))
        last = F.coalesce(_bin(F.get(e, i + 1)) != _bin(x), F.lit(True))
        return F.when(last, F.shiftleft(_bin(x), 32).bitwiseOR(both.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))))

    return df.withColumn(out, F.filter(F.transform(e, part), lambda x: x.isNotNull())).drop(t, e)


def as_string(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the bins with elements in either that agree; 1 if neither has any."""
    bins = lambda x: F.transform(x, lambda y: F.shiftright(y, 32))
    union = F.size(F.array_union(bins(a), bins(b)))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def next_ids(ids: DataFrame) -> DataFrame:
    """Adds next_id, the following doc_id (after the last: the first), to a table of distinct doc_ids, by ranges of ids."""
    ranged = materialize(ids.repartitionByRange("doc_id").withColumn("range", F.spark_partition_id()), "ranges")
    firsts = ranged.groupBy("range").agg(F.min("doc_id").alias("first"))
    along = Window.orderBy("range")  # a row for each range
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("range", F.coalesce(F.lead("first").over(along), F.first("first").over(whole)).alias("after"))
    within = Window.partitionBy("range").orderBy("doc_id")
    out = ranged.join(firsts, "range").withColumn("next_id", F.coalesce(F.lead("doc_id").over(within), "after"))
    return materialize(out.drop("range", "after"), "next")


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and `signature` of each row's whole text. Null is the empty text, whose signature is empty."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return with_signature(rows, "text", "signature").select("doc_id", "signature")


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprints each text and its edited text, whose last quarter is replaced by the beginning of the next document's.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; a row per row of docs.
    A null text is empty. The next document is that of the next doc_id (after the last: the first); where an id is repeated,
    its smallest text, and for near_next its smallest signature. A row without doc_id has no next document: nothing replaces
    its last quarter, and near_next is null. No documents give no rows; extra columns are ignored.
    """
    every = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows, no_id = every.where("doc_id is not null"), every.where("doc_id is null")
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    ids = next_ids(rows.select("doc_id", quarter.alias("q")).groupBy("doc_id").agg(F.max("q").alias("q")))
    # both joins take the same exchange of the texts by doc_id, which is made once
    heads = rows.join(ids.select(F.col("doc_id").alias("before"), "q", F.col("next_id").alias("doc_id")), "doc_id")
    heads = heads.select(F.col("before").alias("doc_id"), F.expr("substring(text, 1, q)").alias("head")).groupBy("doc_id").agg(F.min("head").alias("head"))
    both = rows.join(heads, "doc_id", "left").unionByName(no_id.withColumn("head", F.lit(None).cast("string")))
    both = both.select("doc_id", "text", F.char_length("text").cast("long").alias("n_chars"), quarter.alias("q"), F.coalesce("head", F.lit("")).alias("head"))
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars as int) - q)"), F.expr("substring(head, 1, q)")))
    both = both.select("doc_id", "n_chars", "text", "edited", F.sha2("edited", 256).alias("edited_sha256"))
    signed = with_signature(with_signature(both, "text", "a"), "edited", "b")
    signed = materialize(signed.select("doc_id", "n_chars", "edited_sha256", "a", "b"), "signatures")
    following = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min("a").alias("c"))
    following = ids.join(following.withColumnRenamed("doc_id", "next_id"), "next_id").select("doc_id", "c")
    out = signed.join(following, "doc_id", "left")
    near_next = F.when(F.col("c").isNotNull(), likeness(F.col("a"), F.col("c")))
    return out.select("doc_id", "n_chars", "edited_sha256", as_string(F.col("a")).alias("fingerprint"), as_string(F.col("b")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"), near_next.alias("near_next"))
