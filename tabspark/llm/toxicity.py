"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's embedding is the mean of those of its character n-grams and of the word itself, so an unseen misspelling shares most
of its word's. The embeddings of WINDOW neighbouring words are averaged and go through a linear softmax of two classes. What
makes a document toxic may be one word of thousands, which an average over the whole text drowns; so a document is as toxic as
its most toxic window. In training the maximum is a soft one that sharpens from round to round: gradients go to all windows of
a document in proportion to what they say, at first, and to the most toxic one in the end.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.llm.lean import lean
from tabspark.llm.mixing import uniform
from tabspark.llm.store import by_keys, materialize
from tabspark.llm.text import CHUNK, as_bytes, mix

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
DIMENSIONS = 16
SIZES = (3, 4, 5, 6)
#: Words averaged together.
WINDOW = 2
#: About so many toxic and twice as many clean documents train the model, none of more bytes than LONGEST_LESSON.
PER_CLASS = 1000
LONGEST_LESSON = 50_000
ROUNDS, RATE, DECAY = 80, 0.05, 1e-4
#: How sharp the soft maximum is in the end; it begins as the log of the windows' summed odds.
SHARPEST = 4.0
#: Log odds of a window before anything is learnt.
START_BIAS = -6.0
#: Words of the texts, n-grams of the distinct words, and embeddings that a training step works on at a time.
STEP = 1 << 16
#: A run of more bytes (text without spaces, say) is no single word: it is as toxic as its most toxic part.
LONGEST_WORD = 64
#: Bytes of the parts of a long run, at each of its places.
PIECES = (8, 12, 16, 24, 32, 48, 64)
_MARKS = b"\t\n\x0b\x0c\r.,;:!?\"'()[]{}<>*$%&#|`~-_/\\"
#: A-Z lowered; what stands between words is a space.
_FOLD = bytes(32 if b in _MARKS else b + 32 if 65 <= b <= 90 else b for b in range(256))
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) + np.uint64(1 << 32)) | np.uint64(1)
_TIMES = 0x9E3779B97F4A7C15
_SPREAD = np.uint64(0xC2B2AE3D27D4EB4F)


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    return ((h + np.uint64(salt)) * _SPREAD >> np.uint64(64 - BUCKET_BITS)).astype(np.uint16)


@dataclass
class Cells:
    """Words of a piece of text: where each starts and ends, and the buckets of n-grams by the place where they begin.

    The space before a word and that after it are part of its n-grams. whole: the bucket of each word itself.
    """

    start: np.ndarray
    end: np.ndarray
    grams: dict[int, np.ndarray]
    whole: np.ndarray

    @classmethod
    def of(cls, folded: bytes) -> Cells:
        """folded: text through _FOLD, a space before and after it."""
        b = np.frombuffer(folded, np.uint8)
        inside = b != 32
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        start, end = edge[::2], edge[1::2]
        value = _VALUE[b]
        h, power, grams = value.copy(), 1, {}
        for n in range(2, max(SIZES) + 1):
            power = power * _TIMES % (1 << 64)
            h = h[: len(b) - n + 1] + value[n - 1 :] * np.uint64(power)
            if n in SIZES:
                grams[n] = _bucket(h, n)
        # a word is known by its length and the sum of what its neighbouring bytes hash to
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value[:-1] * np.uint64(3) + value[1:]))])
        whole = sums[end] - sums[start - 1]
        return cls(start, end, grams, _bucket(mix(whole + (end - start).astype(np.uint64)), 1))

    def of_word(self, i: int) -> np.ndarray:
        a, b = self.start[i] - 1, self.end[i] + 1
        return np.concatenate([*(self.grams[n][a : b - n + 1] for n in SIZES if b - a >= n), self.whole[i : i + 1]])

    def scores(self, by_bucket: np.ndarray) -> np.ndarray:
        """Each word's mean over its buckets; of a long run that of its highest part."""
        total, size = by_bucket[self.whole], np.ones(len(self.start))
        sums = {n: np.concatenate([[0.0], np.cumsum(by_bucket[g])]) for n, g in self.grams.items()}
        a, b = self.start - 1, self.end + 1
        for n in SIZES:
            stop = np.maximum(a, b - n + 1)
            total = total + sums[n][np.minimum(stop, len(sums[n]) - 1)] - sums[n][np.minimum(a, len(sums[n]) - 1)]
            size += stop - a
        out = total / size
        for i in np.flatnonzero(self.end - self.start > LONGEST_WORD):
            best = -np.inf
            for piece in PIECES:
                at = np.arange(a[i], b[i] - piece + 1)
                held = sum(sums[n][at + piece - n + 1] - sums[n][at] for n in SIZES)
                best = max(best, float(held.max()) / sum(piece - n + 1 for n in SIZES))
            out[i] = best
        return out


def pieces(text: bytes) -> Iterator[bytes]:
    """A folded text in parts of at most CHUNK bytes with a space on both sides, cut at spaces; a longer run is cut with an
    overlap of its longest part."""
    at = 0
    while at < len(text):
        stop, following = at + CHUNK, at + CHUNK
        if stop < len(text) and text[stop] != 32:
            cut = text.rfind(b" ", at, stop)
            stop, following = (cut, cut) if cut > at else (stop, stop - max(PIECES))
        yield b" " + text[at:stop] + b" "
        at = following


def word_scores(texts: Iterable[bytes | None], by_bucket: np.ndarray) -> Iterator[np.ndarray]:
    """For each text its words' parts of the softmax's toxic minus clean logit. Texts are read together, very long ones in parts."""

    def together(some: list[bytes]) -> Iterator[np.ndarray]:
        cells = Cells.of(b" " + b" ".join(some) + b" ")
        found = cells.scores(by_bucket)
        bounds = np.searchsorted(cells.start, np.cumsum([0, *(len(t) + 1 for t in some)]) + 1)
        for i in range(len(some)):
            yield found[bounds[i] : bounds[i + 1]]

    some, size = [], 0
    for text in texts:
        text = (text or b"").translate(_FOLD)
        if some and size + len(text) + 1 > CHUNK:
            yield from together(some)
            some, size = [], 0
        if len(text) < CHUNK:
            some.append(text)
            size += len(text) + 1
        else:
            yield np.concatenate([Cells.of(p).scores(by_bucket) for p in pieces(text)])
    if some:
        yield from together(some)


def windows(s: np.ndarray) -> np.ndarray:
    """Means of WINDOW neighbours; of all if there are fewer."""
    if len(s) <= WINDOW:
        return s.mean(keepdims=True)
    c = np.concatenate([[0.0], np.cumsum(s)])
    return (c[WINDOW:] - c[:-WINDOW]) / WINDOW


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Lessons:
    """Texts to learn from, as buckets of distinct words, words in order, and windows."""

    def __init__(self, texts: list[bytes]) -> None:
        number: dict[bytes, int] = {}
        cells, size, docs = bytearray(), array("q"), []
        for text in texts:
            folded = b" " + text.translate(_FOLD) + b" "
            found, own = Cells.of(folded), array("i")
            for i, (a, b) in enumerate(zip(found.start.tolist(), found.end.tolist(), strict=True)):
                word = folded[a:b]
                if (n := number.get(word)) is None:
                    n = number[word] = len(number)
                    cells += (own_cells := found.of_word(i)).tobytes()
                    size.append(len(own_cells))
                own.append(n)
            docs.append(np.frombuffer(own, np.int32))
        self.cells = np.frombuffer(cells, np.uint16)
        self.size = np.frombuffer(size, np.int64)
        self.words = np.concatenate(docs)
        self.length = np.array([len(d) for d in docs])
        self.n = np.maximum(1, self.length - WINDOW + 1)  # windows of each text
        self.texts = _blocks(self.length)
        self.distinct = _blocks(self.size)


def _blocks(sizes: np.ndarray) -> list[tuple[slice, slice]]:
    """Runs of neighbours of about STEP in all, or one that is larger; and where what they hold stands."""
    ends = np.cumsum(sizes)
    cuts = np.unique(np.append(np.flatnonzero(np.diff((ends - sizes) // STEP)) + 1, [0, len(sizes)])).tolist()
    held = [0, *ends.tolist()]
    return [(slice(a, b), slice(held[a], held[b])) for a, b in zip(cuts, cuts[1:])]


class Model:
    """embedding: a row for each bucket; out: the softmax's weights of clean and toxic, a column each; bias: toxic minus clean."""

    def __init__(self) -> None:
        r = np.random.default_rng(7)
        self.embedding = r.normal(scale=0.1, size=(BUCKETS, DIMENSIONS))
        self.out = r.normal(size=(DIMENSIONS, 2)) / np.sqrt(DIMENSIONS)
        self.bias = START_BIAS

    def by_bucket(self) -> np.ndarray:
        """What a bucket adds to the toxic minus clean logit of a word that it stands for alone."""
        return self.embedding @ (self.out[:, 1] - self.out[:, 0])

    def gradients(self, x: Lessons, y: np.ndarray, weight: np.ndarray, sharp: float = 1.0) -> tuple[float, np.ndarray, np.ndarray, float]:
        """Weighted cross entropy of texts by the soft maximum of their windows, and its gradients by embedding, out and bias.

        A softmax of two classes depends on the embeddings through one number a bucket, so these are propagated as numbers.
        """
        along = self.out[:, 1] - self.out[:, 0]
        by_bucket, words = self.by_bucket(), np.empty(len(x.size))
        for some, held in x.distinct:
            size = x.size[some]
            words[some] = np.add.reduceat(by_bucket[x.cells[held]], np.cumsum(size) - size) / size
        loss, by_bias, by_word, by_cell = 0.0, 0.0, np.zeros(len(x.size)), np.zeros(BUCKETS)
        for some, held in x.texts:
            own, length, n = x.words[held], x.length[some], x.n[some]
            begins = np.cumsum(n) - n
            at = np.arange(n.sum()) + np.repeat(np.cumsum(length) - length - begins, n)
            width = np.repeat(np.minimum(WINDOW, length), n)
            c = np.concatenate([[0.0], np.cumsum(words[own])])
            z = (c[at + width] - c[at]) / width + self.bias
            top = np.maximum.reduceat(z, begins)
            odds = np.exp(sharp * (z - np.repeat(top, n)))
            total = np.add.reduceat(odds, begins)
            logit = top + np.log(total) / sharp
            loss += float((weight[some] * np.logaddexp(0, np.where(y[some], -logit, logit))).sum())
            by_window = np.repeat((sigmoid(logit) - y[some]) * weight[some] / total, n) * odds
            by_bias += float(by_window.sum())
            by_window /= width
            ends = np.bincount(at, weights=by_window, minlength=len(own) + 1) - np.bincount(at + width, weights=by_window, minlength=len(own) + 1)
            np.add.at(by_word, own, np.cumsum(ends)[:-1])
        by_word /= x.size
        for some, held in x.distinct:
            by_cell += np.bincount(x.cells[held], weights=np.repeat(by_word[some], x.size[some]), minlength=BUCKETS)
        by_out = self.embedding.T @ by_cell
        return loss, by_cell[:, None] * along, np.stack([-by_out, by_out], 1), by_bias

    def fit(self, texts: list[bytes], toxic: np.ndarray) -> Model:
        """Embeddings, softmax and bias together, by Adam over all texts at once, both classes of the same weight."""
        x, y = Lessons(texts), toxic.astype(float)
        weight = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
        bias = np.array([self.bias])
        state = [(value, np.zeros_like(value), np.zeros_like(value)) for value in (self.embedding, self.out, bias)]
        for i in range(1, ROUNDS + 1):
            _, by_embedding, by_out, by_bias = self.gradients(x, y, weight, 1 + (SHARPEST - 1) * i / ROUNDS)
            rate, step = RATE * (1 - (i - 1) / ROUNDS), STEP // DIMENSIONS
            for (value, m, v), gradient, decay in zip(state, (by_embedding, by_out, np.array([by_bias])), (DECAY, 0.0, 0.0), strict=True):
                for a in range(0, len(value), step):
                    part = slice(a, a + step)
                    g = gradient[part] + decay * value[part]
                    m[part] = 0.9 * m[part] + 0.1 * g
                    v[part] = 0.99 * v[part] + 0.01 * g * g
                    value[part] -= rate * (m[part] / (1 - 0.9**i)) / (np.sqrt(v[part] / (1 - 0.99**i)) + 1e-8)
            self.bias = float(bias[0])
        return self

    def logit(self, texts: Iterable[bytes | None]) -> np.ndarray:
        """Log odds of texts; of one without words the bias alone."""
        return np.array([windows(s).max() + self.bias if len(s) else self.bias for s in word_scores(texts, self.by_bucket())])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Trains on about per_class toxic and twice as many clean documents, chosen by the hashes of the ids in labels (doc_id, toxic).

    A label of several rows is toxic if any is; null labels and ids, and texts without words or longer than LONGEST_LESSON
    bytes, teach nothing. If only one class is left, the model is the untrained one, which takes nothing for toxic. Training
    is one task of an executor, whose rows the sample bounds; the driver gets the finished weights.
    """
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = {r.toxic: r.n for r in one.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("toxic") > 0, min(1.0, per_class / max(1, count.get(True, 0)))).otherwise(min(1.0, 2 * per_class / max(1, count.get(False, 0))))
    chosen = materialize(one.where(uniform(F.col("doc_id"), "toxic") < share), "lessons")
    rows = by_keys(docs.select("doc_id", "text").where(F.octet_length("text") <= LONGEST_LESSON), chosen.select("doc_id"), "doc_id", "left_semi").join(chosen, "doc_id")
    schema = pa.schema([("embedding", pa.binary()), ("out", pa.binary()), ("bias", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lessons = {(t, bool(y)) for batch in batches for t, y in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True)}
        lessons = sorted(x for x in lessons if x[0].translate(_FOLD).strip())
        toxic = np.array([y for _, y in lessons], bool)
        if toxic.any() and not toxic.all():
            model = Model().fit([t for t, _ in lessons], toxic)
            yield pa.RecordBatch.from_pylist([{"embedding": model.embedding.astype(np.float32).tobytes(), "out": model.out.tobytes(), "bias": float(model.bias)}], schema=schema)

    trained = rows.select("text", F.col("toxic") > 0).repartition(1).mapInArrow(lean(run), "embedding binary, out binary, bias double").collect()
    model = Model()
    if trained:
        model.embedding = np.frombuffer(trained[0].embedding, np.float32).reshape(BUCKETS, DIMENSIONS).astype(float)
        model.out, model.bias = np.frombuffer(trained[0].out).reshape(DIMENSIONS, 2), trained[0].bias
    else:
        model.embedding = np.zeros_like(model.embedding)
        model.bias = -40.0
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs with score (0 to 1) and predicted (1 if score >= 0.5, else 0) added, replaced if docs has such.

    Each whole text is read, long runs without spaces in parts; null texts and texts without words score as the bias alone.
    Only the text tells. Repeated rows and null ids are rows like any other. One pass, no shuffle.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    at = kept.index("text")
    shared = docs.sparkSession.sparkContext.broadcast((model.by_bucket(), float(model.bias)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket, bias = shared.value
        for batch in batches:
            found = word_scores(as_bytes(batch.column(at)), by_bucket)
            p = sigmoid(np.array([windows(s).max() + bias if len(s) else bias for s in found]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], [*kept, "score", "predicted"])

    return docs.mapInArrow(lean(run), schema)
