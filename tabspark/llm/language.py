"""Language identification by hierarchical discrimination.

A linear support vector machine for each language family picks the family; linear machines, one for each pair of the
family's languages, then vote on the language. Features are hashed byte pairs and triples of the whole text.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.llm.lean import lean
from tabspark.llm.mixing import uniform

#: ISO 639-1 codes by family; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be bg sr hr bs sl mk cs sk pl",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi bn mr ne gu pa ur",
    "semitic": "ar he mt am",
    "celtic": "ga gd cy br",
    "baltic": "lt lv",
    "malayic": "id ms",
}
#: About so many documents of a language train the machines.
PER_LANGUAGE = 600
MOST_LESSONS = 20_000
DIMENSIONS = 4096
UNDETERMINED = "und"
_WEIGHTS = pa.schema([("langs", pa.list_(pa.string())), ("weights", pa.binary()), ("bias", pa.binary())])
#: Bytes other than ASCII letters and those of longer characters are spaces; A-Z are lowered.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def family_of(language: str) -> str:
    return next((f for f, codes in FAMILIES.items() if language in codes.split()), language)


def features(text: bytes) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs and triples: a vector of length 1."""
    b = np.frombuffer(b" " + text.translate(_LETTERS) + b" ", np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] + b[2:] * np.uint32(0xC2B2AE3D)
    shift = np.uint32(20)
    mixed = np.concatenate([(two ^ two >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> shift, (three ^ three >> np.uint32(13)) * np.uint32(0x297A2D39) >> shift])
    return np.sqrt(np.bincount(mixed, minlength=DIMENSIONS) / len(mixed)).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def train_svm(x: np.ndarray, positive: np.ndarray, c: float = 10.0, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, classes weighted alike, by accelerated gradients."""
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    share = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(np.float32)
    xb = np.hstack([x, np.ones((len(x), 1), np.float32)])
    v = np.ones(xb.shape[1], np.float32)
    for _ in range(10):  # largest curvature
        v = xb.T @ (share * (xb @ v))
        v /= (top := float(np.linalg.norm(v)))
    step = 1.0 / (1.0 / c + 2.0 * top)
    w = np.zeros(xb.shape[1], np.float32)
    z, t = w.copy(), 1.0
    for _ in range(rounds):
        short = np.maximum(0.0, 1.0 - y * (xb @ z))
        grad = z / c - 2.0 * (xb.T @ (share * y * short))
        following = z - step * grad
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2  # Python's own floats leave the arrays in single precision
        z = following + (t - 1) / t2 * (following - w)
        w, t = following, t2
    return w[:-1], float(w[-1])


@dataclass
class Hierarchy:
    families: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)
    weights: np.ndarray | None = None  # a column for each machine: the families', then each family's pairs'
    bias: np.ndarray | None = None

    @classmethod
    def of(cls, langs: Iterable[str]) -> Hierarchy:
        members = defaultdict(list)
        for lang in sorted(set(langs)):
            members[family_of(lang)].append(lang)
        return cls(sorted(members), dict(members))

    @classmethod
    def fit(cls, x: np.ndarray, langs: np.ndarray) -> Hierarchy:
        self = cls.of(langs)
        members = self.languages
        family = np.array([family_of(a) for a in langs])
        machines = [train_svm(x, family == f) for f in self.families] if len(self.families) > 1 else []
        for f in self.families:
            for a, b in combinations(members[f], 2):
                of = (langs == a) | (langs == b)
                machines.append(train_svm(x[of], langs[of] == a))
        if machines:
            self.weights, self.bias = np.stack([w for w, _ in machines], 1), np.array([b for _, b in machines])
        return self

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each row of x: the family's share times the language's in it."""
        margin = x @ self.weights + self.bias if self.weights is not None else np.zeros((len(x), 0))
        n = len(self.families)
        if n > 1:
            e = np.exp(4 * (margin[:, :n] - margin[:, :n].max(1, keepdims=True)))
            share, at = e / e.sum(1, keepdims=True), n
        else:
            share, at = np.ones((len(x), 1)), 0
        best = share.argmax(1)
        out, score = np.empty(len(x), object), share.max(1).astype(float)
        for i, f in enumerate(self.families):
            langs, rows = self.languages[f], np.flatnonzero(best == i)
            votes = np.zeros((len(rows), len(langs)))
            for a, b in combinations(range(len(langs)), 2):
                p = 1 / (1 + np.exp(-4 * margin[rows, at]))
                votes[:, a] += p
                votes[:, b] += 1 - p
                at += 1
            if len(langs) > 1:
                votes /= len(langs) * (len(langs) - 1) / 2
                score[rows] *= np.minimum(1.0, votes.max(1) * len(langs) / 2)
            out[rows] = np.array(langs, object)[votes.argmax(1)] if len(rows) else []
        return out, np.clip(score, 0.0, 1.0)


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Hierarchy:
    """Trains on about per_language rows of each language of labelled (doc_id, text, lang): those of the least hashes.

    Rows with a null lang or text, or no letter, teach nothing. Which rows are taken depends on doc_id alone. Features of
    their whole texts are made by all executors, and one task of one, whose rows the sample bounds (MOST_LESSONS over all
    languages), trains the machines; the driver gets the finished weights.
    """
    rows = labelled.where("lang is not null and text is not null")
    count = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not count:
        return Hierarchy()
    per_language = min(per_language, MOST_LESSONS // len(count) + 1)
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))) for lang, n in sorted(count.items())])
    chosen = rows.where(uniform(F.col("doc_id"), "lang") < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(lang, features(t.encode("utf-8", "surrogatepass"))) for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([lang for lang, _ in pairs], pa.string()), pa.array([x.astype(np.float16).tobytes() for _, x in pairs], pa.binary())], ["lang", "x"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        if got:
            x = np.stack([np.frombuffer(b, np.float16) for _, b in got]).astype(np.float32)
            made = Hierarchy.fit(x, np.array([lang for lang, _ in got], object))
            weights, bias = (made.weights, made.bias) if made.weights is not None else (np.zeros((DIMENSIONS, 0), np.float32), np.zeros(0))
            yield pa.RecordBatch.from_pylist([{"langs": sorted({lang for lang, _ in got}), "weights": weights.astype(np.float32).tobytes(), "bias": bias.astype(float).tobytes()}], schema=_WEIGHTS)

    features_ = chosen.select("text", "lang").mapInArrow(lean(run), "lang string, x binary")
    found = features_.repartition(1).mapInArrow(lean(train), "langs array<string>, weights binary, bias binary").collect()
    if not found:
        return Hierarchy()
    out = Hierarchy.of(found[0].langs)
    bias = np.frombuffer(found[0].bias)
    if len(bias):
        out.weights, out.bias = np.frombuffer(found[0].weights, np.float32).reshape(DIMENSIONS, len(bias)), bias
    return out


def identify(docs: DataFrame, labelled: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """All columns of docs with lang_pred and score (0 to 1) added (replaced if docs has such), from whole texts.

    lang_pred is a language that labelled (doc_id, text, lang) has, or `und`, with score 0, if the text is null, empty or
    without a letter, or if labelled teaches nothing. Only the text tells: equal texts get equal results. Repeated rows and
    null ids are rows like any other. One pass, no shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled, per_language))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hierarchy = model.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            lang, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
            rows = [i for i, t in enumerate(texts) if has_letter(t)] if hierarchy.families else []
            for j in range(0, len(rows), 1000):
                some = rows[j : j + 1000]
                lang[some], score[some] = hierarchy.predict(np.stack([features(texts[i].encode("utf-8", "surrogatepass")) for i in some]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], [*kept, "lang_pred", "score"])

    return docs.mapInArrow(lean(run), schema)


def learnable(doc_id: Column) -> Column:
    """Rows whose crc32(doc_id as text) mod 3 isn't 1; a null id counts as the empty text."""
    from tabspark.llm.lm import held_out

    return ~held_out(doc_id, 3, 1)
