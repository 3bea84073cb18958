"""Language-model scores from a weighted backoff automaton.

States are histories of two words, of one, and the root. A state has an arc for each word that follows it in training,
weighted by the logarithm of (c(history, word) + PRIOR * p(word | shorter history)) / (c(history) + PRIOR), and a failure arc,
weighted by PRIOR / (c(history) + PRIOR), to the shorter history. The root's arcs are the additively smoothed words. A text is
read once from left to right: from the state at hand a token is read on its arc, or failure arcs are followed until one has
it, and leads to the longest history that the model knows. Nothing is pruned: what occurs once in training has its arc.

The model of a corpus fits no machine, but what a block of texts can ever ask of it does. Each block of bounded size sends
its distinct n-grams, with their counts, to the buckets of their hashes; a bucket adds up what it gets and answers each block
with the sums, in the order asked. So every n-gram crosses the network once for a block, however often it occurs, no answer
repeats a key, and no key is hot. With the sums a block builds its own part of the automaton, which has all that it needs.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabspark.llm.packing import pack, unpack
from tabspark.llm.store import materialize
from tabspark.llm.text import as_bytes, mix, word_hashes

ADD = 0.1
#: What the shorter history's estimate counts for.
PRIOR = 4.0
#: Tokens of a block, and of the parts in which texts are read side by side. Word numbers of a block fit in 21 bits.
BLOCK_TOKENS = 900_000
PART = 1024
#: Bytes of text for each bucket of n-grams.
BUCKET_BYTES = 4 << 20
#: Words can't hold spaces: none is like these two.
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_BITS = np.uint64(21)
_LOW = np.uint64((1 << 21) - 1)

_COLUMNS = [("to", pa.int64()), ("kind", pa.int32()), ("block", pa.int64()), ("tokens", pa.int64()), ("words", pa.int64()), ("data", pa.binary())]
_MESSAGE = pa.schema(_COLUMNS)
MESSAGE = "to long, kind int, block long, tokens long, words long, data binary"
#: Kinds of messages: a block's texts, its n-grams or their sums, and training totals.
TEXTS, GRAMS, TOTALS = 0, 1, 2
SCORES = "row long, doc_id long, n long, known long, base double, score double"
_SCORES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])


def held_out(doc_id: Column, of: int, remainder: int = 0) -> Column:
    """crc32(doc_id as text) mod `of` is `remainder`; a null id counts as the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of == remainder


def _runs(x: np.ndarray) -> np.ndarray:
    """Which values of a sorted array differ from the one before."""
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return new


@dataclass
class Block:
    """Parts of texts: tokens as numbers of `words` (sorted hashes); each part begins with `context` tokens of the one before
    (or the beginning), which are read but not scored."""

    words: np.ndarray
    tokens: np.ndarray
    size: np.ndarray
    context: np.ndarray
    train: np.ndarray
    row: np.ndarray
    doc_id: np.ndarray
    has_id: np.ndarray

    @classmethod
    def of(cls, parts: list[tuple[int, int | None, bool, int, np.ndarray]]) -> Block:
        rows, ids, train, context, seqs = zip(*parts, strict=True)
        words, tokens = _numbered(np.concatenate(seqs))
        often = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")  # small numbers for frequent words
        number = np.empty(len(words), np.uint32)
        number[often] = np.arange(len(words), dtype=np.uint32)
        return cls(
            words[often],
            number[tokens],
            np.array([len(s) for s in seqs], np.int64),
            np.array(context, np.int8),
            np.array(train, np.int8),
            np.array(rows, np.int64),
            np.array([x or 0 for x in ids], np.int64),
            np.array([x is not None for x in ids], np.int8),
        )

    def packed(self) -> bytes:
        return pack(self.words, self.tokens, self.size, self.context, self.train, self.row, self.doc_id, self.has_id)

    def name(self, task: int, number: int) -> int:
        """A hash of all that the block holds and of where it was found."""
        h = xxhash.xxh3_64(struct.pack("<QQ", task, number))
        for a in (self.words, self.tokens, self.size, self.context, self.train, self.row, self.doc_id, self.has_id):
            h.update(np.ascontiguousarray(a).view(np.uint8))
        return h.intdigest() - (1 << 63)


def _order(x: np.ndarray, bits: int) -> np.ndarray:
    """Places of values of so many bits in rising order, in half the time of an argsort where a place fits beside a value."""
    if len(x) > 1 << (64 - bits):
        return np.argsort(x, kind="stable")
    free = np.uint64(64 - bits)
    return (np.sort((x << free) | np.arange(len(x), dtype=np.uint64)) & ((np.uint64(1) << free) - np.uint64(1))).astype(np.int64)


def _numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes and the number of each place's."""
    by = _order(hashes >> np.uint64(21), 43)
    x = hashes[by]
    new = _runs(x)
    if (x[1:][new[1:]] >> np.uint64(21) == x[:-1][new[1:]] >> np.uint64(21)).any():  # alike in all bits that were sorted
        return np.unique(hashes, return_inverse=True)
    out = np.empty(len(hashes), np.int64)
    out[by] = np.cumsum(new) - 1
    return x[new], out


class Grams:
    """The distinct n-grams of a block, their training counts in it, and hashes by which all blocks know them.

    code2 has the two words of each pair, code3 the pair and the word of each triple, and at3 a place where it ends. count[n]
    is how often an n-gram ends in a token that is scored in training. pair: of each place but the first of a part, which pair
    ends there. keys, order: the hashes of all, and their rising order; the two low bits are n, or 0 for a text's beginning.
    """

    def __init__(self, block: Block) -> None:
        t = block.tokens.astype(np.uint64)
        first = np.cumsum(block.size) - block.size
        place = np.arange(len(t)) - np.repeat(first, block.size)
        scored = place >= np.repeat(block.context, block.size)
        learnt = scored & np.repeat(block.train == 1, block.size)
        self.scored, self.first = scored, first
        words = block.words
        count1 = np.bincount(block.tokens[learnt], minlength=len(words))
        begin = np.flatnonzero(words == BEGIN)
        self.begin = int(begin[0]) if len(begin) else -1
        if self.begin >= 0:  # counted as often as a text that is learnt begins
            starts = (place == 0) & (block.tokens == self.begin) & np.repeat((block.train == 1) & (block.context == 1), block.size)
            count1[self.begin] = int(starts.sum())
        two, three = np.flatnonzero(place >= 1), np.flatnonzero(place >= 2)
        sums = lambda at, begins: np.add.reduceat(learnt[at].astype(np.int64), begins) if len(begins) else np.zeros(0, np.int64)
        code = (t[two - 1] << _BITS) | t[two]
        by = _order(code, 42)
        new = _runs(code[by])
        self.pair = np.zeros(len(t), np.int64)
        self.pair[two[by]] = np.cumsum(new) - 1
        begins = np.flatnonzero(new)
        self.code2, count2 = code[by[begins]], sums(two[by], begins)
        code = (self.pair[three - 1].astype(np.uint64) << _BITS) | t[three]  # the pair before, and the word
        by = _order(code, 42)
        begins = np.flatnonzero(_runs(code[by]))
        self.code3, self.at3 = code[by[begins]], three[by[begins]]
        self.count = {1: count1, 2: count2, 3: sums(three[by], begins)}

        one = mix(words)
        two_ = mix(words[self.code2 >> _BITS] * np.uint64(0x9E3779B97F4A7C15) + words[self.code2 & _LOW])
        three_ = mix(two_[self.code3 >> _BITS] * np.uint64(0xC2B2AE3D27D4EB4F) + words[self.code3 & _LOW])
        self.keys = np.concatenate([(k & ~np.uint64(3)) | np.uint64(n) for n, k in ((1, one), (2, two_), (3, three_))])
        if self.begin >= 0:
            self.keys[self.begin] &= ~np.uint64(3)
        self.order = _order(self.keys >> np.uint64(22), 42)  # all bits that tell buckets are among these

    def counts(self) -> np.ndarray:
        return np.concatenate([self.count[n] for n in (1, 2, 3)])

    def summed(self, sums: np.ndarray) -> dict[int, np.ndarray]:
        """Counts by n, from sums in the order of the keys."""
        back = np.empty(len(self.keys))
        back[self.order] = sums
        a, b = len(self.count[1]), len(self.count[1]) + len(self.count[2])
        return {1: back[:a], 2: back[a:b], 3: back[b:]}


class Automaton:
    """State 0 is the root, 1 + w that of word w, 1 + words + p that of pair p. Arcs of states lie one after another, sorted
    by word; root arcs are found by the word itself. All weights are log10."""

    def __init__(self, root: np.ndarray, known: np.ndarray, fail: np.ndarray, fail_weight: np.ndarray, state: np.ndarray, word: np.ndarray, weight: np.ndarray, target: np.ndarray) -> None:
        self.root, self.fail, self.fail_weight = root, fail, fail_weight
        self.root_target = np.where(known, np.arange(1, len(known) + 1), 0)
        self.word, self.weight, self.target = word, weight, target
        self.begins = np.concatenate([[0], np.cumsum(np.bincount(state, minlength=len(fail)))])
        self.key = state * np.int64(1 << 21) + word

    @classmethod
    def of(cls, block: Block, grams: Grams, sums: np.ndarray, tokens: int, words: int) -> Automaton:
        """The part of the model that a block's texts can reach, from the sums over all blocks."""
        c, v = grams.summed(sums), len(block.words)
        p1 = (c[1] + ADD) / (tokens + ADD * (words + 1))
        if grams.begin >= 0:
            p1[grams.begin] = ADD / (tokens + ADD * (words + 1))
        known = c[1] > 0
        u, w = (grams.code2 >> _BITS).astype(np.int64), (grams.code2 & _LOW).astype(np.int64)
        p2 = (c[2] + PRIOR * p1[w]) / (c[1][u] + PRIOR)
        before, now = (grams.code3 >> _BITS).astype(np.int64), grams.pair[grams.at3]
        p3 = (c[3] + PRIOR * p2[now]) / (c[2][before] + PRIOR)
        fail = np.concatenate([[0], np.zeros(v, np.int64), np.where(known[w], 1 + w, 0)])
        weight = np.concatenate([[0.0], np.log10(PRIOR / (c[1] + PRIOR)), np.log10(PRIOR / (c[2] + PRIOR))])
        pair = np.where(c[2] > 0, 1 + v + np.arange(len(w)), np.where(known[w], 1 + w, 0))  # where a pair leads to
        has2, has3 = c[2] > 0, c[3] > 0
        state = np.concatenate([1 + u[has2], 1 + v + before[has3]])  # rising, as codes are
        word = np.concatenate([w[has2], (grams.code3 & _LOW).astype(np.int64)[has3]])
        arcs = np.concatenate([np.log10(p2[has2]), np.log10(p3[has3])])
        return cls(np.log10(p1), known, fail, weight, state, word, arcs, np.concatenate([pair[has2], pair[now[has3]]]))

    def arc(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Numbers of the arcs of states by words; -1 where there is none."""
        at = self.begins[state]
        n = self.begins[state + 1] - at
        found = np.full(len(state), -1)
        maybe = np.flatnonzero(n)
        hit = maybe[self.word[at[maybe]] == word[maybe]]
        found[hit] = at[hit]
        rest = np.flatnonzero((found < 0) & (n > 1))
        if len(rest):
            key = state[rest] * np.int64(1 << 21) + word[rest]
            place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[place] == key
            found[rest[hit]] = place[hit]
        return found

    def read(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reads a word from each state: the states that follow, and the weights of the arcs and failure arcs taken."""
        state, weight, following = state.copy(), np.zeros(len(state)), np.empty(len(state), np.int64)
        left = np.arange(len(state))
        while len(left):
            s, w = state[left], word[left]
            root = s == 0
            done = left[root]
            weight[done] += self.root[w[root]]
            following[done] = self.root_target[w[root]]
            left, s, w = left[~root], s[~root], w[~root]
            arc = self.arc(s, w)
            on = arc >= 0
            weight[left[on]] += self.weight[arc[on]]
            following[left[on]] = self.target[arc[on]]
            left, s = left[~on], s[~on]
            weight[left] += self.fail_weight[s]
            state[left] = self.fail[s]
        return following, weight

    def walk(self, block: Block, first: np.ndarray) -> np.ndarray:
        """log10 probability of each part: all parts are read side by side, a token each at a time, each in its own state."""
        longest = np.argsort(-block.size, kind="stable")
        size, context, start = block.size[longest], block.context[longest], first[longest]
        state, score = np.zeros(len(size), np.int64), np.zeros(len(size))
        tokens = block.tokens.astype(np.int64)
        for i in range(int(size[0])):
            m = int(np.searchsorted(-size, -i))  # parts of more than i tokens
            word = tokens[start[:m] + i]
            if i == 0:  # a part begins in the state of its first token
                state[:m] = self.root_target[word]
                continue
            state[:m], weight = self.read(state[:m], word)
            score[:m] += np.where(i >= context[:m], weight, 0.0)
        out = np.empty(len(size))
        out[longest] = score
        return out


def score_block(block: Block, sums: np.ndarray, tokens: int, words: int) -> list[np.ndarray]:
    """row, doc_id, has_id, n, known, base, score of each text of which the block has parts."""
    grams = Grams(block)
    model = Automaton.of(block, grams, sums, tokens, words)
    score = model.walk(block, grams.first)
    part = np.repeat(np.arange(len(block.size)), block.size)[grams.scored]
    read = block.tokens[grams.scored]
    n = np.bincount(part, minlength=len(block.size))
    known = np.bincount(part, weights=model.root_target[read] > 0, minlength=len(block.size))
    base = np.bincount(part, weights=model.root[read], minlength=len(block.size))
    rows, at, of = np.unique(block.row, return_index=True, return_inverse=True)
    add = lambda x: np.bincount(of, weights=x, minlength=len(rows))
    return [rows, block.doc_id[at], block.has_id[at], add(n), add(known), add(base), add(score)]


def _blocks(batches: Iterator[pa.RecordBatch], block_tokens: int, part: int) -> Iterator[tuple[int, Block]]:
    """Blocks of the texts of a task and their names; columns doc_id, text, train."""
    task = TaskContext.get().partitionId()
    parts, size, number, row = [], 0, 0, 0

    def close() -> tuple[int, Block]:
        block = Block.of(parts)
        parts.clear()
        return block.name(task, number), block

    for batch in batches:
        ids, train = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for doc_id, learnt, h in zip(ids, train, word_hashes(as_bytes(batch.column(1))), strict=True):
            s = np.concatenate([[BEGIN], h, [END]])
            for a in range(1, len(s), part):
                piece = s[max(0, a - 2) : a + part]
                parts.append(((task << 33) + row, doc_id, bool(learnt), a - max(0, a - 2), piece))
                size += len(piece)
                if size >= block_tokens:
                    yield close()
                    size, number = 0, number + 1
            row += 1
    if parts:
        yield close()


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True) if rows else [()] * 6, _COLUMNS, strict=True)], schema=_MESSAGE)


def ask(texts: DataFrame, buckets: int, block_tokens: int = BLOCK_TOKENS, part: int = PART) -> DataFrame:
    """Messages of each block to each bucket: its n-grams and their counts. buckets is a power of two."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block in _blocks(batches, block_tokens, part):
            grams = Grams(block)
            keys, counts = grams.keys[grams.order], grams.counts()[grams.order].astype(np.uint32)
            ends = np.searchsorted(keys >> shift if buckets > 1 else np.zeros(len(keys), np.uint64), np.arange(buckets + 1, dtype=np.uint64))
            for i in range(0, buckets, 64):
                rows = []
                for to in range(i, min(buckets, i + 64)):
                    if len(k := keys[ends[to] : ends[to + 1]]):
                        rows.append((to, GRAMS, name, 0, 0, pack(np.diff(k, prepend=np.uint64(0)), counts[ends[to] : ends[to + 1]])))
                yield _messages(rows)

    return texts.mapInArrow(run, MESSAGE)


def tell(texts: DataFrame, block_tokens: int = BLOCK_TOKENS, part: int = PART) -> DataFrame:
    """A message of each block that has its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block in _blocks(batches, block_tokens, part):
            yield _messages([(-1, TEXTS, name, 0, 0, block.packed())])

    return texts.mapInArrow(run, MESSAGE)


def answer(messages: DataFrame) -> DataFrame:
    """For each message of n-grams their sums over all blocks, and each bucket's training totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, asked = None, []

        def close() -> pa.RecordBatch:
            blocks, keys, counts = zip(*asked, strict=True)
            k, c = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
            by = np.argsort(k)
            new = _runs(k[by])
            begins = np.flatnonzero(new)
            sums = np.add.reduceat(c[by], begins)
            back = np.empty(len(k), np.int64)
            back[by] = sums[np.cumsum(new) - 1]
            one = (k[by][begins] & np.uint64(3)) == 1
            rows = [(current, TOTALS, -1, int(sums[one].sum()), int((sums[one] > 0).sum()), None)]
            for block, some in zip(blocks, np.split(back, np.cumsum([len(x) for x in keys])[:-1]), strict=True):
                rows.append((current, GRAMS, block, 0, 0, pack(some.astype(np.uint32 if some.max() < 1 << 32 else np.uint64))))
            asked.clear()
            return _messages(rows)

        for batch in batches:
            for i in range(batch.num_rows):
                to, block, data = (batch.column(j)[i].as_py() for j in (0, 2, 5))
                if asked and to != current:
                    yield close()
                current = to
                differences, counts = unpack(data)
                asked.append((block, np.cumsum(differences, dtype=np.uint64), counts))
        if asked:
            yield close()

    return messages.repartition("to").sortWithinPartitions("to").mapInArrow(run, MESSAGE)


def read_texts(messages: DataFrame, tokens: int, words: int) -> DataFrame:
    """SCORES of all texts, from blocks and the sums that they got: a row for each text of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, block, sums = None, None, []

        def close() -> pa.RecordBatch:
            if block is None or not sums:
                raise ValueError("the documents weren't the same, or in another order, when they were read again: write them to a table first")
            rows, doc_id, has_id, n, known, base, score = score_block(block, np.concatenate(sums), tokens, words)
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(doc_id, mask=has_id == 0), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)], schema=_SCORES)

        for batch in batches:
            for i in range(batch.num_rows):
                kind, name, data = (batch.column(j)[i].as_py() for j in (1, 2, 5))
                if current is not None and name != current:
                    yield close()
                    block = None
                current = name
                if kind == TEXTS:
                    block = Block(*unpack(data))
                else:
                    sums += unpack(data)
        if current is not None:
            yield close()

    return messages.repartition("block").sortWithinPartitions("block", "kind", "to").mapInArrow(run, SCORES)


def score_documents(docs: DataFrame, train: Column, bucket_bytes: int = BUCKET_BYTES, block_tokens: int = BLOCK_TOKENS, part: int = PART) -> DataFrame:
    """Scores docs (doc_id, text) by a model of those where `train` holds.

    Returns doc_id, n_tokens (words and one end), n_known (tokens seen in training), train_tokens, base_score, score: a row
    per row of docs. A null or empty text is its end alone. Repeated rows count and are scored each, as are rows without
    doc_id; a null `train` is false; extra columns are ignored. Without training texts all counts are 0, and base_score and
    score are 0. No documents give no rows. A text of any length is read in parts, each begun with the two tokens before it.

    bucket_bytes, block_tokens and part change no result, only how the work is divided.

    docs must give the same rows in the same order whenever it is read, as tables do; else an error is raised, never a wrong
    score. Texts are read for their size, to ask, and to score. Two exchanges: one of n-grams, one of answers and texts.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = 1 << max(0, (size // bucket_bytes).bit_length())
    answers = materialize(answer(ask(texts, buckets, block_tokens, part)), "answers")
    tokens, words = answers.where(F.col("kind") == TOTALS).agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    # texts first: their tasks then have the numbers that they had when they asked
    parts = read_texts(tell(texts, block_tokens, part).unionAll(answers.where(F.col("kind") == GRAMS)), int(tokens), int(words))
    sums = [F.sum(a).alias(b) for a, b in (("n", "n_tokens"), ("known", "n_known"), ("base", "base_score"), ("score", "score"))]
    out = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *sums)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), "base_score", "score")
