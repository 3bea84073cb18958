"""Token counts by heap-and-linked-list byte-pair merging.

A text's count is its initial symbols minus the merges made; no identifier is produced. The vocabulary is that of a
sentencepiece BPE model (identity normalizer, dummy prefix, byte fallback).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: Segments whose counts a Python worker keeps; then it starts anew.
KEEP_SEGMENTS = 400_000
#: A vocabulary is shipped to every task, so its size is checked.
MAX_PIECES = 1_000_000


def load_ranks(model_path: str) -> dict[str, int]:
    """piece -> rank; the piece of the highest score has rank 0, equal scores share a rank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    if sp.get_piece_size() > MAX_PIECES:
        raise ValueError(f"{model_path} has more than {MAX_PIECES} pieces")
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    rank = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in ids}, reverse=True))}
    ranks = {sp.id_to_piece(i): rank[sp.get_score(i)] for i in ids}
    if any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in ranks):
        raise ValueError("a piece crosses a line or goes on after a space: texts can't be cut there")
    return ranks


class SegmentCounts(dict):
    """segment -> tokens. A segment is a run of spaces (as ▁) and the other characters up to the next space."""

    def __init__(self, ranks: dict[str, int]) -> None:
        super().__init__()
        self.ranks = ranks

    def __missing__(self, segment: str) -> int:
        if len(self) >= KEEP_SEGMENTS:
            self.clear()
        n = self.merge(segment)
        if len(segment) <= 64:
            self[segment] = n
        return n

    def merge(self, segment: str) -> int:
        """Initial symbols minus merges: the adjacent pair of the lowest rank (leftmost first) is merged until none is left."""
        ranks, n = self.ranks, len(segment)
        count = sum(1 if c in ranks else len(c.encode("utf-8", "surrogatepass")) for c in segment)
        if n < 2:
            return count
        symbol: list[str | None] = list(segment)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, i + 1, 2) for i in range(n - 1) if (r := ranks.get(segment[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, left, right, size = heappop(heap)
            a, b = symbol[left], symbol[right]
            if a is None or b is None or after[left] != right or len(a) + len(b) != size:
                continue  # one of the two has been merged since
            symbol[left], symbol[right] = a + b, None
            count -= 1
            after[left] = following = after[right]
            if following >= 0:
                before[following] = left
                joined = symbol[left] + symbol[following]
                if (r := ranks.get(joined)) is not None:
                    heappush(heap, (r, left, following, len(joined)))
            if (previous := before[left]) >= 0:
                joined = symbol[previous] + symbol[left]
                if (r := ranks.get(joined)) is not None:
                    heappush(heap, (r, previous, left, len(joined)))
        return count

    def text(self, text: str) -> int:
        """Tokens of a whole text. A dummy space goes before it; a newline is a byte token that nothing merges with."""
        if not text:
            return 0
        if SPACE in text:
            text = text.replace(SPACE, " ")
        total, first = 0, True
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            if first:
                rest, head, first = [head, *rest], "", False
            else:
                total += 1
            if head:
                total += self[head]
            if "" in rest:
                rest = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", SPACE + SPACE.join(rest))
                total += sum(map(self.__getitem__, rest))
            else:
                total += sum([self[SPACE + w] for w in rest])
        return total


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), one row per row of docs.

    Null and empty texts have no bytes and no tokens. Repeated rows and null ids are counted like any other row. One pass,
    no shuffle; a worker holds one batch of texts and at most KEEP_SEGMENTS counts.
    """
    ranks = load_ranks(model_path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = SegmentCounts(ranks)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [counts.text(t or "") for t in texts]
            size = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], schema=schema)

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
