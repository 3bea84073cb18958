"""Each operator against brute force or an exact round trip, with nulls, empties, ties, repeats, clashing columns, no rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabspark.llm import chat, decontaminate, fingerprint, language, lean, lm, mixing, ngram_join, tokens, toxicity, warc
from tabspark.llm.store import new_path
from tabspark.llm.text import set_hash, shingle_sets, word_hashes, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, size string"


def docs(spark, texts, lang=None, source=None):
    """Rows with extra columns whose names the operators use themselves."""
    rows = [(i, t, lang[i] if lang else "en", source[i] if source else "s", len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, vocabulary=300):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(n))


def shingles(text, k):
    w = words(text.encode()) if text else []
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(texts, k, percent):
    sets, root = [shingles(t, k) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


# 1: n-gram Jaccard join


@pytest.mark.parametrize("percent", [80, 90])
def test_partenum_loses_no_similar_pair(percent):
    rng = np.random.default_rng(5)
    for size in [*range(1, 40), 55, 80, 130, 260, 700, 2500]:
        for _ in range(12):
            most = (100 - percent) * 2 * size // (100 + percent)
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            out, new = (int(x) for x in (rng.integers(0, most + 1), 0))
            new = max(0, most - out - int(rng.integers(0, 2)))
            b = np.unique(np.concatenate([rng.permutation(a)[out:], rng.integers(0, 2**63, new).astype(np.uint64)]))
            i = len(np.intersect1d(a, b))
            if len(b) and 100 * i >= percent * (len(a) + len(b) - i) and (len(a) != len(b) or (a != b).any()):
                assert np.intersect1d(ngram_join.signatures(a, percent), ngram_join.signatures(b, percent)).size, (size, len(b))


def test_profiles_never_overstate_a_difference():
    rng = np.random.default_rng(5)
    for n, m in [(1, 1), (100, 120), (127, 128), (255, 256), (1000, 1100), (4000, 4200), (4000, 900), (20_000, 17_000)]:
        f = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        g = np.unique(np.concatenate([f[: min(n, m) * 9 // 10], rng.integers(0, 1 << 64, max(1, m - min(n, m) * 9 // 10), dtype=np.uint64)]))
        p, q = ngram_join._profile(f), ngram_join._profile(g)
        assert [len(p), len(q)] == ngram_join._cells(np.array([len(f), len(g)])).tolist()
        apart = len(np.setxor1d(f, g))
        assert apart // 3 <= ngram_join._least_apart(p[None], q[None])[0] <= apart
        assert ngram_join._least_apart(p[None], p[None])[0] == 0
    crowded = np.arange(300, dtype=np.uint64)  # all in one part of the domain: its number is at the bound, so nothing is known
    assert ngram_join._least_apart(ngram_join._profile(crowded)[None], ngram_join._profile(f)[None])[0] == 0


@pytest.mark.parametrize("k, percent, crowd", [(3, 90, 32), (3, 90, 2), (5, 80, 3)])
def test_join_agrees_with_all_pairs(spark, monkeypatch, k, percent, crowd):
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    rng = random.Random(percent)
    texts = [prose(rng, rng.choice([1, 2, 3, 6, 12, 40, 150])) for _ in range(40)]
    for _ in range(120):
        w = rng.choice(texts[:40]).split()
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    hub = prose(rng, 200).split()  # many sets near one, most of them not near each other
    for _ in range(60):
        w = list(hub)
        for _ in range(rng.choice([1, 3, 6])):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [None, "", " \n", "a", "a", "A b", "a  b"]
    got = {r.doc_id: r for r in ngram_join.similar_documents(docs(spark, texts), k, percent).collect()}
    sizes, want = components([t or "" for t in texts], k, percent)
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == want


def test_join_of_odd_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (5, "a b c d"), (5, "x y z u"), (9, "x y z u"), (7, None)]
    got = ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got if r.doc_id) == [(1, 1), (1, 1), (5, 1), (5, 1), (7, 7), (9, 1)]
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert ngram_join.similar_documents(docs(spark, []), 3, 90).count() == 0


# 2: mixing


def water(sizes, weights, total, most):
    """Targets by repeated capping."""
    left, target = sum(sizes) * total, {}
    free = [i for i in range(len(sizes))]
    while True:
        share = (left - sum(target.values())) / max(1e-12, sum(weights[i] for i in free)) if free else 0
        over = [i for i in free if share * weights[i] > most * sizes[i] + 1e-9]
        if not over:
            return [target.get(i, share * weights[i]) for i in range(len(sizes))]
        for i in over:
            target[i] = most * sizes[i]
        free = [i for i in free if i not in over]


def test_mix(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.choice([0, 1, 5, 30, 100])) for _ in range(600)] + [None]
    source = [rng.choice(["b", "a", "C", None, "é", "b", "b", "b"]) for _ in texts]
    df = docs(spark, texts, source=source)
    mixed = lambda: sorted(mixing.mix(df, F.lit(1.0)).select("doc_id", "source", "size", "source_size", "target", "taken").collect())
    rows = {r.doc_id: r for r in mixed()}
    assert len(rows) == len(texts) and [rows[i] for i in sorted(rows)] == [r for r in mixed()]
    names = sorted({s for s in source if s is not None}) + [None]
    size = {n: sum(len((t or "").split()) for t, s in zip(texts, source, strict=True) if s == n) for n in names}
    want = water([size[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2.0)
    for n, target in zip(names, want, strict=True):
        own = [r for r in rows.values() if r.source == n]
        assert all(r.source_size == size[n] and math.isclose(r.target, target) for r in own)
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own)
        assert all(r.taken in (0, r.size, 2 * r.size) for r in own)
    assert mixing.mix(docs(spark, []), F.lit(1.0)).count() == 0
    twice = df.union(df).where("doc_id < 50")
    assert mixing.mix(twice, F.lit(None).cast("double")).count() == 100


def test_better_documents_are_taken_more_often(spark):
    df = docs(spark, ["a b"] * 4000, source=["s"] * 4000)
    out = mixing.mix(df, F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0), (1,), 0.3).groupBy(F.col("doc_id") % 2).agg(F.sum("taken")).collect()
    taken = dict(map(tuple, out))
    assert taken[0] > 2.5 * taken[1] and taken[0] + taken[1] in range(2396, 2405)


# 3: language


WORDS = {"en": "the of and that was with they house water", "de": "der und nicht das ist schule zeit über", "fr": "les des que était avec pour château être", "es": "los que para más ciudad niño está"}


def written(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def test_language(spark):
    rng = random.Random(1)
    langs = [rng.choice([*WORDS]) for _ in range(400)]
    texts = [written(rng, a, rng.choice([6, 30])) for a in langs]
    df = docs(spark, texts, lang=langs)
    assert language.family_of("es") == "romance" and language.family_of("xx") == "xx"
    odd = docs(spark, [*texts, None, "", "123 !?", texts[0]], lang=[*langs, "en", "en", "en", "en"])
    rows = language.identify(odd, df.where("doc_id < 250")).orderBy("doc_id").collect()
    assert set(rows[0].asDict()) == set(odd.columns) | {"lang_pred"}
    held = [r for r in rows[250:400]]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert [(r.lang_pred, r.score) for r in rows[400:403]] == [("und", 0.0)] * 3
    assert (rows[403].lang_pred, rows[403].score) == (rows[0].lang_pred, rows[0].score) and all(0 <= r.score <= 1 for r in rows)
    nothing = language.identify(df, df.where("lang is null")).first()
    assert (nothing.lang_pred, nothing.score) == ("und", 0.0)
    assert language.identify(docs(spark, []), df).count() == 0


# 4: WARC


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é" + "x" * 1000
    rows = [(1, "http://a", big), (5, None, big), (3, "http://b\r\nX: y", big), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", big), (5, "again", big), (8, "u", "\r\n\r\nWARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    index = warc.archive_pages(spark, pages, folder := new_path(spark, "test"))
    got = warc.read_by_offset(index).collect()
    assert len(got) == len(rows)
    for page_id, _, html in rows:
        data = (html or "").encode()
        own = [r for r in got if r.page_id == page_id]
        assert {(r.payload_bytes, r.payload_digest) for r in own} == {(len(data), hashlib.sha1(data).hexdigest())}
        revisit = html == big and page_id != 5
        assert {(r.record_type, r.refers_to) for r in own} == {("revisit", 5) if revisit else ("response", None)}
    entries = index.collect()
    fs, path = warc._fs(f"{folder}/warc")
    for archive in {e.archive for e in entries}:  # the sidecar has the same, and each member stands alone
        side = fs.open_input_stream(warc._fs(archive)[1] + ".idx").read().decode().splitlines()
        own = sorted((e.offset, e.length) for e in entries if e.archive == archive)
        assert len(side) == len(own) and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
        assert b"".join(warc.inflate(archive)).count(b"WARC/1.1\r\nWARC-Type") == len(own)
    assert warc.read_by_offset(warc.archive_pages(spark, pages.limit(0), new_path(spark, "test"))).count() == 0


def test_inflating_in_pieces(tmp_path):
    data = [warc.build_record(i, None, bytes(random.Random(i).randbytes(300_000)), "00" * 20, None) for i in range(8)]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    (tmp_path / "one.gz").write_bytes(z.compress(b"".join(data)) + z.flush())
    assert [d for _, d in warc.records(warc.inflate(str(tmp_path / "one.gz")))] == data
    (tmp_path / "bad.gz").write_bytes((tmp_path / "one.gz").read_bytes()[:-9000])
    with pytest.raises(ValueError):
        list(warc.records(warc.inflate(str(tmp_path / "bad.gz"))))


# 5: decontamination


def test_decontamination(spark):
    rng = random.Random(8)
    items = [prose(rng, n, 5000) for n in (3, 5, 9, 30, 80, 150, 400)] + [None, "", prose(rng, 30, 5000)]
    texts = [prose(rng, rng.choice([3, 50, 900]), 5000) for _ in range(60)]
    for n, item in enumerate(items[1:7]):
        w = item.split()
        texts[n] = f"{texts[n]} {item.upper()} tail"
        texts[n + 10] += " " + " ".join(w[: int(len(w) * 0.9)])  # most of it
        texts[n + 20] += " " + " ".join(w[: len(w) // 2])  # too little
        w[len(w) // 2] = "changed"
        texts[n + 30] = " ".join(w) + " " + texts[n + 30]
        texts[n + 40] = " ".join(w[: len(w) // 2]) + " " + texts[n + 40] + " " + " ".join(w[len(w) // 2 :])
    texts += [items[0], None, ""]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    want = set()
    for i, t in enumerate(texts):
        for j, q in enumerate(items):
            a, b = shingles(q, 5), shingles(t, 5)
            if a and len(a & b) >= 0.8 * len(a):
                want.add((i, j, len(a), len(a & b)))
    assert got == want and len(want) >= 14
    assert decontaminate.contaminated(docs(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs(spark, []), bench).count() == 0


# 6: toxicity


def test_toxicity(spark):
    rng = random.Random(2)
    bad = ["horrible", "nastiness", "vilest"]

    def text(toxic):
        w = prose(rng, rng.choice([20, 200])).split()
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(bad) + rng.choice(["", "ly", ".", "s"])
        return " ".join(w)

    marks = [rng.random() < 0.3 for _ in range(400)]
    df = docs(spark, [text(m) for m in marks])
    labels = spark.createDataFrame([(i, int(m), 0) for i, m in enumerate(marks)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(df, labels.where("doc_id < 250").union(labels.limit(3)).union(spark.createDataFrame([(None, 1, 0), (2, None, 0)], labels.schema)))
    rows = toxicity.score(df, model).orderBy("doc_id").collect()
    assert sum(r.predicted == int(m) for r, m in zip(rows[250:], marks[250:], strict=True)) >= 147
    odd = toxicity.score(docs(spark, [None, "", " ", "plain w1 w2", "w1 horribel w2", "w3 horrrible w2", "w1 " * 30000 + "HORRIBLE"]), model).orderBy("doc_id").collect()
    assert [r.predicted for r in odd[:4]] == [0] * 4 and odd[0].score == odd[1].score == odd[2].score
    assert odd[5].predicted == 1 and odd[6].predicted == 1 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd)
    untrained = toxicity.score(df, toxicity.fit(df, labels.where("toxic = 0"))).first()
    assert untrained.predicted == 0
    assert toxicity.score(docs(spark, []), model).count() == 0


def test_toxic_words_behind_the_first_bytes_of_a_run(spark):
    rng = random.Random(2)
    marks = [rng.random() < 0.3 for _ in range(300)]
    df = docs(spark, [prose(rng, 40) + (" " + rng.choice(["horrible", "nastiness"]) if m else "") for m in marks])
    model = toxicity.fit(df, spark.createDataFrame([(i, int(m)) for i, m in enumerate(marks)], "doc_id long, toxic int"))
    clean = prose(rng, 60)
    runs = ["_".join(clean.split()), "".join(clean.split()), "x" * 70_000]
    texts = [*runs, runs[0] + "_horrible", runs[1] + "horrible" + runs[1], runs[2] + "nastiness", runs[2] + "/horrible/" + "x" * 200]
    assert [r.predicted for r in toxicity.score(docs(spark, texts), model).orderBy("doc_id").collect()] == [0, 0, 0, 1, 1, 1, 1]


def test_toxicity_gradients_agree_with_finite_differences():
    rng = random.Random(4)
    texts = [(prose(rng, rng.choice([1, 2, 9])) + x).encode() for x in ("", " vile", "", " vilest", " no") for _ in range(3)]
    y = np.array([b"vile" in t for t in texts], float)
    lessons, weight, model = toxicity.Lessons(texts), np.full(len(texts), 1 / len(texts)), toxicity.Model()
    model.bias = -1.0
    for sharp in (1.0, 3.0):
        _, by_embedding, by_out, by_bias = model.gradients(lessons, y, weight, sharp)
        loss = lambda: model.gradients(lessons, y, weight, sharp)[0]
        for array, gradient in ((model.embedding, by_embedding), (model.out, by_out)):
            for place in zip(*np.unravel_index(np.argsort(-np.abs(gradient), axis=None)[:: max(1, gradient.size // 9)][:6], gradient.shape), strict=True):
                kept, step = array[place], 1e-5
                array[place] = kept + step
                up = loss()
                array[place] = kept - step
                assert math.isclose((up - loss()) / (2 * step), gradient[place], rel_tol=1e-4, abs_tol=1e-8)
                array[place] = kept
        kept = model.bias
        model.bias = kept + 1e-5
        up = loss()
        model.bias = kept - 1e-5
        assert math.isclose((up - loss()) / 2e-5, by_bias, rel_tol=1e-4)
        model.bias = kept


def test_toxicity_trains_in_bounded_memory():
    import tracemalloc

    rng = random.Random(17)
    lessons = toxicity.Lessons([" ".join(rng.choices([f"w{i}" for i in range(500)], k=5000)).encode() for _ in range(200)])
    model, y, weight = toxicity.Model(), np.arange(200) % 3 == 0, np.full(200, 1 / 200)
    tracemalloc.start()
    model.gradients(lessons, y.astype(float), weight)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(lessons.words) == 1_000_000 and len(lessons.texts) > 10
    assert peak < 40e6  # a million windows as doubles are 8 MB, and so are the embeddings' gradients


def test_toxicity_embeddings_have_many_dimensions():
    rng = random.Random(5)
    texts = [(prose(rng, 30) + (" vile" if i % 3 == 0 else "")).encode() for i in range(60)]
    model = toxicity.Model().fit(texts, np.arange(60) % 3 == 0)
    values = np.linalg.svd(model.embedding[np.unique(toxicity.Lessons(texts).cells)], compute_uv=False)
    assert values[1] > 0.02 * values[0] and (values > 1e-3 * values[0]).all()
    assert (model.logit(texts) > 0).tolist() == [i % 3 == 0 for i in range(60)]
    assert model.logit([b"w1 vilee w2"]) > model.logit([b"w1 tree w2"])  # shares n-grams with what was learnt


def test_toxicity_scores_dont_depend_on_where_a_text_stands():
    rng = random.Random(6)
    by_bucket = np.random.default_rng(1).normal(size=toxicity.BUCKETS)
    texts = [prose(rng, rng.choice([0, 1, 5, 80])).encode() for _ in range(200)]
    alone = [next(toxicity.word_scores([t], by_bucket)) for t in texts]
    assert all(np.allclose(a, b) for a, b in zip(alone, toxicity.word_scores(texts, by_bucket), strict=True))
    long = b" ".join(texts * 200)
    assert len(long) > 2 * toxicity.CHUNK
    got = next(toxicity.word_scores([long], by_bucket))
    assert len(got) == 200 * sum(map(len, alone)) and np.allclose(got[: sum(map(len, alone))], np.concatenate(alone))


# 7: tokens


def test_token_counts(spark):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    alphabet = ["a", "b", "the", " ", "  ", "\n", "\n\n", "\t", "é", "日本", "😀", "▁", "</s>", "<s>", "<unk>", "<0x0A>", "1", "23", "'", "un", "ing", " ", "　", "ß", "\x00", "$$$", "0000000", "\r\n"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)] + [" ", "\n", "   ", "▁▁", "x" * 3000, "ab" * 2000, " " * 300, None, ""]
    rows = tokens.count_tokens(docs(spark, texts), path, limit=50).orderBy("doc_id").collect()
    want = [len(x) for x in sp.encode([t or "" for t in texts])]
    assert [r.n_tokens for r in rows] == want
    assert [r.n_bytes for r in rows] == [len((t or "").encode()) for t in texts]
    assert [r.over_limit for r in rows] == [n > 50 for n in want]
    assert tokens.count_tokens(docs(spark, []), path).count() == 0


# 8: chat


def test_chat_round_trip(spark):
    rng = random.Random(6)
    pieces = ["hi", " ", "\n", "<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[TEXT]", "[ROLE]", "\\", "\\\\", "é", "😀", ""]
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 8)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool", "[INST] x", "", None]), rng.choice([None, "".join(rng.choice(pieces) for _ in range(rng.randrange(8)))])))
    rows += [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (7, 0, "user", "again"), (7, 0, "user", "again")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int").repartition(5)
    for part_bytes in (1, 4 << 20):
        parts = chat.format_chat(df, part_bytes)
        got = {r.conv_id: r for r in chat.read_back(parts).collect()}
        for c in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
            loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
            text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
            assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256(text.encode()).hexdigest()), c
            assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
            formatted = "".join(p.text for p in sorted(parts.where(F.col("conv_id").eqNullSafe(F.lit(c))).collect(), key=lambda p: p.part)) if c in (0, 1, None) else None
            assert formatted is None or (len(formatted) == got[c].formatted_chars and formatted.startswith("<s>"))
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0


# 9: language model


class PlainModel:
    """Counts of n-grams of up to three tokens in dictionaries, nothing pruned."""

    def __init__(self, read):
        self.c, self.history = Counter(), Counter()
        for r in read:
            s = ["<begin>", *r]
            self.c.update((w,) for w in r)
            for n in (2, 3):
                self.c.update(tuple(s[i - n + 1 : i + 1]) for i in range(n - 1, len(s)))
            self.history["<begin>",] += 1
        self.history.update({k: x for k, x in self.c.items() if len(k) < 3})
        self.n, self.v = sum(map(len, read)), sum(len(k) == 1 for k in self.c)

    def p(self, history, w):
        if not history:
            return (self.c[w,] + 0.1) / (self.n + 0.1 * (self.v + 1))
        return (self.c[*history, w] + lm.PRIOR * self.p(history[1:], w)) / (self.history[history] + lm.PRIOR)

    def score(self, r):
        s = ["<begin>", *r]
        return sum(math.log10(self.p(tuple(s[max(0, i - 2) : i]), s[i])) for i in range(1, len(s)))


@pytest.mark.parametrize("sizes", [{}, {"bucket_bytes": 500, "block_tokens": 300, "part": 7}, {"bucket_bytes": 1 << 40, "block_tokens": 1, "part": 1}])
def test_scores_agree_with_a_plain_model(spark, sizes):
    rng = random.Random(9)
    texts = [prose(rng, rng.choice([1, 20, 80]), 60) for _ in range(100)] + [None, "", "new words only", prose(rng, 30).upper(), "a b", "a b", prose(rng, 3000, 40)]
    df = docs(spark, texts)
    df = df.unionByName(df.where("doc_id = 3")).unionByName(df.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    train = ~lm.held_out(F.col("doc_id"), 10)
    rows = lm.score_documents(df, train, **sizes).collect()
    read = [[*words((t or "").encode()), "<end>"] for t in texts]
    learnt = lambda i: zlib.crc32(str(i).encode()) % 10 != 0
    model = PlainModel([r for i, r in enumerate(read) if learnt(i)] + ([read[3]] if learnt(3) else []))
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted([*range(len(texts)), 3])
    for r in rows:
        t = read[4 if r.doc_id is None else r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(model.c[w,] > 0 for w in t), model.n)
        assert math.isclose(r.base_score, sum(math.log10(model.p((), w)) for w in t), rel_tol=1e-9)
        assert math.isclose(r.score, model.score(t), rel_tol=1e-9)
    some = [k for k in model.history if k[-1] != "<end>"][::40]
    for h in some:  # each state's probabilities of all words, and of one never seen, sum to 1
        total = sum(model.p(h, k[0]) for k in model.c if len(k) == 1) + model.p(h, "never")
        assert math.isclose(total, 1.0, rel_tol=1e-6)


def test_scores_without_lessons_or_documents(spark):
    assert lm.score_documents(docs(spark, []), ~lm.held_out(F.col("doc_id"), 10)).count() == 0
    alone = lm.score_documents(docs(spark, ["a b"]), F.lit(False)).first()
    assert (alone.n_tokens, alone.n_known, alone.train_tokens, alone.base_score, alone.score) == (3, 0, 0, 0.0, 0.0)


def test_what_occurs_once_keeps_its_arc_beside_millions(spark):
    texts = ["w " * 1_500_000, "w " * 2_500_000, "rare pair", "pair rare", "rare pair"]
    found = {r.doc_id: r for r in lm.score_documents(docs(spark, texts), F.col("doc_id") < 4).collect()}
    model = PlainModel([["w", "<end>"], ["rare", "pair", "<end>"], ["pair", "rare", "<end>"]])
    model.c["w",], model.c["<end>",], model.history["<begin>",], model.n = 4_000_000, 4, 4, 4_000_008
    assert found[0].n_tokens == 1_500_001 and found[0].train_tokens == model.n
    assert math.isclose(found[4].base_score, sum(math.log10(model.p((), w)) for w in ("rare", "pair", "<end>")), rel_tol=1e-9)
    assert math.isclose(found[4].score, model.score(["rare", "pair", "<end>"]), rel_tol=1e-9)


def test_automaton_follows_chains_of_failures():
    read = [["a", "b", "c", "<end>"], ["a", "b", "d", "<end>"], ["b", "e", "<end>"]]
    model = PlainModel(read)
    number = {w: np.uint64(10 + i) for i, w in enumerate("abcdez")} | {"<end>": lm.END}
    unknown = ["a", "b", "e", "a", "z", "b", "c", "<end>"]
    parts = [(i, i, i < 3, 1, np.array([lm.BEGIN, *(number[w] for w in r)], np.uint64)) for i, r in enumerate([*read, unknown])]
    block = lm.Block.of(parts)
    grams = lm.Grams(block)
    rows, _, _, n, known, _, score = lm.score_block(block, grams.counts()[grams.order], model.n, model.v)
    assert [*rows] == [0, 1, 2, 3] and [*n] == [4, 4, 3, 8] and known[3] == 7
    assert np.allclose(score, [model.score(r) for r in [*read, unknown]])
    automaton = lm.Automaton.of(block, grams, grams.counts()[grams.order], model.n, model.v)
    v = len(block.words)
    assert (automaton.fail[1 + v :] > 0).any() and (automaton.fail[1 : 1 + v] == 0).all()  # pairs fail to words, words to the root


# 10: fingerprints


def plain_tokens(text):
    t = [x for x in text.replace("\t", " ").replace("\n", " ").split(" ") if x]
    return list(text) if len(t) < fingerprint.FEW_WORDS else t


def test_fingerprints(spark):
    rng = random.Random(11)
    texts = [prose(rng, rng.choice([3, 50, 400])) for _ in range(40)] + [None, "", "a", "ab", "word " * 500, "日本語" * 40, "same text here", "same text here"]
    df = docs(spark, texts).repartition(4)
    rows = fingerprint.edits(df).orderBy("doc_id").collect()
    plain = [t or "" for t in texts]
    for i, r in enumerate(rows):
        t, q = plain[i], len(plain[i]) // 4
        edited = t[: len(t) - q] + plain[(i + 1) % len(plain)][:q]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest()), i
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if edited == t:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1.0
    assert rows[-1].fingerprint == rows[-2].fingerprint and rows[-2].near_next == 1.0
    long = [r for r, t in zip(rows[:40], plain, strict=False) if len(t) > 300]
    assert np.mean([r.near_edited for r in long]) > 0.3 > 0.1 > np.mean([r.near_next for r in long])
    odd = spark.createDataFrame([(3, "a b c"), (3, "a b d"), (None, "abcdefgh"), (8, "x" * 8)], "doc_id long, text string")
    got = {(r.doc_id, r.edited_sha256) for r in fingerprint.edits(odd).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {(3, sha("a b x")), (None, sha("abcdef")), (8, sha("x" * 6 + "a "))}
    assert fingerprint.edits(docs(spark, [])).count() == 0


def test_fingerprints_follow_order_and_occurrence(spark):
    rng = random.Random(12)
    w = [f"u{i}" for i in range(600)]
    blocks = [w[i : i + 60] for i in range(0, 600, 60)]
    rng.shuffle(blocks)
    moved, cut = " ".join(x for b in blocks for x in b), " ".join(w[:540])
    df = spark.createDataFrame([(0, " ".join(w)), (1, moved), (2, cut), (3, "a b " * 40), (4, "a b " * 80)], "doc_id long, text string")
    s = {r.doc_id: r.signature for r in fingerprint.fingerprint(df).collect()}
    alike = lambda a, b: len(set(s[a]) & set(s[b])) / len({x >> 32 for x in s[a]} | {x >> 32 for x in s[b]})
    assert alike(0, 2) > 0.6 and alike(0, 1) < alike(0, 2) - 0.15  # the same words moved are less alike than nine tenths of them
    assert s[3] != s[4]


def test_the_signature_is_that_of_the_definition(spark):
    rng = random.Random(13)
    texts = [prose(rng, n, 12) for n in (9, 30, 200)]
    for text, r in zip(texts, fingerprint.fingerprint(docs(spark, texts)).orderBy("doc_id").collect(), strict=True):
        t = plain_tokens(text)
        pairs = spark.createDataFrame([(i, x, t[i + 1] if i + 1 < len(t) else None) for i, x in enumerate(t)], "i int, a string, b string")
        h = [x.h for x in pairs.select("i", F.shiftrightunsigned(F.xxhash64("a", "b"), 21).alias("h")).orderBy("i").collect()]
        seen: Counter = Counter()
        numbered = []
        for i, x in enumerate(h):
            numbered.append((i, x, seen[x]))
            seen[x] += 1
        e = spark.createDataFrame(numbered, "i int, h long, o int").select("i", F.shiftrightunsigned(F.xxhash64("h", "o"), 21).alias("e")).collect()
        parts = []
        for b in range(32):
            least = sorted((x.e, x.i) for x in e if x.e >> 38 == b)[:2]
            if least:
                parts.append((b, [x for x, _ in sorted(least, key=lambda y: y[1])]))
        hashed = spark.createDataFrame([(b, p[0], p[1] if len(p) > 1 else None) for b, p in parts], "b long, x long, y long")
        want = hashed.select(F.shiftleft("b", 32).bitwiseOR(F.when(F.col("y").isNull(), F.xxhash64("x")).otherwise(F.xxhash64("x", "y")).bitwiseAND(F.lit(0xFFFFFFFF)))).collect()
        assert sorted(r.signature) == sorted(x[0] for x in want)


# the pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(14)
    langs = [rng.choice([*WORDS]) for _ in range(240)]
    texts = [written(rng, a, 40) + f" {' '.join(f'z{rng.randrange(10**5)}' for _ in range(12))}" for a in langs]
    toxic = set(range(60, 140, 2))
    for i in toxic:
        texts[i] += " horrible"
    item = " ".join(f"q{i}" for i in range(30))
    texts[5] += " " + item
    texts[7] = texts[8]
    texts[10] = texts[11] + " more"
    texts += ["12345 678", None, ""]
    langs += ["en"] * 3
    d = str(tmp_path)
    clean = spark.createDataFrame([(i, t, langs[i], f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    clean.union(clean.where("doc_id = 20")).union(clean.where("doc_id = 21").selectExpr("cast(null as long)", "text", "lang", "source", "n_chars")).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic)) for i in range(240)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert [n for n, _ in P.STAGES] == ["language_id", "toxicity", "near_duplicates", "decontamination", "mixing"]
    rows = P.run(spark, d).collect()
    kept = Counter(r.doc_id for r in rows)
    docs0 = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs0.columns
    for name, stage in P.STAGES:
        after = stage(spark, docs0, d)
        if name != "mixing":
            assert after.columns == columns
        ids = Counter(r.doc_id for r in after.select("doc_id").collect())
        if name == "language_id":
            assert not {240, 241, 242} & set(ids) and len(set(ids)) >= 239
        if name == "toxicity":
            assert len(toxic & set(ids)) <= 2 and len(set(ids)) >= 240 - len(toxic) - 3
        if name == "near_duplicates":
            assert not {8, 11} & set(ids) and {7, 10} <= set(ids) and ids[20] == 1 and ids[None] == 1
        if name == "decontamination":
            assert 5 not in ids and len(set(ids)) == len(set(r.doc_id for r in docs0.collect())) - 1
    assert not ({240, 241, 242, 8, 11, 5} & set(kept)) and len(toxic & set(kept)) <= 2 and all(r.taken > 0 for r in rows)


def test_unlike_sets_of_a_crowd_with_a_common_passage_dont_pair(spark):
    own = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    passage = " ".join(f"p{j}" for j in range(60))
    texts = [own(0, 200), *(f"{passage} {own(i, 140)}" for i in range(1, 61))]
    texts.append(texts[1] + " more")
    sets = list(shingle_sets([t.encode() for t in texts], 5))
    ids = [set_hash(f) for f in sets]
    for f, g in [(sets[1], sets[2]), (sets[1], sets[61]), (sets[0], sets[1])]:
        bits = sum(int(x).bit_count() for x in (ngram_join._odd(f) ^ ngram_join._odd(g)).view(np.uint64))
        assert bits <= len(np.setxor1d(f, g))
    rows = [(ids[0], ids[0], c, len(f), c) for c, f in zip(ids[1:], sets[1:], strict=True)]
    many = spark.createDataFrame(rows, "center long, center_label long, class_id long, n_shingles long, label long")
    stored = ngram_join.class_sets(spark.createDataFrame([(t,) for t in texts], "text string"), 5)
    pairs = [{r.a, r.b} for r in ngram_join._crowd_pairs(many, stored, 80).collect()]
    between = [p for p in pairs if ids[0] not in p]
    assert {ids[1], ids[61]} in between and all(p == {ids[1], ids[61]} for p in between)
    assert all({ids[0], c} in pairs for c in ids[1:])


def test_pipeline_texts_travel_once(spark):
    import corpus_pipeline as P

    for columns in (["text", "row", "c0", "doc_id", "a b"], ["doc_id", "text"], ["text"]):
        rows = [tuple(f"{c} {i}" for c in columns) for i in range(3)] + [(None,) * len(columns)]
        df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))
        wrapped, restore = P._wrapped(df)
        assert wrapped.columns == ["text", "row"] and len(wrapped.schema["row"].dataType) == max(1, len(columns) - 1)
        back = restore(wrapped.mapInArrow(lambda batches: batches, wrapped.schema))
        assert back.columns == columns and sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)


def test_batches_of_texts_are_short():
    batch = pa.RecordBatch.from_pydict({"text": [f"t{i}" for i in range(2 * lean.TEXTS + 1)]})
    seen = []

    def run(batches):
        for b in batches:
            seen.append(b.num_rows)
            yield b

    got = list(lean.lean(run)(iter([batch, batch.slice(0, 0)])))
    assert seen == [lean.TEXTS, lean.TEXTS, 1, 0] and pa.Table.from_batches(got) == pa.Table.from_batches([batch])
    assert [b.num_rows for b in lean.lean(run, None)(iter([batch]))] == [batch.num_rows]


def test_rows_without_id_are_decontaminated(spark, tmp_path):
    import corpus_pipeline as P

    item = " ".join(f"q{i}" for i in range(30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "before " + item + " after"), (None, "clean text of its own"), (3, item), (4, "clean too"), (None, None)]
    kept = P.decontaminated(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)


def test_shingles_as_defined():
    assert [len(f) for f in shingle_sets([b"A b\tc\x0bd a b c", "é x".encode(), b" \n", None], 3)] == [4, 1, 0, 0]


def test_hashes_of_words_dont_depend_on_where_they_stand():
    rng = random.Random(1)
    vocabulary = ["é", "x" * 65, "y" * 200, "A", "ab", "ba", *(f"w{i}" for i in range(50))]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 7, 300]))) for _ in range(300)]
    long = " ".join(rng.choices(vocabulary, k=400_000))
    run = "Z" * 2_500_000
    texts += [long, f"{run} tail {run}", f"a {run}", run + "\n" + long, None, " " * 2_200_000]
    seen = {}
    for t, h in zip(texts, word_hashes(None if t is None else t.encode() for t in texts), strict=True):
        w = words((t or "").encode())
        assert len(w) == len(h)
        assert all(seen.setdefault(a, b) == b for a, b in zip(w, h.tolist(), strict=True))
    assert len(set(seen.values())) == len(seen)
