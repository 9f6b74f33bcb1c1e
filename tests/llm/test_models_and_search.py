"""Operators 1, 3, 4, 5, 6, 8 and 10: brute force, exact round trips, held-out accuracy."""

import math
import os
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm_cases import docs, empty, plan_text, rows  # noqa: F401  (fixtures)
from pitchside.llm import attention_mil, bpe_trie, centroid_langid, hypergeometric_shards, joins, positional_index, queries, rp_forest, suffix_tree, text

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.01"
REPO = os.path.dirname(bpe_trie.__file__).removesuffix("/pitchside/llm")


def held(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def test_suffix_tree_matches_brute_force(docs, rows, empty, monkeypatch):
    marked = docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1)
    texts = [(i, (t or "").encode().translate(LOWER).split() + [0], held(i, 5) == 1) for i, t in rows]
    one, two, three = Counter(), Counter(), Counter()
    for _, w, out in texts:
        if not out:
            one.update(w)
            two.update(zip(w, w[1:], strict=False))
            three.update(zip(w, w[1:], w[2:], strict=False))
    n, v, k = sum(one.values()), len(one), suffix_tree.KAPPA
    root = lambda x: (one[x] + 0.5) / (n + 0.5 * (v + 1))
    g1, g2 = defaultdict(float), defaultdict(float)
    for _, w, out in texts:
        for t in range(1, 0 if out else len(w)):
            p1 = (two[w[t - 1], w[t]] - 1 + k * root(w[t])) / (one[w[t - 1]] - 1 + k)
            g1[w[t - 1]] += math.log(p1 / root(w[t]))
            if t > 1:
                s = (w[t - 2], w[t - 1])
                g2[s] += math.log((three[*s, w[t]] - 1 + k * p1) / (two[s] - 1 + k) / p1)
    states = {s for s, g in g1.items() if one[s] > 1 and g > suffix_tree.GAIN} | {s for s, g in g2.items() if two[s] > 1 and g > suffix_tree.GAIN}
    want = defaultdict(list)
    for i, w, out in texts:
        base = score = 0.0
        for t, x in enumerate(w):
            p = root(x)
            base += math.log10(p)
            if t and w[t - 1] in states:
                p = (two[w[t - 1], x] + k * p) / (one[w[t - 1]] + k)
            if t > 1 and (w[t - 2], w[t - 1]) in states:
                p = (three[w[t - 2], w[t - 1], x] + k * p) / (two[w[t - 2], w[t - 1]] + k)
            score += math.log10(p)
        want[i].append((out, len(w), sum(one[x] > 0 for x in w), n, base, score))
    for small_chunks in (False, True):   # the totals do not depend on how texts fall into chunks
        if small_chunks:
            monkeypatch.setattr(suffix_tree, "CHUNK_BYTES", 20_000)
        got = suffix_tree.score_documents(marked).collect()
        assert len(got) == len(rows)
        for r in got:
            assert any(tuple(r[1:5]) == x[:4] and r.base_score == pytest.approx(x[4], rel=1e-9) and r.score == pytest.approx(x[5], rel=1e-4) for x in want[r.doc_id]), r
    assert suffix_tree.score_documents(empty.withColumn("held_out", F.lit(False))).count() == 0
    nothing = suffix_tree.score_documents(marked.withColumn("held_out", F.lit(True))).first()
    assert nothing.train_tokens == 0 and nothing.score == 0


def test_suffix_tree_totals_beyond_32_bits_and_large_divergences():
    keys = np.array([5, 9], np.uint64)

    def total(kind, *counts):
        asked = [{"chunk": i, "kind": kind, "part": 0, "keys": suffix_tree._pack_keys(keys), "counts": suffix_tree.pack(np.array(c, suffix_tree._count_type(kind)))} for i, c in enumerate(counts)]
        return suffix_tree._total(pa.Table.from_pylist(asked)).to_pylist()

    found = total(0, [3_000_000_000, 1], [2_000_000_000, 0])
    assert [suffix_tree.unpack(r["answers"], suffix_tree._answer_type(0)).tolist() for r in found] == [[5_000_000_000, 1]] * 2
    assert (found[0]["n"], found[0]["v"]) == (5_000_000_001, 2)
    found = total(suffix_tree.RETAINED + 1, [70_000.0, 2.0001], [-69_990.0, -0.0002])
    assert [suffix_tree.unpack(r["answers"], suffix_tree._answer_type(suffix_tree.RETAINED + 1)).tolist() for r in found] == [[1, 0]] * 2


def test_suffix_tree_of_long_contexts_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    near = "b c d e f".split()
    texts = []
    for i in range(90):   # what follows "b c d e f" depends on the word six places back
        w = [f"x{k}" for k in rng.integers(0, 6, 4)]
        first = ["p", "q", "r"][i % 3]
        texts.append((i, w + [first, *near, first + "end"] + [f"x{k}" for k in rng.integers(0, 6, 3)], i % 5 == 0))
    texts += [(100 + i, [f"w{k}" for k in range(30)], False) for i in range(4)]
    depth, k = 10, suffix_tree.KAPPA
    grams = Counter()
    tokens = [(i, [*w, 0], out) for i, w, out in texts]
    for _, w, out in tokens:
        if not out:
            grams.update(tuple(w[t:t + m]) for m in range(1, depth + 2) for t in range(len(w) - m + 1))
    n, v = sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)
    root = lambda x: (grams[x,] + 0.5) / (n + 0.5 * (v + 1))
    gain = defaultdict(float)
    for _, w, out in tokens:
        for t in range(0 if out else len(w)):
            p = root(w[t])
            for m in range(1, min(depth, t) + 1):
                s = tuple(w[t - m:t])
                if grams[s] >= 2:
                    q = (grams[*s, w[t]] - 1 + k * p) / (grams[s] - 1 + k)
                    gain[s] += math.log(q / p)
                    p = q
    states = {s for s, g in gain.items() if g > suffix_tree.GAIN}
    assert ("p", *near) in states and max(map(len, states)) > 5
    want = {}
    for i, w, _ in tokens:
        want[i] = 0.0
        for t, x in enumerate(w):
            p = root(x)
            for m in range(1, min(depth, t) + 1):
                s = tuple(w[t - m:t])
                if s in states:
                    p = (grams[*s, x] + k * p) / (grams[s] + k)
            want[i] += math.log10(p)
    df = spark.createDataFrame([(i, " ".join(w), out) for i, w, out in texts], "doc_id long, text string, held_out boolean").repartition(3)
    got = {r.doc_id: r.score for r in suffix_tree.score_documents(df, max_context=depth).collect()}
    assert got == {i: pytest.approx(x, rel=1e-9) for i, x in want.items()}


def test_suffix_tree_rounds_read_the_last_answers_alone(spark, monkeypatch):
    """A round of counts gets one level of answers back, and an n-gram's share of a divergence is sent by one chunk."""
    df = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(12)), False) for i in range(6)], "doc_id long, text string, held_out boolean").repartition(3)
    got, plain_round = [], suffix_tree._round

    def watch(chunks, replies, ask, levels, parts):
        out = plain_round(chunks, replies, ask, levels, parts)
        if getattr(ask, "__name__", ask) == "ask_counts" and levels != [1, 2]:
            got.append((levels[0], {r.kind for r in replies.select("kind").distinct().collect()}))
        return out

    monkeypatch.setattr(suffix_tree, "_round", watch)
    assert len({r.score for r in suffix_tree.score_documents(df, max_context=4).collect()}) == 1
    assert [m for m, _ in got] == [3, 4, 5]
    assert all(kinds - {0} == {m - 2, suffix_tree.ASKED} and (m == 3 or 0 not in kinds) for m, kinds in got)
    asked = pa.Table.from_pylist([{"chunk": i, "kind": 3, "part": 0, "keys": suffix_tree._pack_keys(np.array([5, 9], np.uint64)),
                                   "counts": suffix_tree.pack(np.array(c, np.uint32))} for i, c in enumerate([[0, 1], [2, 1], [3, 0]])])
    sends = [np.unpackbits(np.frombuffer(r["sends"], np.uint8), count=2).tolist() for r in suffix_tree._total(asked).to_pylist()]
    assert sends == [[0, 1], [1, 0], [0, 0]]


def test_suffix_tree_beats_its_base_on_held_out_text(spark):
    got = queries.op1_suffix_tree(spark, SMALL).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_language_of_held_out_documents(spark):
    truth = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    got = queries.op3_centroid_langid(spark, SMALL).join(truth, "doc_id").filter("held_out").collect()
    assert len(got) > 200 and np.mean([r.lang_pred == r.lang for r in got]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark, docs, empty, rows):
    model = centroid_langid.fit(docs.withColumn("lang", F.when(F.col("doc_id") < 40, "aa").when(F.col("doc_id") < 80, "bb")), "doc_id", "text", "lang")
    got = centroid_langid.predict(docs, model).collect()
    assert len(got) == len(rows)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.lang_pred)
    assert all(by[i] == {"und"} for i in (9000, 9001, 9002, 9011)) and by[9008] <= {"aa", "bb"}
    assert centroid_langid.predict(empty, model).count() == 0
    none = centroid_langid.fit(empty, "doc_id", "text", "lang")
    assert {r.lang_pred for r in centroid_langid.predict(docs, none).collect()} == {"und"}


def test_trie_bpe_equals_the_library(docs, rows, empty):
    library = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in bpe_trie.encode_documents(docs, TOKENIZER).collect()) == want
    assert bpe_trie.encode_documents(empty, TOKENIZER).count() == 0


def test_trie_bpe_on_every_script():
    library, bpe = Tokenizer.from_file(TOKENIZER), bpe_trie.encoder(TOKENIZER)
    texts = ["".join(chr(c) for c in range(a, a + 64) if not 0xD800 <= c < 0xE000) for a in range(0, 0x11000, 64)]
    texts += ["<|startoftext|>x<|endoftext|>", "<|ENDOFTEXT|>", "ΑΣ Σας", "a\x1cb", "é ́", "x" * 3000, "''s'S"]
    for t, ids in zip(texts, bpe.encode_batch(texts), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(t[:20])
        assert bpe.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_trie_bpe_looks_tokens_up_once_per_beginning():
    """A walk over prefixes met before looks no part of a word up in the vocabulary again."""
    bpe, asked = bpe_trie.TrieBpe(TOKENIZER), []

    class Watched(dict):
        def get(self, *key):
            asked.append(key)
            return super().get(*key)

    bpe.rank = Watched(bpe.rank)
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("aeinrst"), int(n))) for n in rng.integers(1, 14, 2_000)]
    ranks = bpe.encode_words(words)
    first = len(asked)
    assert first and bpe.encode_words(words) == ranks and len(asked) == first
    library = Tokenizer.from_file(TOKENIZER)
    for w in set(words):
        assert [np.frombuffer(bpe.raw_id[r], "<u4")[0] for r in ranks[w]] == library.encode(w, add_special_tokens=False).ids


def test_trie_bpe_keeps_few_words_and_little_memory():
    """An encoder holds as many words as it may, and is read with little more memory than it keeps; a task's end drops the powers."""
    bpe, library = bpe_trie.TrieBpe(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    bpe.cached_words = 100
    for a in range(0, 2_000, 50):
        texts = [f"word{i} and some{i % 7}" for i in range(a, a + 50)]
        for t, ids in zip(texts, bpe.encode_batch(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
        assert len(bpe.ids) + len(bpe.older) < 1_000
    look = ("import re, sys; from pitchside.llm import bpe_trie\n"
            "kb = lambda: int(re.search(r'RssAnon:\\s+(\\d+)', open('/proc/self/status').read())[1])\n"
            "before = kb(); bpe_trie.encoder(sys.argv[1]); print(kb() - before)")
    grown = subprocess.run([sys.executable, "-c", look, TOKENIZER], capture_output=True, text=True, check=True, cwd=REPO).stdout
    assert int(grown.split()[-1]) < 55_000
    text.span_hash(text.prefix_sums(np.zeros(9, np.uint8)), np.array([0]), np.array([9]))
    assert len(text._powers["up"]) > 9
    list(text.blocks(iter([pa.record_batch({"t": ["a"]})]), "t"))
    assert len(text._powers["up"]) == len(text._powers["down"]) == 1


def test_communication_matrix_has_its_margins_and_law():
    rows, cells = [7, 0, 30, 13], [20, 20, 10]
    total = np.zeros((4, 3))
    for seed in range(400):
        m = np.array(hypergeometric_shards.communication_matrix(rows, cells, seed))
        assert m.sum(axis=1).tolist() == rows and m.sum(axis=0).tolist() == cells
        total += m
    assert np.allclose(total / 400, np.outer(rows, cells) / 50, atol=0.35)


def test_exact_draws_have_the_law_whatever_the_total(monkeypatch):
    # Small numbers against the law itself, all by rejection.
    monkeypatch.setattr(hypergeometric_shards, "NUMPY_TOTAL", 0)
    rng = np.random.default_rng(1)
    for good, bad, n in ((5, 7, 4), (30, 11, 25), (1, 40, 20), (400, 300, 350)):
        law = {x: math.comb(good, x) * math.comb(bad, n - x) / math.comb(good + bad, n) for x in range(max(0, n - bad), min(n, good) + 1)}
        for x, p in law.items():
            assert p < 1e-250 or math.isclose(math.exp(hypergeometric_shards._log_law(x, good, bad, n)), p, rel_tol=1e-9)
        seen = Counter(hypergeometric_shards.hypergeometric(rng, good, bad, n) for _ in range(6_000))
        assert set(seen) <= set(law)
        for x, p in law.items():
            assert abs(seen[x] - 6_000 * p) <= 5 * (6_000 * p * (1 - p)) ** 0.5 + 3
    assert hypergeometric_shards.hypergeometric(rng, 5, 0, 3) == 3 and hypergeometric_shards.hypergeometric(rng, 9, 4, 0) == 0
    monkeypatch.undo()
    # Three times 10^9 rows: margins, and mean, spread and shape of one cell.
    m = np.array(hypergeometric_shards.communication_matrix([10**9] * 3, [3 * 10**9 // 8] * 8, 7))
    assert m.sum(axis=1).tolist() == [10**9] * 3 and m.sum(axis=0).tolist() == [375_000_000] * 8
    good, total, n = 1_500_000_000, 3_000_000_000, 10**9
    sd = (n * 0.25 * (total - n) / (total - 1)) ** 0.5
    z = np.array([(hypergeometric_shards.hypergeometric(rng, good, total - good, n) - n / 2) / sd for _ in range(4_000)])
    assert abs(z.mean()) < 0.08 and abs(z.std() - 1) < 0.05 and abs((np.abs(z) < 1).mean() - 0.6827) < 0.03
    for x in (500_000_000, 500_020_000):  # the ratio of neighbours is known exactly
        ratio = (good - x) * (n - x) / ((x + 1) * (total - good - n + x + 1))
        got = hypergeometric_shards._log_law(x + 1, good, total - good, n) - hypergeometric_shards._log_law(x, good, total - good, n)
        assert abs(got - math.log(ratio)) < 1e-8


def test_broadcasts_are_bounded_by_bytes(spark):
    df = spark.range(50).select("id", F.array_repeat(F.lit("x" * 90), 100).alias("texts")).cache()
    hinted = lambda d: "strategy=broadcast" in plan_text(spark.range(9).join(d, "id"))
    assert hinted(joins.broadcast_if_small(df)) and not hinted(joins.broadcast_if_small(df, max_bytes=400_000))
    assert not hinted(joins.broadcast_if_small(df.select("id"), max_rows=49)) and hinted(joins.broadcast_if_small(df.select("id"), max_bytes=1))
    assert hinted(joins.broadcast_if_small(df.filter("id < 0")))


def test_shards_are_even_gapless_and_whole(spark, docs, rows, empty):
    for df, n in ((docs, len(rows)), (spark.range(10_001).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), 10_001)):
        got = hypergeometric_shards.shard_rows(df.select("doc_id", "text"), ["doc_id", "text"], ["doc_id"]).collect()
        assert len(got) == n
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        sizes = [len(slots[s]) for s in range(8)]
        assert max(sizes) - min(sizes) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.05
    assert hypergeometric_shards.shard_rows(empty.select("doc_id", "text"), ["doc_id"], ["doc_id"]).count() == 0


BENCH = [(1, "one two three"), (2, " ".join(f"w{i}" for i in range(20))), (3, ""), (4, None), (5, "ONE, two; Three!"), (None, "lonely words here"),
         (6, "the " * 15), (2, " ".join(f"w{i}" for i in range(20)))]
TEXTS = [(1, "x One two. THREE y"), (2, " ".join(f"w{i}" for i in range(3, 17))), (3, " ".join(f"w{i}" for i in range(3, 15))), (4, None), (5, ""),
         (6, "the " * 20 + "end"), (7, "so lonely words here are"), (8, "a w0 " + " ".join(f"W{i}" for i in range(20)) + " one two three " * 2), (8, "other"),
         (None, "one two three"), (9, "one two")]


def windows(rows, bench):
    import re
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOWER))
    items = [(i, words(t)) for i, t in bench]
    for d, t in rows:
        w, hit, seen = words(t), set(), set()
        for i, x in items:
            k = min(13, len(x))
            grams = {tuple(x[s:s + k]) for s in range(len(x) - k + 1)} if x else set()
            for s in range(len(w) - k + 1) if x else ():
                if tuple(w[s:s + k]) in grams:
                    hit |= set(range(s, s + k))
                    seen.add(i)
        yield d, len(w), len(hit), tuple(sorted(str(i) for i in seen if i is not None))


def test_decontamination_matches_brute_force(spark, empty, docs, rows):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("k1", F.lit("clash")).withColumn("term", F.lit(1))
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in positional_index.decontaminate(df, bench).collect())
    assert got == Counter(windows(TEXTS, BENCH))
    assert positional_index.decontaminate(empty, bench).count() == 0
    real = [(i, t[:400]) for i, t in rows if t and len(t) > 500][:6] + BENCH[:2]
    got = positional_index.decontaminate(docs, spark.createDataFrame(real, "item_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == Counter(windows(rows, real))
    none = positional_index.decontaminate(df, bench.limit(0)).collect()
    assert len(none) == len(TEXTS) and all(r.n_hit == 0 for r in none)
    kept = positional_index.clean_documents(df, bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, n, h, _ in windows(TEXTS, BENCH) if not (h and 20 * h >= n)}
    assert kept.columns == df.columns


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x x beta"), (2, "alpha " + "x " * 40 + "beta"), (3, "beta alpha")], "doc_id long, text string")
    items = positional_index.items_table(spark.createDataFrame([(7, "alpha beta")], "item_id long, text string"))
    index = positional_index.build_index(docs, items)
    near = positional_index.proximity_hits(index, items, 10).join(index.filter("term = ''"), ["k1", "k2"])
    assert {(r.doc_id, r.item_id, r.distance) for r in near.collect()} == {(1, "7", 4), (3, "7", 1)}


def test_items_near_match_brute_force(spark):
    import re
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    texts = TEXTS + [(20, "three " + "x " * 19 + "one"), (21, "three " + "x " * 20 + "one"), (22, "here " * 30 + "lonely"), (20, "three " + "x " * 19 + "one")]
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOWER))
    count = Counter(w for _, t in texts for w in words(t))
    terms = defaultdict(set)
    for i, t in BENCH:
        if i is not None:
            terms[str(i)] |= set(words(t))
    rare = {i: sorted((count[w], w) for w in ws if count[w])[:2] for i, ws in terms.items()}
    want = []
    for d, t in texts:
        at = defaultdict(list)
        for p, w in enumerate(words(t)):
            at[w].append(p)
        near = [i for i, r in rare.items() if len(r) == 2 and any(abs(p - q) <= 20 for p in at[r[0][1]] for q in at[r[1][1]])]
        want.append((d, len(near)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = [(r.doc_id, r.n_near) for r in positional_index.decontaminate(df, bench).collect()]
    order = lambda x: (str(x[0]), x[1])
    assert sorted(got, key=order) == sorted(want, key=order) and max(n for _, n in want) > 1
    assert {r.n_near for r in positional_index.decontaminate(df, bench, slop=None).collect()} == {0}


def test_decontamination_is_native(spark, docs):
    text = plan_text(positional_index.decontaminate(docs, spark.createDataFrame(BENCH, "item_id long, text string")))
    assert "Python" not in text and "Arrow" not in text


def brute_neighbours(rows, queries, k):
    out = {}
    for q, y in queries:
        d = sorted((float(np.sqrt(((np.array(x, float) - np.array(y, float)) ** 2).sum())), i) for i, x in rows if i != q)[:k]
        out[q] = [(i, s) for s, i in d]
    return out


def test_forest_finds_neighbours(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(np.float32(v)) for v in rng.normal(size=8)]) for i in range(600)]
    good += [(1000 + i, good[5][1]) for i in range(40)]                           # one vector many times
    bad = [(2000, None), (2100, [0.0] * 8), (2200, [float("nan")] + [1.0] * 7), (2300, [float("inf")] + [1.0] * 7), (2400, [1.0] * 3), (2500, [None] + [1.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame(good + bad + [good[0]], "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("vec", F.lit(2))
    got = defaultdict(list)
    for r in rp_forest.nearest(df, F.col("id") % 100 == 0, leaf_points=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = brute_neighbours(good, [(i, x) for i, x in good if i % 100 == 0], 10)
    assert set(got) == set(want) and all(len(x) == 10 for x in got.values())
    found = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    assert np.mean(found) >= 9
    few = spark.createDataFrame(good[:4], "vec_id long, embedding array<float>")
    assert rp_forest.nearest(few, F.col("id") == 0).count() == 3
    assert rp_forest.nearest(few.limit(0), F.col("id") == 0).count() == 0


def test_forest_recall_on_the_test_vectors(spark):
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect() if r.embedding]
    got = defaultdict(set)
    for r in queries.op8_rp_forest(spark, "/root/testdata/sf0.1").collect():
        got[r.query_id].add(r.vec_id)
    want = brute_neighbours(table, [(i, x) for i, x in table if i % 100 == 0], 10)
    assert np.mean([len(got[q] & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9


def test_quality_of_held_out_documents(spark):
    truth = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality")
    got = queries.op10_attention_mil(spark, SMALL).join(truth, "doc_id").filter("held_out").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.quality for r in got]) > 0.94


def test_quality_edge_cases(docs, rows, empty, spark):
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)] + [(None, 1), (70, None), (3, 1)], "doc_id long, quality int")
    model = attention_mil.fit(docs, labels)
    got = attention_mil.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert attention_mil.score(empty, model).count() == 0
    assert attention_mil.fit(docs, labels.limit(0)) is None
    assert {r.score for r in attention_mil.score(docs, None).collect()} == {0.5}
    kept = attention_mil.keep_good(docs, model, 0.5)
    assert kept.columns == docs.columns and kept.count() == sum(r.score >= 0.5 for r in got)


def test_passages_do_not_depend_on_the_texts_beside_them():
    texts = [b"", b"Some words, some WORDS.\n", b" \n", b"x" * 90 + b" 12", b"word " * 200, b"", "é à ü.".encode()]
    for some in (texts, texts[::-1], texts[2:5]):
        x, owner = attention_mil.passages(some)
        for i, text in enumerate(some):
            assert np.array_equal(x[owner == i], attention_mil.passages([text])[0])


def test_quality_sample_is_bounded_and_the_same_in_any_order(spark, monkeypatch):
    docs = [(i, f"Sentence {i} of some text, " * (i % 7 * 6 + 1)) for i in range(60)] + [(7, "Another text of an id that stands twice."), (8, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    learned = []
    monkeypatch.setattr(attention_mil, "train", lambda x, owner, y: learned.append((x.copy(), owner.copy(), y.copy())) or {})
    frames = [spark.createDataFrame(d, "doc_id long, text string").repartition(n) for d, n in ((docs, 1), (docs[::-1], 5), (docs + docs[3:9], 3))]
    for bound in (60_000, 40):
        learned.clear()
        for df in frames:
            attention_mil.fit(df, labels, sample_passages=bound)
        for x, owner, y in learned:
            assert len(x) <= bound and all(np.array_equal(a, b) for a, b in zip((x, owner, y), learned[0], strict=True))
        assert len(learned[0][2]) == 60 if bound > 40 else 5 < len(learned[0][2]) < 60


def test_attention_gradient():
    """The analytic gradient against differences: one small step of training lowers the loss."""
    rng = np.random.default_rng(1)
    x, owner = rng.normal(size=(40, attention_mil.FEATURES)), np.repeat(np.arange(10), 4)
    y = (x[owner == owner, 0].reshape(10, 4).max(axis=1) > 0.8).astype(float)
    loss = lambda p: -np.mean(np.log(np.where(y > 0, (s := attention_mil.forward(p, x, owner, 10)["score"]), 1 - s) + 1e-12))
    assert loss(attention_mil.train(x, owner, y, rounds=60)) < 0.5 * loss(attention_mil.train(x, owner, y, rounds=1))
