"""Operators 2, 7 and 9 against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm_cases import docs, empty, frame, plan_text, rows  # noqa: F401  (fixtures)
from pitchside.llm import fuzzy_lines, linking, lyndon_suffix, superminhash
from pitchside.llm.components import components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_components_of_chains_stars_and_single_nodes(spark):
    rng = np.random.default_rng(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (300, None)]
    links += [tuple(map(int, rng.integers(1000, 1100, 2))) for _ in range(70)]
    want = Union()
    for a, b in links:
        if b is not None:
            want.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: want.find(x) for x in list(want)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("n,share", [(40, 0.9), (900, 0.8), (6, 0.7)])
def test_superminhash_estimates_jaccard(n, share):
    rng = np.random.default_rng(n)
    est = []
    for _ in range(60):
        pool = rng.integers(0, 1 << 62, 2 * n, dtype=np.uint64)
        k = round(n * share)
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:k], pool[n: n + n - k]]))
        sig = superminhash.signatures(np.concatenate([a, b]), np.array([0, n, 2 * n]))
        est.append((sig[0] == sig[1]).mean())
        assert (sig >> np.uint64(48)).max() < superminhash.SIZE   # every place is filled
    true = k / (2 * n - k)
    assert np.mean(est) == pytest.approx(true, abs=0.04)
    # Lower variance than that of independent places.
    assert np.var(est) < 1.3 * true * (1 - true) / superminhash.SIZE


def shingles(text):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates_match_brute_force(docs, rows, empty):
    sets = [(i, shingles(t)) for i, t in rows]
    union = Union()
    named = [(i, s) for i, s in sets if i is not None]
    for a, (i, s) in enumerate(named):
        for j, t in named[a + 1:]:
            if s and t and 100 * len(s & t) >= 85 * len(s | t):
                union.join(i, j)
    want = Counter((i, len(s), union.find(i) if i is not None else None, i is None or union.find(i) == i) for i, s in sets)
    got = superminhash.near_duplicates(docs)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == want
    assert any(k[2] != k[0] for k in want if k[0])
    assert superminhash.near_duplicates(empty).count() == 0


def test_a_large_group_of_near_copies_is_one_component(spark, monkeypatch):
    """300 variants of one text, each a little different, and one that only a chain of links reaches."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:i % 100] + [f"z{i}"] + base[i % 100 + 1:])) for i in range(300)]
    far = base[:]
    for p in (20, 60, 140):
        far[p] = "q"
    rows.append((1000, " ".join(far)))
    rows.append((2000, " ".join(base[::-1])))
    sets = dict((i, shingles(t)) for i, t in rows)
    union = Union()
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                union.join(a, b)
    monkeypatch.setattr(linking, "BLOCK", 40)   # families fall into several blocks
    got = {r.doc_id: r.component_id for r in superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: union.find(i) for i in sets}


def test_families_in_blocks_lose_no_link(spark, monkeypatch):
    """Chains whose neighbours are linked, the others not: 60 texts, each a few words on from the one before."""
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join([f"v{k}" if k < 3 * i else w for k, w in enumerate(base)])) for i in range(12)]
    rows += [(100 + i, " ".join(base[:60] + [f"x{i}_{k}" for k in range(25)] + base[85:])) for i in range(40)]
    sets = dict((i, shingles(t)) for i, t in rows)
    union = Union()
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                union.join(a, b)
    monkeypatch.setattr(linking, "BLOCK", 5)
    got = {r.doc_id: r.component_id for r in superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: union.find(i) for i in sets}


def test_fuzzy_lines_match_brute_force(docs, rows, empty, spark):
    lines = [(fuzzy_lines.plain(x), i, j) for i, t in rows if i is not None and t
             for j, x in enumerate(t.encode().splitlines(keepends=True)) if len(fuzzy_lines.plain(x)) >= fuzzy_lines.MIN_CHARS]
    union, distinct = Union(), sorted({p for p, _, _ in lines})
    sets = {p: {p[k:k + 8] for k in range(len(p) - 7)} for p in distinct}
    for a, p in enumerate(distinct):
        for q in distinct[a + 1:]:
            if min(len(sets[p]), len(sets[q])) * 5 >= 4 * max(len(sets[p]), len(sets[q])):
                common = len(sets[p] & sets[q])
                if 100 * common >= 80 * (len(sets[p]) + len(sets[q]) - common):
                    union.join(p, q)
    first = {}
    for p, i, j in lines:
        r = union.find(p)
        first[r] = min(first.get(r, (i, j)), (i, j))
    gone = defaultdict(set)
    for p, i, j in lines:
        if first[union.find(p)] != (i, j):
            gone[i].add(j)
    want = Counter()
    for i, t in rows:
        own = (t or "").encode().splitlines(keepends=True)
        drop = gone[i] if i is not None else set()
        text = None if t is None else b"".join(x for j, x in enumerate(own) if j not in drop).decode()
        want[i, text, len(own), len(drop)] += 1
    got = fuzzy_lines.dedup_lines(docs)
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()) == want
    assert sum(len(x) for x in gone.values()) >= 3
    assert set(got.columns) == set(docs.columns) | {"n_removed"}
    assert fuzzy_lines.dedup_lines(empty).count() == 0


def test_fuzzy_lines_of_a_template_over_blocks_and_partitions(spark):
    """Lines of one template share bands with centres they are not similar to; every similar pair that shares a band is found."""
    rng = np.random.default_rng(6)
    words = [f"w{i:03d}" for i in range(400)]
    template = [str(x) for x in rng.choice(words, 36)]
    lines = []
    for _ in range(120):
        line = list(template)
        for k in rng.choice(36, 3, replace=False):
            line[k] = str(rng.choice(words))
        lines.append(" ".join(line))
        near = list(line)
        near[int(rng.integers(36))] = str(rng.choice(words))
        lines.append(" ".join(near))
    rows = [(i, "\n".join(str(x) for x in rng.permutation(lines)[:4])) for i in range(200)]
    distinct = sorted({x.encode() for _, t in rows for x in t.split("\n")})
    bands = [set(x) for x in superminhash.band_hashes(fuzzy_lines.minhash(distinct), fuzzy_lines.ROWS).tolist()]
    union, pairs = Union(), Counter()
    for a, p in enumerate(distinct):
        for b in range(a + 1, len(distinct)):
            if bands[a] & bands[b]:
                pairs[fuzzy_lines.line_similar(p, distinct[b])] += 1
                if fuzzy_lines.line_similar(p, distinct[b]):
                    union.join(p, distinct[b])
    assert pairs[True] > 50 and pairs[False] > pairs[True]
    first = {}
    for i, t in rows:
        for j, x in enumerate(t.encode().split(b"\n")):
            first.setdefault(union.find(x), (i, j))
    want = {i: sum(first[union.find(x)] != (i, j) for j, x in enumerate(t.encode().split(b"\n"))) for i, t in rows}
    for parts in (1, 7):
        got = fuzzy_lines.dedup_lines(frame(spark, rows).repartition(parts))
        assert {r.doc_id: r.n_removed for r in got.select("doc_id", "n_removed").collect()} == want


def test_suffix_array_of_random_and_periodic_strings():
    rng = np.random.default_rng(4)
    for _ in range(600):
        n, k = int(rng.integers(1, 40)), int(rng.choice([1, 2, 3, 8]))
        s = [*map(int, rng.integers(1, k + 1, n)), 0]
        assert lyndon_suffix.suffix_array(s) == sorted(range(n + 1), key=lambda i: s[i:])
    s = [1, 2, 1] * 50 + [0]
    assert lyndon_suffix.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def repeats(rows, width=lyndon_suffix.WIDTH):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p:p + width] for _, t in texts for p in range(len(t) - width + 1))
    for i, t in texts:
        hit = np.zeros(len(t) + 1, int)
        for p in range(len(t) - width + 1):
            if seen[t[p:p + width]] > 1:
                hit[p] += 1
                hit[p + width] -= 1
        cover = np.cumsum(hit)[:-1] > 0
        edges = np.diff(np.concatenate([[0], cover.astype(int), [0]]))
        yield i, len(t), int(cover.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(b for b, c in zip(t, cover, strict=True) if not c)).hexdigest()


def removed(df):
    return Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest())
                   for r in lyndon_suffix.remove_repeats(df).collect())


def test_repeated_strings_match_brute_force(spark, docs, rows, empty, monkeypatch):
    few = [(i, t if t is None or len(t) < 60_000 else t[:30_000]) for i, t in rows]
    assert removed(frame(spark, few)) == Counter(repeats(few))
    assert lyndon_suffix.remove_repeats(empty).count() == 0


def test_passage_with_many_surroundings_and_windows_one_by_one(spark, monkeypatch):
    """One passage in 40 different texts at different places, in one sorted group and cut into windows by hash."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    passage = " ".join(word() for _ in range(75))
    rows = [(i, " ".join(word() for _ in range(int(rng.integers(0, 40)))) + passage[i % 3 * 40: 500 - i % 5 * 8] + " ".join(word() for _ in range(20))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(repeats(rows))
    assert sum(x[2] for x in want) > 10_000 and removed(df) == want
    monkeypatch.setattr(lyndon_suffix, "GROUP", 3)
    assert removed(df) == want


def test_equal_rows_send_their_runs_once(spark, monkeypatch):
    text = "".join(chr(97 + int(x)) for x in np.random.default_rng(5).integers(0, 26, 900))
    df = spark.createDataFrame([(1, text)] * 40 + [(None, text)] * 30 + [(2, text[:700])], "doc_id long, text string")
    most, plain_stage = [], lyndon_suffix.stage

    def watch(table, name):
        if name == "removed-spans":
            most.append(plan_text(table))
        return plain_stage(table, name)

    monkeypatch.setattr(lyndon_suffix, "stage", watch)
    got = lyndon_suffix.remove_repeats(df).collect()
    assert len(got) == 71 and all(r.n_bytes == s.end - s.start for r in got for s in r.spans) and all(len(r.spans) == 1 for r in got)
    keys = [x for x in most[0].splitlines() if "Aggregate" in x and "r#" in x and "first#" in x and "last#" in x and "collect_list" not in x]
    assert keys


def test_first_of_groups_goes_by_rows(spark):
    base = " ".join(f"w{i}" for i in range(60))
    near = base + " more"
    rows = [(1, base), (1, base), (1, near), (2, near), (2, "a clean text under an id that a near copy has too"), (3, "short"), (3, "short"),
            (None, base), (4, None), (4, None), (5, "..."), (6, "two rows with this id and"), (6, "another text that is not close to it")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, r string").repartition(3)
    left = superminhash.first_of_groups(df, numerator=80)
    assert left.columns == df.columns
    key = lambda x: (str(x[0]), str(x[1]))
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=key)
    one = [t for i, t in got if i == 1]
    assert len(one) == 1 and one[0] in (base, near)  # of two texts of the smallest id the one with the least hash
    want = [(1, one[0]), (2, rows[4][1]), (3, "short"), (None, base), (4, None), (4, None), (5, "..."), rows[11], rows[12]]
    assert got == sorted(want, key=key)
    assert superminhash.first_of_groups(df.limit(0)).count() == 0
