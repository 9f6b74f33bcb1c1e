"""Result columns, types and values of queries that no SQL expresses, against brute force over the whole small tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from llm_cases import SF
from pitchside.llm import fuzzy_lines, queries
from test_pairs_and_lines import Union


@pytest.fixture(scope="module")
def documents():
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(*(table.column(i).to_pylist() for i in range(2)), strict=True))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def line_rows(documents):
    """(doc_id, n_lines, n_removed, digest) by joining all lines whose shingle sets are similar; candidates share a shingle."""
    places = [(fuzzy_lines.plain(x), i, j) for i, t in documents for j, x in enumerate((t or "").encode().splitlines(keepends=True))]
    places = [p for p in places if len(p[0]) >= fuzzy_lines.MIN_CHARS]
    sets = {p: {p[k:k + 8] for k in range(len(p) - 7)} for p, _, _ in places}
    holders, union = defaultdict(list), Union()
    for p, grams in sets.items():
        shared = Counter(q for g in grams for q in holders[g])
        for q, common in shared.items():
            if 100 * common >= 80 * (len(grams) + len(sets[q]) - common):
                union.join(p, q)
        for g in grams:
            holders[g].append(p)
    first, gone = {}, defaultdict(set)
    for p, i, j in places:
        root = union.find(p)
        first[root] = min(first.get(root, (i, j)), (i, j))
    for p, i, j in places:
        if first[union.find(p)] != (i, j):
            gone[i].add(j)
    for i, t in documents:
        lines = (t or "").encode().splitlines(keepends=True)
        yield i, len(lines), len(gone[i]), sha(b"".join(x for j, x in enumerate(lines) if j not in gone[i]))


def test_lines_of_the_whole_table(spark, documents):
    got = queries.op2_fuzzy_lines(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("n_lines", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string")]
    want = sorted(line_rows(documents))
    assert sorted(tuple(r) for r in got.collect()) == want
    assert sum(w[2] for w in want) > 0


def test_tokens_of_the_whole_table(spark, documents):
    got = queries.op4_trie_bpe(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    library = Tokenizer.from_file(queries.TOKENIZER)
    library.no_truncation()
    library.no_padding()
    want = []
    for i, t in documents:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_shards_of_the_whole_table(spark, documents):
    got = queries.op5_hypergeometric_shards(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"),
                          ("slot", "bigint"), ("grown_shard", "int")]
    rows = got.collect()
    want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in documents]
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == sorted(want)
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(8) for k in range(sizes[s])]


def test_pairs_of_lines_are_compared_exactly():
    rng = np.random.default_rng(4)
    base = ["".join(rng.choice(list("ab é"), 60)).encode() for _ in range(30)]
    near = [x[:k] + b"#" + x[k:] for x in base for k in (3, 20, 50)]
    lines = [x for x in base + near + [b"a" * 200, b"a" * 300, b"0123456789abcdef"] if len(x) >= 16]
    left, right = zip(*[(a, b) for a in lines for b in lines], strict=True)
    want = [fuzzy_lines.line_similar(a, b) for a, b in zip(left, right, strict=True)]
    assert [bool(x) for x in fuzzy_lines.similar_pairs(list(left), list(right))] == want
    assert True in want and False in want
    values, owner = fuzzy_lines.line_shingles([b"shorter", b"", b"ab cd ef gh"])
    assert [v.tobytes() for v in values] == [b"ab cd ef", b"b cd ef ", b" cd ef g", b"cd ef gh"] and set(owner) == {2}


def test_only_bands_of_several_lines_are_answered(spark):
    """A band is shared if two distinct lines have it, in one block or in two; the same line in every block shares nothing."""
    rng = np.random.default_rng(8)
    made = []
    for block in range(12):
        c = np.unique(np.append(rng.integers(-50, 50, 20), 999))
        bands = (rng.integers(0, 60, (len(c), 3)) + 100 * np.arange(3)).astype(np.uint64)   # as band_hashes: a line's bands differ
        bands[c == 999] = [1000, 1001, 1002]
        bands[:, 2] += np.uint64(2000 * (block + 1))   # one band in three belongs to its block alone
        bands[c == 999, 2] = 1002
        made.append((block, c, bands))
    lines, where = defaultdict(set), defaultdict(lambda: defaultdict(set))
    for block, c, bands in made:
        for line, own in zip(c.tolist(), bands.tolist(), strict=True):
            for band in own:
                lines[band].add(line)
                where[band][block].add(line)
    key = {band: min(own, key=lambda x: int(fuzzy_lines._centre_key(np.array([x], np.int64), np.array([band], np.uint64))[0])) for band, own in lines.items()}
    want = sorted((band, sorted(own), key[band]) for band, blocks in where.items() if len(lines[band]) > 1 for own in blocks.values())
    scan = spark.createDataFrame([(None, None, None, b, c.tobytes(), bands.tobytes()) for b, c, bands in made],
                                 "c long, id long, line int, block long, cs binary, bands binary")
    got = sorted((r.band, sorted(r.cs), r.centre) for r in fuzzy_lines._buckets(scan.repartition(3)).collect())
    assert got == want
    assert {1000, 1001, 1002}.isdisjoint(band for band, _, _ in want)
    assert fuzzy_lines._buckets(scan.limit(0)).count() == 0
