"""Queries of the operators: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.llm import (
    active_lloyd,
    attention_mil,
    bpe_trie,
    budgeted_windows,
    centroid_langid,
    fuzzy_lines,
    hypergeometric_shards,
    lyndon_suffix,
    positional_index,
    rp_forest,
    segment_bounds,
    suffix_tree,
    superminhash,
)

QUALITY_THRESHOLD = 0.3
#: Words in the longest context of operator 1.
MAX_CONTEXT = 10
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int) -> Column:
    """crc32 of the doc_id as text, modulo n (0 where the doc_id is null: its text is empty)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under a suffix tree learned from documents with remainder 0, 2, 3 or 4 of 5."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (_remainder(5) == 1).alias("held_out"))
    return suffix_tree.score_documents(docs, max_context=MAX_CONTEXT)


def op2_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many repeat a line kept elsewhere, and a digest of the text that stays."""
    docs = fuzzy_lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op3_centroid_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by the nearest centroid, learned from documents with remainder 0, 1 or 3 of 4."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = centroid_langid.fit(docs.filter(_remainder(4) != 2), "doc_id", "text", "lang")
    found = centroid_langid.predict(docs, model)
    return found.select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op4_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and the decoded text of every document."""
    coded = bpe_trie.encode_documents(_table(spark, sf_dir, "documents"), TOKENIZER)
    return coded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under the law ``rows``: a uniform shuffle, shard sizes at most one apart."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    dealt = hypergeometric_shards.shard_rows(docs, ["doc_id", "size", "text_crc32"], ["doc_id", "size", "text_crc32"])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


def op6_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in 13-word windows of benchmark items, the items, the verdict, and its proximity matches."""
    found = positional_index.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "n_near")


def op7_lyndon_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that lie in 400-byte strings found elsewhere, and a digest of the bytes that stay."""
    found = lyndon_suffix.remove_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors found for every vec_id divisible by 100, by Euclidean distance."""
    return rp_forest.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op9_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of Jaccard similarity 0.85 on 5-word shingles."""
    return superminhash.near_duplicates(_table(spark, sf_dir, "documents"))


def quality_model(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The classifier of operator 10, learned from labels whose remainder of 5 is not 0."""
    return attention_mil.fit(docs, labels.filter(_remainder(5) != 0))


def op10_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labelled documents with remainder 1 to 4 of 5."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = attention_mil.score(docs, quality_model(docs, _table(spark, sf_dir, "labels").select("doc_id", "quality")))
    return scored.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score",
                         (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op11_active_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code of every embedding: 16 parts, 64 entries a part, 2 rounds; errors, and a digest of the codebooks."""
    codes, books = active_lloyd.vector_codes(_table(spark, sf_dir, "embeddings"))
    found = active_lloyd.with_label_error(codes)
    return found.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error",
                        F.lit(active_lloyd.codebook_digest(books)).alias("codebooks_sha256"))


def op12_budgeted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings, formatted in windows; digests of what is read back from them."""
    control = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(control)
    return budgeted_windows.digest(budgeted_windows.chat_windows(turns))


def op13_segment_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vec_id divisible by 100, for each of its 5 positives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return segment_bounds.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_suffix_tree, op2_fuzzy_lines, op3_centroid_langid, op4_trie_bpe, op5_hypergeometric_shards, op6_positional_index, op7_lyndon_suffix,
        op8_rp_forest, op9_superminhash, op10_attention_mil, op11_active_lloyd, op12_budgeted_windows, op13_segment_bounds)
}

_SQL_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
              "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op6_positional_index": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(len(w), 13) AS k FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g
       FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM i)),
dw AS (SELECT rid, k, s, array_to_string(w[s:s + k - 1], ' ') AS g
       FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
m AS (SELECT rid, item_id, k, s FROM dw JOIN iw USING (k, g)),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + k)) AS p FROM m) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item_id) AS n_items,
             string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY rid),
it AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, unnest(w) AS term FROM i WHERE item_id IS NOT NULL),
post AS (SELECT rid, pos, term FROM (SELECT rid, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d) WHERE term IN (SELECT term FROM it)),
rare AS (SELECT it.item_id, it.term, row_number() OVER (PARTITION BY it.item_id ORDER BY c.n, it.term) AS r
         FROM it JOIN (SELECT term, count(*) AS n FROM post GROUP BY term) c USING (term) QUALIFY r <= 2),
pr AS (SELECT DISTINCT rid, item_id, r, pos, pos // 20 AS block FROM post JOIN rare USING (term)),
near AS (SELECT a.rid, count(DISTINCT a.item_id) AS n_near
         FROM (SELECT * FROM pr WHERE r = 1) a
         JOIN (SELECT rid, item_id, pos, unnest([block - 1, block, block + 1]) AS block FROM pr WHERE r = 2) b USING (rid, item_id, block)
         WHERE abs(a.pos - b.pos) <= 20 GROUP BY a.rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid) LEFT JOIN near USING (rid)
"""}


def _lloyd_sql(parts: int = 16, width: int = 4, entries: int = 64, rounds: int = 2) -> str:
    """Codes by full rescans: one assignment and one update per round, and the last assignment."""
    comps, part_sum = [f"c{j}" for j in range(width)], " + ".join(f"(x.c{j} - b.c{j}) * (x.c{j} - b.c{j})" for j in range(width))
    cut = ", ".join(f"v[{width} * p + {j + 1}] AS c{j}" for j in range(width))
    steps = [f"""
k AS (SELECT row_number() OVER () AS rid, vec_id, label,
             list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT rid, p, {cut} FROM k, (SELECT unnest(range(0, {parts})) AS p)),
b0 AS (SELECT x.p, s.e, {', '.join('x.' + c for c in comps)} FROM x
       JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM k) s ON x.rid = s.rid AND s.e < {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (SELECT x.rid, x.p, min(({part_sum}) * {entries} + b.e) AS m FROM x JOIN b{r} b ON x.p = b.p GROUP BY x.rid, x.p)""")
        if r < rounds:
            means = ", ".join(f"CAST(floor(sum(x.{c}) / count(*)) AS BIGINT) AS {c}" for c in comps)
            steps.append(f"""u{r} AS (SELECT x.p, a.m % {entries} AS e, {means} FROM x JOIN a{r} a ON x.rid = a.rid AND x.p = a.p GROUP BY 1, 2)""")
            steps.append(f"""b{r + 1} AS (SELECT b.p, b.e, {', '.join(f'coalesce(u.{c}, b.{c}) AS {c}' for c in comps)}
      FROM b{r} b LEFT JOIN u{r} u ON b.p = u.p AND b.e = u.e)""")
    flat = "concat_ws(',', " + ", ".join(comps) + ")"
    return f"""WITH {', '.join(steps)},
f AS (SELECT rid, string_agg(lower(printf('%02x', m % {entries})), '' ORDER BY p) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error
      FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg({flat}, ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM k JOIN f USING (rid)"""


def _safe_sql(column: str) -> str:
    return f"replace(replace(replace({column}, '\\', '\\b'), '###', '\\h'), '</turn>', '\\t')"


def _windows_sql(budget: int = budgeted_windows.BUDGET, history: int = budgeted_windows.HISTORY) -> str:
    """Lengths from windows over running sums; the digests from the turns themselves."""
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')),
t AS (SELECT *, '### ' || replace({_safe_sql('role')}, ':', '\\c') || ': ' || {_safe_sql('text')} || '</turn>' || chr(10) AS piece,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS n FROM c),
s AS (SELECT *, CAST(ceil(strlen(piece) / 4.0) AS BIGINT) AS tokens FROM t),
h AS (SELECT conv_id, tokens AS system, length(piece) AS system_chars FROM s WHERE n = 1 AND role = 'system' AND tokens <= {budget // 2}),
e AS (SELECT s.*, coalesce(system, 0) AS system, system_chars, {budget - history} - coalesce(system, 0) AS room,
             sum(tokens) OVER (PARTITION BY s.conv_id ORDER BY n) - coalesce(system, 0) AS ends
      FROM s LEFT JOIN h USING (conv_id)),
b AS (SELECT *, ends - tokens AS starts, CAST(floor((ends - tokens) / room) AS BIGINT) AS bucket FROM e WHERE NOT (n = 1 AND system > 0)),
f AS (SELECT *, min(starts) OVER (PARTITION BY conv_id, bucket) AS first_start FROM b),
w AS (SELECT *, CASE WHEN ends - first_start > room AND starts > first_start THEN starts ELSE first_start END AS win FROM f),
o AS (SELECT DISTINCT conv_id, win, system_chars FROM w),
again AS (SELECT o.conv_id, sum(length(w.piece)) AS chars FROM o JOIN w ON w.conv_id = o.conv_id AND w.ends <= o.win AND w.starts >= o.win - {history} GROUP BY 1),
sys AS (SELECT conv_id, sum(system_chars) AS chars FROM o WHERE win > 0 GROUP BY 1)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (sum(length(piece)) + coalesce(any_value(again.chars), 0) + coalesce(any_value(sys.chars), 0))::BIGINT AS formatted_chars
FROM s LEFT JOIN again USING (conv_id) LEFT JOIN sys USING (conv_id) GROUP BY conv_id"""


ORACLE_SQL |= {"op11_active_lloyd": _lloyd_sql(), "op12_budgeted_windows": _windows_sql(), "op13_segment_bounds": """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
      FROM r a JOIN r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""}

#: Operator 7: every 400-byte window by its hash, runs of repeated windows as spans; texts in hexadecimal, cut in pieces for speed alone.
ORACLE_SQL["op7_lyndon_suffix"] = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT *, strlen(h) // 2 AS n FROM d),
c AS (SELECT rid, n, o, substr(h, 2 * o + 1, 2 * (1024 + 399)) AS piece
      FROM (SELECT rid, h, n, unnest(range(0, n - 399, 1024)) AS o FROM n WHERE n >= 400)),
g AS (SELECT rid, s, md5(substr(piece, 2 * (s - o) + 1, 800)) AS w
      FROM (SELECT rid, o, piece, unnest(range(o, least(o + 1024, n - 399))) AS s FROM c)),
r AS (SELECT rid, s FROM g WHERE w IN (SELECT w FROM g GROUP BY w HAVING count(*) > 1)),
b AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY rid ORDER BY s) + 400 THEN 0 ELSE 1 END AS new FROM r),
p AS (SELECT rid, min(s) AS a, max(s) + 400 AS z FROM (SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY s) AS k FROM b) GROUP BY rid, k),
q AS (SELECT *, lag(z, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS f FROM p),
k AS (SELECT rid, sum(z - a) AS gone, count(*) AS spans, max(z) AS tail, string_agg(substr(h, 2 * f + 1, 2 * (a - f)), '' ORDER BY a) AS head
      FROM q JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM n LEFT JOIN k USING (rid)
"""

#: Operator 9: links from shared shingles, components by a recursive walk.
ORACLE_SQL["op9_superminhash"] = """
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
e AS (SELECT rid, doc_id, len(sh) AS n, unnest(sh) AS x FROM s WHERE doc_id IS NOT NULL),
l AS (SELECT DISTINCT u, v FROM (
        SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
        GROUP BY a.rid, b.rid, a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*)))),
reach AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM reach r JOIN l ON r.v = l.u),
c AS (SELECT u AS doc_id, min(least(u, v)) AS root FROM reach GROUP BY u)
SELECT s.doc_id, len(sh) AS n_shingles, coalesce(root, s.doc_id) AS component_id, s.doc_id IS NULL OR coalesce(root, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON s.doc_id = c.doc_id
"""
