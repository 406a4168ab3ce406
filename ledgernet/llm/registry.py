"""The queries of this package: each operator over its whole table, with
production parameters, and a DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgernet.llm import chat_format as chat
from ledgernet.llm import embedding_dedup as emb
from ledgernet.llm import language_id as lid
from ledgernet.llm import license_scan as licenses
from ledgernet.llm import merkle_manifest as merkle
from ledgernet.llm import mixing, ngram_join, packing, prefix_trie, substring_dedup, suffix_dedup, token_output
from ledgernet.llm import topk_search as topk
from ledgernet.llm.common import table

#: End ids and vocabulary files of the two token queries.
BYTE_VOCABULARY, BYTE_END = "byte_bpe_50k.json", 2
WORD_VOCABULARY, WORD_END = "word_bpe_49k.json", 0


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), keep_text=False).drop("kept_bytes")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    return chat.read_back(chat.chat_format(rows.unionByName(extra))).drop("rewritten")


_SIGNS = "~<[/|"
OP2_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, length(role) + length(text) + {len(chat.OPEN + chat.HEAD + chat.CLOSE) + 1}
        + length(role) - length(translate(role, '{_SIGNS}', ''))
        + length(text) - length(translate(text, '{_SIGNS}', '')) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(sum(chars) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).withColumn("probability", F.round("probability", 9))


def _op3_sql() -> str:
    from_docs = f"""
d AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
    CASE WHEN 1 - length(translate(t, '0123456789#$%&*+-/:;<=>@[]_{{|}}~()!', '')) / greatest(length(t), 1) > 0.08 THEN 'marked'
         WHEN length(t) < 500 THEN 'note' WHEN length(t) < 4000 THEN 'article' ELSE 'book' END AS topic,
    cast(len(regexp_extract_all(t, '[^ \\t\\n\\r\\x0b\\x0c]+')) AS BIGINT) AS tokens
  FROM (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents)),
c AS MATERIALIZED (SELECT source, lang, topic, sum(tokens) AS tokens FROM d WHERE tokens > 0 GROUP BY ALL),
f0 AS MATERIALIZED (SELECT *, tokens / (SELECT sum(tokens) FROM c) AS fitted FROM c)"""
    parts = [from_docs]
    for by in mixing.MARGINALS:
        parts.append(f"""t_{by} AS MATERIALIZED (
  SELECT {by}, pow(sum(tokens), {mixing.TEMPER}) / (SELECT sum(w) FROM
    (SELECT pow(sum(tokens), {mixing.TEMPER}) AS w FROM c GROUP BY {by})) AS share FROM c GROUP BY {by})""")
    k = 0
    for _ in range(mixing.ROUNDS):
        for by in mixing.MARGINALS:
            parts.append(f"""f{k + 1} AS MATERIALIZED (
  SELECT f.source, f.lang, f.topic, f.tokens, f.fitted * t.share / sum(f.fitted) OVER (PARTITION BY f.{by}) AS fitted
  FROM f{k} f JOIN t_{by} t ON f.{by} = t.{by})""")
            k += 1
    return "WITH " + ",".join(parts) + f""",
p AS (SELECT source, lang, topic, (fitted / tokens) / (SELECT max(fitted / tokens) FROM f{k}) AS p FROM f{k})
SELECT doc_id, d.topic, tokens AS n_tokens, round(CASE WHEN tokens > 0 THEN p ELSE 0.0 END, 9) AS probability,
  cast('0x' || substr(md5('{mixing.SEED}:' || coalesce(cast(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)
    / 4503599627370496.0 < CASE WHEN tokens > 0 THEN p ELSE 0.0 END AS kept
FROM d LEFT JOIN p USING (source, lang, topic)"""


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.topk_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, cast(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, cast(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


_REACH = """
reach(node, other) AS (
  SELECT a, b FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other)"""

OP5_SQL = f"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM documents WHERE text IS NOT NULL),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 4), chr(10)) AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS i
    FROM sh p JOIN sh q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY 1, 2) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE x.i * 5 >= 4 * (na.n + nb.n - x.i)),
{_REACH},
g AS (SELECT node, min(other) AS least FROM reach GROUP BY node),
k AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT d.doc_id, least(d.doc_id, coalesce(g.least, d.doc_id)) AS class_id, coalesce(k.n_links, 0) AS n_links,
  d.doc_id <= coalesce(g.least, d.doc_id) AS kept
FROM documents d LEFT JOIN g ON g.node = d.doc_id LEFT JOIN k ON k.a = d.doc_id"""


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb.embedding_dedup(table(spark, sf_dir, "embeddings"))


OP6_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: cast(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id
    AND len(p.e) = len(q.e) WHERE list_cosine_similarity(p.e, q.e) >= 0.98),
{_REACH},
g AS (SELECT node, min(other) AS least FROM reach GROUP BY node),
k AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT d.vec_id, coalesce(k.n_links, 0) AS n_links, least(d.vec_id, coalesce(g.least, d.vec_id)) AS component_id,
  d.vec_id <= coalesce(g.least, d.vec_id) AS kept
FROM embeddings d LEFT JOIN g ON g.node = d.vec_id LEFT JOIN k ON k.a = d.vec_id"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lid.language_id(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_files(spark, table(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY), BYTE_END)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY), WORD_END)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), keep_text=False).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


OP10_SQL = """
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
w AS MATERIALIZED (
  SELECT doc_id, i, words[i] AS word,
    CASE WHEN i + 49 <= len(words) THEN md5(array_to_string(list_slice(words, i, i + 49), ' ')) END AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d)),
m AS (SELECT h, min(doc_id) AS least FROM w WHERE h IS NOT NULL GROUP BY h),
x AS (SELECT w.doc_id, w.i, w.word, max(CASE WHEN m.least < w.doc_id THEN 1 ELSE 0 END) OVER (
        PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
      FROM w LEFT JOIN m ON m.h = w.h),
k AS (SELECT doc_id, count(*) AS n_words, cast(sum(gone) AS BIGINT) AS n_removed,
        string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM x GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def _crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes in DuckDB SQL."""
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, _: xor(r >> 1, 3988292384 * (r & 1)))"
    code = f"list_transform(string_split({text}, ''), lambda ch: cast(ascii(ch) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(cast(4294967295 AS BIGINT), {code}), lambda c, b: {step}), 4294967295)"


OP11_SQL = f"""
WITH RECURSIVE t AS MATERIALIZED (
  SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS r
  FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (
  SELECT *, {_crc32_sql("cast(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
own AS (SELECT c.conv_id, 1 AS part, r, id, words FROM c JOIN t USING (conv_id) WHERE r > h),
taken AS (SELECT c.conv_id, 0 AS part, r, id, words FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 WHERE r <= h),
p AS MATERIALIZED (
  SELECT conv_id, id, words, row_number() OVER (PARTITION BY conv_id ORDER BY part, r) AS d
  FROM (FROM own UNION ALL FROM taken)),
n AS MATERIALIZED (SELECT conv_id, (SELECT count(*) FROM p WHERE p.conv_id = c.conv_id) AS len FROM c),
chain(conv_id, d, node, words) AS (
  SELECT conv_id, cast(0 AS BIGINT), '', cast(0 AS BIGINT) FROM c
  UNION ALL
  SELECT p.conv_id, p.d, sha256(chain.node || p.id), p.words
  FROM chain JOIN p ON p.conv_id = chain.conv_id AND p.d = chain.d + 1),
m AS MATERIALIZED (FROM chain),
nodes AS MATERIALIZED (
  SELECT d, node, min(m.conv_id) AS conv_id, count(*) AS n_convs, max(len) AS longest, max(words) AS words,
    sha256(coalesce(string_agg(cast(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) FILTER (len = d), '')) AS ends
  FROM m JOIN n ON n.conv_id = m.conv_id GROUP BY d, node),
up AS MATERIALIZED (
  SELECT nodes.d, nodes.node, a.d AS above, a.node AS over FROM nodes JOIN m a ON a.conv_id = nodes.conv_id AND a.d <= nodes.d),
s AS (
  SELECT above AS d, over AS node, cast(sum(CASE WHEN longest = nodes.d THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
    cast(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens,
    cast(sum(CASE WHEN nodes.d = above + 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_children
  FROM up JOIN nodes USING (d, node) GROUP BY above, over)
SELECT x.conv_id, x.d AS depth, y.conv_id AS parent_conv_id, x.n_convs, n_children, n_leaves, saved_tokens,
  x.ends AS ends_sha256
FROM nodes x JOIN s USING (d, node) LEFT JOIN up u ON u.d = x.d AND u.node = x.node AND u.above = x.d - 1
LEFT JOIN nodes y ON y.d = u.above AND y.node = u.over"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_manifest(table(spark, sf_dir, "documents"))


def _field_sql(name: str) -> str:
    return f"coalesce(octet_length(encode(cast({name} AS VARCHAR))) || ':' || {name}, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars", text))) + ")"


OP12_SQL = f"""
WITH RECURSIVE l AS MATERIALIZED (
  SELECT doc_id, coalesce('+' || source, '') AS src, {_leaf_sql("text")} AS leaf,
    CASE WHEN {_crc32_sql("cast(doc_id AS VARCHAR)")} % 5 = 0
      THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS claim,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
  FROM documents),
lower(src, lvl, idx, n, d) AS (
  SELECT src, 0, idx, n, leaf FROM l
  UNION ALL
  SELECT src, lvl + 1, idx // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY idx))
  FROM lower WHERE n > 1 GROUP BY src, lvl, idx // 16, n),
lo AS MATERIALIZED (FROM lower),
r AS MATERIALIZED (SELECT src, lvl AS height, d AS subroot, row_number() OVER (ORDER BY src) - 1 AS idx, count(*) OVER () AS n
  FROM lo WHERE n = 1),
upper(lvl, idx, n, d) AS (
  SELECT 0, idx, n, subroot FROM r
  UNION ALL
  SELECT lvl + 1, idx // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY idx))
  FROM upper WHERE n > 1 GROUP BY lvl, idx // 16, n),
hi AS MATERIALIZED (FROM upper),
nodes AS MATERIALIZED (
  SELECT src AS tree, lvl, idx, d, n FROM lo UNION ALL SELECT '*', lvl, idx, d, n FROM hi),
way AS MATERIALIZED (
  SELECT l.src, l.idx AS leaf_no, x.lvl AS hop, x.tree, x.lvl, x.idx FROM l JOIN nodes x
    ON x.tree = l.src AND x.n > 1 AND x.idx = l.idx // cast(pow(16, x.lvl) AS BIGINT)
  UNION ALL
  SELECT l.src, l.idx, r.height + x.lvl, x.tree, x.lvl, x.idx FROM l JOIN r USING (src) JOIN nodes x
    ON x.tree = '*' AND x.n > 1 AND x.idx = r.idx // cast(pow(16, x.lvl) AS BIGINT)),
sib AS MATERIALIZED (
  SELECT w.src, leaf_no, hop, coalesce(string_agg(x.d, '' ORDER BY x.idx) FILTER (x.idx < w.idx), '') AS a,
    coalesce(string_agg(x.d, '' ORDER BY x.idx) FILTER (x.idx > w.idx), '') AS z
  FROM way w JOIN nodes x ON x.tree = w.tree AND x.lvl = w.lvl AND x.idx // 16 = w.idx // 16 GROUP BY w.src, leaf_no, hop, w.idx),
fold(src, leaf_no, hop, d) AS (
  SELECT src, idx, 0, coalesce(claim, leaf) FROM l
  UNION ALL
  SELECT f.src, f.leaf_no, f.hop + 1, sha256(s.a || f.d || s.z) FROM fold f JOIN sib s
    ON s.src = f.src AND s.leaf_no = f.leaf_no AND s.hop = f.hop),
folded AS (SELECT src, leaf_no, arg_max(d, hop) AS d FROM fold GROUP BY src, leaf_no),
proof AS (SELECT src, leaf_no, string_agg(a || z, '' ORDER BY hop) AS t FROM sib GROUP BY src, leaf_no)
SELECT l.doc_id, l.leaf, r.subroot, h.d AS root, sha256(coalesce(t, '')) AS proof_sha256, f.d AS folded_root,
  f.d = h.d AS verified
FROM l JOIN r USING (src) JOIN hi h ON h.n = 1 LEFT JOIN folded f ON f.src = l.src AND f.leaf_no = l.idx
LEFT JOIN proof p ON p.src = l.src AND p.leaf_no = l.idx"""


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).withColumn(
        "n_spans", F.size("spans").cast("long")).drop("spans")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_QUERIES = [op1_suffix_array_dedup, op2_chat_format, op3_mixing, op4_exact_topk, op5_ngram_jaccard_join,
            op6_embedding_near_dedup, op7_language_id, op8_token_files, op9_best_fit_packing, op10_substring_dedup,
            op11_conversation_trie, op12_merkle_manifest, op13_license_scan, pipeline]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": OP2_SQL, "op3_mixing": _op3_sql(), "op4_exact_topk": OP4_SQL,
            "op5_ngram_jaccard_join": OP5_SQL, "op6_embedding_near_dedup": OP6_SQL, "op10_substring_dedup": OP10_SQL,
            "op11_conversation_trie": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
