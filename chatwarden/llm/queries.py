"""The registered queries of the operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chatwarden.llm import (
    decontamination,
    fingerprints,
    jaccard_join,
    mixing,
    nearest,
    quality,
    resampling,
    secrets,
    substring_dedup,
    token_files,
    tool_calls,
    toxicity,
    vector_codes,
)
from chatwarden.llm.common import held_out, table


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file; another installation passes its own path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = nearest.nearest(vectors, F.col("vec_id") % 50 == 0, k=5)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


OP1_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0
    AND len([x for x in embedding if x <> 0]) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = tool_calls.chat_rows(table(spark, sf_dir, "conversations"))
    return linked.select(
        "conv_id", "call_id", "turn", "result_turn", "level", "status",
        F.array_join("errors", "; ").alias("errors"), "message",
    )


OP2_SQL = """
WITH users AS (SELECT conv_id, turn, min(text) AS text FROM conversations
  WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
answers AS (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE role = 'assistant' GROUP BY ALL),
calls AS (SELECT *, lag(turn) OVER w AS prior, row_number() OVER w - 1 AS level FROM users
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
checked AS (SELECT *, CASE WHEN text IS NULL THEN 'missing prompt' WHEN len(text) > 300 THEN 'too long: prompt' ELSE '' END AS errors
  FROM calls)
SELECT u.conv_id, u.conv_id || ':' || u.turn AS call_id, u.turn, a.turn AS result_turn, CAST(level AS INTEGER) AS level,
  CASE WHEN a.turn IS NULL THEN 'unanswered' WHEN errors <> '' THEN 'invalid' ELSE 'linked' END AS status, errors,
  '{"arguments":{' || CASE WHEN prior IS NULL THEN '' ELSE '"after":' || prior || ',' END
    || CASE WHEN u.text IS NULL THEN '' ELSE '"prompt":' || to_json(u.text)::VARCHAR || ',' END
    || '"turn":' || u.turn || '},"id":"' || u.conv_id || ':' || u.turn || '","name":"'
    || CASE WHEN prior IS NULL THEN 'open' ELSE 'reply' END || '","result":'
    || coalesce(to_json(a.text)::VARCHAR, 'null') || '}' AS message
FROM checked u LEFT JOIN answers a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
UNION ALL
SELECT conv_id, conv_id || ':' || turn, turn, NULL, NULL, 'orphan', '',
  '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}'
FROM conversations c
WHERE NOT coalesce(role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL, false)
  AND NOT coalesce(role = 'assistant' AND EXISTS (SELECT 1 FROM users u WHERE u.conv_id = c.conv_id AND u.turn + 1 = c.turn), false)
"""


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality")
    return quality.score(docs.select("doc_id", "text", held_out("doc_id").alias("held_out")), model, threshold=0.3).select(
        "doc_id", "held_out", "score", "predicted"
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    return secrets.find_secrets(docs, ranks, public_tokenizers.PATTERN).drop("text")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_files.token_digests(docs, tokenizer_path("byte_bpe_50k.json"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic")
    return toxicity.score(docs.select("doc_id", "text", held_out("doc_id").alias("held_out")), field, threshold=0.5).select(
        "doc_id", "held_out", "score", "predicted", "toxic_spans"
    )


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN words IS NULL OR len(words) = 0 THEN []
    WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + 4], ' ') for i in range(1, len(words) - 3)]) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n, sh FROM s),
e AS (SELECT doc_id, n, unnest(sh) AS x FROM n),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (min(a.n) + min(b.n) - count(*))),
links AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach(d, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.d, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT n.doc_id, n.n AS n_shingles, m.component_id
FROM n JOIN (SELECT d, min(r) AS component_id FROM reach GROUP BY d) m ON m.d = n.doc_id
"""


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP8_SQL = r"""
WITH dw AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
items AS (SELECT DISTINCT item_id, least(len(words), 13) AS k,
    unnest([array_to_string(words[i:i + least(len(words), 13) - 1], ' ') for i in range(1, len(words) - least(len(words), 13) + 2)]) AS x
  FROM iw WHERE len(words) > 0),
ks AS (SELECT DISTINCT k FROM items),
spots AS (SELECT doc_id, k, unnest(range(1, len(words) - k + 2)) AS i,
    unnest([array_to_string(words[j:j + k - 1], ' ') for j in range(1, len(words) - k + 2)]) AS x FROM dw, ks WHERE len(words) >= k),
hits AS (SELECT doc_id, i, spots.k AS k, item_id FROM spots JOIN items USING (k, x)),
n_hit AS (SELECT doc_id, count(DISTINCT w) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS w FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hits GROUP BY doc_id)
SELECT dw.doc_id, len(words) AS n_words, coalesce(n_hit.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit.n, 0) > 0 AND 20 * coalesce(n_hit.n, 0) >= len(words) AS contaminated
FROM dw LEFT JOIN n_hit ON n_hit.doc_id = dw.doc_id LEFT JOIN found ON found.doc_id = dw.doc_id
"""


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(words) - 11)) AS i,
    unnest([array_to_string(words[j:j + 12], ' ') for j in range(1, len(words) - 11)]) AS x FROM w WHERE len(words) >= 13),
first AS (SELECT x, min(doc_id) AS d FROM s GROUP BY x),
gone AS (SELECT DISTINCT s.doc_id, unnest(range(i, i + 13)) AS i FROM s JOIN first USING (x) WHERE first.d < s.doc_id),
kept AS (SELECT a.doc_id, count(g.i) AS n_removed, coalesce(string_agg(CASE WHEN g.i IS NULL THEN a.x END, ' ' ORDER BY a.i), '') AS t
  FROM (SELECT doc_id, unnest(words) AS x, unnest(range(1, len(words) + 1)) AS i FROM w) a
  LEFT JOIN gone g ON g.doc_id = a.doc_id AND g.i = a.i GROUP BY a.doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, text,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight FROM s),
level(i, x) AS (
  SELECT 0, 1.5::DOUBLE * sum(source_size)::DOUBLE / sum(weight) FROM r
  UNION ALL
  SELECT i + 1, (1.5::DOUBLE * (SELECT sum(source_size) FROM r)::DOUBLE - (SELECT coalesce(sum(2 * source_size), 0) FROM r WHERE 2 * source_size < weight * x))
    / (SELECT sum(weight) FROM r WHERE NOT 2 * source_size < weight * x) FROM level WHERE i < 60),
t AS (SELECT source, source_size, CASE WHEN 2 * source_size < weight * x THEN CAST(2 * source_size AS DOUBLE) ELSE weight * x END AS target
  FROM r, (SELECT x FROM level WHERE x IS NOT NULL ORDER BY i DESC LIMIT 1)),
m AS (SELECT d.doc_id, size, source_size, target, least(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END, 2) AS rate,
    ('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), md5(coalesce(text, ''))) || '#0'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM m
"""


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded(table(spark, sf_dir, "embeddings"))


def _op11_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds are written out: c0, a0, c1, a1, ..."""
    steps = [
        """v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
    [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS x FROM embeddings
  WHERE len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0)""",
        f"""w AS MATERIALIZED (SELECT r, p, x[p * (len(x) // {parts}) + 1 : (p + 1) * (len(x) // {parts})] AS x
  FROM v, range({parts}) AS t(p))""",
        f"c0 AS MATERIALIZED (SELECT p, r - 1 AS j, x AS c FROM w WHERE r <= {entries})",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, p, min(d * {entries} + j) AS m FROM (
    SELECT r, w.p, j, CAST(list_sum([(x[k] - c[k]) * (x[k] - c[k]) for k in range(1, len(x) + 1)]) AS BIGINT) AS d
    FROM w JOIN c{i} ON c{i}.p = w.p) GROUP BY r, p)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.p, c{i}.j, coalesce(n.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
    SELECT p, j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS c FROM (
      SELECT p, j, k, CAST(sum(e) AS BIGINT) AS s, count(*) AS n FROM (
        SELECT w.p, m % {entries} AS j, unnest(x) AS e, generate_subscripts(x, 1) AS k FROM w JOIN a{i} USING (r, p))
      GROUP BY p, j, k) GROUP BY p, j) n ON n.p = c{i}.p AND n.j = c{i}.j)""")
    steps.append(f"""coded AS (SELECT r, string_agg(printf('%02x', m % {entries}), '' ORDER BY p) AS code,
    CAST(sum(m // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY r)""")
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) AS h FROM c{rounds})")
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM coded JOIN v USING (r), digest
"""


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# The checksum of a word goes byte by byte through the table of the reversed polynomial 0xEDB88320.
OP13_SQL = r"""
WITH RECURSIVE bits(b, c, i) AS (SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM bits WHERE i < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM bits WHERE i = 8),
dw AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents),
bw AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
fw AS MATERIALIZED (SELECT doc_id, unnest(words) AS w FROM dw),
names AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM (SELECT w FROM fw UNION SELECT w FROM bw)),
steps(w, h, c) AS (SELECT w, h, 4294967295 FROM names
  UNION ALL SELECT w, substr(h, 3), xor(c >> 8, t[xor(c & 255, CAST('0x' || substr(h, 1, 2) AS BIGINT)) + 1]) FROM steps, crc WHERE h <> ''),
named AS MATERIALIZED (SELECT w, xor(c, 4294967295) % 10000 AS b FROM steps WHERE h = ''),
s AS (SELECT b, count(*) AS n FROM fw JOIN named USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM bw JOIN named USING (w) GROUP BY b),
gains AS MATERIALIZED (SELECT b, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * ((SELECT count(*) FROM fw) + 10000) AS DOUBLE)
    / CAST((coalesce(s.n, 0) + 1) * ((SELECT count(*) FROM bw) + 10000) AS DOUBLE))) AS BIGINT) AS g
  FROM (SELECT DISTINCT b FROM named) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
weights AS (SELECT doc_id, CAST(sum(g) AS BIGINT) AS weight FROM fw JOIN named USING (w) JOIN gains USING (b) GROUP BY doc_id),
scored AS (SELECT dw.doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000.0 * ln(-ln((CAST('0x' || substr(sha256('2024:' || dw.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM dw LEFT JOIN weights ON weights.doc_id = dw.doc_id),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN r <= n * 10 // 100 THEN r END AS rank
FROM scored LEFT JOIN drawn ON drawn.doc_id = scored.doc_id
"""

QUERIES = {
    "op1_nearest": (op1_nearest, OP1_SQL),
    "op2_tool_calls": (op2_tool_calls, OP2_SQL),
    "op3_quality": (op3_quality, None),
    "op4_secrets": (op4_secrets, None),
    "op5_token_files": (op5_token_files, None),
    "op6_toxicity": (op6_toxicity, None),
    "op7_jaccard": (op7_jaccard, OP7_SQL),
    "op8_decontamination": (op8_decontamination, OP8_SQL),
    "op9_substring_dedup": (op9_substring_dedup, OP9_SQL),
    "op10_mixing": (op10_mixing, OP10_SQL),
    "op11_vector_codes": (op11_vector_codes, _op11_sql()),
    "op12_fingerprints": (op12_fingerprints, None),
    "op13_resampling": (op13_resampling, OP13_SQL),
}
