"""The queries of this subpackage: each applies one operator to its whole table. SQL has the ones DuckDB can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


#: A-Z lower-cased, null as empty; and operator 7's words.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankloom.llm import quality

    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality", "votes")


@query
def op7_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankloom.llm import decontaminate

    found = decontaminate.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    items = F.transform(F.array_sort(F.transform("items", lambda x: x.cast("string"))), lambda x: x)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["words"])), F.lit(0)).cast("long").alias("longest"))


SQL["op7_suffix_array_decontamination"] = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({LOWER}, {WORDS}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, {WORDS}) AS w FROM benchmark),
item AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 8, 2))) AS j, w FROM b WHERE len(w) > 0),
win AS MATERIALIZED (SELECT item_id, n, j, array_to_string(w[j:j + n - 1], ' ') AS s FROM item),
place AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
found AS MATERIALIZED (SELECT doc_id, item_id, n, i, j FROM place JOIN win USING (n, s)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
runs AS (SELECT doc_id, max(words) AS longest FROM (SELECT doc_id, any_value(n) + count(*) - 1 AS words FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, n, i - j ORDER BY i) AS island FROM found) GROUP BY doc_id, item_id, n, i - j, island) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0)::BIGINT AS longest
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN runs USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


@query
def op6_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankloom.llm import mixing

    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL["op6_low_discrepancy_mix"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM sized GROUP BY source),
weighed AS (SELECT *, [3.0, 1.0, 2.0][(s % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS bound FROM per),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(bound) OVER (ORDER BY bound / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY bound / w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
goals AS (
  SELECT *, floor(target + 1e-6) AS goal FROM (
    SELECT *, least(bound, w * (SELECT arg_min(level, bound / w * 1e6 + s) FROM levels WHERE bound / w >= level - 1e-9)) AS target FROM levels)),
shares AS (
  SELECT *, sum(goal) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / greatest(sum(goal) OVER (), 1) AS hi,
    coalesce(sum(goal) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / greatest(sum(goal) OVER (), 1) AS lo FROM goals),
points AS (SELECT (slot % 2147483648 * 2654435769 % 4294967296) / 4294967296.0::DOUBLE AS u FROM range((SELECT ceil(coalesce(sum(goal), 0) / 32)::BIGINT FROM goals)) r(slot)),
slots AS (SELECT s, 32 * count(u) AS words FROM shares LEFT JOIN points ON u >= lo AND u < hi GROUP BY s),
placed AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, w.words,
    coalesce(sum(d.size) OVER (PARTITION BY g.s ORDER BY ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':' || d.size), 1, 15))::BIGINT ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source JOIN slots w ON w.s = g.s)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (greatest(0, least(pos + size, words) - pos) + greatest(0, least(source_size + pos + size, words) - source_size - pos))::BIGINT AS taken
FROM placed
"""


@query
def op3_composite_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankloom.llm import html_text

    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])


@query
def op5_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankloom.llm import chat

    return chat.rendered(table(spark, sf_dir, "conversations"))


SQL["op5_snapshot_collapse"] = """
WITH turns AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
whole AS (
  SELECT conv_id, count(*) AS n_turns, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS said,
    string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS chat
  FROM turns GROUP BY conv_id, alone),
one AS (SELECT said, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(n_turns) AS n_turns, any_value(chat) AS chat FROM whole GROUP BY said)
SELECT a.conv_id, a.n_turns, a.n_copies, a.chat FROM one a
WHERE NOT EXISTS (SELECT 1 FROM one b WHERE b.said[1] = a.said[1] AND b.n_turns > a.n_turns AND b.said[1:a.n_turns] = a.said)
"""


def remainder(by: int):
    """crc32 of the id as text, modulo `by`."""
    return F.crc32(F.col("doc_id").cast("string")) % by


@query
def op1_partial_matching_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankloom.llm import langid

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(remainder(4) == 2, F.lit(False)))
    model = langid.train(docs.filter("not held_out"), "text", "lang", F.col("doc_id"))
    return langid.predict(docs.drop("lang"), model, keep=["doc_id", "held_out"])


@query
def op4_subword_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankloom.llm import lattice

    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(remainder(7) == 2, F.lit(False)))
    return lattice.score(docs)


@query
def op10_bagminhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankloom.llm import bagminhash

    return bagminhash.grouped(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL["op10_bagminhash_near_duplicates"] = rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, text, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
bag AS MATERIALIZED (SELECT doc_id, s, count(*) AS c FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w) GROUP BY ALL),
size AS (SELECT doc_id, sum(c) AS n FROM bag GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS common FROM bag a JOIN bag b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE common / (x.n + y.n - common) >= 0.8),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
class AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a)
SELECT doc_id, class_id, CASE WHEN len(w) > 0 THEN count(*) OVER (PARTITION BY class_id) ELSE 1 END AS class_size, CASE WHEN len(w) > 0 THEN count(*) OVER (PARTITION BY text) ELSE 1 END AS copies FROM class JOIN w USING (doc_id)
"""


@query
def op9_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankloom.llm import pii

    found = pii.detect(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")


@query
def op2_interleave_refined_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankloom.llm import suffix_dedup

    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL["op2_interleave_refined_dedup"] = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
place AS MATERIALIZED (SELECT doc_id, p, md5_number(h[2 * p + 1:2 * p + 800]) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 399)) AS p FROM d WHERE len(h) >= 800)),
again AS (SELECT doc_id, p FROM place JOIN (SELECT k FROM place GROUP BY k HAVING count(*) > 1) USING (k)),
cut AS (SELECT doc_id, min(p) AS a, max(p) + 400 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT *, (p - lag(p, 1, -1000) OVER (PARTITION BY doc_id ORDER BY p) > 400)::INT AS new FROM again)) GROUP BY doc_id, run),
gone AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM cut GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n_spans > 0 THEN h[1:2 * a[1]] || array_to_string(list_transform(range(1, len(a)), lambda i: h[2 * b[i] + 1:2 * a[i + 1]]), '') || h[2 * b[len(b)] + 1:] ELSE h END)) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankloom.llm import resampling

    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: crc is the table of the reflected polynomial 0xEDB88320, a byte at a time.
SQL["op13_importance_resampling"] = rf"""
WITH RECURSIVE poly AS (SELECT b, b::BIGINT AS c, 0 AS k FROM range(256) r(b) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM poly WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM poly WHERE k = 8),
d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({LOWER}, {WORDS}) AS w FROM documents),
b AS (SELECT regexp_extract_all({LOWER}, {WORDS}) AS w FROM benchmark),
dw AS MATERIALIZED (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest(w) AS f FROM d) GROUP BY ALL),
bw AS (SELECT f, count(*) AS n FROM (SELECT unnest(w) AS f FROM b) GROUP BY f),
word AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM dw UNION SELECT f FROM bw)),
coded AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM word, crc),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN coded USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM bw JOIN coded USING (f) GROUP BY bucket),
size AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + 10000 AS s, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + 10000 AS t),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t.t, 0)::DOUBLE + 1) * size.s / ((s.s::DOUBLE + 1) * size.t)))::BIGINT AS g FROM s LEFT JOIN t USING (bucket), size),
heavy AS (SELECT doc_id, floor(sum(n * g) / sum(n)::DOUBLE)::BIGINT AS weight FROM dw JOIN coded USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN heavy USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM placed) THEN rank END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""


@query
def op12_wavelet_matrix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from rankloom.llm import wavelet

    return wavelet.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), end=1)


@query
def op11_full_sort_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rankloom.llm import negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=moved)


SQL["op11_full_sort_hard_negatives"] = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
p AS (SELECT a, anchor_id, b, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST, b) <= 5),
n AS (SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.id NULLS LAST, s.b) AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
  FROM p JOIN s USING (a) WHERE NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
