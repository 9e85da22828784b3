"""One query per operator, over its whole table, with the SQL that must agree where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_repetition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repetition as m

    out = m.verdict(m.repetition_stats(table(spark, sf_dir, "documents")))
    return out.withColumnRenamed("words_in_3", "n_repeat_words").drop("chars_in_3")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT item_id, least(len(w), 10) AS k, list_aggregate(w[i:i + least(len(w), 10) - 1], 'string_agg', ' ') AS g FROM b, unnest(range(1, greatest(2, len(w) - 8))) t(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, k, i, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS g FROM d, ks, unnest(range(1, greatest(1, len(w) - k + 2))) t(i)),
hit AS (SELECT dw.doc_id, dw.i, dw.k, win.item_id FROM dw JOIN win ON dw.k = win.k AND dw.g = win.g),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, unnest(range(0, k)) t(j) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS joined FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query(OP3_SQL)
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate as m

    hits = m.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query()
def op4_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash as m

    found = m.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query()
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing as m

    return m.pack(table(spark, sf_dir, "documents"))


@query()
def op6_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_crf as m

    return m.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity as m

    return m.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op5_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_tree as m

    return m.score(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH raw AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL
  SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
p AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn, 4 + CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens FROM raw),
s AS (SELECT *, CAST(coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM p),
sys AS (SELECT conv_id, tokens AS st, text AS system FROM s WHERE before = 0 AND role = 'system' AND tokens < 1024),
r AS (SELECT s.*, st, least(192, (1024 - coalesce(st, 0)) // 2) AS hist, 1024 - coalesce(st, 0) - least(192, (1024 - coalesce(st, 0)) // 2) AS room FROM s LEFT JOIN sys USING (conv_id)),
c AS (SELECT *, greatest(1, room * 3 // 4) AS cell FROM r),
w AS (SELECT *, ((before + tokens - 1) // cell) * 2 + CASE WHEN (before + tokens - 1) // cell > before // cell AND tokens > room - cell THEN 0 ELSE 1 END AS win FROM c),
st AS (SELECT conv_id, win, min(before) AS start FROM w GROUP BY ALL HAVING min(before) > 0),
msg AS (SELECT conv_id, role, text, 'turn' AS kind FROM w
  UNION ALL SELECT st.conv_id, w.role, w.text, 'repeat' FROM st JOIN w ON w.conv_id = st.conv_id AND w.before + w.tokens <= st.start AND st.start - w.before <= w.hist WHERE NOT (w.before = 0 AND w.role = 'system')
  UNION ALL SELECT conv_id, 'system', system, 'repeat' FROM st JOIN sys USING (conv_id)),
ch AS (SELECT conv_id, CAST(sum(2 * length(kind) + 7 + length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g')) + length(replace(replace(text, '\', '\b'), '<', '\l'))) AS BIGINT) AS formatted_chars FROM msg GROUP BY conv_id),
d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY before)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY before) FILTER (WHERE role = 'assistant'), '') AS loss FROM s GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM d JOIN ch USING (conv_id)
"""


@query(OP9_SQL)
def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat as m

    said = F.lit("\\### Assistant: </turn> ok")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)
    return m.digests(m.windows(turns))


@query()
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup as m

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = m.dedup_lines(docs, removed_col="n_removed")
    return out.select("doc_id", "n_removed", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS keep FROM d WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN keep IS NULL OR keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keep <> page_id THEN keep END AS refers_to
FROM d LEFT JOIN m ON d.payload_digest = m.payload_digest AND payload_bytes >= 1000
"""


@query(OP2_SQL)
def op2_warc_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc as m

    # the table has no capture time: a second for each page, from 2024 on, in a range that ids of any size stay in
    captured = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1 << 31)))
    captures = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", captured.alias("captured"), F.col("html").alias("payload"))
    merged = m.merge_runs(m.capture_runs(spark, m.write_archives(captures)))
    return merged.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
  ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
r AS (SELECT *, CAST(len(u) AS BIGINT) AS n, h1 % (len(u) + 1) AS r1, h2 % (len(u) + 1) AS r2,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, n, form, t, array_to_string(u[1:least(r1, r2)], '') AS p, array_to_string(u[least(r1, r2) + 1:greatest(r1, r2)], '') AS m, array_to_string(u[greatest(r1, r2) + 1:], '') AS s FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


@query(OP11_SQL)
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import infill as m

    out = m.transform(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(m.restored("output", "form"), 256).alias("restored_sha256"))


@query()
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import whitening as m

    out = m.whitened(table(spark, sf_dir, "embeddings"))
    return out.withColumns({"deviation": F.col("deviation").try_cast("long"), "deviation_exact": F.col("deviation")})


@query()
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import byte_bpe as m

    encoded = m.encode(table(spark, sf_dir, "documents")).withColumn("ids_sha256", F.sha2("ids", 256))
    decoded = m.decode(encoded, ("doc_id", "n_tokens", "ids_sha256"))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("data", 256).alias("decoded_sha256"))
