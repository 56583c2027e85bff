"""Registered queries of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import ann, bpe, chat, clustering, context_tree, decontamination, jaccard, license_scan, quality, resampling, sharding, substring, suffix_array
from gaugeworks.llm.common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 7 of near-equal bytes; equal texts stay together."""
    out = sharding.shard(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def word_bpe() -> str:
    """Content of the public word-level BPE file, read by the driver."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts to token ids and back."""
    out = bpe.bpe_round_trip(table(spark, sf_dir, "documents"), word_bpe())
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored for quality; learned from labelled rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality", exclude=held)
    out = quality.classify(docs, model)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    found = decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.verdict(found).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


OP2_SQL = r"""
WITH low AS (
  SELECT doc_id AS id, coalesce(text, '') AS t, 'd' AS kind FROM documents
  UNION ALL SELECT item_id, coalesce(text, ''), 'b' FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM low),
item AS (SELECT id AS item_id, ws, least(13, len(ws)) AS size FROM w WHERE kind = 'b' AND len(ws) > 0),
phrase AS (SELECT DISTINCT item_id, size, array_to_string(ws[a : a + size - 1], ' ') AS p FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS a FROM item)),
place AS (SELECT id AS doc_id, s.size, a, array_to_string(ws[a : a + s.size - 1], ' ') AS p
          FROM (SELECT w.id, w.ws, s.size, unnest(range(1, len(w.ws) - s.size + 2)) AS a FROM w, (SELECT DISTINCT size FROM phrase) s WHERE w.kind = 'd' AND len(w.ws) >= s.size) AS t
          JOIN (SELECT DISTINCT size FROM phrase) s USING (size)),
hit AS (SELECT place.doc_id, place.a, place.size, phrase.item_id FROM place JOIN phrase ON place.size = phrase.size AND place.p = phrase.p),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + size)) AS k FROM hit) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT w.id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN n ON n.doc_id = w.id LEFT JOIN i ON i.doc_id = w.id WHERE w.kind = 'd'
"""


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without passages that also start earlier."""
    out = substring.find_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, a, hash(array_to_string(ws[a : a + 19], ' ')) AS p, md5(array_to_string(ws[a : a + 19], ' ')) AS q FROM (SELECT *, unnest(range(1, len(ws) - 18)) AS a FROM w)),
later AS (SELECT doc_id, a FROM (SELECT doc_id, a, row_number() OVER (PARTITION BY p, q ORDER BY doc_id, a) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, a + 20)) AS i FROM later),
g AS (SELECT doc_id, list(i) AS gi FROM gone GROUP BY doc_id),
k AS (SELECT w.doc_id, ws, coalesce(gi, []) AS gi FROM w LEFT JOIN g USING (doc_id)),
pos AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w) AS t ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT k.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(gi) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN pos USING (doc_id)
"""


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in classes linked by Jaccard similarity of 4-word shingles of 0.85 or more."""
    return jaccard.classes(table(spark, sf_dir, "documents"), 4, 85, 100)


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[a : a + 3], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(ws) - 2, 2))) AS a FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) LEFT JOIN n USING (doc_id)
"""


OP9_SQL = OP5_SQL.replace("a + 19", "a + 49").replace("len(ws) - 18", "len(ws) - 48").replace("a + 20", "a + 50")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that speaks the template's own control strings, formatted and read back."""
    hard = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.read_back(chat.format_windows(rows, spec=word_bpe()))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of each fiftieth vector among all others."""
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows.where(F.col("vec_id") % 50 == 0), ann.build(rows), 5)


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of nine tenths of them."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    out = context_tree.score(table(spark, sf_dir, "documents"), ~held)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without passages of 50 words that also start earlier."""
    out = suffix_array.find_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scanned for license notices by all rules."""
    out = license_scan.scan(table(spark, sf_dir, "documents"))
    named = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", *named, "score", F.size("detections").cast("long").alias("n_detections"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighted towards the benchmark's words; a tenth of those of 20 words or more drawn."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH crc AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
w AS (SELECT kind, id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
      FROM (SELECT doc_id AS id, coalesce(text, '') AS t, 'd' AS kind FROM documents UNION ALL SELECT item_id, coalesce(text, ''), 'b' FROM benchmark)),
x AS (SELECT kind, id, unnest(ws) AS f FROM w),
n AS (SELECT f, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM x GROUP BY f),
h AS (SELECT f, s, n.t, xor(list_reduce(list_transform(range(0, octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT)),
        lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 10000 AS b FROM n, crc),
g AS (SELECT b, CAST(floor(1000 * ln((CAST(sum(t) AS DOUBLE) + 1) * ((SELECT CAST(sum(s) AS DOUBLE) FROM n) + 10000) / ((CAST(sum(s) AS DOUBLE) + 1) * ((SELECT CAST(sum(t) AS DOUBLE) FROM n) + 10000)))) AS BIGINT) AS gain FROM h GROUP BY b),
d AS (SELECT id, count(*) AS n, sum(gain) AS total FROM x JOIN h USING (f) JOIN g USING (b) WHERE kind = 'd' GROUP BY id),
v AS (SELECT w.id AS doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(CAST(floor(total / n) AS BIGINT), 0) AS weight,
        CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || w.id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise FROM w LEFT JOIN d ON d.id = w.id WHERE kind = 'd'),
r AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS k, count(*) OVER () AS n FROM v WHERE n_features >= 20)
SELECT v.doc_id, n_features, weight, weight + noise AS score, CASE WHEN k <= n * 10 // 100 THEN k END AS rank FROM v LEFT JOIN r USING (doc_id)
"""


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in 8 clusters after 10 rounds."""
    return clustering.cluster(table(spark, sf_dir, "embeddings"))[0]


def op13_sql(rounds: int = 10) -> str:
    """The rounds written out one after another."""
    square = "list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [
        """WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS j, v AS m FROM k QUALIFY j < 8)"""
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, min(vec_id) AS vec_id, any_value(v) AS v, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT r, vec_id, v, j, {square} AS d FROM k, c{i}) GROUP BY r)")
        if i < rounds:
            mean = "SELECT j, list((s - ((s % n + n) % n)) // n ORDER BY i) AS m FROM (SELECT j, i, sum(x) AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x, unnest(range(0, 64)) AS i FROM {a}) GROUP BY j, i) GROUP BY j"
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.j, coalesce(n.m, list_transform(c{i}.m, lambda x: CAST(x AS HUGEINT))) AS m FROM c{i} LEFT JOIN ({mean.replace('{a}', f'a{i}')}) n USING (j))")
    return ",\n".join(steps) + f"""
SELECT vec_id, CAST(a{rounds}.j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (j)"""


QUERIES = {
    "op1_sharding": op1_sharding, "op2_decontamination": op2_decontamination, "op4_bpe": op4_bpe, "op3_jaccard": op3_jaccard, "op5_substring": op5_substring, "op6_chat": op6_chat, "op7_ann": op7_ann, "op8_lm": op8_lm,
    "op9_suffix_array": op9_suffix_array, "op10_quality": op10_quality, "op11_licenses": op11_licenses, "op12_resampling": op12_resampling, "op13_clustering": op13_clustering,
}
SQL: dict[str, str] = {"op2_decontamination": OP2_SQL, "op3_jaccard": OP3_SQL, "op5_substring": OP5_SQL, "op9_suffix_array": OP9_SQL, "op12_resampling": OP12_SQL, "op13_clustering": op13_sql()}
