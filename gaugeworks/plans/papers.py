"""Queries on translation runs, papers, references and prompts: parts, documents and customers stand for units, works and questions."""

from pyspark.sql import functions as F

from gaugeworks.functions import bibtex, prompts
from gaugeworks.operators import references, translation
from gaugeworks.plans.dual import Dual
from gaugeworks.plans.fact import table

D = Dual()
put = D.put

TERMS = [("red", "Merah (warna)"), ("WIDGET", "alat"), ("small ring", "cincin kecil"), ("blue N", "biru"), ("ed", "ed")]
TERMS_SQL = "(VALUES " + ", ".join(f"('{a.lower()}', '{b.lower().split(' (')[0]}')" for a, b in TERMS if not a.endswith(" N")) + ") g(term, target)"


def units(spark, sf_dir):
    """Translated units: a part's name with a placeholder; large ones have no final text."""
    p = table(spark, sf_dir, "part")
    final = F.replace(F.replace("p_name", F.lit("red"), F.lit("merah")), F.lit("ring"), F.lit("cincin"))
    return p.select(F.col("p_partkey").alias("unit"), F.concat("p_name", F.lit(" ⟦0⟧")).alias("masked"), F.when(F.col("p_size") <= 40, final).alias("final"), "p_size", "p_brand", "p_retailprice")


def glossary_terms(spark, sf_dir):
    """AG-26: terms met and kept, by unit."""
    return translation.glossary_hits(units(spark, sf_dir), spark.createDataFrame(TERMS, "term string, target string"))


put(
    "glossary_terms",
    glossary_terms,
    rf"""WITH u AS (SELECT p_partkey AS unit, lower(p_name) AS masked, lower(replace(replace(p_name, 'red', 'merah'), 'ring', 'cincin')) AS final FROM {{part}} WHERE p_size <= 40)
SELECT unit, count(*) AS n_terms, count(*) FILTER (WHERE contains(final, target)) AS n_kept FROM u, {TERMS_SQL}
WHERE regexp_matches(masked, '\b' || term || '\b') GROUP BY unit""",
)


def translation_report(spark, sf_dir):
    """AG-26: stages of translated parts; even sizes were reviewed."""
    reviewed = F.col("p_size") % 2 == 0
    size = F.col("p_size").cast("double")
    draft = F.map_from_arrays(F.array(F.lit("draft_s"), F.lit("sim_draft"), F.lit("back_draft_sim")), F.array(size, size / 64, size / 128))
    review = F.map_from_arrays(F.array(F.lit("review_s"), F.lit("review_edit")), F.array(size * 2, (size % 4) / 8))
    u = units(spark, sf_dir).select("unit", F.when(reviewed, F.map_concat(draft, review)).otherwise(draft).alias("metrics"), F.when(reviewed, "review").otherwise("draft").alias("selected"))
    return translation.stage_report(u)


put(
    "translation_report",
    translation_report,
    """SELECT 'draft' AS stage, round(avg(CAST(p_size AS DOUBLE)), 3) AS s_per_unit, round(avg(p_size / 64.0::DOUBLE), 3) AS cosine_direct, round(avg(p_size / 128.0::DOUBLE), 3) AS cosine_back,
CAST(NULL AS DOUBLE) AS edit_ratio, CAST(0 AS BIGINT) AS changed, count(*) FILTER (WHERE p_size % 2 = 1) AS selected FROM {part}
UNION ALL SELECT 'review', round(avg(p_size * 2.0::DOUBLE), 3), NULL, NULL, round(avg((p_size % 4) / 8.0::DOUBLE), 3), count(*) FILTER (WHERE p_size % 4 > 0), count(*) FROM {part} WHERE p_size % 2 = 0""",
)


def translation_cache(spark, sf_dir):
    """JN-23: units met again by masked text; a draft without the placeholder, or a back translation equal to its draft, goes."""
    u = units(spark, sf_dir)
    k = F.col("unit")
    pairs = lambda *kv: F.map_from_arrays(F.array(*map(F.lit, kv[::2])), F.array(*kv[1::2]))
    draft = F.when(k % 3 == 0, F.lit("lost")).otherwise(F.concat(F.lit("d "), "masked"))
    out = pairs("draft", draft, "back_draft", F.when(k % 3 == 1, draft).otherwise("b"))
    cache = u.where("p_retailprice > 950").select("masked", k.alias("seq"), F.coalesce("final", F.lit("-")).alias("final"), out.alias("out"), pairs("sim_draft", k / 2, "draft_s", k / 4).alias("metrics"))
    got = translation.reuse_cached(u.select("unit", "masked"), cache)
    at = lambda m, n: F.try_element_at(m, F.lit(n))
    return got.select("unit", "final", at("out", "draft").alias("draft"), at("out", "back_draft").alias("back"), at("metrics", "sim_draft").alias("sim"), at("metrics", "draft_s").alias("secs"))


put(
    "translation_cache",
    translation_cache,
    """WITH u AS (SELECT p_partkey AS unit, p_name || ' ⟦0⟧' AS masked, coalesce(CASE WHEN p_size <= 40 THEN replace(replace(p_name, 'red', 'merah'), 'ring', 'cincin') END, '-') AS final, p_retailprice AS price FROM {part}),
c AS (SELECT masked, max(unit) AS k, arg_max(final, unit) AS final FROM u WHERE price > 950 GROUP BY masked)
SELECT u.unit, c.final, CASE WHEN k % 3 > 0 THEN 'd ' || u.masked END AS draft, CASE WHEN k % 3 = 2 THEN 'b' END AS back, CASE WHEN k % 3 = 2 THEN k / 2.0::DOUBLE END AS sim, k / 4.0::DOUBLE AS secs
FROM u LEFT JOIN c ON u.masked = c.masked""",
)


def prompt_texts(spark, sf_dir):
    """RM-1: a question with choices, a judge's criteria, a filled template and a preview, by customer."""
    c = table(spark, sf_dir, "customer")
    choices = F.map_from_arrays(F.array(F.lit("B"), F.lit("A")), F.array("c_mktsegment", F.col("c_nationkey").cast("string")))
    rated = prompts.criteria(F.array(F.struct(F.lit("clear").alias("name"), F.col("c_mktsegment").alias("meaning")), F.struct(F.lit("right").alias("name"), F.lit("no error").alias("meaning"))))
    shown = prompts.preview(F.concat(F.lit("h\r\n"), "c_name", F.lit("\n2\n3\n")), 1)
    return c.select("c_custkey", prompts.options("c_name", choices).alias("question"), rated["lines"].alias("criteria"), rated["keys"].alias("keys"), prompts.fill("{{{a}}} of {b}", a="c_custkey", b="c_name").alias("filled"), shown["head"].alias("head"), shown["rows"].alias("n_rows"))


put(
    "prompt_texts",
    prompt_texts,
    """SELECT c_custkey, c_name || chr(10) || chr(10) || 'A. ' || c_nationkey || chr(10) || 'B. ' || c_mktsegment AS question, '- clear: ' || c_mktsegment || chr(10) || '- right: no error' AS criteria,
'"clear": 1-5, "right": 1-5' AS keys, '{' || c_custkey || '} of ' || c_name AS filled, 'h' || chr(10) || c_name AS head, CAST(3 AS INTEGER) AS n_rows FROM {customer}""",
)


def picked_sources(spark, sf_dir):
    """RM-2: six long enough documents of each source."""
    d = table(spark, sf_dir, "documents")
    works = d.select(F.col("source").alias("topic"), F.col("doc_id").alias("pos"), F.col("doc_id").alias("id"), F.col("text").alias("abstract"), F.col("lang").alias("language"))
    return translation.pick_sources(works).select("topic", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), "enough")


put(
    "picked_sources",
    picked_sources,
    """WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM {documents} WHERE length(text) >= 500 AND coalesce(lang, 'en') IN ('en', 'id'))
SELECT s.source AS topic, coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY k), '') AS ids, count(doc_id) = 6 AS enough
FROM (SELECT DISTINCT source FROM {documents}) s LEFT JOIN r ON r.source IS NOT DISTINCT FROM s.source AND k <= 6 GROUP BY 1""",
)


def lookup_states(spark, sf_dir):
    """SRC-20: searches for part names by brand; brands 1 to 5 have caps, names of red parts are cached."""
    p = table(spark, sf_dir, "part")
    wanted = p.select(F.col("p_brand").alias("source"), (F.col("p_partkey") % 3).alias("day"), F.concat("p_name", F.lit(" "), "p_size").alias("title"))
    known = wanted.where("title LIKE 'red%'").select(references.lookup_key(F.col("source"), F.col("title"), 5).alias("key"))
    used = wanted.groupBy("source", "day").agg(F.lit(1).alias("n"))
    out = references.lookups(wanted, known, used, {f"Brand#{k}": k for k in range(1, 6)})
    return out.groupBy("source", "day", "state").agg(F.count(F.lit(1)).alias("n"))


put(
    "lookup_states",
    lookup_states,
    """WITH q AS (SELECT DISTINCT p_brand AS source, p_partkey % 3 AS day, p_name || ' ' || p_size AS title FROM {part}),
t AS (SELECT *, title LIKE 'red%' AS known, CASE WHEN source IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5') THEN CAST(replace(source, 'Brand#', '') AS INTEGER) END AS cap FROM q),
n AS (SELECT *, row_number() OVER (PARTITION BY source, day, known ORDER BY title) AS k FROM t)
SELECT source, day, CASE WHEN known THEN 'cached' WHEN cap IS NULL OR k + 1 <= cap THEN 'ask' ELSE 'paused' END AS state, count(*) AS n FROM n GROUP BY 1, 2, 3""",
)


def verified_again(spark, sf_dir):
    """JN-26: suppliers as seeds; of every second an entry was verified, every sixth is checked by hand."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    seeds = s.select(k.alias("key"), F.lit("A title").alias("title"), F.when(k % 6 == 0, "manual").otherwise("auto").alias("verify"))
    text = F.concat(F.lit("@misc{"), k.cast("string"), F.lit(",\n  title={{A title3}},\n  year={2020}\n}"))
    earlier = s.select(k.alias("key"), F.when(k % 2 == 0, "VERIFIED").otherwise("SINGLE").alias("status"), text.alias("bibtex"))
    out = references.reuse_verified(seeds, earlier)
    return out.select("key", "reused", "bibtex", bibtex.normal_bibtex("bibtex", F.lit("k")).alias("rekeyed"), bibtex.bibtex_agrees("bibtex", "title", F.lit(2021)).alias("agrees"))


put(
    "verified_again",
    verified_again,
    """WITH t AS (SELECT s_suppkey AS key, s_suppkey % 2 = 0 AND s_suppkey % 6 <> 0 AS reused FROM {supplier})
SELECT key, reused, CASE WHEN reused THEN '@misc{' || key || ',' || chr(10) || '  title={{A title}},' || chr(10) || '  year={2020}' || chr(10) || '}' END AS bibtex,
CASE WHEN reused THEN '@misc{k,' || chr(10) || '  title = {{A title}},' || chr(10) || '  year = {2020}' || chr(10) || '}' END AS rekeyed, reused AS agrees FROM t""",
)


def report_rows(spark, sf_dir):
    """JN-24: nations by number, of one engine a region, with their rich customers and suppliers beside them."""
    ranking = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("model"), (F.col("n_nationkey") + 1).alias("place"), F.col("n_regionkey").alias("engine"))
    per = lambda t, k, n: table(spark, sf_dir, t).where(f"{k[0]}_acctbal > 9000").groupBy(F.col(k).alias("model")).agg(F.count(F.lit(1)).alias(n))
    return references.report_rows(ranking, per("customer", "c_nationkey", "customers"), per("supplier", "s_nationkey", "suppliers"))


put(
    "report_rows",
    report_rows,
    """SELECT n.n_nationkey AS model, n.n_nationkey + 1 AS place, n.n_regionkey AS engine, customers, suppliers, coalesce(a.n_regionkey <> n.n_regionkey, false) AS rule
FROM {nation} n LEFT JOIN {nation} a ON a.n_nationkey = n.n_nationkey + 1
LEFT JOIN (SELECT c_nationkey AS k, count(*) AS customers FROM {customer} WHERE c_acctbal > 9000 GROUP BY 1) c ON c.k = n.n_nationkey
LEFT JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM {supplier} WHERE s_acctbal > 9000 GROUP BY 1) s ON s.k = n.n_nationkey""",
)

QUERIES, SQL = D.queries, D.sql
