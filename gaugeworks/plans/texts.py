"""Text, JSON, time-series, embedding and conversation queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeworks.functions import special, text
from gaugeworks.operators import references, relational, scorers, timeseries
from gaugeworks.plans.dual import Dual
from gaugeworks.plans.fact import fact, table
from gaugeworks.plans.streamed import ENERGY_SQL

D = Dual()
add, put = D.add, D.put

W_SQL = r"regexp_extract_all(text, '[0-9A-Za-zÀ-ÿ]+(?:[-''][0-9A-Za-zÀ-ÿ]+)*')"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def word_counts(spark, sf_dir):
    """FN-5, FN-24."""
    n = F.size(text.words("text"))
    return docs(spark, sf_dir).select("doc_id", n.cast("long").alias("n_words"), F.round(text.length_score(n, 250, 400), 8).alias("length_score"))


put("word_counts", word_counts, f"SELECT doc_id, n AS n_words, round(CASE WHEN n BETWEEN 250 AND 400 THEN 1.0 WHEN n < 250 THEN greatest(0.0, 1.0 - (250 - n) / 400) ELSE greatest(0.0, 1.0 - (n - 400) / 400) END, 8) AS length_score FROM (SELECT doc_id, len({W_SQL}) AS n FROM {{documents}})")


def number_literals(spark, sf_dir):
    """FN-7: how many, and their sum where plain."""
    p = table(spark, sf_dir, "events").select("event_id", text.number_literals("props").alias("n"))
    return p.select("event_id", F.size("n").cast("long").alias("n"), F.try_element_at("n", F.lit(1)).alias("first"))


put("number_literals", number_literals, "SELECT event_id, len(n) AS n, n[1] AS \"first\" FROM (SELECT event_id, regexp_extract_all(props, '[0-9]+(?:[.,][0-9]+)*%?') AS n FROM {events})")


def norm_texts(spark, sf_dir):
    """FN-6, FN-13."""
    return table(spark, sf_dir, "part").select("p_partkey", text.norm_text("p_name").alias("norm"), F.regexp_replace(F.lower(F.trim("p_type")), r"[\s-]+", "_").alias("enum"))


put("norm_texts", norm_texts, "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^0-9a-z%]+', ' ', 'g'), ' +', ' ', 'g')) AS norm, regexp_replace(lower(trim(p_type)), '[\\s-]+', '_', 'g') AS enum FROM {part}".replace("\\\\", "\\"))


def dictionary_hits(spark, sf_dir):
    """JN-21, FN-28: tokens that are in a word list; the list is a small table, sent to all."""
    d = docs(spark, sf_dir).select("doc_id", F.explode(F.transform(text.words("text"), F.lower)).alias("w"))
    known = d.sparkSession.createDataFrame([(w,) for w in ENGLISH], "w string")
    hits = d.join(F.broadcast(known.withColumn("hit", F.lit(1))), "w", "left")
    return hits.groupBy("doc_id").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1)), 8).alias("ratio"))


ENGLISH = ["the", "and", "of", "to", "in", "is", "that", "for", "with", "as", "was", "are"]
put("dictionary_hits", dictionary_hits, f"WITH w AS (SELECT doc_id, lower(unnest({W_SQL})) AS w FROM {{documents}}) SELECT doc_id, CAST(sum(CASE WHEN w IN ({', '.join(repr(w) for w in ENGLISH)}) THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(avg(CASE WHEN w IN ({', '.join(repr(w) for w in ENGLISH)}) THEN 1 ELSE 0 END), 8) AS ratio FROM w GROUP BY doc_id")


def long_sentence_share(spark, sf_dir):
    """FN-21, FN-28: share of sentences of over 40 words; 1 where there is none."""
    s = docs(spark, sf_dir).select("doc_id", text.sentences("text", 1, False).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("sentences"), F.round(F.when(F.size("s") == 0, F.lit(1.0)).otherwise(F.size(F.filter("s", lambda x: (text.n_words(x)) > 40)) / F.size("s")), 8).alias("share"))


put(
    "long_sentence_share",
    long_sentence_share,
    r"WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]\s+')) AS text FROM {documents}), n AS (SELECT doc_id, len(" + W_SQL + ") AS n FROM s), g AS (SELECT doc_id, count(*) AS k, avg(CASE WHEN n > 40 THEN 1 ELSE 0 END) AS share FROM n WHERE n >= 1 GROUP BY doc_id) SELECT d.doc_id, coalesce(k, 0) AS sentences, round(coalesce(share, 1.0), 8) AS share FROM {documents} d LEFT JOIN g ON g.doc_id = d.doc_id",
)


def verbatim_overlap(spark, sf_dir):
    """FN-15: items quoted word for word; only documents with three neighbouring inner words of an item are searched for it."""
    return relational.quotes(docs(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote")), "doc_id", "item_id")


put("verbatim_overlap", verbatim_overlap, "SELECT doc_id, item_id FROM {documents} d JOIN {benchmark} b ON contains(d.text, b.text)")


def jaccard_dedupe(spark, sf_dir):
    """JN-22: documents grouped by their words: the first document of the earliest group alike by a Jaccard of 0.35 or more."""
    w = F.array_sort(F.array_distinct(F.transform(text.words("text"), lambda x: F.xxhash64(F.lower(x)))))
    groups = relational.first_match_groups(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), w.alias("w")), 35, 100)
    return groups.select(F.col("id").alias("doc_id"), F.col("first").alias("group_id"), F.round("jaccard", 6).alias("jaccard"))


put(
    "jaccard_dedupe",
    jaccard_dedupe,
    f"""WITH RECURSIVE w AS (SELECT DISTINCT doc_id, lower(unnest({W_SQL})) AS t FROM {{documents}}), n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM w a JOIN w b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b, c / (x.n + y.n - c) AS j FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 35 * (x.n + y.n - c)),
d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k, coalesce(cand, []) AS cand FROM {{documents}} LEFT JOIN (SELECT b, list(a ORDER BY a) AS cand FROM e GROUP BY b) AS l ON b = doc_id),
r AS (SELECT k, doc_id, doc_id AS group_id, [doc_id] AS leads FROM d WHERE k = 1
UNION ALL SELECT k, doc_id, coalesce(f, doc_id), CASE WHEN f IS NULL THEN list_append(leads, doc_id) ELSE leads END FROM (SELECT d.k, d.doc_id, r.leads, list_intersect_first(d.cand, r.leads) AS f FROM r JOIN d ON d.k = r.k + 1) AS t)
SELECT r.doc_id, group_id, round(CASE WHEN n.n IS NULL THEN NULL WHEN group_id = r.doc_id THEN 1.0 ELSE j END, 6) AS jaccard FROM r LEFT JOIN n ON n.doc_id = r.doc_id LEFT JOIN e ON e.a = group_id AND e.b = r.doc_id""".replace("list_intersect_first(d.cand, r.leads)", "list_min(list_intersect(d.cand, r.leads))"),
)


def cosine_pairs(spark, sf_dir):
    """FN-47: of vectors of one label, each with the next by id."""
    e = table(spark, sf_dir, "embeddings").withColumn("next", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id")))
    return e.where("next IS NOT NULL").select("vec_id", F.round(text.cosine("embedding", "next"), 6).alias("cosine"))


put("cosine_pairs", cosine_pairs, "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(nx AS DOUBLE[])), 6) AS cosine FROM (SELECT vec_id, embedding, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS nx FROM {embeddings}) WHERE nx IS NOT NULL")


def props_json_fields(spark, sf_dir):
    """FN-1 on valid JSON."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


put("props_json_fields", props_json_fields, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM {events}")


def loose_json(spark, sf_dir):
    """FN-1 to FN-3: objects in talk, with a closer lost on the way."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Sure: "), F.regexp_replace("props", r"\}\s*$", "")).alias("t"))
    return e.select("event_id", text.parse_json_loose("t").alias("json"))


put("loose_json", loose_json, "SELECT event_id, replace(props, ' ', '') AS json FROM {events}")

add(
    "html_regex_qa",
    "AG-25: counts of patterns in pages.",
    r"SELECT page_id, CAST(TAGS AS BIGINT) AS tags, CAST(LINKS AS BIGINT) AS links, contains(html, '<script') AS scripts FROM {pages}",
    spark={"TAGS": r"regexp_count(html, '<[a-zA-Z]')", "LINKS": "regexp_count(html, 'href=')"},
    duck={"TAGS": r"len(regexp_extract_all(html, '<[a-zA-Z]'))", "LINKS": "len(regexp_extract_all(html, 'href='))"},
)
add("turn_explode", "PRJ-8: turns as rows with totals of their conversation.", "SELECT conv_id, turn, role, length(text) AS n_chars, CAST(sum(length(text)) OVER (PARTITION BY conv_id) AS BIGINT) AS total FROM {conversations}", spark={"length(text)": "CAST(length(text) AS BIGINT)"})
add("first_last_turn", "WN-11, PRJ-9: the first and last turn of a conversation.", "SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n, count(CASE WHEN role = 'assistant' THEN 1 END) AS answers FROM {conversations} GROUP BY conv_id")


def trapezoid_energy(spark, sf_dir):
    """WN-6: trapezoids between samples of a user."""
    e = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = e.withColumn("d", F.col("t") - F.lag("t").over(w)).withColumn("m", (F.col("value") + F.lag("value").over(w)) / 2)
    return e.groupBy("user_id").agg(F.round(F.sum(F.col("d") * F.col("m")) / 1e6, 4).alias("mj"))


put("trapezoid_energy", trapezoid_energy, "SELECT user_id, round(sum(d * m) / 1e6, 4) AS mj FROM (SELECT user_id, epoch(ts) - lag(epoch(ts)) OVER w AS d, (value + lag(value) OVER w) / 2 AS m FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY user_id")


def _samples(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "value")


def range_join_window(spark, sf_dir):
    """JN-15, ST-25: samples around each purchase, mean and count."""
    s = _samples(spark, sf_dir)
    w = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("call"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t0")).withColumn("t1", F.col("t0") + 86400)
    return timeseries.range_join(s, w, "user_id", "t", "t0", "t1", 2.0, 43200.0).groupBy("user_id", "call").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_w"))


put("range_join_window", range_join_window, "WITH w AS (SELECT user_id, event_id AS call, epoch(ts) AS t0 FROM {events} WHERE event_type = 'purchase') SELECT w.user_id, call, count(*) AS n, round(avg(value), 6) AS mean_w FROM w JOIN {events} e ON e.user_id = w.user_id AND epoch(e.ts) BETWEEN t0 - 2 AND t0 + 86402 GROUP BY w.user_id, call")


def asof_interpolate(spark, sf_dir):
    """JN-16: the latest purchase value at or before each error."""
    e = _samples(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    left = e.where("event_type = 'error'").select("user_id", "event_id", "t")
    right = e.where("event_type = 'purchase'").groupBy("user_id", "t").agg(F.max("value").alias("value"))
    return timeseries.as_of(left, right, "user_id", "t", "value", "before").select("user_id", "event_id", F.round("before", 6).alias("before"))


put("asof_interpolate", asof_interpolate, "WITH p AS (SELECT user_id, ts, max(value) AS value FROM {events} WHERE event_type = 'purchase' GROUP BY user_id, ts) SELECT e.user_id, e.event_id, round(p.value, 6) AS before FROM (SELECT * FROM {events} WHERE event_type = 'error') e ASOF LEFT JOIN p ON p.user_id = e.user_id AND e.ts >= p.ts")


def energy_segments(spark, sf_dir):
    """ST-24, ST-25: integral over each purchase's hour of a user's samples, interpolated at its edges."""
    s = _samples(spark, sf_dir).groupBy("user_id", "t").agg(F.avg("value").alias("value"))
    w = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("call"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t0")).withColumn("t1", F.col("t0") + 3600)
    return timeseries.integrate(s, w, "user_id", "call", "t", "value", "t0", "t1", 7200.0, 7200.0).select("user_id", "call", F.round("integral", 3).alias("joules"))


put("energy_segments", energy_segments, ENERGY_SQL)


def title_similarity(spark, sf_dir):
    """FN-31, FN-32, JN-18: page titles with letters swapped as seeds, against all page titles; hosts are authors, some works have none, languages are sources."""
    p = table(spark, sf_dir, "pages").withColumn("k", F.col("page_id"))
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    host = F.regexp_extract("url", r"//(?:m\.|www\.)?([^./]*)", 1)
    seeds = p.select(F.col("k").alias("seed"), F.when(F.col("k") % 3 == 0, F.translate(title, "xz", "zx")).when(F.col("k") % 3 == 1, F.concat(title, F.lit(": a note"))).otherwise(title).alias("title"), F.when(F.col("k") % 7 != 0, 2000 + F.col("k") % 4).cast("int").alias("year"), F.concat(F.lit("Dr. "), host).alias("author"), F.when(F.col("k") % 11 == 0, "arxiv").alias("type"))
    years = F.when(F.col("k") % 5 == 0, F.array().cast("array<int>")).otherwise(F.array((2000 + F.col("k") % 6).cast("int")))
    authors = F.when(F.col("k") % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Ann Other"), F.concat(F.lit("É. "), host, F.lit("son"))))
    found = p.select(F.col("k").alias("pos"), title.alias("title"), years.alias("years"), authors.alias("authors"), (F.col("k") % 2).alias("source"))
    return references.best_match(seeds, found).select("seed", "source", "pos", F.round("similarity", 6).alias("similarity"), "agrees")


put(
    "title_similarity",
    title_similarity,
    r"""WITH RECURSIVE p AS (SELECT page_id AS k, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t, regexp_extract(url, '//(?:m\.|www\.)?([^./]*)', 1) AS host FROM {pages}),
seeds AS (SELECT k AS seed, CASE k % 3 WHEN 0 THEN translate(t, 'xz', 'zx') WHEN 1 THEN t || ': a note' ELSE t END AS st, CASE WHEN k % 7 <> 0 THEN 2000 + k % 4 END AS year, host, k % 11 = 0 AS preprint FROM p),
found AS (SELECT k AS pos, t AS ct, CASE WHEN k % 5 <> 0 THEN 2000 + k % 6 END AS y, CASE WHEN k % 6 <> 0 THEN host END AS who, k % 2 AS source FROM p),
v AS (SELECT st AS t, 0 AS side FROM seeds UNION SELECT ct, 1 FROM found),
w AS (SELECT side, t, head, trim(regexp_replace(lower(strip_accents(CASE WHEN head THEN split_part(t, ':', 1) ELSE t END)), '[^a-z0-9]+', ' ', 'g')) AS f FROM v, (VALUES (false), (true)) h(head)),
x AS (SELECT * FROM w WHERE f <> '' AND (NOT head OR length(f) >= 15)),
cand AS MATERIALIZED (SELECT a.f AS fa, b.f AS fb, row_number() OVER () AS id FROM (SELECT DISTINCT f FROM x WHERE side = 0) a, (SELECT DISTINCT f FROM x WHERE side = 1) b
  WHERE 2 * least(length(a.f), length(b.f)) >= 0.9 * (length(a.f) + length(b.f))
  AND 2 * list_sum(list_transform(string_split('abcdefghijklmnopqrstuvwxyz0123456789 ', ''), lambda c: least(length(a.f) - length(replace(a.f, c, '')), length(b.f) - length(replace(b.f, c, ''))))) >= 0.9 * (length(a.f) + length(b.f)) - 1e-9),
blk AS (SELECT id, fa, fb, 1 AS alo, length(fa) + 1 AS ahi, 1 AS blo, length(fb) + 1 AS bhi, CAST(0 AS BIGINT) AS m FROM cand
  UNION ALL
  SELECT id, fa, fb, CASE WHEN side = 0 THEN alo ELSE i + n END, CASE WHEN side = 0 THEN i ELSE ahi END, CASE WHEN side = 0 THEN blo ELSE j + n END, CASE WHEN side = 0 THEN j ELSE bhi END, CASE WHEN side = 0 THEN n ELSE 0 END
  FROM (SELECT id, any_value(fa) AS fa, any_value(fb) AS fb, alo, any_value(ahi) AS ahi, blo, any_value(bhi) AS bhi, arg_min(i, (-n, i, j)) AS i, arg_min(j, (-n, i, j)) AS j, max(n) AS n
    FROM (SELECT id, any_value(fa) AS fa, any_value(fb) AS fb, alo, any_value(ahi) AS ahi, blo, any_value(bhi) AS bhi, min(i) AS i, min(j) AS j, count(*) AS n
      FROM (SELECT *, i - row_number() OVER (PARTITION BY id, alo, blo, i - j ORDER BY i) AS run
        FROM (SELECT *, unnest(range(blo, bhi)) AS j FROM (SELECT * EXCLUDE (m), unnest(range(alo, ahi)) AS i FROM blk WHERE ahi > alo AND bhi > blo)) WHERE fa[i] = fb[j])
      GROUP BY id, alo, blo, i - j, run) GROUP BY id, alo, blo), (VALUES (0), (1)) s(side)),
ratio AS (SELECT fa, fb, 2.0::DOUBLE * sum(m) / (length(fa) + length(fb)) AS r FROM blk GROUP BY id, fa, fb),
alike AS (SELECT a.t AS st, b.t AS ct, max(r) AS similarity FROM ratio JOIN x a ON a.f = fa AND a.side = 0 JOIN x b ON b.f = fb AND b.side = 1 AND b.head = a.head WHERE r >= 0.9 GROUP BY 1, 2),
pair AS (SELECT seed, source, pos, similarity, who IS NULL OR length(host) < 3 OR contains(who || 'son', host) AS agrees, preprint,
  length(trim(regexp_replace(lower(strip_accents(st)), '[^a-z0-9]+', ' ', 'g'))) >= 40 AS wide FROM seeds JOIN alike USING (st) JOIN found USING (ct) WHERE year IS NULL OR y IS NULL OR abs(year - y) <= 1)
SELECT seed, source, arg_min(pos, (-similarity, pos)) AS pos, round(max(similarity), 6) AS similarity, arg_min(agrees, (-similarity, pos)) AS agrees
FROM pair WHERE agrees OR (wide AND NOT preprint AND similarity >= 0.95) GROUP BY seed, source""",
)


def p_values(spark, sf_dir):
    """ST-8, ST-11, ST-12: tail probabilities of the group means of quantities."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("m"), F.stddev_samp("l_quantity").alias("s"))
    g = g.withColumn("t", (F.col("m") - 25.5) / (F.col("s") / F.sqrt("n")))
    return g.select("l_linenumber", F.round("t", 6).alias("t"), F.round(special.t_p_value("t", F.col("n").cast("double") - 1), 6).alias("p_t"), F.round(2 * special.norm_sf(F.abs("t")), 6).alias("p_z"))


put("p_values", p_values)


def scored_answers(spark, sf_dir):
    """FN-24, AG-20: conversation answers through the length, sentence and citation parts of the grounded scorer."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("item"), "text", F.array(F.lit("2020 12 %")).alias("sources"))
    return scorers.grounded(c).select("item", F.round("score", 6).alias("score"), "words", "n_sentences")


put("scored_answers", scored_answers)


def stratified_fixed_sample(spark, sf_dir):
    """FLT-1: ten documents per language by a seeded hash; the limit is the operator's purpose."""
    return relational.stratified_sample(docs(spark, sf_dir).select("doc_id", "lang"), "lang", "doc_id", 10, 7)


put("stratified_fixed_sample", stratified_fixed_sample)


def greedy_batches(spark, sf_dir):
    """WN-12: texts of a source into batches of at most 20,000 characters."""
    d = docs(spark, sf_dir).select("source", "doc_id", "n_chars")
    return relational.size_batches(d, "source", "doc_id", "n_chars", 20_000)


put(
    "greedy_batches",
    greedy_batches,
    """WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM {documents}),
r AS (SELECT source, doc_id, n_chars, k, CAST(0 AS BIGINT) AS batch, CAST(coalesce(n_chars, 0) AS BIGINT) AS total FROM d WHERE k = 1
UNION ALL SELECT d.source, d.doc_id, d.n_chars, d.k, CASE WHEN total + coalesce(d.n_chars, 0) > 20000 THEN batch + 1 ELSE batch END, CASE WHEN total + coalesce(d.n_chars, 0) > 20000 THEN 0 ELSE total END + coalesce(d.n_chars, 0)
FROM r JOIN d ON d.source IS NOT DISTINCT FROM r.source AND d.k = r.k + 1) SELECT source, doc_id, n_chars, CAST(batch AS INTEGER) AS batch FROM r""",
)


def set_f1(spark, sf_dir):
    """SO-4, FN-16: word sets of neighbouring turns."""
    c = table(spark, sf_dir, "conversations").withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.where("next IS NOT NULL").select("conv_id", "turn", F.round(text.set_f1(text.words("text"), text.words("next")), 8).alias("f1"))


put("set_f1", set_f1, "WITH c AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM {conversations}), w AS (SELECT conv_id, turn, list_distinct(" + W_SQL.replace("(text", "(a") + ") AS x, list_distinct(" + W_SQL.replace("(text", "(b") + ") AS y FROM c WHERE b IS NOT NULL) SELECT conv_id, turn, round(CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) END, 8) AS f1 FROM w")

QUERIES, SQL = D.queries, D.sql
