"""Queries on models and tests by group; the SQL twins are written from the definitions (normal equations, Newton rounds, quadrature)."""

from pyspark.sql import functions as F

from gaugeworks.operators import models
from gaugeworks.plans.dual import Dual
from gaugeworks.plans.fact import table
from gaugeworks.plans.runs import sql_norm, sql_t

D = Dual()
put = D.put


def rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes])


def line_regressions(spark, sf_dir):
    """RA-6: price on quantity and discount, by line number."""
    return rounded(models.ols_by(table(spark, sf_dir, "lineitem").withColumn("price", F.col("l_extendedprice") / 1000), ["l_linenumber"], "price", ["l_quantity", "l_discount"]).select("l_linenumber", "term", "coef", "se", "t", "p", "n", "r2", "adj_r2"))


put(
    "line_regressions",
    line_regressions,
    f"""WITH r AS (SELECT l_linenumber AS g, CAST(l_extendedprice AS DOUBLE) / 1000 AS y, CAST(l_quantity AS DOUBLE) AS x, CAST(l_discount AS DOUBLE) AS z FROM {{lineitem}}),
s AS (SELECT g, count(*) AS n, avg(y) AS my, avg(x) AS mx, avg(z) AS mz, var_pop(x) * count(*) AS xx, var_pop(z) * count(*) AS zz, var_pop(y) * count(*) AS yy, covar_pop(x, z) * count(*) AS xz, covar_pop(x, y) * count(*) AS xy, covar_pop(z, y) * count(*) AS zy FROM r GROUP BY g),
b AS (SELECT *, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS bx, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS bz, xx * zz - xz * xz AS det FROM s),
e AS (SELECT *, my - bx * mx - bz * mz AS b0, (yy - bx * xy - bz * zy) / (n - 3) AS mse, (bx * xy + bz * zy) / yy AS r2 FROM b),
t AS (SELECT g, n, r2, 'l_quantity' AS term, bx AS coef, sqrt(mse * zz / det) AS se FROM e UNION ALL SELECT g, n, r2, 'l_discount', bz, sqrt(mse * xx / det) FROM e
UNION ALL SELECT g, n, r2, 'const', b0, sqrt(mse * (1.0 / n + (mx * mx * zz + mz * mz * xx - 2 * mx * mz * xz) / det)) FROM e)
SELECT g AS l_linenumber, term, round(coef, 6) AS coef, round(se, 6) AS se, round(coef / se, 6) AS t, round(greatest(0, {sql_t('(coef / se)', '(n - 3)')}), 6) AS p, n, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 3), 6) AS adj_r2 FROM t""",
)


def return_odds(spark, sf_dir):
    """RA-20: whether a line was returned, on its quantity, by line number."""
    own = table(spark, sf_dir, "lineitem").select("l_linenumber", (F.col("l_returnflag") == "R").cast("double").alias("y"), (F.col("l_quantity") / 50).alias("q"))
    return rounded(models.logit_by(own, ["l_linenumber"], "y", ["q"]).select("l_linenumber", "term", "coef", "odds", "se", "p", "n", "mcfadden", "accuracy"))


def logit_sql(rounds: int = 8) -> str:
    """Newton's rounds written out."""
    steps = ["WITH r AS (SELECT l_linenumber AS g, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, CAST(l_quantity AS DOUBLE) / 50 AS q FROM {lineitem})", "b0 AS (SELECT g, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c, 0.0::DOUBLE AS vb, 0.0::DOUBLE AS vc FROM r GROUP BY g)"]
    for k in range(rounds):
        steps.append(f"""h{k} AS (SELECT r.g, any_value(b) AS b, any_value(c) AS c, sum(w * q * q) AS hqq, sum(w * q) AS hq, sum(w) AS h1, sum(q * (y - p)) AS gq, sum(y - p) AS g1 FROM (SELECT r.*, b, c, 1 / (1 + exp(-(b * q + c))) AS p, 1 / (1 + exp(-(b * q + c))) * (1 - 1 / (1 + exp(-(b * q + c)))) AS w FROM r JOIN b{k} USING (g)) r GROUP BY r.g),
b{k + 1} AS MATERIALIZED (SELECT g, b + (h1 * gq - hq * g1) / (hqq * h1 - hq * hq) AS b, c + (hqq * g1 - hq * gq) / (hqq * h1 - hq * hq) AS c, h1 / (hqq * h1 - hq * hq) AS vb, hqq / (hqq * h1 - hq * hq) AS vc FROM h{k})""")
    z = "abs(coef / se)"
    return ",\n".join(steps) + f""",
f AS (SELECT r.g, count(*) AS n, avg(y) AS s, sum(y * ln(p) + (1 - y) * ln(1 - p)) AS ll, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy FROM (SELECT r.*, 1 / (1 + exp(-(b * q + c))) AS p FROM r JOIN b{rounds} USING (g)) r GROUP BY r.g),
t AS (SELECT g, 'q' AS term, b AS coef, sqrt(vb) AS se FROM b{rounds} UNION ALL SELECT g, 'const', c, sqrt(vc) FROM b{rounds})
SELECT g AS l_linenumber, term, round(coef, 6) AS coef, round(exp(coef), 6) AS odds, round(se, 6) AS se, round(greatest(0, 2 * {sql_norm(z)}), 6) AS p, n, round(1 - ll / (n * (s * ln(s) + (1 - s) * ln(1 - s))), 6) AS mcfadden, round(accuracy, 6) AS accuracy FROM t JOIN f USING (g)"""


put("return_odds", return_odds, logit_sql())


def chosen_tests(spark, sf_dir):
    """RA-7, RA-28: balances of odd and even customers of five groups of nations, compared by the test that suits their shape."""
    own = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5).alias("nations"), F.when(F.col("c_custkey") % 2 == 0, "a").otherwise("b").alias("side"), (F.col("c_acctbal") + F.when(F.col("c_nationkey") % 5 < 2, F.pow(F.col("c_acctbal") / 4000, F.lit(5.0))).otherwise(0.0)).alias("v"))
    return rounded(models.chosen_tests(own, ["nations"], "side", "v"), 5)


def shapiro_sql(source: str) -> str:
    """CTEs from source(g, side, v) to sw(g, side, n, p) for groups of 6 values and more."""
    poly = lambda c, x: "(" + " + ".join(f"{v}::DOUBLE * pow({x}, {k})" for k, v in enumerate(c)) + ")"
    steps = [
        f"v AS (SELECT g, side, CAST(v AS DOUBLE) AS v, row_number() OVER (PARTITION BY g, side ORDER BY v) AS i, count(*) OVER (PARTITION BY g, side) AS n FROM {source})",
        "q0 AS (SELECT n, i, (i - 0.375::DOUBLE) / (n + 0.25::DOUBLE) AS p, (pow((i - 0.375::DOUBLE) / (n + 0.25::DOUBLE), 0.135::DOUBLE) - pow(1 - (i - 0.375::DOUBLE) / (n + 0.25::DOUBLE), 0.135::DOUBLE)) / 0.1975::DOUBLE AS z FROM (SELECT DISTINCT n, i FROM v))",
    ]
    for k in range(4):
        steps.append(f"q{k + 1} AS MATERIALIZED (SELECT n, i, p, z + (p - 1 + {sql_norm('z')}) * sqrt(2 * pi()) * exp(z * z / 2) AS z FROM q{k})")
    u, log_n = "(1 / sqrt(n))", "(ln(n))"
    large = f"(ln(1 - w) - {poly(models.C5, log_n)}) / exp({poly(models.C6, log_n)})"
    small = f"(-ln({poly(models.G, 'n')} - ln(1 - w)) - {poly(models.C3, 'n')}) / exp({poly(models.C4, 'n')})"
    tail = sql_norm(f"(CASE WHEN n <= 11 THEN {small} ELSE {large} END)")
    steps += [
        "m AS (SELECT n, sum(z * z) AS mm, max(z) AS m1, max(CASE WHEN i = n - 1 THEN z END) AS m2 FROM q4 GROUP BY n)",
        f"a AS (SELECT *, m1 / sqrt(mm) + {poly(models.C1, u)} AS a1, m2 / sqrt(mm) + {poly(models.C2, u)} AS a2 FROM m)",
        "c AS (SELECT q4.n, i, CASE WHEN i = q4.n THEN a1 WHEN i = 1 THEN -a1 WHEN i = q4.n - 1 THEN a2 WHEN i = 2 THEN -a2 ELSE z / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) END AS a FROM q4 JOIN a USING (n))",
        "w AS (SELECT g, side, n, pow(sum(a * v), 2) / (var_pop(v) * count(*)) AS w FROM v JOIN c USING (n, i) GROUP BY g, side, n)",
        f"sw AS (SELECT g, side, n, {tail} AS p FROM w)",
    ]
    return ",\n".join(steps)


put(
    "chosen_tests",
    chosen_tests,
    f"""WITH s AS (SELECT c_nationkey % 5 AS g, CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS side, c_acctbal + CASE WHEN c_nationkey % 5 < 2 THEN pow(CAST(c_acctbal AS DOUBLE) / 4000, 5.0) ELSE 0 END AS v FROM {{customer}}),
{shapiro_sql('s')},
r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY v) + (count(*) OVER (PARTITION BY g, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY g, v) AS ties FROM s),
k AS (SELECT g, count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb, avg(v) FILTER (side = 'a') AS ma, avg(v) FILTER (side = 'b') AS mb, var_samp(v) FILTER (side = 'a') AS va, var_samp(v) FILTER (side = 'b') AS vb,
CAST(sum(r) FILTER (side = 'a') AS DOUBLE) AS ra, sum(CAST(ties AS DOUBLE) * ties - 1) AS tie FROM r GROUP BY g),
j AS (SELECT k.*, x.p AS pa, y.p AS pb, x.p > 0.05 AND y.p > 0.05 AS normal, na + nb AS n, ra - na * (na + 1) / 2 AS u FROM k JOIN sw x ON x.g = k.g AND x.side = 'a' JOIN sw y ON y.g = k.g AND y.side = 'b'),
z AS (SELECT *, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (n - 2) * (1.0 / na + 1.0 / nb)) AS t, greatest(0, (abs(u - na * nb / 2.0) - 0.5) / sqrt(na * nb / 12.0 * (n + 1 - tie / (CAST(n AS DOUBLE) * (n - 1))))) AS zz FROM j)
SELECT g AS nations, n, round(greatest(0, pa), 5) AS sw_p_a, round(greatest(0, pb), 5) AS sw_p_b, CASE WHEN normal THEN 'student' ELSE 'mann_whitney' END AS test, round(CASE WHEN normal THEN t ELSE u END, 5) AS statistic,
round(greatest(0, CASE WHEN normal THEN {sql_t('t', '(n - 2)')} ELSE least(1, 2 * {sql_norm('zz')}) END), 5) AS p FROM z""",
)


def mean_pairs(spark, sf_dir):
    """RA-13, RA-17: totals of orders by priority, every two against each other, by status."""
    own = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", (F.col("o_totalprice") / 1000 + F.length("o_orderpriority") * 2).alias("v"))
    return rounded(models.mean_pairs(own, ["o_orderstatus"], "o_orderpriority", "v"), 4)


put(
    "mean_pairs",
    mean_pairs,
    f"""WITH g AS (SELECT o_orderstatus AS k, o_orderpriority AS g, count(*) AS n, avg(v) AS m, var_samp(v) AS v FROM (SELECT *, CAST(o_totalprice AS DOUBLE) / 1000 + length(o_orderpriority) * 2 AS v FROM {{orders}}) GROUP BY 1, 2),
t AS (SELECT k, count(*) AS c, sum(n) - count(*) AS free, sum((n - 1) * v) / (sum(n) - count(*)) AS mse, sum(n * m) / sum(n) AS grand FROM g GROUP BY k),
p AS (SELECT t.*, a.g AS a, b.g AS b, a.m - b.m AS diff, abs(a.m - b.m) / sqrt(mse / 2 * (1.0 / a.n + 1.0 / b.n)) AS q, sqrt(mse * (1.0 / a.n + 1.0 / b.n)) AS se FROM g a JOIN g b ON a.k = b.k AND a.g < b.g JOIN t ON t.k = a.k),
z AS (SELECT i, -8 + i * 0.01::DOUBLE AS z, exp(-0.5 * pow(-8 + i * 0.01::DOUBLE, 2)) / sqrt(2 * pi()) AS f, exp(-0.5 * pow(-8.005::DOUBLE + i * 0.01::DOUBLE, 2)) / sqrt(2 * pi()) AS h FROM range(0, 1601) x(i)),
cdf AS (SELECT i, f, coalesce(sum((f0 + 4 * h + f) * 0.01 / 6) OVER (ORDER BY i), 0) AS c FROM (SELECT *, lag(f) OVER (ORDER BY i) AS f0 FROM z)),
w AS MATERIALIZED (SELECT c, r, sum(c * 0.02::DOUBLE * f * pow(greatest(0, cdf_c - coalesce(low, 0)), c - 1)) AS w FROM (SELECT t.c, r.r, z.f, z.c AS cdf_c, y.c AS low FROM (SELECT DISTINCT c FROM t) t, (SELECT unnest(range(0, 801)) AS r) r, cdf z LEFT JOIN cdf y ON y.i = z.i - 2 * r.r WHERE z.i % 2 = 0) GROUP BY c, r),
e AS (SELECT k, a, b, c, free, 1 + i * 0.15::DOUBLE / sqrt(2 * free) AS s, 0.15::DOUBLE / sqrt(2 * free) AS step, q * (1 + i * 0.15::DOUBLE / sqrt(2 * free)) / 0.02::DOUBLE AS x FROM p, range(-44, 45) y(i)),
o AS (SELECT k, a, b, sum(step * exp(ln(2) + free / 2.0 * ln(free / 2.0) - lgamma(free / 2.0) + (free - 1) * ln(s) - free * s * s / 2) * (w.w + (x - w.r) * (up.w - down.w) / 2 + pow(x - w.r, 2) * (up.w - 2 * w.w + down.w) / 2)) AS inside
  FROM e JOIN w ON w.c = e.c AND w.r = greatest(1, CAST(round(x) AS BIGINT)) JOIN w up ON up.c = e.c AND up.r = w.r + 1 JOIN w down ON down.c = e.c AND down.r = w.r - 1 GROUP BY k, a, b),
t0 AS (SELECT DISTINCT free, 1.96::DOUBLE AS x FROM t),
t1 AS (SELECT free, x + ({sql_t('x', 'free')} - 0.05) / (2 * exp(lgamma((free + 1) / 2.0) - lgamma(free / 2.0)) / sqrt(free * pi()) * pow(1 + x * x / free, -(free + 1) / 2.0)) AS x FROM t0),
t2 AS (SELECT free, x + ({sql_t('x', 'free')} - 0.05) / (2 * exp(lgamma((free + 1) / 2.0) - lgamma(free / 2.0)) / sqrt(free * pi()) * pow(1 + x * x / free, -(free + 1) / 2.0)) AS x FROM t1)
SELECT p.k AS o_orderstatus, p.a, p.b, round(diff, 4) AS diff, round(q, 4) AS q, round(greatest(0, 1 - inside), 4) AS p_tukey, round(x * se, 4) AS lsd, abs(diff) > x * se AS differ, round(sqrt(mse) / grand * 100, 4) AS cv_pct
FROM p JOIN o ON o.k = p.k AND o.a = p.a AND o.b = p.b JOIN t2 ON t2.free = p.free""",
)


def anova_tables(spark, sf_dir):
    """RA-18, RA-19: quantities by return flag and mode, with the interaction and as randomised blocks."""
    own = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_linenumber") % 5).alias("mode"), (F.col("l_quantity") + F.col("l_linenumber") % 5).alias("v"))
    both = [models.anova_table(own, "l_returnflag", "mode", "v", i).withColumn("design", F.lit(n)) for i, n in ((True, "two-way"), (False, "blocks"))]
    return rounded(both[0].unionByName(both[1]), 5)


def sql_f(f: str, d1: str, d2: str) -> str:
    """Upper tail of F for two or more degrees of freedom, by Simpson's rule over the density up to f."""
    weight = "(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    x = f"(i * ({f}) / 2000.0::DOUBLE)"
    density = f"exp(({d1} / 2.0 - 1) * ln(greatest({x}, 1e-300::DOUBLE)) - ({d1} + {d2}) / 2.0 * ln(1 + {d1} * {x} / {d2}))"
    return f"(1 - exp(lgamma(({d1} + {d2}) / 2.0) - lgamma({d1} / 2.0) - lgamma({d2} / 2.0) + {d1} / 2.0 * ln({d1} / CAST({d2} AS DOUBLE))) * ({f}) / 6000 * list_sum(list_transform(range(0, 2001), lambda i: {weight} * {density})))"


put(
    "anova_tables",
    anova_tables,
    f"""WITH r AS (SELECT l_returnflag AS a, l_linenumber % 5 AS b, CAST(l_quantity + l_linenumber % 5 AS DOUBLE) AS v FROM {{lineitem}}),
t AS (SELECT count(*) AS n, avg(v) AS g, var_pop(v) * count(*) AS tot FROM r),
sa AS (SELECT sum(n * pow(m - g, 2)) AS ss, count(*) - 1 AS d FROM (SELECT a, count(*) AS n, avg(v) AS m FROM r GROUP BY a), (SELECT g FROM t)),
sb AS (SELECT sum(n * pow(m - g, 2)) AS ss, count(*) - 1 AS d FROM (SELECT b, count(*) AS n, avg(v) AS m FROM r GROUP BY b), (SELECT g FROM t)),
sc AS (SELECT sum(n * pow(m - g, 2)) AS ss, count(*) - 1 AS d FROM (SELECT a, b, count(*) AS n, avg(v) AS m FROM r GROUP BY a, b), (SELECT g FROM t)),
x AS (SELECT sa.ss AS sa, sb.ss AS sb, sc.ss AS sc, sa.d AS da, sb.d AS db, sc.d AS dc, n, tot FROM sa, sb, sc, t),
u AS (SELECT 'two-way' AS design, 'a' AS source, sa AS ss, da AS df, (tot - sc) / (n - 1 - dc) AS mse, n - 1 - dc AS dfe FROM x UNION ALL SELECT 'two-way', 'b', sb, db, (tot - sc) / (n - 1 - dc), n - 1 - dc FROM x
UNION ALL SELECT 'two-way', 'a:b', sc - sa - sb, dc - da - db, (tot - sc) / (n - 1 - dc), n - 1 - dc FROM x UNION ALL SELECT 'two-way', 'error', tot - sc, n - 1 - dc, (tot - sc) / (n - 1 - dc), n - 1 - dc FROM x
UNION ALL SELECT 'blocks', 'a', sa, da, (tot - sa - sb) / (n - 1 - da - db), n - 1 - da - db FROM x UNION ALL SELECT 'blocks', 'b', sb, db, (tot - sa - sb) / (n - 1 - da - db), n - 1 - da - db FROM x
UNION ALL SELECT 'blocks', 'error', tot - sa - sb, n - 1 - da - db, (tot - sa - sb) / (n - 1 - da - db), n - 1 - da - db FROM x)
SELECT source, round(ss, 5) AS ss, CAST(df AS DOUBLE) AS df, round(ss / df, 5) AS ms, CASE WHEN source <> 'error' THEN round(ss / df / mse, 5) END AS f, CASE WHEN source <> 'error' THEN round(greatest(0, {sql_f('(ss / df / mse)', 'df', 'dfe')}), 5) END AS p, design FROM u""",
)


def alpha_by_criterion(spark, sf_dir):
    """ST-22: orders as answers rated by three judges; agreement on the answers that all rated, by task and criterion (ordinal), on the mean score
    (interval) and on a label (nominal)."""
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("answer"), (F.col("l_linenumber") % 3).alias("judge"))
    r = r.agg(F.max(F.ceil(F.col("l_quantity") / 10)).cast("double").alias("a"), F.max(F.floor(F.col("l_discount") * 40) + 1).cast("double").alias("b"), F.max("l_returnflag").alias("label"))
    common = r.groupBy("answer").agg(F.count(F.lit(1)).alias("n")).where("n = 3").select("answer")
    own = r.join(common, "answer").withColumn("task", F.col("answer") % 4)
    long = own.select("task", "answer", F.explode(F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array("a", "b"))).alias("criterion", "v"))
    ordinal = models.alpha_by(long, ["task", "criterion"], ["answer"], "v", "ordinal")
    interval = models.alpha_by(own.withColumn("v", (F.col("a") + F.col("b")) / 2), ["task"], ["answer"], "v", "interval").withColumn("criterion", F.lit("mean"))
    nominal = models.alpha_by(own, ["task"], ["answer"], "label", "nominal").withColumn("criterion", F.lit("label"))
    return rounded(ordinal.unionByName(interval).unionByName(nominal))


put(
    "alpha_by_criterion",
    alpha_by_criterion,
    """WITH r AS (SELECT l_orderkey AS answer, l_linenumber % 3 AS judge, CAST(max(ceil(l_quantity / 10)) AS DOUBLE) AS a, CAST(max(floor(l_discount * 40) + 1) AS DOUBLE) AS b, max(l_returnflag) AS label FROM {lineitem} GROUP BY 1, 2),
o AS (SELECT *, answer % 4 AS task FROM r WHERE answer IN (SELECT answer FROM r GROUP BY answer HAVING count(*) = 3)),
l AS (SELECT task, 'a' AS criterion, answer, judge, a AS v FROM o UNION ALL SELECT task, 'b', answer, judge, b FROM o UNION ALL SELECT task, 'mean', answer, judge, (a + b) / 2 FROM o UNION ALL SELECT task, 'label', answer, judge, ascii(label) FROM o),
m AS (SELECT task, criterion, v, count(*) AS n FROM l GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY task, criterion ORDER BY v) - n / 2.0 AS mid FROM m),
x AS (SELECT a.task, a.criterion, a.v AS x, b.v AS y, a.n AS nx, b.n AS ny, CASE a.criterion WHEN 'label' THEN 1.0 WHEN 'mean' THEN pow(a.v - b.v, 2) ELSE pow(CAST(a.mid - b.mid AS DOUBLE), 2) END AS d FROM c a JOIN c b ON a.task = b.task AND a.criterion = b.criterion AND a.v <> b.v),
p AS (SELECT a.task, a.criterion, a.v AS x, b.v AS y, count(*) / 2.0 AS o FROM l a JOIN l b ON a.task = b.task AND a.criterion = b.criterion AND a.answer = b.answer AND a.judge <> b.judge GROUP BY ALL)
SELECT x.task, x.criterion, round(1 - ((SELECT sum(n) FROM m WHERE m.task = x.task AND m.criterion = x.criterion) - 1) * sum(coalesce(o, 0) * d) / sum(CAST(nx AS DOUBLE) * ny * d), 6) AS alpha,
CAST((SELECT sum(n) FROM m WHERE m.task = x.task AND m.criterion = x.criterion) AS BIGINT) AS n_pairable FROM x LEFT JOIN p USING (task, criterion, x, y) GROUP BY x.task, x.criterion""",
)

QUERIES, SQL = D.queries, D.sql
