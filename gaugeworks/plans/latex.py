"""LaTeX queries: lines of TeX made of the names of parts."""

from pyspark.sql import functions as F

from gaugeworks.functions import tex
from gaugeworks.operators import relational
from gaugeworks.plans.dual import Dual
from gaugeworks.plans.fact import table

D = Dual()
put = D.put


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", F.col("p_size").cast("string").alias("size"))


def tex_masked(spark, sf_dir):
    """FN-41: masked lines, whether they come back, and whether a copy without its first placeholder is found out."""
    p = parts(spark, sf_dir).withColumn("t", F.concat("p_name", F.lit(r" \emph{"), "p_type", F.lit(r" \cite{k}} is~$"), "size", F.lit(r"$ or "), "size", F.lit(r"\% \label{x}")))
    m = p.withColumn("m", tex.mask_latex("t")).withColumn("bad", F.replace("m.masked", F.lit("⟦0⟧"), F.lit("")))
    return m.select("p_partkey", "m.masked", F.size("m.held").cast("long").alias("held"), (tex.unmask_latex("m.masked", "m.held", "m.tags") == F.col("t")).alias("back"), tex.intact("m.masked", "m.masked").alias("intact"), tex.intact("m.masked", "bad").alias("bad"))


put("tex_masked", tex_masked, "SELECT p_partkey, p_name || ' <1>' || p_type || ' ⟦0⟧</1> is⟦1⟧ or ' || p_size || '⟦2⟧ ⟦3⟧' AS masked, CAST(4 AS BIGINT) AS held, true AS back, true AS intact, false AS bad FROM {part}")


def tex_cells(spark, sf_dir):
    """FN-42."""
    line = F.concat("p_name", F.lit(r" & \textbf{a & "), "p_type", F.lit(r"} & $x & y$ \& "), "size")
    return parts(spark, sf_dir).select("p_partkey", F.explode(tex.split_cells(line)).alias("cell"))


put("tex_cells", tex_cells, r"SELECT p_partkey, unnest([p_name || ' ', ' \textbf{a & ' || p_type || '} ', ' $x & y$ \& ' || p_size]) AS cell FROM {part}")


def tex_macros(spark, sf_dir):
    """FN-43, FN-46, FN-49: definitions read, comments off, commands expanded, reference words and wording changed."""
    head = F.concat(F.lit(r"\newcommand{\name}{"), "p_name", F.lit(r" of \brand{}}\renewcommand*{\brand}{"), "p_brand", F.lit("}"))
    body = F.concat(F.lit("Figure~\\ref{f} shows \\name, 5\\% % not this\nof "), "p_type", F.lit(" in Section~\\ref{s}; Section \\names"))
    p = parts(spark, sf_dir).select("p_partkey", tex.expand_macros(tex.strip_comments(body), tex.macro_definitions(head)).alias("t"))
    p = p.select("p_partkey", tex.post_edits(tex.ref_words("t"), [("shows", "has"), ("never there", "nowhere")], [("Section", "Part")]).alias("e"))
    return p.select("p_partkey", "e.text", F.array_join("e.missing", ",").alias("missing"))


put("tex_macros", tex_macros, r"SELECT p_partkey, 'Gambar~\ref{f} has ' || p_name || ' of ' || p_brand || ', 5\% ' || chr(10) || 'of ' || p_type || ' in Bagian~\ref{s}; Part \names' AS text, 'never there' AS missing FROM {part}")


def headings(spark, sf_dir):
    """FN-45: names as paragraphs of several styles and numberings."""
    k = F.col("p_partkey") % 6
    style = F.when(k == 0, "Heading 2").when(k == 1, "Title")
    text = F.when(k == 2, F.concat(F.lit("IV. "), "p_name")).when(k == 3, F.concat(F.lit(" 2.1 "), "p_name")).when(k == 4, F.upper("p_type")).otherwise(F.col("p_name"))
    return parts(spark, sf_dir).select("p_partkey", tex.heading_level(style, text).alias("level"), tex.heading_text(text).alias("heading"))


put(
    "headings",
    headings,
    r"""WITH p AS (SELECT p_partkey, p_partkey % 6 AS k, p_name, upper(p_type) AS t FROM {part})
SELECT p_partkey, CAST(CASE k WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN CASE WHEN length(t) BETWEEN 4 AND 59 THEN 1 END END AS INTEGER) AS level,
CASE WHEN k = 4 THEN array_to_string(list_transform(string_split(lower(t), ' '), lambda x: upper(x[1]) || x[2:]), ' ') ELSE p_name END AS heading FROM p""",
)


def printed_numbers(spark, sf_dir):
    """JN-25: means printed with one decimal that are over 0.02 away from the mean, a printed one that is no longer there, and one not printed."""
    own = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("q"), "l_linenumber").alias("name")).agg(F.avg("l_quantity").cast("double").alias("value"))
    printed = own.where("name <> 'q1'").select("name", F.round("value", 1).alias("value")).unionByName(own.where("name = 'q2'").select(F.lit("gone").alias("name"), "value"))
    return relational.differing(printed, own, "name", "value", 0.02).select("name", "state", F.round("difference", 6).alias("difference"))


put(
    "printed_numbers",
    printed_numbers,
    """WITH own AS (SELECT 'q' || l_linenumber AS name, CAST(avg(l_quantity) AS DOUBLE) AS value FROM {lineitem} GROUP BY 1)
SELECT name, 'differs' AS state, round(abs(round(value, 1) - value), 6) AS difference FROM own WHERE name <> 'q1' AND abs(round(value, 1) - value) > 0.02
UNION ALL SELECT 'gone', 'not computed', NULL UNION ALL SELECT 'q1', 'not printed', NULL""",
)

QUERIES, SQL = D.queries, D.sql
