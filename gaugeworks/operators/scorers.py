"""Deterministic task scorers over answer and reference columns (UD-1, UD-2; scoring formulas of structure, methodology,
extraction, grounded, references, language, coding, latex). Vocabularies and word lists are parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import text as T

#: UD-4: raised when a scorer changes what it gives; scores of an older version are made anew.
VERSIONS = {"methodology": 1, "structure": 1, "extraction": 2, "grounded": 1, "language": 1, "coding": 2, "references": 2, "latex": 2}


def versioned(answers: DataFrame, task: str = "task") -> DataFrame:
    """UD-4: answers with scorer_version, that of their task's scorer (null for tasks without one), to be a key of relational.split_reuse."""
    known = F.create_map(*[F.lit(x) for t, v in VERSIONS.items() for x in (t, v)])
    return answers.withColumn("scorer_version", F.try_element_at(known, F.col(task)))



def methodology(answers: DataFrame) -> DataFrame:
    """item, text, key."""
    chosen = T.option_letter("text")
    return answers.withColumn("chosen", chosen).withColumn("score", F.coalesce((F.col("chosen") == F.upper("key")).cast("double"), F.lit(0.0)))


def chapter(headings: str, rules: list[tuple[str, str]], weights: dict[str, float], other: str | None = None):
    """FN-10 to FN-12: recall by weight and precision over the distinct families of headings; unknown ones count as `other`, or not at all."""
    clean = lambda h: F.trim(F.regexp_replace(F.lower(h), "[^a-z/ ]", " "))
    families = F.transform(F.col(headings), lambda h: F.coalesce(T.first_family(clean(h), rules), F.lit(other)))
    got = F.array_distinct(F.filter(families, lambda f: f.isNotNull()))
    names = list(weights)
    hit = F.array_intersect(got, F.array(*map(F.lit, names)))
    weight = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    recall = F.aggregate(hit, F.lit(0.0), lambda s, f: s + F.element_at(weight, f)) / sum(weights.values())
    precision = F.when(F.size(got) > 0, F.size(hit) / F.size(got)).otherwise(0.0)
    f1 = F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0)
    return F.struct(got.alias("families"), recall.alias("recall"), precision.alias("precision"), f1.alias("f1"))


def structure(answers: DataFrame, ch3: tuple, ch4: tuple, topical: str) -> DataFrame:
    """item, h3, h4 (heading arrays). ch3, ch4: rules and weights."""
    out = answers.withColumn("ch3", chapter("h3", *ch3)).withColumn("ch4", chapter("h4", *ch4, other=topical))
    return out.withColumn("score", F.round((F.col("ch3.f1") + F.col("ch4.f1")) / 2, 4))


def extraction(answers: DataFrame, scalars: list[str], lists: list[str]) -> DataFrame:
    """FN-16: item, got struct, want struct, undecided map<string, array<string>>, optionally scored array<string>: the fields that the reference has
    (null: all). A field of the reference counts even where its value is null: exact scalars, null with null; set F1 of lists without
    undecided elements, two empty ones agree. Mean over the fields."""
    parts = []
    for f in scalars:
        parts.append((f, F.col(f"got.{f}").eqNullSafe(F.col(f"want.{f}")).cast("double")))
    for f in lists:
        open_ = F.coalesce(F.try_element_at("undecided", F.lit(f)), F.array().cast("array<string>"))
        side = lambda s: F.array_except(F.coalesce(F.col(f"{s}.{f}"), F.array().cast("array<string>")), open_)  # noqa: B023, E731
        parts.append((f, T.set_f1(side("got"), side("want"))))
    counts = lambda k: F.coalesce(F.array_contains("scored", k), F.lit(True)) if "scored" in answers.columns else F.lit(True)
    fields = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in parts]), lambda e: counts(e["key"])))
    return answers.withColumn("fields", fields).withColumn("score", mean_of_map("fields"))


def mean_of_map(name: str):
    """AG-20."""
    v = F.map_values(name)
    return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v))


#: What counts as a citation by author and year, (Name, 2020) and Name (2020), with others or a second name.
FOREIGN = (r"\(\s*[A-Z][A-Za-z'’\-]+(?:\s+(?:et\s+al\.?|dkk\.?|&\s+[A-Z][A-Za-z'’\-]+))?,?\s+\d{4}[a-z]?\s*\)", r"\b[A-Z][A-Za-z'’\-]+(?:\s+(?:et\s+al\.?|dkk\.?))?\s+\(\d{4}[a-z]?\)")


def grounded(answers: DataFrame, lo: int = 250, hi: int = 400) -> DataFrame:
    """item, text, sources (source texts in order), optionally years (of the sources): coverage, sentences with a valid citation, no
    invalid and no foreign citations, supported numbers, length."""
    n = F.size("sources")
    years = F.col("years").cast("array<string>") if "years" in answers.columns else F.array().cast("array<string>")
    out = answers.withColumn("cited", T.cited_numbers("text")).withColumn("sentences", T.sentences("text")).withColumn("words", F.size(T.words("text")))
    holds = lambda c: (c >= 1) & (c <= n)
    valid = F.array_distinct(F.filter("cited", holds))
    cited_sentences = F.size(F.filter("sentences", lambda s: F.exists(T.cited_numbers(s), holds)))
    foreign = sum((F.regexp_count(F.coalesce("text", F.lit("")), F.lit(p)) for p in FOREIGN[1:]), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(FOREIGN[0])))
    out = out.withColumn("_said", T.supported_numbers("text", "sources", years)).withColumn("numbers", F.col("_said.numbers")).withColumn("unsupported", F.col("_said.unsupported")).drop("_said")
    out = out.withColumn("foreign", foreign).withColumn("n_sentences", F.size("sentences"))
    parts = {
        "coverage": F.when(n > 0, F.size(valid) / n).otherwise(0.0),
        "cited": F.when(F.size("sentences") > 0, cited_sentences / F.size("sentences")).otherwise(0.0),
        "valid": F.forall("cited", holds).cast("double"),
        "own": (F.col("foreign") == 0).cast("double"),
        "numbers": F.when(F.col("numbers") > 0, 1 - F.size("unsupported") / F.col("numbers")).otherwise(1.0),
        "length": T.length_score("words", lo, hi),
    }
    out = out.withColumn("parts", F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)]))
    return out.withColumn("score", mean_of_map("parts"))


def english_share(w, english: list[str], own: list[str]):
    """FN-28: English function words among the function words of both languages; 1 where there is none."""
    within = lambda a: F.size(F.filter(w, lambda x: x.isin(a))) if a else F.lit(0)
    en, home = within(english), within(own)
    return F.when(en + home > 0, en / (en + home)).otherwise(1.0)


def key_terms(text: str):
    """FN-27: the text as terms are looked for in it: lower case, letters and digits by single blanks, one at each end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^0-9a-zà-ÿ]+", " ")), F.lit(" "))


def language(answers: DataFrame, english: list[str], nonstandard: list[str], lo: int, hi: int, own: list[str] | None = None, one_paragraph: bool = False) -> DataFrame:
    """item, text, numbers, terms (arrays to be kept), optionally source (the text it is made of; else numbers are all it may say): length,
    English share among function words of both languages (own: those of the text's), non-standard words, numbers by any reading, terms, long sentences."""
    w = F.transform(T.words("text"), F.lower)
    out = answers.withColumn("_w", w)
    ratio = english_share("_w", english, own or [])
    said = T.number_literals("text")
    source = T.number_literals("source") if "source" in answers.columns else F.col("numbers")
    out = out.withColumn("numbers_missing", T.without_reading("numbers", said)).withColumn("numbers_new", T.without_reading(said, source))
    s = T.sentences("text", 1, False)
    norm = lambda t: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(t), "[^0-9a-zà-ÿ]+", " ")), F.lit(" "))
    bad = F.size(F.filter("_w", lambda x: x.isin(nonstandard))) if nonstandard else F.lit(0)
    parts = {
        "length": T.length_score(F.size("_w"), lo, hi),
        "english": F.when(ratio <= 0.03, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - 5 * ratio)),
        "standard": F.greatest(F.lit(0.0), 1 - 0.25 * bad),
        "numbers": F.when(F.size("numbers") > 0, 1 - F.size("numbers_missing") / F.size("numbers")).otherwise(1.0),
        "invented": F.when(F.size(said) > 0, 1 - F.size("numbers_new") / F.size(said)).otherwise(1.0),
        "terms": F.when(F.size("terms") > 0, F.size(F.filter("terms", lambda t: F.contains(key_terms("text"), norm(t)))) / F.size("terms")).otherwise(1.0),
        "sentences": 1 - F.when(F.size(s) > 0, F.size(F.filter(s, lambda x: T.n_words(x) > 40)) / F.size(s)).otherwise(1.0),
    }
    if one_paragraph:
        parts["one_paragraph"] = ((F.size(F.filter(F.split("text", r"\n\s*\n"), lambda p: T.strip(p) != "")) == 1) & ~F.col("text").rlike(r"(?im)^\s*(#|\*\*|abstrak\b)")).cast("double")
    out = out.withColumn("parts", F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v.cast("double"))]))
    return out.withColumn("score", mean_of_map("parts")).drop("_w")


def coding(answers: DataFrame) -> DataFrame:
    """item, attempts array<map<string,double>> (values by key of each run), expected map<string,double>: share right at first, all right at first and at last."""
    right = lambda got: F.size(F.filter(F.map_entries("expected"), lambda e: T.near(F.try_element_at(got, e["key"]), e["value"])))
    n = F.size("expected")
    out = answers.withColumn("_first", right(F.get("attempts", F.lit(0)))).withColumn("_last", right(F.try_element_at("attempts", F.lit(-1))))
    return out.withColumn("score", F.col("_first") / n).withColumn("pass1", F.col("_first") == n).withColumn("pass_repair", F.col("_last") == n).drop("_first", "_last")


def coding_json(answers: DataFrame) -> DataFrame:
    """UD-1, FN-38: item, score, pass1, pass_repair, acc_final of programs by what they printed. answers: item (one row each), attempts array<string> (JSON
    of each run in turn), expected and tolerance (JSON objects). Keys are compared by value and type, each within its own tolerance."""
    from gaugeworks.operators.compare import compare

    tries = answers.select("item", "expected", "tolerance", F.posexplode("attempts").alias("turn", "got"), F.size("attempts").alias("runs")).where("turn = 0 OR turn = runs - 1")
    tries = tries.withColumn("run", F.struct("item", "turn"))
    ok = compare(tries, "run", "got", "expected", "tolerance").groupBy("run").agg(F.avg(F.col("ok").cast("double")).alias("acc"))
    best = tries.join(ok, "run", "left").groupBy("item").agg(F.min_by(F.coalesce("acc", F.lit(0.0)), "turn").alias("first"), F.max_by(F.coalesce("acc", F.lit(0.0)), "turn").alias("last"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = answers.select("item").join(best, "item", "left")
    return out.select("item", F.round(zero("first"), 4).alias("score"), (zero("first") == 1).alias("pass1"), (zero("last") == 1).alias("pass_repair"), F.round(zero("last"), 4).alias("acc_final"))


def reference_list(refs: DataFrame, requested: int = 5) -> DataFrame:
    """item, exists, doi_given, doi_right per listed reference: mean credit over those asked for; null if a check was not possible."""
    from gaugeworks.operators.references import credit

    c = credit(F.col("exists"), F.col("doi_given"), F.col("doi_right"))
    g = refs.withColumn("credit", c).groupBy("item").agg(F.sum("credit").alias("_s"), F.count_if(F.col("credit").isNull()).alias("_open"), F.count_if(~F.col("exists")).alias("not_found"), F.count(F.lit(1)).alias("returned"))
    return g.select("item", "returned", "not_found", F.when(F.col("_open") == 0, F.col("_s") / requested).alias("score"))


def table_cells(tex: str):
    """FN-39: cleaned cells of a tabular, by row."""
    body = F.regexp_extract(F.col(tex), r"(?s)\\begin\{tabular\}\{[^}]*\}(.*?)\\end\{tabular\}", 1)
    bare = F.regexp_replace(F.regexp_replace(body, r"\\(?:top|mid|bottom)rule|\\hline", ""), r"\\text(?:bf|it)\{([^{}]*)\}", "$1")
    rows = F.filter(F.transform(F.split(bare, r"\\\\"), T.strip), lambda r: r != "")
    return F.transform(rows, lambda r: F.transform(F.split(r, r"(?<!\\)&"), lambda c: F.lower(T.strip(F.regexp_replace(c, r"\$|\\(?=[%&_#])", "")))))


def cell_accuracy(got: str, want: str):
    """FN-39: cells right at their place less superfluous ones, over expected ones."""
    n = F.aggregate(F.col(want), F.lit(0), lambda s, r: s + F.size(r))
    m = F.aggregate(F.col(got), F.lit(0), lambda s, r: s + F.size(r))
    right = F.aggregate(F.zip_with(got, want, lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & y.isNotNull()), lambda v: v))), F.lit(0), lambda s, x: s + F.coalesce(F.greatest(x, F.lit(0)), F.lit(0)))
    return F.greatest(F.lit(0.0), (right - F.greatest(F.lit(0), m - n)) / n)


def latex_fix(compiled, snippets, text):
    """0.5 for compiling and 0.5 for the share of snippets; nothing unless it compiles."""
    share = F.size(F.filter(snippets, lambda s: F.contains(text, s))) / F.size(snippets)
    return F.when(compiled, 0.5 + 0.5 * share).otherwise(0.0)


def latex_table(compiled, accuracy, rules, labelled):
    return 0.3 * compiled.cast("double") + 0.5 * accuracy + 0.1 * (rules >= 3).cast("double") + 0.1 * labelled.cast("double")


def bibtex_entry(got, want):
    """FN-40: share of the expected type, key and fields that agree."""
    right = lambda e: F.when(e["key"].isin("_type", "_key"), F.lower(F.try_element_at(got, e["key"])).eqNullSafe(F.lower(e["value"]))).otherwise(T.field_agrees(e["key"], F.try_element_at(got, e["key"]), e["value"]))
    return F.size(F.filter(F.map_entries(want), right)) / F.size(want)


SCORERS = {"methodology": methodology, "structure": structure, "extraction": extraction, "grounded": grounded, "language": language, "coding": coding, "references": reference_list, "latex": latex_table}
