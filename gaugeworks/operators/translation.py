"""Translation runs: units from the cache, stages, their report, glossary, documents put together, papers in one text (SRC-24, SNK-11, JN-23, AG-26, RM-9, UD-6)."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions import tex

STAGES = ("draft", "review")
INPUT = regex.compile(r"\\(?:input|include)\{([^}]+)\}")
PREAMBLE = regex.compile(r"\\(?:usepackage|documentclass|graphicspath|newcommand)\b.*")


def _without(units: DataFrame, stage: str, bad: Column, own: bool) -> DataFrame:
    """Takes a stage's back translation and its figures away where `bad`, with `own` its output too."""
    outs = [f"back_{stage}", *([stage] if own else [])]
    figures = [f"sim_{stage}", f"back_{stage}_sim", f"qa_{stage}", *([f"back_{stage}_failed"] if own else [])]
    bad = F.coalesce(bad, F.lit(False))
    drop = lambda m, keys: F.when(bad, F.map_filter(m, lambda k, _: ~k.isin(keys))).otherwise(F.col(m))
    return units.withColumns({"out": drop("out", outs), "metrics": drop("metrics", figures)})


def reuse_cached(units: DataFrame, cache: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """JN-23: units with what the cache holds for the same masked text, last entry by seq: final, out, metrics.

    units: unit, masked. cache: masked, seq, final, out map<string,string>, metrics map<string,double>; empty texts do not
    count. A stage's output that no longer keeps the unit's placeholders goes with its figures, as does a back translation
    equal to its own input. A unit the cache does not know has empty maps."""
    last = cache.where("masked <> ''").groupBy("masked").agg(F.max_by(F.struct("final", "out", "metrics"), "seq").alias("c"))
    out = units.join(last, "masked", "left").select(*units.columns, "c.*")
    empty = lambda c, t: F.coalesce(c, F.create_map().cast(f"map<string,{t}>"))
    out = out.withColumns({"out": empty("out", "string"), "metrics": empty("metrics", "double")})
    for s in stages:
        out = _without(out, s, ~tex.intact(F.col("masked"), F.try_element_at("out", F.lit(s))), True)
    for s in stages:
        said = lambda k: F.trim(F.try_element_at("out", F.lit(k)))
        out = _without(out, s, said(f"back_{s}") == said(s), False)
    return out


def run_stage(units: DataFrame, stage: str, answer: Callable[[pd.Series], pd.Series], accept: Callable[[str, str], bool]) -> DataFrame:
    """UD-6: units with the stage's output in `out`, where it was not there: answer() takes masked texts in batches, and what
    accept(masked, answer) refuses is asked once more by itself and then left out."""
    schema = units.schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            outs = [dict(o) if o is not None else {} for o in rows["out"]]
            todo = [k for k, o in enumerate(outs) if stage not in o]
            masked = rows["masked"]
            got = list(answer(masked.iloc[todo])) if todo else []
            for k, a in zip(todo, got, strict=True):
                if a is None or not accept(masked.iloc[k], a):
                    a = answer(masked.iloc[[k]]).iloc[0]
                if a is not None and accept(masked.iloc[k], a):
                    outs[k][stage] = a
            yield rows.assign(out=pd.Series(outs, index=rows.index, dtype=object))

    return units.mapInPandas(run, schema)


def stage_report(units: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """AG-26: a row a stage: means of seconds and cosines, mean and number of edits (of the last stage), units it was selected for.

    units: metrics map<string,double>, selected. Means are over the units that have the figure, to three places."""
    named = lambda p, s="": F.try_element_at("metrics", F.concat(F.lit(p), F.col("stage"), F.lit(s)))
    edit = F.when(F.col("stage") == stages[-1], named("", "_edit"))
    mean = lambda c: F.round(F.avg(c), 3)
    rows = units.withColumn("stage", F.explode(F.array(*map(F.lit, stages))))
    return rows.groupBy("stage").agg(
        mean(named("", "_s")).alias("s_per_unit"),
        mean(named("sim_")).alias("cosine_direct"),
        mean(named("back_", "_sim")).alias("cosine_back"),
        mean(edit).alias("edit_ratio"),
        F.count_if(edit > 0).alias("changed"),
        F.count_if(F.col("selected") == F.col("stage")).alias("selected"),
    )


def glossary_hits(units: DataFrame, glossary: DataFrame) -> DataFrame:
    """AG-26: unit, n_terms, n_kept: terms that stand as whole words in a unit's masked text, and those of them whose target,
    up to ` (`, is in the final text. Case does not matter.

    units: unit, masked, final (null: not counted). glossary: term, target; terms that end in ` N` or hold no word character do
    not count. A term meets only the texts that hold its first word, so no unit meets every term."""
    first = F.regexp_extract(F.lower("term"), r"(?U)\w+", 0)
    terms = glossary.where(~F.col("term").endswith(" N")).select(first.alias("w"), F.lower("term").alias("term"), F.substring_index(F.lower("target"), " (", 1).alias("target")).where("w <> ''")
    texts = units.where("final IS NOT NULL").select("unit", F.lower("masked").alias("masked"), F.lower("final").alias("final"))
    words = texts.select("*", F.explode(F.array_distinct(F.regexp_extract_all("masked", F.lit(r"(?U)\w+"), F.lit(0)))).alias("w"))
    pattern = F.concat(F.lit(r"(?U)\b\Q"), F.replace("term", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
    met = words.join(terms, "w").where(F.rlike("masked", pattern))
    return met.groupBy("unit").agg(F.count(F.lit(1)).alias("n_terms"), F.count_if(F.contains("final", "target")).alias("n_kept"))


def plan_counts(units: DataFrame) -> DataFrame:
    """RM-9: units, words, placeholders and tags of a dry run. units: masked, held, tags; placeholders and tags are no words."""
    text = F.regexp_replace("masked", r"⟦\d+⟧|</?\d+>", " ")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return units.agg(F.count(F.lit(1)).alias("units"), total(F.regexp_count(text, F.lit(r"(?U)\S+"))).alias("words"), total(F.size("held")).alias("placeholders"), total(F.size("tags")).alias("tags"))


def documents(pieces: DataFrame, key: str = "file", pos: str = "pos", text: str = "text", sep: str = "\n") -> DataFrame:
    """SNK-11: key, text: a document's pieces by position, ties by text; null pieces are left out. A document is one cell."""
    parts = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(pos, text))))
    return pieces.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p[text]), sep).alias(text))


def round_trip(rendered: DataFrame, originals: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """RM-9: key, same: whether a document comes back as it was; one that does not come back at all is not the same."""
    back = rendered.select(key, F.col(text).alias("_back"))
    return originals.join(back, key, "left").select(key, F.col(text).eqNullSafe(F.col("_back")).alias("same"))


def roles(spec: str, usual: dict[str, tuple[str, str]]) -> dict[str, tuple[str, str]]:
    """RM-9: engine and model by stage: `multi` for the usual ones, `single:engine:model` for a draft of its own and no review."""
    kind, *named = spec.split(":", 2)
    if spec == "multi":
        return dict(usual)
    if kind != "single" or len(named) < 2:
        raise ValueError(f"pipeline {spec!r} is neither multi nor single:engine:model")
    return {s: r for s, r in usual.items() if s != "review"} | {"draft": tuple(named)}


def flatten(files: dict[str, str], main: str, limit: int | None = 60000) -> str:
    """SRC-24: one text of a paper's files: inputs put in where they stand (once each; looked for beside the main file, then beside
    the file that names them; missing ones are nothing), behind \\begin{document}, without preamble commands, macros expanded.

    Comments are off already. `limit` is the length of the excerpt a reviewer sees; None gives it whole."""
    known: dict[str, str] = {}
    seen: set[str] = set()
    out: list[str] = []
    todo = [(main, None)]
    while todo:
        path, rest = todo.pop()
        if rest is None:  # a file that is opened
            if path in seen or path not in files:
                continue
            seen.add(path)
            rest = files[path] or ""
            known |= tex.definitions(rest)
        m = INPUT.search(rest)
        out.append(rest[: m.start()] if m else rest)
        if m:
            todo.append((path, rest[m.end() :]))
            name = tex.expand(m[1], known).strip()
            name += "" if name.endswith(".tex") else ".tex"
            beside = [posixpath.normpath(posixpath.join(posixpath.dirname(p), name)) for p in (main, path)]
            todo.append((beside[0] if beside[0] in files else beside[1], None))
    body = "".join(out).split("\\begin{document}", 1)[-1]
    return tex.expand(PREAMBLE.sub("", body), known)[:limit]


def papers(files: DataFrame, limit: int | None = 60000) -> DataFrame:
    """SRC-24: paper, text of rows paper, path, text, main (whether a paper's main file; the first by path, else none and no row)."""
    rows = files.withColumn("text", tex.strip_comments("text"))
    main = rows.groupBy("paper").agg(F.min(F.when(F.col("main"), F.col("path"))).alias("main")).where("main IS NOT NULL")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"paper": f["paper"].iloc[:1], "text": [flatten(dict(zip(f["path"], f["text"], strict=True)), f["main"].iloc[0], limit)]})

    schema = f"paper {files.schema['paper'].dataType.simpleString()}, text string"
    return rows.drop("main").join(main, "paper").select("paper", "path", "text", "main").groupBy("paper").applyInPandas(run, schema)


def pick_sources(works: DataFrame, n: int = 6, least: int = 500, languages: tuple[str, ...] = ("en", "id"), strict: bool = False) -> DataFrame:
    """RM-2: topic, ids, enough, sha256: the first n works of a topic by pos with a long enough abstract in one of the languages
    (null: the first of them). enough is false where there are fewer; strict raises instead. sha256 is of the chosen works as JSON.

    works: topic, pos, id, abstract, language; other columns are hashed along, by name."""
    fits = (F.length("abstract") >= least) & F.coalesce("language", F.lit(languages[0])).isin(*languages)
    top = works.where(fits).withColumn("_n", F.row_number().over(Window.partitionBy("topic").orderBy("pos", "id"))).where(F.col("_n") <= n)
    rest = sorted(c for c in works.columns if c not in ("topic", "pos"))
    got = top.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct(F.col("_n").alias("k"), F.to_json(F.struct(*rest)).alias("j"), F.col("id").alias("id")))).alias("s"))
    out = works.select("topic").distinct().join(got, "topic", "left").withColumn("s", F.coalesce("s", F.array().cast(got.schema["s"].dataType)))
    enough = F.size("s") == n
    if strict:
        enough = F.when(enough, True).otherwise(F.raise_error(F.concat(F.lit("too few sources: "), F.col("topic").cast("string"))).cast("boolean"))
    return out.select("topic", F.transform("s", lambda x: x["id"]).alias("ids"), enough.alias("enough"), F.sha2(F.concat(F.lit("["), F.array_join(F.transform("s", lambda x: x["j"]), ","), F.lit("]")), 256).alias("sha256"))


def selected_stage(units: DataFrame, stages: tuple[str, ...] = ("draft", "review"), margin: float = 0.02, qa: bool = True) -> DataFrame:
    """FN-47: units with metrics and selected: the stage whose text is final, and final, that text.

    units: out map<string,string>, metrics map<string,double>. A stage's quality qa_<stage> is the mean of its cosine and that of its
    back translation, to three places, or its cosine alone without one. The last stage wins unless its quality is more than
    `margin` below the first one's; a missing quality is 0. A winner without a text gives way to the first stage; without qa, or with one
    stage, no quality counts."""
    at = lambda m, k: F.try_element_at(m, F.lit(k))
    made = lambda k: F.array_contains(F.map_keys("out"), k)
    first, last = stages[0], stages[-1]
    for s in stages:
        d, b = at("metrics", f"sim_{s}"), F.coalesce(at("metrics", f"back_{s}_sim"), F.lit(0.0))
        blend = F.when(made(s) & d.isNotNull(), F.when(made(f"back_{s}"), F.round(0.5 * d + 0.5 * b, 3)).otherwise(F.round(d, 3)))
        rest = F.map_filter("metrics", lambda k, v: k != f"qa_{s}")  # noqa: B023
        units = units.withColumn("metrics", F.when(blend.isNotNull(), F.map_concat(rest, F.create_map(F.lit(f"qa_{s}"), blend))).otherwise(F.col("metrics")))
    score = lambda s: F.coalesce(at("metrics", f"qa_{s}"), F.lit(0.0))
    best = F.when(score(last) >= score(first) - margin, last).otherwise(first) if qa and len(stages) > 1 else F.lit(last)
    units = units.withColumn("selected", F.when(made(best), best).otherwise(first))
    return units.withColumn("final", F.try_element_at("out", F.col("selected")))
