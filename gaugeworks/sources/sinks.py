"""Sinks: logs, score upserts, manifests, reports, key-value macros, rater sheets (SNK)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.relational import upsert


def append_log(df: DataFrame, path: str) -> None:
    """SNK-1."""
    df.write.mode("append").json(path)


def merge_scores(spark, path: str, new: DataFrame, keys: list[str], known: DataFrame | None = None) -> str:
    """SNK-2: writes the merged table beside the old one and gives its path; the caller swaps the reference, so a lost job changes nothing."""
    import uuid

    out = f"{path.rstrip('/')}-{uuid.uuid4().hex[:8]}"
    upsert(spark.read.parquet(path), new, keys, known).sortWithinPartitions(*keys).write.parquet(out)
    return out


def manifest(items: DataFrame) -> DataFrame:
    """SNK-7, DM-16: counts and id -> hash by task. items: task, privacy, id, sha256."""
    return items.groupBy("task").agg(
        F.count_if(F.col("privacy") == "public").alias("public"), F.count_if(F.col("privacy") == "private").alias("private"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "sha256")))).alias("items")
    )


def markdown(df: DataFrame, most: int = 1000) -> str:
    """SNK-3, SNK-4, PRJ-18: a small result as a Markdown table, rows in the order of df; nulls are dashes. More than `most` rows are an error."""
    cols = df.columns
    rows = df.limit(most + 1).select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("–")).alias(c) for c in cols]).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows are no report; write a table")
    return "\n".join(["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols), *["| " + " | ".join(r) + " |" for r in rows]])


def put_between(text: str, block: str, begin: str, end: str) -> str:
    """SNK-4: replaces what stands between two markers; the same input gives the same text."""
    head, mark, rest = text.partition(begin)
    _, close, tail = rest.partition(end)
    if not mark or not close:
        raise ValueError("markers not found")
    return f"{head}{begin}\n{block}\n{end}{tail}"


def macro_name(label: str) -> str:
    """PRJ-19: letters only: digits as words, parts capitalised."""
    import re

    digits = "Zero One Two Three Four Five Six Seven Eight Nine".split()
    return "".join(p[:1].upper() + p[1:] for p in re.split(r"[^A-Za-z]+", re.sub(r"\d", lambda m: f" {digits[int(m[0])]} ", label)) if p)


def macros(numbers: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    r"""SNK-5: \newcommand lines of a key-value relation."""
    return numbers.select(F.format_string(r"\newcommand{\%s}{%s}", F.col(key), F.coalesce(F.col(value).cast("string"), F.lit("–"))).alias("value"))


def rater_sheet(answers: DataFrame, per_task: int, seed: int) -> DataFrame:
    """SNK-8, WN-16: per_task answers of each task, models in turn and the least-used items first (operators/picks.py), under anonymous ids H01, H02 ..
    in a seeded order; answers: task, model, item, one row each, and what goes with them. Ids are numbered by ranges, not in one task."""
    from gaugeworks.operators.picks import balanced_picks, seeded
    from gaugeworks.operators.relational import running

    picked = balanced_picks(answers, per_task, seed).select("task", "model", "item").withColumn("o", seeded(seed + 2, "task", "model", "item")).withColumn("one", F.lit(1))
    named = running(picked, "o", "one", "sum", "n").select("task", "model", "item", F.format_string("H%02d", F.col("n")).alias("id"))
    return answers.join(named, ["task", "model", "item"])


def sorted_log(df: DataFrame, keys: list[str], path: str, files: int) -> None:
    """SL-2: rows as JSON lines in order of keys (unique together), in `files` folders file=0, file=1 .. of equal numbers of rows, the same bytes
    whatever the partitions of df. A row's place comes from ranges and their sizes; no task holds all rows."""
    from gaugeworks.operators.relational import running

    rows = df.select(F.struct(*keys).alias("key"), F.to_json(F.struct(*df.columns)).alias("value"), F.lit(1).alias("one"))
    placed = running(rows, "key", "one", "sum", "place")
    total = placed.count()
    file = F.floor((F.col("place") - 1) * files / F.lit(max(total, 1))).cast("int")
    out = placed.select(file.alias("file"), "place", "value").repartition(files, "file").sortWithinPartitions("file", "place")
    out.select("file", "value").write.partitionBy("file").text(path)


def canonical_csv(df: DataFrame, path: str, names: list[str]) -> None:
    """SNK-12."""
    if df.columns != names:
        raise ValueError(f"columns {df.columns}, expected {names}")
    df.coalesce(1).write.csv(path, header=True)


def bibtex(refs: DataFrame) -> DataFrame:
    """SNK-10: entries of key, type, title, author array, year, doi."""
    line = lambda k, c: F.when(c.isNotNull(), F.concat(F.lit(f"  {k} = {{"), c.cast("string"), F.lit("},\n"))).otherwise("")
    return refs.select(F.concat(F.lit("@"), "type", F.lit("{"), "key", F.lit(",\n"), line("title", F.col("title")), line("author", F.array_join("authors", " and ")), line("year", F.col("year")), line("doi", F.col("doi")), F.lit("}")).alias("value"))
