"""Text made of values and values made of text: prompts, previews, short names, results in words, ratings, brace groups (RM-1, RM-4 to RM-6, RM-10)."""

from __future__ import annotations

from string import Formatter

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from gaugeworks.functions.records import flat
from gaugeworks.functions.text import col

# groups in braces nest, whatever stands in front of a brace; one that is never closed reaches to the end
GROUP = regex.compile(r"[ \t\n]*+(?<g>\{(?:[^{}]++|(?&g))*+(?:\}|\Z))")
# here a brace behind a backslash does not count
INSIDE = regex.compile(r"(?:[^{}\\]|\\[{}]|\\|(?<g>\{(?:[^{}\\]|\\[{}]|\\|(?&g))*+(?:\}|\Z)))*+", regex.DOTALL)
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def fill(template: str, **values) -> Column:
    """RM-1: a template's {name} marks filled with columns; {{ and }} are braces. Null fills in nothing."""
    parts = []
    for text, name, *_ in Formatter().parse(template):
        parts.append(F.lit(text))
        if name is not None:
            parts.append(F.coalesce(col(values[name]).cast("string"), F.lit("")))
    return F.concat(F.lit(""), *parts)


def options(question, choices) -> Column:
    """RM-1: a question and its map of choices, a line each, by letter."""
    choices = col(choices)
    lines = F.transform(F.array_sort(F.map_keys(choices)), lambda k: F.concat(k, F.lit(". "), F.element_at(choices, k)))
    return F.concat(col(question), F.lit("\n\n"), F.array_join(lines, "\n"))


def criteria(entries, scale: str = "1-5") -> Column:
    """RM-1: lines and keys of an array of structs name, meaning: what a judge rates, and the JSON it answers with."""
    entries = col(entries)
    lines = F.transform(entries, lambda e: F.concat(F.lit("- "), e["name"], F.lit(": "), e["meaning"]))
    keys = F.transform(entries, lambda e: F.concat(F.lit('"'), e["name"], F.lit(f'": {scale}')))
    return F.struct(F.array_join(lines, "\n").alias("lines"), F.array_join(keys, ", ").alias("keys"))


def preview(text, n: int = 5) -> Column:
    """RM-1: head (the header and n rows) and rows (all lines but the header) of a CSV text; null is empty."""
    lines = F.split(F.regexp_replace(F.coalesce(col(text), F.lit("")), rf"(?:{LINE_END})\z", ""), LINE_END)
    return F.struct(F.array_join(F.slice(lines, 1, n + 1), "\n").alias("head"), (F.size(lines) - 1).alias("rows"))


def likert(x, lo: int = 1, hi: int = 5) -> Column:
    """RM-4: nearest whole number, halves to the even one, inside the scale."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), F.rint(col(x)).cast("int")))


def near_whole(x, eps: float = 1e-4) -> Column:
    """RM-4."""
    return F.abs(col(x) - F.rint(col(x))) <= eps


def deviation(got, want) -> Column:
    """RM-4: the largest absolute difference of two arrays over the places they share; 0 if they share none."""
    far = F.zip_with(col(got), col(want), lambda a, b: F.coalesce(F.abs(a - b), F.lit(0.0)))
    return F.coalesce(F.array_max(far), F.lit(0.0))


def strip_command(c, name: str) -> Column:
    r"""RM-5: \name{x} becomes x, where braces in x nest once at most."""
    return F.regexp_replace(col(c), rf"\\{name}\s*\{{((?:[^{{}}]++|\{{[^{{}}]*+\}})*+)\}}", "$1")


def expected_cell(c) -> Column:
    """RM-5: the normal form of an expected cell: dashes and squares as one character, lower case, single blanks."""
    return flat(F.replace(F.replace(col(c), F.lit("--"), F.lit("–")), F.lit("^2"), F.lit("²")))


@F.pandas_udf(IntegerType())
def skip_group(text: pd.Series, at: pd.Series) -> pd.Series:
    """RM-5: place (from 0) behind the brace group that starts at `at`, blanks in front skipped; `at` if none does."""
    ends = [GROUP.match(t or "", int(k)) for t, k in zip(text, at, strict=True)]
    return pd.Series([m.end() if m else int(k) for m, k in zip(ends, at, strict=True)], dtype="int32")


@F.pandas_udf(StringType())
def brace_group(text: pd.Series, at: pd.Series) -> pd.Series:
    """RM-6: what stands in the group whose opening brace is just before `at` (from 0); null text is empty."""
    return pd.Series([INSIDE.match(t or "", int(k))[0] if k <= len(t or "") else "" for t, k in zip(text, at, strict=True)], dtype=object)


def issue_key(c) -> Column:
    """RM-6: an issue's text for comparison: lower case, ASCII letters, figures and blanks only."""
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9 ]", "")


def shorten(c, pairs: dict[str, str]) -> Column:
    """RM-10: names with parts replaced one after the other."""
    out = col(c)
    for old, new in pairs.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def gate_text(cited, known, problems) -> Column:
    """RM-10: a gate's counts and, a line each, its problems, an array of structs key, why, files."""
    problems = col(problems)
    lines = F.transform(problems, lambda p: F.concat(F.lit("- "), p["key"], F.lit(": "), p["why"], F.lit(" ["), F.array_join(p["files"], ", "), F.lit("]")))
    state = F.when(F.size(problems) == 0, "all known").otherwise(F.concat(F.size(problems).cast("string"), F.lit(" not allowed\n"), F.array_join(lines, "\n")))
    return F.concat(col(cited).cast("string"), F.lit(" cited of "), col(known).cast("string"), F.lit(": "), state)


def build_text(ok, error, counts) -> Column:
    """RM-10: a failed build's error, else its map of counts by name."""
    counts = col(counts)
    pairs = F.transform(F.array_sort(F.map_keys(counts)), lambda k: F.concat(k, F.lit("="), F.element_at(counts, k).cast("string")))
    return F.when(col(ok), F.concat_ws(" ", F.lit("built"), F.array_join(pairs, " "))).otherwise(F.concat(F.lit("failed: "), F.coalesce(col(error), F.lit(""))))
