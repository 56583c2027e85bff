"""Column functions over model answers and sources: normal values, evidence, abstracts, prompts' source lines (FN-11, FN-14, FN-15, FN-17, FN-18, FN-19,
FN-26, FN-37, FN-50, PRJ-18, SO-5, SO-9, FLT-6, FLT-8, SL-5, WN-13)."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def norm_value(v) -> Column:
    """FN-13: lower case; runs of anything but a-z, 0-9 and _ (& dropped, - and / as _) become one _, none at the ends."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(v, F.lit("")))), "&", ""), "[-/]", "_")
    return F.regexp_replace(F.regexp_replace(s, "[^a-z0-9_]+", "_"), "^_+|_+$", "")


def enum(v, vocabulary: list[str]) -> Column:
    """FN-14: the normal value if the vocabulary has it, else null."""
    n = norm_value(v)
    return F.when(n.isin(vocabulary), n)


def enum_list(values, vocabulary: list[str]) -> Column:
    """FN-14, SO-5: distinct normal values of the vocabulary, sorted; a null is an empty list."""
    n = F.transform(F.coalesce(values, F.array().cast("array<string>")), norm_value)
    return F.array_sort(F.array_distinct(F.array_intersect(n, F.array(*map(F.lit, vocabulary)))))


def whole_number(text) -> Column:
    """FN-14: the first number of a text, dots as thousands marks; null without one or for 0."""
    n = F.nullif(F.regexp_replace(F.regexp_extract(text, r"(\d[\d.]*)", 1), r"\.", ""), F.lit("")).try_cast("long")
    return F.when(n > 0, n)


def truth(text) -> Column:
    """FN-14: true for true, ya, ada; all else, nulls too, is false."""
    return F.coalesce(F.lower(F.trim(text)).isin("true", "ya", "ada"), F.lit(False))


def decimal(text) -> Column:
    """FN-37: a number with decimal point or comma."""
    return F.regexp_replace(F.trim(text), ",", ".").try_cast("double")


def correction(field: str, text, lists: dict[str, list[str]], enums: dict[str, list[str]]) -> Column:
    """FN-50: a rater's correction as text of the field's type: sorted list joined by commas, digits, true or false, or a value of the vocabulary."""
    s = F.trim(F.coalesce(text, F.lit("")))
    if field in lists:
        return F.array_join(enum_list(F.filter(F.split(s, ","), lambda x: F.trim(x) != ""), lists[field]), ",")
    if field in enums:
        return F.when(F.lower(s) != "null", enum(s, enums[field]))
    return F.when(s.rlike(r"^\d+$"), s) if field.startswith("n_") else F.lower(s).isin("true", "1", "ya").cast("string")


def flat(text) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def evidence_share(quotes, excerpt) -> Column:
    """FN-15: share of non-empty quotes that stand in the excerpt word for word, case and white space aside, closing marks dropped; null without quotes."""
    real = F.filter(quotes, lambda q: F.coalesce(F.trim(q) != "", F.lit(False)))
    bare = lambda q: F.regexp_replace(flat(q), "^[ .\"'“”…]+|[ .\"'“”…]+$", "")
    return F.when(F.size(real) > 0, F.size(F.filter(real, lambda q: F.contains(flat(excerpt), bare(q)))) / F.size(real))


def headings(direct, nested) -> Column:
    """FN-11: headings from whichever shape an answer has: a list, or an object's values; blanks dropped."""
    return F.filter(F.transform(F.coalesce(direct, nested, F.array().cast("array<string>")), lambda h: F.trim(h)), lambda h: F.coalesce(h != "", F.lit(False)))


def inverted_index(words) -> Column:
    """FN-17: map<word, array<position>> of an array of words, inside the row; null without words."""
    bound = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    placed = F.sort_array(F.transform(words, lambda w, p: F.struct(w.alias("w"), p.alias("p"))))
    first = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["w"] != F.get(s, i - 1)["w"]))
    run = lambda s, i, end: F.struct(F.get(s, i)["w"].alias("w"), F.transform(F.slice(s, i + 1, end - i), lambda x: x["p"]).alias("ps"))
    runs = lambda s: bound(first(s), lambda f: F.transform(f, lambda i, k: run(s, i, F.coalesce(F.get(f, k + 1), F.size(s)))))
    return F.when(F.size(words) > 0, F.map_from_entries(bound(placed, runs)))


def from_inverted_index(index) -> Column:
    """FN-17: text of map<word, array<position>>: words by position, ties by word."""
    e = F.flatten(F.transform(F.map_entries(index), lambda x: F.transform(x["value"], lambda p: F.struct(p.alias("p"), x["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(e), lambda x: x["w"]), " "), F.lit(""))


def clip(text, limit: int = 1200) -> Column:
    """FN-18: white space squeezed; a longer text is cut behind its last sentence end before the limit, if that is in the second half, else at a blank."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    cut = F.substring(t, 1, limit)
    end = F.length(F.regexp_extract(cut, r"(?s)^(.*[.?!]) ", 1))
    word = F.concat(F.when(cut.contains(" "), F.regexp_extract(cut, r"(?s)^(.*) [^ ]*$", 1)).otherwise(cut), F.lit(" …"))
    return F.when(F.length(t) <= limit, t).when(end - 1 > limit // 2, F.substring(cut, F.lit(1), end)).otherwise(word)


def source_line(i, authors, year, title, abstract) -> Column:
    """FN-19, SL-5: `[P1] Name et al. (year). Title. Abstract`, with the language's own words for others and for no date."""
    last = F.substring_index(F.get(authors, F.lit(0)), " ", -1)
    who = F.when(F.size(F.coalesce(authors, F.array().cast("array<string>"))) == 0, "Anonim").otherwise(F.concat(last, F.when(F.size(authors) > 1, " dkk.").otherwise("")))
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return F.concat(F.lit("[P"), i.cast("string"), F.lit("] "), who, F.lit(" ("), F.coalesce(year.cast("string"), F.lit("t.t.")), F.lit("). "), blank(title), F.lit(". Abstrak: "), blank(abstract))


def summary_text(summary, order: list[str]) -> Column:
    """FN-26: map as lines `Key: value`, the named keys first in their order, others after in the map's."""
    keys = F.map_keys(summary)
    first = F.filter(F.array(*map(F.lit, order)), lambda k: F.array_contains(keys, k))
    rest = F.filter(keys, lambda k: ~k.isin(order))
    upper = lambda k: F.concat(F.upper(F.substring(k, 1, 1)), F.lower(F.substring(k, 2, 1000)))
    return F.array_join(F.transform(F.concat(first, rest), lambda k: F.concat(upper(k), F.lit(": "), F.coalesce(F.element_at(summary, k), F.lit("None")))), "\n")


def generic_only(used, typical, generic: list[str]) -> Column:
    """SO-9: families used beyond the typical ones, out of the generic set, sorted."""
    return F.array_sort(F.array_intersect(F.array_except(used, typical), F.array(*map(F.lit, generic))))


def skipped(text, in_references) -> Column:
    """FLT-6: why a unit of text is left as it is: empty, reference, number, identifier, formula, or null for prose."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return (
        F.when(t == "", "empty")
        .when(in_references, "reference")
        .when(~t.rlike("[A-Za-zÀ-ÿ]{2,}"), "no prose")
        .when(t.rlike(r"^(?:https?://\S+|\S+@\S+\.\S+|10\.\d{4,9}/\S+|[A-Z0-9_.:-]*\d[A-Z0-9_.:-]*)$"), "identifier")
        .when(t.rlike(r"^[^=]{1,40}=[^=]{1,80}$") & ~t.rlike(r"[A-Za-zÀ-ÿ]{4,}\s+[A-Za-zÀ-ÿ]{4,}"), "formula")
    )


def carried(mark, keys: list[str], order: list[str]) -> Column:
    """WN-13: the last mark that is not null at or before a row."""
    return F.last(mark, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def schema_ok(json_text, keys: list[str]) -> Column:
    """FLT-8: an object with all the keys, none of them null."""
    return F.forall(F.array(*[F.get_json_object(json_text, f"$.{k}").isNotNull() for k in keys]), lambda x: x)


def display(value, digits: int = 2, signed: bool = False, percent: bool = False) -> Column:
    """PRJ-18: fixed decimals with thousands marks, a sign or per cent if asked for, a dash for null."""
    v = value * 100 if percent else value
    s = F.format_number(v, digits)
    s = F.when(v > 0, F.concat(F.lit("+"), s)).otherwise(s) if signed else s
    return F.coalesce(F.concat(s, F.lit("%")) if percent else s, F.lit("–"))
