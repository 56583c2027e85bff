"""BibTeX entries: normal form, new key, agreement with a seed, footnote figures in titles (FN-48, JN-26)."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from gaugeworks.functions.text import bibtex_fields, similarity


def entry(fields: dict[str, str]) -> str:
    """Fields as parsed (_type, _key and the rest), one a line; a month is a macro and has no braces."""
    lines = [f"  {k} = " + (v if k == "month" else f"{{{v}}}") for k, v in fields.items() if k[0] != "_" and v]
    return f"@{fields['_type']}{{{fields['_key']},\n" + ",\n".join(lines) + "\n}"


def normal(text: str | None, key: str | None = None) -> str | None:
    """FN-48: an entry written anew for LaTeX, null if it is none: entities as characters, bare & escaped, months by three letters,
    dashes in pages as --, a DOI said in the note and not in the address, an arXiv address dropped beside an arXiv note.
    With a key the entry gets it, and its title keeps its capitals by a second pair of braces."""
    f = bibtex_fields(html.unescape(text or ""))
    if f is None:
        return None
    f = {k: re.sub(r"(?<!\\)&", r"\\&", v) if k[0] != "_" else v for k, v in f.items()}
    if "month" in f:
        f["month"] = f["month"].lower()[:3]
    if "pages" in f:
        f["pages"] = re.sub("[–—]", "--", f["pages"])
    if f.get("doi"):
        if re.match(r"https?://(?:dx\.)?doi\.org/", f.get("url", ""), re.IGNORECASE):
            del f["url"]
        f.setdefault("note", f"doi: {f['doi']}")
    elif f.get("note", "").startswith("arXiv:") and re.match(r"https?://arxiv\.org/", f.get("url", "")):
        del f["url"]
    if f.get("note", "").startswith("doi: "):
        f["note"] = re.sub(r"(?<!\\)_", r"\\_", f["note"])
    if "url" in f:
        f["url"] = f["url"].replace("http://dx.doi.org/", "https://doi.org/")
    if key:
        f["_key"] = key
        if "title" in f and not f["title"].startswith("{"):
            f["title"] = f"{{{f['title']}}}"
    return entry(f)


def agrees(text: str | None, title: str | None, year: int | None, apart: int = 1, least: float = 0.85) -> bool:
    """FN-48: whether an entry has the seed's title, nearly, and its year, give or take; no where either lacks one."""
    f = bibtex_fields(text) or {}
    y = re.fullmatch(r"\d{4}", f.get("year", ""))
    return bool(y) and year is not None and not pd.isna(year) and abs(int(y[0]) - int(year)) <= apart and similarity(title, f.get("title")) >= least


@F.pandas_udf(StringType())
def normal_bibtex(text: pd.Series, key: pd.Series) -> pd.Series:
    """normal() by row; a null or empty key keeps the entry's own."""
    return pd.Series([normal(t, k or None) for t, k in zip(text, key, strict=True)], dtype=object)


@F.pandas_udf(BooleanType())
def bibtex_agrees(text: pd.Series, title: pd.Series, year: pd.Series) -> pd.Series:
    return pd.Series([agrees(*r) for r in zip(text, title, year, strict=True)], dtype=bool)


def without_footnote(bibtex, title):
    """JN-26: the figure of a footnote off the end of a double-braced title, unless the seed's own title ends in a figure."""
    cut = F.regexp_replace(bibtex, r"(?s)^(.*?title\s*=\s*\{\{[^}]*?[A-Za-z])\d\}\}", "$1}}")
    return F.when(F.trim(title).rlike(r"\d$"), bibtex).otherwise(cut)
