"""LaTeX expressions: masking and its checks, table cells, reference words, headings, comments and macros, post-edits (FN-41 to FN-43, FN-45, FN-46, FN-49)."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

from gaugeworks.functions.text import col, strip

# fixed values: emphasis that a translator sees as tags, and the words before a reference with their translations
EMPHASIS = ["emph", "textbf", "textit"]
REF_WORDS = {
    "Fig.": "Gambar", "Figs.": "Gambar", "Figure": "Gambar", "Table": "Tabel", "Tables": "Tabel",
    "Section": "Bagian", "Sections": "Bagian", "Eq.": "Pers.", "Algorithm": "Algoritma",
}
# fixed values: typographic characters and how TeX spells them
TYPED = {"“": "``", "”": "''", "‘": "`", "’": "'", "—": "---", "–": "--", "…": "\\ldots", "\u00a0": "~"}

# groups in braces or brackets nest; one that is never closed reaches to the end
GROUPS = r"""(?(DEFINE)
  (?<brace>\{(?:[^{}\\]|\\.|\\\Z|(?&brace))*+(?:\}|\Z))
  (?<bracket>\[(?:[^\[\]\\]|\\.|\\\Z|(?&bracket))*+(?:\]|\Z))
  (?<closed>\{(?:[^{}\\]|\\.|(?&closed))*+\})
)"""
TAGGED = rf"\\(?P<name>{'|'.join(EMPHASIS)})\*?(?=\{{)(?P<inner>(?&closed))"
HELD = rf"""%.*|\$[^$]*(?:\$|\Z)|\\\(.*?(?:\\\)|\Z)|[~&⟦⟧]|</?\d+>|(?&brace)
  |(?!\\(?:{'|'.join(EMPHASIS)})\*?(?&closed))\\[A-Za-z]++\*?(?:(?&brace)|(?&bracket))*+|\\[^A-Za-z]|\\\Z"""
PIECE = regex.compile(rf"{GROUPS}(?:{TAGGED}|(?P<held>(?:{HELD})+))", regex.VERBOSE | regex.DOTALL)
CELL = regex.compile(rf"{GROUPS}(?:\\.|(?&brace)|\}}.*|\$(?:[^$\\]|\\.)*+(?:\$|\Z)|(?P<cut>&))", regex.VERBOSE | regex.DOTALL)
DEFINITION = regex.compile(rf"{GROUPS}\\(?:re)?newcommand\*?\s*\{{\\(?P<name>[A-Za-z@]+)\}}\s*(?P<body>(?&brace))", regex.VERBOSE | regex.DOTALL)
CALL = regex.compile(r"\\([A-Za-z@]+)(?:\{\})?")


def mask(text: str | None) -> tuple[str, list[str], list[str]]:
    """FN-41: text for a translator, what its placeholders ⟦n⟧ hold, and the commands of its tags <k>, k from 1.

    Commands with their arguments, formulas, groups, comments and escapes become placeholders, neighbours one together;
    emphasis becomes a tag around its masked text. What already looks like a placeholder or tag is held too. Emphasis that
    is not closed is held as a command is. Null is empty."""
    held, tags = [], []

    def put(m) -> str:
        if m["held"]:
            held.append(m["held"])
            return f"⟦{len(held) - 1}⟧"
        tags.append(m["name"])
        k = len(tags)
        return f"<{k}>{PIECE.sub(put, m['inner'][1:-1])}</{k}>"

    return PIECE.sub(put, text or ""), held, tags


def unmask(text: str | None, held: list[str], tags: list[str]) -> str:
    """FN-41 inverse, for translations too: typographic characters as TeX spells them, bare specials escaped, tags without
    their other half and placeholders of no number dropped, tags may nest; an unknown tag is \\emph."""
    text = (text or "").translate(str.maketrans(TYPED))
    text = regex.sub(r"(?<!\\)[%&#_$]", lambda m: "\\" + m[0], text)
    for k in dict.fromkeys(regex.findall(r"<(\d+)>", text)):
        name = tags[int(k) - 1] if 0 < int(k) <= len(tags) else "emph"
        text = regex.sub(rf"(?s)<{k}>(.*?)</{k}>", lambda m, name=name: f"\\{name}{{{m[1]}}}", text)
    text = regex.sub(r"</?\d+>", "", text)
    return regex.sub(r"⟦(\d+)⟧", lambda m: held[int(m[1])] if int(m[1]) < len(held) else "", text)


@F.pandas_udf(StructType().add("masked", StringType()).add("held", ArrayType(StringType())).add("tags", ArrayType(StringType())))
def mask_latex(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([mask(t) for t in text], columns=["masked", "held", "tags"])


@F.pandas_udf(StringType())
def unmask_latex(masked: pd.Series, held: pd.Series, tags: pd.Series) -> pd.Series:
    return pd.Series([unmask(t, h if h is not None else [], g if g is not None else []) for t, h, g in zip(masked, held, tags, strict=True)], dtype=object)


def brace_counts(c) -> Column:
    """FN-41: opening and closing braces that are not escaped."""
    bare = F.regexp_replace(col(c), r"\\[{}]", "")
    return F.struct(*[F.regexp_count(bare, F.lit(p)).alias(n) for p, n in ((r"\{", "open"), (r"\}", "close"))])


def intact(masked, candidate) -> Column:
    """FN-41: a translation keeps placeholders and tags as multisets, the number of braces, and placeholders behind their
    numbers, where a decimal comma may stand for the point."""
    found = lambda c, p: F.array_sort(F.regexp_extract_all(col(c), F.lit(p), F.lit(1)))
    numbers = F.regexp_extract_all(col(masked), F.lit(r"(\d[\d.,]*⟦\d+⟧)"), F.lit(1))
    kept = F.forall(numbers, lambda n: F.contains(col(candidate), n) | F.contains(col(candidate), F.replace(n, F.lit("."), F.lit(","))))
    same = [found(masked, p) == found(candidate, p) for p in (r"⟦(\d+)⟧", r"</?(\d+)>")]
    return same[0] & same[1] & (brace_counts(masked) == brace_counts(candidate)) & kept


def cells(line: str | None) -> list[str] | None:
    """FN-42: what stands between the ampersands outside groups, formulas and escapes; null where there is none.

    A closing brace too many holds the rest of the line together."""
    at = [m.start() for m in CELL.finditer(line or "") if m["cut"]]
    return [line[a:b] for a, b in zip([0] + [k + 1 for k in at], at + [len(line)], strict=True)] if at else None


@F.pandas_udf(ArrayType(StringType()))
def split_cells(line: pd.Series) -> pd.Series:
    return line.map(cells)


def ref_words(c, words: dict[str, str] = REF_WORDS) -> Column:
    """FN-43: words in front of ~\\ref{ replaced by others, all at once: a new word is not replaced again."""
    out, names = col(c), sorted(words)
    for k, w in enumerate(names):
        out = F.regexp_replace(out, rf"(?U)\b\Q{w}\E(?=~\\ref\{{)", f"\u0000{k}\u0000")
    for k, w in enumerate(names):
        out = F.replace(out, F.lit(f"\u0000{k}\u0000"), F.lit(words[w]))
    return out


# fixed values: a heading's number is Roman, a letter, or figures with points
NUMBERED = r"^(?:([IVX]+)\.|([A-Z])\.|(\d+(?:\.\d+)*)\.?)\s+(.+)$"


def _capitals(t: Column) -> Column:
    return (F.upper(t) == t) & (F.lower(t) != t)


def heading_level(style, text) -> Column:
    """FN-45: 1 to 9 by the style's name, 0 for a title, else by the number in front or by capitals; null if no heading."""
    t = strip(col(text))
    part = lambda k: F.regexp_extract(t, NUMBERED, k)
    by_style = F.regexp_extract(F.coalesce(col(style), F.lit("")), r"^Heading (\d)", 1)
    numbered = (part(4) != "") & (F.length(t) < 90) & ~t.endswith(".")
    depth = F.when(part(1) != "", 1).when(part(2) != "", 2).otherwise(F.least(F.lit(3), F.regexp_count(part(3), F.lit(r"\.")) + 1))
    capitals = _capitals(t) & F.length(t).between(4, 59) & ~t.startswith("[")
    return F.when(by_style != "", by_style.cast("int")).when(col(style) == "Title", 0).when(numbered, depth).when(capitals, 1)


def heading_text(text) -> Column:
    """FN-45: without its number; text in capitals gets a capital at the start of each run of letters."""
    t = strip(col(text))
    named = F.regexp_extract(t, NUMBERED, 4)
    t = F.when(named != "", named).otherwise(t)
    runs = F.split(t, r"(?<=\p{L})(?=\P{L})|(?<=\P{L})(?=\p{L})")
    return F.when(_capitals(t), F.array_join(F.transform(runs, F.initcap), "")).otherwise(t)


def strip_comments(c) -> Column:
    """FN-46: each line up to the first per cent sign without a backslash in front; lines end with \\n, the last one with nothing."""
    text = F.regexp_replace(col(c), r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n")
    return F.regexp_replace(F.regexp_replace(text, r"\n\z", ""), r"(?<!\\)%[^\n]*", "")


def definitions(text: str | None) -> dict[str, str]:
    """FN-46: commands without arguments and their bodies; of a name defined again the last body, which may be empty.

    A body that is never closed reaches to the end."""
    body = lambda b: b[1:-1] if regex.fullmatch(GROUPS + r"(?&closed)", b, regex.VERBOSE | regex.DOTALL) else b[1:]
    return {m["name"]: body(m["body"]) for m in DEFINITION.finditer(text or "")}


def expand(text: str | None, known: dict[str, str], rounds: int = 3) -> str | None:
    """FN-46: commands replaced by their bodies, those inside bodies in the next round."""
    for _ in range(rounds if text else 0):
        text, before = CALL.sub(lambda m: known.get(m[1], m[0]), text), text
        if text == before:
            break
    return text


@F.pandas_udf(MapType(StringType(), StringType()))
def macro_definitions(text: pd.Series) -> pd.Series:
    return text.map(definitions)


@F.pandas_udf(StringType())
def expand_macros(text: pd.Series, known: pd.Series) -> pd.Series:
    """Three rounds of the row's own definitions, a map; text without any stays as it is."""
    return pd.Series([expand(t, dict(d) if d is not None else {}) for t, d in zip(text, known, strict=True)], dtype=object)


def post_edits(c, edits: list[tuple[str, str]], everywhere: list[tuple[str, str]] = ()) -> Column:
    """FN-49: text after literal edits one after the other, and missing: those of `edits` of which neither the old nor the
    new text was there. `everywhere` follows and reports nothing."""
    text, missing = col(c), []
    for old, new in edits:
        missing.append(F.when(~F.contains(text, F.lit(old)) & ~F.contains(text, F.lit(new)), F.lit(old)))
        text = F.replace(text, F.lit(old), F.lit(new))
    for old, new in everywhere:
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.struct(text.alias("text"), F.array_compact(F.array(*missing)).alias("missing") if missing else F.array().cast("array<string>").alias("missing"))
