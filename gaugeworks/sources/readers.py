"""Sources: strict and permissive JSONL, CSV, word lists, macros, Markdown tables, rosters, labels (SRC)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def jsonl_strict(spark: SparkSession, path, schema) -> DataFrame:
    """SRC-1: a bad line fails the read. Lines end at a line feed only."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("lineSep", "\n").json(path)


def jsonl_log(spark: SparkSession, path, schema: StructType) -> DataFrame:
    """SRC-4, SRC-30: an append-only log; truncated lines are dropped."""
    wide = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    rows = spark.read.schema(wide).option("mode", "PERMISSIVE").option("lineSep", "\n").json(path)
    # parsed once more by hand: Spark forbids a read of nothing but the corrupt column
    return rows.withColumn("_bad", F.col("_corrupt_record").isNotNull()).where(~F.col("_bad")).drop("_bad", "_corrupt_record")


def numbered_lines(spark: SparkSession, path) -> DataFrame:
    """file, line (from 1), value: file order as a sequence, for logs whose time stamps are too coarse. Files are read whole, so keep them of moderate size."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\n").alias("l"))
    return whole.select("file", F.posexplode("l").alias("pos", "value")).select("file", (F.col("pos") + 1).alias("line"), "value").where(F.trim("value") != "")


def items(spark: SparkSession, paths: list[str], schema, tasks: list[str], required: list[str], domains: dict[str, list[str]]) -> DataFrame:
    """SRC-2, SRC-3: item files of several folders, named by task; required values, allowed values, the file's name and unique ids are checked as rows are read."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(paths).withColumn("_file", F.regexp_extract("_metadata.file_name", r"^(.*)\.jsonl$", 1))
    bad: Column = ~F.col("task").isin(tasks) | (F.col("task") != F.col("_file"))
    for c in required:
        bad = bad | F.col(c).isNull()
    for c, allowed in domains.items():
        bad = bad | ~F.col(c).isin(allowed)
    twice = F.count(F.lit(1)).over(Window.partitionBy("id")) > 1
    check = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(F.lit("bad item "), F.coalesce("id", F.lit("?"))))).when(twice, F.raise_error(F.concat(F.lit("id twice: "), F.col("id"))))
    return rows.withColumn("_ok", check).where("_ok IS NULL").drop("_ok", "_file")


def per_item_csv(spark: SparkSession, path) -> DataFrame:
    """SRC-9: the released fact table; an empty judge is null."""
    return spark.read.csv(path, header=True, nullValue="", schema="model string, item string, task string, score double, auto double, judge double")


def csv(spark: SparkSession, path, schema) -> DataFrame:
    """SRC-27, SRC-13."""
    return spark.read.csv(path, header=True, schema=schema, nullValue="")


def rating(column) -> Column:
    """SRC-13: a whole number from 1 to 5, else null."""
    n = F.expr(f"try_cast(trim({column}) AS int)")
    return F.when(n.between(1, 5), n)


def wordlist(spark: SparkSession, path) -> DataFrame:
    """SRC-12: words of a text file, lower case; lines that begin with # are comments."""
    line = F.trim("value")
    return spark.read.text(path).where((line != "") & ~line.startswith("#")).select(F.lower(line).alias("word")).distinct()


def replacements(spark: SparkSession, path) -> DataFrame:
    """SRC-12: tab-separated pairs."""
    parts = F.split("value", "\t")
    return spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#")).select(F.lower(F.trim(F.get(parts, F.lit(0)))).alias("word"), F.trim(F.get(parts, F.lit(1))).alias("standard"))


def macros(spark: SparkSession, path) -> DataFrame:
    r"""SRC-10: key, value and number of \newcommand lines; math minus and braced commas are plain in the number."""
    p = r"\\newcommand\{\\(\w+)\}\{(.*)\}"
    own = spark.read.text(path).select(F.regexp_extract("value", p, 1).alias("key"), F.regexp_extract("value", p, 2).alias("value")).where("key <> ''")
    plain = F.regexp_replace(F.regexp_replace("value", r"\$-\$|−|–", "-"), r"\{,\}|\\%|\\,|,", "")
    return own.withColumn("number", plain.try_cast("double"))


def markdown_table(spark: SparkSession, path) -> DataFrame:
    """SRC-26: cells of table rows; rules and other lines are skipped."""
    line = F.trim("value")
    rows = spark.read.text(path).where(line.startswith("|") & ~line.rlike(r"^\|[\s:|-]+$"))
    return rows.select(F.transform(F.split(F.regexp_replace(line, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)).alias("cells"))


def roster(spark: SparkSession, text: str, default_effort: str | None = None) -> DataFrame:
    """SRC-11: models of a YAML roster {tier: [label or {name: ..., ...}]} as a small dimension."""
    import yaml

    rows = []
    for tier, models in (yaml.safe_load(text) or {}).items():
        for m in models if isinstance(models, list) else []:
            conf = m if isinstance(m, dict) else {"model": m}
            engine, _, name = str(conf["model"]).partition(":")
            name, _, effort = name.partition("@")
            rows.append((tier, engine, name, effort or conf.get("effort") or default_effort, conf.get("family"), {k: str(v) for k, v in conf.items()}))
    return spark.createDataFrame(rows, "tier string, engine string, model string, effort string, family string, options map<string,string>")


def labels(spark: SparkSession, path) -> DataFrame:
    """SRC-14, DM-12: {item: {family or *: {field: value or list}}} as rows item, family, field, value array."""
    kind = "map<string, map<string, map<string, string>>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m"))
    rows = whole.select(F.explode("m").alias("item", "f")).select("item", F.explode("f").alias("family", "v")).select("item", "family", F.explode("v").alias("field", "raw"))
    return rows.select("item", "family", "field", F.coalesce(F.from_json("raw", "array<string>"), F.array("raw")).alias("value"))


def power_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """SRC-21: gpu, watts, mem_mib, util of comma-separated sampler lines; others are dropped."""
    parts = F.transform(F.split(column, ","), lambda c: F.trim(c))
    num = lambda k: F.get(parts, F.lit(k)).try_cast("double")
    out = lines.select("*", num(0).cast("int").alias("gpu"), num(1).alias("watts"), num(2).alias("mem_mib"), num(3).alias("util"))
    return out.where(F.size(parts) == 4).where("gpu IS NOT NULL AND watts IS NOT NULL AND mem_mib IS NOT NULL AND util IS NOT NULL")


def missing_from(snapshot: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """SRC-15: wanted keys a frozen snapshot lacks."""
    return wanted.select(key).distinct().join(snapshot.select(key), key, "left_anti")


def bibliographic(rows: DataFrame, source: str) -> DataFrame:
    """SRC-18, DM-10: source-specific JSON (column json) as records source, title, year, doi, authors, years."""
    paths = {
        "crossref": ("$.title[0]", "$.DOI", "$.author[*].family", ["$.published-print.date-parts[0][0]", "$.published-online.date-parts[0][0]", "$.issued.date-parts[0][0]"]),
        "openalex": ("$.title", "$.doi", "$.authorships[*].author.display_name", ["$.publication_year"]),
        "arxiv": ("$.title", "$.doi", "$.authors[*]", ["$.year"]),
    }[source]
    get = lambda p: F.get_json_object("json", p)
    names = F.coalesce(F.from_json(get(paths[2]), "array<string>"), F.array_compact(F.array(get(paths[2]))))
    years = F.array_sort(F.array_distinct(F.array_compact(F.array(*[get(p).try_cast("int") for p in paths[3]]))))
    from gaugeworks.functions.text import clean_doi

    return rows.select("*", F.lit(source).alias("source"), get(paths[0]).alias("title"), F.get(years, F.lit(0)).alias("year"), clean_doi(get(paths[1])).alias("doi"), names.alias("authors"), years.alias("years"))


@dataclass
class Context:
    """UD-3: what scorers share: the session, the folders of public and private items, a cache by name, and whether sources may be asked."""

    spark: SparkSession
    public: str
    private: str | None = None
    offline: bool = True
    cache: dict = field(default_factory=dict)

    def table(self, name: str, read: Callable[[SparkSession, str], DataFrame], private: bool = False) -> DataFrame:
        """A folder's table, read once; a private one without a private folder is an error."""
        folder = self.private if private else self.public
        if folder is None:
            raise ValueError(f"{name} is private and there is no private folder")
        if (private, name) not in self.cache:
            self.cache[private, name] = read(self.spark, f"{folder}/{name}")
        return self.cache[private, name]


def seeds(spark: SparkSession, text: str) -> DataFrame:
    """SRC-28: key, title, year, authors, verify, fields of a YAML list of entries; a key that occurs twice is an error."""
    import yaml

    entries = (yaml.safe_load(text) or {}).get("entries") or []
    count = Counter(str(e["key"]) for e in entries)
    if twice := sorted(k for k, n in count.items() if n > 1):
        raise ValueError(f"keys that occur twice: {twice}")
    rows = [(str(e["key"]), e.get("title"), e.get("year"), list(e.get("authors") or []), e.get("verify", "auto"), {k: str(v) for k, v in e.items() if not isinstance(v, list)}) for e in entries]
    return spark.createDataFrame(rows, "key string, title string, year int, authors array<string>, verify string, fields map<string,string>")


def glossary(spark: SparkSession, text: str | None) -> DataFrame:
    """SRC-28: term, target of a YAML map, in its order by pos; no text is no terms."""
    import yaml

    rows = [(k, str(term), str(target)) for k, (term, target) in enumerate((yaml.safe_load(text or "") or {}).items())]
    return spark.createDataFrame(rows, "pos int, term string, target string")
