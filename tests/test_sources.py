import json

import pytest
from pyspark.sql import functions as F

from gaugeworks.sources import readers, sinks
from gaugeworks.streaming import streams


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_jsonl(spark, tmp_path):
    good = write(tmp_path / "a.jsonl", '{"k": 1}\n\n{"k": 2}\n')
    assert sorted(r.k for r in readers.jsonl_strict(spark, good, "k int").collect()) == [1, 2]
    bad = write(tmp_path / "b.jsonl", '{"k": 1, "t": "a b"}\n{"k": 2, "t": \n{"k": 3, "t": "c"}\n')
    with pytest.raises(Exception):
        readers.jsonl_strict(spark, bad, "k int, t string").collect()
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    assert sorted(r.k for r in readers.jsonl_log(spark, bad, StructType([StructField("k", IntegerType()), StructField("t", StringType())])).collect()) == [1, 3]
    assert [(r.line, json.loads(r.value)["k"]) for r in readers.numbered_lines(spark, good).orderBy("line").collect()] == [(1, 1), (3, 2)]


def test_items(spark, tmp_path):
    write(tmp_path / "coding.jsonl", '{"id": "c1", "task": "coding", "privacy": "public"}\n{"id": "c2", "task": "coding", "privacy": "private"}\n')
    args = ("id string, task string, privacy string", ["coding"], ["id"], {"privacy": ["public", "private"]})
    assert readers.items(spark, [str(tmp_path)], *args).count() == 2
    write(tmp_path / "more.jsonl", '{"id": "c1", "task": "coding", "privacy": "public"}\n')
    with pytest.raises(Exception, match="bad item|id twice"):
        readers.items(spark, [str(tmp_path)], *args).collect()


def test_small_formats(spark, tmp_path):
    m = readers.macros(spark, write(tmp_path / "n.tex", "\\newcommand{\\nItems}{6{,}375}\n\\newcommand{\\diff}{$-$0.5}\n% no\n\\newcommand{\\who}{abc}\n"))
    assert {r.key: r.number for r in m.collect()} == {"nItems": 6375.0, "diff": -0.5, "who": None}
    t = readers.markdown_table(spark, write(tmp_path / "t.md", "x\n| a | b |\n|---|:--|\n| 1 | 2 |\n"))
    assert [r.cells for r in t.collect()] == [["a", "b"], ["1", "2"]]
    w = readers.wordlist(spark, write(tmp_path / "w.txt", "# c\nFoo\n\nbar\nfoo\n"))
    assert sorted(r.word for r in w.collect()) == ["bar", "foo"]
    c = readers.per_item_csv(spark, write(tmp_path / "p.csv", "model,item,task,score,auto,judge\nm,i,t,0.5,0.5,\n"))
    assert c.first().judge is None
    l = readers.labels(spark, write(tmp_path / "l.json", '{"i1": {"*": {"f": "x", "g": ["a", "b"]}}}'))
    assert {(r["item"], r.family, r.field): r["value"] for r in l.collect()} == {("i1", "*", "f"): ["x"], ("i1", "*", "g"): ["a", "b"]}
    r = readers.roster(spark, "economy: [eng:m1, {model: 'eng:m2@high', family: v}]\nlocal: [o:q]\n", "low")
    assert sorted((x.tier, x.model, x.effort) for x in r.collect()) == [("economy", "m1", "low"), ("economy", "m2", "high"), ("local", "q", "low")]
    p = readers.power_lines(spark.createDataFrame([("0, 55.5, 100, 7",), ("junk",)], "value string"))
    assert [(x.gpu, x.watts) for x in p.collect()] == [(0, 55.5)]
    assert [x.r for x in spark.createDataFrame([(" 4",), ("6",), ("x",), (None,)], "v string").select(readers.rating("v").alias("r")).collect()] == [4, None, None, None]
    b = spark.createDataFrame([('{"title": ["T"], "DOI": "10.1000/X", "author": [{"family": "Doe"}, {"family": "Roe"}], "issued": {"date-parts": [[2020, 1]]}}',)], "json string")
    x = readers.bibliographic(b, "crossref").first()
    assert (x.title, x.doi, x.authors, x.year, x.years) == ("T", "10.1000/x", ["Doe", "Roe"], 2020, [2020])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "key string, value double")
    assert sinks.markdown(df).splitlines()[2:] == ["| a | 1.5 |", "| b | – |"]
    assert sorted(r.value for r in sinks.macros(df).collect()) == [r"\newcommand{\a}{1.5}", r"\newcommand{\b}{–}"]
    text = sinks.put_between("x <!--b--> old <!--e--> y", "new", "<!--b-->", "<!--e-->")
    assert text == sinks.put_between(text, "new", "<!--b-->", "<!--e-->")
    assert sinks.macro_name("gpt-5.4 mini") == "GptFiveFourMini"
    spark.createDataFrame([(1, 0.1), (2, 0.2)], "k int, score double").write.parquet(str(tmp_path / "s"))
    out = sinks.merge_scores(spark, str(tmp_path / "s"), spark.createDataFrame([(2, 0.9)], "k int, score double"), ["k"])
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, 0.1), (2, 0.9)]
    items = spark.createDataFrame([("t", "public", "i1", "h1"), ("t", "private", "i2", "h2")], "task string, privacy string, id string, sha256 string")
    m = sinks.manifest(items).first()
    assert (m.public, m.private, m["items"]) == (1, 1, {"i1": "h1", "i2": "h2"})
    sinks.append_log(df, str(tmp_path / "log"))
    sinks.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_sessions_and_sliding(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:04:00", 2.0), (1, "2024-01-01 01:00:00", 3.0)]
    spark.createDataFrame(rows, "k int, ts string, value double").select("k", F.to_timestamp("ts").alias("ts"), "value").write.parquet(str(tmp_path / "e"))
    stream = lambda: spark.readStream.schema("k int, ts timestamp, value double").parquet(str(tmp_path / "e"))
    assert sorted(r.n for r in streams.drain(streams.sessions(stream(), "ts", "10 minutes", ["k"]), "sess", "complete").collect()) == [1, 2]
    out = streams.drain(streams.tumbling(stream(), "ts", "1 hour", ["k"], slide="30 minutes"), "slide", "complete").collect()
    assert sum(r.n for r in out) == 6
