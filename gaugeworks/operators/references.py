"""Bibliographic matching: best match, verdict by DOI or title, audit classes, credit, multi-source status with adopted DOIs,
audit roll-up, reuse, lookups, report rows (JN-18, JN-24, JN-26, FN-33, FN-34, FN-35, PRJ-16, AG-9, SRC-20)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.bibtex import without_footnote
from gaugeworks.functions.text import clean_doi, fold, fold_all, surname
from gaugeworks.operators.relational import kept
from gaugeworks.operators.titles import alike_titles


#: Sources in the order in which they are asked; the late ones only where fewer than two others have the work.
SOURCES, LATE = ("crossref", "openalex", "semantic_scholar", "scopus"), ("semantic_scholar", "scopus")
ARXIV = "10.48550/"
KEY = 6


def best_match(seeds: DataFrame, candidates: DataFrame, least: float = 0.9, strict: float = 0.95, relaxed: int = 40) -> DataFrame:
    """JN-18: seed, source, pos, similarity, agrees: for each seed and source the candidate of highest title similarity, the least pos on ties.

    seeds: seed, title, year, author (the first one), optionally type. candidates: pos, title, years, authors, source. The folded
    surname, if of three letters or more, must stand in the folded name of any author; candidates without authors agree. A
    match needs `least`; one that does not agree needs `strict` and a seed whose folded title has `relaxed` characters and
    whose type is not arxiv. A candidate's years, if any, must hold one within one of the seed's.

    Pairs of distinct titles come from the title join; seeds of one title, year and surname are looked up once, candidates of one title
    and year count by their least pos. Authors are looked up by the first letters of the surname at any place in a name. So
    neither a title that many works share nor one surname makes all pairs."""
    kind = F.col("type") if "type" in seeds.columns else F.lit(None).cast("string")
    first = surname("author")
    own = seeds.select("seed", F.col("title").alias("st"), "year", F.when(F.length(first) >= 3, first).alias("first"), ((F.length(fold("title")) >= relaxed) & ~kind.eqNullSafe("arxiv")).alias("relax"))
    own = kept(own.where("st IS NOT NULL"))
    found = kept(candidates.select("pos", F.col("title").alias("ct"), F.coalesce("years", F.array().cast("array<int>")).alias("years"), fold_all("authors").alias("names"), "source").where("ct IS NOT NULL"))
    alike = kept(alike_titles(own, found, min(least, strict)))
    cls = ["st", "year", "first", "relax"]
    # a year stands for itself, "-" for a work without years, "*" for any
    asks = F.when(F.col("year").isNull(), F.array(F.lit("*"))).otherwise(F.array(*[(F.col("year").cast("int") + d).cast("string") for d in (-1, 0, 1)], F.lit("-")))
    ask = own.select(*cls).distinct().join(alike, "st").withColumn("y", F.explode(asks))
    gives = F.concat(F.array(F.lit("*")), F.when(F.size("years") == 0, F.array(F.lit("-"))).otherwise(F.array_distinct(F.transform("years", lambda y: y.cast("int").cast("string")))))
    give = found.join(alike.select("ct").distinct(), "ct", "left_semi").withColumn("y", F.explode(gives))
    # whoever wrote it
    least_pos = give.groupBy("ct", "source", "y").agg(F.min("pos").alias("any"), F.min(F.when(F.size("names") == 0, F.col("pos"))).alias("unnamed"))
    free = ask.join(least_pos, ["ct", "y"])
    agree = F.col("first").isNull()
    one = free.select(*cls, "source", "similarity", F.when(agree, F.col("any")).otherwise(F.col("unnamed")).alias("pos"), F.lit(True).alias("agrees")).where(F.col("pos").isNotNull() & (F.col("similarity") >= least))
    two = free.where(~agree & F.col("relax") & (F.col("similarity") >= strict)).select(*cls, "source", "similarity", F.col("any").alias("pos"), F.lit(False).alias("agrees"))
    # an author whose name holds the surname
    names = give.where(F.size("names") > 0).select("ct", "source", "y", "pos", F.explode("names").alias("name")).groupBy("ct", "source", "y", "name").agg(F.min("pos").alias("pos"))
    at = F.sequence(F.lit(1), F.greatest(F.length("name") - 2, F.lit(1)))
    keys = F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(F.array(*[F.lit(k) for k in range(3, KEY + 1)]), lambda k: F.substr("name", i, k)))))
    by_key = names.select("*", F.explode(keys).alias("key"))
    three = ask.where(~agree & (F.col("similarity") >= least)).withColumn("key", F.left("first", F.lit(KEY))).join(by_key, ["ct", "y", "key"])
    three = three.where(F.contains("name", F.col("first"))).select(*cls, "source", "similarity", "pos", F.lit(True).alias("agrees"))
    best = one.unionByName(two).unionByName(three).groupBy(*cls, "source").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "pos", (~F.col("agrees")).alias("d"))).alias("b"))
    best = best.select(*[F.col(c).alias(f"b_{c}") for c in cls], "source", F.col("b.pos").alias("pos"), (-F.col("b.s")).alias("similarity"), (~F.col("b.d")).alias("agrees"))
    same = [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in cls]
    return own.join(best, same).select("seed", "source", "pos", "similarity", "agrees")


def matching_records(seeds: DataFrame, records: DataFrame, least: float, strict: float) -> DataFrame:
    """seed, source, asked, similarity: the records, each by itself, that match a seed. records: source, asked (the identifier they
    were found by), title, years, authors; one a source and identifier."""
    each = records.select(F.struct("source", "asked").alias("source"), F.lit(0).alias("pos"), "title", "years", "authors")
    return best_match(seeds, each, least, strict).select("seed", "source.source", "source.asked", "similarity")


def verify(seeds: DataFrame, resolved: DataFrame, candidates: DataFrame, least: float = 0.9, strict: float = 0.95) -> DataFrame:
    """FN-33: seed, exists, doi_ok, doi_confirmed, doi_resolves (null without a DOI), via: the seed's own DOI's record if it matches, else the best title found.

    seeds: seed, title, year, author, doi, optionally type. resolved: doi, title, years, authors; an arXiv DOI resolves only if it names an
    arXiv id. candidates: pos, title, years, authors, doi, optionally step: 1 for works found by title and author, 2 for those
    found by title alone, which count only where no work of step 1 matches."""
    given = clean_doi("doi")
    own = seeds.withColumn("given", F.when(given != "", given))
    known = resolved.withColumn("asked", clean_doi("doi")).where(~F.col("asked").startswith(ARXIV) | F.contains("asked", F.lit("arxiv.")))
    known = known.dropDuplicates(["asked"]).withColumn("source", F.lit("doi"))
    by_doi = matching_records(own, known, least, strict).join(own.select("seed", "given"), "seed").where("asked = given").select("seed", F.lit(True).alias("by_doi")).distinct()
    step = F.col("step") if "step" in candidates.columns else F.lit(1)
    found = best_match(own, candidates.select("pos", "title", "years", "authors", step.cast("int").alias("source")), least, strict)
    found = found.groupBy("seed").agg(F.min_by("pos", "source").alias("pos"))
    dois = candidates.select("pos", clean_doi("doi").alias("found")).groupBy("pos").agg(F.min("found").alias("found"))
    by_title = found.join(dois, "pos").select("seed", F.lit(True).alias("by_title"), F.when(F.col("found") != "", F.col("found")).alias("found"))
    resolves = known.select(F.col("asked").alias("given"), F.lit(True).alias("resolves"))
    out = own.join(by_doi, "seed", "left").join(by_title, "seed", "left").join(resolves, "given", "left")
    via = F.when(F.col("by_doi"), "doi").when(F.col("by_title"), "title")
    return out.select(
        "seed",
        via.isNotNull().alias("exists"),
        F.coalesce(F.when(via == "doi", True).when(via == "title", F.col("given") == F.col("found")), F.lit(False)).alias("doi_ok"),
        F.when(via == "doi", F.col("given")).when(via == "title", F.col("found")).alias("doi_confirmed"),
        F.when(F.col("given").isNotNull(), F.coalesce("resolves", F.lit(False))).alias("doi_resolves"),
        via.alias("via"),
    )


def audit(refs: DataFrame, by_doi: DataFrame, searched: DataFrame, away: DataFrame, sources: tuple[str, ...], least: float = 0.9, strict: float = 0.95) -> DataFrame:
    """FN-35: seed, class, via, doi of references that were not found: exact (a source has the work), title (one has its title alone), unchecked
    (neither, and a lookup was not answered), none.

    refs: seed, title, year, author, doi, doi_resolves. by_doi: doi, title, years, authors: records of DOIs, asked for those that do not
    resolve where they should; a row without a title is an unanswered lookup. searched: source, pos, title, years, authors, doi.
    away: source, title: searches without an answer. Exact matches go by the DOI first, then by sources in their order."""
    given = clean_doi("doi")
    whole = refs.where("title IS NOT NULL AND title <> '' AND year IS NOT NULL").withColumn("given", F.when((given != "") & ~F.col("doi_resolves"), given))
    records = by_doi.withColumn("asked", clean_doi("doi")).dropDuplicates(["asked"]).withColumn("source", F.lit("doi.org"))
    known = records.where("title IS NOT NULL")
    place = F.array_position(F.array(F.lit("doi.org"), *map(F.lit, sources)), F.col("source"))
    exact = matching_records(whole, known, least, strict).join(whole.select("seed", "given"), "seed").where("asked = given").select("seed", "source", F.col("asked").alias("doi"))
    listed = searched.where(F.col("source").isin(*sources))
    found = best_match(whole, listed, least, strict).join(listed.select("source", "pos", clean_doi("doi").alias("doi")), ["source", "pos"]).select("seed", "source", "doi")
    exact = exact.unionByName(found).groupBy("seed").agg(F.min(F.struct(place.alias("k"), "source", "doi")).alias("e"))
    titles = listed.select("title").union(known.select("title")).distinct().withColumnRenamed("title", "ct")
    alike = kept(alike_titles(whole.select(F.col("title").alias("st")), titles.where("ct IS NOT NULL"), least).select("st", "ct"))
    by_search = alike.join(listed.select(F.col("title").alias("ct")).distinct(), "ct", "left_semi").select(F.col("st").alias("title")).distinct()
    own = whole.join(known.select(F.col("asked").alias("given"), F.col("title").alias("own")), "given", "left").join(alike.select(F.col("st").alias("title"), F.col("ct").alias("own"), F.lit(True).alias("in_record")), ["title", "own"], "left")
    lost = records.where("title IS NULL").select(F.col("asked").alias("given"), F.lit(True).alias("no_record"))
    unanswered = away.where(F.col("source").isin(*sources)).select("title", F.lit(True).alias("no_search")).distinct()
    out = own.join(by_search.withColumn("in_search", F.lit(True)), "title", "left").join(lost, "given", "left").join(unanswered, "title", "left").join(exact, "seed", "left")
    cls = F.when(F.col("e").isNotNull(), "exact").when(F.coalesce("in_record", "in_search", F.lit(False)), "title").when(F.coalesce("no_record", "no_search", F.lit(False)), "unchecked").otherwise("none")
    out = out.select("seed", cls.alias("class"), F.col("e.source").alias("via"), F.coalesce("e.doi", F.lit("")).alias("doi"))
    rest = refs.join(out.select("seed"), "seed", "left_anti").select("seed", F.lit("none").alias("class"), F.lit(None).cast("string").alias("via"), F.lit("").alias("doi"))
    return out.unionByName(rest)


def adopted(seeds: DataFrame, records: DataFrame, searched: DataFrame, least: float = 0.9, strict: float = 0.95) -> DataFrame:
    """FN-34: seed, status (VERIFIED by two sources, SINGLE_SOURCE, NOT_FOUND, MANUAL), sources, doi, similarity, notes.

    seeds: seed, title, year, author, doi, type, arxiv (id), verify. records: source, asked, title, years, authors, doi, year: what a source has under
    a DOI (arxiv: under an id). searched: source, pos, title, years, authors, doi, year: what searches of a source gave.

    In turn: the records of the seed's own DOI; the arXiv DOI's record in openalex; the best match of each source's search, the late
    ones only while fewer than two sources have the work; arxiv's record, for preprints or below two. A DOI that a record
    confirms stays. Otherwise the DOI of crossref's record, or else the least one found, is adopted if a record of crossref or
    openalex has it, those under that DOI included. Preprints have none. Seeds to be checked by hand keep their DOI."""
    given, arxiv = clean_doi("doi"), F.coalesce(F.col("arxiv").cast("string"), F.lit(""))
    own = seeds.withColumn("given", F.coalesce(given, F.lit(""))).withColumn("arxiv", arxiv).withColumn("manual", F.coalesce("verify", F.lit("auto")) == "manual").withColumn("preprint", F.coalesce("type", F.lit("")) == "arxiv")
    auto = own.where("NOT manual")
    fact = lambda *more: F.struct("similarity", F.coalesce(clean_doi("doi"), F.lit("")).alias("doi"), F.col("year").cast("int").alias("year"), *more)
    asked = F.when(F.col("source") == "arxiv", F.col("asked")).otherwise(clean_doi("asked"))
    records = records.withColumn("asked", asked).dropDuplicates(["source", "asked"])
    by_id = kept(matching_records(auto, records, least, strict).join(records.select("source", "asked", "doi", "year"), ["source", "asked"]).select("seed", "source", "asked", fact().alias("r")))
    hits = best_match(auto, searched, least, strict).join(searched.select("source", "pos", "doi", "year"), ["source", "pos"]).select("seed", F.struct("source", fact().alias("r")).alias("e"))
    as_map = lambda c: F.map_from_entries(F.collect_list(c))
    ids = by_id.groupBy("seed").agg(as_map(F.struct(F.struct("source", "asked").alias("k"), "r")).alias("ids"))
    out = auto.join(ids, "seed", "left").join(hits.groupBy("seed").agg(as_map("e").alias("hits")), "seed", "left")
    record = lambda source, key: F.try_element_at("ids", F.struct(F.lit(source).alias("source"), key.alias("asked")))
    got = {s: F.when(F.col("given") != "", record(s, F.col("given"))) if s in ("crossref", "openalex") else F.lit(None).cast(by_id.schema["r"].dataType) for s in (*SOURCES, "arxiv")}
    out = out.withColumns({f"r_{s}": c for s, c in got.items()}).withColumn("confirmed", F.col("r_crossref").isNotNull() | F.col("r_openalex").isNotNull())
    out = out.withColumn("r_openalex", F.coalesce("r_openalex", F.when(F.col("arxiv") != "", record("openalex", F.concat(F.lit(f"{ARXIV}arxiv."), F.lower("arxiv"))))))
    n = sum((F.col(f"r_{s}").isNotNull().cast("int") for s in SOURCES[1:]), F.col(f"r_{SOURCES[0]}").isNotNull().cast("int"))
    for s in SOURCES:
        hit = F.try_element_at("hits", F.lit(s))
        out = out.withColumn(f"r_{s}", F.coalesce(f"r_{s}", F.when(n < 2, hit) if s in LATE else hit))
    out = out.withColumn("r_arxiv", F.when((F.col("arxiv") != "") & (F.col("preprint") | (n < 2)), record("arxiv", F.col("arxiv"))))
    all_of = F.filter(F.array(*[F.col(f"r_{s}") for s in (*SOURCES, "arxiv")]), lambda r: r.isNotNull())
    dois = F.array_sort(F.array_distinct(F.filter(F.transform(all_of, lambda r: r["doi"]), lambda d: (d != "") & ~d.startswith(ARXIV))))
    out = out.withColumn("dois", dois).withColumn("seen", F.coalesce(F.when(F.col("r_crossref.doi") != "", F.col("r_crossref.doi")), F.get("dois", F.lit(0))))
    open_ = ~F.col("preprint") & ~F.col("confirmed") & (F.size("dois") > 0)
    for s in ("crossref", "openalex"):
        out = out.withColumn(f"r_{s}", F.coalesce(f"r_{s}", F.when(open_, record(s, F.col("seen")))))
    backed = open_ & (F.coalesce(F.col("r_crossref.doi") == F.col("seen"), F.lit(False)) | F.coalesce(F.col("r_openalex.doi") == F.col("seen"), F.lit(False)))
    doi = F.when(~F.col("preprint") & F.col("confirmed"), F.col("given")).when(backed, F.col("seen")).otherwise("")
    other = F.array_except("dois", F.array("given"))
    said = F.array(
        F.when(~F.col("preprint") & F.col("confirmed") & (F.size(other) > 0), F.concat(F.lit("other DOIs seen: "), F.array_join(other, ", "))),
        F.when(~F.col("preprint") & ~F.col("confirmed") & (F.col("given") != ""), F.concat(F.lit("seed DOI wrong: "), "given")),
        F.when(open_ & ~backed, F.concat(F.lit("DOI not confirmed: "), "seen")),
        F.when(backed, F.concat(F.lit("DOI adopted: "), "seen")),
        *[F.when(F.col(f"r_{s}.year") != F.col("year"), F.concat(F.lit(f"{s}: year "), F.col(f"r_{s}.year").cast("string"))) for s in (*SOURCES, "arxiv")],
    )
    names = F.array_sort(F.filter(F.array(*[F.when(F.col(f"r_{s}").isNotNull(), s) for s in (*SOURCES, "arxiv")]), lambda s: s.isNotNull()))
    status = F.when(F.size("sources") >= 2, "VERIFIED").when(F.size("sources") == 1, "SINGLE_SOURCE").otherwise("NOT_FOUND")
    best = F.coalesce(F.array_max(F.transform(all_of, lambda r: r["similarity"])), F.lit(0.0))
    done = out.withColumn("sources", names).select("seed", status.alias("status"), "sources", doi.alias("doi"), best.alias("similarity"), F.filter(said, lambda s: s.isNotNull()).alias("notes"))
    by_hand = own.where("manual").select("seed", F.lit("MANUAL").alias("status"), F.array().cast("array<string>").alias("sources"), F.col("given").alias("doi"), F.lit(0.0).alias("similarity"), F.array(F.lit("to be checked by hand")).alias("notes"))
    return done.unionByName(by_hand)


def credit(exists, doi_given, doi_right):
    """PRJ-16: 1 with a right DOI, 0.75 without any, 0.5 with a wrong one, 0 if not found; null while a source is away."""
    return F.when(exists.isNull(), None).when(~exists, 0.0).when(~doi_given, 0.75).when(doi_right, 1.0).otherwise(0.5)


def status(matches: DataFrame, seeds: DataFrame) -> DataFrame:
    """FN-34: VERIFIED by two sources, SINGLE by one, NOT_FOUND by none."""
    n = matches.groupBy("seed").agg(F.countDistinct("source").alias("n"))
    kind = F.when(F.col("n") >= 2, "VERIFIED").when(F.col("n") == 1, "SINGLE").otherwise("NOT_FOUND")
    return seeds.select("seed").join(n, "seed", "left").select("seed", F.coalesce("n", F.lit(0)).alias("n_sources"), kind.alias("status"))


def audit_rollup(refs: DataFrame) -> DataFrame:
    """AG-9, PRJ-17: counts and rates by model and by group in one pass. refs: model, grp, found, class (exact, title, none)."""
    n = lambda c: F.count_if(c)
    out = refs.groupingSets([["model"], ["grp"]], "model", "grp").agg(F.count(F.lit(1)).alias("listed"), n(~F.col("found")).alias("not_found"), *[n(~F.col("found") & (F.col("class") == k)).alias(k) for k in ("exact", "title", "none")])
    return out.withColumn("none_rate", F.round(F.try_divide("none", "listed"), 4))


def reuse_verified(seeds: DataFrame, previous: DataFrame) -> DataFrame:
    """JN-26: seeds with reused and bibtex: what an earlier run verified and has an entry for, unless the seed is checked by hand.

    seeds: key, title, verify. previous: key, status, bibtex; of a repeated key the least entry."""
    had = previous.where("status = 'VERIFIED' AND bibtex <> ''").groupBy("key").agg(F.min("bibtex").alias("_b"))
    out = seeds.join(had, "key", "left")
    again = F.col("_b").isNotNull() & (F.coalesce("verify", F.lit("auto")) != "manual")
    return out.select(*seeds.columns, again.alias("reused"), F.when(again, without_footnote(F.col("_b"), F.col("title"))).alias("bibtex"))


def lookup_key(source, query, limit: int):
    """SRC-20: the content address of a search."""
    return F.sha1(F.to_json(F.array(source, query, F.lit(str(limit)))))


def lookups(wanted: DataFrame, cache: DataFrame, used: DataFrame, caps: dict[str, int], limit: int = 5) -> DataFrame:
    """SRC-20: source, day, query, key, state of each distinct search: empty (no word to ask for), cached, ask, or paused where the
    source's cap of a day is used up by what was asked before and the searches in front, in order of key.

    wanted: source, day, title. cache: key. used: source, day, n. Sources without a cap are always asked."""
    q = wanted.select("source", "day", fold("title").alias("query")).distinct().withColumn("key", lookup_key(F.col("source"), F.col("query"), limit))
    q = q.join(cache.select("key", F.lit(True).alias("_known")).distinct(), "key", "left")
    fresh = q.where("query <> '' AND _known IS NULL").where(F.col("source").isin(*caps))
    # the largest cap is a literal bound, so each task keeps no more rows of a source and day than that
    w = Window.partitionBy("source", "day").orderBy("key")
    first = fresh.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max(caps.values(), default=0))
    cap = F.coalesce(*[F.when(F.col("source") == s, n) for s, n in caps.items()], F.lit(0))
    spent = used.groupBy("source", "day").agg(F.sum("n").alias("_spent"))
    first = first.join(spent, ["source", "day"], "left").where(F.col("_n") + F.coalesce("_spent", F.lit(0)) <= cap)
    out = q.join(first.select("key", "day", F.lit(True).alias("_ask")), ["key", "day"], "left")
    state = F.when(F.col("query") == "", "empty").when(F.col("_known"), "cached").when(F.col("_ask") | ~F.col("source").isin(*caps), "ask").otherwise("paused")
    return out.select("source", "day", "query", "key", state.alias("state"))


def report_rows(ranking: DataFrame, audit: DataFrame, diagnostics: DataFrame, key: str = "model") -> DataFrame:
    """JN-24: a row a ranked model with its audit and diagnostics beside it, null where there are none, and whether the next one is of
    another engine. ranking: key, place, engine; the others have a row a key."""
    wide = ranking.join(audit, key, "left").join(diagnostics, key, "left")
    after = ranking.select((F.col("place") - 1).alias("place"), F.col("engine").alias("_next"))
    return wide.join(after, "place", "left").withColumn("rule", F.coalesce(F.col("_next") != F.col("engine"), F.lit(False))).drop("_next")
