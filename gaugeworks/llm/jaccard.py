"""Exact n-gram Jaccard join by vertical partitioning.

Distinct n-grams of all documents get one global order: by class of document frequency (its binary logarithm), rare ones
first, by hash within a class. Two sets that link share an n-gram among the first of either in that order (its prefix),
and n-grams of one document only cannot be shared, so few documents have candidates. For candidates the order is cut into
fragments of about equal mass, their number growing with the corpus; overlaps are counted fragment by fragment and summed
per pair.

Classes, not pairs, are the result, so pairs that cannot change a class are not made. In rounds each document meets a few
partners, at most four, of a larger class than its own; rounds go on while they still join classes. What is left is taken
exactly: all candidates of different classes. Documents with equal sets are one node throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import IS_SPACE, LOWER, blobs, chunked, cut, fresh, grams, lean, lean_group, mix, text_bytes, unpack, word_hashes, words

NOT_SPACE = ~IS_SPACE
HUB_GRAMS = 6
PARTNERS = 3
#: A round is followed by another while one pair in so many still joins classes.
LEAST_JOINED = 8


def sets(buf: np.ndarray, offs: np.ndarray, n: int) -> list[np.ndarray]:
    """Distinct n-gram hashes of each document, ascending; with fewer words all of them are one n-gram."""
    low = LOWER[buf]
    starts, ends, first = words(low, offs, NOT_SPACE)
    h = word_hashes(low, starts, ends)
    g = grams(h, n)
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
        if z - a >= n:
            own = np.sort(g[a : z - n + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif z > a:
            out.append(mix(grams(h[a:z], z - a) + np.uint64(z - a)))
        else:
            out.append(h[:0])
    return out


def node(own: np.ndarray) -> int:
    """A 64-bit name of a set."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64))[0].view(np.int64))


def _frequencies(chunks: DataFrame, n: int, bits: int) -> DataFrame:
    """chunk, classes: for each bucket of n-gram hashes the log2 of the document frequency of those of the chunk, ascending.

    Frequencies are of 32 bits below the bucket's, so they may be too high, never too low."""

    def count(batches):
        for b in batches:
            for chunk, buf, offs, _ in unpack(b):
                keys, times = np.unique(_short(_distinct(sets(buf, offs, n)), bits), return_counts=True)
                bucket = (keys >> np.uint64(32)).astype(np.int64)
                head = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else []
                ends = np.append(head, len(keys))[1:]
                low, times = keys.astype(np.uint32), np.minimum(times, 255).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[head] if len(keys) else [], pa.int32()),
                        pa.array(np.full(len(head), chunk), pa.int64()),
                        pa.array([low[a:z].tobytes() for a, z in zip(head, ends)], pa.binary()),
                        pa.array([times[a:z].tobytes() for a, z in zip(head, ends)], pa.binary()),
                    ],
                    ["bucket", "chunk", "low", "times"],
                )

    def meet(t: pa.Table) -> pa.Table:
        rows = t.column("low").to_pylist()
        _, back = np.unique(blobs(rows, np.uint32), return_inverse=True)
        df = np.bincount(back, blobs(t.column("times").to_pylist(), np.uint8))
        kind = np.minimum(np.log2(df), 15).astype(np.uint8)[back]
        ends = np.cumsum([len(r) // 4 for r in rows])
        return pa.table([t.column("chunk"), t.column("bucket"), pa.array([kind[a:z].tobytes() for a, z in zip([0, *ends[:-1]], ends)], pa.binary())], ["chunk", "bucket", "classes"])

    counted = chunks.select("chunk", "offs", "text").mapInArrow(lean(count), "bucket int, chunk long, low binary, times binary")
    return counted.groupBy("bucket").applyInArrow(lean_group(meet), "chunk long, bucket int, classes binary").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "classes"))).alias("classes"))


def _distinct(own: list[np.ndarray]) -> np.ndarray:
    """N-grams of the documents, those of equal documents once."""
    seen = {node(s): s for s in own if len(s)}
    return np.concatenate([*seen.values(), np.zeros(0, np.uint64)])


def _short(keys: np.ndarray, bits: int) -> np.ndarray:
    return keys >> np.uint64(32 - bits)


def order_key(own: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Place of an n-gram in the global order: class of frequency first, then hash."""
    return kind.astype(np.uint64) << np.uint64(60) | own >> np.uint64(4)


def fragment_edges(mass: list[int], count: int) -> np.ndarray:
    """Where to cut the order into `count` fragments of about equal mass; mass: of each class of frequency, whose hashes are even."""
    total, out = sum(mass), []
    before = np.concatenate([[0], np.cumsum(mass)])
    for k in range(1, count):
        at = total * k / count
        kind = min(int(np.searchsorted(before, at, "right")) - 1, 15) if total else 15
        part = (at - before[kind]) / mass[kind] if total and mass[kind] else 0.0
        out.append((kind << 60) + int(part * ((1 << 60) - 1)))
    return np.array(out, np.uint64)


def _mass(classes: DataFrame) -> list[int]:
    """How many shared n-grams the chunks have in each class of frequency."""

    def run(batches):
        total = np.zeros(16, np.int64)
        for b in batches:
            for kinds in b.column(0).to_pylist():
                total += np.bincount(blobs([k["classes"] for k in kinds], np.uint8), minlength=16)
        total[0] = 0  # n-grams of one document are in no fragment
        yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array(total)], ["kind", "n"])

    rows = classes.select("classes").mapInArrow(lean(run), "kind int, n long").groupBy("kind").agg(F.sum("n").alias("n")).collect()
    out = [0] * 16
    for r in rows:
        out[r.kind] = r.n
    return out


_MEMBERS = "kind int, chunk long, row int, id long, n int, node long, frag int, shared int, tokens array<long>, prefix array<long>"
_names = ["kind", "chunk", "row", "id", "n", "node", "frag", "shared", "tokens", "prefix"]


def _members(chunks: DataFrame, classes: DataFrame, n: int, num: int, den: int, bits: int, edges: np.ndarray) -> DataFrame:
    """Kind 0: a row for each document. Kind 1: the shared n-grams of each node that may link, by fragment where it has any, and in the first of them its prefix."""
    long_list = pa.list_(pa.int64())

    def run(batches):
        for b in batches:
            for chunk, buf, offs, rows, kinds in unpack(b, ("classes",)):
                own = sets(buf, offs, n)
                keys = np.unique(_short(_distinct(own), bits))
                kinds = blobs([k["classes"] for k in kinds or []], np.uint8)
                nodes = [node(s) if len(s) else None for s in own]
                m = len(own)
                none = pa.nulls(m, long_list)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.zeros(m), pa.int32()),
                        pa.array(np.full(m, chunk), pa.int64()),
                        pa.array(np.arange(m), pa.int32()),
                        rows.field(0),
                        pa.array([len(s) for s in own], pa.int32()),
                        pa.array(nodes, pa.int64()),
                        pa.nulls(m, pa.int32()),
                        pa.nulls(m, pa.int32()),
                        none,
                        none,
                    ],
                    _names,
                )
                out, seen = [], set()
                for s, name in zip(own, nodes):
                    if name is None or name in seen:
                        continue
                    seen.add(name)
                    kind = kinds[np.searchsorted(keys, _short(s, bits))]
                    shared = kind > 0
                    first = len(s) - -(-num * len(s) // den) + 1 - (len(s) - int(shared.sum()))
                    if first <= 0:
                        continue
                    key = np.sort(order_key(s[shared], kind[shared]))
                    prefix = key[:first].view(np.int64)
                    for k, piece in enumerate(np.split(key, np.searchsorted(key, edges))):
                        if len(piece):
                            out.append((name, len(s), k, len(key), piece.view(np.int64), prefix))
                            prefix = None
                if out:
                    name, size, frag, own_shared, piece, prefix = zip(*out)
                    m = len(out)
                    null = pa.nulls(m, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.ones(m), pa.int32()), null, pa.nulls(m, pa.int32()), null, pa.array(size, pa.int32()), pa.array(name, pa.int64()), pa.array(frag, pa.int32()), pa.array(own_shared, pa.int32()), pa.array(piece, long_list), pa.array(prefix, long_list)],
                        _names,
                    )

    return chunks.join(classes, "chunk", "left").mapInArrow(lean(run), _MEMBERS)


def overlaps(pairs: DataFrame, segments: DataFrame, fragments: int) -> DataFrame:
    """a, b, na, nb, overlap of pairs of nodes: counted in each fragment of the order that both have, summed per pair."""
    cells = pairs.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(fragments - 1))).alias("frag"))
    left = segments.select(F.col("node").alias("a"), "frag", F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = segments.select(F.col("node").alias("b"), "frag", F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    parts = cells.join(left, ["a", "frag"]).join(right, ["b", "frag"])
    parts = parts.select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("part"))
    return parts.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("overlap"))


def linked(counted: DataFrame, num: int, den: int) -> DataFrame:
    return counted.where(den * F.col("overlap") >= num * (F.col("na").cast("long") + F.col("nb") - F.col("overlap"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node, label (its class's smallest node) for nodes of links: smallest neighbour's label, then the label's label, until nothing changes."""
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        ahead = step.select(F.col("node").alias("label"), F.col("label").alias("ahead"))
        new = cut(step.join(ahead, "label", "left").select("node", "old", F.least("label", F.coalesce("ahead", "label")).alias("label")), "labels")
        labels = new.select("node", "label")
        if not new.where("label <> old").limit(1).count():
            return labels


def _partners(posted: DataFrame, met: DataFrame | None, num: int, den: int) -> DataFrame:
    """a, b, hub: a few partners of each node not met before, out of those that share an n-gram of both prefixes.

    An n-gram's hubs are, of its largest class, the node with the fewest n-grams of its own, which links with most, and one by
    chance. At first every node is a class, and all of an n-gram's nodes are hubs alike; only the rarest n-grams count then. Of its
    n-grams' hubs a node takes those with the fewest n-grams of their own, and one by chance."""
    near = posted.where(F.col("pos") < HUB_GRAMS) if met is None else posted
    one = F.lit(0).cast("long")
    own, chance = (F.col("n") - F.col("rest")).cast("long"), F.xxhash64("node", "token")
    large = [one, one] if met is None else [-F.col("size"), F.col("label")]
    hub = [F.struct(large[0].alias("x"), large[1].alias("y"), k.alias("z"), F.xxhash64("node").alias("w"), F.col("node").alias("hub"), own.alias("own"), F.col("n").alias("hn"), F.col("rest").alias("hs"), F.col("label").alias("hl")) for k in (own, chance)]
    hubs = near.groupBy("token").agg(*[F.min(h).alias(f"h{k}") for k, h in enumerate(hub)])
    found = near.join(hubs, "token").select("node", "n", "rest", "label", F.explode(F.array("h0", "h1")).alias("h"))
    found = found.where(F.col("label") != F.col("h.hl")).where(_may_link("n", "rest", "h.hn", "h.hs", num, den))
    found = found.select("node", F.col("h.hub").alias("hub"), F.col("h.own").alias("own"))
    if met is not None:
        found = found.join(met.select(F.col("a").alias("node"), F.col("b").alias("hub")).union(met.select(F.col("b"), F.col("a"))), ["node", "hub"], "left_anti")
    best = found.groupBy("node").agg(F.array_sort(F.collect_set(F.struct("own", "hub"))).alias("found"), F.min(F.struct(F.xxhash64("node", "hub"), F.col("hub").alias("hub"))).alias("z"))
    pairs = best.select("node", F.explode(F.array_distinct(F.concat(F.slice("found.hub", 1, PARTNERS), F.array("z.hub")))).alias("hub"))
    return pairs.groupBy(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).agg(F.min("hub").alias("hub"))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after links between nodes: classes that a link touches become one."""
    la, lb = (labels.select(F.col("node").alias(k), F.col("label").alias(f"l{k}")) for k in "ab")
    top = components(links.join(la, "a").join(lb, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a <> b").distinct())
    return cut(labels.join(top.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label")), "classes")


def _mixed(posted: DataFrame, labels: DataFrame) -> DataFrame:
    """posted with the classes (and their sizes) as they are now, n-grams of one class left out."""
    sized = labels.join(labels.groupBy("label").agg(F.count(F.lit(1)).alias("size")), "label")
    posted = posted.select("token", "node", "n", "rest", "pos").join(sized, "node")
    mixed = posted.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token")
    return cut(posted.join(mixed, "token"), "mixed")


def join(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The chunks of docs, and for each document: chunk, row (place in the chunk), id, n (size of its set), node (null if empty), label (of its class).

    A set is the document's distinct n-word sequences, A-Z lowered; with fewer words all of them are one. Sets link when
    den * |intersection| >= num * |union|; empty sets with nothing. N-grams are compared by 60-bit hashes within their class of
    frequency, sets by 64-bit hashes. Ids that are no whole numbers count as null.
    """
    docs = docs.withColumn(id_col, F.col(id_col).try_cast("long"))
    chunks = chunked(docs, text_col, [id_col, *[c for c in carry or [] if c != id_col]], "ngrams")
    bits = max(9, (text_bytes(chunks) >> 21).bit_length())
    fragments = bits - 5
    kinds = cut(_frequencies(chunks, n, bits), "frequencies")
    members = cut(_members(chunks, kinds, n, num, den, bits, fragment_edges(_mass(kinds), fragments)), "members")
    own = members.where("kind = 0").select("chunk", "row", "id", "n", "node")
    prefixes = members.where("kind = 1 AND prefix IS NOT NULL").groupBy("node", "n", "shared").agg(F.first("prefix").alias("prefix"))
    every = _posted(prefixes)
    posted = cut(every.join(every.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("token"), "token").withColumn("label", F.col("node")).withColumn("size", F.lit(1).cast("long")), "mixed")
    alone = posted.select("node").distinct()
    labels = cut(alone.select("node", F.col("node").alias("label")), "classes")
    segments = members.where("kind = 1").select("node", "frag", "n", "tokens").join(labels.select("node"), "node", "left_semi").dropDuplicates(["node", "frag"])
    segments = cut(segments, "segments")

    met = None
    while True:
        pairs = cut(_partners(posted, met, num, den), "pairs")
        now = cut(overlaps(pairs, segments, fragments).join(pairs, ["a", "b"]), "met")
        met = now if met is None else met.unionByName(now)
        links = linked(now, num, den)
        made, joined = now.count(), links.count()
        if joined:
            labels = _joined(labels, links)
            posted = _mixed(posted, labels)
        if joined * LEAST_JOINED < made or not joined:
            break

    # how far nodes are from partners they met: two at distances further apart than linked sets are cannot link (1 - Jaccard is a metric)
    far = (1 - F.col("overlap") / (F.col("na") + F.col("nb") - F.col("overlap"))).alias("far")
    far = met.select(F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("node"), "hub", far)
    far = far.union(met.select(F.col("hub").alias("node"), "hub", F.lit(0.0).alias("far")).distinct())
    far = far.groupBy("node").agg(F.collect_set(F.struct("hub", "far")).alias("far"))

    # candidates of a token by size and rest first: those of one such kind are met only where the kinds can link
    kinds = posted.groupBy("token", "n", "rest").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    x, y = (kinds.select("token", *[F.col(c).alias(f"{c}{k}") for c in ("n", "rest", "lo", "hi")]) for k in "xy")
    meet = x.join(y, "token").where("(nx, restx) <= (ny, resty) AND NOT (lox = hiy AND hix = loy)").where(_may_link("nx", "restx", "ny", "resty", num, den))
    a = posted.select("token", F.col("n").alias("nx"), F.col("rest").alias("restx"), F.col("node").alias("a"), F.col("label").alias("la"))
    b = posted.select("token", F.col("n").alias("ny"), F.col("rest").alias("resty"), F.col("node").alias("b"), F.col("label").alias("lb"))
    rest = a.join(meet.select("token", "nx", "restx", "ny", "resty"), ["token", "nx", "restx"]).join(b, ["token", "ny", "resty"]).where("la <> lb")
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = rest.join(far.select(F.col("node").alias("a"), F.col("far").alias("fa")), "a", "left").join(far.select(F.col("node").alias("b"), F.col("far").alias("fb")), "b", "left")
    apart = F.exists("fa", lambda p: F.exists("fb", lambda q: (p.hub == q.hub) & (F.abs(p.far - q.far) > 1 - num / den + 1e-9)))
    rest = cut(rest.where(~F.coalesce(apart, F.lit(False))).select("a", "b"), "pairs")
    links = cut(linked(overlaps(rest, segments, fragments), num, den), "links")
    if links.limit(1).count():
        labels = _joined(labels, links)
    own = own.join(labels, "node", "left").select("chunk", "row", "id", "n", "node", F.coalesce("label", "node").alias("label"))
    return chunks, cut(own, "classes")


def _posted(prefixes: DataFrame) -> DataFrame:
    """A row for each n-gram of a prefix; rest: how many n-grams of the set stand there or behind it in the order."""
    keep = ("node", "n")
    own = prefixes.select(*keep, "shared", F.posexplode("prefix").alias("pos", "token"))
    return own.select(*keep, "token", "pos", (F.col("shared") - F.col("pos")).alias("rest"))


def _may_link(n: str, rest: str, n2: str, rest2: str, num: int, den: int):
    """Sizes allow a link: the smaller set is large enough, and if this is the first n-gram both have, what stands behind it is enough
    for the overlap. Linked sets pass at the first n-gram both have."""
    size = den * F.least(n, n2).cast("long") >= num * F.greatest(n, n2).cast("long")
    return size & ((num + den) * F.least(rest, rest2).cast("long") >= num * (F.col(n).cast("long") + F.col(n2)))


def classes(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id (smallest id of its class), for each row of docs. Documents without words are classes of their own;
    null ids count only where no other is in the class. Repeated rows share a class. Other columns are not read."""
    _, own = join(docs, n, num, den, id_col, text_col)
    least = own.where("label IS NOT NULL").groupBy("label").agg(F.min("id").alias("least"))
    return own.join(least, "label", "left").select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns as they are, with one row of each class: the one of smallest id, whatever whole-number type ids have.
    Null ids, and ids that are no whole numbers, come last, ties by place. All rows without words stay. Extra columns may have any name."""
    names = docs.columns
    key, null = fresh(names, "_key"), fresh(names, "_was_null")
    carry = [key, *[c for c in names if c != text_col], null]
    marked = docs.withColumn(null, F.col(text_col).isNull()).withColumn(key, F.col(id_col).try_cast("long"))
    chunks, own = join(marked, n, num, den, key, text_col, carry)
    # the smallest id first, then place: one row a class, by partial aggregation
    first = own.where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "chunk", "row")).alias("k")).select("k.chunk", "k.row")
    kept = first.union(own.where("label IS NULL").select("chunk", "row")).groupBy("chunk").agg(F.collect_list("row").alias("kept"))
    order = [carry.index(c) if c != text_col else -1 for c in names]

    def run(batches):
        for b in batches:
            for _, buf, offs, rows, kept in unpack(b, ("kept",)):
                kept = np.sort(np.array(kept, np.int64))
                null = rows.field(len(carry) - 1).to_pylist()
                texts = [None if null[k] else buf[offs[k] : offs[k + 1]].tobytes().decode() for k in kept]
                rows = rows.take(pa.array(kept))
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k < 0 else rows.field(k) for k in order], names)

    return chunks.join(kept, "chunk").mapInArrow(lean(run), docs.schema)
