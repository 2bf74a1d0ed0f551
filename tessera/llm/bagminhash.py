"""Near-duplicate classes by BagMinHash signatures of weighted five-word shingles.

A text is a multiset of shingles; its weight for a shingle is how often that occurs. Each shingle has a Poisson
process over (weight, time): the weights' axis is cut into the dyadic spans [0,1), [1,2), [2,4), [4,8) ..., each
span has a process of its own whose rate is its length, and a point's place within its span is read from its bits,
one bit for each halving, so that only points below the text's weight count. A point also picks one component of
the signature, and a component keeps the smallest time. Two texts then agree in a component with a probability
equal to their weighted Jaccard similarity. Points are only made up to a time by which all components are filled,
which depends on the text's total weight; texts that have an empty component go on to twice that time.

Signatures are cut into bands. Texts that agree in a band meet in its bucket. A bucket links its texts to a centre
(the text that meets most others); links are verified by exact multiset overlap; connected texts form classes.
Buckets whose texts ended in several classes are gone through again with other centres, as long as that links any
number of texts. What is then left is settled whole: its texts are entered under the rarest members of their sets, as
many as two near texts can't both do without, and all pairs of texts that meet there are verified. So dense groups
cost about one link for each text, loose ones little more than their texts, and no link between texts that meet in
a band is lost.

Exact copies are one node from the start. Defined results: texts of fewer than five words are one shingle; empty
and null texts are copies of one another and near no other text; repeated rows and rows with a null id take part
as copies and come out once for each row; the class id is the smallest doc_id of the class (null if it has none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Bands of rows each: at similarity 0.8 a pair meets with probability 1 - (1 - 0.8**5)**25 = 0.99995.
BANDS, ROWS = 25, 5
COMPONENTS = BANDS * ROWS
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, starts: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, shingle hash and weight, sorted by document and hash, of UTF-8 documents; letters A-Z count as a-z."""
    lowered = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
    begin, end, doc = common.word_spans(data, starts)
    h = common.word_hashes(lowered, begin, end)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = np.bincount(doc, minlength=len(starts) - 1)
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    place = np.arange(len(h)) - first[doc]
    size = np.minimum(words, n)[doc]
    whole = place + size <= n[doc]  # where a shingle begins
    at = np.flatnonzero(whole)
    value = np.zeros(len(at), np.uint64)
    for i in range(words):
        more = i < size[at]
        part = np.where(more, h[np.minimum(at + i, len(h) - 1)], np.uint64(0))
        value = common.mix64(value * _GOLDEN + part + np.uint64(i))
    order = np.lexsort((value, doc[at]))
    d, v = doc[at][order], value[order]
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (v[1:] != v[:-1])]))
    return d[new], v[new], np.diff(np.concatenate([new, [len(d)]]))


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, docs: int, components: int = COMPONENTS) -> np.ndarray:
    """Smallest times, one row for each of ``docs`` texts; infinite throughout for texts without shingles."""
    out = np.full((docs, components), np.inf)
    total = np.bincount(doc, weight, docs)
    limit = components * (np.log(components) + 4) / np.maximum(total, 1)
    doing = total > 0
    while doing.any():
        rows = np.flatnonzero(doing[doc])
        spans = np.ceil(np.log2(np.maximum(weight[rows], 1))).astype(np.int64) + 1
        row = np.repeat(rows, spans)
        span = np.arange(len(row)) - np.repeat(np.cumsum(spans) - spans, spans)
        rate = 2.0 ** np.maximum(span - 1, 0)
        low = np.where(span > 0, rate, 0.0)
        d, w, last = doc[row], weight[row], limit[doc[row]]
        seed = common.mix64(shingle[row] + _GOLDEN * (span + 1).astype(np.uint64))
        time = np.zeros(len(row))
        n = 0
        while len(row):
            n += 1
            bits = common.mix64(seed ^ np.uint64(n * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
            time = time - np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / rate
            going = time <= last
            row, d, w, last, seed, time, rate, low, bits = (x[going] for x in (row, d, w, last, seed, time, rate, low, bits))
            bits = common.mix64(bits + _GOLDEN)
            place = low + (bits >> np.uint64(32)).astype(np.float64) / 2.0**32 * rate
            below = place < w
            component = (bits & np.uint64(0xFFFFFFFF)).astype(np.int64)[below] % components
            np.minimum.at(out, (d[below], component), time[below])
        doing = np.isinf(out).any(1) & doing
        limit = np.where(doing, limit * 2, limit)
    return out


def bands(times: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    parts = times.view(np.uint64).reshape(len(times), n_bands, rows)
    key = np.tile(np.arange(1, n_bands + 1, dtype=np.uint64), (len(times), 1))
    for i in range(rows):
        key = common.mix64(key * _GOLDEN + parts[:, :, i])
    return key.view(np.int64)


def members(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's multiset as a set, sorted: a shingle of weight w has w members. And where each text starts."""
    nth = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
    out = common.mix64(np.repeat(shingle, weight) + _GOLDEN * nth.astype(np.uint64)).view(np.int64)
    doc = np.repeat(doc, weight)
    order = np.lexsort((out, doc))
    return out[order], np.searchsorted(doc[order], np.arange(docs + 1))


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets given by their sorted members."""
    if not len(a) or not len(b):
        return 0.0
    shared = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return shared / (len(a) + len(b) - shared)


def nodes_of(docs: DataFrame) -> DataFrame:
    """node, doc_id, keys, size: one row for each row of ``docs``; node tells the text (its MD5), keys are its band
    keys, size is the sum of its shingles' weights."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, starts = common.text_bytes(batch.column("text"))
        doc, shingle, weight = shingles(data, starts)
        times = signatures(doc, shingle, weight, batch.num_rows)
        size = np.bincount(doc, weight, batch.num_rows).astype(np.int64)
        empty = np.isinf(times).all(1)
        keys = [[] if e else k for e, k in zip(empty, bands(times))]
        return pa.RecordBatch.from_arrays([batch.column("node"), batch.column("doc_id"), pa.array(keys, pa.list_(pa.int64())), pa.array(size)], ["node", "doc_id", "keys", "size"])

    return common.map_arrow(_texts(docs).select("node", "doc_id", "text"), step, "node binary, doc_id long, keys array<long>, size long", rows=512)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.unhex(F.md5(text.cast("binary"))).alias("node"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


#: Ids and nodes up to this many may be broadcast (24 bytes each); more are joined by shuffling.
MOST_BROADCAST = 1_000_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


#: Rows of ids that one task takes on. Tasks of few rows would each leave shuffle files.
TASK_ROWS = 60_000
#: Rows that a Python worker is sent at once: pairs with both texts' sets are large where texts are long.
ROWS_SENT = 256
#: Rounds of centres end with one in which fewer than one pair in this many was near; the rest is settled whole.
FUTILE = 50


def tasks(rows: int) -> int:
    return max(1, -(-rows // TASK_ROWS))


def sets_of(wanted: DataFrame, n_wanted: int, docs: DataFrame) -> DataFrame:
    """(node, members) of the nodes in ``wanted``, of which there are ``n_wanted``, from their whole texts."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, starts = members(*shingles(*common.text_bytes(batch.column("text"))), batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(found))], ["node", "members"])

    texts = _texts(docs).join(sized(wanted, n_wanted), "node", "left_semi").groupBy("node").agg(F.any_value("text").alias("text"))
    return common.map_arrow(texts, step, "node binary, members array<long>", rows=512)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): those pairs of nodes whose sets overlap by ``similarity`` or more."""
    joined = pairs
    for side in ("b", "a"):
        joined = joined.join(sets.select(F.col("node").alias(side), F.col("members").alias(f"of_{side}")), side)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sides = []
        for column in (batch.column("of_a"), batch.column("of_b")):
            values, at = column.values.to_numpy(), column.offsets.to_numpy()
            sides.append([values[i:j] for i, j in zip(at, at[1:])])
        near = pa.array([overlap(x, y) >= similarity for x, y in zip(*sides)], pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column("a").filter(near), batch.column("b").filter(near)], ["a", "b"])

    return common.map_arrow(joined.select("a", "b", "of_a", "of_b"), step, "a binary, b binary", rows=256)


def meeting(texts: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of ``texts`` (node, root, size) of different roots, among them all that overlap by ``similarity``.

    All members have one order, by how many of these texts hold them, the rarest first. Where two texts are near, the
    first member that both hold has a place in each that leaves enough after it; so a text is entered under those of
    its first members only after which enough is left. Members that no other text holds come first and need no entry:
    a text that has many is near no other, and the loose copies of one text, each with changes of its own, part here."""
    own = texts.select("node").join(sets, "node")
    held = own.select("node", F.explode("members").alias("member"))
    times = held.groupBy("member").agg(F.count("*").alias("n")).where("n > 1")
    shared = held.join(times, "member").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "member"))).alias("shared"))
    alone = F.col("size") - F.size("shared")
    tried = F.floor(F.col("size") * (1 - similarity) + 1e-6) - alone + 1
    entries = shared.join(texts, "node").select("node", "root", "size", alone.alias("alone"), F.posexplode(F.slice("shared", 1, F.greatest(F.lit(0), tried).cast("int"))).alias("place", "of"))
    entries = entries.select("node", "root", "size", (F.col("size") - F.col("alone") - F.col("place")).alias("left"), F.col("of.member").alias("member"))
    enough = lambda left, sizes: left * (1 + similarity) >= sizes * similarity - 1e-6
    smaller = entries.where(enough(F.col("left"), 2 * F.col("size"))).alias("x")
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    ordered = (x("size") < y("size")) | (x("size") == y("size")) & (x("node") < y("node"))
    fit = ordered & (x("root") != y("root")) & enough(F.least(x("left"), y("left")), x("size") + y("size"))
    return smaller.join(entries.alias("y"), (x("member") == y("member")) & fit).select(*_unordered("x.node", "y.node"))


def components(links: DataFrame) -> DataFrame:
    """(node, root): for each node of ``links`` (a, b) the smallest node connected to it.

    Alternates linking larger and smaller neighbours to the smallest one until nothing changes; each round is
    written to the shared folder, so lineage stays short."""
    least = lambda e: e.groupBy("u").agg(F.min("v").alias("m")).coalesce(width)
    width = tasks(links.count())
    edges = common.checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct().coalesce(width))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = least(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").coalesce(width).distinct().coalesce(width)
        m = least(large)
        small = large.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(m.select("u", F.col("m").alias("v"))).coalesce(width).distinct()
        new = common.checkpointed(small.coalesce(width))
        gone = edges.join(new, ["u", "v"], "left_anti").limit(1).count() or new.join(edges, ["u", "v"], "left_anti").limit(1).count()
        edges = new
        if not gone:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _unordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def classes(docs: DataFrame, similarity: float = 0.8, stars: int = 3) -> DataFrame:
    """doc_id, class_id, class_size, kept: one row for each row of ``docs``; kept marks the row that stands for its class."""
    return labelled(docs, similarity, stars).select("doc_id", "class_id", "class_size", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("kept"))


def labelled(docs: DataFrame, similarity: float, stars: int = 3) -> DataFrame:
    """doc_id, node, root, class_id, class_size: one row for each row of ``docs``; root names the class.

    Up to ``stars`` rounds link each bucket's texts to its centre: in the first round the text that meets most others,
    then one chosen by hash. The texts of buckets that still have several roots are settled by ``meeting``. The table
    of texts that share a bucket has one row for each of them, with their keys and their root as it is known so far."""
    with common.stepwise(docs.sparkSession, ROWS_SENT):
        rows = common.checkpointed(_labelled(docs, similarity, stars))
    sizes = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return rows.join(sizes, "root")


def _labelled(docs: DataFrame, similarity: float, stars: int) -> DataFrame:
    """doc_id, node, root."""
    found = common.checkpointed(nodes_of(docs))
    nodes = found.groupBy("node").agg(F.any_value("keys").alias("keys"), F.any_value("size").alias("size"))
    entries = nodes.select("node", "size", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    texts = common.checkpointed(entries.join(shared, "key").groupBy("node").agg(F.any_value("size").alias("size"), F.sum("n").alias("degree"), F.collect_list("key").alias("keys")))
    n_texts = texts.count()
    sets = common.checkpointed(sets_of(texts.select("node"), n_texts, docs))
    rooted, links, n_links, n_new, n_pairs = texts.withColumn("root", F.col("node")), None, 0, 0, 0
    may = F.least("size", "centre.size") >= F.greatest("size", "centre.size") * similarity  # overlap is at most the ratio of sizes
    for star in range(stars + 1 if n_texts else 0):
        rank = F.struct("degree", "node") if star == 0 else F.struct(F.xxhash64("node", F.lit(star)), F.col("node"))
        rows = rooted.select("node", "root", "size", rank.alias("rank"), F.explode("keys").alias("key"))
        buckets = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max_by(F.struct("node", "root", "size"), "rank").alias("centre")).where("low < high")
        last = star == stars or star > 0 and n_new * FUTILE < max(1, n_pairs)
        if last:
            left = rows.join(buckets.select("key"), "key", "left_semi").groupBy("node").agg(F.any_value("root").alias("root"), F.any_value("size").alias("size"))
            pairs = meeting(common.checkpointed(left.coalesce(tasks(n_texts))), sets, similarity)
        else:
            pairs = rows.join(buckets, "key").where((F.col("root") != F.col("centre.root")) & may).select(*_unordered("node", "centre.node"))
        pairs = common.checkpointed(pairs.distinct())
        n_pairs, n_new = pairs.count(), 0
        if n_pairs:
            new = verified(pairs, sets, similarity)
            links = common.checkpointed(new if links is None else links.unionByName(new))
            n_new, n_links = links.count() - n_links, links.count()
        if n_new:
            roots = common.checkpointed(components(links))
            rooted = common.checkpointed(texts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        if last:
            break
    rows = found.select("doc_id", "node")
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")) if n_links else rows.withColumn("root", F.col("node"))


def deduplicated(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stand for their classes: the smallest doc_id of each, one row of it.

    A class without any id keeps one row. Rows whose id stands on different texts are told apart by text. What is dropped decides how the rows are filtered: ids of dropped rows
    are broadcast while they are few, and joined by shuffling beyond that."""
    found = common.checkpointed(labelled(docs, similarity))
    kept = F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False))
    dropped = common.checkpointed(found.where(~kept & F.col("doc_id").isNotNull()).select("doc_id").distinct())
    node = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    named = docs.where(F.col("doc_id").isNotNull())
    mixed = common.checkpointed(found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("doc_id"))
    n_mixed, apart = mixed.count(), None
    if n_mixed:
        chosen = found.where(kept).groupBy("root").agg(F.min("doc_id").alias("doc_id"), F.min("node").alias("_node")).select("doc_id", "_node")
        apart = named.join(sized(mixed, n_mixed), "doc_id", "left_semi").withColumn("_node", node).join(chosen, ["doc_id", "_node"], "left_semi").dropDuplicates(["doc_id", "_node"]).select(docs.columns)
        named = named.join(sized(mixed, n_mixed), "doc_id", "left_anti")
    named = named.join(sized(dropped, dropped.count()), "doc_id", "left_anti")
    repeated = common.checkpointed(found.where(kept).groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not repeated.isEmpty():
        named = named.join(repeated, "doc_id", "left_anti").unionByName(named.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    if apart is not None:
        named = named.select(docs.columns).unionByName(apart)
    nameless = common.checkpointed(found.where(F.col("class_id").isNull()).groupBy("root").agg(F.min("node").alias("node")))
    if nameless.isEmpty():
        return named
    others = docs.where(F.col("doc_id").isNull()).withColumn("_node", node).join(nameless.select(F.col("node").alias("_node")), "_node", "left_semi")
    return named.unionByName(others.dropDuplicates(["_node"]).select(docs.columns))
