"""Searches, packing, revisits and language model against brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bitsliced, common, kneser_ney, packing, rabitq, revisits

NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit("clash"), "dim": F.lit(1), "block": F.lit(2)})


def some(n, dim, seed=1, scale=1.0):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim)) * scale / math.sqrt(dim)
    m[n // 2 : n // 2 + 5] = m[0]  # ties
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(m)]


ODD = [(1000, None), (1010, []), (1020, [None, 1.0]), (1030, [NAN, 1.0]), (1040, [INF, 0.0]), (1050, [0.0, 0.0]), (None, [1.0, 1.0]), (1100, [0.5, 0.5]), (1101, [0.25, 0.5]), (1101, [0.25, 0.5])]


def brute(rows, every, k, value, usable):
    good = [(i, value(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and usable(v)]
    out = {}
    for q, x in dict((i, v) for i, v in good if i % every == 0).items():
        found = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in good if i != q and len(y) == len(x))[:k]
        out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return {q: v for q, v in out.items() if v}


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


@pytest.mark.parametrize("scale,dim", [(1.0, 16), (300.0, 70), (0.001, 3)])
def test_bit_sliced_search_is_exact(spark, scale, dim):
    rows = some(400, dim, scale=scale) + ODD
    got = by_query(bitsliced.search(vectors(spark, rows), block_rows=150, query_rows=3))
    assert got == brute(rows, 50, 5, lambda v: [math.floor(256 * float(np.float32(x))) for x in v], lambda v: True)


def test_bit_sliced_search_of_large_values(spark):
    large = [(2000, [6e5, 1.0]), (2001, [-6e5, 3.0]), (2002, [1e12, -1e12]), (2050, [1e12, 1e12]), (2003, [3e38, 3e38]), (2004, [3e38, 2e38]), (2100, [-3e38, 1.5])]
    rows = [(i, v) for i, v in some(200, 2, scale=300.0) + ODD + large]
    got = by_query(bitsliced.search(vectors(spark, rows), block_rows=90, query_rows=3))
    value = lambda v: [math.floor(256 * float(np.float32(x))) for x in v]
    good = [(i, value(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    expected = {}
    for q, x in ((i, v) for i, v in good if i % 50 == 0):
        score = lambda y: min(max(sum(a * b for a, b in zip(x, y)), -(2**63)), 2**63 - 1)  # noqa: B023, E731
        found = sorted((-score(y), i) for i, y in good if i != q and len(y) == len(x))[:5]
        expected[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(found)]
    assert got == expected and {2000, 2050, 2100} <= set(got)


def test_bitmap_sums():
    rng = np.random.default_rng(4)
    bits = rng.integers(0, 2, (40, 128))
    weights = rng.integers(0, 5, 40)
    planes = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)
    slices = bitsliced.add_up({int(w): [planes[weights == w]] for w in set(weights)}, 2)
    total = (bits * (1 << weights)[:, None]).sum(0)
    got = sum(np.unpackbits(s.view(np.uint8), bitorder="little").astype(int) << i for i, s in enumerate(slices))
    assert (got == total).all()
    everything = np.full(2, ~np.uint64(0))
    for k in (1, 7, 128):
        kth = bitsliced.kth_largest(slices, k, everything)
        assert kth == sorted(total)[-k]
        assert np.bitwise_count(bitsliced.at_least(slices, kth, everything)).sum() == (total >= kth).sum()


@pytest.mark.parametrize("dim", (16, 64, 70))
def test_one_bit_codes_recall(spark, dim):
    rows = some(700, dim) + ODD
    got = by_query(rabitq.search(vectors(spark, rows), block_rows=300, query_rows=10))
    expected = brute(rows, 20, 20, lambda v: [float(np.float32(x)) for x in v], any)
    assert got.keys() == expected.keys()
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in e}) for q, e in expected.items())
    assert hits >= 0.9 * sum(map(len, expected.values()))
    for q, e in got.items():
        assert [r for r, _, _ in e] == list(range(1, len(e) + 1)) and [s for *_, s in e] == sorted((s for *_, s in e), reverse=True)


@pytest.mark.parametrize("data", ["sf0.01", "sf0.1"])
def test_one_bit_codes_recall_on_embeddings(spark, data):
    """Recall of the query on the whole table, and its scores, against all products."""
    from tessera.llm import queries

    folder = f"/root/testdata/{data}"
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    rows = {i: v for i, v in rows.items() if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids, x = np.array(sorted(rows)), np.array([rows[i] for i in sorted(rows)])
    got = by_query(queries.op5_neighbours(spark, folder))
    assert got.keys() == {i for i in rows if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        scores = x @ x[np.searchsorted(ids, q)]
        scores[np.searchsorted(ids, q)] = -INF
        hits += len({i for _, i, _ in found} & set(ids[np.argsort(-scores, kind="stable")[:20]].tolist()))
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [s for *_, s in found] == pytest.approx(scores[np.searchsorted(ids, [i for _, i, _ in found])])
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
    assert hits >= 0.99 * 20 * len(got)


def test_repeated_query_ids_and_ties(spark):
    """Rows that share an id are candidates each, but not for their own id, and one query; equal vectors go by id."""
    v = [0.25, -0.5, 1.0]
    rows = [(i, v) for i in (40, 7, 3, 60, 7, 100)] + [(0, v), (0, v), (5, [0.0, 0.0, 0.125])]
    for search, every, k in ((rabitq.search, 20, 20), (bitsliced.search, 50, 5)):
        got = by_query(search(vectors(spark, rows)))
        assert [i for _, i, _ in got[0]] == [3, 7, 7, 40, 60, 100, 5][:k] and set(got) == {i for i, _ in rows if i % every == 0}


def test_estimates_are_near():
    rng = np.random.default_rng(5)
    m = rng.normal(size=(500, 64))
    m /= np.linalg.norm(m, axis=1)[:, None]
    turned = m @ rabitq.rotation(64)
    own = np.abs(turned).sum(1) / 8
    q = rng.normal(size=64)
    q /= np.linalg.norm(q)
    guess, _ = rabitq.estimates(rabitq._packed_bits(turned > 0), own, np.stack([q, -q]) @ rabitq.rotation(64), 6)
    assert np.allclose(guess[0], -guess[1], atol=0.02)
    error = guess[0] - m @ q
    assert abs(error.mean()) < 0.02 and error.std() < 0.12


@pytest.mark.parametrize("search", [bitsliced.search, rabitq.search])
def test_searches_of_nothing(spark, search):
    assert search(vectors(spark, [])).count() == 0 and search(vectors(spark, [(0, [1.0])])).count() == 0


def test_packing(spark):
    rng = np.random.default_rng(6)
    items = np.minimum(rng.geometric(0.002, 3000), 8192)
    sizes = packing.Sizes()
    bins, places, final = packing.best_fit(items, sizes)
    for b in range(bins.max() + 1):
        own = np.flatnonzero(bins == b)
        spans = sorted((places[i], places[i] + items[i]) for i in own)
        assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
        assert final[own[0]] == sizes.holding(spans[-1][1])
    first = {b: f for b, f in zip(bins, final)}
    assert items.sum() / sum(first.values()) > 0.97
    assert len(packing.best_fit(np.zeros(0, np.int64), sizes)[0]) == 0


def test_packing_rows(spark):
    texts = [(1, "a b c"), (2, None), (2, None), (None, ""), (3, "w " * 20_000), (4, "x" * 100_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"n_tokens": F.lit("clash"), "deal": F.lit(1)})
    rows = packing.pack(packing.lengths(docs), shard_rows=2).collect()
    assert sorted((r.doc_id or 0, r.piece, r.n_tokens) for r in rows) == [(0, 0, 1), (1, 0, 4), (2, 0, 1), (2, 0, 1), (3, 0, 8192), (3, 1, 8192), (3, 2, 20_001 - 16_384), (4, 0, 2)]
    assert len({(r.bin_id, r.place) for r in rows}) == len(rows)
    assert packing.pack(packing.lengths(docs.limit(0))).count() == 0


def naive_best_fit(items, sizes):
    """The bins as (size, contents) by looking at every open bin and filling every permitted size item by item. Of
    bins with the same room the one that came to it last is taken."""
    order = sorted(range(len(items)), key=lambda i: (-items[i], i))
    bins = []  # size, used, when last used
    for at, i in enumerate(order):
        n = items[i]
        fitting = [(size - used, -when, b) for b, (size, used, when) in enumerate(bins) if size - used >= n]
        if fitting:
            b = min(fitting)[2]
        else:
            best = None
            for size in sizes.lengths:
                if size >= n:
                    room = size - n
                    for j in order[at + 1 :]:
                        room -= items[j] if items[j] <= room else 0
                    rate = sizes.cost(sizes.holding(size - room)) / (size - room)
                    if best is None or rate < best[0] - 1e-12:
                        best = (rate, size)
            bins.append((best[1], 0, 0))
            b = len(bins) - 1
        bins[b] = (bins[b][0], bins[b][1] + n, at)
    return [used for _, used, _ in bins]


@pytest.mark.parametrize("seed", range(6))
def test_packing_equals_a_naive_one(seed):
    rng = np.random.default_rng(seed)
    sizes = packing.Sizes((8, 16, 32, 64), 512.0)
    items = np.minimum(rng.geometric((0.05, 0.2, 0.5)[seed % 3], 150), 64)
    bins, places, final = packing.best_fit(items, sizes)
    used = np.bincount(bins, items).astype(int)
    assert used.tolist() == naive_best_fit(items.tolist(), sizes)
    assert [int(final[bins == b][0]) for b in range(len(used))] == [sizes.holding(int(u)) for u in used]


def test_packing_of_one_repeated_row(spark, monkeypatch):
    """Equal rows are dealt to all shards, each piece once; runs agree."""
    monkeypatch.setattr(packing, "TOGETHER", 8)
    docs = spark.range(600).select(F.lit(5).cast("long").alias("doc_id"), F.lit("a b c").alias("text")).unionByName(spark.createDataFrame([(i, "w " * i) for i in range(40)], "doc_id long, text string"))
    rows = packing.pack(packing.lengths(docs), shard_rows=40).collect()
    assert len(rows) == 640 and len({(r.bin_id, r.place) for r in rows}) == 640
    shards = Counter(r.bin_id >> 32 for r in rows if r.n_tokens == 4 and r.doc_id == 5)
    assert len(shards) > 10 and max(shards.values()) < 160
    again = packing.pack(packing.lengths(docs.repartition(7)), shard_rows=40).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_revisits_query_has_all_outcomes(spark):
    from tessera.llm import queries

    data = "/root/testdata/sf0.01"
    found = queries.op4_revisits(spark, data)
    assert {r.outcome for r in found.select("outcome").distinct().collect()} == {"resolved", "mismatch", "unverified", "orphan"}
    assert found.count() == spark.read.parquet(f"{data}/pages.parquet").count()


def test_revisits_of_odd_pages(spark):
    """Repeated rows, null ids and null or empty addresses: one row for each revisit, and no page answers for an empty address."""
    pages = spark.createDataFrame([(1, "http://a.org/x", "h"), (1, "http://a.org/x", "h"), (7, "", "h"), (8, "", "h"), (14, None, "h"), (None, "http://a.org/x", "h"), (21, "http://a.org/x", None)], "page_id long, url string, html string").withColumn("headers", F.lit(0))
    got = [(r.record_id, r.outcome) for r in revisits.resolve(revisits.captures_of(pages)).collect()]
    assert Counter(got) == Counter([(3, "mismatch"), (3, "mismatch"), (15, "orphan"), (17, "orphan"), (29, "orphan"), (None, "orphan"), (43, "resolved")])


CAPTURES = [
    (1, "http://WWW.a.org:80/x/?utm_source=q&b=2&a=1#f", 10, False, '"v1"', None, {"etag": '"v1"', "content-length": "5", "date": "d1"}),
    (2, "https://a.org/x?a=1&b=2", 20, True, 'W/"v1"', None, {"content-length": "0", "date": "d2"}),
    (3, "https://a.org/x?a=1&b=2", 30, False, '"v2"', "yesterday", {"etag": '"v2"'}),
    (4, "https://a.org/x?a=1&b=2", 200_000, True, '"v1"', None, {}),
    (5, "https://a.org/x?a=1&b=2", 200_000, True, None, "yesterday", None),
    (6, "https://a.org/x?a=1&b=2", 30, True, '"v1"', None, {"set-cookie": "no", "age": "1"}),
    (7, "https://b.org/", 5, True, '"v1"', None, {}),
    (8, None, 5, True, None, None, {}),
    (9, "https://a.org/x?b=2&a=1", None, True, None, None, {}),
    (10, "https://a.org/x?b=2&a=1", 40, True, None, None, {}),
]


@pytest.mark.parametrize("span", (7, 1000, 1 << 40))
def test_revisits(spark, span):
    df = spark.createDataFrame(CAPTURES, "record_id long, url string, ts long, is_revisit boolean, etag string, last_modified string, headers map<string,string>").withColumn("outcome", F.lit(0))
    got = {r.record_id: r for r in revisits.resolve(df, span).collect()}
    assert {i: (r.outcome, r.source_id) for i, r in got.items()} == {
        2: ("resolved", 1), 4: ("mismatch", 3), 5: ("resolved", 3), 6: ("resolved", 1), 7: ("orphan", None), 8: ("orphan", None), 9: ("orphan", None), 10: ("unverified", 3),
    }
    assert got[2].headers == {"etag": '"v1"', "content-length": "5", "date": "d2"}
    assert got[6].headers == {"etag": '"v1"', "content-length": "5", "date": "d1", "age": "1"}
    assert got[2].url_key == "a.org/x?a=1&b=2"
    assert revisits.resolve(df.limit(0)).count() == 0


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def test_language_model(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"W{int(x)}É" for x in np.minimum(rng.geometric(0.05, rng.integers(0, 60)), 80)) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(200, None), (201, ""), (202, " new words \v here"), (3, texts[3]), (None, "w1é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("clash"), "n_tokens": F.lit(0)})
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")) + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    uni, bi, n = Counter(), Counter(), 0
    for i, t in rows:
        if not held(i):
            w = tokens(t)
            uni.update(w)
            bi.update(zip(["<"] + w, w))
            n += 1
    total, size = uni.total(), len(uni)
    cont = Counter(w for _, w in bi)
    d2, d1 = (kneser_ney.Discounts.of([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]) for c in (bi, cont))
    cut = lambda d, c: float(d(np.array([c]))[0])
    mass1 = sum(cut(d1, c) for c in cont.values()) / len(bi)
    single = lambda w: max(cont[w] - cut(d1, cont[w]), 0) / len(bi) + mass1 / (size + 1)
    after = {}
    for (a, _), c in bi.items():
        after[a] = after.get(a, 0) + cut(d2, c)

    def p(a, w):
        context = n if a == "<" else uni[a]
        return single(w) if not context else max(bi[a, w] - cut(d2, bi[a, w]), 0) / context + after[a] / context * single(w)

    assert sum(p("w1é", w) for w in [*uni, "unknown"]) == pytest.approx(1)
    got = kneser_ney.score_all(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, t in rows:
        w, r = tokens(t), by_id[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w), sum(uni[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10((uni[x] + 0.5) / (total + 0.5 * (size + 1))) for x in w))
        assert r.score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(["<"] + w, w)))
    assert kneser_ney.score_all(docs.limit(0)).count() == 0


@pytest.mark.parametrize("order,per_shard", [(2, 300), (3, 4_000_000), (3, 300), (5, 300)])
def test_language_model_of_longer_grams(spark, tmp_path, order, per_shard):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{int(x)}" for x in np.minimum(rng.geometric(0.15, rng.integers(0, 40)), 30)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(200, None), (201, ""), (202, " new w1 w2 new w1 w1 w1"), (203, texts[3]), (204, "w1"), (205, "w1"), *((300 + i, "w7 w8 w9 w10") for i in range(400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tokens = lambda t: (t or "").split() + [None]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    words, raw = Counter(), [Counter() for _ in range(order + 1)]
    for i, t in rows:
        if not held(i):
            w = ["<"] + tokens(t)
            words.update(w[1:])
            for k in range(2, order + 1):
                raw[k].update(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
    adjusted = {order: raw[order]}
    for k in range(order - 1, 0, -1):
        adjusted[k] = Counter(g[1:] for g in raw[k + 1])
        if k > 1:
            adjusted[k].update({g: n for g, n in raw[k].items() if g[0] == "<"})
    d = {k: kneser_ney.Discounts.of([sum(v == j for v in c.values()) for j in (1, 2, 3, 4)]) for k, c in adjusted.items()}
    cut = lambda k, c: float(d[k](np.array([c]))[0])
    total, lost = Counter(), Counter()
    for k, c in adjusted.items():
        for g, n in c.items():
            total[k, g[:-1]] += n
            lost[k, g[:-1]] += cut(k, n)

    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else 1 / (len(words) + 1)
        n, all_of = adjusted[k][g], total[k, g[:-1]]
        return max(n - cut(k, n), 0) / all_of + lost[k, g[:-1]] / all_of * lower if all_of else lower

    for context in [("w1", "w2"), ("<",), ("<", "w1"), ("new", "w1"), ("w7", "w8", "w9")]:
        assert sum(p((*context[-(order - 1) :], w)) for w in [*words, "unknown"]) == pytest.approx(1)
    training = docs.where(~common.held_out("doc_id", 5, 1)).select("text")
    model = kneser_ney.fit(training, training.count(), f"file://{tmp_path}", per_shard=per_shard, order=order)
    assert (model.shards > 5 and len(model.hot) > 2) == (per_shard == 300)
    got = {r.doc_id: r.score for r in kneser_ney.score(docs, model).collect()}
    for i, t in rows:
        w = ["<"] + tokens(t)
        assert got[i] == pytest.approx(sum(math.log10(p(tuple(w[max(0, j - order + 1) : j + 1]))) for j in range(1, len(w))))


@pytest.mark.parametrize("bits", [8, 40])
def test_grams_as_a_tree(bits):
    rng = np.random.default_rng(3)
    rows = [tuple(int(x) for x in r) for r in rng.integers(0, 5, (500, 3))]
    columns, n = kneser_ney.distinct([np.array(c, np.uint64) for c in zip(*rows)], bits)
    columns, n = kneser_ney.decoded([a.tobytes() for a in kneser_ney.encoded(columns, n)])
    assert list(zip(zip(*(c.tolist() for c in columns)), n.tolist())) == sorted(Counter(rows).items())


def test_files_with_a_directory(tmp_path):
    """Keys of 48 bits in a file with a directory are found as in one without; some leading bits have many, most none."""
    rng = np.random.default_rng(4)
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 48, 70_000), rng.integers(5 << 32, 6 << 32, 5_000), [0, (1 << 48) - 1]])).astype(np.uint64)
    counts = rng.integers(1, 400, (len(keys), 2))
    folder = f"file://{tmp_path}"
    kneser_ney._write_counts(folder, "x-0", keys, counts, 48)
    kneser_ney._write_counts(folder, "x-1", keys[:9000], counts[:9000], 48)
    assert {f.name for f in tmp_path.iterdir()} == {"x-0.first", "x-0.rest", "x-0.count", "x-0.large", "x-1.key", "x-1.count", "x-1.large"}
    reader = kneser_ney.Reader(kneser_ney.Model(folder, 2))
    asked = np.concatenate([keys, rng.integers(0, 1 << 48, 9000).astype(np.uint64), keys + np.uint64(1) & np.uint64((1 << 48) - 1)])
    known = {int(k): tuple(c) for k, c in zip(keys, counts)}
    for part, have in ((0, known), (1, {int(k): known[int(k)] for k in keys[:9000]})):
        got = reader.lookup("x", np.full(len(asked), part), asked, 2)
        assert [tuple(x) for x in got] == [have.get(int(k), (0, 0)) for k in asked]


def test_query_takes_longer_contexts():
    from tessera.llm import queries

    assert queries.ORDER >= 3
