"""Near duplicates and the pipeline against brute force."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bagminhash, common

DATA = "/root/testdata/sf0.001"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def multiset(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def brute_classes(rows):
    """The smallest id of each row's class, by all pairs."""
    sets = [multiset(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or jaccard(sets[i], sets[j]) >= 0.8:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [least.get(root(i)) for i in range(len(rows))]


def family(words, copies, edits, seed):
    """A text and near copies of it, each with some words replaced."""
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(words)]
    out = [base]
    for c in range(copies):
        copy = list(base)
        for at in r.sample(range(words), edits):
            copy[at] = f"new{seed}_{c}_{at}"
        out.append(copy)
    return [" ".join(x) for x in out]


def test_signatures_estimate_weighted_similarity():
    r = random.Random(1)
    base = [f"w{r.randrange(9)}" for _ in range(900)]
    texts = [" ".join(base), " ".join(base[:600]), " ".join(base[300:]), " ".join(base[:100] * 9)]
    data, starts = common.text_bytes(pa.array(texts))
    doc, shingle, weight = bagminhash.shingles(data, starts)
    times = bagminhash.signatures(doc, shingle, weight, len(texts), 4000)
    for i in range(4):
        assert sorted(weight[doc == i]) == sorted(multiset(texts[i]).values())
        for j in range(i):
            assert (times[i] == times[j]).mean() == pytest.approx(jaccard(multiset(texts[i]), multiset(texts[j])), abs=0.04)


def test_classes_equal_brute_force(spark):
    texts = family(300, 25, 4, 1) + family(300, 20, 13, 2) + family(80, 6, 2, 3) + ["a b c", "A b c", "", " ", "a b", "x y z q"] * 2
    random.Random(5).shuffle(texts)
    rows = list(enumerate(texts)) + [(500, None), (None, texts[0]), (None, "nobody else has this text"), (3, texts[3]), (501, "long " * 30_000), (502, "long " * 29_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit(1), "key": F.lit("clash"), "class_id": F.lit(0)})
    got = sorted(((r.doc_id or -1, r.class_id or -1) for r in bagminhash.classes(docs).collect()))
    assert got == sorted((d or -1, c or -1) for (d, _), c in zip(rows, brute_classes(rows)))
    kept = bagminhash.deduplicated(docs)
    assert set(kept.columns) == set(docs.columns)
    found = [r.doc_id for r in kept.collect()]
    classes = {c for c in brute_classes(rows) if c is not None}
    assert sorted(x for x in found if x is not None) == sorted(classes) and found.count(None) == 1
    assert bagminhash.classes(docs.limit(0)).count() == 0 and bagminhash.deduplicated(docs.limit(0)).count() == 0


def as_sets(texts):
    data, starts = common.text_bytes(pa.array(texts))
    found, cut = bagminhash.members(*bagminhash.shingles(data, starts), len(texts))
    return [found[i:j] for i, j in zip(cut, cut[1:])]


def test_overlap_of_sets():
    texts = family(60, 12, 3, 7) + ["a b a b a b a b a b a", "a b a b a b a b a", "a b c", "", " ", "long " * 9000, "long " * 8000]
    sets = as_sets(texts)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert bagminhash.overlap(sets[i], sets[j]) == pytest.approx(jaccard(multiset(a), multiset(b)))


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.95, 1.0])
def test_meeting_loses_no_near_pair(spark, similarity):
    """Loose and dense families, texts of different lengths, one class of many texts: all near pairs of different classes."""
    texts = family(80, 20, 2, 11) + family(80, 20, 5, 12) + family(90, 4, 1, 13) + ["a b c", "A b c", "a b", "w w w w w w w w", "w w w w w w w w w"]
    texts += [" ".join(texts[0].split()[:n]) for n in (40, 60, 64, 66, 70, 79)] + [t + " w w w w w w w w" for t in texts[:3]]
    root = [b"\0\0" if i < 8 else bytes([1, i]) for i in range(len(texts))]
    sets = as_sets(texts)
    rows = [(bytes([i]), root[i], len(x), x.tolist()) for i, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "node binary, root binary, size long, members array<long>")
    found = {(r.a[0], r.b[0]) for r in bagminhash.meeting(df.drop("members"), df.select("node", "members"), similarity).collect()}
    near = {(j, i) for i in range(len(texts)) for j in range(i) if root[i] != root[j] and bagminhash.overlap(sets[i], sets[j]) >= similarity}
    assert near <= found and all(root[i] != root[j] for i, j in found)
    if similarity == 0.8:  # copies of one text with five changes each are not near one another
        loose = set(range(21, 42))
        assert sum(i in loose and j in loose for i, j in found) < 21


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (102, 102)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in bagminhash.components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_classes_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert {r.doc_id: r.class_id for r in bagminhash.classes(docs).collect()} == {d: c for (d, _), c in zip(rows, brute_classes(rows))}


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "near_duplicates", "packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, common.checkpointed(stage(spark, kept, DATA))
        assert kept.schema.names == docs.schema.names
        assert kept.join(before, docs.columns, "left_anti").count() == 0 and 0 < kept.count() <= before.count()
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert brute_classes(rows) == [d for d, _ in rows]
    last = corpus_pipeline.STAGES[-1][1](spark, kept, DATA).collect()
    assert {r.doc_id for r in last} == {d for d, _ in rows}
    assert Counter({d: len((t or "").split()) + 1 for d, t in rows}) == Counter(sum((Counter({r.doc_id: r.n_tokens}) for r in last), Counter()))
    whole = corpus_pipeline.run(spark, DATA)
    assert sorted((r.doc_id, r.piece, r.n_tokens) for r in whole.collect()) == sorted((r.doc_id, r.piece, r.n_tokens) for r in last)


def test_pipeline_of_odd_rows(spark):
    """Null ids, one id on different texts, repeated rows, empty and null texts, very long ones, further columns with
    names that the operators use: each stage keeps whole rows, and clean ones."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    clean = docs.join(spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1 and toxic = 0"), "doc_id", "left_semi").orderBy("doc_id").limit(6).collect()
    a, b, c = (r.text for r in clean[:3])
    texts = [(1, a), (1, a), (1, b), (2, b), (None, c), (None, c), (None, a), (3, None), (4, ""), (5, "x" * 200_000), (6, " ".join([c] * 200)), *((r.doc_id + 100, r.text) for r in clean[3:])]
    rows = [(i, t, "en", "here", None if t is None else len(t), "n", 1.5, b"k", 7, "r") for i, t in texts]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, score double, key binary, size int, root string")
    kept = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, common.checkpointed(stage(spark, kept, DATA))
        assert kept.columns == odd.columns
        assert not Counter(map(tuple, kept.collect())) - Counter(map(tuple, before.collect()))
    left = {t for _, t in [(r.doc_id, r.text) for r in kept.collect()]}
    assert {a, b, c, *(r.text for r in clean[3:])} <= left
    assert len(left) == kept.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, DATA).collect()
    assert sum(r.n_tokens for r in packed) == sum(len((t or "").split()) + 1 for t in left)


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_ids_on_different_texts_keep_one_row_of_each_class(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(3, a), (7, a), (7, b), (1, b + " more"), (9, c), (9, "z " + c), (8, "x y"), (8, "u v"), (8, "u v")]
    got = bagminhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [1, 3, 8, 8, 9]
    rows = [(3, a), (7, a), (7, b)]
    got = bagminhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(3, a), (7, b)]
