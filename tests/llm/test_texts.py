"""Classifiers, HTML text and pieces: held-out accuracy, defined results for awkward input, exact comparisons."""

import random
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, html_text, pieces, quality, toxicity, transducer
from tessera.llm.queries import PIECES, op1_toxicity, op2_quality

DATA = "/root/testdata/sf0.01"
ODD = [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, "idiot"), (4, "idiot"), (5, "x" * 300_000), (6, "word " * 60_000), (7, "\u0000 \U0001f600 é")]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"score": F.lit("clash"), "held_out": F.lit(1), "predicted": F.lit(None)})


def no_labels(spark):
    return spark.createDataFrame([(None, None, None), (2, None, 1)], "doc_id long, quality int, toxic int")


def accuracy(spark, found, label):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    rows = found.where("held_out").join(labels, "doc_id").select("doc_id", "predicted", "y").collect()
    assert rows
    return sum(r.predicted == r.y for r in rows) / len(rows)


def test_held_out_is_the_remainder(spark):
    rows = spark.range(40).select("id", common.held_out("id", 3, 1).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)


def test_toxicity_accuracy(spark):
    found = op1_toxicity(spark, DATA)
    assert found.count() == 1000 and accuracy(spark, found, "toxic") > 0.9
    assert found.where("score < 0 or score > 1 or (predicted = 1) <> (score >= 0.7)").count() == 0


def test_quality_accuracy(spark):
    found = op2_quality(spark, DATA)
    assert found.count() == 1000 and accuracy(spark, found, "quality") > 0.95
    assert found.where("score < 0 or score > 1 or (predicted = 1) <> (score >= 0.3)").count() == 0


@pytest.mark.parametrize("of", [toxicity, quality])
def test_classifiers_on_odd_rows(spark, of):
    docs = odd(spark)
    model = of.fit(docs, no_labels(spark))
    rows = of.score(docs, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.doc_id is None for r in rows) == 1 and len({r.score for r in rows if r.doc_id == 4}) == 1
    assert of.score(docs.limit(0), of.fit(docs.limit(0), no_labels(spark).limit(0))).count() == 0
    keep = toxicity.without_toxic if of is toxicity else quality.of_quality
    assert set(keep(docs, model).columns) == set(docs.columns)


def naive_strength(model, text):
    """Strength, hits and words by trying every entry and exception at every word."""
    words = toxicity.fold(text).split()
    weights = {}
    for entry, w in model.entries:
        weights[entry] = max(w, weights.get(entry, 0.0))
    hits = {i: max((w for e, w in weights.items() if (word + " ").startswith(e)), default=0.0) for i, word in enumerate(words)}
    for phrase in model.exceptions:
        parts = toxicity.fold(phrase).split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                for j in range(i, i + len(parts)):
                    hits[j] = 0.0
    return sum(hits.values()), sum(w > 0 for w in hits.values()), len(words)


def test_automaton_equals_a_naive_matcher(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert len(model.entries) > 20
    machine = model.automaton()
    r = random.Random(4)
    texts = [t or "" for (t,) in docs.select("text").limit(60).collect()]
    parts = [e.strip() for e, _ in model.entries] + list(model.exceptions) + ["word", "tr4sh c4n", "...", "x" * 40]
    texts += [" ".join(r.choice(parts) + r.choice(["", "s", "ed", "!"]) for _ in range(r.randint(1, 15))) for _ in range(300)] + [t for _, t in ODD if t and len(t) < 1000]
    for text in texts:
        own, naive = model.strength(machine, text), naive_strength(model, text)
        assert own[1:] == naive[1:] and own[0] == pytest.approx(naive[0]), text


def test_long_words_give_no_whole_word_entry():
    features = toxicity._features("abcdefghijklmnopqrstuvwxyzabc short")
    assert "short " in features and not any(f.endswith(" ") and len(f) > 24 for f in features) and not any(len(f) > 6 for f in features if not f.endswith(" "))


def test_near_copies_leave_the_sample(spark):
    """Copies of a text count once, texts that share a line don't."""
    r = random.Random(3)
    line = "all rights are reserved by the owner of this text and so on and on"
    own = [" ".join(f"w{r.randrange(10**6)}" for _ in range(200)) + f" {line}" for _ in range(60)]
    copies = [own[0].replace(own[0].split()[r.randrange(200)], "other") for _ in range(40)]
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame(list(zip(ids, own + copies)), "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    kept = [x.text for x in toxicity.training_sample(docs, labels, 1000).collect()]
    assert set(own) <= set(kept) and len(kept) < 66


def test_quality_equals_a_direct_fit(spark):
    """Ridge weights from all rows at once, calibration by a naive isotonic regression."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    sample = common.labelled_sample(docs, labels, "quality", 5, 0, 16_000).withColumn("part", F.expr("pmod(xxhash64(doc_id, 1), 5)")).collect()
    x, y = np.stack([quality.statistics(r.text) for r in sample]), np.array([r.y for r in sample], float)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, x.std(0) + 1e-6)
    fits = np.array([r.part < 4 for r in sample])
    phi = quality.features(x, model.mean, model.scale, model.directions, model.phases)
    a, b = phi[fits], y[fits]
    weights = np.linalg.lstsq(np.vstack([a / np.sqrt(len(a)), np.sqrt(1e-3) * np.eye(a.shape[1])]), np.r_[b / np.sqrt(len(a)), np.zeros(a.shape[1])], rcond=None)[0]
    assert np.allclose(model.weights, weights, atol=1e-6)
    raw, rest = phi[~fits] @ weights, y[~fits]
    order = np.argsort(raw, kind="stable")
    raw, rest = raw[order], rest[order]
    # the greatest of the means of runs that end here or later, over the least start: min-max form of isotonic regression
    sums = np.r_[0, np.cumsum(rest)]
    value = [max(min((sums[j] - sums[i]) / (j - i) for j in range(k + 1, len(rest) + 1)) for i in range(k + 1)) for k in range(len(rest))]
    assert np.allclose(np.interp(raw, *model.steps), value, atol=1e-9)


def test_repeated_ids_leave_the_sample_bounded(spark):
    docs = spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, toxic int")
    assert [tuple(r) for r in common.labelled_sample(docs, labels, "toxic", 3, 1, 10).collect()] == [(1, "text 0", 1)]


def test_folding_and_exceptions():
    model = toxicity.ToxicityModel((("idiot".replace("l", "i"), 2.0), ("trash", 2.0)), toxicity.EXCEPTIONS, 1.0, 1.0)
    machine = model.automaton()
    hits = lambda t: model.strength(machine, t)[1]
    for text in ("idiot", "IDIOT!", "1d10t", "іdіоt", "ｉｄｉｏｔ", "ídïót", "idiots and others", "id​iot"):
        assert hits(text) == 1, text
    assert hits("bidiot") == 0 and hits("idi ot") == 0
    assert hits("the trash can") == 0 and hits("the trash heap") == 1 and hits("trash can trash") == 1
    strength, _, words = model.strength(machine, "idiot " + "word " * 9999)
    assert model.normalised(strength, words) < model.normalised(*model.strength(machine, "idiot")[::2])


def test_isotonic():
    x, y = np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 1])
    at, value = quality.isotonic(x, y)
    assert list(np.interp([1, 2, 3, 4], at, value)) == [0, 0.5, 0.5, 1] and (np.diff(value) >= 0).all()


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    d, n = quality.N_STATISTICS, 4000
    x = rng.normal(size=(2, d))
    phi = quality.features(x, np.zeros(d), np.ones(d), rng.normal(size=(d, n)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, n))[:, 1:]
    assert phi[0] @ phi[1] == pytest.approx(np.exp(-((x[0] - x[1]) ** 2).sum() / (2 * d)), abs=0.06)


ARTICLE = "<article><h1>A title</h1><p>The first of the paragraphs is about this and that,<br>and it is long enough to be one.</p><p>Short.</p>{}</article>"
PAGE = (
    "<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t='</p><p>no';</script></head><body><header><a href=x>no home</a></header><nav><ul><li><a>no</a></li></ul></nav>"
    "<div class='cookie-notice'>no, this is the notice that we show to all of you here.</div>{}<aside>no side</aside><form><p>no form</p></form>"
    "<section id=comments><p>no, I read this and it was the best of all that I have read.</p></section><footer>&copy; no</footer></body></html>"
)


def test_html_article():
    text, n = html_text.main_text(PAGE.format(ARTICLE.format("<div class='ad banner'>no</div><p>A&amp;B &lt;x&gt; &eacute;&nbsp; c</p>")))
    assert text.split("\n") == ["A title", "The first of the paragraphs is about this and that, and it is long enough to be one.", "Short.", "A&B <x> é c"] and n == 4


def test_html_without_article_element():
    body = "<div><h2>Head</h2><p>The first of the paragraphs is about this and that, and it is long enough to be one of them, so that the rules can tell it is text.</p><p>Short one.</p><p>And this is another one of those paragraphs that are long enough to be seen as text by the rules, whatever is near it on the page.</p></div>"
    text, _ = html_text.main_text(PAGE.format(body))
    assert text.startswith("Head\nThe first") and "Short one." in text and "no" not in text.split()


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!-- open", "<script>", "plain", "<article><p>cut &am", "</div></p></article>", "<a>" * 500, "<div>" * 3000 + "deep"])
def test_html_broken(page):
    text, _ = html_text.main_text(page)
    assert isinstance(text, str)


PROSE = "<p>The first of the paragraphs is about this and that, and it is long enough to be one of them.</p><p>Another of the paragraphs is here and it has all of the words that it needs to have.</p>"
TEXT = "The first of the paragraphs is about this and that, and it is long enough to be one of them.\nAnother of the paragraphs is here and it has all of the words that it needs to have."


@pytest.mark.parametrize(
    "page",
    [
        '<article class="overflow-hidden">{}</article>',
        '<div class="overflow-hidden">{}</div>',
        '<article class="ad-free">{}</article>',
        '<div class="post-search-engines">{}</div>',
        '<title>Never closed <article>{}</article>',
        '<div class="content has-sidebar"><article>{}</article></div>',
        '<div class="sidebar"><main>{}</main></div>',
        '<div class="widget">{}</div>',  # nothing else is there
        '<article><a href="never closed>link</a>{}</article>',
        '<article><div hidden>no</div><div style="display: none">no</div><div aria-hidden="true">no</div>{}</article>',
        '<article>{}<article class="x"><p>A comment that is about the article and that is as long as one of them.</p></article></article>',
        '<div class="ad">Buy the thing that you have wanted to have and that is on offer for you.</div><article>{}</article><aside>{}</aside>',
        '<article>{}<noscript>Turn it on</noscript><form>Name <input name=n> <button>Go</button></form></article>',
    ],
)
def test_html_marks_are_whole_names(page):
    assert html_text.main_text(page.replace("{}", PROSE, 1).replace("{}", PROSE))[0] == TEXT


def test_html_marks():
    for value in ("ad", "Sidebar", "comment-list", "cookie_banner", "social-share-buttons", "widget-3", "top-nav"):
        assert html_text.is_mark(value), value
    for value in ("overflow-hidden", "ad-free", "post-search-engines", "has-sidebar", "entry-header", "article-header", "shared", "list", ""):
        assert not html_text.is_mark(value), value


def test_html_of_other_languages():
    first, second = "这是一个关于天气的文章，今天的天气很好。" * 5, "第二段文字也很长，它讲述了城市的历史。" * 5
    page = f"<nav><a href=x>首页</a><a href=y>新闻</a></nav><div><p>{first}</p><p>{second}</p></div><div><a href=z>{first}</a></div>"
    assert html_text.main_text(page)[0] == f"{first}\n{second}"
    assert "x + y" in html_text.main_text(f"<article>{PROSE}<p><math>x + y</math></p><object>kept</object></article>")[0].split("\n")


@pytest.mark.parametrize("run", ['<a "x ', '<a b="x ', "<a b='", "<!--", "<script>", "<title>", "<b ", "</", "<!x", "<div>", "&", "<a b=c", '<a ="" ', "</div>", "<section></div>", "<article><section></div></article>", "<i hidden>"])
def test_html_takes_time_in_proportion(run):
    began = time.process_time()
    html_text.main_text("<div><article>" + run * (1_000_000 // len(run)))
    assert time.process_time() - began < 8


class ArticleReader(HTMLParser):
    """The blocks of article elements, read by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts, self.blocks = 0, [], []

    def close_block(self):
        if text := " ".join("".join(self.parts).split()):
            self.blocks.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "article"):
            self.close_block()
        self.depth += tag == "article"
        if tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.close_block()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


def test_html_equals_a_plain_parser(spark):
    """On pages whose article element holds the whole text; all pages of the table are such."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for row in pages.collect():
        reader = ArticleReader()
        reader.feed(row.html or "")
        reader.close()
        assert got[row.page_id] == "\n".join(reader.blocks), row.page_id


def test_html_of_an_empty_table_and_long_pages(spark):
    pages = spark.createDataFrame([(1, "u", f"<nav>no</nav><article>{PROSE * 3000}</article>", "extra", 5)], "page_id long, url string, html string, text string, n_chars int")
    assert html_text.extract(pages.limit(0)).count() == 0
    (row,) = html_text.extract(pages).collect()
    assert row.text == "\n".join([TEXT] * 3000) and row.n_chars == len(row.text)


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", None), (None, None, "<article><p>x y</p></article>"), (1, "u", None)], "page_id long, url string, html string").withColumn("text", F.lit(0))
    assert sorted((r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [("", 0), ("", 0), ("x y", 3)]


def test_pieces_equal_the_library(spark):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=PIECES)
    with open(PIECES, "rb") as f:
        machine = pieces.Machine.compile(f.read())
    r = random.Random(3)
    texts = ["", " ", "   a  b ", "\n\n x", "▁", "日本語テスト", "😀😀", "\t\ttab", "<s> </s> <0x0A>", "\x00", "a" * 40, " " * 41 + "x", "-----=====", "def f(x):\n    return x\n"]
    texts += ["".join(r.choice("abcdeinrst  ▁\n.ée漢😀0") for _ in range(r.randint(1, 40))) for _ in range(1500)]
    for t in texts:
        ids = machine.encode(t)
        assert ids.tolist() == sp.encode(t) and machine.decode(ids) == sp.decode(sp.encode(t)), t


#: Left and right sides of rewriting rules, some the beginning of others.
RULES = {"ﬁ": "fi", "①": "1", "Ａ": "a", "\u3000": " ", "\t": " ", "e\u0301": "é", "e\u0301\u0323": "x", "\u0001": "", "™": "tm", "c c": "d"}


def character_map(rules):
    """Rules as a double array (any placement that has no two states in one place will do) and their right sides."""
    right, at, trie = b"", {}, {}
    for left, new in rules.items():
        node = trie
        for byte in left.encode():
            node = node.setdefault(byte, {})
        node[0] = len(right)
        right += new.encode() + b"\0"
    units, taken, bases = np.zeros(1 << 16, np.uint32), {0}, set()

    def place(node, state, label):
        offset = next(o for o in range(1, 1 << 16) if state ^ o not in bases and taken.isdisjoint(state ^ o ^ c for c in node))
        bases.add(state ^ offset)
        taken.update(state ^ offset ^ c for c in node)
        units[state] = offset << 10 | (256 if 0 in node else 0) | label
        for c, child in node.items():
            if c:
                place(child, state ^ offset ^ c, c)
            else:
                units[state ^ offset] = 1 << 31 | child

    place(trie, 0, 0)
    units = units[: -(-(max(taken) + 1) // 256) * 256]
    return np.uint32(units.nbytes).tobytes() + units.tobytes() + right


def model_file(kind, pieces_, byte_fallback, squeeze, prefix, rules):
    """A model in the format of its files, written by hand."""

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    part = lambda field, value: number(field << 3 | 2) + number(len(value)) + value
    flag = lambda field, value: number(field << 3) + number(value)
    out = b""
    special = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] * byte_fallback
    for text, score, type_ in special + pieces_:
        out += part(1, part(1, text.encode()) + number(2 << 3 | 5) + np.float32(score).tobytes() + flag(3, type_))
    spec = part(1, b"own") + (part(2, character_map(rules)) if rules else b"") + flag(3, prefix) + flag(4, squeeze) + flag(5, 1)
    return out + part(2, flag(3, kind) + flag(35, byte_fallback)) + part(3, spec)


@pytest.mark.parametrize("kind", [pieces.UNIGRAM, pieces.BPE])
@pytest.mark.parametrize("byte_fallback,squeeze,prefix,rules", [(1, 0, 1, {}), (0, 1, 1, RULES), (1, 1, 1, RULES), (0, 0, 0, RULES), (1, 1, 0, {})])
def test_models_of_both_kinds_equal_the_library(kind, byte_fallback, squeeze, prefix, rules):
    sentencepiece = pytest.importorskip("sentencepiece")
    r = random.Random(7)
    parts = {c for c in "▁abcdefitmé1x"} | {"▁" * (r.random() < 0.4) + "".join(r.choice("abcdefitm1") for _ in range(r.randint(2, 5))) for _ in range(400)}
    if kind == pieces.BPE:  # every piece can be merged from shorter ones
        parts |= {t[:n] for t in parts for n in range(1, len(t))}
    order = sorted(parts, key=lambda t: (len(t), r.random()))
    known = [(t, -float(i) if kind == pieces.BPE else -r.uniform(1, 3) * (1 + len(t)) ** 0.5 - 0.001 * i, 1) for i, t in enumerate(order)]
    data = model_file(kind, known, byte_fallback, squeeze, prefix, rules)
    library, machine = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Machine.compile(data)
    assert machine.rules == rules
    signs = [*"abcdefitm1éxzz  ▁漢", *RULES, "e"]
    texts = ["", " ", "  a", "a  ", "zz", "a zz b", "  ", "e\u0301\u0323 e\u0301"] + ["".join(r.choice(signs) for _ in range(r.randint(1, 30))) for _ in range(1500)]
    for t in texts:
        ids, own = library.encode(t), machine.encode(t).tolist()
        if kind == pieces.BPE or sum(machine.scores[i] for i in own) != pytest.approx(sum(machine.scores[i] for i in ids)):
            assert own == ids, t  # the library adds scores in single precision, which may part equal ones
        assert machine.decode(np.array(ids, np.int64)) == library.decode(ids), t


def test_pieces_of_the_user_and_across_words():
    sentencepiece = pytest.importorskip("sentencepiece")
    known = [(c, -5.0 - i / 10, 1) for i, c in enumerate("▁abcd")] + [("ab", -5.5, 1), ("b▁c", -6.0, 1), ("▁a▁b", -7.0, 1), ("cab", 0.0, 4)]
    data = model_file(pieces.UNIGRAM, known, 1, 0, 1, {})
    library, machine = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Machine.compile(data)
    r = random.Random(2)
    for _ in range(500):
        t = "".join(r.choice("abcd ") for _ in range(r.randint(1, 20)))
        assert machine.encode(t).tolist() == library.encode(t), t


def test_shortest_path_equals_all_paths():
    """Against every way of cutting a text into pieces; with a grammar, those in which it forbids nothing."""
    r = random.Random(5)
    weights = {t: (i, r.randint(500, 4000)) for i, t in enumerate({"".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(25)} - {"c"})}
    machine = transducer.Pieces(weights, lambda c: (100 + ord(c),), 9000)
    barred = {(a, b) for a in range(25) for b in range(25) if r.random() < 0.3}

    def ways(text, last, follows):
        if not text:
            return [(0, [])]
        out = [(9000 + w, [100 + ord(text[0]), *ids]) for w, ids in ways(text[1:], -1, follows)] if text[0] not in weights else []
        for n in range(1, 5):
            if len(text) >= n and text[:n] in weights and follows(last, weights[text[:n]][0]):
                i, own = weights[text[:n]]
                out += [(own + w, [i, *ids]) for w, ids in ways(text[n:], i, follows)]
        return out

    for _ in range(150):
        text = "".join(r.choice("abc") for _ in range(r.randint(1, 9)))
        for follows in (None, lambda a, b: (a, b) not in barred):
            if found := ways(text, -1, follows or (lambda a, b: True)):
                ids = transducer.shortest_path(text, machine, follows)
                assert (min(found)[0], ids) in found


def test_pieces_rows(spark):
    docs = odd(spark)
    out = pieces.encode(docs, PIECES)
    assert out.count() == len(ODD) and out.where("not restored").count() == 0
    assert pieces.encode(docs.limit(0), PIECES).count() == 0 and pieces.decode(out.limit(0), PIECES).count() == 0
    back = {r.doc_id: r.text for r in pieces.decode(out.where("doc_id >= 2"), PIECES).collect()}
    assert all(back[i] == t for i, t in ODD if i and i >= 2)


def test_batches_are_cut_by_rows_and_bytes(monkeypatch):
    monkeypatch.setattr(common, "MOST_BYTES", 10)
    texts = ["a" * n for n in (3, 7, 1, 25, 0, 0, 5, 5, 1, 11)] + [None]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    assert common.cuts(batch, 100) == [0, 2, 3, 4, 8, 9, 10, 11] and common.cuts(batch.slice(3), 2) == [0, 1, 3, 5, 6, 7, 8]
    assert common.cuts(batch.slice(0, 0), 5) == [0] and common.cuts(pa.RecordBatch.from_pydict({"x": [1, 2, 3]}), 2) == [0, 2, 3]


@pytest.mark.parametrize("segment", [1, 7, 64, 1 << 22])
def test_word_hashes_in_segments(monkeypatch, segment):
    """Words are told apart by their bytes alone, wherever they stand and however the bytes are cut."""
    r = random.Random(6)
    words = ["a", "b", "ab", "ba", "é", "x" * 100, "aa", "\x01", *("".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(60))]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 30))) for _ in range(40)]
    data, starts = common.text_bytes(pa.array(texts))
    begin, end, _ = common.word_spans(data, starts)
    monkeypatch.setattr(common, "SEGMENT", segment)
    found = {}
    for h, b, e in zip(common.word_hashes(data, begin, end).tolist(), begin, end):
        found.setdefault(bytes(data[b:e]), set()).add(h)
    assert all(len(h) == 1 for h in found.values()) and len({min(h) for h in found.values()}) == len(found)
    monkeypatch.undo()
    whole = common.word_hashes(data, begin, end).tolist()
    assert whole == [min(found[bytes(data[b:e])]) for b, e in zip(begin, end)]


def test_settings_come_back(spark):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    with pytest.raises(KeyError), common.stepwise(spark, 7):
        assert spark.conf.get(setting) == "7"
        raise KeyError
    assert spark.conf.get(setting) == before


def test_a_shared_folder_is_demanded_on_clusters(monkeypatch):
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError):
        common.checkpoint_folder(Session)
