"""Each corpus operator against a brute-force version or the library, with nulls, blanks, ties, repeats and clashing columns."""

import hashlib
import re
import sys
import time
import unicodedata
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, html, jaccard, language, lines, pii, quality, queries, tokens, warc
from plumbline.llm.common import Tables, connected_components, new_path, shared_dir

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog again and again today"),
    (2, "the quick brown fox jumps over the lazy dog again and again today"),
    (3, None),
    (4, ""),
    (5, "  \n \t "),
    (6, "a"),
    (7, "x" * 5000 + " " + "ab" * 700 + " <|endoftext|> don't  I'LL\n\n12 345"),
    (8, "é中😀 ünïcode wörds ... and more!!! words,"),
    (2, "the quick brown fox jumps over the lazy dog again and again today"),
    (None, "no id here but words enough to be a text"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, "en" if i != 8 else None, "s", "clash", 1) for i, t in TEXTS], "doc_id long, text string, lang string, source string, ids string, n_tokens int")
    return df.repartition(3).persist()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.TOKENIZER)


def test_bpe_is_the_library(docs, empty):
    t = tokenizer()
    want = sorted(
        (str(i), len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(e, skip_special_tokens=False).encode()).hexdigest())
        for i, e in ((i, t.encode(x or "", add_special_tokens=False).ids) for i, x in TEXTS)
    )
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, queries.TOKENIZER).collect())
    assert got == want
    assert bpe.round_trip(empty, queries.TOKENIZER).count() == 0
    assert set(bpe.encode_documents(docs, queries.TOKENIZER).columns) == set(docs.columns)


def test_new_units_cost_few_calls():
    """Units that were not seen before are cut from the library's ids, and listed by Arrow, without several calls for each."""
    encoder, calls = tokens.LibraryEncoder(queries.TOKENIZER), Counter()
    texts = [" ".join(f"wo{k:05d}rd{k % 7}é." for k in range(at, at + 500)) for at in range(0, 8000, 500)]
    encoder.batch(["one"])
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        ids, size = encoder.batch(texts)
    finally:
        sys.setprofile(None)
    each = [x.ids for x in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert [len(x) for x in each] == size.tolist() and [i for x in each for i in x] == ids.tolist()
    assert calls["call"] + calls["c_call"] < 6 * 8000, calls


def test_segment_tree_equals_plain_merging():
    v = bpe.vocabulary(queries.TOKENIZER)

    def plain(word):
        ids = [v.letter[b] for b in word]
        while True:
            best = min(((v.rank.get(a << 32 | b, bpe.NONE), k) for k, (a, b) in enumerate(zip(ids, ids[1:], strict=False))), default=(bpe.NONE, 0))
            if best[0] == bpe.NONE:
                return ids
            ids[best[1] : best[1] + 2] = [v.merged[best[0]]]

    rng = np.random.default_rng(1)
    some = [bytes(rng.choice(list(b" aeiounrstlth"), rng.integers(1, 90)).tolist()) for _ in range(300)] + [b"a", b"aa", b"the" * 30, bytes(range(256))]
    want = [plain(w) for w in some]
    assert [bpe.merge_word(w, v) for w in some] == want
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.merge_many(some, v)] == want


def test_token_files(spark, docs, empty):
    path = new_path(spark, "t")
    tokens.write_token_files(docs, path, tokens.TokenFileParams(queries.TOKENIZER))
    t = tokenizer()
    got = tokens.positions(spark, path).orderBy("start").collect()
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in TEXTS}
    start = 0
    assert [r.doc_id for r in got] == sorted((i for i, _ in TEXTS), key=lambda i: -1 if i is None else i)
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[r.doc_id]), zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes()))
        start += r.n_tokens
    plan = tokens.read_token_files(spark, path).where("doc_id = 7")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in plan
    path = new_path(spark, "t")
    tokens.write_token_files(empty, path, tokens.TokenFileParams(queries.TOKENIZER))
    assert tokens.positions(spark, path).count() == 0


def test_repeated_ids_stand_in_file_order_and_filters_skip_stripes(spark):
    t = tokenizer()
    texts = ["one two three four five six", "a", "b c d e f g h i j", "k"]
    df = spark.createDataFrame([(2, x) for x in texts] + [(k, f"text {k} of many") for k in range(3, 4000)], "doc_id long, text string").repartition(3)
    path = new_path(spark, "t")
    tokens.write_token_files(df.where("doc_id < 5"), path, tokens.TokenFileParams(queries.TOKENIZER))
    files = tokens.read_token_files(spark, path)
    shards = sorted({r.shard for r in files.select("shard").collect()})
    rows = [r for s in shards for r in files.where(F.col("shard") == s).collect()]  # as they lie in the files
    place, want = 0, set()
    for r in rows:
        want.add((r.doc_id, place, r.n_tokens, zlib.crc32(np.array(r.ids, "<u4").tobytes())))
        place += r.n_tokens
    assert {tuple(r) for r in tokens.positions(spark, path).collect()} == want
    assert sorted(r.n_tokens for r in rows if r.doc_id == 2) == sorted(len(t.encode(x).ids) + 1 for x in texts)
    path = new_path(spark, "t")
    tokens.write_token_files(df.where("doc_id > 2").coalesce(1), path, tokens.TokenFileParams(queries.TOKENIZER, index_rows=1000))

    def read(condition: str) -> int:
        found = tokens.read_token_files(spark, path).where(condition)
        found.collect()
        leaf = found._jdf.queryExecution().executedPlan().collectLeaves().head()
        return leaf.metrics().apply("numOutputRows").value()

    assert read("doc_id >= 3") == 3997 and read("doc_id = 3500") <= 1000 and read("doc_id = -5") == 0


def test_html_extraction(spark):
    page = (
        '<html><head><title>T</title><script>var a="</p>"</script></head><body><header><h1>Site</h1></header><div id="cookie-notice">We use cookies for many good reasons</div>'
        '<div class="content"><h2>Real title</h2><p>First &amp; real   para with <a href=x>link</a> text.<p>Second, with&nbsp;more text here.<ul><li>point one<li>point two</ul>'
        '<div class="ad">Buy now</div><p>Third one after the advert.</p><form><label>Name</label></form></div><aside>Other stuff</aside><section id="comments"><p>I think this is a great comment.</p></section><footer>c</footer>'
    )
    marked = "<nav><a>menu</a></nav><article><h1>Head</h1><p>Some words of text &lt;here&gt;.</p></article><footer>&copy;</footer>"
    df = spark.createDataFrame([(1, "u", page), (2, "u", marked), (3, None, None), (4, "u", ""), (None, "u", "just words <b>and</b> more"), (2, "u", marked), (6, "u", "<div <p unclosed 'x")], "page_id long, url string, html string")
    got = {(r.page_id): r for r in html.extract(df).collect()}
    assert got[1].text == "Real title\nFirst & real para with link text.\nSecond, with more text here.\npoint one\npoint two\nThird one after the advert."
    assert got[2].text == "Head\nSome words of text <here>." and got[2].n_chars == len(got[2].text)
    assert got[3].text == got[4].text == "" and got[None].text == "just words and more"
    assert html.extract(df).count() == 7 and html.extract(df.where("false")).count() == 0


def test_html_attributes_and_deep_pages():
    """Names inside values, words of a subject, and visible elements are no reason to leave text out; a page of a megabyte costs linear time."""
    keep = ('<p aria-hidden="false">x</p>', '<p data-title="hidden gems">x</p>', '<div><a href="/style/hidden-gems">x</a> more words</div>', '<div class="entry-header"><h2>x</h2></div>', '<p class="lead search-engine">x</p>', "<p title='class=ad'>x</p>", "<p CLASS=story>x</p>")
    drop = ("<p hidden>x</p>", '<p aria-hidden="true">x</p>', "<div style='color:red; display : none'>x</div>", '<div class="site-header">x</div>', '<div id=sidebar-left>x</div>', '<div class="comment-list"><p>x</p></div>', "<div class=ad>x</div>", "<div role='contentinfo'>x</div>")
    for elements, said in ((keep, True), (drop, False)):
        for e in elements:
            text = html.main_text(f"<article><p>First words of the text.</p>{e}<p>Last words of the text.</p></article>", html.DEFAULT_WEIGHTS)
            assert text.startswith("First words of the text.\n") and text.endswith("\nLast words of the text.") and ("x" in text.replace("text", "")) == said, e
    n = 60_000
    deep = "<article>" + "<b><i>x " * n + "</u>" * n + "<td>" * 1000 + "</article>"
    assert len(deep) > 600_000 and html.main_text(deep, html.DEFAULT_WEIGHTS) == " ".join("x" * n)


LEARNED = {f: {"word paragraph": 3.0, "word heading": 3.0, "word link": -2.0, "tag": -0.5, "tag body": -0.5, "tag p": -0.05}.get(f, w) for f, w in (html.DEFAULT_WEIGHTS | {"tag body": -0.5, "tag p": -0.05}).items()}


@pytest.mark.parametrize("weights", [html.DEFAULT_WEIGHTS, LEARNED])
def test_articles_stay_whole(weights):
    """Lists, lines in div elements, links, inline marks, tables and what follows them stay; so do blocks whose class names a subject."""
    some = "<p>" + " ".join(f"word{k}" for k in range(25)) + "</p>"
    last = "<p>" + " ".join(f"end{k}" for k in range(12)) + "</p>"
    advert = '<div class="ad"><p>Buy</p></div>'
    bodies = (
        "<h1>Title here</h1>" + some * 3 + "<ul>" + "".join(f"<li>item number {k}</li>" for k in range(10)) + "</ul>" + last,
        "<h1>Title here</h1>" + "".join(f"<div>line number {k} of text</div>" for k in range(12)),
        "<h1>Two words</h1><p>See <a>one</a>, <a>two</a>, <a>three</a> and <a>four</a>.</p>",
        "<p>" + " ".join(f"<span><i>w{k}</i></span>" for k in range(12)) + "</p>",
        '<div class="post-related-work"><h2>Related work</h2>' + some + "</div>",
        some + '<div class="menu-item"><p>Soup of the day with bread</p></div>' + some,
        some + "<table>" + "".join(f"<tr><td>a{k}</td><td>b{k}</td></tr>" for k in range(20)) + "</table>" + last,
        some + "<dl>" + "".join(f"<dt>t{k}</dt><dd>d{k}</dd>" for k in range(20)) + "</dl>" + last,
        some + advert * 3 + last,
    )
    around = "<html><body><nav><ul><li><a href=/>Home</a><li><a>About us</a></ul></nav><header><h1>Site</h1></header>%s<footer>(c) site</footer></body></html>"
    for body in bodies:
        want = re.findall(r"[^<>\s]+(?![^<]*>)", body.replace(advert, ""))
        for within in ("<article>%s</article>", "<main>%s</main>", '<div class="content">%s</div>', "%s"):
            assert "".join(html.main_text(around % within % body, weights).split()) == "".join(want), (body[:60], within)
    for body in (some + "<td></td>" * 500 + last, some + advert * 200 + last):
        assert html.main_text(f"<article>{body}</article>", weights).count("\n") == 1
    page = "<article>" + (some + "<ul><li>an item</ul>") * 5500 + last + "</article>"
    assert len(page) > 1_000_000 and html.main_text(page, weights).count("\n") == 11000


def test_weights_of_tags_that_articles_hardly_use():
    """An element of the surroundings alone costs as much as most tags; no tag costs more than its bound."""
    seen = {("word paragraph", True): 9000, ("word item", False): 900, ("tag p", True): 400, ("tag li", False): 5000, ("tag div", True): 3, ("tag div", False): 4000, ("word outside", False): 50}
    got = html.learned(seen, html.HtmlParams())
    assert got["tag li"] == got["tag"] and got["word paragraph"] >= 0.5 and got["word outside"] == -0.5
    assert all(-0.5 <= w <= -0.05 for f, w in got.items() if f.startswith("tag"))
    assert html.learned({}, html.HtmlParams()) == html.DEFAULT_WEIGHTS


def test_pages_with_ties_and_clashing_columns(spark):
    page = "<article><p>Some words of text.</p></article>"
    df = spark.createDataFrame([(1, "u", page, "x", 1), (1, "v", page, "y", 2), (2, "u", page, None, None)], "page_id long, url string, html string, text string, n_chars int")
    got = html.extract(df).collect()
    assert sorted((r.page_id, r.url) for r in got) == [(1, "u"), (1, "v"), (2, "u")] and {(r.text, r.n_chars) for r in got} == {("Some words of text.", 19)}


def test_region_is_the_best_sum():
    rng = np.random.default_rng(2)
    for _ in range(50):
        x = rng.integers(-5, 6, 12).tolist()
        a, b = html.region(x)
        assert sum(x[a:b]) == max(0, max(sum(x[i:j]) for i in range(12) for j in range(i, 13)))


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0
            ok = {"email": True, "ip": all(int(x) < 256 for x in m.group().split(".")) if kind == "ip" else False, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), n, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, n, b, k in sorted(out))


def test_personal_data_base_spans(spark, docs):
    rng = np.random.default_rng(3)
    odd = ["".join(rng.choice(list("a1.@+-_ ()4é😀:"), 60)) for _ in range(150)]
    odd += ["a@b.c_d@e.fg x@y.zz@q.rr 1.2.3.4.5.6.7.8 1.2.300.4 😀😀 +1 (555) 555-5555 4111 1111 1111 1111", "12 " * 800, "a" * 50_000, "1." * 3000 + "+ " * 300 + "a." * 9000 + "@" + "b." * 5000, None, ""]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    for i, t in enumerate(odd):
        want = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (t[:80], want, got[i].spans)
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))
    assert pii.personal_data(docs).count() == len(TEXTS) and pii.personal_data(df.where("false")).count() == 0


def test_secrets_are_added_by_the_method(spark):
    """Tokens that are assigned become spans, for their form and surroundings; long words, identifiers and names do not."""
    rng = np.random.default_rng(31)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 9))))
    token = lambda: "".join(rng.choice(list("0123456789abcdef"), 40))
    rows, want = [], {}
    for k in range(80):
        text = " ".join(word() for _ in range(20)) + " "
        if k % 2:
            want[k] = f"secret:{len(text) + 9}:{len(text) + 49}"
            text += f'token = "{token()}" ' + word()
        else:
            text += f"{word()}-{word()}-{word()}-{word()}-{word()}-{word()}-{k} {word()}_{word()}_{word()}_{word()}_{word()}_{word()}2 and more"
        rows.append((k, text))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    assert {k: r.spans for k, r in got.items() if r.n_added} == want
    assert all(r.n_spans == r.n_added and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got.values())
    terms = spark.createDataFrame([("secret", "zz"), ("email", "example"), (None, "x"), ("phone", None)], "kind string, term string")
    assert pii.terms_of(terms, pii.PiiParams())["email"] == ["example"] and pii.personal_data(df, gazetteer=terms).count() == 80
    with pytest.raises(ValueError):
        pii.terms_of(terms, pii.PiiParams(most_terms=1))


def test_expectation_maximisation_finds_planted_reliabilities(spark):
    """Three labelers of known hit and false-alarm rates over 20,000 candidates, a third of them personal data."""
    rng = np.random.default_rng(32)
    truth = rng.random(20_000) < 1 / 3
    rates = [(0.95, 0.1), (0.8, 0.2), (0.7, 0.05)]
    votes = np.stack([np.where(rng.random(len(truth)) < 0.15, -1, rng.random(len(truth)) < np.where(truth, a, b)) for a, b in rates], 1).astype(int)
    df = spark.createDataFrame([("email", tuple(v)) for v in votes.tolist()], "kind string, v struct<v1: int, v2: int, v3: int>")
    s = pii.reliabilities(df, pii.PiiParams(em_rounds=60)).first().s
    assert abs(s.prior - 1 / 3) < 0.03
    assert all(abs(s[f"a{k}"] - a) < 0.05 and abs(s[f"b{k}"] - b) < 0.05 for k, (a, b) in enumerate(rates, 1))
    p = {(r.v1, r.v2, r.v3): r.p for r in pii.posteriors(df, pii.PiiParams(em_rounds=60)).collect()}
    decided = np.array([p[tuple(v)] > 0.5 for v in votes.tolist()])
    assert (decided == truth).mean() > 0.9


def test_archives(spark):
    x = "<p>same payload " + "y" * 120
    rows = [(1, "http://A.com:80/x?b", x), (2, "http://www.a.com/x?b", x), (3, None, None), (4, "http://b.org/\r\nfoo", "short"), (5, "u", "short"), (None, "http://c.com", x), (7, "http://c.com", "WARC/1.1\r\n\r\n" + "é😀" * 60), (2, "http://www.a.com/x?b", x)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archived(df).collect()
    assert [r.page_id for r in got] == [3, 1, 2, 2, None, 7, 4, 5]
    by = {r.page_id: r for r in got}
    assert (by[2].record_type, by[2].refers_to, by[1].record_type, by[4].record_type, by[None].record_type) == ("revisit", 1, "response", "response", "response")
    for i, _, h in rows:
        assert (by[i].payload_bytes, by[i].payload_digest) == (len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest())
    assert warc.archived(df.where("false")).count() == 0


def test_captures_of_any_id_and_ranges_of_bounded_size(spark):
    big = [(10**12 + k, f"http://h{k % 7}.org/{k % 5}", f"<p>payload {k % 11} " + "z" * 120) for k in range(120)] + [(9223372036854775807, "http://a.org", "end"), (-5, "http://a.org", "minus"), (None, "http://a.org", "none")] * 2
    df = spark.createDataFrame(big, "page_id long, url string, html string").repartition(4)
    got = warc.archived(df, warc.WarcParams(archive_bytes=4000, range_rows=20)).collect()
    keys = [((r.url_key or ""), r.captured, r.page_id is not None, r.page_id or 0) for r in got]
    assert keys == sorted(keys) and len(got) == len(big)
    assert {r.page_id: r.refers_to for r in got if r.page_id and r.page_id > 10**11 and r.page_id < 10**13} == {10**12 + k: 10**12 + k % 11 if k >= 11 else None for k in range(120)}


def test_runs_read_in_parts_are_cut_where_they_descend():
    rng = np.random.default_rng(41)
    rows = [x for _ in range(6) for x in sorted(rng.integers(0, 50, 9).tolist())]
    pieces = warc.natural_runs(rows, lambda x: x)
    assert [x for p in pieces for x in p] == rows and all(p == sorted(p) for p in pieces) and list(warc.LoserTree(pieces, lambda x: x)) == sorted(rows)


def test_loser_tree():
    rng = np.random.default_rng(4)
    for k in range(0, 9):
        runs = [sorted(rng.integers(0, 9, rng.integers(0, 8)).tolist()) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_language(spark, docs, empty):
    words = {"en": "the and of with thing there", "de": "der und nicht mit sich ein", "fr": "le et avec pour dans une"}
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(rng.choice(words[lang].split(), 30)), lang) for k, lang in enumerate(list(words) * 40)]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 !?", "de"), (902, "", None), (903, "the thing", None)], "doc_id long, text string, lang string").withColumn("held_out", language.held_out())
    assert {r.doc_id: r.held_out for r in df.collect()} == {r: zlib.crc32(str(r).encode()) % 4 == 2 for r in [*range(120), 900, 901, 902, 903]}
    gothic = "\U00010330\U00010331\U00010332 " * 9
    model = language.train(df.where("not held_out").unionByName(spark.createDataFrame([(904, gothic, "got", False)], df.schema)))
    df = df.unionByName(spark.createDataFrame([(905, gothic[:11], None, False)], df.schema))
    got = {r.doc_id: r for r in language.identify(df, model, keep=("held_out",)).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang in rows) and got[903].lang_pred == "en" and got[905].lang_pred == "got"
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (900, 901, 902)) and all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(docs, language.train(empty)).select("lang_pred").distinct().collect()[0][0] == "und"


def test_long_texts_are_counted_in_parts():
    """What is counted part by part is what is counted at once; 20 MB take no more memory than the parts do."""
    whole = language.LanguageParams()
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdé  ,\n1ΣİßЖ中😀  "))
    for k in range(60):
        text = "".join(rng.choice(letters, rng.integers(0, 400)))
        want = np.bincount(language.grams([text.lower()], whole)[0], minlength=whole.buckets)
        got = np.zeros(whole.buckets)
        for bucket, owner, sign in language.counted([text], language.LanguageParams(most_chars=int(rng.integers(1, 40)))):
            assert (owner == 0).all()
            got += np.bincount(bucket, sign, whole.buckets)
        assert (got == want).all(), k
    import tracemalloc

    long = "some words and more " * 1_000_000
    tracemalloc.start()
    total = sum(int(sign.sum()) for _, _, sign in language.counted([long], whole))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 3 * len(long) - 4_000_000 - 3 and peak < 300e6, (total, peak)


def test_archives_are_bounded_by_bytes(spark):
    """A few very long pages among short ones make no archive much longer than asked."""
    df = spark.createDataFrame([(k, f"http://x/{k}", "y" * (400_000 if k % 50 == 0 else 30) + str(k)) for k in range(400)], "page_id long, url string, html string").coalesce(1)
    path = new_path(spark, "t")
    warc.write_archives(df, path, warc.WarcParams(archive_bytes=1 << 20))
    sizes = [r[0] for r in spark.read.format("binaryFile").load(path).select("length").collect()]
    assert max(sizes) <= 4 << 20 and len(sizes) > 4
    assert warc.merged_index(warc.sorted_runs(spark, path)).count() == 400


def test_held_out_languages_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", language.held_out())
    told = language.identify(docs.where("held_out"), language.train(docs.where("not held_out")), keep=("lang",)).where("lang is not null and lang_pred <> 'und'")
    right = told.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("x"), F.count("*").alias("n")).first()
    assert right.n > 150 and right.x > 0.98


def plain_distance(p, q):
    p, q = ([x / sum(v) for x in v] for v in (p, q))
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    d = sum(a * np.log2(a / c) for a, c in zip(p, m, strict=True) if a) + sum(b * np.log2(b / c) for b, c in zip(q, m, strict=True) if b)
    return (d / 2) ** 0.5


def test_quality_verdicts_against_plain_counting(spark):
    """Every language has its reference, broadcast or joined; distances and verdicts equal a plain computation."""
    rng = np.random.default_rng(51)
    words = {"en": "the of and a to in that it was for longerword otherlong", "zz": "zu zi za zo ze lang-es-wort zzz zy", "ja": "これはです ものです そして 日本語の文章"}
    rows = []
    for k in range(90):
        lang = list(words)[k % 3]
        w = rng.choice(words[lang].split(), 80).tolist() if k % 10 else ["#|&"] * 40 + [f"x{j}" for j in range(60)]
        rows.append((k, " ".join(w), lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kind = {"L": 2, "M": 2, "N": 3, "P": 5, "S": 6, "Z": 4}

    def classes(text):
        out = [0] * 8
        for c in text:
            x = unicodedata.category(c)
            out[4 if c in " \t\n" else 6 if c in quality.SYMBOLS else 0 if x == "Ll" else 1 if x in ("Lu", "Lt") else kind.get(x[0], 7)] += 1
        return out

    def common(text):
        return Counter(x for x in (w.strip(".,;:!?\"'()").lower() for w in text.split()) if 0 < len(x) <= 5 and x.isalpha())

    ref = {}
    for lang in words:
        own = [t for _, t, x in rows if x == lang]
        counts = sum((common(t) for t in own), Counter())
        top = sorted(counts, key=lambda w: (-counts[w], w))[:48]
        ref[lang] = np.sum([classes(t) for t in own], 0), top, [counts[w] for w in top] + [sum(len(t.split()) for t in own) - sum(counts[w] for w in top)]
    for broadcast in (64, 1):
        got = {r.doc_id: r for r in quality.quality_rules(df, quality.QualityParams(broadcast_languages=broadcast)).collect()}
        assert len(got) == 90
        for k, text, lang in rows:
            c, n = common(text), len(text.split())
            hist = [c[w] for w in ref[lang][1]]
            d_class, d_word = plain_distance(classes(text), ref[lang][0]), plain_distance([*hist, n - sum(hist)], ref[lang][2])
            assert abs(got[k].class_distance - d_class) < 1e-9 and abs(got[k].word_distance - d_word) < 1e-9
            fits = d_class <= 0.17 + 0.6 / n**0.5 and d_word <= 0.29 + 1.2 / n**0.5
            assert got[k].kept == (fits and not got[k].base_failed)
    assert {r.doc_id for r in quality.keep_good(df, quality.QualityParams(broadcast_languages=1)).collect()} == {k for k in got if got[k].kept}
    assert any(got[k].kept for k in got) and not any(got[k].kept for k in range(0, 90, 10))


def test_quality_counts(spark, docs, empty):
    def brute(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        hit = {j for k, x in enumerate(tri) if tri.count(x) > 1 for j in (k, k + 1, k + 2)}
        rows = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(rows) - len(set(rows)), len(hit)

    odd = ["a b c a b c", "a a a a", "a b a b a b\na b\na b\n\n", "x # y | z <", "\x1c \x85 a\xa0b", None, "w " * 200, " ".join(f"w{k}" for k in range(80))]
    df = spark.createDataFrame([(k, t, None) for k, t in enumerate(odd)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    for k, t in enumerate(odd):
        n = brute(t)
        assert (got[k].n_words, got[k].word_chars, got[k].n_symbols, got[k].n_dup_lines, got[k].n_repeat_words) == n, t
        assert got[k].base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (got[k].base_failed and got[k].kept)
    assert quality.quality_rules(docs).count() == len(TEXTS) and quality.quality_rules(empty).count() == 0
    assert quality.keep_good(docs).columns == docs.columns


def near(text, rng, edits):
    w = text.split()
    for k in rng.choice(len(w), edits, replace=False):
        w[k] = f"edit{rng.integers(1e6)}"
    return " ".join(w)


def shingle_groups(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_jaccard_groups_are_exact(spark, docs, empty, words, percent):
    rng = np.random.default_rng(words)
    rows = []
    for f in range(12):
        text = " ".join(f"w{rng.integers(500)}" for _ in range(int(rng.integers(3, 160))))
        rows += [text, text.upper()] + [near(text, rng, min(len(text.split()), int(rng.integers(0, 6)))) for _ in range(12)]
    rows = list(enumerate([*rows, None, "", " \n", "one", "ONE", "two words", "two  words"]))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), jaccard.JaccardParams(words=words, percent=percent, block=8)).collect()}
    assert got == shingle_groups(rows, words, percent)
    odd = jaccard.jaccard_groups(docs).collect()
    assert len(odd) == len(TEXTS) and {r.doc_id: r.component_id for r in odd}[2] == 1 and {r.doc_id: r.component_id for r in odd}[None] is None
    assert jaccard.jaccard_groups(empty).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_tile(percent):
    """All sizes, at the edge of the threshold; unlike sets hardly ever share one, though many have empty parts."""
    rng = np.random.default_rng(percent)
    starts = jaccard.bands(percent, 3000)
    met = 0
    for _ in range(1500):
        n = int(np.exp(rng.uniform(0, 7)))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        out, new = (int(x) for x in rng.integers(0, n // 4 + 1, 2))
        b = np.unique(np.concatenate([a[out:], rng.integers(0, 1 << 63, new).astype(np.uint64)]))
        if len(b) and jaccard.linked(a, b, percent):
            met += 1
            assert set(jaccard.tile_keys(a, starts, percent).tolist()) & set(jaccard.tile_keys(b, starts, percent).tolist()), (len(a), len(b))
    assert met > 300
    many = [set(jaccard.tile_keys(np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64)), starts, percent).tolist()) for _ in range(200)]
    assert sum(bool(x & y) for k, x in enumerate(many) for y in many[:k]) < 0.001 * 200 * 199 / 2


def test_jaccard_blocks_give_no_more_rows_than_they_search(spark, monkeypatch):
    """A tile of near copies, nearly all pairs of which the bitmaps allow: 16 places of a text have a word of their own, few rows of a place are linked with others."""
    params, base = jaccard.JaccardParams(words=3, percent=90, block=64), [f"w{k}" for k in range(100)]
    texts = [" ".join([*base[: at - 1], *([f"y{at}"] if k else base[at - 1 : at]), f"x{at}-{k}", *base[at + 1 :]]) for at in range(3, 99, 6) for k in range(16)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    source = jaccard.source_rows(df, "doc_id").persist()
    sets = [jaccard.shingles(x, 3) for x in texts]
    node = [jaccard.node_of(x) for x in sets]
    hashes = {r.id: r.text_hash for r in source.collect()}
    nodes = spark.createDataFrame([(n, (k, hashes[k])) for k, n in enumerate(node)], "node long, head struct<id long, text_hash long>")
    bits = spark.createDataFrame([(n, len(x), jaccard.bitmap(x, params.bitmap_bits).tobytes()) for n, x in zip(node, sets, strict=True)], "node long, n long, bits binary")
    tiles, found = spark.createDataFrame([(1, n) for n in node], "key long, node long"), spark.createDataFrame([], "id long, component long")
    want = shingle_groups(list(enumerate(texts)), 3, 90)
    with Tables(spark) as t:
        near = t.stored(jaccard.unresolved(tiles, found, bits, params, t), "near")
        assert near.count() <= 2 * 4 * len(texts) and near.select("node").distinct().count() == len(texts)
        for most in (jaccard.GROUP_SHINGLES, 4000):
            monkeypatch.setattr(jaccard, "GROUP_SHINGLES", most)
            links = t.stored(jaccard.joining(near, nodes, source, params), "links")
            assert links.count() < near.count()
            at = {n: k for k, n in enumerate(node)}
            assert all(jaccard.linked(sets[at[r.a]], sets[at[r.b]], 90) for r in links.collect())
            got = {r.id: r.component for r in connected_components(links).collect()}
            groups = [[k for k, n in enumerate(node) if got.get(n, n) == c] for c in {got.get(n, n) for n in node}]
            assert sorted(groups) == sorted([k for k in want if want[k][1] == c] for c in {x[1] for x in want.values()}) and len(groups) > 10
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(df, params).collect()} == want


def test_jaccard_ids_with_two_texts_and_without_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(7, a), (7, b), (7, b), (3, b), (9, c), (None, a), (None, c), (None, "one " * 9 + "two"), (11, a + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard.jaccard_groups(df).collect())
    assert got == [(0, 0), (0, 7), (0, 9), (3, 3), (7, 3), (7, 3), (7, 7), (9, 9), (11, 7)]
    left = sorted((r.doc_id or 0, r.text[:3]) for r in jaccard.keep_one(df.withColumn("keys", F.lit(1)).withColumn("id", F.lit("clash"))).collect())
    assert left == [(0, "one"), (3, "b0 "), (7, "a0 "), (9, "c0 ")]


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}


def line_signature(words):
    words = list(dict.fromkeys(words))
    sums = [sum(xxhash.xxh64_intdigest(w.encode(), 42) >> j & 1 for w in words) for j in range(64)]
    return sum(1 << j for j, s in enumerate(sums) if s > len(words) // 2)


def test_simhash_of_lines(spark):
    texts = ["a b c d e", "one", " ".join(f"w{k % 200}" for k in range(300)), "é ü ñ ö ß ø å"]
    got = lines.signatures(spark.createDataFrame(list(enumerate(texts)), "h1 long, line string")).collect()
    assert {r.h1: r.simhash % (1 << 64) for r in got} == {k: line_signature(t.split()) for k, t in enumerate(texts)}


def test_simhash_blocks_meet_by_the_pigeonhole_principle(spark):
    """Lines with fewer differing bits than a bucket has blocks share a part of it, if it is dealt by all blocks."""
    rng = np.random.default_rng(21)
    base = [" ".join(f"w{rng.integers(1 << 20)}" for _ in range(80)) for _ in range(6)]
    texts = {10 * k + j: near(t, rng, j) for k, t in enumerate(base) for j in range(3)}
    sign = {k: line_signature(t.split()) for k, t in texts.items()}
    df = spark.createDataFrame([(7, k, x - (1 << 64) if x >> 63 else x) for k, x in sign.items()], "key long, h1 long, simhash long")
    parts = {r.h1: set(r.parts) for r in df.select("h1", F.expr(lines.block_key(lines.LineParams(dealt_blocks=6))).alias("parts")).collect()}
    want = {(a, b) for a in texts for b in texts if a < b and (sign[a] ^ sign[b]).bit_count() < 6}
    assert len(want) > 5 and all(parts[a] & parts[b] for a, b in want) and all(len(p) == 6 for p in parts.values())


def test_lines_keep_one_occurrence(spark, docs, empty):
    long = " ".join(f"word{k}" for k in range(60))
    near_long = long.replace("word30", "wort30")
    rows = [(3, f"{long}\nown line of the third document here"), (1, f"Head\n\n{long.upper()}\nHead\nlast words here"), (2, f"{near_long}\nHead"), (4, None), (5, ""), (6, "short\nshort"), (7, "Head")]
    got = {r.doc_id: r for r in lines.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))).collect()}
    assert got[1].text == f"Head\n\n{long.upper()}\nlast words here" and (got[1].n_lines, got[1].n_dropped) == (4, 1)
    assert got[3].text == "own line of the third document here" and got[6].text == "short"
    assert got[2].text == "" and (got[2].n_lines, got[2].n_dropped) == (2, 2)
    assert got[4].text is None and got[5].text == "" and got[7].text == "" and got[7].n_left == 0
    kept = {r.doc_id for r in lines.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 7 not in kept and {1, 3, 4, 5, 6} <= kept
    assert lines.without_repeated_lines(docs).count() == len(TEXTS) and lines.without_repeated_lines(empty).count() == 0


def edit_similarity(a, b):
    row = np.arange(len(b) + 1)
    other = np.array([ord(x) for x in b])
    for k, x in enumerate(a, 1):
        least = np.minimum(row[:-1] + (other != ord(x)), row[1:] + 1)
        least = np.concatenate([[k], least]) - np.arange(len(b) + 1)
        row = np.minimum.accumulate(least) + np.arange(len(b) + 1)
    return 1 - row[-1] / max(len(a), len(b))


def edited_lines(rng):
    """(line, edited line) of all lengths: whole words replaced, or single characters."""
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(2, 10))))
    for words in (2, 3, 4, 8, 10, 15, 20, 40, 80, 150):
        for k in range(12):
            w = [word() for _ in range(words)]
            other = list(w)
            if k % 3 or words == 2:
                for at in rng.choice(words, max(1, words * (k + 4) // 100), replace=False):
                    x = list(other[at])
                    x[int(rng.integers(len(x)))] = "z"
                    other[at] = "".join(x)
            else:
                for at in rng.choice(words, max(1, words * (k + 8) // 100), replace=False):
                    other[at] = "z" * len(other[at])
            yield " ".join(w), " ".join(other)


def test_fuzzy_lines_reach_the_similarity(spark):
    pairs = list(edited_lines(np.random.default_rng(11)))
    rows = [(2 * k + side, line) for k, pair in enumerate(pairs) for side, line in enumerate(pair)]
    got = {r.doc_id for r in lines.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.n_dropped}
    want = {2 * k + 1 for k, (a, b) in enumerate(pairs) if edit_similarity(a, b) >= 0.8}
    assert len(want) > 90 and any(len(pairs[k // 2][0].split()) < 5 for k in want)
    assert got <= want and len(got) >= 0.97 * len(want)


def brute_line_groups(texts):
    """Smallest-first groups of distinct lines of edit similarity 0.8 or more; letter counts rule most pairs out first."""
    letters = sorted({c for t in texts for c in t})
    counts = np.array([[t.count(c) for c in letters] for t in texts])
    size = np.array([len(t) for t in texts])
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k in range(len(texts)):
        longer = np.maximum(size, size[k])
        least = (np.abs(counts - counts[k]).sum(1) + np.abs(size - size[k])) / 2  # no edit distance is smaller
        for j in np.flatnonzero((least <= 0.2 * longer) & (np.arange(len(texts)) > k)).tolist():
            if root(j) != root(k) and edit_similarity(texts[k], texts[j]) >= 0.8:
                parent[root(j)] = root(k)
    return [root(k) for k in range(len(texts))]


def test_line_groups_against_brute_force_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = lines.line_places(docs).select("h1", "line").distinct().orderBy("h1").collect()
    texts = [r.line for r in rows]
    want = brute_line_groups(texts)
    placed = lines.with_keys(lines.line_places(docs), lines.LineParams()).persist()
    distinct = placed.groupBy("h1", "h2", "size").agg(F.min(F.struct("doc", "place", "text_hash")).alias("first"), F.count("*").alias("many"))
    found = {r.id: r.component for r in lines.groups(placed, docs, distinct, lines.LineParams()).collect()}
    got = [found.get(r.h1, r.h1) for r in rows]
    members = lambda groups: {(a, b) for x in {g: [k for k, y in enumerate(groups) if y == g] for g in groups}.values() for a in x for b in x if a < b}
    wanted, had = members(want), members(got)
    assert had <= wanted and len(had) >= 0.95 * len(wanted) and len(wanted) > 20


def test_links_in_a_bucket_that_its_lead_does_not_have(spark):
    """A hundred pairs of alike lines that all share one phrase with a more frequent line: they meet in its bucket only, whatever their SimHashes' blocks."""
    rng = np.random.default_rng(31)
    lead, rows = (7, 9, 40, 0), []
    for k in range(200):
        base = int(rng.integers(1 << 62))
        bits = rng.choice(62, 12, replace=False).tolist()
        rows += [(1, (1, 4 * k, 200, base, 4 * k)), (1, (1, 4 * k + 2, 200, base ^ sum(1 << int(b) for b in bits), 4 * k + 2))]
    rows += [(1, (*lead, 9)), (1, (5, 11, 40, 0, 9))] + [(2, row) for _, row in rows[:2]] + [(3, row) for _, row in rows[:2]] + [(3, (5, 11, 40, 0, 9))]
    placed = spark.createDataFrame(rows, "key long, line struct<many long, h1 long, size int, simhash long, component long>")
    params = lines.LineParams(block=64)
    with Tables(spark) as t:
        got = [(r.a, r.b) for r in lines.across(placed, params, t).collect()]
    alone = {line[1]: line for _, line in rows}.values()
    want = {(x[1], y[1]) for x in alone for y in alone if x[1] < y[1] and x[4] != y[4] and x[2] == y[2] and (x[2] <= 60 or (x[3] ^ y[3]).bit_count() <= 20)}
    assert len(got) == len(set(got)) and set(got) == want and {(4 * k, 4 * k + 2) for k in range(200)} <= want


def test_a_stored_table_leaves_no_shuffle_files(spark):
    """They go when it is written, not when the driver collects garbage."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {disk.getAllFiles().apply(k).getName() for k in range(disk.getAllFiles().size())}
    before = files()
    with Tables(spark) as t:
        assert t.stored(spark.range(50_000).groupBy((F.col("id") % 9973).alias("k")).count(), "counts").count() == 9973
        for _ in range(50):
            if not (left := {x for x in files() - before if x.startswith("shuffle_")}):
                break
            time.sleep(0.1)
    assert len(left) <= 8, left  # those of the last count, of one row a task


def test_letters_rule_out_no_similar_lines_and_most_others(spark):
    """Short lines of one bucket: all similar ones stay candidates, at the edge of the similarity too; of unlike ones few do."""
    rng, params = np.random.default_rng(33), lines.LineParams()
    texts = []
    for k in range(150):
        base = "".join(rng.choice(list("etaoinsrhlducmpgbfkvwxyzüé 4"), int(rng.integers(6, 75)))).strip() or "x"
        other = list(base)
        for at in rng.choice(len(base), len(base) // 5, replace=False):
            other[at] = ("", "e", "#", other[at] + "t")[int(rng.integers(4))]
        texts += [base, "".join(other) + "e" * (k % 3 == 0)]
    rows = spark.createDataFrame([(k, t, len(t)) for k, t in enumerate(texts)], "h1 long, line string, size int")
    placed = rows.select(F.lit(1).alias("key"), F.struct(F.lit(1).alias("many"), "h1", "size", F.lit(0).cast("long").alias("simhash"), F.expr(lines.letters(params)).alias("letters"), F.col("h1").alias("component")).alias("line"))
    with Tables(spark) as t:
        got = {(r.a, r.b) for r in lines.across(placed, params, t).collect()}
    # SimHashes are all the same here, so only short lines are ruled out
    short = lambda x, y: min(len(x), len(y)) <= params.any_bits_size and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y))
    pairs = [(k, j) for j in range(len(texts)) for k in range(j) if short(texts[k], texts[j])]
    near = {(k, j) for k, j in pairs if k // 2 == j // 2 and edit_similarity(texts[k], texts[j]) >= 0.8}
    assert near <= got and len(near) > 80 and len(got & set(pairs)) < 0.3 * len(pairs)


def test_only_lines_with_a_candidate_bring_their_texts(spark):
    """Of a divided bucket only lines that may be alike to another are stored with their texts, whatever its tiles are; its links are those of all pairs."""
    texts = [x * 30 for x in "etaoinsrhlducmpg"] + ["seven quick brown foxes jump", "seven quick brown foxes jumps", "seven quiet brown foxes jumps"]
    found, kept = {}, {}
    for block in (512, 2):
        params = lines.LineParams(block=block)
        rows = spark.createDataFrame([(k, t, len(t)) for k, t in enumerate(texts)], "h1 long, line string, size int")
        line = F.struct(F.lit(1).alias("many"), "h1", "size", F.lit(0).cast("long").alias("simhash"), F.expr(lines.letters(params)).alias("letters"), F.col("h1").alias("component")).alias("line")
        placed = rows.select(line).crossJoin(spark.range(1, 3).select(F.col("id").alias("key"))).where("key = 1 OR line.h1 > 3")
        with Tables(spark) as t:
            got = sorted((r.a, r.b, r.sure) for r in lines.across(placed, params, t, rows.select("h1", "line")).collect())
            stored = [spark.read.parquet(x) for x in t.paths]
            with_text = [x for x in stored if "line" in x.columns and "text" in x.schema["line"].dataType.names]
            found[block], kept[block] = got, sorted((r.key, r.h1) for x in with_text for r in x.select("key", "line.h1").collect())
    n = len(texts)
    want = [(j, k, True) for k in range(n) for j in range(k) if edit_similarity(texts[j], texts[k]) >= 0.8]
    assert found[512] == found[2] == want and len(want) == 3
    assert kept[512] == kept[2] == [(key, n - k) for key in (1, 2) for k in (3, 2, 1)]


def test_all_links_of_a_bucket_are_found(spark):
    """Families of short alike lines behind one shared beginning: in the shared bucket most are alike to no more frequent line."""
    rng = np.random.default_rng(32)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    texts = {"quay rolls"}
    for _ in range(60):
        tail = "".join(rng.choice(letters, 8))
        texts |= {f"quay {tail}", f"quay {tail[:3]}#{tail[4:6]}#{tail[7:]}", f"quay {tail[:1]}%{tail[2:]}"}
    for _ in range(12):
        word = "".join(rng.choice(letters, 5))
        texts |= {word, word[:2] + "%" + word[3:], word[1:]}
    texts = sorted(texts)
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000, "quay rolls"), (1001, "quay rolls")]
    placed = lines.with_keys(lines.line_places(spark.createDataFrame(rows, "doc_id long, text string")), lines.LineParams()).persist()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    distinct = placed.groupBy("h1", "h2", "size").agg(F.min(F.struct("doc", "place", "text_hash")).alias("first"), F.count("*").alias("many"))
    found = {r.id: r.component for r in lines.groups(placed, docs, distinct, lines.LineParams()).collect()}
    h1 = {r.line: r.h1 for r in lines.line_places(docs).select("line", "h1").distinct().collect()}
    members = lambda groups: {(a, b) for a, x in enumerate(groups) for b, y in enumerate(groups) if a < b and x == y}
    want = members(brute_line_groups(texts))
    assert members([found.get(h1[t], h1[t]) for t in texts]) == want and len(want) > 150


def test_lines_of_a_hot_template_and_repeated_rows(spark):
    """A line that half of the documents share, near copies of it by the hundred, an id with several texts."""
    base = " ".join(f"word{k}" for k in range(40))
    rows = [(k, base) for k in range(300)] + [(1000 + k, f"{base} number {k}") for k in range(150)] + [(7, f"{own}\n{base}") for own in ("first of its words", "quite another line")] + [(None, base)] * 2
    got = lines.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.lit("clash")).withColumn("key", F.lit(1)), lines.LineParams()).collect()
    assert len(got) == len(rows) and sum(r.n_left for r in got if r.doc_id is not None) == 2
    assert [r.text for r in got if r.doc_id is None] == [base, base]


def test_long_lines_are_held_by_edits(spark):
    rng = np.random.default_rng(12)
    rows = []
    for k, (words, share) in enumerate([(500, 0.15), (700, 0.15), (17_000, 0.01), (500, 0.3)]):
        w = [f"{rng.integers(1 << 20):05x}" for _ in range(words)]
        other = list(w)
        for at in rng.choice(words, int(words * share), replace=False):
            other[at] = "z" * len(other[at])
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other[: words - k % 2]))]
    got = {r.doc_id for r in lines.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.n_dropped}
    assert got == {1, 3, 5}


def test_decontamination(spark, docs, empty):
    rng = np.random.default_rng(6)
    word = lambda: "w" + str(rng.integers(3000)) if rng.random() > 0.4 else str(rng.choice(["the", "of", "and"]))
    items = [(k // 2 * 2, " ".join(word() for _ in range(20)) + ". " + " ".join(word() for _ in range(12))) for k in range(60)] + [(98, None), (99, "  ")]  # each id has two texts
    texts, want = [], set()
    for k in range(80):
        filler = [word() for _ in range(int(rng.integers(0, 900)))]
        if k % 3 == 0:
            at, item = int(rng.integers(0, len(filler) + 1)), int(rng.integers(60))
            filler[at:at] = items[item][1].split()
            want.add((k, item // 2 * 2))
        elif k % 3 == 1:
            filler += items[k % 60][1].split()[:16]  # the question without its answer
        texts.append((k, " ".join(filler)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([*texts, (500, None), (501, "")], "doc_id long, text string")
    for size in (7, 1, 20_000):
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench, decontaminate.DecontaminationParams(items_per_index=size)).collect()}
        assert got == want
    assert {r.doc_id for r in decontaminate.decontaminate(df, bench).collect()} == {k for k, _ in texts} - {k for k, _ in want} | {500, 501}
    held = spark.createDataFrame([(None, "some words " + items[3][1]), (None, "some words"), (5, items[4][1]), (5, "own words")], "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("score", F.lit(0))
    assert sorted(r.text for r in decontaminate.decontaminate(held, bench).collect()) == ["own words", "some words"]
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(docs, bench.where("false")).count() == 0


def test_passages_glued_to_marks_and_edited_answers(spark):
    rng = np.random.default_rng(13)
    word = lambda: f"w{rng.integers(3000)}"
    filler = lambda: " ".join(word() for _ in range(60))
    items = [(k, " ".join(word() for _ in range(30)) + ". " + " ".join(["Was", "an"] + [word() for _ in range(k % 10 + 1)]) + ".") for k in range(40)]
    texts = {}
    for k, t in items:
        question, answer = t.split(". ")
        w = answer.rstrip(".").split()
        w[int(rng.integers(len(w)))] = "edited"
        texts[k] = [f"**{t}***", f"{filler()} ({t})*** {filler()}", f"{filler()}\n\u201c{t}\u201d\u2014{filler()}", f"{filler()} {question}. {' '.join(w)}. {filler()}", f"{filler()} {question}. {filler()}"]
    rows = [(10 * k + j, t) for k, own in texts.items() for j, t in enumerate(own)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(10 * k + j, k) for k in texts for j in range(4)}


def test_wand_finds_what_full_scoring_finds():
    rng = np.random.default_rng(7)
    items = [(k, " ".join(f"w{x}" for x in rng.zipf(1.4, 25) % 80)) for k in range(200)]
    index = decontaminate.Index(items, decontaminate.DecontaminationParams(block=4))
    lists = {t: dict(zip(index.lists[t], index.impacts[t], strict=True)) for t in index.lists}
    for _ in range(60):
        terms = [t for t in rng.choice(len(index.terms), 30, replace=False).tolist() if t in lists]
        full = {}
        for t in terms:
            for k, x in lists[t].items():
                full[k] = full.get(k, 0.0) + x
        assert sorted(index.search(terms)) == sorted(k for k, x in full.items() if x >= 1 - 1e-9)


def test_registered_queries_name_every_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


def test_token_workers_keep_few_units():
    """What a worker keeps of op1's units and vocabulary has a bound that two of them can have beside an executor's JVM."""
    bpe.vocabulary.cache_clear()
    encoder = tokens.LibraryEncoder(queries.TOKENIZER)
    assert bpe.vocabulary.cache_info().currsize == 0
    known = encoder.units.stems
    known.make_many = lambda keys: [b""] * len(keys)
    for k in range(12):
        known.all_of({str(x) for x in range(k * 100_000, (k + 1) * 100_000)})
    assert len(known.young) + len(known.old) <= 600_000


def test_line_keys_go_before_lines_are_compared(spark, monkeypatch):
    """The stored keys are most of what line dedup stores; when lines are compared they are gone, and only texts of compared lines are read."""
    seen = []

    def similar(pairs, texts, params, *mostly):
        where = Path(shared_dir(spark).removeprefix("file://"))
        seen.append({"keys" in spark.read.parquet(str(x)).columns for x in where.iterdir() if x.name.startswith(("keyed-", "lines-"))})
        return before(pairs, texts, params, *mostly)

    before = lines.similar
    monkeypatch.setattr(lines, "similar", similar)
    rows = [(k, f"one line of many words that are the same in all of them but one, {k}") for k in range(6)]
    gone = lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(gone) == 5 and seen and all(x == {False} for x in seen)


def test_edit_distances_are_made_once_a_pair(spark):
    """The steps of a comparison are no columns, which a filter pushed below them would repeat in each other."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcde é"), rng.integers(2, 9))).replace(" ", "") or "x" for _ in range(60)]
    texts = []
    for n in (2, 6, 11, 40):
        for _ in range(12):
            x = list(rng.choice(words, n))
            texts += [" ".join(x), " ".join(x[:-1]), " ".join([*x[: n // 2], *rng.choice(words, 1 + n // 6), *x[n // 2 + n // 6 :]])]
    texts = sorted({t for t in texts if t})
    ids = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if abs(len(texts[a]) - len(texts[b])) < 30]
    table = spark.createDataFrame(list(enumerate(texts)), "h1 long, line string")
    pairs = spark.createDataFrame(ids, "a long, b long")
    both = pairs.join(table.selectExpr("h1 a", "line x"), "a").join(table.selectExpr("h1 b", "line y"), "b")
    want = {(r.a, r.b) for r in both.where("levenshtein(x, y) <= cast(greatest(length(x), length(y)) * 20 div 100 as int)").collect()}
    for mostly in (False, True):
        got = lines.similar(pairs, table, lines.LineParams(), mostly)
        assert {(r.a, r.b) for r in got.collect()} == want and len(want) > 20
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("levenshtein(") <= 3
