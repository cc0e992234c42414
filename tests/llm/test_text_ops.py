"""HTML, language ID, BPE: brute force, held-out accuracy, exact round trips."""

import hashlib
import html
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from seedgrow.llm import bpe, html_wrappers, langid

SF = "/root/testdata/sf0.01"


# -- HTML ---------------------------------------------------------------------

def article_text(page):
    """Main text of the tables' pages, read off their known template."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = (re.sub("<[^>]+>", "", x.replace("<br>", " ")) for x in re.split("</?(?:p|h1)>", inner))
    return "\n".join(t for t in (" ".join(html.unescape(x).split()) for x in parts) if t)


def test_pages_of_the_table(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = html_wrappers.op1_html(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == article_text(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


PAGE = """<html><head><title>T</title><style>p{}</style></head><body>
<header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><ul class="menu"><li><a href=/a>A</a></ul>
<div class="content"><h2>A &amp; B</h2><p>Hello <a href=x>world</a>
 now<br>next <p>two &lt;x&gt; 3 < 4<ul><li>one<li>two</ul></div>
<div class=sidebar>side</div><section id="comments"><p>first!</p></section><form>name <input></form>
<script>var a = "<p>no</p>";</script><!-- <p>gone</p> --><footer>c</footer></body></html>"""


def test_structure_without_an_article():
    assert html_wrappers.extract(PAGE, {}) == "A & B\nHello world now next\ntwo <x> 3 < 4\none\ntwo"


def test_wrapper_tells_template_from_text():
    pages = [
        f"<body><div class=x><p>Welcome to our site</p></div><div class=y><p>Story {i} of many words</p>"
        + "<p>more</p>" * (i % 3) + ("<h3>Extra</h3>" if i % 2 else "") + "</div>"
        + "<div class=z>" + "".join(f"<p><a href=/{j}>link {j}</a></p>" for j in range(i + 2)) + "</div></body>"
        for i in range(6)
    ]
    w = html_wrappers.infer(pages)
    assert w["slots"]["body>div.y>p"] and not w["slots"]["body>div.x>p"] and not w["slots"]["body>div.z>p"]
    assert html_wrappers.extract(pages[2], w) == "Story 2 of many words\nmore\nmore"


def test_wrapper_decides_on_article_and_class_slots():
    """Where the wrapper is taken away, the text changes."""
    story = "A long story, number {0}, of words that fill a paragraph of its page, told {0} times over and once more. " * 2
    teaser = [f"<div class=c><p>{story.format(i)}</p></div><article><p>Teaser {i}</p></article>" for i in range(5)]
    w = html_wrappers.infer(teaser)
    assert html_wrappers.extract(teaser[1], {}) == "Teaser 1"
    assert html_wrappers.extract(teaser[1], w) == f"{story.format(1).strip()}\nTeaser 1"
    share = [f"<article><p>{story.format(i)}</p><div class=box>Tell a friend about us</div></article>" for i in range(5)]
    assert html_wrappers.extract(share[1], {}) == f"{story.format(1).strip()}\nTell a friend about us"
    assert html_wrappers.extract(share[1], html_wrappers.infer(share)) == story.format(1).strip()
    hint = [f"<div class='page has-sidebar'><p>{story.format(i)}</p></div><footer>f</footer>" for i in range(5)]
    assert html_wrappers.extract(hint[1], {}) == ""
    assert html_wrappers.extract(hint[1], html_wrappers.infer(hint)) == story.format(1).strip()
    odd = ["<div class='a|hint'><p>x</p></div><div class=ad>buy</div>"]
    assert html_wrappers.extract(odd[0], html_wrappers.infer(odd)) == "x"


def test_wrapper_is_made_from_all_pages_and_blocks(spark):
    """Many pages, several templates, copies, long pages, near copies."""
    rows = []
    for i in range(120):
        k = i % 6  # a template each, with a notice of its own
        lines = "".join(f"<p>line {j} of {i}</p>" for j in range(3500 if i == 7 else 2))
        rows.append(f"<div class=t{'abcdef'[k]}><p>Notice of template {k}</p></div><div class=y>{lines}</div><div class=z>end</div>")
    near = [f"<h1>Only story</h1><div class=y><p>Line one of it</p></div><div class=q>Advert {i}</div>" for i in range(40)]
    data = [(i, "http://many/x", h) for i, h in enumerate(rows)] + [(900 + i, "http://near/x", h) for i, h in enumerate(near)]
    data += [(2000 + i, "http://many/x", "<div class=w><p>copied</p></div>") for i in range(30)] + [(3000, "http://many/x", None)]
    d = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"].split("\n") for r in html_wrappers.extract_pages(d).collect()}
    for i in range(120):
        assert got[i] == [f"line {j} of {i}" for j in range(3500 if i == 7 else 2)]
    assert all(got[900 + i][:2] == ["Only story", "Line one of it"] for i in range(40))
    assert got[2000] == ["copied"] and got[3000] == [""]
    scratch = html_wrappers.Scratch(spark, "test")
    wrappers = {r["host"]: json.loads(r["wrapper"]) for r in html_wrappers.host_wrappers(d, scratch).collect()}
    for host in ("many", "near"):
        want = html_wrappers.infer([h for _, u, h in data if host in u])
        assert wrappers[host] == json.loads(json.dumps(want))


def test_alignment_resolves_mismatches():
    item = lambda k, t="t": {"key": k, "verdict": "", "text": t, "rep": False, "opt": False, "n": 1, "link": 0.0, "size": 1, "pages": 1}
    w = html_wrappers.align([item("a"), item("b", "x"), item("c")], [item("a"), item("b", "y"), item("b", "z"), item("d")])
    assert [(x["key"], x["opt"], x["rep"], x["text"]) for x in w] == [
        ("a", False, False, "t"), ("b", False, True, None), ("c", True, False, "t"), ("d", True, False, "t")]


@pytest.mark.parametrize("page", ["<p", "<p>a<!-- b", "<script>x", "< <<a <b>", "<p>" * 2000 + "x", '<a href="x>y</a>', "&#0;&bogus;"])
def test_broken_markup_does_not_fail(page):
    assert isinstance(html_wrappers.extract(page, {}), str)


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "http://h/x", ""), (3, "http://h/x", "<article><p>ok"), (3, "http://h/x", "<article><p>ok"),
            (None, "nonsense", "<p>plain</p>"), (5, "http://H:80/y", "<article><p>" + "w " * 50000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((r["page_id"] or 0, r["text"][:9]) for r in html_wrappers.extract_pages(d).collect())
    assert got == [(0, "plain"), (1, ""), (2, ""), (3, "ok"), (3, "ok"), (5, "w w w w w")]
    assert html_wrappers.extract_pages(d.limit(0)).count() == 0


# -- language ID ----------------------------------------------------------------

def brute_profile(texts):
    counts = {}
    for t in texts:
        words = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        for w in words:
            w = f" {w} "
            for n in (1, 2, 3):
                for i in range(len(w) - n + 1):
                    g = w[i : i + n]
                    if n != 1 or g != " ":
                        counts[g] = counts.get(g, 0) + 1
    pack = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    return [pack(g) for g, _ in sorted(counts.items(), key=lambda x: (-x[1], pack(x[0])))][: langid.PROFILE]


def test_profiles_and_distance_match_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(~langid.held_out())
    got = langid.train(rows)
    texts = {}
    for r in rows.collect():
        texts.setdefault(r["lang"], []).append(r["text"])
    assert got == {lang: brute_profile(t) for lang, t in texts.items()}
    model = langid.RankOrder(got)
    for t in ("The story of the thing and of what was there", "über die straße zu gehen", "a"):
        mine = brute_profile([t])
        d = {lang: sum(abs(p.index(g) - i) if g in p else langid.PROFILE for i, g in enumerate(mine)) for lang, p in got.items()}
        best = min(sorted(d), key=d.get)
        lang, score = model.predict(t)
        assert lang == best and score == pytest.approx(1 - d[best] / (langid.PROFILE * len(mine)))


def test_held_out_accuracy(spark):
    d = langid.op7_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = d.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert r > 0.98
    assert d.where("score < 0 or score > 1 or lang_pred is null").count() == 0


def test_langid_odd_rows(spark):
    train = [(i, "the cat and the dog", "en") for i in range(5)] + [(9, "der hund und die katze", "de"), (8, "x", None)]
    d = spark.createDataFrame(train, "doc_id long, text string, lang string")
    odd = spark.createDataFrame(
        [(1, None), (2, ""), (3, "123 !?"), (4, "the the"), (4, "the the"), (None, "und der"), (6, "ж"), (7, "der hund " * 30000)],
        "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = sorted((r["doc_id"] or 0, r["lang_pred"], r["score"] > 0) for r in langid.predict(odd, langid.train(d)).collect())
    assert got == [(0, "de", True), (1, "und", False), (2, "und", False), (3, "und", False), (4, "en", True), (4, "en", True),
                   (6, "de", False), (7, "de", True)]
    assert langid.train(d.limit(0)) == {}
    assert {r["lang_pred"] for r in langid.predict(odd, {}).collect()} == {"und"}


# -- BPE -----------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def own():
    return bpe.load(bpe.default_path())


def same(own, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    ids = own.encode(text)
    return ids == want and own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_random_texts(own, library):
    rng = random.Random(1)
    pool = "aábB'sS Σİßﬁ́\u0085 ​\x1c\x1f日本👍🏽éxyz12½!!?<|startoftext|>"
    for _ in range(3000):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        assert same(own, library, t + "<|endoftext|>" * (rng.random() < 0.2) + t), t


@pytest.mark.parametrize("text", ["", "a" * 20000, "!" * 5000, "ab" * 9000, "é" * 3000, "thequickbrown" * 500, "don't we'll I'd"])
def test_long_words(own, library, text):
    assert same(own, library, text)


def test_cuts_are_certain(own):
    """No vocabulary token spans a cut."""
    rng = random.Random(2)
    words = list(own.vocab)
    for _ in range(500):
        w = "".join(rng.choice(words).replace("</w>", "") for _ in range(3))
        pieces = own.fragments(w)
        assert "".join(p for p, _ in pieces) == w
        for (a, _), (b, last) in zip(pieces, pieces[1:]):
            pair = a[-1] + b[0]
            if not (last and len(b) == 1):
                assert not any(pair in t.replace("</w>", "")[: -1 if t.endswith("</w>") else None] for t in rng.sample(words, 300))


def test_query_and_decode(spark, own, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in bpe.op10_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "Hi there"), (4, "x"), (4, "x")], "doc_id long, text string")
    enc = bpe.encode(odd.withColumn("ids", F.lit("clash")))
    back = sorted((r["doc_id"] or 0, r["text"]) for r in bpe.decode(enc).collect())
    assert back == [(0, own.decode(own.encode("Hi there"))), (1, ""), (2, ""), (4, "x</w>"), (4, "x</w>")]
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(odd).where("doc_id < 3").collect()} == {(empty, empty)}
    assert bpe.digests(odd.limit(0)).count() == 0


# -- HTML: classes of articles, raw elements, inline furniture, repeated headings --

@pytest.mark.parametrize("cls", ["post category-legal hentry", "has-sidebar", "post with-comments", "side-menu search"])
def test_an_article_is_not_dropped_for_its_class(cls):
    page = f'<body><nav>n</nav><article class="{cls}"><p>Main text</p></article><aside>x</aside></body>'
    assert html_wrappers.extract(page, {}) == "Main text"
    assert html_wrappers.extract(page, html_wrappers.infer([page])) == "Main text"


def test_class_words_match_whole_tokens():
    kept = '<article><section id="search-engines"><p>a</p></section><div class="side-effects">b</div>'
    gone = ('<div class="related-posts">c</div><div id="comments"><p>d</p></div><div class="ad_slot-2">e</div>'
            '<article class="comment-body"><p>f</p></article></article>')
    assert html_wrappers.extract(kept + gone, {}) == "a\nb"
    assert html_wrappers.extract('<div class="article-header"><h1>T</h1></div><p>x</p><div class="site-header">s</div>', {}) == "T\nx"


@pytest.mark.parametrize("page,want", [
    ("<p>a <svg/> b</p><p>c</p>", "a b\nc"),
    ("<p>a <svg><svg><text>x</text></svg><text>y</text></svg> b</p><p>c</p>", "a b\nc"),
    ("<p>a</p><template><template>x</template>y</template><p>b</p>", "a\nb"),
    ("<p>a</p><iframe src=x><p>b</p>", "a\nb"),
    ("<p>a</p><svg><p>b</p>", "a\nb"),
    ("<p>a <math><mi>x</mi><mo>=</mo></math> b <object data=o>seen</object></p>", "a x= b seen"),
    ("<p>a</p><script>x<p>b</p>", "a"),
    ("<p>a</p><iframe>x</iframe><p>b</p>", "a\nb"),
])
def test_raw_elements(page, want):
    assert html_wrappers.extract(page, {}) == want


def test_inline_furniture_is_left_out_of_its_block():
    page = ("<article><p>One <button>Subscribe</button>two <label>Name</label><span hidden>no</span> three"
            "<span style='display:none'>no <b>no</b></span> four</p><p>five <button>x<div>y</div></button> six</p>"
            "<p>seven <button>no</p><p>eight</p></article>")
    assert html_wrappers.extract(page, {}) == "One two three four\nfive\nsix\nseven\neight"


def test_a_heading_on_all_pages_of_a_series_stays():
    pages = [f"<article><h2 class='s'>The series</h2><p>Part {i} of many, told at some length.</p><div>Tell a friend</div></article>"
             for i in range(10)]
    w = html_wrappers.infer(pages)
    assert html_wrappers.extract(pages[3], w) == "The series\nPart 3 of many, told at some length."


def test_many_unclosed_raw_elements_take_linear_time():
    assert html_wrappers.extract("<svg><iframe><template>" * 30000 + "<p>x", {}) == "x"
