"""Language, quality, near duplicates and fingerprints against brute force and small cases."""

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sourcelode.llm import htmltext, jaccard, langid, quality, syncmers
from sourcelode.llm.components import components
from sourcelode.llm.words import shingle_sets
from tests.llm.conftest import ODD_TEXTS

LETTERS = {"xx": "aeiou", "yy": "bcdfg"}


def prose(rng, lang, n=80):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(2, 6))) for _ in range(n))


def test_language_profiles(documents):
    rng = random.Random(3)
    rows = [(i, prose(rng, lang), lang, "s") for i, lang in enumerate(["xx", "yy"] * 20)]
    profiles = langid.train(documents(rows))
    assert profiles.languages == ["xx", "yy"]
    asked = documents([(100, "AEIOU, aei!", None, None), (101, "bcd fgb", None, None), (102, "12 %%", None, None), (103, None, None, None)])
    got = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in langid.predict(asked, profiles).collect()}
    assert [got[i][0] for i in (100, 101, 102, 103)] == ["xx", "yy", "und", "und"]
    assert got[102][1] == got[103][1] == 0.0 and all(0 <= s <= 1 for _, s in got.values())


def test_language_nothing_learned_and_odd_texts(documents):
    empty = langid.train(documents([(1, None, "en", "s"), (2, "abc", None, "s")]))
    docs = documents([(i, t) for i, t in enumerate(ODD_TEXTS)]).withColumn("lang_pred", F.lit(1))
    assert {r["lang_pred"] for r in langid.predict(docs, empty).collect()} == {"und"}
    some = langid.train(documents([(1, "the cat", "en", "s")]))
    assert langid.predict(docs, some).count() == len(ODD_TEXTS)
    assert langid.predict(documents([]), some).count() == 0


def test_grams_across_chunks(monkeypatch):
    text = prose(random.Random(1), "xx", 500)
    whole = langid.grams(text)
    monkeypatch.setattr(langid, "CHUNK", 101)
    parts = langid.grams(text)
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_quality_learns_and_takes_odd_rows(documents, spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, "xx") if i % 2 else " | ".join(prose(rng, "xx", 4).split() * 9) + " ### !!") for i in range(200)]
    docs = documents(rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)] + [(161, None), (None, 1), (163, 7), (1, 1)], "doc_id long, label int")
    weights = quality.train(labels, docs, rows=1000)
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, weights).collect()}
    assert all((got[i] >= 0.3) == bool(i % 2) for i in range(160, 200))
    odd = documents([(i, t) for i, t in enumerate(ODD_TEXTS)]).withColumn("quality_score", F.lit("x"))
    scores = [r["quality_score"] for r in quality.score(odd, weights).collect()]
    assert len(scores) == len(ODD_TEXTS) and all(0 <= s <= 1 for s in scores)
    none = quality.train(labels.limit(0), docs)
    assert not none.any() and quality.score(documents([]), none).count() == 0


def brute_components(rows, words=5, percent=80):
    sets, ids = [], []
    for at, text in rows:
        own = (text or "").encode().lower().split()
        grams = {tuple(own[i : i + words]) for i in range(len(own) - words + 1)} or ({tuple(own)} if own else set())
        sets.append(grams)
        ids.append(at)
    parent = {at: at for at in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, left in enumerate(sets):
        for j in range(i):
            both = len(left & sets[j])
            if both and 100 * both >= percent * (len(left) + len(sets[j]) - both):
                a, b = root(ids[i]), root(ids[j])
                parent[max(a, b)] = min(a, b)
    return sorted((at, len(s), root(at)) for at, s in zip(ids, sets))


def edited(rng, text, n):
    own = text.split()
    for _ in range(n):
        own[rng.randrange(len(own))] = f"z{rng.randrange(10**6)}"
    return " ".join(own)


def test_near_duplicates_equal_brute_force(documents):
    rng = random.Random(7)
    passage = prose(rng, "yy", 30)
    rows = []
    for family in range(12):
        base = prose(rng, "xx", rng.randint(6, 150))
        for _ in range(rng.choice([1, 3, 12])):
            # Chains too: copies of copies, near the threshold.
            text = edited(rng, base, rng.randint(0, max(1, len(base.split()) // 40)))
            rows.append((rng.randrange(10**6), rng.choice([text, text.upper(), f" {text}\n"])))
            base = rng.choice([base, text])
    rows += [(rng.randrange(10**6), passage + " " + prose(rng, "xx", rng.randint(2, 30))) for _ in range(60)]
    rows += [(rng.randrange(10**6), text) for text in ("a b c", "A b  c", "a b", "x", None, "", "  ")]
    rng.shuffle(rows)
    got = sorted(tuple(r) for r in jaccard.near_duplicates(documents(rows).withColumn("n", F.lit("clash"))).collect())
    assert got == brute_components(rows)


def test_near_duplicates_many_near_copies_and_repeated_ids(documents):
    rng = random.Random(9)
    base = prose(rng, "xx", 200)
    rows = [(i, edited(rng, base, 3)) for i in range(10, 150)] + [(5, "u v w x y z"), (5, base), (7, "u v w x y z"), (8, "u v w x y z")]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(documents(rows)).collect()}
    assert {c for d, c in got if d in (5, 7, 8)} == {5}
    want = brute_components(rows)
    assert {(d, c) for d, _, c in want} == got
    nothing = jaccard.near_duplicates(documents([(None, base), (None, None), (3, base)])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in nothing if r["doc_id"]) == [(3, 3)]
    assert len(nothing) == 3 and jaccard.near_duplicates(documents([])).count() == 0


def test_shingles_do_not_depend_on_batches():
    texts = pa.array([t for t in ODD_TEXTS if t is None or "\x85" not in t])
    whole = shingle_sets(texts)
    for at in range(len(texts)):
        assert (whole[at] == shingle_sets(texts.slice(at, 1))[0]).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (101, 102), (7, 7)] + [(200 + i, 250) for i in range(30)]
    found = components(spark.createDataFrame(links, "left long, right long"))
    got = dict(tuple(r) for r in found.collect())
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 104)} | {i: 200 for i in [*range(200, 230), 250]}
    assert got == want
    assert components(spark.createDataFrame([], "left long, right long")).count() == 0




def test_fingerprints(documents):
    rng = random.Random(4)
    rows = [(i * 1500, prose(rng, "xx", rng.randint(1, 120))) for i in range(30)] + [(9, "same text here"), (10, "same text here")]
    rows += [(50_000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    got = {r["doc_id"]: r for r in syncmers.fingerprints(documents(rows).withColumn("anchors", F.lit(1))).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for at, (doc, text) in enumerate(order):
        text, follows = text or "", order[(at + 1) % len(order)][1] or ""
        cut = len(text) // 3
        copy = text[: len(text) - cut] + follows[:cut]
        row = got[doc]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), hashlib.sha256(copy.encode()).hexdigest())
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
        assert (copy != text) or row["near_edited"] == 1
        if len(text) > 300 and " " in text[:50]:
            assert row["near_edited"] > 0.3 > row["near_next"]
    assert got[9]["fingerprint"] == got[10]["fingerprint"] != ""


def test_anchors_are_closed_syncmers(spark):
    """A k-mer is an anchor exactly if the least of its inner hashes is at an edge."""
    rng = random.Random(6)
    df = spark.createDataFrame([(prose(rng, "xx", 60),)], "text string")
    df = syncmers.with_anchors(df, "text", "anchors").withColumn("u", syncmers.unit_hashes(F.col("text")))
    pairs = F.expr("transform(sequence(0, size(u) - 2), i -> xxhash64(u[i], u[i + 1]))")
    row = df.withColumn("m", pairs).withColumn("k", F.expr("transform(sequence(0, size(u) - 5), i -> hash(m[i], m[i + 2], m[i + 3]))")).first()
    want = [row["k"][i] for i in range(len(row["u"]) - 4) if min(row["m"][i : i + 4]) in (row["m"][i], row["m"][i + 3])]
    assert row["anchors"] == want and 10 < len(want) < 50


@pytest.mark.parametrize("ids", ["sparse", "one", "none"])
def test_next_documents_whatever_the_ids(documents, ids):
    rng = random.Random(2)
    pick = {"sparse": lambda: rng.randrange(-(2**63), 2**63), "one": lambda: rng.choice([7, 7, 7, 7, 8, -3]), "none": lambda: None}[ids]
    rows = [(pick(), f"{rng.randrange(40)} words of a text {'x ' * rng.randrange(9)}") for _ in range(300)]
    df = documents(rows)
    hashed = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]), reverse=True)
    want = [(doc, text, follows) for (doc, text), (_, follows) in zip(order, order[1:] + order[:1])]
    got = [(r["doc_id"], r["text"], r["next_text"]) for r in syncmers.with_next(df.select("doc_id", "text")).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_likeness_is_by_position(spark):
    rng = random.Random(8)
    half, other, more = (prose(rng, "xx", 80) for _ in range(3))
    texts = [f"{half} {other}", f"{other} {half}", f"{more} {half} {other}", f"{half} {other}", " ".join(sorted(f"{half} {other}".split()))]
    df = syncmers.with_anchors(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text", "a")
    first = df.where("id = 0").select(F.col("a_links").alias("own"))
    near = {r["id"]: r["n"] for r in df.join(first).select("id", syncmers.likeness(F.col("a_links"), F.col("own")).alias("n")).collect()}
    # A moved half keeps its own order, a text in front takes a third, mixed words leave nothing.
    assert near[0] == near[3] == 1 and near[1] > 0.8 and 0.55 < near[2] < 0.75 and near[4] < 0.1
    small = spark.createDataFrame([([1, 2, 3, 4], [4, 3, 2, 1])], "x array<int>, y array<int>")
    links = "transform({0}, (a, i) -> CASE WHEN i = 0 THEN hash(a) ELSE hash(a, {0}[i - 1], 1) END)"
    row = small.select(syncmers.likeness(F.expr(links.format("x")), F.expr(links.format("y"))).alias("n")).first()
    assert row["n"] == 0.0  # the same anchors in another order


def test_fingerprints_small_tables(documents):
    assert syncmers.fingerprints(documents([])).count() == 0
    only = syncmers.fingerprints(documents([(1, "abcdef")])).first()
    assert only["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and only["near_next"] == 1
    rows = syncmers.fingerprints(documents([(None, "xyz"), (2, "abc"), (2, "abc")])).collect()
    assert sorted(r["edited_sha256"] for r in rows) == sorted(hashlib.sha256(t).hexdigest() for t in (b"aba", b"abx", b"xya"))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="c%d"><nav><a href="/">Home</a></nav>
<div id="cookie-notice">We use cookies</div><script>var x = "</p><p>no";</script>
<div class="post post-%d"><header><h1>Big  &amp; small</h1></header><p>First <b>bold<p>Second<br>line &lt;tag&gt; caf&eacute;
<ul><li>one<li>two</ul><div class="ad">Buy!</div><form><input value="x">Send</form><p>Third %s</div>
<section class="comments"><p>Nice post, I think so too and write a lot about it, really a lot of words here.</p></section>
<aside>Side</aside><footer>&copy; me</footer></body></html>"""


def test_extraction_by_host_consensus(spark):
    long = "words " * 30
    pages = [(i, f"http://www.host.org:80/{i}", PAGE % (i, i, long)) for i in range(5)] + [
        (10, None, None), (11, "http://host.org/x", ""), (12, "//other", "plain text"), (13, "http://h2/", "<p>a<p>b"),
        (14, "http://h2/", "<article><h1>T</h1><p>x</p></article><div class=sidebar>much longer text than the article has, by far</div>"),
    ]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in htmltext.extract_pages(df).collect()}
    want = "Big & small\nFirst bold\nSecond line <tag> café\none\ntwo\nThird " + long.strip()
    assert [got[i] for i in range(5)] == [want] * 5
    assert (got[10], got[11], got[12], got[13], got[14]) == ("", "", "plain text", "a\nb", "T\nx")
    assert htmltext.extract_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<" * 5000, "<div>" * 3000 + "x", "</p>" * 500, "<p a='", "<!-- never ends", "<script>x", "a &#0; &#x110000; &amp", "<p>" * 2000])
def test_broken_pages_do_not_crash(page):
    assert isinstance(htmltext.extract(page, ["/div"]), str)
    htmltext.best_path(page)


def test_shingle_sets_are_sorted_and_distinct():
    sets = shingle_sets(pa.array(["a b c d e " * 50]))
    assert len(sets[0]) == 5 and (np.diff(sets[0].astype(object)) > 0).all()


def test_near_duplicates_of_an_id_with_two_texts(documents):
    rng = random.Random(12)
    rows = []
    for at in range(6):
        one, two = (prose(rng, "xx", 150) for _ in range(2))
        # Each text of the repeated id has one near copy, and the copies do not link by themselves.
        rows += [(10 * at, one), (10 * at, two), (10 * at + 1, edited(rng, one, 2)), (10 * at + 2, edited(rng, two, 2))]
    for order in (rows, rows[::-1]):
        got = {(r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(documents(order)).collect()}
        assert got == {(10 * at + k, 10 * at) for at in range(6) for k in range(3)}
        assert got == {(d, c) for d, _, c in brute_components(order)}


BODY = "<p>" + "Body of the article, in words. " * 40 + "</p>"
NESTED = [
    # headline and lead outside the body's div, with and without an article around them
    "<div class=top><a href=/>Home</a></div><article><h1>Headline</h1><p>Lead</p><div class=content>%s</div></article><p>Imprint</p>",
    "<div class=top><a href=/>Home</a></div><div class=wrap><h1>Headline</h1><p>Lead</p><div class=content>%s</div></div><div class=end>Imprint</div>",
    "<main><h1>Headline</h1><p>Lead</p><div class=content><div class=inner>%s</div></div></main><div>Imprint</div>",
    # two differently named parts
    "<article><div class=intro><h1>Headline</h1><p>Lead</p></div><div class=rest>%s</div></article><div>Imprint</div>",
    "<div class=page><div class=intro><h1>Headline</h1><p>Lead</p></div><div class=rest>%s</div></div><div>Imprint</div>",
]


@pytest.mark.parametrize("page", NESTED)
def test_extraction_takes_the_whole_article(page):
    page = "<html><body>" + page % BODY + "</body></html>"
    want = ["Headline", "Lead", htmltext.blocks(htmltext.parse(BODY))[0]]
    assert htmltext.extract(page, []).split("\n") == want
    assert htmltext.extract(page, [htmltext.best_path(page)[0]]).split("\n") == want


def test_extraction_stays_in_a_div_with_its_headline():
    page = "<body><div class=head>Site</div><div class=post><h1>Headline</h1>%s</div><div class=end>Imprint</div></body>" % BODY
    assert htmltext.extract(page, []).startswith("Headline\nBody") and "Imprint" not in htmltext.extract(page, [])


LAYOUTS = [
    "content no-sidebar", "content-area has-sidebar", "post-content with-comments", "main-content social", "story promo-free", "page-wrap sticky-nav",
    "article-search", "post related-post", "main-content sidebar-right", "two-column side", "menu",
]


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("page", [
    "<body><nav><a href=/>Home</a></nav><div class=cookie-notice>We use cookies</div><div class='%s'>%s</div><div class=ad>Buy</div></body>",
    "<body><header><h1>Site</h1></header><div class=outer><div class='%s'>%s</div></div><footer>Imprint</footer></body>",
    "<body><table class='%s'><tr><td>%s</td></tr></table></body>",
    "<body><form action=/><input name=state><div class='%s'>%s</div><button>Send</button></form></body>",
    "<body><div class='%s'><article>%s</article><div class=comments><p>Nice. </p></div></div></body>",
])
def test_layout_classes_keep_the_article(layout, page):
    page = page % (layout, f"<h1>Headline</h1><p>Lead</p><div class=side-by-side><p>Left</p><p>Right</p></div>{BODY}<div class=share>Gone</div>")
    want = ["Headline", "Lead", "Left", "Right", htmltext.blocks(htmltext.parse(BODY))[0]]
    assert htmltext.extract(page, []).split("\n")[-5:] == want
    assert "Gone" not in htmltext.extract(page, []) and "cookies" not in htmltext.extract(page, [])
    assert htmltext.extract(page, [htmltext.best_path(page)[0]]) == htmltext.extract(page, [])


@pytest.mark.parametrize("name", ["comments", "comment-list", "sidebar", "related-posts"])
def test_longer_parts_beside_the_article_stay_noise(name):
    page = f"<body><div class=post><h1>Headline</h1><p>Short.</p></div><div class={name}>{BODY}</div></body>"
    assert htmltext.extract(page, []) == "Headline\nShort."


def test_deep_pages_take_linear_time():
    def page(n):
        return "<article>" + "<header>" * 50 + "<div class=a><span>" * n + "x <h1>T</h1> y" + "</b></div>" * n + "<p>z</article>"

    def took(n):
        began = time.perf_counter()
        assert htmltext.extract(page(n), []) == "x\nT\ny\nz"
        htmltext.best_path(page(n))
        return time.perf_counter() - began

    took(1000)
    short, long = min(took(5000) for _ in range(2)), took(50_000)
    assert long < 30 * short + 1


@pytest.mark.parametrize("part", [
    "<h2 id=related-work>Kept</h2>", "<h2 id=ad-hoc-methods>Kept</h2>", "<h3 id=comments>Kept</h3>", "<p id=search-results>Kept</p>", "<p>K<span id=side>ept</span></p>",
    "<section id=side-effects><h2>Kept</h2></section>", "<section id=share-prices><p>Kept</section>", "<div id=related-work>Kept</div>",
    "<article class='post comments-open' id=no-comments>Kept</article>",
])
def test_ids_made_of_heading_words_are_no_noise(part):
    assert "\nKept\n" in htmltext.extract(f"<article><h1>T</h1>{part}{BODY}</article>", []) + "\n"


@pytest.mark.parametrize("part", [
    "<article class=comment>Gone</article>", "<article class='item comment-body' id=x>Gone</article>", "<article id=comment-12>Gone</article>",
    "<div id=cookie-notice>Gone</div>", "<section id=related-posts>Gone</section>", "<section id=comments>Gone</section>", "<div id=top-ad-slot-2>Gone</div>",
    "<ul id=share-buttons><li>Gone</ul>", "<p class=ad>Gone</p>", "<div class=related-links>Gone</div>",
])
def test_marked_parts_are_noise(part):
    assert "Gone" not in htmltext.extract(f"<article><h1>T</h1>{BODY}{part}</article>", [])
