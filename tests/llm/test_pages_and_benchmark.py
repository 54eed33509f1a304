import random
import time

import numpy as np

from veilspark.llm import decontaminate as D
from veilspark.llm import html_text


def test_templates(spark, sf_dir):
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r["page_id"]: r for r in html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    for p in pages:
        inner = re.search("<article>(.*?)</article>", p["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?p>|<br>|</?h1>", inner)]
        want = "\n".join(b for b in blocks if b)
        assert got[p["page_id"]]["text"] == want and got[p["page_id"]]["n_chars"] == len(want)


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><a href=x>one</a> <a href=y>two</a></nav><div class="cookie-notice">We use cookies for things and more things</div>
<div id="content"><h1>Title &amp; more</h1><p>Para one is long enough, with <a href=z>a link</a> inside.</p><!-- no --><p>Para   two
goes on<p>Third, unclosed<ul><li>item 1<li>item 2</ul></div>
<div class="sidebar"><p>Somewhere else entirely</p></div><div id="comments"><p>Reader says this is nice and long</p></div>
<form>Name <input></form><script>var a = "<p>not text</p>";</script><footer>&copy; us</footer></body></html>"""


def test_density_without_article():
    assert html_text.main_text(PAGE) == "Title & more\nPara one is long enough, with a link inside.\nPara two goes on\nThird, unclosed\nitem 1\nitem 2"


def test_boilerplate_in_and_around_articles():
    page = """<body><div id="header"><p>Site name and slogan of the site</p></div><article><header><h1>Head</h1></header><p>One.</p>
    <div class="ad-slot"><p>Buy now</p></div><aside>Box</aside><p>Two<br>three &lt;x&gt; \u00a0 y</p><section class="comments"><p>First!</p></section>
    <div class="share-buttons">Share</div></article><article class="teaser"><p>Other story</p></article></body>"""
    assert html_text.main_text(page) == "Head\nOne.\nTwo\nthree <x> y"


LONG = "Words of a paragraph that goes on for long enough to count as text, number {}, with nothing linked."


def _paragraphs(*numbers):
    return "".join(f"<p>{LONG.format(i)}</p>" for i in numbers), [LONG.format(i) for i in numbers]


def test_density_decides_among_regions():
    (a, x), (b, y), (c, z) = _paragraphs(1, 2, 3), _paragraphs(4, 5), _paragraphs(6, 7, 8)
    nav = "<nav><a href=x>one</a> <a href=y>two</a></nav>"
    # Sibling articles, the text beside the article of a main region, and text outside of an empty article.
    assert html_text.main_text(f"<body>{nav}<article>{a}</article><article>{b}</article></body>").split("\n") == x + y
    assert html_text.main_text(f"<body>{nav}<main><article>{a}</article><div>{b}</div></main></body>").split("\n") == x + y
    assert html_text.main_text(f"<body>{nav}<article><p>Card</p></article><div>{a}{c}</div></body>").split("\n") == x + z
    # Text that stands loose beside the densest subtree.
    loose = " ".join(LONG.format(i) for i in (9, 10, 11))
    assert html_text.main_text(f"<body><div>{loose} <b>Bold.</b><div>{a}</div></div></body>").split("\n") == [loose + " Bold.", *x]


def test_names_and_forms_are_only_a_penalty():
    (a, x), (b, y) = _paragraphs(1, 2, 3), _paragraphs(4, 5, 6)
    nav, foot = "<nav><a href=x>one</a> <a href=y>two</a></nav>", "<footer>Small print</footer>"
    for wrapper in ("<form id=aspnetForm><div>{}</div></form>", "<div class='content with-sidebar'>{}</div>", "<div id=layout-menu><div>{}</div></div>", "<div style='overflow:hidden'>{}</div>", "<div class=has-sidebar><article>{}</article></div>", "<form><input><article>{}</article></form>"):
        assert html_text.main_text(f"<html><body>{nav}{wrapper.format(a)}{foot}</body></html>").split("\n") == x, wrapper
    # Sections of an article whose names only sound like boilerplate; comments and short boxes go.
    for name in ("related-work", "legal", "alert", "tags", "search"):
        page = f"<body>{nav}<article>{a}<section class={name}>{b}</section><div class={name}>Box</div><div class=comments>{b}</div></article>{foot}</body>"
        assert html_text.main_text(page).split("\n") == x + y, name
    # A head without its end tag.
    assert html_text.main_text(f"<html><head><meta charset=x><body><div>{a}</div></body></html>").split("\n") == x


def test_titles_and_broken_quotes():
    a, x = _paragraphs(1, 2, 3)
    nav = "<nav><a href=x>one</a> <a href=y>two</a></nav>"
    assert html_text.main_text(f"<body>{nav}<header><h1>Site</h1></header><div class='post tag-politics'><header><h1>Title</h1></header>{a}</div></body>").split("\n") == ["Title", *x]
    assert html_text.main_text(f'<body>{nav}<div><a href="x>link</a>{a}</div></body>').split("\n") == ["link", *x]
    assert html_text.main_text(f"<div>{a}</div><p class='cut off").split("\n") == x


def naive(node):
    """Characters, tags, link characters and link tags of a subtree, counted anew for each node."""
    chars = tags = links = link_tags = 0
    for y in node.items:
        if isinstance(y, str):
            chars += len("".join(y.split()))
        else:
            c, t, lc, lt = naive(y)
            chars, tags, links, link_tags = chars + c, tags + t + 1, links + lc, link_tags + lt
    return (chars, tags, chars, tags + 1) if node.tag == "a" else (chars, tags, links, link_tags)


def test_densities_equal_a_naive_count():
    import math

    rng = random.Random(6)

    def markup(depth):
        out = []
        for _ in range(rng.randrange(1, 5)):
            kind = rng.choice(["text", "a", "b", "div", "p"]) if depth else "text"
            words = " ".join("word" * rng.randrange(1, 4) for _ in range(rng.randrange(1, 30)))
            out.append(words if kind == "text" else f"<{kind}>{words if kind in 'abp' else markup(depth - 1)}</{kind}>")
        return "".join(out)

    for _ in range(60):
        root = html_text.tree(f"<body><div>{markup(3)}</div><div>{markup(2)}</div></body>")
        nodes, linked = html_text.densities(root)
        body = next(n for n in nodes if n.tag == "body")
        c, _, lc, _ = naive(body)
        assert math.isclose(linked, lc / c)
        for n in nodes:
            c, t, lc, lt = naive(n)
            base = math.log(c / max(c - lc, 1) * lc + linked * c + math.e**2) if c else 0
            t, lc, lt = max(t, 1), max(lc, 1), max(lt, 1)
            want = c / t * max(math.log(max(c / lc * t / lt, 1.0)) / math.log(max(base, 1.5)), 1e-3) if c else 0.0
            assert math.isclose(n.density, want, rel_tol=1e-9, abs_tol=1e-12)
            assert math.isclose(n.total, sum(y.density for y in n.items if not isinstance(y, str)), abs_tol=1e-12)
        best = max(nodes, key=lambda n: n.total)
        chosen = html_text.content(html_text.tree(f"<body>{markup(0)}</body>"))
        assert best.total >= 0 and chosen


def test_very_long_page():
    a = "".join(f"<p>{LONG.format(i)}</p>" for i in range(20_000))
    assert html_text.main_text(f"<body><nav><a href=x>one</a></nav><div>{a}</div></body>").count("\n") == 19_999


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "just text"), (4, "u", "<p>a<p>b</div></p>"), (5, "u", "<div>" * 3000 + "deep"), (6, "u", "a < b & c"), (None, None, "<script>x"), (4, "u", "<p>a<p>b</div></p>")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert text[1] == text[2] == text[None] == "" and text[3] == "just text" and text[4] == "a\nb" and text[5] == "deep" and text[6] == "a < b & c"
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_subsequence():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 20))] for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert D.common_subsequence(a, b) == t[-1, -1]


def corpus():
    rng = random.Random(8)
    vocab = ["".join(rng.choice("aeioubcdrst") for _ in range(rng.randrange(3, 9))) for _ in range(1500)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(some(30)) + ". " + " ".join(some(10)) + ".") for i in range(30)]
    docs, dirty = [], set()
    for i in range(200):
        w = some(rng.randrange(20, 200))
        if i % 5 == 0:
            p = items[i % 30][1].split()
            if i % 10 == 0:  # a paraphrase: words dropped and changed
                p = [x if rng.random() > 0.12 else rng.choice(vocab) for x in p if rng.random() > 0.08]
            at = rng.randrange(len(w))
            w[at:at] = p
            dirty.add(i)
        docs.append((i, " ".join(w)))
    return docs, items, dirty


def test_finds_planted_items(spark, table, odd):
    docs, items, dirty = corpus()
    bench = spark.createDataFrame(items + [(99, None), (98, ""), (97, " ")], "item_id long, text string")
    rows = docs + [(1000 + (i or 500), t) for i, t in odd]
    found = {r["doc_id"]: r["item_id"] for r in D.matches(table(rows), bench).collect()}
    assert len(dirty & found.keys()) >= 0.9 * len(dirty) and not found.keys() - dirty
    assert all(found[i] == i % 30 for i in found)
    # Against brute force over every window: recall of the latent search.
    texts = {i: (D.words(t), D.words(t.rstrip(".").split(". ")[-1])) for i, t in items}
    brute = set()
    for i, t in docs:
        w = D.words(t)
        for target, answer in texts.values():
            for s in range(0, len(w), 10):
                region = w[max(0, s - 20) : s + 60]
                share = D.common_subsequence(target, region) / len(target)
                if share >= D.SURE or (share >= D.LIKELY and D.common_subsequence(answer, region) / len(answer) >= D.ANSWER):
                    brute.add(i)
    assert len(brute & found.keys()) >= 0.9 * len(brute)
    clean = {r["doc_id"] for r in D.clean(table(rows), bench).collect()}
    assert clean == {i for i, _ in rows} - found.keys() and D.clean(table(rows), bench).columns == table(rows).columns


def test_items_in_slices(spark, table, monkeypatch):
    docs, items, _ = corpus()
    bench = spark.createDataFrame(items + [(100 + i, t) for i, t in items[:5]], "item_id long, text string")
    row = lambda r: (r["doc_id"], r["item_id"], r["n_items"])
    whole = sorted(row(r) for r in D.matches(table(docs), bench).collect())
    monkeypatch.setattr(D, "ITEM_BYTES", 2500)
    assert len(D.item_slices(bench)) > 3
    assert sorted(row(r) for r in D.matches(table(docs), bench).collect()) == whole
    assert {r["doc_id"] for r in D.clean(table(docs), bench).collect()} == {i for i, _ in docs} - {r[0] for r in whole}


def test_empty_tables(spark, table):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert D.matches(table([(1, "a b")]), none).count() == 0 and D.clean(table([(1, "a b")]), none).count() == 1
    assert D.matches(table([]), some).count() == 0 and D.clean(table([]), some).count() == 0


def test_recall_by_length_of_item(spark, table):
    rng = random.Random(11)
    vocab = ["".join(rng.choice("aeioubcdrst") for _ in range(rng.randrange(3, 9))) for _ in range(3000)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    lengths = [8, 12, 16, 24, 40, 80, 200]
    items = [(i, some(lengths[i % 7])) for i in range(420)]
    bench = spark.createDataFrame([(i, " ".join(t[:-4]) + ". " + " ".join(t[-4:]) + ".") for i, t in items], "item_id long, text string")
    docs, brute = [], {}
    for i, t in items:
        # A quarter of the words before the answer dropped, three tenths of the rest changed.
        p = [x if rng.random() > 0.3 else rng.choice(vocab) for x in t[:-4] if rng.random() > 0.25] + t[-4:]
        docs.append((i, " ".join(some(rng.randrange(30, 150)) + p + some(rng.randrange(30, 150)))))
        w, answer = D.words(docs[-1][1]), [x.encode() for x in t[-4:]]
        target = D.words(" ".join(t[:-4]) + ". " + " ".join(t[-4:]) + ".")
        regions = [w[at : at + 2 * len(t)] for at in range(0, len(w), 4)]
        shares = [(D.common_subsequence(target, x) / len(t), D.common_subsequence(answer, x) / 4) for x in regions]
        brute[i] = any(x >= D.SURE or (x >= D.LIKELY and y >= D.ANSWER) for x, y in shares)
    found = {(r["doc_id"], r["item_id"]) for r in D.matches(table(docs), bench).collect()}
    assert all(sum(brute[i] for i, t in items if len(t) == n) > 20 for n in lengths)
    recall = {n: np.mean([(i, i) in found for i, t in items if len(t) == n and brute[i]]) for n in lengths}
    assert min(recall.values()) >= 0.9, recall


def test_projection_is_fitted_on_every_document(spark, table):
    docs = [(i, f"own{i} the cat {i % 7} sat") for i in range(3000)]
    latent = D.fit(table(docs), spark.createDataFrame([(1, "one two three four five")], "item_id long, text string"))
    own = np.concatenate([D.buckets(f"own{i}") for i in range(3000)])
    assert (np.abs(latent.project[own]).max(1) > 0).all()


def test_sums_of_passages():
    rng = np.random.default_rng(3)
    idf, hashed = rng.random(D.DIMS) + 0.5, [rng.integers(0, 300, 40) for _ in range(200)]
    a = np.zeros((200, 300))
    for i, h in enumerate(hashed):
        np.add.at(a[i], h, idf[h])
    a /= np.linalg.norm(a, axis=1, keepdims=True)

    def total(rows, fold, seed=0):
        gram = D.Gram(idf, 8, rows, fold, seed)
        for i in range(0, 200, 70):
            gram.add(np.repeat(np.arange(len(hashed[i : i + 70])), 40), np.concatenate(hashed[i : i + 70]))
        gram.multiply()
        return gram.total[:300]

    want = a.T @ (a @ D._start(8)[:300])
    assert np.allclose(total(512, 1 << 17), want, atol=1e-4) and np.allclose(total(16, 16), want, atol=1e-4)
    # Passages that share a row: right on the mean over draws of signs.
    each = [np.linalg.norm(total(32, 100, k) - want) for k in range(100)]
    mean = np.mean([total(32, 100, k) for k in range(100)], axis=0)
    assert np.linalg.norm(mean - want) < 0.2 * np.mean(each)


def test_a_long_comment_does_not_take_the_articles_place():
    paragraphs = [("word" + str(i) + " ") * 15 for i in range(4)]
    article = "".join(f"<p>{p}</p>" for p in paragraphs)
    for n in (30, 60, 200):
        text = html_text.main_text(f"<body><div class=post>{article}</div><div class='c-list'><p>{'remark ' * n}</p></div></body>")
        assert all(p.strip() in text for p in paragraphs)


def test_phrases_stay_in_their_paragraph():
    page = "<body><article><p>Press <button>Save</button> and wait for <label>Name</label> to show.</p><p>A formula <math><mi>x</mi><mo>+</mo><mn>1</mn></math>, and an <object>object</object> in it.</p></article></body>"
    assert html_text.main_text(page) == "Press and wait for to show.\nA formula x+1, and an object in it."


def test_deep_nesting_is_linear():
    for page in ("<form>" * 20_000 + "<p>text here</p>", "<b>" * 20_000 + "</i>" * 20_000 + "x", "<p>a<div>" * 5_000, "<header><div>" * 10_000 + "<h1>t</h1>"):
        began = time.time()
        html_text.main_text(page)
        assert time.time() - began < 10
