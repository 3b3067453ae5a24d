import html
import random
import re
from collections import Counter

import corpus_pipeline
from cases import no_documents, odd_documents, random_text
from pyspark.sql import functions as F

from framewright.llm import decontaminate, htmlwrap, jaccard, packing, quality, toxicity
from framewright.llm.common import table


def text_of(pages, spark):
    return {r.page_id: r.text for r in htmlwrap.extract(spark.createDataFrame(pages, "page_id long, url string, html string, text string, host int")).collect()}


def test_pages_against_their_articles(spark, small):
    pages = table(spark, small, "pages").collect()
    got = {r.page_id: r for r in htmlwrap.op10_html_wrappers(spark, small).collect()}
    for p in pages:
        article = re.search(r"<article>(.*?)(</article>|$)", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:h1|p)>", article)]
        assert got[p.page_id].text == "\n".join(b for b in blocks if b) and got[p.page_id].n_chars == len(got[p.page_id].text)


PAGE = """<!doctype html><html><head><title>T{i}</title><style>p{{}}</style></head><body class="has-sidebar"><!-- c --><header><h1>Site</h1></header>
<nav><ul><li><a>Home</a><li><a>About</a></ul></nav><div class="cookie-notice">We use <b>cookies</b></div><aside><p>Side {i}</p></aside>
{open}<h2>Title&nbsp;{i} &amp; more</h2><p>First  para <em>with</em> em{i}<p>Second<br>line {i}<ul><li>a{i}<li>b</ul><div class="ad">Buy</div><form><p>Mail</p><input></form>
<script>if (1 < 2) "</p>";</script><pre>x  y</pre>{close}<section id="comments"><article class="comment"><p>Reader {i}</p></article></section><footer>&copy; Site</footer></body></html>"""


def test_boilerplate_goes(spark):
    want = "Title {i} & more\nFirst para with em{i}\nSecond line {i}\na{i}\nb\nx y"
    pages = [(i, "https://u@Host.example:80/p?q#f", PAGE.format(i=i, open="<article>", close="</article>"), "", 1) for i in range(12)]
    pages += [(100 + i, "http://plain.example/x", PAGE.format(i=i, open='<div id="body-text">', close="</div>"), "", 1) for i in range(12)]
    got = text_of(pages, spark)
    for i in range(12):
        assert got[i] == want.format(i=i)
        assert got[100 + i] == want.format(i=i).removesuffix("\nx y")  # a constant outside an article


def test_every_page_is_read_through_its_wrapper(spark):
    """Pages with an article went past the wrapper."""
    pages = [f"<body><div>Home</div><article><h1>Title {i}</h1><p>Text <b>of</b> {i}</p>{'<ul><li>one</li></ul>' * (i % 2)}</article></body>" for i in range(4)]
    roots = [htmlwrap.parse(p) for p in pages]
    home = htmlwrap.home_slots(htmlwrap.wrapper_of(roots))
    assert [htmlwrap.main_text(r, set(), set(), home) for r in roots] == [f"Title {i}\nText of {i}" + "\none" * (i % 2) for i in range(4)]
    assert [htmlwrap.main_text(r, set(), set()) for r in roots] == [""] * 4
    rows = spark.createDataFrame([(i, "http://a.b/", p) for i, p in enumerate(pages)], "page_id long, url string, html string").withColumn("host", htmlwrap.host_of("url"))
    places = htmlwrap.article_places(htmlwrap.read_pages(rows)).collect()
    assert [(r["_host"], {p % (1 << 64) for p in r.home}, r.slots) for r in places] == [("a.b", home, [])]


def test_a_line_break_begins_a_block(spark):
    """A block that began with one was counted to the element before."""
    pages = ["<body><article><p>One</p></article><div><br>Contact us</div></body>", "<body><div>Shop</div><article><p><br>Two</p></article></body>"]
    got = text_of([(i + 1, f"http://host{i}.example/", p, "", 1) for i, p in enumerate(pages)], spark)
    assert got == {1: "One", 2: "Two"}


def test_hosts_that_mix_templates(spark):
    """One page with an article leaves the text of the host's other pages alone."""
    pages = [(1, None, "<body><article><p>In an article</p></article><p>Outside</p></body>", "", 1), (2, None, "<body><div><p>No article here</p></div></body>", "", 1), (3, None, "<body><main></main><p>Empty main</p></body>", "", 1)]
    assert text_of(pages, spark) == {1: "In an article", 2: "No article here", 3: "Empty main"}


def test_odd_pages(spark):
    pages = [(1, None, None, None, None), (2, "", "", None, None), (3, "x", "no markup at all", None, None), (4, "http://h/", "<article><p>open <b>never closed", None, None), (5, "http://h/", "<" * 50 + "a='", None, None), (6, "http://h/", "<p>" * 400 + "deep", None, None), (7, "http://h/", "<div>" * 400 + "deep", None, None), (4, "http://h/", "<article><p>open <b>never closed", None, None)]
    got = text_of(pages, spark)
    assert got[1] == got[2] == "" and got[4] == "open never closed" and len(got) == 7
    assert text_of([], spark) == {}


def wrapper(*pages):
    return htmlwrap.wrapper_of([htmlwrap.parse(p) for p in pages])


def test_wrappers_align():
    a, b = "<div class=x><h1>x</h1><p>a</p><p>b</p></div>", "<div class=x><h1>y</h1><img><p>a</p></div>"
    want = "<div.x><h1>#text</h1>(<img></img>)?(<p>#text</p>)+</div>"
    assert htmlwrap.expression(wrapper(a, b)) == htmlwrap.expression(wrapper(b, a)) == want
    both = wrapper(a, b)
    assert htmlwrap.written(htmlwrap.read(htmlwrap.written(both))) == htmlwrap.written(both) == htmlwrap.written(htmlwrap.wrapper_of([both, wrapper(a)]))


def test_matches_are_common_subsequences(monkeypatch):
    rnd = random.Random(6)
    for pairs in (40_000, 0):
        monkeypatch.setattr(htmlwrap, "PAIRS", pairs)
        for _ in range(200):
            a, b = ([rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 12))] for _ in range(2))
            got = htmlwrap.matches(a, b)
            assert all(a[i] == b[j] for i, j in got) and all(p < q and r < s for (p, r), (q, s) in zip(got, got[1:], strict=False))
            if pairs:
                longest = [[0] * 13 for _ in range(13)]
                for i, x in enumerate(a):
                    for j, y in enumerate(b):
                        longest[i + 1][j + 1] = longest[i][j] + 1 if x == y else max(longest[i][j + 1], longest[i + 1][j])
                assert len(got) == longest[len(a)][len(b)]


def test_deep_and_wide_pages(spark):
    deep = ["<div>" * n + "deep" + "</div>" * n for n in (20_000, 19_999)]
    wide = ["".join(f"<p class=c{(k * step) % 9973}>w{k}</p>" for k in range(5_000)) for step in (1, 7)]
    pages = [(i, f"http://{'ab'[i // 2]}/", p, "", 1) for i, p in enumerate(deep + wide)]
    got = text_of(pages, spark)
    assert got[0] == got[1] == "deep" and all(len(got[i].split()) == 5_000 for i in (2, 3))


#: No element or class says what it is.
PLAIN = """<html><body><div class="q1"><div><a href="/">Home</a></div><div><a href="/x">News {i}</a></div><div><a href="/y">More {j}</a></div></div>
<div class="z7">We value your privacy and store things on your machine.</div>
<div class="k3">{extra}<div class="h9">Heading {i}</div><div class="b2">Body number {i} says <b>a few things</b> that no other page says, {words}.</div>
<div class="b2">A second part, {words}.</div></div><div class="w5">All rights are reserved by the owners of this site.</div></body></html>"""


def plain_pages(hosts=("p.example",), n=5):
    out = []
    for h, host in enumerate(hosts):
        for i in range(n):
            words = " ".join(f"v{i * 31 + k}" for k in range(20))
            out.append((100 * h + i, f"http://{host}/{i}", PLAIN.format(i=i, j=i * i, words=words, extra='<div class="m4"><img></div>' if i % 2 else ""), "", 1))
    return out


def plain_text(i):
    words = " ".join(f"v{i * 31 + k}" for k in range(20))
    return f"Heading {i}\nBody number {i} says a few things that no other page says, {words}.\nA second part, {words}."


def test_wrappers_find_articles_without_marks(spark):
    """Menus, notices and footers without tell-tale names go by variation and links; also from among copies of one page."""
    pages = plain_pages()
    got = text_of(pages + [(50 + k, "http://p.example/0", pages[0][2], "", 1) for k in range(3)], spark)
    assert got == {i: plain_text(i) for i in range(5)} | {50 + k: plain_text(0) for k in range(3)}


def test_without_alignment_articles_are_not_found(monkeypatch):
    """Slots of groups that only some pages have are known by alignment alone."""
    roots = [htmlwrap.parse(h.replace('class="k3"', 'class="kx"' if i % 2 else 'class="ky"')) for i, _, h, _, _ in plain_pages()]
    varying = Counter()
    for r in roots:
        varying.update({path: len(text) for path, _, text, links in htmlwrap.blocks_of(r) if not links and ("number" in text or "Heading" in text)})

    def found():
        slots, others = htmlwrap.article_slots(htmlwrap.wrapper_of(roots), varying, {})
        return [bool(htmlwrap.main_text(r, slots & set(varying), others & set(varying))) for r in roots]

    assert found() == [True] * 5
    monkeypatch.setattr(htmlwrap, "aligned", lambda a, b: a)  # the first page alone
    assert found() == [True, False] * 2 + [True]


def test_copies_of_an_article_are_no_template(spark):
    """Pages that hold the same article under other menus keep it."""
    body = " ".join(f"word{k}" for k in range(200))
    pages = [(i, "http://c.example/", f"<body><div class=a><a>{i} link</a></div><div class=b><p>{body}</p></div></body>", "", 1) for i in range(4)]
    assert all(body in t for t in text_of(pages, spark).values())


def test_wrappers_do_not_depend_on_the_layout(spark, monkeypatch):
    rows = spark.createDataFrame(plain_pages(("a.x", "b.x"), 12), "page_id long, url string, html string, text string, host int")
    few = {r.page_id: r.text for r in htmlwrap.extract(rows.coalesce(1)).collect()}
    monkeypatch.setattr(htmlwrap, "TOGETHER", 2)
    assert few == {r.page_id: r.text for r in htmlwrap.extract(rows.repartition(7)).collect()}


# --- decontamination ----------------------------------------------------------------------------------------------------------

ITEM = "A train leaves Paris at 9 with 120 passengers and Alice counts 15 km before the train meets Bob who walks 4 km every hour near the old bridge."


def test_reparameterised_items_are_caught(spark):
    other = ITEM.replace("Paris", "Rome").replace("Alice", "Carol").replace("120", "77").replace("15", "8").replace("9", "11")
    mixed = "A train leaves Paris at 9 with 120 passengers and then nothing of the kind happens to anybody for a long and quiet while in the hills."
    rnd = random.Random(1)
    docs = [(1, random_text(rnd, 50) + " " + ITEM + " " + random_text(rnd, 50)), (2, "Intro here. " + other), (3, mixed), (4, random_text(rnd, 400)), (5, None), (6, ""), (7, ITEM.upper()), (8, ITEM.title()), (None, ITEM), (1, random_text(rnd, 10)), (9, "He asked: who wrote Hamlet? Nobody knew.")]
    benchmark = spark.createDataFrame([(10, ITEM), (11, ITEM), (12, "too short"), (13, None), (14, "Who wrote Hamlet?"), (15, "12 13 14"), (None, ITEM)], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    out = decontaminate.find_leaks(frame, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(d, i) for d in (1, 2, 7, 8, None) for i in (10, 11)} | {(9, 14)}
    changed = {r.doc_id: r.n_changed for r in out}
    assert changed[1] == 0 and changed[2] >= 4
    assert sorted(str(r.doc_id) for r in decontaminate.decontaminate(frame, benchmark).collect()) == ["3", "4", "5", "6"]
    named = frame.selectExpr("doc_id", "text", "1 as _leaked", "2 as th", "3 as h")
    assert sorted(str(r.doc_id) for r in decontaminate.decontaminate(named, benchmark).collect()) == ["3", "4", "5", "6"]
    long = " ".join(f"filler{i}" for i in range(60_000)) + " " + other
    assert [r.item_id for r in decontaminate.find_leaks(spark.createDataFrame([(1, long)], "doc_id long, text string"), benchmark).collect()] in ([10, 11], [11, 10])


def test_inconsistent_slots_are_no_leak(spark):
    item = " then ".join("Ann gave 5 coins to the old red fox" for _ in range(6))
    same = item.replace("5", "8")
    mixed = "".join(c if c != "5" else str(100 + i) for i, c in enumerate(item))
    frame = spark.createDataFrame([(1, same), (2, mixed)], "doc_id long, text string")
    out = decontaminate.find_leaks(frame, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [r.doc_id for r in out] == [1]


def test_each_occurrence_is_judged(spark):
    """A copy stays a leak beside a variant of the same item, and if the item repeats a template with other values."""
    other = ITEM.replace("Paris", "Rome").replace("Alice", "Carol").replace("120", "77").replace("15", "8").replace("9", "11")
    repeats = " then ".join(f"he picked {k} red apples from the tree" for k in (3, 8, 5, 7, 4))
    docs = [(1, ITEM + " And again. " + other), (2, other + " And again. " + other.replace("Rome", "Oslo").replace("77", "31").replace("8", "6").replace("Carol", "Dan").replace("11", "12")), (3, "Intro here. " + repeats)]
    benchmark = spark.createDataFrame([(10, ITEM), (11, repeats)], "item_id long, text string")
    out = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(1, 10), (2, 10), (3, 11)}
    assert {r.doc_id: r.n_changed for r in out}[1] == {r.doc_id: r.n_changed for r in out}[3] == 0


def test_join_without_broadcast_agrees(spark, medium, monkeypatch):
    docs, benchmark = table(spark, medium, "documents"), table(spark, medium, "benchmark")
    near = sorted(decontaminate.find_leaks(docs, benchmark).collect())
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert sorted(decontaminate.find_leaks(docs, benchmark).collect()) == near and near


def test_planted_items_are_found(spark, medium):
    """Documents that hold an item's words one after the other, by plain search."""
    plain = lambda t: " ".join(re.sub(r"[^\w\s]", "", t).lower().split())
    items = [plain(r.text) for r in table(spark, medium, "benchmark").collect()]
    docs = table(spark, medium, "documents").collect()
    want = {r.doc_id for r in docs if any(i in plain(r.text) for i in items)}
    assert {r.doc_id for r in decontaminate.op1_template_decontamination(spark, medium).collect()} == want


def test_marked_words(spark):
    text = "Then Bob paid 1,000.5 dollars for 12km to O'Neil, Ann. At 9 3rd x9 \ue000 日本 done"
    row = spark.createDataFrame([(text,)], "text string").select(decontaminate.marked_words(F.col("text")).alias("w")).select("w", F.transform("w", lambda w: decontaminate.template_word(w, True)).alias("t"), F.transform("w", lambda w: decontaminate.template_word(w, False)).alias("p"), F.transform("w", decontaminate.value_of).alias("v")).first()
    num, name, unit = decontaminate.NUM, decontaminate.NAMED, decontaminate.UNIT
    assert row.v == ["then", "bob", "paid", "10005", "dollars", "for", "12km", "to", "oneil", "ann", "at", "9", "3rd", "x9", "日本", "done"]
    assert [x[0] if x[0] in num + name + unit else x for x in row.t] == ["then", name, "paid", num, unit, "for", num, "to", name, name, "at", num, num, "x9", "日本", "done"]
    assert [x[0] if x[0] in num + name + unit else x for x in row.p] == ["then", "bob", "paid", num, unit, "for", num, "to", "oneil", "ann", "at", num, num, "x9", "日本", "done"]
    assert row.t[3] == num and row.t[12] == num + "rd"


def test_reparameterised_items_in_documents(spark, medium):
    """Every item with other numbers and names, planted into documents: all found, no clean document is."""
    rnd = random.Random(4)
    items = [(r.item_id, r.text) for r in table(spark, medium, "benchmark").collect()]
    clean = [(i, random_text(rnd, 300)) for i in range(50)]
    worded = [(k, re.sub(r"(\w+) (\w+) (\w+) (\w+) (\w+) (\w+)", r"\1 \2 Kim \3 \4 17 \5 \6", t)) for k, t in items]
    other = [(1000 + k, f"{random_text(rnd, 40)}. {t.replace('Kim', 'Lee').replace('17', '250')} {random_text(rnd, 40)}") for k, t in worded]
    frame = spark.createDataFrame(clean + other, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame, spark.createDataFrame(worded, "item_id long, text string")).collect()}
    assert {d for d, _ in found} == {d for d, _ in other} and {(1000 + k, k) for k, _ in items} <= found


# --- pipeline -------------------------------------------------------------------------------------------------------------------


def test_pipeline_against_single_stages(spark, medium):
    docs, labels, benchmark = (table(spark, medium, t) for t in ("documents", "labels", "benchmark"))
    toxic = {r.doc_id for r in toxicity.classify(docs, toxicity.train(docs, labels)).where("toxic").collect()}
    left = docs.where(~docs.doc_id.isin(toxic))
    left = left.where(left.doc_id.isin({r.doc_id for r in quality.judge(left).where("kept").collect()}))
    left = left.where(left.doc_id.isin({r.doc_id for r in jaccard.join_similar(left).where("doc_id = class_id").collect()}))
    leaks = {r.doc_id for r in decontaminate.find_leaks(left, benchmark).collect()}
    want = {r.doc_id for r in left.collect()} - leaks
    out = corpus_pipeline.run(spark, medium).collect()
    assert {r.doc_id for r in out} == want and len(toxic) > 50 and leaks is not None
    assert len({(r.doc_id, r.start) for r in out}) == len(out)


def test_stages_keep_columns(spark, small):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (odd_documents(spark), no_documents(spark)):
            out = stage(spark, docs, small)
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
    assert packing.op6_packing(spark, small).columns == corpus_pipeline.STAGES[-1][1](spark, no_documents(spark), small).columns


def test_the_pipeline_judges_small_languages(spark):
    """The quality stage had no model of languages below a 2^10th of all tokens: there a text without grammar passed beside the prose."""
    import random

    import corpus_pipeline

    pairs = ["da ke", "lo mi", "nu pa"]
    prose = [" ".join(f"{pairs[j % 3]} x{i}y{j}" for j in range(20 + i % 10)) for i in range(41)]
    words = prose.pop().split()
    random.Random(1).shuffle(words)
    rows = [*((i, "xx", p) for i, p in enumerate(prose)), (99, "xx", " ".join(words))]
    large = spark.range(1000, 1040).selectExpr("id AS doc_id", "'en' AS lang", "repeat(concat('the w', id, ' and '), 40000) AS text")
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").union(large)
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, "").where("lang = 'xx'").collect()}
    assert kept == set(range(40))


def test_the_pipeline_leaves_no_ngram_out(spark, medium, monkeypatch):
    """What its quality stage keeps doesn't depend on which n-grams are frequent: those below NGRAM_SHARE had no say."""
    import corpus_pipeline

    docs = table(spark, medium, "documents")
    kept = lambda: sorted(r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, medium).collect())
    want = kept()
    monkeypatch.setattr(quality, "NGRAM_SHARE", 2.0**-7)
    assert kept() == want
