from __future__ import annotations

from tallyframe.llm import page_text as pt

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">home</a></li></ul></nav><div class="ad">buy {i}</div><article><h1>Head&amp;line {i}</h1><p>One <b>bo</b>ld
 line.<br>next</p><aside>side</aside><div class="comments"><p>me too</p></div><p>caf&eacute; {i}</article><footer>&copy; x</footer>"""


def pages(spark, rows):
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, pt_host string")


def run(spark, rows, **kw):
    return {r.page_id: r.pt_text for r in pt.extract(pages(spark, rows), ["page_id"], **kw).collect()}


def test_article_without_what_stands_around_it(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.replace("{i}", str(i))) for i in range(5)]
    want = {i: f"Head&line {i} One bold line. next café {i}" for i in range(5)}
    assert run(spark, rows) == want
    assert run(spark, rows, most_tokens=0) == want  # templates joined, not broadcast


def test_constant_text_goes_where_there_is_no_article(spark):
    page = "<html><body><div><p>Welcome to our site</p></div><div><p>story {i}</p></div><div><p>All rights reserved</p></div></body></html>"
    rows = [(i, "http://a/x", page.replace("{i}", str(i))) for i in range(6)]
    assert run(spark, rows) == {i: f"story {i}" for i in range(6)}


def brute(hosts):
    """Texts of pages, a list for each host, deduced with occurrence vectors in full, and their main element and valid tokens."""
    found = []
    for pages_ in hosts:
        seen, shape = [], {}
        for page in pages_:
            order, around = [], [0]
            for kind, key, name, content in pt.walk(page):
                if kind == "text" and content.strip():
                    k = pt.text_key(key, content)
                    shape[k] = (key, "")
                    order.append((k, len(content)))
                elif kind in ("open", "close") and name not in pt.INLINE:
                    if kind == "open":
                        shape[key] = (around[-1], name, pt._named_out(name, content))
                        order.append((key, 0))
                    around = [*around, key] if kind == "open" else around[:-1]
            seen.append(order)
        n, vectors = len(pages_), {k: tuple(sum(x == k for x, _ in o) for o in seen) for k in shape}
        classes = {}
        for k, v in vectors.items():
            if max(v) == 1 and sum(v) * 10 >= n:
                classes.setdefault(v, set()).add(k)
        valid = set()
        for v, members in classes.items():
            kept = {k for k in members if (k > 0 and (sum(m > 0 for m in members) > 1 or sum(v) == n)) or (k < 0 and sum(v) > 2 and 2 * sum(v) >= n)}
            if len({tuple(k for k, _ in o if k in kept) for o, hit in zip(seen, v, strict=True) if hit}) <= 1:
                valid |= kept
        chain = lambda k: [] if not k else [k, *chain(shape[k][0])]
        inside = lambda k: next((x for x in chain(k) if x in valid), 0)
        chars = {}
        for o in seen:
            for k, size in o:
                if k < 0:
                    for x in dict.fromkeys([*[x for x in chain(shape[k][0]) if x in valid], 0]):
                        chars.setdefault(x, []).append((size, chain(shape[k][0])))
        def held(x):
            return sum(size for size, c in chars.get(x, []) if not any(y in valid and shape[y][2] for y in c[: c.index(x) if x else len(c)]))
        main = 0
        while not main or shape[main][1] not in pt.MAIN:
            below = [k for k in valid if k > 0 and inside(shape[k][0]) == main and not shape[k][2]]
            heads = [k for k in below if shape[k][1] in pt.HEADINGS and not any(t in valid and shape[t][0] == k for t in shape if t < 0)]
            inner = sorted((-held(k), k) for k in below if shape[k][1] in pt.CONTAINERS)
            if not inner or (main and heads) or -2 * inner[0][0] < held(main):
                break
            main = inner[0][1]
        main = 0 if main and shape[main][1] in ("html", "body") else main
        found.append((valid, main, [pt.main_text(p, pt.Template(dict.fromkeys(valid, 1), main)) for p in pages_]))
    return found


def test_deduction_against_brute_force(spark, sf):
    d = sf.replace("sf0.001", "sf0.01")
    real = {}
    for r in spark.read.parquet(f"{d}/pages.parquet").collect():
        real.setdefault(r.url.split("/")[2].lower(), []).append((r.page_id, r.html))
    shop = "<html><body><div class=top>Shop {i}</div><div class=x><h1>item {i}</h1>{p}<div class=zz>buy now</div></div><div class=rest>{q}</div></body></html>"
    real["a"] = [(10**6 + i, shop.replace("{p}", "".join(f"<p>text {j} of {i} and more</p>" for j in range(i % 4))).replace("{q}", "<i>y</i>" * (i % 3)).replace("{i}", str(i))) for i in range(12)]
    real["b"] = [(2 * 10**6 + i, "<div><p>one</p></div>" + ("<ul><li>a</ul><section>b</section>" if i % 2 else "<section>b</section><ul><li>a</ul>")) for i in range(5)]
    rows = [(k, f"http://{h}/x", page) for h, own in real.items() for k, page in own]
    plain = pages(spark, rows).select(pt.host_of(pt.F.col("url")).alias("pt_host"), pt.F.col("html").alias("pt_html"))
    got = {}
    for r in pt.templates(plain).collect():
        got.setdefault(r.host, [set(), r.main])[0].add(r.token)
    texts = run(spark, rows)
    for (h, own), (valid, main, want) in zip(real.items(), brute([[p for _, p in own] for own in real.values()]), strict=True):
        assert tuple(got.get(h, [set(), 0])) == (valid, main), h
        assert [texts[k] for k, _ in own] == want
    assert texts[10**6 + 5] == "item 5 text 0 of 5 and more" and texts[2 * 10**6] in ("one a b", "one b a")


def test_the_template_decides(spark, sf):
    d = sf.replace("sf0.001", "sf0.01")
    rows = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html").collect()
    own = {r.page_id: r.text for r in pt.op7_page_text(spark, d).collect()}
    bare = {r.page_id: pt.main_text(r.html, pt.Template({})) for r in rows}
    assert sum(own[k] != bare[k] for k in own) > 0.95 * len(own)


def deduced(*pages_):
    """Texts of one host's pages, deduced without Spark."""
    return brute([list(pages_)])[0][2]


def test_odd_pages(spark):
    rows = [
        (1, None, None), (2, "", ""), (3, "http://b/", "plain &lt; text"), (4, "http://b/", "<p>a < b</p><!-- never closed <p>x</p>"), (5, "http://b/", "<script>never closed <p>x"),
        (6, "http://b/", "<div class='ad'>open<article>kept</article>"), (7, "http://b/", "<a href='x>y'>l</a> m"), (7, "http://b/", "<a href='x>y'>l</a> m"), (8, "http://c/", "<p>" * 3000 + "deep"),
    ]
    got = run(spark, rows)
    assert got == {1: "", 2: "", 3: "plain < text", 4: "a < b", 5: "", 6: "kept", 7: "l m", 8: "deep"}
    assert run(spark, []) == {}


def test_query_returns_code_points(spark, sf):
    for r in pt.op7_page_text(spark, sf).collect():
        assert r.n_chars == len(r.text) and "&amp;" not in r.text and r.text == " ".join(r.text.split())


def test_closing_tags_end_their_own_elements(spark):
    page = "<html><body><div id='page'><article><p>one {i}</p>{own}<p>three {i}</p></article><div class='ad'>buy</div></div></body></html>"
    rows = [(i, "http://a/x", page.replace("{own}", "".join(f"<div>two {j}.{i}</div>" for j in range(1 + i % 3))).replace("{i}", str(i))) for i in range(6)]
    assert run(spark, rows) == {i: " ".join([f"one {i}", *[f"two {j}.{i}" for j in range(1 + i % 3)], f"three {i}"]) for i in range(6)}


def test_elements_left_open_do_not_end_the_article():
    for page in (
        "<p>out<article>one <p>two</p></p> three</article>",  # the article ends the paragraph before it
        "<b>out<article>one</b> <p>two</p> three</article>",
        "<article>one<ul><li class='share'>x<li>two</ul>three</article>",
        "<article><span>one<p>two</span></p>three</article>",
    ):
        assert deduced(page)[0].split() == ["one", "two", "three"], page


def test_constant_slots_go_inside_an_article_too(spark):
    page = "<html><body><article><h1>story {i}</h1><div class='xq'><p>Get our app</p> <b>now</b></div><div class='lead'>By the way, <i>{i}</i></div><p>As always</p></article></body></html>"
    rows = [(i, "http://a/x", page.replace("{i}", str(i))) for i in range(6)]
    assert run(spark, rows) == {i: f"story {i} By the way, {i} As always" for i in range(6)}
    same = "<html><body><article><div class='xq'>whole text</div></article></body></html>"  # copies of a page keep their text
    assert run(spark, [(i, "http://a/x", same) for i in range(6)]) == dict.fromkeys(range(6), "whole text")


def test_captions_stay_and_raw_elements_end_where_they_do():
    for tag in ("<svg class='i' />", "<iframe src='x'/>", "<svg><text>no</text></svg>", "<noscript>", "<select>", "<template/>"):
        assert deduced(f"<article>one {tag} two<figure><img src='x'><figcaption>three</figcaption></figure></article>")[0] == "one two three", tag
    assert deduced("<article>one <script src='x'/> two</article>")[0] == "one"
