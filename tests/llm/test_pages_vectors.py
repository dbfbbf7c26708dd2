"""Page and vector operators against plain versions, and on odd tables."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapcast.llm import links, multi_index, templates, topk, url_lists
from tests.llm import brute

VECTORS = "vec_id bigint, embedding array<float>, label int"


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (300, 301), (301, 300)]
    got = dict(links.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect())
    expected = brute.components(400, pairs)
    assert got == {x: expected[x] for p in pairs for x in p if p[0] != p[1]}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16))
    points = np.concatenate([centres[rng.integers(0, 40, 500)] + rng.normal(size=(500, 16)) * rng.choice([0.1, 0.3], (500, 1)), rng.normal(size=(300, 16))])
    points = np.concatenate([points * rng.choice([0.2, 1, 1, 3], (800, 1)), points[:20]]).astype(np.float32)
    rows = [(i, [float(x) for x in p], 0) for i, p in enumerate(points)]
    return points.astype(float), spark.createDataFrame(rows, VECTORS).repartition(4)


def test_multi_index_links_match_all_pairs(vectors, monkeypatch):
    points, table = vectors
    monkeypatch.setattr(multi_index, "CELL", 20)
    monkeypatch.setattr(multi_index, "MEMBERS", 16)
    monkeypatch.setattr(multi_index, "VISITORS", 40)
    got = {r["vec_id"]: r for r in multi_index.near_duplicates(table).collect()}
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    found = sum(r["n_links"] for r in got.values())
    assert 0.98 * near.sum() <= found <= near.sum()
    assert all(got[i]["n_links"] <= n for i, n in enumerate(near.sum(1)))
    expected = brute.components(len(points), np.argwhere(near))
    assert np.mean([got[i]["component_id"] == c for i, c in enumerate(expected)]) > 0.98


def test_traversal_is_in_order_and_complete():
    rng = np.random.default_rng(0)
    a, b = rng.random(9), rng.random(7)
    cells = list(multi_index.traverse(a, b, 0.9))
    costs = [a[i] + b[j] for i, j in cells]
    assert costs == sorted(costs) and set(cells) == {(i, j) for i in range(9) for j in range(7) if a[i] + b[j] <= 0.9}


def test_top_k_matches_all_products(vectors, monkeypatch):
    points, table = vectors
    monkeypatch.setattr(topk, "BUCKET", 64)
    monkeypatch.setattr(topk, "QUERIES", 8)
    got = {}
    for r in topk.top_k(table, F.pmod("vec_id", F.lit(50)) == 0, 7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = np.floor(1024 * points).astype(np.int64)
    ids = np.arange(len(whole))
    assert len(got) == -(-len(whole) // 50)
    for q, found in got.items():
        scores = whole @ whole[q]
        order = [i for i in np.lexsort([ids, -scores]) if i != q][:7]
        assert sorted(found) == [(k + 1, i, scores[i]) for k, i in enumerate(order)]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, None, 0), (3, [0.0, 0.0], None), (4, [nan, 1.0], 0), (5, [1.0, None], 0),
            (6, [inf, 1.0], 0), (7, [], 0), (8, [1.0], 0), (9, [5.0, 0.1], 0), (None, [1.0, 0.0], 0), (0, [1.0, 0.0], 0)]
    table = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS cell", "2 AS score", "3 AS rank")
    got = sorted(multi_index.near_duplicates(table).collect(), key=str)
    assert len(got) == 12
    links_of = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got}
    assert links_of[0] == links_of[1] == links_of[9] == (3, 0) and links_of[None] == (0, None)
    assert all(links_of[i] == (0, i) for i in range(2, 9))
    best = topk.top_k(table, F.col("vec_id") >= 0).collect()
    assert {(r["query_id"], r["vec_id"]) for r in best} == {(a, b) for a in (0, 1, 3, 9) for b in (0, 1, 3, 9) if a != b}
    assert multi_index.near_duplicates(table.where("false")).count() == 0
    assert topk.top_k(table.where("false"), F.col("vec_id") == 0).count() == 0
    assert topk.top_k(table, F.lit(False)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">Accept</div>
<div class="sidebar"><p>Also</p></div><article><h1>Title &amp; more</h1><p>First  <b>bold</b>&nbsp;text<br>next &#233;<p>Second
line</p><!-- <p>hidden</p> --><div class="ad">Buy</div><p>Read on</p></article><section id="comments"><p>Nice!</p></section>
<form><p>Mail</p><textarea>x</textarea></form><footer>&copy; me</footer>"""


def test_main_text_of_a_page():
    assert templates.main_text(PAGE, frozenset()) == "Title & more\n\nFirst bold text next é\n\nSecond line\n\nRead on"
    plain = "<body><div id=menu>Menu</div><div><p>a &lt;b&gt;</p>tail<p>c</div><p class='comment'>no</p>"
    assert templates.main_text(plain, frozenset()) == "a <b>\n\ntail\n\nc"
    assert templates.main_text("", frozenset()) == "" and templates.main_text("just text", frozenset()) == "just text"


@pytest.mark.parametrize(
    "page,text",
    [
        ('<body class="home no-sidebar"><article><p>Whole</article></body>', "Whole"),
        ('<body class="has-sidebar"><article><p>Whole</article><div class="left-sidebar"><p>x</div></body>', "Whole"),
        ('<article class="post no-comments"><p>Whole</article>', "Whole"),
        ('<article><div class="post-header"><h1>Headline</h1></div><p>a</article>', "Headline\n\na"),
        ('<main><p>a</p><ol class="responses"><li>reader comment</li></ol></main>', "a"),
        ('<main><p>a</p><article class="comment"><p>reader</p></article></main>', "a"),
        ('<div class="site-header"><p>Site</div><div class="with-ads"><p>b</div><div class="ad-slot">Buy</div>', "b"),
    ],
)
def test_names_do_not_hide_pages(page, text):
    assert templates.main_text(page, frozenset()) == text


def test_templates_decide_on_most_hosts(spark):
    """Hosts whose menus bear no name: only their recurring texts tell them; odd pages do not turn that off."""
    rows, want = [], {}
    for h in range(6):
        for i in range(3 + h):
            page = f"<div><p>Shop {h}</p><p>Cart</p></div><div><p>Story {h}.{i}</p><p>More of {i}</p></div><div><p>Terms</p></div>"
            rows.append((100 * h + i, f"http://h{h}.example/{i}", page))
            want[100 * h + i] = f"Story {h}.{i}\n\nMore of {i}"
        rows += [(100 * h + 90, f"http://h{h}.example/e", ""), (100 * h + 91, f"http://h{h}.example/o", "<p>Other</p>")]
        want |= {100 * h + 90: "", 100 * h + 91: "Other"}
    # An article that all pages of a host share stays, and so does a page that has nothing but copies.
    rows += [(900 + i, "http://copies.example", "<div><p>Top</p></div><article><p>Same</p></article>") for i in range(9)]
    rows += [(950 + i, "http://plain.example", "<div><p>Same</p><p>text</p></div>") for i in range(9)]
    want |= {900 + i: "Same" for i in range(9)} | {950 + i: "Same\n\ntext" for i in range(9)}
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r["page_id"]: r["text"] for r in templates.extract(pages).collect()} == want
    # The deduction against one over whole pages in memory.
    found = {(r["host"], t) for r in templates.fixed_texts(templates.tokens(pages)).collect() for t in r["fixed"]}
    assert found == brute_template(rows)


def test_classes_are_ordered_and_nested(spark):
    """Texts that change places are no template, nor the smaller of two classes that interleave."""
    rows, want = [], {}
    for i in range(8):
        links = ["<p>Left</p>", "<p>Right</p>"][:: 1 if i % 2 else -1]
        rows.append((i, f"http://turns.example/{i}", f"<div><p>Shop</p>{''.join(links)}<p>Cart</p><p>Story {i}</p></div>"))
        want[i] = "\n\n".join([*(("Left", "Right") if i % 2 else ("Right", "Left")), f"Story {i}"])
        # Three tokens on all pages; two on the last five, now inside the first slot, now across two.
        small = ["<p>x</p>", "<p>y</p>"] if i > 2 else ["", ""]
        inner = [small[0] + small[1], ""] if i % 2 else small
        rows.append((10 + i, f"http://cross.example/{i}", f"<b>one</b><hr>{inner[0]}<b>two</b><hr>{inner[1]}<b>three</b><hr><p>Story {i}</p>"))
        want[10 + i] = "\n\n".join([*(("x", "y") if i > 2 else ()), f"Story {i}"])
        # The same, always in one slot.
        rows.append((20 + i, f"http://nest.example/{i}", f"<b>one</b><hr>{''.join(small)}<b>two</b><hr><b>three</b><hr><p>Story {i}</p>"))
        want[20 + i] = f"Story {i}"
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    assert {r["page_id"]: r["text"] for r in templates.extract(pages).collect()} == want


def brute_template(rows) -> set:
    """(host, text token) of classes of equal occurrence vectors, two tokens or more, on half of a host's pages."""
    out = set()
    for host in {u.split("/")[2] for _, u, _ in rows}:
        own = [templates.blocks(p) for _, u, p in rows if u.split("/")[2] == host]
        vectors: dict = {}
        for k, page in enumerate(own):
            for b in page:
                steps = b.path.split(">")
                for token in [("text", b.path, b.text), *(("path", ">".join(steps[:j])) for j in range(2, len(steps) + 1))]:
                    vectors.setdefault(token, [0] * len(own))[k] += token[0] == "text" or len(token[1].split(">")) == len(steps)
            vectors.setdefault(("path", ""), [0] * len(own))[k] = int(bool(page))
        seen = {t: [any((t[0] == "text" and (b.path, b.text) == t[1:]) or (t[0] == "path" and (b.path + ">").startswith(t[1] + ">")) or t == ("path", "") for b in p) for p in own] for t in vectors}
        for token, vector in vectors.items():
            alike = sum((v, seen[t]) == (vector, seen[token]) for t, v in vectors.items())
            if token[0] == "text" and alike >= 2 and sum(seen[token]) >= max(2, sum(map(bool, own)) / 2):
                out.add((host, templates.token_hash(*token[1:])))
    return out


def test_template_texts_leave_and_slots_stay(spark):
    rows = [(i, f"http://a.example/{i}", f"<body><div><p>Welcome</p><p>News {i}</p></div></body>") for i in range(12)]
    rows += [(100 + i, "http://b.example/x", "<body><p>Welcome</p></body>") for i in range(3)]
    rows += [(200, None, None), (201, "http://a.example/z", ""), (None, "nonsense", "<p>x"), (0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'h' AS host", "'f' AS fixed")
    found = templates.tokens(pages.where("html <> '' AND page_id < 100"))
    assert [r["token"] for r in found.where("kind = 'text'").where("pages > 1").join(found.where("path = ''").selectExpr("host", "vector"), ["host", "vector"]).collect()]
    got = templates.extract(pages).collect()
    texts = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and texts[201] == ""
    assert texts[3] == "News 3" and texts[100] == "Welcome" and texts[200] == "" and texts[None] == "x"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    nested = templates.templates(templates.tokens(pages)).where("host = 'a.example'").collect()
    assert any(">body>div" in p for r in nested for p in r["paths"])
    assert templates.extract(pages.where("false")).count() == 0


def test_lists_hold_while_active(spark):
    day = lambda d: dt.date(2024, *d)
    events = [("domain", "example.org", "ads", "add", day((1, 5))), ("domain", "example.org", "ads", "remove", day((2, 10))),
              ("domain", "example.org", "ads", "add", day((2, 10))), ("domain", "example.org", "ads", "remove", day((3, 1))),
              ("prefix", "b.net/x/y", "spam", "add", day((1, 1))), ("host", "c.net", "bad", "add", None), (None, "c.net", "bad", "add", day((1, 1)))]
    events = spark.createDataFrame(events, "kind string, pattern string, category string, action string, day date")
    captures = [(1, "https://A.Example.org/p", day((1, 4))), (2, "https://a.example.org/p", day((1, 5))), (3, "http://u@example.org:80/", day((2, 10))),
                (4, "http://example.org", day((3, 1))), (5, "http://b.net/x/y/z?q", day((12, 31))), (6, "http://b.net/x/yy", day((6, 1))),
                (7, None, day((6, 1))), (8, "nonsense", day((6, 1))), (9, "http://example.org", None), (2, "https://a.example.org/p", day((1, 5))),
                (None, "http://b.net/x/y", day((6, 1))), (10, "http://notexample.org/", day((1, 6)))]
    captures = spark.createDataFrame(captures, "page_id bigint, url string, day date").selectExpr("*", "1 AS kind", "2 AS month")
    got = {r["page_id"]: r for r in url_lists.evaluate(captures, events).collect()}
    assert {i for i, r in got.items() if r["blocked"]} == {2, 3, 5, None}
    assert got[2]["n_captures"] == 2 and got[5]["categories"] == "spam" and got[1]["n_active"] == 0 and len(got) == 11
    assert url_lists.evaluate(captures.where("false"), events).count() == 0
    assert url_lists.evaluate(captures, events.where("false")).where("blocked").count() == 0


def test_hot_host_is_judged_like_the_rest(spark):
    rng = random.Random(3)
    day = dt.date(2024, 1, 1)
    rows = [(i, f"http://{'hot' if rng.random() < 0.6 else rng.randrange(9)}.net/a/{i % 4}", day + dt.timedelta(rng.randrange(300))) for i in range(800)]
    events = [("prefix" if i % 2 else "host", f"{rng.choice(['hot', 1, 2])}.net" + ("/a" if i % 2 else ""), f"c{i % 3}", rng.choice(["add", "remove"]), day + dt.timedelta(rng.randrange(300))) for i in range(300)]
    got = url_lists.evaluate(
        spark.createDataFrame(rows, "page_id bigint, url string, day date"),
        spark.createDataFrame(events, "kind string, pattern string, category string, action string, day date"),
    )
    states = {}
    for kind, pattern, category, action, d in events:
        states.setdefault((kind, pattern, category), {}).setdefault(d, set()).add(action)
    for r in got.collect():
        host = r["url"].split("/")[2]
        active = []
        for (kind, pattern, category), days in states.items():
            past = [d for d in days if d <= r["day"]]
            if pattern == (host if kind == "host" else f"{host}/a") and past and "add" in days[max(past)]:
                active.append(category)
        assert (r["n_active"], r["categories"]) == (len(active), ",".join(sorted(set(active))))
