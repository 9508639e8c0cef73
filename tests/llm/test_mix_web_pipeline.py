import gzip
import hashlib
import random
from html import unescape

import corpus_pipeline
import duckdb
import pytest
from pagetide.llm import bpe, exact_dedup, html_extract, mixing, quality, queries, simhash, warc
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, source string"


def brute_targets(size, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, held = share * sum(size.values()), {}
    while True:
        free = [s for s in names if s not in held]
        left = total - sum(held.values())
        part = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: cap * size[s] for s in free if part[s] > cap * size[s] + 1e-9}
        if not over:
            return {**held, **part}
        held |= over


def corpus(n=900, seed=0, hot=0.4):
    rnd = random.Random(seed)
    sources = ["b", "a", "Z", "ä", "中", None]
    return [(i, "w " * rnd.randrange(1, 60), "hot" if rnd.random() < hot else rnd.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("flight", [50_000, 50])
def test_mix(spark, monkeypatch, flight):
    monkeypatch.setattr(mixing, "FLIGHT", flight)
    rows = corpus() + [(1000, None, "a"), (1001, "", "void"), (1002, None, None), (1003, "x " * 3000, "big")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"size": F.lit("s"), "unit": F.lit(1), "grp": F.lit(2), "p": F.lit(3), "taken": F.lit(4)})
    out = {r.doc_id: r for r in mixing.mix(docs).collect()}
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    want = brute_targets(size)
    assert len(out) == len(rows)
    for i, t, s in rows:
        r = out[i]
        assert r.size == len((t or "").split()) and r.source_size == size[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken in (0, r.size, 2 * r.size)
    for s, aim in want.items():
        got = sum(out[i].taken for i, _, x in rows if x == s)
        assert abs(got - aim) <= 60 or s == "big"
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {i: r.taken for i, r in out.items()}


def test_mix_balances_documents_too(spark):
    rows = [(i, "w " * (1 + i % 50), f"s{i % 2}") for i in range(2000)]
    out = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    for s in ("s0", "s1"):
        own = [r for r in out if r.source == s]
        assert abs(sum(r.copies for r in own) - len(own) * own[0].target / own[0].source_size) <= 3


def test_mixed_rows(spark):
    rows = corpus(200) + [(5, "w w", "hot"), (7, None, "hot")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("c") for c in ("copies", "__id", "__copies", "c0", "unit", "rows", "whole", "more", "id", "of", "digest", "place", "copy")})
    out = mixing.mixed(docs)
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert out.columns == docs.columns and set(counts.values()) <= {1, 2, 3, 4} and 7 in counts
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.mix(docs.withColumn("text", F.lit(""))).agg(F.sum("taken")).first()[0] == 0


def test_mix_of_repeated_rows(spark, monkeypatch):
    """Each row gives one, with its own size; rows alike are taken as often as their share, not all or none."""
    monkeypatch.setattr(mixing, "STEP", 7)
    rows = [(1, "a b c", "s")] * 500 + [(2, "d e f", "t")] * 2 + [(i, "g h", "t") for i in range(10, 200)] + [(3, "", "u")] * 3
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows) and {r.size for r in out if r.doc_id in (1, 2)} == {3} and all(r.taken <= 2 * r.size for r in out)
    size = {"s": 1500, "t": 386, "u": 0}
    want = brute_targets(size)
    for s, aim in want.items():
        own = [r for r in out if r.source == s]
        assert {r.source_size for r in own} == {size[s]} and abs(sum(r.taken for r in own) - aim) <= 6
    more = docs.withColumn("k", F.monotonically_increasing_id())
    taken = mixing.mixed(more)
    assert taken.columns == more.columns
    assert sorted(r.doc_id for r in taken.collect()) == sorted(r.doc_id for r in out for _ in range(r.copies))
    first = {r.k: r["count"] for r in taken.where("doc_id = 1").groupBy("k").count().collect()}
    assert max(first.values()) - min(first.values()) <= 1


def test_flight_keeps_sums():
    rnd = random.Random(7)
    for n in (0, 1, 2, 3, 50, 500):
        p, s = [0.37] * n, [float(rnd.randrange(1, 9)) for _ in range(n)]
        decided, moves = [], mixing.flight(p, s, [rnd.random() for _ in range(n)])
        while True:
            try:
                decided.append(next(moves))
            except StopIteration as end:
                ids, q, sizes, _ = end.value
                break
        assert len(ids) <= 2 and len(decided) + len(ids) == n
        assert abs(sum(t for _, t in decided) + sum(q) - sum(p)) < 1e-6
        assert abs(sum(s[i] for i, t in decided if t) + sum(a * b for a, b in zip(q, sizes, strict=True)) - sum(a * b for a, b in zip(p, s, strict=True))) < 1e-5


def test_flight_is_fair():
    taken = [0] * 6
    for k in range(3000):
        rnd = random.Random(k)
        moves = mixing.flight([0.5] * 6, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [rnd.random() for _ in range(6)])
        while True:
            try:
                i, t = next(moves)
                taken[i] += t
            except StopIteration as end:
                for i, q in zip(*end.value[:2], strict=True):
                    taken[i] += q
                break
    assert all(abs(t / 3000 - 0.5) < 0.05 for t in taken)


PAGES = "page_id long, url string, html string"
LONG = "<p>" + "ä text " * 300
WEB = [(1, "http://a/x?y#z", LONG), (2, "http://b/", LONG), (3, "http://c/", "short"), (4, "http://d/", "short"), (5, None, None), (6, "bad\r\nurl", ""), (7, "u", "WARC/1.1\r\n\r\n\r\nContent-Length: 5\r\n\r\n" * 50), (8, "u", LONG), (None, "v", "no id")]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_round_trip(spark, tmp_path, compression):
    pages = spark.createDataFrame(WEB, PAGES).withColumns({"id": F.lit(1), "digest": F.lit(2), "payload": F.lit(3)}).repartition(3)
    warc.write_archives(pages, str(tmp_path / "w"), compression=compression)
    records = warc.read_records(spark, str(tmp_path / "w"))
    assert {r.kind: r["count"] for r in records.groupBy("kind").count().collect()} == {"request": 9, "metadata": 9, "response": 7, "revisit": 2}
    whole = warc.assemble(records)
    by = {r.metadata.fields.split("\r\n")[0].removeprefix("page-id: "): r for r in whole.collect()}
    assert len(by) == 9 and all(r.request and r.metadata for r in by.values())
    for i, _, html in WEB:
        r = by["" if i is None else str(i)]
        payload = (html or "").encode()
        assert r.response.payload_digest == "sha1:" + hashlib.sha1(payload).hexdigest()
        if i in (1, 2):
            assert r.response.kind == "revisit" and r.response.refers_to == by["8"].record_id and bytes(r.response.payload) == b""
        else:
            assert r.response.kind == "response" and bytes(r.response.payload) == payload


def test_warc_of_other_writers():
    record = lambda kind, block, extra=b"": b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nContent-Length: %d\r\n" % len(block) + extra + b"\r\n" + block + b"\r\n\r\n"
    data = b"".join(gzip.compress(record(k, b)) for k, b in ((b"warcinfo", b"x"), (b"response", b"\r\n\r\n"), (b"response", b"")))
    assert [(k, b) for k, _, b in warc.parsed(warc.unzipped(data))] == [("warcinfo", b"x"), ("response", b"\r\n\r\n"), ("response", b"")]
    assert list(warc.parsed([])) == list(warc.parsed([b""])) == list(warc.parsed([b"\r\n"])) == []
    for broken in (b"not a record", record(b"response", b"12345")[:-6], b"WARC/1.0\r\nContent-"):
        with pytest.raises(ValueError):
            list(warc.parsed([broken]))
    with pytest.raises(ValueError):
        list(warc.unzipped(data[: len(data) - 3]))


@pytest.mark.parametrize("step", [1, 7, 100, 10**6])
def test_records_in_pieces(step, monkeypatch):
    """Records come whole, however the archive's bytes are cut; little more than a record is held at a time."""
    monkeypatch.setattr(warc, "CHUNK", 64)
    blocks = [b"x" * 500, b"", b"\r\n\r\nWARC/1.0\r\n", b"y" * 3]
    data = b"".join(b"WARC/1.0\r\nWARC-Type: t\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(x), x) for x in blocks)
    assert [x for _, _, x in warc.parsed(data[i : i + step] for i in range(0, len(data), step))] == blocks
    pieces = list(warc.unzipped(gzip.compress(data) + gzip.compress(data)))
    assert b"".join(pieces) == data + data and max(map(len, pieces)) <= 64


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 10_000)
    pages = spark.createDataFrame([(i, "u", f"{i}" * 3000) for i in range(1, 9)], PAGES).coalesce(1)
    warc.write_archives(pages, str(tmp_path / "w"))
    assert len(list((tmp_path / "w").glob("part*"))) >= 3 and warc.transactions(spark, str(tmp_path / "w")).count() == 8


def test_large_pages_that_lie_together(spark, tmp_path, monkeypatch):
    """Many small pages and some neighbouring large ones: by their mean, all large ones would go to one archive."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 40_000)
    rows = [(i, f"https://e.org/{i}", f"{i} " * (4000 if 50 <= i < 70 else 5)) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "w"), compression="none")
    sizes = [p.stat().st_size for p in (tmp_path / "w").glob("part*")]
    largest = max(len(r[2]) for r in rows)
    assert max(sizes) < 2 * (40_000 + largest) and len(sizes) >= sum(len(r[2]) for r in rows) // (40_000 + largest)
    got = warc.transactions(spark, str(tmp_path / "w"))
    assert sorted(bytes(r.response.payload).decode() for r in got.collect()) == sorted(r[2] for r in rows)


def test_warc_of_no_pages(spark, tmp_path):
    spark.createDataFrame([], PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.op7_warc(spark, str(tmp_path)).count() == 0


def test_assembly_of_stray_records(spark):
    names = "record_id string, kind string, uri string, concurrent_to string, content_type string, block_bytes long, fields string"
    rows = [("r1", "response", "u", None, "", 1, None), ("q2", "request", "u", "r1", "", 1, None), ("q1", "request", "u", "r1", "", 1, None), ("m", "metadata", "u", "other", "", 1, "f"), ("i", "warcinfo", None, None, "", 1, None)]
    out = warc.assemble(spark.createDataFrame(rows, names)).collect()
    assert [(r.record_id, r.request.record_id, r.metadata) for r in out] == [("r1", "q1", None)]


def test_native_sql_oracles(spark):
    for sf in ("/root/testdata/sf0.001",):
        c = duckdb.connect()
        for name in ("documents", "pages", "labels"):
            c.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
        for name, sql in queries.ORACLE_SQL.items():
            df = queries.QUERIES[name](spark, sf)
            cursor = c.execute(sql)
            order = [[d[0] for d in cursor.description].index(x) for x in df.columns]
            assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in cursor.fetchall())


PAGE = """<!DOCTYPE html><html lang=en><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header>Site</header><nav><ul><li><a href=/a>Home</a><li><a href=/b>More</a></ul></nav><!-- ad <p>x</p> -->
<div class="ad">Buy &amp; win.</div><div id="cookie-notice"><p>We use cookies, lots of them, as everyone does.</p></div><article><h1>A&nbsp;title &lt;1&gt;</h1><p><b>First   para&#233;<br>goes on<p>Be.<div class="share-buttons">Tweet</div><p>Third <a href=x>link</a>, &am; end</p>
<section id="comments"><article><p>I agree with all of that, it is well said indeed, my friend.</p></article></section></article><aside>Related</aside><form><label>Mail</label></form><footer>&copy; 2026</footer>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "A title <1>\nFirst paraé goes on\nBe.\nThird link, &am; end"
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<nav>x</nav>") == html_extract.main_text("<p>") == ""


def test_main_text_without_marks():
    prose = "This is a paragraph of plain text that goes on for long enough to be read by someone."
    page = f"<ul><li><a href=1>Home</a><li><a href=2>News</a></ul><div><p>{prose}</p><p>{prose}</p></div><div><a href=3>Terms</a></div>"
    assert html_extract.main_text(page) == f"{prose}\n{prose}"


@pytest.mark.parametrize("html", ["<", "<p", "</p>", "<!--", "<script>", "a<b>c</i>d", "<p>" * 3000, "&" * 1000, '<a href="x>y', "<td><li><p></ul>t", "x" * 10**6, "\x00<p>퟿", "<!", "</", "<a =b>", "<a b='", "<select>x", "</p></div>x"])
def test_broken_html(html):
    assert isinstance(html_extract.main_text(html), str)


def all_elements(e):
    return [e, *(x for u in e.units if isinstance(u, html_extract.Element) for x in all_elements(u))]


def random_tree(rnd, blocks):
    """A tree of containers with blocks, some of them empty."""
    marks = [html_extract.NEUTRAL, html_extract.LOOSE, html_extract.NAMED, (3.0, 0.5, 1.25)]
    root = html_extract.Element("", None)
    homes = [root]
    for _ in range(rnd.randrange(4)):
        e = html_extract.Element("x", rnd.choice(homes), rnd.choice(marks))
        e.parent.units.append(e)
        homes.append(e)
    for _ in range(blocks):
        home = rnd.choice(homes)
        home.units.insert(rnd.randrange(len(home.units) + 1), html_extract.Block(home))
    found = []

    def walk(e):
        for u in e.units:
            if isinstance(u, html_extract.Element):
                walk(u)
            elif rnd.random() < 0.9:
                u.place = len(found)
                found.append(u)

    walk(root)
    return root, found


def test_cut_is_minimal():
    """Against all labellings of all blocks and containers of small trees."""
    from itertools import product

    rnd = random.Random(8)
    for _ in range(120):
        root, blocks = random_tree(rnd, rnd.randrange(1, 6))
        costs = [(rnd.randrange(10) / 4, rnd.randrange(10) / 4 + rnd.random() / 100) for _ in blocks]
        inside = lambda e: [b for b in e.units if isinstance(b, html_extract.Block) and b.place >= 0] + [b for u in e.units if isinstance(u, html_extract.Element) for b in inside(u)]  # noqa: E731, B023
        live = [e for e in all_elements(root) if inside(e)]
        number = {id(e): k for k, e in enumerate(live)}
        path = lambda b: [e for e in iterate(b.home)]

        def iterate(e):
            while e:
                yield e
                e = e.parent

        bare = {id(e): e.mark[:2] == (0.0, 0.0) and sum(isinstance(u, html_extract.Block) and u.place >= 0 or isinstance(u, html_extract.Element) and id(u) in number for u in e.units) == 1 for e in live}
        n = len(blocks)
        edges = []
        for e in live:
            for u in e.units:
                if isinstance(u, html_extract.Block):
                    if u.place >= 0:
                        edges.append((n + number[id(e)], u.place, e.mark[2]))
                elif id(u) in number:
                    edges.append((n + number[id(e)], n + number[id(u)], max(e.mark[2], u.mark[2]) if u.mark[0] == 0 else e.mark[2]))
        for x, y in zip(blocks, blocks[1:], strict=False):
            above = {id(e) for e in path(y)}
            common = next(e for e in path(x) if id(e) in above)
            between = sum(not bare[id(e)] for b in (x, y) for e in list(iterate(b.home))[: [id(z) for z in iterate(b.home)].index(id(common))])
            edges.append((x.place, y.place, html_extract.ADJACENT / (1 + between)))
        terminals = costs + [(e.mark[1], e.mark[0]) for e in live]
        cost = lambda labels, t=terminals, edges=edges: sum(b if x else c for x, (c, b) in zip(labels, t, strict=True)) + sum(w for i, j, w in edges if labels[i] != labels[j])
        best, ends = min(map(cost, product([0, 1], repeat=n + len(live)))), html_extract.cut(root, costs)
        assert abs(min(cost((*map(int, ends), *rest)) for rest in product([0, 1], repeat=len(live))) - best) < 1e-9


PROSE = "This is a paragraph of plain text that goes on for long enough to be read by someone."


@pytest.mark.parametrize("name", ["story-notice", "related-work", "popup-museum", "no-comments", "banner-years"])
def test_sections_of_an_article_stay(name):
    page = f'<div class="sidebar"><p>{PROSE}</p></div><article><p>Start.</p><section class="{name}"><h2>Head</h2><p>{PROSE}</p><p>Short.</p></section><table><tr><td>1 | 2<td>3</table><p>End.</p></article>'
    assert html_extract.main_text(page) == f"Start.\nHead\n{PROSE}\nShort.\n1 | 2\n3\nEnd."


@pytest.mark.parametrize("name", ["comments", "user-comments", "article-comments", "ad", "cookie-notice", "share-buttons", "post-footer", "related", "newsletter-form"])
def test_boilerplate_in_an_article_goes(name):
    inner = "".join(f"<li><a href=x>More</a> {name}</li>" for _ in range(8)) if name == "related" else f"<p>{PROSE}</p>" * 9
    assert html_extract.main_text(f'<main><p>Start.</p><div id="{name}"><div>{inner}</div></div><p>End.</p></main>') == "Start.\nEnd."


def test_no_markup_in_the_text():
    assert html_extract.main_text(f'<article><p>See <a href="x>broken</a> now. {PROSE}') == f"See broken now. {PROSE}"
    assert html_extract.main_text(f'<article><p title="a > b" class=x>One <b title=\'<p>"\'>two</b><br/>three<img alt="x>y"> &lt;p&gt; 1 < 2</article>') == "One two three <p> 1 < 2"
    assert html_extract.main_text("<article><p hidden>no<p>yes<div style='display: none'><p>no</div></article>") == "yes"


@pytest.mark.parametrize(
    "part",
    ["<div>Some plain words here</div>", "<a ", '<a href="x ', "<p a=\' ", "<div>", "<p><center>", "<button>x", "<select>", "<ul><li>x", "<!-- ", "<a b='", "<p>x</q></u></section>", "<table><td>x", "<article><p>x"],
)
def test_time_grows_as_the_page(part):
    import time

    html_extract.main_text(part * 100)
    began = time.perf_counter()
    html_extract.main_text(part * 20_000)
    assert time.perf_counter() - began < 10  # a quadratic way takes minutes


def test_the_cut_decides():
    """Pages whose article element is made a div: what the classifier says of each block alone is nearly never the article; the cut is."""
    import re

    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    x, y = [], []
    for r in rows[::2]:
        for b in html_extract.units_of(r["html"])[1]:
            x.append(html_extract.figures(b))
            y.append(html_extract.in_article(b))
    import numpy as np

    weights = html_extract.fit(np.array(x), np.array(y)).tolist()
    alone = together = 0
    for r in rows[1::2]:
        want = html_extract.main_text(r["html"])
        root, blocks = html_extract.units_of(re.sub("(</?)article>", r"\1div>", r["html"]))
        costs = [html_extract.capacities(b, weights) for b in blocks]
        alone += "\n".join(b.text for b, (c, d) in zip(blocks, costs, strict=True) if c > d) == want
        together += "\n".join(b.text for b, z in zip(blocks, html_extract.cut(root, costs), strict=True) if z) == want
    assert together >= 0.95 * 125 and alone <= 0.2 * 125


def test_fit_without_labels():
    import numpy as np

    x = np.ones((5, len(html_extract.FIGURES)))
    for y in (np.ones(5, bool), np.zeros(5, bool), np.zeros(0, bool)):
        assert html_extract.fit(x[: len(y)], y).tolist() == html_extract.START_WEIGHTS.tolist()


def test_extract(spark):
    rows = [(1, "u", PAGE), (None, None, None), (2, "v", ""), (2, "v", "")]
    out = html_extract.extract(spark.createDataFrame(rows, PAGES).withColumns({"text": F.lit("clash"), "n_chars": F.lit(1)})).collect()
    assert [(r.page_id, r.url, r.n_chars == len(r.text)) for r in out] == [(1, "u", True), (None, None, True), (2, "v", True), (2, "v", True)]
    assert html_extract.extract(spark.createDataFrame([], PAGES)).count() == 0
    few = spark.createDataFrame([(i, "u", PAGE) for i in range(50)], PAGES)
    assert html_extract.learn(few, rows=20).tolist() == html_extract.learn(few.repartition(3), rows=20).tolist() != html_extract.START_WEIGHTS.tolist()


def test_given_pages(spark):
    """The query against a plain reading of the pages' one template."""
    import re

    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html_extract.op9_html(spark, "/root/testdata/sf0.01").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in rows:
        blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        want = "\n".join(x for x in (" ".join(unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in blocks) if x)
        assert got[r.page_id] == (r.url, want, len(want))
    assert len(got) == len(rows)


def test_pipeline_by_stage(spark):
    """Each stage against a plain computation on its own input."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n.split()[0] for n in stages] == ["quality", "exact", "simhash", "mixing", "byte-level"]
    good = stages["quality classifier"](spark, docs, sf)
    verdict = {r.doc_id: r.predicted for r in quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert sorted(r.doc_id for r in good.collect()) == sorted(i for i, p in verdict.items() if p)
    once = stages["exact dedup"](spark, good, sf)
    best = {}
    for r in good.collect():
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in once.collect()) == sorted(best.values())
    apart = stages["simhash near-dedup"](spark, once, sf)
    groups = {r.doc_id: r.component_id for r in simhash.near_groups(once).collect()}
    assert sorted(r.doc_id for r in apart.collect()) == sorted(set(groups.values()))
    mix = stages["mixing sources"](spark, apart, sf)
    assert good.columns == once.columns == apart.columns == mix.columns == docs.columns
    copies = {r.doc_id: r.copies for r in mixing.mix(apart).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()} == copies
    out = corpus_pipeline.run(spark, sf)
    texts = {r.doc_id: r.text for r in docs.collect()}
    codec = bpe.codec(bpe.public_tokenizers.path(bpe.VOCABULARY), bpe.public_tokenizers.PATTERN)
    want = sorted((i, hashlib.sha256(codec.encode(texts[i])).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest()) for i, n in copies.items() for _ in range(n))
    assert sorted((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in out.collect()) == want


def test_pipeline_of_odd_rows(spark):
    rows = [(1, "a b c", "en", "s", 5), (None, None, None, None, None), (2, "", "en", None, 0), (2, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for d in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, "/root/testdata/sf0.001")
            d.count()
    assert exact_dedup.exact_dedup(docs).count() == 2
