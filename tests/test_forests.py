"""Graphs by joins, against the same found in one place; many random graphs at once, each a run of its own."""

import random

import pandas as pd
import pytest
from pagetide.operators import forests, graph
from pyspark.sql import functions as F

ARCS = "run_id long, source_id long, target_id long"
NODES = "run_id long, page_id long"


def random_graphs(seed, n=40):
    rnd = random.Random(seed)
    out = {}
    for run in range(n):
        size = rnd.randrange(1, 25)
        ids = rnd.sample(range(1, 100), size)
        density = rnd.choice([0.5, 1, 1.5, 3])
        arcs = {(rnd.choice(ids), rnd.choice(ids)) for _ in range(int(size * density))}
        if run % 4 == 0:  # a long way, with some ways back
            arcs |= set(zip(ids, ids[1:], strict=False)) | {(rnd.choice(ids), ids[0])}
        out[run] = (ids, {v: sorted(b for a, b in arcs if a == v) for v in ids})
    return out


def tables(spark, graphs):
    nodes = spark.createDataFrame([(run, v) for run, (ids, _) in graphs.items() for v in ids], NODES)
    arcs = spark.createDataFrame([(run, v, w) for run, (_, out) in graphs.items() for v, to in out.items() for w in to], ARCS)
    return nodes, arcs


def test_components_and_sinks(spark):
    graphs = random_graphs(1)
    nodes, arcs = tables(spark, graphs)
    parts = forests.components(nodes, arcs).cache()
    got = {}
    for r in parts.collect():
        got.setdefault((r.run_id, r.component), set()).add(r.page_id)
    want, ends = {}, {}
    for run, (ids, out) in graphs.items():
        for part in graph.strong_components(ids, out):
            want[run, min(part)] = set(part)
            if all(w in part for v in part for w in out[v]):
                ends[run, min(part)] = (len(part), len(part) > 1 or part[0] in out[part[0]])
    assert got == want and max(map(len, want.values())) > 5
    assert {(r.run_id, r.component): (r.pages, r.cycle) for r in forests.sinks(parts, arcs).collect()} == ends


def test_dominators(spark):
    graphs = random_graphs(2)
    nodes, arcs = tables(spark, graphs)
    start = nodes.groupBy("run_id").agg(F.min("page_id").alias("page_id"))
    tree = forests.dominators(forests.reachable(start, arcs), arcs)
    got = {(r.run_id, r.page_id): r.size - 1 for r in forests.subtree_sizes(tree).collect()}
    want = {}
    for run, (ids, out) in graphs.items():
        whole = set(graph.reach(min(ids), out))
        want |= {(run, v): len(whole - {v} - set(graph.reach(min(ids), out, v))) if v != min(ids) else len(whole) - 1 for v in whole}
        assert {v: n for (r, v), n in want.items() if r == run} == graph.stranded(min(ids), out)
    assert got == want


def test_dominators_of_a_ladder(spark):
    """Two long sides whose rungs lead to and fro: moves wait for each other."""
    n = 20
    arcs = [(0, 1), (0, 101)] + [(a, a + 1) for side in (0, 100) for a in range(side + 1, side + n)] + [(k, 100 + k + 2) for k in range(1, n - 2, 7)] + [(100 + k, k + 3) for k in range(2, n - 3, 5)]
    out = {v: sorted(b for a, b in arcs if a == v) for v in {x for a in arcs for x in a}}
    rows = spark.createDataFrame([(1, a, b) for a, b in arcs], ARCS)
    tree = forests.dominators(forests.reachable(spark.createDataFrame([(1, 0)], NODES), rows), rows)
    assert {r.page_id: r.size - 1 for r in forests.subtree_sizes(tree).collect()} == graph.stranded(0, out)


def test_forest(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for run in range(40):
        ids = rnd.sample(range(1, 200), rnd.randrange(1, 40))
        parents = {v: rnd.choice([None, *ids, *ids]) for v in ids}
        if run % 5 == 0:
            parents = dict(zip(ids, [*ids[1:], ids[0]], strict=True))  # one cycle of all
        if run % 5 == 1:
            parents = dict(zip(ids, [*ids[1:], None], strict=True))  # one chain
        sequence = dict(zip(rnd.sample(ids, len(ids)), range(1, len(ids) + 1), strict=True))
        rows += [(run, v, sequence[v], p) for v, p in parents.items()]
        up = graph.unlooped(parents, sequence)
        for v in ids:
            w, level = v, 0
            while up[w] is not None:
                w, level = up[w], level + 1
            want[run, v] = (up[v], w, level)
    found = forests.levels(forests.loops_cut(spark.createDataFrame(rows, "run_id long, page_id long, sequence_number int, parent_id long")))
    assert {(r.run_id, r.page_id): (r.parent_id, r.root_id, r.level) for r in found.collect()} == want


def test_long_chain(spark):
    """Hundred thousand pages in a row take as many rounds as their number has digits in base two."""
    n = 100_000
    chain = spark.range(1, n + 1).select(F.lit(1).cast("long").alias("run_id"), F.col("id").alias("page_id"), F.col("id").cast("int").alias("sequence_number"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent_id"))
    out = forests.levels(forests.loops_cut(chain))
    assert tuple(out.agg(F.count("*"), F.max("level"), F.min("root_id"), F.max("root_id"), F.max(F.col("page_id") - F.col("level"))).first()) == (n, n - 1, 1, 1, 1)
    sizes = forests.subtree_sizes(chain)
    assert sizes.where(F.col("size") != n + 1 - F.col("page_id")).isEmpty()
    ring = chain.withColumn("parent_id", F.coalesce("parent_id", F.lit(n)))
    assert [tuple(r) for r in forests.loops_cut(ring).where("parent_id IS NULL").select("page_id").collect()] == [(1,)]


def test_nearest_rank(spark):
    import math

    rnd = random.Random(4)
    values = {run: [rnd.randrange(6) for _ in range(rnd.randrange(1, 40))] for run in range(30)}
    rows = spark.createDataFrame([(run, v) for run, own in values.items() for v in own], "run_id long, v int")
    for part in (0.2, 0.9):
        want = {run: (len(own), sorted(own)[math.ceil(part * len(own)) - 1]) for run, own in values.items()}
        assert {r.run_id: (r.n, r.bar) for r in forests.nearest_rank(rows, "v", part, "bar").collect()} == want


def crawls(spark, graphs, seed):
    rnd = random.Random(seed)
    rows = []
    for run, (ids, out) in graphs.items():
        for k, v in enumerate(ids):
            outcome = "html" if rnd.random() < 0.9 else "http_error"
            rows.append((run, v, k + 1, f"/{v}", rnd.randrange(9), outcome, None, [f"/{w}" for w in out[v]] if outcome == "html" else None))
    return spark.createDataFrame(rows, "run_id long, page_id long, sequence_number int, url string, depth int, outcome string, http_status int, internal_links array<string>")


def test_signals_ranks_and_trees_of_large_runs(spark, monkeypatch):
    """Runs that no task may hold have the signals, ranks and trees that they would have in a task."""
    pages = crawls(spark, random_graphs(5, 14), 6).cache()
    e = graph.edges(pages).cache()
    nodes, arcs = graph.html_graph(pages, e)
    ranks = graph.pagerank(nodes, arcs).cache()
    columns = ["run_id", "page_id", "signals", "dead_end_is_page", "stranded"]
    small = graph.signals(pages, e, ranks).cache()
    trees = sorted(map(tuple, graph.tree(pages, e).collect()), key=str)
    want = sorted(map(str, small.select(*columns).collect()))
    traps = {(r.run_id, r.page_id): min(r.cycle, default=None) for r in small.collect()}
    seen = {s for r in small.collect() for s in r.signals}
    assert seen == set(graph.SIGNALS)
    assert {(r.run_id, r.page_id): r.trap for r in graph.large_signals(pages, e, ranks).collect()} == traps
    monkeypatch.setattr(graph, "HELD_PAGES", 10)  # some runs go one way, some the other
    assert sorted(map(str, graph.signals(pages, e, ranks).select(*columns).collect())) == want
    assert sorted(map(tuple, graph.tree(pages, e).collect()), key=str) == trees
    near = {(r.run_id, r.page_id): r.pagerank for r in graph.pagerank(nodes, arcs, tolerance=1e-6).collect()}
    assert all(near[r.run_id, r.page_id] == pytest.approx(r.pagerank, abs=1e-5) for r in ranks.collect())


def test_a_run_of_many_pages(spark):
    """Over 200,000 pages: sections of ten pages in a ring, whose first pages hang on the start."""
    n, section = 200_501, 10
    ids = spark.range(1, n + 1).withColumnRenamed("id", "page_id")
    head = (F.col("page_id") - 2) % section == 0
    ring = F.when((F.col("page_id") - 1) % section == 0, F.col("page_id") - section + 1).otherwise(F.col("page_id") + 1)
    links = F.when(F.col("page_id") == 1, F.transform(F.sequence(F.lit(2), F.lit(n), F.lit(section)), lambda x: x)).otherwise(F.array(F.least(ring, F.lit(n)).cast("int")))
    pages = ids.select(F.lit(1).cast("long").alias("run_id"), "page_id", F.col("page_id").cast("int").alias("sequence_number"), F.concat(F.lit("/"), F.col("page_id")).alias("url"), F.when(head, 1).otherwise(2).alias("depth"), F.lit("html").alias("outcome"), F.lit(None).cast("int").alias("http_status"), F.transform(links, lambda x: F.concat(F.lit("/"), x)).alias("internal_links"))
    e = graph.edges(pages)
    found = graph.signals(pages, e).cache()
    whole = (n - 1) // section
    traps = found.where(F.array_contains("signals", "cycle_trap"))
    assert found.count() == n and traps.count() == whole * section and traps.where("cycle IS NOT NULL").isEmpty()
    assert found.where(F.array_contains("signals", "bottleneck")).isEmpty() and found.where(F.array_contains("signals", "island")).isEmpty()


def test_empty_graphs(spark):
    nodes, arcs = spark.createDataFrame([], NODES), spark.createDataFrame([], ARCS)
    assert forests.components(nodes, arcs).isEmpty() and forests.dominators(forests.reachable(nodes, arcs), arcs).isEmpty()
    assert forests.levels(nodes.withColumn("parent_id", F.lit(None).cast("long"))).isEmpty()
    alone = graph.large_signals(crawls(spark, {1: ([5], {5: []})}, 1), graph.edges(crawls(spark, {1: ([5], {5: []})}, 1)))
    assert alone.first().signals == ["dead_end"] and pd.isna(alone.first().trap)
