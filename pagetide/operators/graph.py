"""Link graphs of crawl runs: edges and their states, degrees, PageRank, reachability, structural signals, spanning trees.

Pages are run_id, page_id, sequence_number, url, depth, outcome, http_status, internal_links (null unless outcome is html).
Whole-graph measures are joins that iterate. Ranks, signals and trees of runs that a task may hold are found run by run, those
of larger ones by joins.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.operators import forests
from pagetide.operators.forests import reachable
from pagetide.plans.storage import written
from pagetide.schemas import OUTCOMES

DAMPING = 0.85
TOLERANCE = 1e-12
MAX_ITERATIONS = 200
#: Signals in the order in which they are listed.
SIGNALS = ("low_connectivity", "dead_end", "island", "cycle_trap", "anomalous_depth", "bottleneck")
LEAST_PAGES = 10
LEAST_DEPTH = 5


def checked(pages: DataFrame) -> DataFrame:
    """pages, or an error for what can't be: a page twice by id, sequence or url, a negative depth, an unknown outcome, links without html or html without links."""
    wrong = (F.col("page_id") <= 0) | (F.col("sequence_number") <= 0) | (F.col("depth") < 0) | ~F.col("outcome").isin(*OUTCOMES) | ((F.col("outcome") == "html") != F.col("internal_links").isNotNull()) | F.exists(F.coalesce("internal_links", F.array()), lambda x: x.isNull() | (x == ""))
    bad = pages.where(F.coalesce(wrong, F.lit(True))).select(F.lit("a page's fields contradict each other").alias("m"))
    twice = [pages.groupBy("run_id", c).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(f"a run has a {c} twice").alias("m")) for c in ("page_id", "sequence_number", "url")]
    for x in twice:
        bad = bad.unionByName(x)
    if found := bad.limit(1).collect():
        raise ValueError(found[0]["m"])
    return pages


def link_state(found: Column, outcome: Column, status: Column) -> Column:
    return (
        F.when(found.isNull(), "unchecked")
        .when(outcome.isin("html", "non_html"), "available")
        .when((outcome == "http_error") & status.between(400, 599), "broken")
        .when(outcome.isin("forbidden", "redirect", "network_error", "timeout"), outcome)
        .otherwise("other")
    )


def edges(pages: DataFrame) -> DataFrame:
    """run_id, source_id, position, link, target_id, state: each link of a page once, where it first stands."""
    links = pages.where(F.col("internal_links").isNotNull()).select("run_id", F.col("page_id").alias("source_id"), F.posexplode(F.array_distinct("internal_links")).alias("position", "link"))
    targets = pages.select("run_id", F.col("url").alias("link"), F.col("page_id").alias("target_id"), "outcome", "http_status")
    joined = links.join(targets, ["run_id", "link"], "left")
    return joined.select("run_id", "source_id", "position", "link", "target_id", link_state(F.col("target_id"), F.col("outcome"), F.col("http_status")).alias("state"))


def degrees(pages: DataFrame, e: DataFrame) -> DataFrame:
    """run_id, page_id, outgoing, incoming, broken, unchecked."""
    out = e.groupBy("run_id", F.col("source_id").alias("page_id")).agg(F.count(F.lit(1)).alias("outgoing"), F.count_if(F.col("state") == "broken").alias("broken"), F.count_if(F.col("state") == "unchecked").alias("unchecked"))
    into = e.where(F.col("target_id").isNotNull()).groupBy("run_id", F.col("target_id").alias("page_id")).agg(F.count(F.lit(1)).alias("incoming"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return pages.select("run_id", "page_id").join(out, ["run_id", "page_id"], "left").join(into, ["run_id", "page_id"], "left").select("run_id", "page_id", *(zero(c) for c in ("outgoing", "incoming", "broken", "unchecked")))


def state_counts(e: DataFrame) -> DataFrame:
    return e.groupBy("run_id", "state").agg(F.count(F.lit(1)).alias("links"))


def among(e: DataFrame, chosen: DataFrame) -> DataFrame:
    """The edges of a selection: both ends belong to it."""
    ids = chosen.select("page_id")
    return e.join(ids.withColumnRenamed("page_id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("page_id", "target_id"), "target_id", "left_semi")


def html_graph(pages: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes run_id, page_id, sequence_number, depth, and edges run_id, source_id, target_id among html pages, each once."""
    nodes = pages.where("outcome = 'html'").select("run_id", "page_id", "sequence_number", "depth")
    ids = nodes.select("run_id", F.col("page_id").alias("target_id"))
    return nodes, e.where(F.col("target_id").isNotNull()).join(ids, ["run_id", "target_id"], "left_semi").select("run_id", "source_id", "target_id").distinct()


def site_ranks(ids: list[int], targets: list[list[int]], damping: float = DAMPING, tolerance: float = TOLERANCE, max_iterations: int = MAX_ITERATIONS) -> np.ndarray:
    """PageRank of one graph by power iteration; dead ends spread theirs evenly. Fails if the last step still moves more than tolerance."""
    n = len(ids)
    place = {v: i for i, v in enumerate(ids)}
    src = np.array([i for i, t in enumerate(targets) for _ in t], np.int64)
    dst = np.array([place[w] for t in targets for w in t], np.int64)
    out = np.bincount(src, minlength=n)
    rank = np.full(n, 1.0 / max(n, 1))
    for _ in range(max_iterations):
        got = np.bincount(dst, rank[src] / out[src], minlength=n) + rank[out == 0].sum() / n
        new = (1 - damping) / n + damping * got
        moved, rank = np.abs(new - rank).sum(), new
        if moved <= tolerance:
            return rank
    raise ValueError(f"PageRank didn't settle in {max_iterations} steps")


def pagerank(nodes: DataFrame, arcs: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, max_iterations: int = MAX_ITERATIONS) -> DataFrame:
    """run_id, page_id, pagerank: ranks within each run sum to 1. A run of up to HELD_PAGES pages is held in one task; larger ones go through large_pagerank()."""
    nodes, large = by_size(nodes)
    lists = arcs.groupBy("run_id", F.col("source_id").alias("page_id")).agg(F.sort_array(F.collect_list("target_id")).alias("targets"))
    rows = nodes.select("run_id", "page_id").join(lists, ["run_id", "page_id"], "left")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("page_id")
        targets = [[] if t is None else [int(x) for x in t] for t in pdf.targets]
        return pd.DataFrame({"run_id": pdf.run_id, "page_id": pdf.page_id, "pagerank": site_ranks([int(i) for i in pdf.page_id], targets, damping, tolerance, max_iterations)})

    ranks = rows.groupBy("run_id").applyInPandas(one, "run_id long, page_id long, pagerank double")
    if large is None:
        return ranks
    return ranks.unionByName(large_pagerank(large, arcs.join(large.select("run_id").distinct(), "run_id", "left_semi"), damping, tolerance, max_iterations))


def large_pagerank(nodes: DataFrame, arcs: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, max_iterations: int = MAX_ITERATIONS, steps: int = 6) -> DataFrame:
    """As pagerank(), by joins, for graphs of any size.

    Spreading the rank of dead ends evenly only scales the solution of x = 1 + damping * (what x sends along links), so x is
    iterated and scaled at the end: each step reads the last one once, and a job takes several steps.
    """
    out = arcs.groupBy("run_id", "source_id").agg(F.count(F.lit(1)).alias("out"))
    links = written(arcs.join(out, ["run_id", "source_id"]))
    x = written(nodes.select("run_id", "page_id", F.lit(1.0).alias("x"), F.lit(1.0).alias("moved")))
    ids = written(nodes.select("run_id", "page_id"))
    for i in range(1, max_iterations + 1):
        sent = links.join(x.select("run_id", F.col("page_id").alias("source_id"), "x", "moved"), ["run_id", "source_id"])
        # The step's change is what the last step's change sends.
        got = sent.groupBy("run_id", F.col("target_id").alias("page_id")).agg(F.sum(damping * F.col("x") / F.col("out")).alias("got"), F.sum(damping * F.col("moved") / F.col("out")).alias("went"))
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        x = ids.join(got, ["run_id", "page_id"], "left").select("run_id", "page_id", (1.0 + zero("got")).alias("x"), zero("went").alias("moved"))
        if i % steps == 0 or i == max_iterations:
            x = written(x)
            sums = x.groupBy("run_id").agg(F.sum("x").alias("total"), (F.sum("moved") / F.sum("x")).alias("part"))
            worst = sums.agg(F.max("part")).first()[0]
            if worst is None or worst <= tolerance:
                return x.join(sums, "run_id").select("run_id", "page_id", (F.col("x") / F.col("total")).alias("pagerank"))
    raise ValueError(f"PageRank didn't settle in {max_iterations} steps")


def ranked(ranks: DataFrame, nodes: DataFrame, digits: int = 9) -> DataFrame:
    """ranks with rank: by PageRank rounded to digits, then in the order of the crawl."""
    from pyspark.sql import Window as W

    order = W.partitionBy("run_id").orderBy(F.desc("pagerank"), "sequence_number")
    return ranks.withColumn("pagerank", F.round("pagerank", digits)).join(nodes.select("page_id", "sequence_number"), "page_id").withColumn("rank", F.row_number().over(order)).drop("sequence_number")


def starts(pages: DataFrame) -> DataFrame:
    """run_id, page_id of the first page of each run, if that is html."""
    first = pages.groupBy("run_id").agg(F.min_by(F.struct("page_id", "outcome"), "sequence_number").alias("f"))
    return first.where("f.outcome = 'html'").select("run_id", "f.page_id")


def crawl_order(start_urls: DataFrame, links: DataFrame, max_pages: int, max_depth: int, forbidden: DataFrame | None = None) -> DataFrame:
    """run_id, url, depth, ord, forbidden, limited: a bounded breadth-first crawl over landed links (run_id, url, position, link).

    max_pages and max_depth are the crawl's own limits; limited tells of a run whether they kept a page out. Pages of
    forbidden (run_id, url), as robots.txt has them, are recorded and count, but nothing is read from them.
    """
    from pyspark.sql import Window as W

    closed = written(forbidden.select("run_id", "url").distinct()) if forbidden is not None else start_urls.select("run_id", "url").limit(0)
    seen = written(start_urls.select("run_id", "url", F.lit(0).alias("depth"), F.lit(1).cast("long").alias("ord")))
    links = written(links.join(closed, ["run_id", "url"], "left_anti"))
    for depth in range(1, max_depth + 1):
        from_last = seen.where(F.col("depth") == depth - 1).select("run_id", "url", "ord")
        found = links.join(from_last, ["run_id", "url"]).groupBy("run_id", F.col("link").alias("url")).agg(F.min(F.struct("ord", "position")).alias("at"))
        fresh = found.join(seen, ["run_id", "url"], "left_anti")
        have = seen.groupBy("run_id").agg(F.count(F.lit(1)).alias("have"))
        order = F.row_number().over(W.partitionBy("run_id").orderBy("at.ord", "at.position")).cast("long") + F.col("have")
        new = written(fresh.join(have, "run_id").select("run_id", "url", F.lit(depth).alias("depth"), order.alias("ord")).where(F.col("ord") <= max_pages))
        if new.isEmpty():
            break
        seen = written(seen.unionByName(new))
    # Whatever a crawled page links to and the crawl hasn't seen was kept out by a limit.
    out = links.join(seen.select("run_id", "url"), ["run_id", "url"]).select("run_id", F.col("link").alias("url")).join(seen, ["run_id", "url"], "left_anti").select("run_id").distinct()
    marked = seen.join(closed.withColumn("closed", F.lit(True)), ["run_id", "url"], "left").join(out.withColumn("kept_out", F.lit(True)), "run_id", "left")
    return marked.select("run_id", "url", "depth", "ord", F.coalesce("closed", F.lit(False)).alias("forbidden"), F.coalesce("kept_out", F.lit(False)).alias("limited"))


#: Pages of a run whose graph a task may hold: far more than a crawl's own limit.
HELD_PAGES = 200_000


def by_size(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows (run_id, ...) of runs that a task may hold, and those of the others if there are any."""
    large = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HELD_PAGES).select("run_id")
    if large.isEmpty():
        return rows, None
    return rows.join(large, "run_id", "left_anti"), rows.join(large, "run_id", "left_semi")


def strong_components(nodes: list[int], out: dict[int, list[int]]) -> list[list[int]]:
    """Strongly connected components (Tarjan) with an explicit stack."""
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    open_, on, found = [], set(), []
    for root in nodes:
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        open_.append(root)
        on.add(root)
        while work:
            v, ahead = work[-1]
            for w in ahead:
                if w not in index:
                    index[w] = low[w] = len(index)
                    open_.append(w)
                    on.add(w)
                    work.append((w, iter(out[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        w = open_.pop()
                        on.discard(w)
                        part.append(w)
                        if w == v:
                            break
                    found.append(part)
    return found


def reach(start: int, out: dict[int, list[int]], without: int | None = None) -> list[int]:
    """Pages that can be reached, in the order of their last visit (a post-order of the search)."""
    if start == without:
        return []
    seen, order, work = {start, without}, [], [(start, iter(out[start]))]
    while work:
        v, ahead = work[-1]
        w = next((x for x in ahead if x not in seen), None)
        if w is None:
            order.append(v)
            work.pop()
        else:
            seen.add(w)
            work.append((w, iter(out[w])))
    return order


def stranded(start: int, out: dict[int, list[int]]) -> dict[int, int]:
    """For each page, how many others can't be reached without it: its subtree in the dominator tree (Cooper, Harvey and Kennedy)."""
    post = reach(start, out)
    number = {v: i for i, v in enumerate(post)}
    into: dict[int, list[int]] = {v: [] for v in post}
    for v in post:
        for w in out[v]:
            into[w].append(v)
    above = {start: start}
    changed = True
    while changed:
        changed = False
        for v in reversed(post):
            if v == start:
                continue
            best = None
            for u in into[v]:
                if u in above:
                    if best is None:
                        best = u
                        continue
                    a, b = u, best
                    while a != b:
                        while number[a] < number[b]:
                            a = above[a]
                        while number[b] < number[a]:
                            b = above[b]
                    best = a
            if best is not None and above.get(v) != best:
                above[v] = best
                changed = True
    below = dict.fromkeys(post, 0)
    for v in post:  # a page comes before what dominates it
        if v != start:
            below[above[v]] += below[v] + 1
    return below


def analyzed(pages: pd.DataFrame, arcs: list[tuple[int, int]], rank: dict[int, float] | None) -> pd.DataFrame:
    """The signals of one run."""
    pages = pages.sort_values("sequence_number")
    html = [int(i) for i, o in zip(pages.page_id, pages.outcome, strict=True) if o == "html"]
    known = set(html)
    out: dict[int, list[int]] = {i: [] for i in html}
    into = dict.fromkeys(html, 0)
    for a, b in sorted(set(arcs)):
        if a in known and b in known:
            out[a].append(b)
            into[b] += 1
    start = int(pages.page_id.iloc[0])
    reached = set(reach(start, out)) if start in known else set()
    signals: dict[int, set[str]] = {int(i): set() for i in pages.page_id}
    trap: dict[int, list[int]] = {}
    place = {v: i for i, v in enumerate(html)}
    for part in strong_components(html, out):
        own = set(part)
        if all(w in own for v in part for w in out[v]):
            for v in part:
                signals[v].add("dead_end")
            if len(part) > 1 or part[0] in out[part[0]]:
                for v in part:
                    signals[v].add("cycle_trap")
                    trap[v] = sorted(part, key=place.__getitem__)
    for v in known - reached - {start}:
        signals[v].add("island")
    candidates = [v for v in html if v != start and v in reached]
    if rank is not None and len(candidates) >= LEAST_PAGES:
        bar = sorted(rank[v] for v in candidates)[math.ceil(0.2 * len(candidates)) - 1]
        for v in candidates:
            if rank[v] < bar and into[v] <= 1:
                signals[v].add("low_connectivity")
    depth = dict(zip(map(int, pages.page_id), map(int, pages.depth), strict=True))
    if len(reached) >= LEAST_PAGES:
        bar = sorted(depth[v] for v in reached)[math.ceil(0.9 * len(reached)) - 1]
        for v in reached:
            if depth[v] >= LEAST_DEPTH and depth[v] > bar:
                signals[v].add("anomalous_depth")
    lost: dict[int, int] = {}
    if start in known:
        least = max(2, math.ceil(0.10 * (len(reached) - 1)))
        lost = {v: n for v, n in stranded(start, out).items() if v != start and n >= least}
        for v in lost:
            signals[v].add("bottleneck")
    ids = [int(i) for i in pages.page_id]
    return pd.DataFrame({
        "run_id": pages.run_id.to_numpy(),
        "page_id": ids,
        "signals": [[s for s in SIGNALS if s in signals[v]] for v in ids],
        "dead_end_is_page": ["dead_end" in signals[v] and not out.get(v) for v in ids],
        "cycle": [trap.get(v, []) for v in ids],
        "stranded": [lost.get(v, 0) for v in ids],
    })


def signals(pages: DataFrame, e: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """run_id, page_id, signals (in order), dead_end_is_page, cycle (its pages in crawl order), stranded. Without ranks, low connectivity isn't judged.

    Runs of over HELD_PAGES pages go through large_signals(). As a cycle of theirs may be too large for a row, cycle is null
    there; large_signals() names it.
    """
    pages, large = by_size(pages)
    targets = e.where(F.col("target_id").isNotNull()).groupBy("run_id", F.col("source_id").alias("page_id")).agg(F.collect_list("target_id").alias("targets"))
    rows = pages.select("run_id", "page_id", "sequence_number", "depth", "outcome").join(targets, ["run_id", "page_id"], "left")
    rows = rows.join(ranks, ["run_id", "page_id"], "left") if ranks is not None else rows.withColumn("pagerank", F.lit(None).cast("double"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        arcs = [(int(a), int(b)) for a, t in zip(pdf.page_id, pdf.targets, strict=True) if t is not None for b in t]
        known = pdf[pdf.pagerank.notna()]
        rank = {int(i): round(r, 9) for i, r in zip(known.page_id, known.pagerank, strict=True)}
        return analyzed(pdf, arcs, rank or None)

    found = rows.groupBy("run_id").applyInPandas(one, "run_id long, page_id long, signals array<string>, dead_end_is_page boolean, cycle array<long>, stranded int")
    if large is None:
        return found
    own = e.join(large.select("run_id").distinct(), "run_id", "left_semi")
    more = large_signals(large, own, ranks).withColumn("cycle", F.lit(None).cast("array<long>")).withColumn("stranded", F.col("stranded").cast("int"))
    return found.unionByName(more.select(found.columns))


def large_signals(pages: DataFrame, e: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """run_id, page_id, signals (in order), dead_end_is_page, trap (the least page_id of the cycle trap that a page is in), stranded: as signals(), by joins, for graphs of any size."""
    page = ["run_id", "page_id"]
    pages = written(pages.select(*page, "url", "sequence_number", "depth", "outcome"))
    nodes, arcs = html_graph(pages, e)
    nodes, arcs = written(nodes), written(arcs)
    start = written(starts(pages))
    first = pages.groupBy("run_id").agg(F.min_by("page_id", "sequence_number").alias("first_id"))
    reached = forests.reachable(start, arcs)
    hung = written(forests.subtree_sizes(forests.dominators(reached, arcs)).select(*page, (F.col("size") - 1).alias("below")))
    parts = written(forests.components(nodes, arcs))
    ends = parts.join(forests.sinks(parts, arcs), ["run_id", "component"]).select(*page, F.lit(True).alias("ends"), F.when(F.col("cycle"), F.col("component")).alias("trap"))
    into = arcs.groupBy("run_id", F.col("target_id").alias("page_id")).agg(F.count(F.lit(1)).alias("into"))
    ways = arcs.select("run_id", F.col("source_id").alias("page_id"), F.lit(True).alias("ways")).distinct()
    known = ranks.select(*page, F.round("pagerank", 9).alias("rank")) if ranks is not None else pages.select(*page, F.lit(None).cast("double").alias("rank"))

    rows = pages.join(first, "run_id").join(reached.select(*page, F.lit(True).alias("reached")), page, "left").join(hung, page, "left").join(ends, page, "left").join(into, page, "left").join(ways, page, "left").join(known, page, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    html, is_first = F.col("outcome") == "html", F.col("page_id") == F.col("first_id")
    rows = written(rows.select(*page, "depth", "rank", "trap", html.alias("html"), is_first.alias("is_first"), yes("reached").alias("reached"), yes("ends").alias("ends"), yes("ways").alias("ways"), F.coalesce("into", F.lit(0)).alias("into"), F.coalesce("below", F.lit(0)).alias("below")))
    judged = F.col("reached") & ~F.col("is_first")
    low = forests.nearest_rank(rows.where(judged & F.col("rank").isNotNull()), "rank", 0.2, "low").withColumnRenamed("n", "ranked")
    deep = forests.nearest_rank(rows.where("reached"), "depth", 0.9, "deep").withColumnRenamed("n", "within")
    rows = rows.join(low, "run_id", "left").join(deep, "run_id", "left")
    lost = (F.col("below") >= F.greatest(F.lit(2), F.ceil(F.lit(0.10) * (F.col("within") - 1)))) & judged
    found = {
        "low_connectivity": judged & (F.col("ranked") >= LEAST_PAGES) & (F.col("rank") < F.col("low")) & (F.col("into") <= 1),
        "dead_end": F.col("ends"),
        "island": F.col("html") & ~F.col("reached") & ~F.col("is_first"),
        "cycle_trap": F.col("trap").isNotNull(),
        "anomalous_depth": F.col("reached") & (F.col("within") >= LEAST_PAGES) & (F.col("depth") >= LEAST_DEPTH) & (F.col("depth") > F.col("deep")),
        "bottleneck": lost,
    }
    listed = F.array_compact(F.array(*(F.when(found[s], F.lit(s)) for s in SIGNALS)))
    return rows.select(*page, listed.alias("signals"), (F.col("ends") & ~F.col("ways")).alias("dead_end_is_page"), "trap", F.when(lost, F.col("below")).otherwise(0).alias("stranded"))


def signal_counts(found: DataFrame) -> DataFrame:
    return found.select("run_id", F.explode("signals").alias("signal")).groupBy("run_id", "signal").agg(F.count(F.lit(1)).alias("pages"))


def first_parents(pages: DataFrame, e: DataFrame) -> DataFrame:
    """run_id, page_id, parent_id: the first page of the crawl that links to each, none for the start; cycles may remain."""
    seq = pages.select("run_id", F.col("page_id").alias("source_id"), "sequence_number")
    linked = e.where(F.col("target_id").isNotNull() & (F.col("target_id") != F.col("source_id"))).join(seq, ["run_id", "source_id"]).groupBy("run_id", F.col("target_id").alias("page_id")).agg(F.min_by("source_id", "sequence_number").alias("parent_id"))
    first = pages.groupBy("run_id").agg(F.min_by("page_id", "sequence_number").alias("start_id"))
    joined = pages.select("run_id", "page_id").join(linked, ["run_id", "page_id"], "left").join(first, "run_id")
    return joined.select("run_id", "page_id", F.when(F.col("page_id") != F.col("start_id"), F.col("parent_id")).alias("parent_id"))


def unlooped(parents: dict[int, int | None], sequence: dict[int, int]) -> dict[int, int | None]:
    """Each cycle of parents is cut at its page of the lowest sequence, which becomes a root."""
    parents, done = dict(parents), set()
    for origin in sorted(parents, key=sequence.__getitem__):
        path, on, v = [], set(), origin
        while v is not None and v not in done and v not in on:
            path.append(v)
            on.add(v)
            v = parents[v]
        if v is not None and v in on:
            parents[min(path[path.index(v) :], key=sequence.__getitem__)] = None
        done |= on
    return parents


def tree(pages: DataFrame, e: DataFrame) -> DataFrame:
    """run_id, page_id, parent_id, root_id, level: the spanning forest, whose roots are the start and pages that nothing outside their cycle links to. Runs of over HELD_PAGES pages go through large_tree()."""
    pages, large = by_size(pages)
    rows = first_parents(pages, e).join(pages.select("run_id", "page_id", "sequence_number"), ["run_id", "page_id"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        sequence = dict(zip(map(int, pdf.page_id), map(int, pdf.sequence_number), strict=True))
        up = unlooped({int(i): None if pd.isna(p) else int(p) for i, p in zip(pdf.page_id, pdf.parent_id, strict=True)}, sequence)
        at: dict[int, tuple[int, int]] = {}
        for v in up:
            path, w = [], v
            while w not in at and up[w] is not None:
                path.append(w)
                w = up[w]
            root, level = at.setdefault(w, (w, 0))
            for x in reversed(path):
                level += 1
                at[x] = (root, level)
        ids = sorted(up, key=sequence.__getitem__)
        return pd.DataFrame({"run_id": pdf.run_id.iloc[0], "page_id": ids, "parent_id": pd.array([up[v] for v in ids], "Int64"), "root_id": [at[v][0] for v in ids], "level": [at[v][1] for v in ids]})

    found = rows.groupBy("run_id").applyInPandas(one, "run_id long, page_id long, parent_id long, root_id long, level int")
    return found if large is None else found.unionByName(large_tree(large, e))


def large_tree(pages: DataFrame, e: DataFrame) -> DataFrame:
    """As tree(), by doubling pointers, for graphs of any size and chains of any length."""
    parents = first_parents(pages, e).join(pages.select("run_id", "page_id", "sequence_number"), ["run_id", "page_id"])
    return forests.levels(forests.loops_cut(written(parents)))


def layout(pages: DataFrame, radius: float = 285.0, centre: tuple[float, float] = (450.0, 330.0), most: int = 100) -> DataFrame:
    """run_id, page_id, x, y: pages in a circle in crawl order. A run of more than most pages is an error."""
    from pyspark.sql import Window as W

    run = W.partitionBy("run_id")
    n = F.count(F.lit(1)).over(run)
    angle = -F.pi() / 2 + 2 * F.pi() * (F.row_number().over(run.orderBy("sequence_number")) - 1) / n
    rows = pages.withColumns({"n": n, "angle": angle})
    held = F.when(F.col("n") > most, F.raise_error(F.lit("too many pages to draw")).cast("double")).otherwise(F.col("angle"))
    return rows.select("run_id", "page_id", F.round(centre[0] + radius * F.cos(held), 2).alias("x"), F.round(centre[1] + radius * F.sin(held), 2).alias("y"))


def filtered(pages: DataFrame, found: DataFrame, counts: DataFrame, url: str | None = None, depth: int | None = None, outcome: str | None = None, broken: bool | None = None, unchecked: bool | None = None, signal: str | None = None) -> DataFrame:
    """Pages of a whole run's analysis that meet every given condition; the analysis doesn't depend on them."""
    from pagetide.functions.text import casefold

    rows = pages.join(found, ["run_id", "page_id"]).join(counts, ["run_id", "page_id"])
    if url is not None:
        rows = rows.where(F.contains(casefold(F.col("url")), F.lit(url.casefold())))
    if depth is not None:
        rows = rows.where(F.col("depth") == depth)
    if outcome is not None:
        rows = rows.where(F.col("outcome") == outcome)
    if broken is not None:
        rows = rows.where((F.col("broken") > 0) == broken)
    if unchecked is not None:
        rows = rows.where((F.col("unchecked") > 0) == unchecked)
    if signal is not None:
        rows = rows.where(F.array_contains("signals", signal))
    return rows
