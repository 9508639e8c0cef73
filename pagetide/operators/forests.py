"""Trees, components and dominators of graphs of any size, by joins.

Pages are named by run_id and page_id, and all runs advance together. Pointers are doubled: a round takes each page as far
again as all rounds before, so chains of a million pages take about twenty rounds. A round is written, which cuts its lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetide.plans.storage import written

PAGE = ["run_id", "page_id"]


def beside(rows: DataFrame, at: str, other: DataFrame, **columns: str) -> DataFrame:
    """rows with columns of other, under new names, for the page that rows name in the column at; null where there is none."""
    own = other.select(F.col("run_id").alias("__run"), F.col("page_id").alias("__page"), *(F.col(c).alias(n) for n, c in columns.items()))
    return rows.join(own, (F.col("run_id") == F.col("__run")) & (F.col(at) == F.col("__page")), "left").drop("__run", "__page")


def loops_cut(parents: DataFrame) -> DataFrame:
    """parents (run_id, page_id, sequence_number, parent_id), where the page of each cycle with the lowest sequence has lost its parent.

    After as many steps as there are pages, whoever still has a parent is on a cycle or leads to one; where these arrive are
    the pages of cycles, and the least that they have passed is their cycle's least.
    """
    walk = written(parents.where(F.col("parent_id").isNotNull()).select(*PAGE, F.col("parent_id").alias("at"), F.struct("sequence_number", "page_id").alias("least")))
    steps = 1
    while True:
        most = walk.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if steps >= most:
            break
        # A page whose next one has no step of that length left has a root ahead, and drops out.
        ahead = beside(walk, "at", walk, next="at", passed="least").where(F.col("next").isNotNull())
        walk = written(ahead.select(*PAGE, F.col("next").alias("at"), F.least("least", "passed").alias("least")))
        steps *= 2
    on = walk.select("run_id", F.col("at").alias("page_id")).distinct()
    cut = walk.join(on, PAGE, "left_semi").where(F.col("least.page_id") == F.col("page_id")).select(*PAGE, F.lit(True).alias("cut"))
    return parents.join(cut, PAGE, "left").withColumn("parent_id", F.when(F.col("cut").isNull(), F.col("parent_id"))).drop("cut")


def levels(parents: DataFrame) -> DataFrame:
    """run_id, page_id, parent_id, root_id, level of a forest: parents (run_id, page_id, parent_id) without cycles."""
    root = F.col("parent_id").isNull()
    rows = written(parents.select(*PAGE, "parent_id", F.coalesce("parent_id", "page_id").alias("root_id"), F.when(root, 0).otherwise(1).alias("level"), root.alias("done")))
    while not rows.where("NOT done").isEmpty():
        # Pages that have arrived take no part but to be met.
        going = beside(rows.where("NOT done"), "root_id", rows, further="root_id", more="level", there="done")
        moved = going.select(*PAGE, "parent_id", F.col("further").alias("root_id"), (F.col("level") + F.col("more")).alias("level"), F.col("there").alias("done"))
        rows = written(rows.where("done").unionByName(moved))
    return rows.drop("done")


def subtree_sizes(parents: DataFrame) -> DataFrame:
    """run_id, page_id, size of a forest: how many pages hang on each, itself included. In round k a page knows those less than 2^k steps below it."""
    rows = written(parents.select(*PAGE, F.col("parent_id").alias("at"), F.lit(1).cast("long").alias("size")))
    while not (live := rows.where(F.col("at").isNotNull())).isEmpty():
        below = live.groupBy("run_id", F.col("at").alias("page_id")).agg(F.sum("size").alias("below"))
        moved = beside(live, "at", rows, next="at").select(*PAGE, F.col("next").alias("at"), "size").unionByName(rows.where(F.col("at").isNull()))
        rows = written(moved.join(below, PAGE, "left").select(*PAGE, "at", (F.col("size") + F.coalesce("below", F.lit(0))).alias("size")))
    return rows.drop("at")


def lifted(parents: DataFrame) -> tuple[DataFrame, int]:
    """run_id, page_id, level, up0, up1, ...: each page's ancestors 1, 2, 4, ... steps up, and how many such columns there are."""
    rows = written(levels(parents).select(*PAGE, "level", F.col("parent_id").alias("up0")))
    deepest = rows.agg(F.max("level")).first()[0] or 0
    n = max(1, deepest.bit_length())
    for k in range(1, n):
        rows = written(beside(rows, f"up{k - 1}", rows, **{f"up{k}": f"up{k - 1}"}))
    return rows, n


def common_ancestors(pairs: DataFrame, tree: DataFrame, n: int) -> DataFrame:
    """pairs (run_id, a, b, ...) with common and common_level: the nearest page of the tree (lifted()) that both hang on or are."""
    rows = beside(beside(pairs, "a", tree, level_a="level"), "b", tree, level_b="level")
    deep = F.col("level_a") >= F.col("level_b")
    rows = rows.withColumns({"x": F.when(deep, F.col("a")).otherwise(F.col("b")), "y": F.when(deep, F.col("b")).otherwise(F.col("a")), "gap": F.abs(F.col("level_a") - F.col("level_b")), "common_level": F.least("level_a", "level_b")})
    for k in range(n):
        rows = beside(rows, "x", tree, above=f"up{k}").withColumn("x", F.when(F.col("gap").bitwiseAND(1 << k) > 0, F.col("above")).otherwise(F.col("x"))).drop("above")
    for k in reversed(range(n)):
        rows = beside(beside(rows, "x", tree, x_up=f"up{k}"), "y", tree, y_up=f"up{k}")
        apart = F.coalesce(F.col("x_up") != F.col("y_up"), F.lit(False))
        moved = {"x": F.when(apart, F.col("x_up")).otherwise(F.col("x")), "y": F.when(apart, F.col("y_up")).otherwise(F.col("y")), "common_level": F.when(apart, F.col("common_level") - (1 << k)).otherwise(F.col("common_level"))}
        rows = rows.withColumns(moved).drop("x_up", "y_up")
    rows = beside(rows, "x", tree, last="up0")
    met = F.col("x") == F.col("y")
    common = {"common": F.when(met, F.col("x")).otherwise(F.col("last")), "common_level": F.when(met, F.col("common_level")).otherwise(F.col("common_level") - 1)}
    return rows.withColumns(common).drop("level_a", "level_b", "x", "y", "gap", "last")


def dominators(reached: DataFrame, arcs: DataFrame) -> DataFrame:
    """run_id, page_id, parent_id: the last page that all ways from the start to a page pass before it; none for the start.

    reached: run_id, page_id, steps, as graph.reachable() gives them. A breadth-first tree is tightened: each page is hung on
    the nearest common ancestor of the pages that link to it, until nothing moves. A page only ever moves up and what
    dominates it stays above it, so this ends, and a tree in which each page hangs above all that link to it is that of
    dominators. Pages move at the same time; few rounds do, unless moves wait for each other along a deep tree.
    """
    start = reached.where("steps = 0").select(*PAGE)
    inner = beside(beside(arcs, "source_id", reached, source_steps="steps"), "target_id", reached, target_steps="steps")
    links = written(inner.where("source_steps IS NOT NULL AND target_steps > 0 AND source_id <> target_id"))
    first = links.where("source_steps = target_steps - 1").groupBy("run_id", F.col("target_id").alias("page_id")).agg(F.min("source_id").alias("parent_id"))
    links = links.select("run_id", "source_id", "target_id")
    parents = written(first.unionByName(start.withColumn("parent_id", F.lit(None).cast("long"))))
    while True:
        tree, n = lifted(parents)
        pairs = beside(links, "target_id", tree, hung="up0").where("source_id <> hung").select("run_id", F.col("source_id").alias("a"), F.col("hung").alias("b"), F.col("target_id").alias("page_id"))
        above = common_ancestors(pairs, tree, n).where("common <> b")
        moved = written(above.groupBy(*PAGE).agg(F.min_by("common", "common_level").alias("moved")))
        if moved.isEmpty():
            return parents
        parents = written(parents.join(moved, PAGE, "left").select(*PAGE, F.coalesce("moved", "parent_id").alias("parent_id")))


def reachable(start: DataFrame, arcs: DataFrame) -> DataFrame:
    """run_id, page_id, steps: pages that can be reached from each run's start, by widening frontiers."""
    arcs = written(arcs)
    seen = frontier = written(start.select("run_id", "page_id", F.lit(0).alias("steps")))
    k = 0
    while True:
        k += 1
        ahead = arcs.join(frontier.select("run_id", F.col("page_id").alias("source_id")), ["run_id", "source_id"]).select("run_id", F.col("target_id").alias("page_id")).distinct()
        frontier = written(ahead.join(seen, ["run_id", "page_id"], "left_anti").withColumn("steps", F.lit(k)))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier) if k % 8 else written(seen.unionByName(frontier))


def spread_least(labels: DataFrame, arcs: DataFrame) -> DataFrame:
    """labels (run_id, page_id, label) after each page has taken the least label of those that reach it by arcs. Only pages whose label has just fallen speak."""
    news = labels
    while True:
        heard = beside(arcs, "source_id", news, said="label").where(F.col("said").isNotNull()).groupBy("run_id", F.col("target_id").alias("page_id")).agg(F.min("said").alias("said"))
        news = written(heard.join(labels, PAGE).where("said < label").select(*PAGE, F.col("said").alias("label")))
        if news.isEmpty():
            return labels
        labels = written(labels.join(news.select(*PAGE, F.col("label").alias("news")), PAGE, "left").select(*PAGE, F.coalesce("news", "label").alias("label")))


#: Rounds of trimming between two rounds of colouring.
TRIMS = 3


def components(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """run_id, page_id, component: the least page_id of the page's strongly connected component.

    Pages without a way in or without a way on are components of their own and are trimmed away. Of the rest, each page
    takes the least page that reaches it as its colour; what reaches a colour's page back within the colour is its component.
    These go, and the rest is coloured anew. Rounds follow the length of ways through what isn't trimmed.
    """
    left = written(nodes.select(*PAGE))
    links = written(arcs.where("source_id <> target_id").select("run_id", "source_id", "target_id"))
    found = []
    while not left.isEmpty():
        for _ in range(TRIMS):
            has_out = links.select("run_id", F.col("source_id").alias("page_id")).distinct()
            has_in = links.select("run_id", F.col("target_id").alias("page_id")).distinct()
            core = written(left.join(has_out, PAGE, "left_semi").join(has_in, PAGE, "left_semi"))
            alone = written(left.join(core, PAGE, "left_anti").select(*PAGE, F.col("page_id").alias("component")))
            if alone.isEmpty():
                break
            found.append(alone)
            left, links = core, written(within(links, core))
        if left.isEmpty():
            break
        colours = spread_least(left.withColumn("label", F.col("page_id")), links)
        same = beside(beside(links, "source_id", colours, near="label"), "target_id", colours, far="label").where("near = far")
        back = written(same.select("run_id", F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")))
        own = reachable(colours.where("label = page_id").select(*PAGE), back).select(*PAGE)
        whole = written(colours.join(own, PAGE, "left_semi").select(*PAGE, F.col("label").alias("component")))
        found.append(whole)
        left = written(left.join(whole, PAGE, "left_anti"))
        links = written(within(links, left))
    out = nodes.select(*PAGE, F.col("page_id").alias("component")).limit(0)
    for rows in found:
        out = out.unionByName(rows)
    return out


def within(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Arcs both of whose ends are among nodes."""
    end = lambda c: nodes.select("run_id", F.col("page_id").alias(c))
    return arcs.join(end("source_id"), ["run_id", "source_id"], "left_semi").join(end("target_id"), ["run_id", "target_id"], "left_semi").select("run_id", "source_id", "target_id")


def sinks(parts: DataFrame, arcs: DataFrame) -> DataFrame:
    """run_id, component, pages, cycle of the components that no arc leaves; cycle tells whether there is a way round in it."""
    both = beside(beside(arcs, "source_id", parts, near="component"), "target_id", parts, far="component")
    leaving = both.where("near <> far").select("run_id", F.col("near").alias("component")).distinct()
    loops = both.where("source_id = target_id").select("run_id", F.col("near").alias("component"), F.lit(True).alias("loop")).distinct()
    sizes = parts.groupBy("run_id", "component").agg(F.count(F.lit(1)).alias("pages"))
    kept = sizes.join(leaving, ["run_id", "component"], "left_anti").join(loops, ["run_id", "component"], "left")
    return kept.select("run_id", "component", "pages", ((F.col("pages") > 1) | F.coalesce("loop", F.lit(False))).alias("cycle"))


def nearest_rank(rows: DataFrame, value: str, part: float, name: str) -> DataFrame:
    """run_id, n and name: of a run's n values in order, that at place ceil(part * n). Equal values are counted first, so a run's distinct values meet in a task, not its rows."""
    counts = rows.groupBy("run_id", value).agg(F.count(F.lit(1)).alias("times"))
    run = W.partitionBy("run_id")
    upto = F.sum("times").over(run.orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = counts.withColumns({"upto": upto, "n": F.sum("times").over(run)})
    return placed.where(F.col("upto") >= F.ceil(F.lit(part) * F.col("n"))).groupBy("run_id").agg(F.max("n").alias("n"), F.min(value).alias(name))
