"""Bounded breadth-first walks over link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bounded_walk(edges: DataFrame, seeds: DataFrame, depth: int, per_level: int | None = None) -> DataFrame:
    """Nodes reachable from the seeds within ``depth`` steps: node, depth, parent (least on ties; null for seeds).

    ``edges`` has source, target; ``seeds`` has node. Each level is one join of the frontier with the
    edges and one anti join with what was seen; ``per_level`` keeps the least so many new nodes of a level
    where a crawl has a budget. Each level is checkpointed in the shared folder, so that lineage stays
    short and a lost executor doesn't restart the walk. Cycles, self-loops and repeated edges do no harm;
    null nodes are left out.
    """
    links = edges.select("source", "target").where("source is not null and target is not null").distinct().checkpoint()
    frontier = seeds.select(F.col("node")).where("node is not null").distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast(links.schema["source"].dataType).alias("parent")).checkpoint()
    seen = frontier
    for level in range(1, depth + 1):
        reached = frontier.select(F.col("node").alias("source")).join(links, "source").groupBy(F.col("target").alias("node")).agg(F.min("source").alias("parent"))
        new = reached.join(seen.select("node"), "node", "left_anti").select("node", F.lit(level).alias("depth"), "parent")
        if per_level is not None:
            new = new.orderBy("node").limit(per_level)
        frontier = new.checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier).checkpoint()
    return seen


def index_crawl(links: DataFrame, entries: DataFrame, depth: int, is_index, most_indexes: int | None = None) -> DataFrame:
    """Articles reached from entry pages over index pages: node, depth, anchors, indexes.

    ``links`` has source, target, anchor; ``entries`` node; ``is_index`` tells from a target column whether a page is an index, of
    which the links are followed, up to ``depth`` steps. Each level keeps the ``most_indexes`` least new index pages where a crawl
    has a budget for them. An article comes with the least depth at which it is met, the distinct anchor texts of all
    links to it from pages of the crawl, sorted and joined by " | ", and the number of those pages. Nulls are left out.
    A page that very many others link to is counted in tasks first; levels are checkpointed.
    """
    edges = links.select("source", "target", "anchor").where("source is not null and target is not null").distinct().checkpoint()
    seen = frontier = entries.select("node").where("node is not null").distinct().select("node", F.lit(0).alias("depth")).checkpoint()
    for level in range(1, depth + 1):
        met = frontier.select(F.col("node").alias("source")).join(edges.where(is_index(F.col("target"))), "source").select(F.col("target").alias("node")).distinct()
        new = met.join(seen.select("node"), "node", "left_anti").select("node", F.lit(level).alias("depth"))
        if most_indexes is not None:
            new = new.orderBy("node").limit(most_indexes)
        frontier = new.checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier).checkpoint()
    found = seen.where(F.col("depth") < depth).select(F.col("node").alias("source"), "depth").join(edges.where(~is_index(F.col("target"))), "source")
    each = found.groupBy("target", "anchor").agg(F.min("depth").alias("depth"))
    pages = found.select("target", "source").distinct().groupBy(F.col("target").alias("_t")).agg(F.count("*").alias("indexes"))
    texts = each.groupBy("target").agg((F.min("depth") + 1).alias("depth"), F.array_join(F.array_sort(F.collect_set("anchor")), " | ").alias("anchors"))
    return texts.join(pages, F.col("target") == F.col("_t")).select(F.col("target").alias("node"), "depth", "anchors", "indexes")


def linked_from(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct targets (node) to which one of ``pages`` (node) links."""
    return links.join(pages.select(F.col("node").alias("source")).distinct(), "source", "left_semi").select(F.col("target").alias("node")).where("node is not null").distinct()


def qualification_walk(edges: DataFrame, seeds: DataFrame, pages: int, per_page: int) -> DataFrame:
    """Depth-first walks from each seed within a budget: (seed, place, node), the first ``pages`` pages in the order they are looked at.

    The children of a page, the least ``per_page`` of them, go to the front of what is still to be looked at, unless the walk has met them
    before. A walk's state is at most ``pages * per_page`` nodes; all walks take a step in one join, ``pages`` times, checkpointed.
    Hubs are cut to their least children before they are brought together. Null nodes are left out.
    """
    place = F.row_number().over(Window.partitionBy("source").orderBy("target"))
    few = edges.select("source", "target").where("source is not null and target is not null").distinct().withColumn("n", place).where(F.col("n") <= per_page)
    children = few.groupBy("source").agg(F.array_sort(F.collect_list("target")).alias("children")).checkpoint()
    nodes = F.array().cast(f"array<{children.schema['source'].dataType.simpleString()}>")
    walks = seeds.where("node is not null").select(F.col("node").alias("seed"), F.array("node").alias("ahead"), F.array("node").alias("met"), nodes.alias("seen")).distinct()
    for _ in range(pages):
        now = F.get("ahead", F.lit(0))
        step = walks.withColumn("now", now).join(children, F.col("now") == F.col("source"), "left")
        fresh = F.filter(F.coalesce("children", nodes), lambda x: ~F.array_contains("met", x))
        moved = step.withColumn("fresh", fresh).select(
            "seed", F.concat("fresh", F.slice("ahead", 2, pages * per_page + 1)).alias("ahead"), F.concat("met", "fresh").alias("met"),
            F.when(F.col("now").isNull(), F.col("seen")).otherwise(F.array_append("seen", F.col("now"))).alias("seen"),
        )
        walks = moved.checkpoint()
    return walks.select("seed", F.posexplode("seen").alias("place", "node"))
