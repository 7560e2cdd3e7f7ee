"""Link graph: resolution of links and bounded reachability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut


def local_target(raw: Column, source_path: Column) -> Column:
    """TXT10: a link's target as a path: without fragment and query, relative to the source's folder, "." and ".." resolved; null for other schemes and empty links."""
    bare = F.regexp_replace(raw, r"[#?].*$", "")
    folder = F.regexp_replace(source_path, r"[^/]*$", "")
    parts = F.split(F.when(F.startswith(bare, F.lit("/")), bare).otherwise(F.concat(folder, bare)), "/")
    kept = F.aggregate(
        F.filter(parts, lambda p: (p != "") & (p != ".")),
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p != "..", F.concat(acc, F.array(p))).when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc),
    )
    return F.when((bare == "") | raw.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)"), F.lit(None).cast("string")).otherwise(F.array_join(kept, "/"))


def resolve_links(links: DataFrame, documents: DataFrame) -> DataFrame:
    """JN06, JN07: links(src_doc, raw) with the document each leads to, if there is one."""
    src = documents.select(F.col("doc_id").alias("src_doc"), F.col("path").alias("src_path"))
    dst = documents.select(F.col("doc_id").alias("dst_doc"), F.col("path").alias("target"))
    return links.join(src, "src_doc").withColumn("target", local_target(F.col("raw"), F.col("src_path"))).join(dst, "target", "left").select("src_doc", "raw", "target", "dst_doc")


def reach(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "out", fixed: bool = False) -> DataFrame:
    """GR01-GR03, JN20, SET01: start, doc, hops, direction, weight, link_type for edges(id, src, dst, link_type), up to ``depth`` (at least 1) hops, the start itself left out.
    weight counts direct edges, link_type is the first one's. Found by both directions, a document has the fewest hops, weight 0 and no type, as
    the reference does; ``fixed`` adds both weights up instead. One join for each hop; a hop's frontier is what is new to its start."""
    depth = max(1, depth)
    ways = {"out": ("src", "dst"), "in": ("dst", "src")}
    e0 = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    found = []
    for way in ways if direction == "both" else (direction,):
        a, b = ways[way]
        e = e0.select(F.col(a).alias("at"), F.col(b).alias("doc")).distinct()
        seen = starts.select(F.col("start"), F.col("start").alias("doc"), F.lit(0).alias("hops")).distinct()
        frontier = seen
        for h in range(1, depth + 1):
            nxt = frontier.select("start", F.col("doc").alias("at")).join(e, "at").select("start", "doc").distinct()
            frontier = cut(nxt.join(seen.select("start", "doc"), ["start", "doc"], "left_anti").withColumn("hops", F.lit(h)))
            seen = seen.unionByName(frontier)
        direct = e0.groupBy(F.col(a).alias("start"), F.col(b).alias("doc")).agg(F.count("*").alias("weight"), F.min_by("link_type", "id").alias("link_type"))
        r = seen.where("hops > 0").join(direct, ["start", "doc"], "left")
        found.append(r.select("start", "doc", "hops", F.lit(way).alias("direction"), F.when(F.col("hops") == 1, F.coalesce("weight", F.lit(0))).otherwise(0).alias("weight"), F.when(F.col("hops") == 1, F.coalesce("link_type", F.lit(""))).otherwise("").alias("link_type")))
    every = reduce(DataFrame.unionByName, found)
    g = every.groupBy("start", "doc").agg(F.min("hops").alias("hops"), F.count("*").alias("ways"), F.max("direction").alias("direction"), F.sum("weight").alias("weight"), F.max("link_type").alias("link_type"))
    both = F.col("ways") > 1
    return g.select("start", "doc", "hops", F.when(both, "both").otherwise(F.col("direction")).alias("direction"), F.when(both & F.lit(not fixed), 0).otherwise(F.col("weight")).alias("weight"), F.when(both & F.lit(not fixed), "").otherwise(F.col("link_type")).alias("link_type"))
