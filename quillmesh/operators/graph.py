"""The link graph of notes: mentions, resolution, backlinks, dangling and orphan sets, ranks, components, neighbourhoods.

Notes have path, id, title, basename, aliases (array) and content. Keys of a note are its title, basename, id and
aliases in normal form; where notes share a key, the last one in path order has it. All operators are DataFrame in,
DataFrame out; only loops that need it (ranks, components, neighbourhoods) come back to the driver, for one flag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import bound_batches, forget, materialize


def mentions(notes: DataFrame) -> DataFrame:
    """One row per link in a note: src_path, pos (in order), target, section, alias."""
    return notes.select(F.col("path").alias("src_path"), F.posexplode(T.wikilinks("content")).alias("pos", "l")).select("src_path", "pos", "l.target", "l.section", "l.alias")


def note_keys(notes: DataFrame) -> DataFrame:
    """key -> path, title; last note in path order, and its last kind of key, wins."""
    kinds = F.concat(F.array("title", "basename", "id"), F.coalesce("aliases", F.array().cast("array<string>")))
    keys = notes.select("path", "title", F.posexplode(kinds).alias("kind", "raw")).filter(F.col("raw").isNotNull()).select("path", "title", "kind", T.normalize_title("raw").alias("key"))
    return keys.groupBy("key").agg(F.max(F.struct("path", "kind", "title")).alias("m")).select("key", "m.path", "m.title")


def resolve(found: DataFrame, keys: DataFrame) -> DataFrame:
    """mentions with dst_path and dst_title, null where no note has the key."""
    named = keys.select("key", F.col("path").alias("dst_path"), F.col("title").alias("dst_title"))
    return found.withColumn("key", T.normalize_title("target")).join(named, "key", "left").drop("key")


def edges(resolved: DataFrame) -> DataFrame:
    """Distinct src_path, dst_path of resolved mentions."""
    return resolved.filter(F.col("dst_path").isNotNull()).select("src_path", "dst_path").distinct()


def backlinks(resolved: DataFrame) -> DataFrame:
    """One row per target and source, with the first mention's alias and place."""
    first = resolved.filter(F.col("dst_path").isNotNull()).groupBy("dst_title", "dst_path", "src_path").agg(F.min_by("alias", "pos").alias("alias"), F.min("pos").alias("pos"))
    return first.select("dst_title", "dst_path", "src_path", "alias", "pos")


def dangling(resolved: DataFrame) -> DataFrame:
    """Targets that no note has, as written, with how often each source mentions them."""
    return resolved.filter(F.col("dst_path").isNull()).groupBy("target", "src_path").agg(F.count("*").alias("mentions"))


def orphans(notes: DataFrame, resolved: DataFrame) -> DataFrame:
    """Notes without resolved links out or in."""
    e = edges(resolved)
    return notes.select("path", "title").join(e.select(F.col("src_path").alias("path")), "path", "left_anti").join(e.select(F.col("dst_path").alias("path")), "path", "left_anti")


def graph_stats(notes: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row: notes, mentions, distinct connections, dangling targets, orphans."""
    counts = resolved.agg(
        F.count("*").alias("total_mentions"),
        F.countDistinct(F.when(F.col("dst_path").isNotNull(), F.struct("src_path", "dst_path"))).alias("unique_connections"),
        F.countDistinct(F.when(F.col("dst_path").isNull(), F.col("target"))).alias("dangling_targets"),
    )
    size = notes.agg(F.count("*").alias("note_count"))
    alone = orphans(notes, resolved).agg(F.count("*").alias("orphan_notes"))
    return size.crossJoin(counts).crossJoin(alone)  # three single rows


def degree_centrality(notes: DataFrame, resolved: DataFrame) -> DataFrame:
    """(in + out) / (2 * largest degree) of each note, by distinct connections."""
    e = edges(resolved)
    ends = e.select(F.col("src_path").alias("path")).union(e.select(F.col("dst_path").alias("path")))
    degree = ends.groupBy("path").agg(F.count("*").alias("degree"))
    top = degree.agg(F.max("degree").alias("top"))
    all_ = notes.select("path").join(degree, "path", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return all_.join(F.broadcast(top)).select("path", "degree", F.when(F.coalesce("top", F.lit(0)) > 0, F.col("degree") / (2 * F.col("top"))).otherwise(0.0).alias("centrality"))


def pagerank(notes: DataFrame, resolved: DataFrame, damping: float = 0.85, iterations: int = 20, tolerance: float | None = 1e-6, cut: int = 5) -> DataFrame:
    """Pull form over distinct sources; a note's out-degree counts its distinct targets as written, dangling ones too; no
    dangling mass is given back; scores are divided by the largest. With tolerance None all iterations are done.

    Each `cut` rounds' scores are a written table, where the change is looked at too.
    """
    out = resolved.groupBy(F.col("src_path").alias("src")).agg(F.countDistinct("target").alias("out"))
    e = edges(resolved).select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst")).join(out, "src")
    n = max(notes.count(), 1)
    base = (1 - damping) / n
    e = materialize(e, "pr-edges")
    scores, last = notes.select("path", F.lit(1.0 / n).alias("score")), None
    for k in range(1, iterations + 1):
        pulled = e.join(scores, e.src == scores.path).groupBy("dst").agg(F.sum(F.col("score") / F.col("out")).alias("s"))
        new = notes.select("path").join(pulled, F.col("path") == F.col("dst"), "left").select("path", (F.lit(base) + damping * F.coalesce("s", F.lit(0.0))).alias("score"))
        if k % cut == 0 or k == iterations:
            if tolerance is not None:
                new = materialize(new.join(scores.withColumnRenamed("score", "was"), "path"), "pr-scores")
                if (new.agg(F.max(F.abs(F.col("score") - F.col("was")))).first()[0] or 0) < tolerance:
                    scores = new.drop("was")
                    break
                new = new.drop("was")
            else:
                new = materialize(new, "pr-scores")
        if k % cut == 0 or k == iterations:
            forget(*([last] if last is not None else []))
            last = new
        scores = new
    top = scores.agg(F.max("score").alias("top"))
    return scores.join(F.broadcast(top)).select("path", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0).alias("score"))


def connected_components(vertices: DataFrame, links: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, component): smallest vertex reachable over undirected links (a, b); labels spread with pointer jumping. Labels
    that still change after all rounds are an error."""
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-links")
    labels = materialize(vertices.select("v", F.col("v").alias("component")), "cc-labels")
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("component").alias("seen"))
        step = labels.join(near, labels.v == near.a, "left").select("v", F.least("component", "seen").alias("new"), F.col("component").alias("was"))
        jump = step.select(F.col("v").alias("new"), F.col("new").alias("further"))
        new = materialize(step.join(jump, "new").select("v", F.least("new", "further").alias("component"), "was"), "cc-labels")
        forget(labels)
        labels = new
        if not labels.filter("component <> was").limit(1).count():
            forget(both)
            return labels.select("v", "component")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def neighbourhood(links: DataFrame, start: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """(path, hops) within `depth` undirected steps of start's paths; a frontier join per step. With `most`, only so many
    nodes: the nearest, and of one distance the first by path."""
    both = links.select(F.col("src_path").alias("a"), F.col("dst_path").alias("b")).union(links.select(F.col("dst_path").alias("a"), F.col("src_path").alias("b"))).distinct()
    seen = start.select("path", F.lit(0).alias("hops")).distinct()
    frontier = seen
    for k in range(1, depth + 1):
        new = frontier.join(both, frontier.path == both.a).select(F.col("b").alias("path")).distinct().join(seen, "path", "left_anti")
        frontier = materialize(new.select("path", F.lit(k).alias("hops")), "bfs")
        seen = seen.union(frontier)
    return seen if most is None else seen.orderBy("hops", "path").limit(most)


def subgraph(links: DataFrame, kept: DataFrame) -> DataFrame:
    """Links with both ends among kept's paths."""
    return links.join(kept.select(F.col("path").alias("src_path")), "src_path", "left_semi").join(kept.select(F.col("path").alias("dst_path")), "dst_path", "left_semi")


def graph_nodes(notes: DataFrame, resolved: DataFrame) -> DataFrame:
    """id, title, kind (note, orphan or dangling) and connections of every node, dangling targets included."""
    e = edges(resolved)
    ends = e.select(F.col("src_path").alias("id")).union(e.select(F.col("dst_path").alias("id"))).groupBy("id").agg(F.count("*").alias("connections"))
    alone = orphans(notes, resolved).select(F.col("path").alias("id"), F.lit(1).alias("o"))
    real = notes.select(F.col("path").alias("id"), "title").join(ends, "id", "left").join(alone, "id", "left").select("id", "title", F.when(F.col("o") == 1, "orphan").otherwise("note").alias("kind"), F.coalesce("connections", F.lit(0)).alias("connections"))
    open_ = resolved.filter(F.col("dst_path").isNull()).groupBy("target").agg(F.countDistinct("src_path").alias("connections"))
    return real.union(open_.select(F.concat(F.lit("dangling:"), "target"), F.col("target"), F.lit("dangling"), "connections"))


def node_keys(notes: DataFrame) -> DataFrame:
    """key, path and title by which the graph API resolves links: titles and basenames in normal form, without aliases and ids;
    of notes that share one the first by path has it. For resolve(); notes without a path or key have none."""
    keys = notes.filter("path is not null").select("path", "title", F.explode(F.array("title", "basename")).alias("k")).select("path", "title", T.normalize_title("k").alias("key"))
    return keys.filter("key is not null").groupBy("key").agg(F.min(F.struct("path", "title")).alias("m")).select("key", "m.path", "m.title")


def graph_links(resolved: DataFrame) -> DataFrame:
    """source and target ids of the graph, dangling targets included."""
    return resolved.select(F.col("src_path").alias("source"), F.coalesce("dst_path", F.concat(F.lit("dangling:"), "target")).alias("target")).distinct()


def page_of(nodes: DataFrame, links: DataFrame, offset: int, limit: int, by_connections: bool = True) -> tuple[DataFrame, DataFrame]:
    """A page of nodes, most connected first, and the links within it."""
    order = [F.desc("connections"), F.asc("id")] if by_connections else [F.asc("id")]
    page = nodes.orderBy(*order).offset(offset).limit(limit)
    ids = page.select("id")
    return page, links.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def merge_links(content: Column | str, old: list[str], new: str, keep_alias: bool = True) -> Column:
    """Rewrites links to any old title as links to new; sections stay; aliases stay, else the old target may become one."""
    import re

    pattern = r"\[\[(" + "|".join(re.escape(o) for o in old) + r")(#[^\]|]+)?(\|[^\]]+)?\]\]"
    t = T.col(content)
    named = F.regexp_replace(t, pattern.replace(r"(\|[^\]]+)?", r"(\|[^\]]+)"), f"[[{new}$2$3]]")
    return F.regexp_replace(named, pattern.replace(r"(\|[^\]]+)?", ""), f"[[{new}$2|$1]]" if keep_alias else f"[[{new}$2]]")


def merge_preview(notes: DataFrame, old: list[str]) -> DataFrame:
    """path, 1-based line and text of the lines that merging would change, with how many links each."""
    import re

    pattern = r"\[\[(?:" + "|".join(re.escape(o) for o in old) + r")(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]"
    lines = notes.select("path", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    return lines.withColumn("links", F.regexp_count("line", F.lit(pattern))).filter("links > 0").select("path", (F.col("pos") + 1).alias("line_number"), "line", "links")


def context_link_score(hits: DataFrame, links: DataFrame) -> DataFrame:
    """Of each hit (query_id, path, score): 0.3, 0.2 and 0.1 for a link with the first, second and third hit of its query, capped at 1."""
    top = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "path"))).filter("rank <= 3").select("query_id", F.col("path").alias("top_path"), "rank")
    pairs = hits.join(top, "query_id").filter("path <> top_path")
    both = links.select(F.col("src_path").alias("path"), F.col("dst_path").alias("top_path")).union(links.select(F.col("dst_path").alias("path"), F.col("src_path").alias("top_path"))).distinct()
    got = pairs.join(both, ["path", "top_path"]).groupBy("query_id", "path").agg(F.sum(F.when(F.col("rank") == 1, 0.3).when(F.col("rank") == 2, 0.2).otherwise(0.1)).alias("s"))
    return hits.join(got, ["query_id", "path"], "left").select(*[hits[c] for c in hits.columns], F.least(F.coalesce("s", F.lit(0.0)), F.lit(1.0)).alias("context_link"))


def graph_rerank(hits: DataFrame, centrality: DataFrame, ranks: DataFrame, links: DataFrame, boost: float = 0.2) -> DataFrame:
    """final = base * (1 + boost * (.4 centrality + .4 PageRank + .2 context links))."""
    scored = context_link_score(hits.withColumnRenamed("base_score", "score"), links).withColumnRenamed("score", "base_score")
    joined = scored.join(centrality.select("path", "centrality"), "path", "left").join(ranks.select("path", F.col("score").alias("rank_score")), "path", "left")
    lift = 0.4 * F.coalesce("centrality", F.lit(0.0)) + 0.4 * F.coalesce("rank_score", F.lit(0.0)) + 0.2 * F.col("context_link")
    return joined.select("query_id", "path", "base_score", (F.col("base_score") * (1 + boost * lift)).alias("final_score"))


def links_with_places(notes: DataFrame) -> DataFrame:
    """mentions with start and end (code points in the content) and the 0-based line of each link; none spans lines."""
    import pandas as pd

    pattern = r"\[\[([^\]|#]+)(?:#([^\]|]+))?(?:\|([^\]]+))?\]\]"

    def run(batches):
        import re

        link = re.compile(pattern)
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["content"], strict=True):
                base = pos = 0
                for number, line in enumerate((text or "").split("\n")):
                    for m in link.finditer(line):
                        rows.append((path, pos, m[1].strip(), (m[2] or "").strip() or None, (m[3] or "").strip() or None, base + m.start(), base + m.end(), number))
                        pos += 1
                    base += len(line) + 1
            yield pd.DataFrame(rows, columns=["src_path", "pos", "target", "section", "alias", "start", "end", "line"])

    bound_batches(notes.sparkSession)
    return notes.select("path", "content").mapInPandas(run, "src_path string, pos int, target string, section string, alias string, start int, end int, line int")


def links_to(found: DataFrame, title: str) -> DataFrame:
    """Mentions whose target is the title but for case and outer blanks."""
    return found.filter(F.lower(F.trim("target")) == title.strip().lower())


def backlinks_of(links: DataFrame, titles: DataFrame) -> DataFrame:
    """backlinks of asked titles (column title): those of the title as written, or else of the first title by name with the
    same normal form."""
    known = links.select("dst_title").distinct().withColumn("key", T.normalize_title("dst_title"))
    asked = titles.select("title").distinct().withColumn("key", T.normalize_title("title"))
    best = asked.join(known, "key").groupBy("title").agg(F.min(F.struct((F.col("dst_title") != F.col("title")).alias("other"), F.col("dst_title"))).alias("m"))
    return best.select("title", F.col("m.dst_title").alias("dst_title")).join(links, "dst_title")


def focus(nodes: DataFrame, links: DataFrame, node: str) -> tuple[DataFrame, DataFrame]:
    """A node with its direct neighbours, and the links among them."""
    near = links.filter(F.col("source") == node).select(F.col("target").alias("id")).union(links.filter(F.col("target") == node).select(F.col("source").alias("id")))
    ids = near.union(nodes.filter(F.col("id") == node).select("id")).distinct()
    kept = nodes.join(ids, "id", "left_semi")
    return kept, links.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def link_lists(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, direction (out or in) and the sorted titles at the other ends of each node's links."""
    titled = nodes.select("id", "title")
    both = links.select(F.col("source").alias("id"), F.lit("out").alias("direction"), F.col("target").alias("other")).union(links.select(F.col("target"), F.lit("in"), F.col("source")))
    return both.join(titled.withColumnRenamed("id", "other"), "other").groupBy("id", "direction").agg(F.array_sort(F.collect_list("title")).alias("titles"))


def filter_nodes(nodes: DataFrame, links: DataFrame, kinds: list[str] | None = None, holds: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of some kinds whose title holds a text, whatever its case, and the links among them."""
    kept = nodes
    if kinds is not None:
        kept = kept.filter(F.col("kind").isin(kinds))
    if holds:
        kept = kept.filter(F.contains(F.lower("title"), F.lit(holds.lower())))
    ids = kept.select("id")
    return kept, links.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def has_more(nodes: DataFrame, offset: int, limit: int) -> DataFrame:
    """One row: total, and whether there are nodes after a page."""
    return nodes.agg(F.count("*").alias("total")).withColumn("has_more", F.col("total") > offset + limit)


def hub_metadata(hubs: DataFrame, notes: DataFrame) -> DataFrame:
    """hubs (dst_title) with the id and path of the first note by path whose title or basename that is; the title and an
    empty path where there is none."""
    names = notes.select("path", "id", F.explode(F.array_distinct(F.array("title", "basename"))).alias("dst_title")).groupBy("dst_title").agg(F.min(F.struct("path", "id")).alias("m"))
    return hubs.join(names, "dst_title", "left").select(*[hubs[c] for c in hubs.columns], F.coalesce("m.id", "dst_title").alias("note_id"), F.coalesce("m.path", F.lit("")).alias("path"))
