"""Registered queries of the link graph over the note view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import health as H
from ..operators import imports as I
from ..operators import links as L
from ..operators.index import embed
from ..operators.titles import title_counts
from ..session import materialize, table
from .common import GRAPH_SQL, norm_sql, notes, resolved, tidy

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, sf: tidy(f(spark, sf))
        if sql:
            SQL[name] = sql
        return f

    return keep


def graph(body: str, more: str = "") -> str:
    return f"WITH {GRAPH_SQL}{', ' + more if more else ''} {body}"


@query("link_mentions", graph("SELECT src_path, CAST(pos AS BIGINT) AS pos, target, alias FROM mentions"))
def link_mentions(spark, sf):
    return G.mentions(notes(spark, sf)).select("src_path", "pos", "target", "alias")


@query("link_resolve", graph("SELECT src_path, CAST(pos AS BIGINT) AS pos, target, dst_path, dst_title FROM resolved"))
def link_resolve(spark, sf):
    return resolved(spark, sf)[1].select("src_path", "pos", "target", "dst_path", "dst_title")


@query("backlinks", graph("SELECT dst_title, dst_path, src_path, min_by(coalesce(alias, '-'), pos) AS alias, CAST(min(pos) AS BIGINT) AS pos FROM resolved WHERE dst_path IS NOT NULL GROUP BY ALL"))
def backlinks(spark, sf):
    return G.backlinks(resolved(spark, sf)[1].withColumn("alias", F.coalesce("alias", F.lit("-"))))


@query("dangling_links", graph("SELECT target, src_path, count(*) AS mentions FROM resolved WHERE dst_path IS NULL GROUP BY ALL"))
def dangling_links(spark, sf):
    return G.dangling(resolved(spark, sf)[1])


ORPHANS = "orphans AS (SELECT path, title FROM notes WHERE path NOT IN (SELECT src_path FROM edges) AND path NOT IN (SELECT dst_path FROM edges))"


@query("orphan_notes", graph("SELECT * FROM orphans", ORPHANS))
def orphan_notes(spark, sf):
    return G.orphans(*resolved(spark, sf))


@query("graph_stats", graph("SELECT (SELECT count(*) FROM notes) AS note_count, count(*) AS total_mentions, (SELECT count(*) FROM edges) AS unique_connections, count(DISTINCT CASE WHEN dst_path IS NULL THEN target END) AS dangling_targets, (SELECT count(*) FROM orphans) AS orphan_notes FROM resolved", ORPHANS))
def graph_stats(spark, sf):
    return G.graph_stats(*resolved(spark, sf))


CENTRAL = "deg AS (SELECT path, count(*) AS degree FROM (SELECT src_path AS path FROM edges UNION ALL SELECT dst_path FROM edges) GROUP BY path), central AS (SELECT n.path, coalesce(degree, 0) AS degree, coalesce(degree, 0) / (2.0 * (SELECT max(degree) FROM deg)) AS centrality FROM notes n LEFT JOIN deg USING (path))"


@query("centrality", graph("SELECT path, degree, round(centrality, 6) AS centrality FROM central", CENTRAL))
def centrality(spark, sf):
    return G.degree_centrality(*resolved(spark, sf))


def pagerank_sql(n: int = 20) -> str:
    steps = ["outs AS MATERIALIZED (SELECT src_path AS src, count(DISTINCT target) AS out FROM resolved GROUP BY 1)", "pe AS MATERIALIZED (SELECT src_path AS src, dst_path AS dst, out FROM edges JOIN outs ON src = src_path)", "pn AS MATERIALIZED (SELECT path FROM notes)", "p0 AS MATERIALIZED (SELECT path, 1.0::DOUBLE / (SELECT count(*) FROM pn) AS score FROM pn)"]
    for k in range(1, n + 1):
        steps.append(f"p{k} AS MATERIALIZED (SELECT pn.path, 0.15::DOUBLE / (SELECT count(*) FROM pn) + 0.85::DOUBLE * coalesce(s, 0) AS score FROM pn LEFT JOIN (SELECT dst, sum(score / out) AS s FROM pe JOIN p{k - 1} ON src = path GROUP BY dst) ON path = dst)")
    return ", ".join(steps) + f", pr AS (SELECT path, score / (SELECT max(score) FROM p{n}) AS score FROM p{n})"


@query("pagerank", graph("SELECT path, round(score, 6) AS score FROM pr", pagerank_sql()))
def pagerank(spark, sf):
    return G.pagerank(*resolved(spark, sf), tolerance=None)


@query("components", graph("SELECT v, min(r) AS component FROM reach GROUP BY v", """adj AS MATERIALIZED (SELECT src_path AS a, dst_path AS b FROM edges UNION SELECT dst_path, src_path FROM edges),
reach AS (SELECT path AS v, path AS r FROM notes UNION SELECT adj.a, reach.r FROM adj JOIN reach ON adj.b = reach.v)""").replace("WITH ", "WITH RECURSIVE ", 1))
def components(spark, sf):
    n, r = resolved(spark, sf)
    e = G.edges(r).select(F.col("src_path").alias("a"), F.col("dst_path").alias("b"))
    return G.connected_components(n.select(F.col("path").alias("v")), e)


KHOP = "adj AS MATERIALIZED (SELECT src_path AS a, dst_path AS b FROM edges UNION SELECT dst_path, src_path FROM edges), h0 AS (SELECT 'notes/doc-5.md' AS path), h1 AS (SELECT DISTINCT b AS path FROM adj JOIN h0 ON a = path), h2 AS (SELECT DISTINCT b AS path FROM adj JOIN h1 ON a = path), khop AS (SELECT path, min(h) AS hops FROM (SELECT path, 0 AS h FROM h0 UNION ALL SELECT path, 1 FROM h1 UNION ALL SELECT path, 2 FROM h2) GROUP BY path)"


@query("bfs_khop", graph("SELECT path, CAST(hops AS BIGINT) AS hops FROM khop", KHOP))
def bfs_khop(spark, sf):
    n, r = resolved(spark, sf)
    return G.neighbourhood(G.edges(r), n.filter("path = 'notes/doc-5.md'").select("path"), 2)


@query("khop_subgraph", graph("SELECT src_path, dst_path FROM edges WHERE src_path IN (SELECT path FROM khop) AND dst_path IN (SELECT path FROM khop)", KHOP))
def khop_subgraph(spark, sf):
    n, r = resolved(spark, sf)
    e = G.edges(r)
    return G.subgraph(e, G.neighbourhood(e, n.filter("path = 'notes/doc-5.md'").select("path"), 2)).select("src_path", "dst_path")


NODES = ORPHANS + ", ends AS (SELECT id, count(*) AS c FROM (SELECT src_path AS id FROM edges UNION ALL SELECT dst_path FROM edges) GROUP BY id), nodes AS (SELECT n.path AS id, n.title, CASE WHEN n.path IN (SELECT path FROM orphans) THEN 'orphan' ELSE 'note' END AS kind, coalesce(c, 0) AS connections FROM notes n LEFT JOIN ends ON ends.id = n.path UNION ALL SELECT 'dangling:' || target, target, 'dangling', count(DISTINCT src_path) FROM resolved WHERE dst_path IS NULL GROUP BY target), links AS (SELECT DISTINCT src_path AS source, coalesce(dst_path, 'dangling:' || target) AS target FROM resolved)"


@query("graph_nodes", graph("SELECT * FROM nodes", NODES))
def graph_nodes(spark, sf):
    return G.graph_nodes(*resolved(spark, sf))


@query("graph_page", graph("SELECT * FROM nodes ORDER BY connections DESC, id OFFSET 10 LIMIT 50", NODES))
def graph_page(spark, sf):
    n, r = resolved(spark, sf)
    return G.page_of(G.graph_nodes(n, r), G.graph_links(r), 10, 50)[0]


@query("graph_page_links", graph("SELECT source, target FROM links WHERE source IN (SELECT id FROM page) AND target IN (SELECT id FROM page)", NODES + ", page AS (SELECT * FROM nodes ORDER BY connections DESC, id OFFSET 0 LIMIT 400)"))
def graph_page_links(spark, sf):
    n, r = resolved(spark, sf)
    return G.page_of(G.graph_nodes(n, r), G.graph_links(r), 0, 400)[1].select("source", "target")


@query("api_links", graph(f"""SELECT DISTINCT src_path AS source, coalesce(first_.path, 'dangling:' || target) AS target FROM mentions LEFT JOIN first_ ON {norm_sql('mentions.target')} = first_.key""",
f"first_ AS (SELECT key, min(path) AS path FROM (SELECT {norm_sql('title')} AS key, path FROM notes UNION ALL SELECT {norm_sql('basename')}, path FROM notes) GROUP BY key)"))
def api_links(spark, sf):
    n = notes(spark, sf)
    return G.graph_links(G.resolve(G.mentions(n), G.node_keys(n)))


HITS = """hits AS (SELECT q.query_id, n.path, round(1.0::DOUBLE / (1 + (n.doc_id * (q.query_id + 3)) % 97), 6) AS base_score FROM notes n, (SELECT unnest([1, 2, 3]) AS query_id) q WHERE (n.doc_id * (q.query_id + 3)) % 97 < 10),
top AS (SELECT query_id, path AS top_path, row_number() OVER (PARTITION BY query_id ORDER BY base_score DESC, path) AS rank FROM hits QUALIFY rank <= 3),
bi AS (SELECT src_path AS path, dst_path AS top_path FROM edges UNION SELECT dst_path, src_path FROM edges),
ctx AS (SELECT h.query_id, h.path, least(sum(CASE rank WHEN 1 THEN 0.3::DOUBLE WHEN 2 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END), 1) AS s FROM hits h JOIN top t ON h.query_id = t.query_id AND h.path <> t.top_path JOIN bi ON bi.path = h.path AND bi.top_path = t.top_path GROUP BY ALL)"""


def hits_of(spark, sf):
    n = notes(spark, sf)
    q = n.select("path", "doc_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("query_id"))
    k = (F.col("doc_id") * (F.col("query_id") + 3)) % 97
    return q.filter(k < 10).select("query_id", "path", F.round(1.0 / (1 + k), 6).alias("base_score"))


@query("context_link_score", graph("SELECT CAST(query_id AS BIGINT) AS query_id, path, base_score AS score, round(coalesce(s, 0), 6) AS context_link FROM hits LEFT JOIN ctx USING (query_id, path)", HITS))
def context_link_score(spark, sf):
    _, r = resolved(spark, sf)
    return G.context_link_score(hits_of(spark, sf).withColumnRenamed("base_score", "score"), G.edges(r))


@query("graph_rerank", graph("SELECT CAST(query_id AS BIGINT) AS query_id, path, base_score, round(base_score * (1 + 0.2::DOUBLE * (0.4::DOUBLE * coalesce(centrality, 0) + 0.4::DOUBLE * coalesce(pr.score, 0) + 0.2::DOUBLE * coalesce(s, 0))), 6) AS final_score FROM hits LEFT JOIN ctx USING (query_id, path) LEFT JOIN central USING (path) LEFT JOIN pr USING (path)", HITS + ", " + CENTRAL + ", " + pagerank_sql()))
def graph_rerank(spark, sf):
    n, r = resolved(spark, sf)
    return G.graph_rerank(hits_of(spark, sf), G.degree_centrality(n, r), G.pagerank(n, r, tolerance=None), G.edges(r))


HEALTH = """into_ AS (SELECT dst_path AS path, count(*) AS b FROM edges GROUP BY 1), out_ AS (SELECT src_path AS path, count(*) AS o FROM edges GROUP BY 1),
per AS (SELECT n.path, n.title, coalesce(b, 0) AS b, coalesce(o, 0) AS o FROM notes n LEFT JOIN into_ USING (path) LEFT JOIN out_ USING (path)),
met AS (SELECT count(*) AS note_count, avg(b) AS avg_backlinks, max(b) AS max_backlinks, (SELECT title FROM per ORDER BY b DESC, path DESC LIMIT 1) AS max_title, count(*) FILTER (WHERE b = 0) / count(*) AS no_backlinks, count(*) FILTER (WHERE o = 0) / count(*) AS no_outlinks, count(*) FILTER (WHERE b = 0 AND o = 0) / count(*) AS orphans, sum(o) / (count(*) * (count(*) - 1)) AS density FROM per),
said AS (SELECT count(*) AS mentions, count(*) FILTER (WHERE dst_path IS NULL) AS dangling_mentions FROM resolved),
hub AS (SELECT dst_title, count(DISTINCT src_path) AS backlinks, count(DISTINCT src_path) / (SELECT count(*) FROM (SELECT DISTINCT dst_title, src_path FROM resolved WHERE dst_path IS NOT NULL)) AS share FROM resolved WHERE dst_path IS NOT NULL GROUP BY 1)"""


@query("health_metrics", graph("SELECT note_count, round(avg_backlinks, 6) AS avg_backlinks, max_backlinks, max_title, round(no_backlinks, 6) AS no_backlinks, round(no_outlinks, 6) AS no_outlinks, round(orphans, 6) AS orphans, round(density, 6) AS density, mentions, dangling_mentions FROM met, said", HEALTH))
def health_metrics(spark, sf):
    return H.graph_metrics(*resolved(spark, sf))


@query("health_report", graph("""SELECT note_count, round(avg_backlinks, 6) AS avg_backlinks, max_backlinks, max_title, round(no_backlinks, 6) AS no_backlinks, round(no_outlinks, 6) AS no_outlinks, round(orphans, 6) AS orphans, round(density, 6) AS density, mentions, dangling_mentions, round(hs, 6) AS hub_share, round(ds, 6) AS dangling_share, score, CASE WHEN score < 50 THEN 'critical' WHEN score < 75 THEN 'warning' ELSE 'healthy' END AS status,
concat_ws('; ', CASE WHEN no_backlinks > 0.6 THEN 'link to more notes: most have no backlinks' END, CASE WHEN no_outlinks > 0.5 THEN 'add links: most notes link nowhere' END, CASE WHEN orphans > 0.3 THEN 'connect orphan notes' END, CASE WHEN hs >= 0.2 THEN 'split hub notes' END, CASE WHEN ds > 0.2 THEN 'repair dangling links' END) AS recommendations
FROM (SELECT *, CAST(greatest(0, round(100 - least(40 * no_backlinks + 20 * no_outlinks, 30) - least(80 * orphans, 25) - least(50 * CASE WHEN hs >= 0.2 THEN hs ELSE 0 END, 25) - least(60 * ds, 20))) AS BIGINT) AS score FROM (SELECT *, dangling_mentions / mentions AS ds FROM met, said, (SELECT max(share) AS hs FROM hub)))""", HEALTH))
def health_report(spark, sf):
    return H.health_report(*resolved(spark, sf)).withColumn("recommendations", F.array_join("recommendations", "; "))


@query("hub_share", graph("SELECT dst_title, backlinks, round(share, 6) AS share, CASE WHEN share >= 0.5 THEN 'high' ELSE 'medium' END AS severity FROM hub WHERE share >= 0.0005", HEALTH))
def hub_share(spark, sf):
    return H.hubs(resolved(spark, sf)[1], 0.0005)


@query("duplicate_links", graph("SELECT src_path, target, 2 * count(*) AS occurrences, CASE WHEN 2 * count(*) > 3 THEN 'medium' ELSE 'low' END AS severity FROM resolved GROUP BY ALL"))
def duplicate_links(spark, sf):
    r = resolved(spark, sf)[1]
    return H.duplicate_links(r.union(r))


@query("levenshtein_fuzzy_join", """WITH s AS (SELECT DISTINCT s_name AS text FROM supplier), c AS (SELECT DISTINCT c_name AS other FROM customer),
p AS (SELECT text, other, round(1.0 - levenshtein(lower(text), lower(other))::DOUBLE / greatest(length(text), length(other)), 6) AS similarity FROM s, c)
SELECT *, row_number() OVER (PARTITION BY text ORDER BY similarity DESC, other) AS rank FROM p WHERE similarity >= 0.6 QUALIFY rank <= 5""")
def levenshtein_fuzzy_join(spark, sf):
    return H.fuzzy_candidates(table(spark, sf, "supplier").select(F.col("s_name").alias("text")), table(spark, sf, "customer").select(F.col("c_name").alias("text")))


@query("link_issues", graph("""SELECT 'dangling' AS kind, CASE WHEN other IS NULL THEN 'high' ELSE 'medium' END AS severity, src_path, target, other AS suggested, CASE WHEN other IS NULL THEN 'create' ELSE 'replace' END AS action, coalesce(similarity, 0) AS confidence FROM open_ LEFT JOIN best USING (target)
UNION ALL SELECT 'duplicate', CASE WHEN n > 3 THEN 'medium' ELSE 'low' END, src_path, target, NULL, 'review', 0 FROM (SELECT src_path, target, count(*) AS n FROM resolved GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'hub', CASE WHEN share >= 0.5 THEN 'high' ELSE 'medium' END, NULL, dst_title, NULL, 'split', 0.5 FROM hub WHERE share >= 0.2""", HEALTH + """,
open_ AS (SELECT DISTINCT target, src_path FROM resolved WHERE dst_path IS NULL), names AS (SELECT title AS other FROM notes UNION SELECT basename FROM notes),
sims AS (SELECT target, other, round(1.0 - levenshtein(lower(target), lower(other))::DOUBLE / greatest(length(target), length(other)), 6) AS similarity FROM (SELECT DISTINCT target FROM open_), names),
best AS (SELECT target, other, similarity FROM sims WHERE similarity >= 0.6 QUALIFY row_number() OVER (PARTITION BY target ORDER BY similarity DESC, other) = 1)"""))
def link_issues(spark, sf):
    return H.link_issues(*resolved(spark, sf))


@query("link_repair", graph("SELECT path, replace(content, '[[Doc ' || t || ']]', '[[Fixed ' || t || ']]') AS repaired, 1::BIGINT AS applied FROM (SELECT path, content, regexp_extract(content, '\\[\\[Doc (\\d+)\\]\\]', 1) AS t FROM notes)"))
def link_repair(spark, sf):
    n, r = resolved(spark, sf)
    fix = r.filter("pos = 0").select("src_path", "target", F.replace("target", F.lit("Doc"), F.lit("Fixed")).alias("suggested"), F.lit(0.9).alias("confidence"), F.lit("replace").alias("action"))
    return H.apply_repairs(n, fix).select("path", "repaired", "applied")


@query("link_lines", graph("SELECT path, target, count(*) AS n FROM (SELECT DISTINCT src_path AS path, lower(target) AS target FROM mentions) GROUP BY ALL"))
def link_lines(spark, sf):
    n, r = resolved(spark, sf)
    t = r.select(F.lower("target").alias("target")).distinct()
    return H.link_lines(n, t).groupBy("path", "target").agg(F.count("*").alias("n"))


@query("link_merge", graph(r"SELECT path, regexp_replace(regexp_replace(content, '\[\[(doc-10|Doc 10)(#[^\]|]+)?(\|[^\]]+)\]\]', '[[Doc 99\2\3]]', 'g'), '\[\[(doc-10|Doc 10)(#[^\]|]+)?\]\]', '[[Doc 99\2|\1]]', 'g') AS content FROM notes"))
def link_merge(spark, sf):
    return notes(spark, sf).select("path", G.merge_links("content", ["doc-10", "Doc 10"], "Doc 99").alias("content"))


@query("link_merge_preview", graph("SELECT path, CAST(i + 1 AS BIGINT) AS line_number, line, CAST(len(regexp_extract_all(line, '\\[\\[(?:doc-1|Doc 1)(?:#[^\\]|]+)?(?:\\|[^\\]]+)?\\]\\]')) AS BIGINT) AS links FROM (SELECT path, unnest(string_split(content, chr(10))) AS line, unnest(range(len(string_split(content, chr(10))))) AS i FROM notes) WHERE regexp_matches(line, '\\[\\[(?:doc-1|Doc 1)(?:#[^\\]|]+)?(?:\\|[^\\]]+)?\\]\\]')"))
def link_merge_preview(spark, sf):
    return G.merge_preview(notes(spark, sf), ["doc-1", "Doc 1"])


@query("link_suggestions")
def link_suggestions(spark, sf):
    n, r = resolved(spark, sf)
    titled = n.withColumn("title", F.element_at(F.regexp_extract_all("content", F.lit(r"([A-Z]\p{L}+)"), F.lit(1)), 1)).filter("title is not null")
    m = L.match_targets(L.extract_anchors(n), titled)
    return L.suggest_links(m, r.select("src_path", F.col("dst_path").alias("path"))).select("src_path", "text", "start", "path", "confidence", "reason", "rank")


#: Notes named by the first two words of their text.
WORDED = r"""worded AS (SELECT 'n' || doc_id AS path, regexp_extract(text, '^\s*(\S+\s+\S+)', 1) AS title, text AS content FROM documents WHERE text IS NOT NULL)"""


def worded(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null")
    return d.select(F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("path"), F.regexp_extract("text", r"^\s*(\S+\s+\S+)", 1).alias("title"), F.col("text").alias("content"))


@query("title_mentions", f"""WITH {WORDED}, named AS (SELECT title, CASE WHEN min(path) = max(path) THEN min(path) END AS owner FROM worded WHERE length(title) >= 3 GROUP BY title),
hit AS (SELECT path, named.title AS target, lower(content) AS c, lower(named.title) AS t FROM worded, named WHERE contains(lower(content), lower(named.title)) AND owner IS DISTINCT FROM path)
SELECT path, target, CAST((length(c) - length(replace(c, t, ''))) // length(t) AS BIGINT) AS n FROM hit""")
def title_mentions(spark, sf):
    n = worded(spark, sf)
    return title_counts(n, n, least=3)


@query("semantic_link_targets")
def semantic_link_targets(spark, sf):
    n = worded(spark, sf)
    chunks = n.select(F.xxhash64("path").alias("id"), "path", "title")
    vectors = embed(chunks, "title").select("id", F.col("embedding").alias("vector"))
    anchors = materialize(L.extract_anchors(n).filter("kind = 'proper_noun'"), "anchors")  # asked for several times
    near = L.semantic_targets(anchors, n, vectors, None, chunks)
    return L.match_targets(anchors, n.withColumn("aliases", F.array().cast("array<string>")), semantic=near).select("src_path", "text", "start", "path", "score", "match", "rank")


@query("hold_out_links")
def hold_out_links(spark, sf):
    return L.hold_out_links(notes(spark, sf))


@query("similar_link_clusters")
def similar_link_clusters(spark, sf):
    p = table(spark, sf, "part").groupBy(F.col("p_name").alias("target")).agg(F.count("*").alias("occurrences"), F.countDistinct("p_brand").alias("sources"))
    return L.similar_clusters(p, 0.7)


@query("import_rewrite", graph(r"""SELECT path, CASE WHEN i2::BIGINT IN (SELECT doc_id FROM documents) THEN replace(c1, '[[doc-' || i2 || '|see]]', '[[n' || i2 || '|see]]') ELSE c1 END AS content FROM (
SELECT path, i2, CASE WHEN i1::BIGINT IN (SELECT doc_id FROM documents) THEN replace(content, '[[Doc ' || i1 || ']]', '[[n' || i1 || '|Doc ' || i1 || ']]') ELSE content END AS c1
FROM (SELECT path, content, regexp_extract(content, '\[\[Doc (\d+)\]\]', 1) AS i1, regexp_extract(content, '\[\[doc-(\d+)\|see\]\]', 1) AS i2 FROM notes))""".replace("\\\\", "\\")))
def import_rewrite(spark, sf):
    n = notes(spark, sf)
    return I.rewrite_links(n, I.title_mapping(n)).select("path", "content")


@query("generated_queries")
def generated_queries(spark, sf):
    return I.generate_queries(notes(spark, sf))


@query("session_masking", "SELECT conv_id, turn, role, text FROM conversations")
def session_masking(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return I.unmask_sessions(I.mask_sessions(c, "0123456789abcdef"), "0123456789abcdef")
