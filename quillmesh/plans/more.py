"""Registered queries of lookups, sessions, datasets, index state, judges and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..operators import chunk, index, links, sessions
from ..operators import graph as G
from ..operators import imports as I
from ..operators import metrics as M
from ..operators import retrieve as R
from ..session import table
from ..sources import files
from .common import GRAPH_SQL, NOTES_SQL, docs, norm_sql, notes, resolved, tidy
from .evaluation import ITEMS_SQL, items
from .graphs import HEALTH, NODES
from .texts import tok

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


# Links and graph


@query("links_to_note", graph("SELECT src_path, CAST(pos AS BIGINT) AS pos, target FROM mentions WHERE lower(trim(target)) = 'doc 10'"))
def links_to_note(spark, sf):
    return G.links_to(G.mentions(notes(spark, sf)), " DOC 10").select("src_path", "pos", "target")


@query("link_places", f"""WITH {NOTES_SQL}, a AS (SELECT *, length(text) + 1 AS s1, 4 + length('Doc ' || ((doc_id * 7 + 3) % m)) AS n1, 8 + length('doc-' || ((doc_id * 13 + 5) % m)) AS n2, length(text) - length(replace(text, chr(10), '')) AS line FROM documents, m)
SELECT 'notes/doc-' || doc_id || '.md' AS src_path, 0::BIGINT AS pos, 'Doc ' || ((doc_id * 7 + 3) % m) AS target, NULL::VARCHAR AS alias, s1 AS start, s1 + n1 AS "end", line FROM a
UNION ALL SELECT 'notes/doc-' || doc_id || '.md', 1, 'doc-' || ((doc_id * 13 + 5) % m), 'see', s1 + n1 + 1, s1 + n1 + 1 + n2, line FROM a""")
def link_places(spark, sf):
    return G.links_with_places(notes(spark, sf)).drop("section")


BACK = "asked(title) AS (VALUES ('Doc 10'), ('doc-11'), ('DOC_12.md'), ('none such')), bl AS (SELECT dst_title, dst_path, src_path, CAST(min(pos) AS BIGINT) AS pos FROM resolved WHERE dst_path IS NOT NULL GROUP BY ALL)"


@query("backlinks_lookup", graph(f"""SELECT title, m.dst_title, src_path, pos FROM (SELECT title, coalesce(max(dst_title) FILTER (WHERE dst_title = title), min(dst_title)) AS dst_title FROM asked JOIN (SELECT DISTINCT dst_title FROM bl) ON {norm_sql('dst_title')} = {norm_sql('title')} GROUP BY title) m JOIN bl USING (dst_title)""", BACK))
def backlinks_lookup(spark, sf):
    asked = spark.createDataFrame([("Doc 10",), ("doc-11",), ("DOC_12.md",), ("none such",)], "title string")
    return G.backlinks_of(G.backlinks(resolved(spark, sf)[1]), asked).select("title", "dst_title", "src_path", "pos")


FOCUS = NODES + ", near AS (SELECT 'notes/doc-5.md' AS id UNION SELECT target FROM links WHERE source = 'notes/doc-5.md' UNION SELECT source FROM links WHERE target = 'notes/doc-5.md')"


@query("focus_nodes", graph("SELECT * FROM nodes WHERE id IN (SELECT id FROM near)", FOCUS))
def focus_nodes(spark, sf):
    n, r = resolved(spark, sf)
    return G.focus(G.graph_nodes(n, r), G.graph_links(r), "notes/doc-5.md")[0]


@query("focus_links", graph("SELECT source, target FROM links WHERE source IN (SELECT id FROM near) AND target IN (SELECT id FROM near)", FOCUS))
def focus_links(spark, sf):
    n, r = resolved(spark, sf)
    return G.focus(G.graph_nodes(n, r), G.graph_links(r), "notes/doc-5.md")[1]


@query("link_lists", graph("SELECT x.id, direction, string_agg(title, ';' ORDER BY title) AS titles FROM (SELECT source AS id, 'out' AS direction, target AS other FROM links UNION ALL SELECT target, 'in', source FROM links) x JOIN nodes ON nodes.id = other GROUP BY ALL", NODES))
def link_lists(spark, sf):
    n, r = resolved(spark, sf)
    return G.link_lists(G.graph_links(r), G.graph_nodes(n, r)).withColumn("titles", F.array_join("titles", ";"))


FILTERED = NODES + ", kept AS (SELECT * FROM nodes WHERE kind IN ('note', 'dangling') AND contains(lower(title), 'oc 1'))"


@query("filter_nodes", graph("SELECT * FROM kept", FILTERED))
def filter_nodes(spark, sf):
    n, r = resolved(spark, sf)
    return G.filter_nodes(G.graph_nodes(n, r), G.graph_links(r), ["note", "dangling"], "OC 1")[0]


@query("filter_node_links", graph("SELECT source, target FROM links WHERE source IN (SELECT id FROM kept) AND target IN (SELECT id FROM kept)", FILTERED))
def filter_node_links(spark, sf):
    n, r = resolved(spark, sf)
    return G.filter_nodes(G.graph_nodes(n, r), G.graph_links(r), ["note", "dangling"], "OC 1")[1]


@query("page_has_more", graph("SELECT count(*) AS total, count(*) > 150 AS has_more FROM nodes", NODES))
def page_has_more(spark, sf):
    return G.has_more(G.graph_nodes(*resolved(spark, sf)), 100, 50)


@query("hub_metadata", graph("SELECT dst_title, backlinks, coalesce(m.id, dst_title) AS note_id, coalesce(m.path, '') AS path FROM (SELECT dst_title, backlinks FROM hub WHERE share >= 0.0005 UNION ALL SELECT 'No Note', 0) LEFT JOIN (SELECT DISTINCT title, path, id FROM notes) m ON m.title = dst_title", HEALTH))
def hub_metadata(spark, sf):
    from ..operators import health as H

    n, r = resolved(spark, sf)
    hubs = H.hubs(r, 0.0005).select("dst_title", "backlinks").union(spark.createDataFrame([("No Note", 0)], "dst_title string, backlinks long"))
    return G.hub_metadata(hubs, n)


@query("khop_capped", graph("SELECT path, CAST(hops AS BIGINT) AS hops FROM khop ORDER BY hops, path LIMIT 12", "adj AS MATERIALIZED (SELECT src_path AS a, dst_path AS b FROM edges UNION SELECT dst_path, src_path FROM edges), h1 AS (SELECT DISTINCT b AS path FROM adj WHERE a = 'notes/doc-7.md'), h2 AS (SELECT DISTINCT b AS path FROM adj JOIN h1 ON a = path), h3 AS (SELECT DISTINCT b AS path FROM adj JOIN h2 ON a = path), khop AS (SELECT path, min(h) AS hops FROM (SELECT 'notes/doc-7.md' AS path, 0 AS h UNION ALL SELECT path, 1 FROM h1 UNION ALL SELECT path, 2 FROM h2 UNION ALL SELECT path, 3 FROM h3) GROUP BY path)"))
def khop_capped(spark, sf):
    n, r = resolved(spark, sf)
    return G.neighbourhood(G.edges(r), n.filter("path = 'notes/doc-7.md'").select("path"), 3, 12)


CONCEPTS = r"""WITH w AS (SELECT doc_id, concept, count(*) AS n FROM (SELECT doc_id, unnest(list_filter(""" + tok("text") + r""", lambda w: length(w) >= 4)) AS concept FROM documents) GROUP BY ALL HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, concept) AS r FROM w),
c AS (SELECT doc_id, concept, 2 AS p, r AS k FROM r WHERE r <= 5
 UNION ALL SELECT doc_id, concept, p, row_number() OVER (PARTITION BY doc_id, p ORDER BY concept) FROM (
  SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b'))) AS concept, 0 AS p FROM documents
  UNION ALL SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\b[A-Z]{2,6}\b'))), 1 FROM documents)),
o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, lower(concept) ORDER BY p, k) = 1)
SELECT doc_id, concept, row_number() OVER (PARTITION BY doc_id ORDER BY p, k) AS rank FROM o QUALIFY rank <= 20"""


@query("suggest_concepts", CONCEPTS)
def suggest_concepts(spark, sf):
    return links.suggest_concepts(links.concepts(docs(spark, sf)))


@query("suggestions_for_anchor", graph("""SELECT q.id, s.src_path AS path, s.target AS text, s.pos FROM (SELECT src_path, target, CAST(pos AS BIGINT) AS pos, pos * 10 AS a, pos * 10 + 8 AS b FROM mentions) s
JOIN (SELECT doc_id AS id, path, ' doc ' || ((doc_id * 7 + 3) % m) AS anchor, CASE WHEN doc_id % 3 = 0 THEN 12 END AS qa, CASE WHEN doc_id % 3 = 0 THEN 20 END AS qb FROM notes, m) q ON q.path = s.src_path
WHERE lower(trim(s.target)) = lower(trim(q.anchor)) OR coalesce(s.a < q.qb AND s.b > q.qa, false)"""))
def suggestions_for_anchor(spark, sf):
    n = notes(spark, sf)
    m = (n.agg(F.max("doc_id")).first()[0] + 1) * 11 // 10
    s = G.mentions(n).select(F.col("src_path").alias("path"), F.col("target").alias("text"), "pos", (F.col("pos") * 10).alias("start"), (F.col("pos") * 10 + 8).alias("end"))
    third = F.col("doc_id") % 3 == 0
    q = n.select(F.col("doc_id").alias("id"), "path", F.concat(F.lit(" doc "), ((F.col("doc_id") * 7 + 3) % m).cast("string")).alias("anchor"), F.when(third, 12).alias("start"), F.when(third, 20).alias("end"))
    return links.suggestions_for(s, q).select("id", "path", "text", "pos")


@query("language_pairs", """WITH n AS (SELECT doc_id, lang, doc_id // 6 AS topic FROM documents) SELECT a.topic, 'd' || a.doc_id AS source, a.lang AS source_language, 'd' || b.doc_id AS expected, b.lang AS expected_language, CASE WHEN a.lang = b.lang THEN 'same' ELSE 'cross' END AS kind FROM n a JOIN n b ON a.topic = b.topic""")
def language_pairs(spark, sf):
    n = docs(spark, sf).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.floor(F.col("doc_id") / 6).alias("topic"), F.col("lang").alias("language"))
    return I.language_pairs(n, 1000)


# Sessions

SESSIONS_SQL = """s AS (SELECT conv_id AS id, TIMESTAMP '2024-01-01' + INTERVAL 7 HOUR * conv_id AS created_at, TIMESTAMP '2024-01-01' + INTERVAL 7 HOUR * conv_id + INTERVAL 11 MINUTE * ((conv_id * 37) % 1000) AS updated_at, ['t' || (conv_id % 3), 'u' || (conv_id % 5)] AS tags FROM (SELECT DISTINCT conv_id FROM conversations))"""


def sessions_of(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("id")).distinct()
    made = F.expr("timestamp_micros(1704067200000000 + id * 25200000000)")
    upd = F.expr("timestamp_micros(1704067200000000 + id * 25200000000 + ((id * 37) % 1000) * 660000000)")
    s = lambda c: c.cast("string")
    return c.select("id", made.alias("created_at"), upd.alias("updated_at"), F.array(F.concat(F.lit("t"), s(F.col("id") % 3)), F.concat(F.lit("u"), s(F.col("id") % 5))).alias("tags")).withColumn("month", T.month("created_at"))


@query("sessions_newest", f"WITH {SESSIONS_SQL} SELECT id, strftime(updated_at, '%Y-%m-%d %H:%M') AS updated FROM s ORDER BY updated_at DESC, id LIMIT 10")
def sessions_newest(spark, sf):
    return sessions.newest(sessions_of(spark, sf)).select("id", F.date_format("updated_at", "yyyy-MM-dd HH:mm").alias("updated"))


@query("sessions_recent", f"WITH {SESSIONS_SQL} SELECT id FROM s WHERE TIMESTAMP '2024-01-10 12:00:00' - updated_at <= INTERVAL 30 MINUTE")
def sessions_recent(spark, sf):
    return sessions.recent(sessions_of(spark, sf), "2024-01-10 12:00:00").select("id")


@query("sessions_by_tag", f"WITH {SESSIONS_SQL} SELECT id FROM s WHERE list_contains(tags, 'u2')")
def sessions_by_tag(spark, sf):
    return sessions.with_tag(sessions_of(spark, sf), "u2").select("id")


@query("session_counts", f"WITH {SESSIONS_SQL} SELECT 'total' AS facet, '' AS value, count(*) AS sessions FROM s UNION ALL SELECT 'month', strftime(created_at, '%Y-%m'), count(*) FROM s GROUP BY 2 UNION ALL SELECT 'tag', t, count(*) FROM (SELECT unnest(tags) AS t FROM s) GROUP BY 2")
def session_counts(spark, sf):
    return sessions.session_counts(sessions_of(spark, sf))


@query("session_tags", f"WITH {SESSIONS_SQL} SELECT id, CASE WHEN id % 3 = 1 THEN '' ELSE 't' || (id % 3) || ';' END || 'u' || (id % 5) || CASE WHEN id % 5 = 2 THEN '' ELSE ';u2' END || ';x' AS tags FROM s")
def session_tags(spark, sf):
    return sessions.remove_tag(sessions.add_tags(sessions_of(spark, sf), ["u2", "x"]), "t1").select("id", F.array_join("tags", ";").alias("tags"))


@query("merge_sessions", f"""WITH {SESSIONS_SQL} SELECT id, strftime(updated_at + CASE WHEN id % 2 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%d %H:%M') AS updated,
CASE WHEN id % 3 <> 2 THEN 't' || (id % 3) || ';u' || (id % 5) || CASE WHEN id % 2 = 0 THEN ';l' ELSE '' END WHEN id % 2 = 0 THEN 'l;t2;u' || (id % 5) ELSE 't2;u' || (id % 5) END AS tags FROM s""")
def merge_sessions(spark, sf):
    s = sessions_of(spark, sf)
    local = s.filter("id % 2 = 0").withColumn("updated_at", F.col("updated_at") + F.expr("INTERVAL 1 HOUR")).withColumn("tags", F.array(F.lit("l")))
    m = sessions.merge_sessions(s.filter("id % 3 <> 2"), local, s)
    return m.select("id", F.date_format("updated_at", "yyyy-MM-dd HH:mm").alias("updated"), F.array_join("tags", ";").alias("tags"))


# Evaluation


@query("filter_items", "SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars < 1000 AND list_contains([source, lang], 'src6')")
def filter_items(spark, sf):
    d = docs(spark, sf).select("doc_id", F.col("lang").alias("language"), F.when(F.col("n_chars") < 1000, "easy").otherwise("hard").alias("difficulty"), F.array("source", "lang").alias("tags"))
    return M.filter_items(d, "en", "easy", "src6").select("doc_id")


@query("dataset_averages", f"WITH {ITEMS_SQL} SELECT count(*) AS items, count(*) FILTER (WHERE answerable) AS answerable, count(*) FILTER (WHERE NOT answerable) AS unanswerable, round(avg(len(want)), 6) AS avg_notes, round(avg(CASE WHEN id % 2 = 0 THEN 0 ELSE len(got) END), 6) AS avg_spans FROM i")
def dataset_averages(spark, sf):
    i = items(spark, sf).select("answerable", F.col("expected").alias("expected_notes"), F.when(F.col("id") % 2 != 0, F.col("retrieved")).alias("expected_spans"))
    return M.dataset_averages(i)


@query("link_summary", f"""WITH {ITEMS_SQL}, x AS (SELECT got[1:id % 7][1:5] AS t, want, list_transform(range(3), lambda k: 'n' || ((id * 31 + k * 51) % 53)) AS known FROM i), y AS (SELECT *, len(list_filter(t, lambda p: list_contains(want, p))) AS h FROM x),
z AS (SELECT *, CASE WHEN len(t) > 0 THEN h::DOUBLE / len(t) ELSE 0 END AS p, CASE WHEN len(want) > 0 THEN len(list_intersect(want, t))::DOUBLE / len(want) ELSE 0 END AS r, CASE WHEN len(t) > 0 THEN len(list_filter(t, lambda q: NOT list_contains(known, q)))::DOUBLE / len(t) ELSE 0 END AS v FROM y)
SELECT count(*) AS items, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1, round(avg(CASE WHEN h > 0 THEN 1 ELSE 0 END), 6) AS hit, round(avg(v), 6) AS novelty FROM z""")
def link_summary(spark, sf):
    known = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.concat(F.lit("n"), ((F.col("id") * 31 + k * 51) % 53).cast("string")))
    i = items(spark, sf).select("id", F.slice("retrieved", F.lit(1), (F.col("id") % 7).cast("int")).alias("suggested"), "expected", known.alias("existing"))
    return M.link_summary(M.link_item_metrics(i))


#: Two runs over the given tables: all events, and those of a later dataset; each snapshot names what it was made of.
SNAPSHOTS_SQL = """d AS (SELECT count(*) || ':' || sum(length(text)) AS notes_hash FROM documents), parts AS (SELECT 'base' AS run, * FROM events UNION ALL SELECT 'cur', * FROM events WHERE event_id % 3 <> 0 AND event_type <> (SELECT max(event_type) FROM events)),
models AS (SELECT run, event_type AS model FROM (SELECT run, event_type, row_number() OVER (PARTITION BY run ORDER BY n DESC, event_type) AS r FROM (SELECT run, event_type, count(*) AS n FROM parts GROUP BY ALL)) WHERE r = 1),
snaps AS (SELECT run, model, count(*) || ':' || sum(event_id) AS dataset_hash, any_value(d.notes_hash) AS notes_hash, CAST(count(DISTINCT event_type) AS VARCHAR) AS schema_version FROM parts JOIN models USING (run), d GROUP BY run, model),
long_ AS (UNPIVOT snaps ON model, dataset_hash, notes_hash, schema_version INTO NAME key VALUE v),
both_ AS (SELECT b.key, b.v AS base, c.v AS cur, b.v = c.v AS same FROM long_ b JOIN long_ c ON b.key = c.key AND b.run = 'base' AND c.run = 'cur')"""


def snapshot_of(spark, sf, events):
    """One row that names the events and documents a run was made of."""
    notes_hash = docs(spark, sf).agg(F.concat_ws(":", F.count("*"), F.sum(F.length("text"))).alias("notes_hash"))
    model = events.groupBy("event_type").agg(F.count("*").alias("n")).agg(F.min(F.struct(-F.col("n"), "event_type"))["event_type"].alias("model"))
    one = events.agg(F.concat_ws(":", F.count("*"), F.sum("event_id")).alias("dataset_hash"), F.countDistinct("event_type").cast("string").alias("schema_version"))
    return one.crossJoin(notes_hash).crossJoin(model)  # single rows


def two_snapshots(spark, sf):
    e = table(spark, sf, "events")
    last = e.agg(F.max("event_type")).first()[0]
    return snapshot_of(spark, sf, e), snapshot_of(spark, sf, e.filter((F.col("event_id") % 3 != 0) & (F.col("event_type") != last)))


@query("snapshot_compatibility", f"WITH {SNAPSHOTS_SQL} SELECT key, CASE WHEN key = 'model' THEN 'error' ELSE 'warning' END AS level, base, cur FROM both_ WHERE NOT same")
def snapshot_compatibility(spark, sf):
    return M.snapshot_compatibility(*two_snapshots(spark, sf))


@query("preconditions", f"WITH {SNAPSHOTS_SQL} SELECT * FROM both_ WHERE key <> 'schema_version'")
def preconditions(spark, sf):
    return M.preconditions(*two_snapshots(spark, sf))


# Judges

ANSWERS = """a AS (SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'Sure:' || chr(10) || '```json' || chr(10) || j || chr(10) || '```' || chr(10) || 'done {' WHEN 1 THEN j WHEN 2 THEN 'Here it is ' || j || ' as asked' WHEN 3 THEN 'no {json} here' ELSE '' END AS answer FROM (SELECT item_id, '{"evaluations": [{"index": 1, "score": ' || (item_id % 14 - 2) || ', "reason": "r"}, {"index": 2}, {"index": 0, "score": 9}]}' AS j FROM benchmark))"""


def answers(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id")
    j = F.concat(F.lit('{"evaluations": [{"index": 1, "score": '), (F.col("item_id") % 14 - 2).cast("string"), F.lit(', "reason": "r"}, {"index": 2}, {"index": 0, "score": 9}]}'))
    k = F.col("item_id") % 5
    said = F.when(k == 0, F.concat(F.lit("Sure:\n```json\n"), j, F.lit("\n```\ndone {"))).when(k == 1, j).when(k == 2, F.concat(F.lit("Here it is "), j, F.lit(" as asked"))).when(k == 3, "no {json} here").otherwise("")
    return b.select("item_id", said.alias("answer"))


@query("judged_scores", "SELECT item_id, CASE WHEN item_id % 5 < 3 THEN '1:' || (CASE WHEN item_id % 14 = 2 THEN 5 ELSE least(greatest(item_id % 14 - 2, 0), 10) END)::DOUBLE || ';2:5.0' END AS scores FROM benchmark")
def judged_scores(spark, sf):
    s = F.transform(R.judged_scores("answer"), lambda r: F.concat_ws(":", r["index"].cast("string"), r["score"].cast("string")))
    return answers(spark, sf).select("item_id", F.when(s.isNotNull(), F.array_join(s, ";")).alias("scores"))


# Index


HISTORY = """f1 AS (SELECT doc_id, text, 1 AS mtime FROM documents WHERE doc_id % 4 <> 0),
f2 AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN text || ' more' ELSE text END AS text, CASE WHEN doc_id % 6 = 0 THEN 2 ELSE 1 END AS mtime FROM documents WHERE doc_id % 5 <> 0),
f3 AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN text || ' more' ELSE text END AS text, CASE WHEN doc_id % 7 = 0 THEN 3 ELSE 1 END AS mtime FROM documents WHERE doc_id % 3 <> 0)"""


def history(spark, sf):
    d = docs(spark, sf).select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), "doc_id", "text")
    more = F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text"))
    one = d.filter("doc_id % 4 <> 0").withColumn("mtime", F.lit(1.0))
    two = d.filter("doc_id % 5 <> 0").withColumn("mtime", F.when(F.col("doc_id") % 6 == 0, 2.0).otherwise(1.0)).withColumn("text", more)
    three = d.filter("doc_id % 3 <> 0").withColumn("mtime", F.when(F.col("doc_id") % 7 == 0, 3.0).otherwise(1.0)).withColumn("text", more)
    return [f.withColumn("content_hash", T.content_hash("text")) for f in (one, two, three)]


def stepped(spark, sf):
    """The index after three looks; each row says at which look it was made."""
    i = state = None
    for k, f in enumerate(history(spark, sf), 1):
        rows = lambda some, k=k: chunk.paragraph_chunks(some, "path", "text", "\n").select("path", "chunk_index", "content").withColumn("look", F.lit(k))
        i, state = index.index_step(i, state, f, rows)
    return i, state


#: A row is as old as its file's last change: at the second look files of 6 change and those of 4 come; at the third, those that the second left out come, and those of 7 or that were newer change.
@query("incremental_index", f"""WITH {HISTORY}, h AS (SELECT f3.doc_id, f3.text, CASE WHEN f2.doc_id IS NULL OR f2.text <> f3.text OR f2.mtime < f3.mtime THEN 3 WHEN f1.doc_id IS NULL OR f1.text <> f2.text OR f1.mtime < f2.mtime THEN 2 ELSE 1 END AS look FROM f3 LEFT JOIN f2 USING (doc_id) LEFT JOIN f1 USING (doc_id)),
p AS (SELECT doc_id, look, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 0) AS p FROM h)
SELECT 'p' || doc_id AS path, CAST(unnest(range(len(p))) AS BIGINT) AS chunk_index, unnest(p) AS content, CAST(look AS BIGINT) AS look FROM p""")
def incremental_index(spark, sf):
    return stepped(spark, sf)[0]


@query("index_state", f"WITH {HISTORY} SELECT 'p' || doc_id AS path, sha256(text) AS content_hash, mtime::DOUBLE AS mtime, CAST(len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0)) AS BIGINT) AS chunk_count, 2::BIGINT AS version, 64::BIGINT AS dimensions FROM f3")
def index_state(spark, sf):
    return stepped(spark, sf)[1]


@query("index_recovery", "SELECT 'p' || doc_id AS path, 2::BIGINT AS look FROM documents WHERE doc_id % 5 <> 0")
def index_recovery(spark, sf):
    """A state of another version has all files made anew."""
    one, two, _ = history(spark, sf)
    rows = lambda k: lambda some: some.select("path", F.lit(0).alias("chunk_index"), F.col("text").alias("content"), F.lit(k).alias("look"))
    i, state = index.index_step(None, None, one, rows(1))
    return index.index_step(i, state.withColumn("version", F.lit(1)), two, rows(2))[0].select("path", "look")


@query("changed_on_both_sides", "SELECT 'p' || doc_id AS path FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 = 0")
def changed_on_both_sides(spark, sf):
    d = docs(spark, sf).select("doc_id", F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"))
    return index.changed_both(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 3 = 0"))


@query("cache_status", """WITH e AS (SELECT event_id AS key, event_id % 500 AS created FROM events), f AS (SELECT doc_id, sha256(text) AS h, 10 AS mtime FROM documents WHERE doc_id % 10 <> 0),
d AS (SELECT event_id AS key, d.doc_id, CASE WHEN event_id % 3 = 0 THEN 9 ELSE 10 END AS mtime, CASE WHEN event_id % 6 = 0 THEN 'old' ELSE sha256(text) END AS h FROM events JOIN documents d ON d.doc_id = event_id % 100 WHERE event_id % 2 = 0)
SELECT key, CASE WHEN 600 - created > 300 THEN 'expired' WHEN key IN (SELECT d.key FROM d LEFT JOIN f USING (doc_id) WHERE f.h IS NULL OR (f.mtime <> d.mtime AND f.h <> d.h)) THEN 'stale' ELSE 'valid' END AS status FROM e""")
def cache_status(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("event_id").alias("key"), (F.col("event_id") % 500).alias("created"), (F.col("event_id") % 100).alias("doc_id"))
    d = docs(spark, sf).select("doc_id", F.col("doc_id").cast("string").alias("path"), T.content_hash("text").alias("content_hash"))
    depends = e.filter("event_id % 2 = 0").join(d, "doc_id").select("key", "path", F.when(F.col("event_id") % 3 == 0, 9).otherwise(10).alias("mtime"), F.when(F.col("event_id") % 6 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"))
    return index.cache_status(e.select("key", "created"), depends, d.filter("doc_id % 10 <> 0").select("path", F.lit(10).alias("mtime"), "content_hash"), 600.0)


# Retrieval and scalar functions


@query("context_expansion", """WITH h AS (SELECT doc_id AS note_id, text, CASE WHEN doc_id % 9 = 0 THEN 'not in any text' ELSE substring(text, 21 + doc_id % 40, 30) END AS content FROM documents),
p AS (SELECT *, instr(text, content) AS p0, string_split(text, chr(10)) AS l FROM h), q AS (SELECT *, len(string_split(text[1:p0 - 1], chr(10))) AS b, len(string_split(text[p0 + length(content):], chr(10))) AS a FROM p),
w AS (SELECT note_id, content, p0, trim(array_to_string(l[greatest(b - 3, 0) + 1:least(len(l), b + least(a, 3)) + 1], chr(10)), ' ') AS wide FROM q)
SELECT note_id, CASE WHEN p0 > 0 AND length(wide) > length(content) THEN wide ELSE content END AS expanded FROM w""")
def context_expansion(spark, sf):
    d = docs(spark, sf)
    cut = F.when(F.col("doc_id") % 9 == 0, "not in any text").otherwise(F.substring("text", (F.col("doc_id") % 40 + 21).cast("int"), F.lit(30)))
    hits = d.select(F.col("doc_id").alias("note_id"), cut.alias("content"))
    return R.context_expansion(hits, d.select(F.col("doc_id").alias("note_id"), "text")).select("note_id", "expanded")


@query("scalar_texts", r"""SELECT doc_id, len(regexp_extract_all(text, '[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0b}]+')) AS words, trim(regexp_replace('a **b** *c* `d` ' || doc_id, '\*\*|\*|`', '', 'g')) AS plain, 'My Doc ' || doc_id AS titled, 'doc-' || doc_id AS base, 'n' || doc_id || '.md' AS inner_path, 'passage: ' || doc_id AS prefixed,
strftime(TIMESTAMP '2024-03-05 06:07:08' + INTERVAL 1 HOUR * doc_id, '%Y%m%d-%H%M%S') AS run, 'note_' || strftime(TIMESTAMP '2024-03-05 06:07:08' + INTERVAL 1 HOUR * doc_id, '%Y%m%d_%H%M%S') || '000' AS note, strftime(TIMESTAMP '2024-03-05 06:07:08' + INTERVAL 1 HOUR * doc_id, '%Y-%m') AS month FROM documents""")
def scalar_texts(spark, sf):
    s = F.col("doc_id").cast("string")
    at = F.expr("timestamp'2024-03-05 06:07:08' + make_interval(0, 0, 0, 0, cast(doc_id as int))")
    return docs(spark, sf).select("doc_id", T.word_count("text").alias("words"), T.strip_markdown(F.concat(F.lit("## a **b** *c* `d` "), s)).alias("plain"), T.title_case(F.concat(F.lit("my-doc_"), s)).alias("titled"), T.basename(F.concat(F.lit("x/y/doc-"), s, F.lit(".md"))).alias("base"), T.relativize(F.concat(F.lit("/v/n"), s, F.lit(".md")), "/v/").alias("inner_path"), F.concat(F.lit("passage: "), s).alias("prefixed"), T.run_id(at).alias("run"), T.note_id(at).alias("note"), T.month(at).alias("month"))


@query("collapsed_texts", r"SELECT item_id, t AS whole, CASE WHEN length(t) > 30 THEN rtrim(t[1:29]) || '…' ELSE t END AS cut FROM (SELECT item_id, trim(regexp_replace('  ' || replace(text, ' ', chr(10) || ' '), '\s+', ' ', 'g')) AS t FROM benchmark)")
def collapsed_texts(spark, sf):
    t = F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("\n ")))
    return table(spark, sf, "benchmark").select("item_id", T.collapse(t).alias("whole"), T.collapse(t, 30).alias("cut"))


@query("scalar_scores", "SELECT event_id, round(greatest(1 - value / 100, 0), 6) AS similarity, round(least(greatest(value / 50 - 0.5, 0), 1), 6) AS clamped FROM events")
def scalar_scores(spark, sf):
    return table(spark, sf, "events").select("event_id", V.distance_to_similarity(F.col("value") / 100).alias("similarity"), V.clamp(F.col("value") / 50 - 0.5).alias("clamped"))


@query("contextual_chunks", r"""SELECT doc_id, '# Doc ' || doc_id || chr(10) || chr(10) || CASE WHEN doc_id % 4 = 0 THEN '## Part ' || doc_id || chr(10) || chr(10) || c WHEN doc_id % 4 = 1 THEN '### Deep' || chr(10) || chr(10) || c ELSE c END AS content FROM (SELECT doc_id, 'x' || text AS c FROM documents)""")
def contextual_chunks(spark, sf):
    k = F.col("doc_id") % 4
    s = F.col("doc_id").cast("string")
    c = docs(spark, sf).select("doc_id", F.concat(F.lit("x"), "text").alias("content"), F.concat(F.lit("Doc "), s).alias("title"), F.when(k == 0, F.concat(F.lit("Part "), s)).when(k == 1, "Deep").when(k == 2, "Summary").alias("header"), F.when(k == 0, 1).otherwise(5).alias("header_level"), F.lit(1).alias("section_chunk"))
    return chunk.contextualize(c).select("doc_id", "content")


# Sources


@query("front_matter", r"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'Doc ' || doc_id END AS title, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'a;b c' ELSE 'x;y' END AS tags, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'one' ELSE 'p;q' END AS aliases, 'x' || text AS body FROM documents""")
def front_matter(spark, sf):
    k, s = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    head = F.when(k == 1, F.concat(F.lit("---\ntitle: \"Doc "), s, F.lit("\"\ntags: [a, 'b c']\nalias: one\n---\n"))).when(k == 2, F.concat(F.lit("---\ntitle: Doc "), s, F.lit("\ntags:\n  - x\n  - y\naliases: [p, q]\n---\n\n"))).otherwise("")
    f = files.with_front_matter(docs(spark, sf).select("doc_id", F.concat(head, F.lit("x"), "text").alias("content")))
    return f.select("doc_id", "title", F.array_join("tags", ";").alias("tags"), F.array_join("aliases", ";").alias("aliases"), "body")


@query("jsonl_quarantine", """SELECT CASE k WHEN 1 THEN 'json' WHEN 2 THEN 'id' WHEN 3 THEN 'expected_spans' WHEN 4 THEN 'language' ELSE 'right' END AS problem, count(*) AS items FROM (SELECT event_id % 7 AS k FROM events) WHERE k < 6 GROUP BY 1""")
def jsonl_quarantine(spark, sf):
    k, s = F.col("event_id") % 7, F.col("event_id").cast("string")
    good = lambda i, more: F.concat(F.lit('{"id": "'), i, F.lit('", "query": "q", "answerable": true, "expected_notes": ["n"]'), F.lit(more), F.lit("}"))
    line = F.when(k == 0, good(s, "")).when(k == 1, F.concat(F.lit("{broken "), s)).when(k == 2, good(F.lit(" "), "")).when(k == 3, good(s, ', "expected_spans": [{"note_path": "n", "start": 3, "end": 2}]')).when(k == 4, good(s, ', "language": "xx"')).when(k == 5, good(s, ', "language": "en", "difficulty": "mid"')).otherwise("# a comment")
    rows = files.jsonl_rows(table(spark, sf, "events").select(line.alias("value")), files.SEARCH_SCHEMA).withColumn("problem", files.search_problem())
    return rows.groupBy(F.coalesce("problem", F.lit("right")).alias("problem")).agg(F.count("*").alias("items"))


@query("note_info", r"""SELECT doc_id, 'Doc ' || doc_id AS title, 'p;q r' AS aliases, 'Alpha;Beta ' || doc_id AS headers FROM documents""")
def note_info(spark, sf):
    s = F.col("doc_id").cast("string")
    c = F.concat(F.lit("---\ntitle: 'Doc "), s, F.lit("'\naliases: [p, 'q r']\n---\n# Alpha\n## Beta "), s, F.lit("\n### Alpha\n#### Deep\n# x\n"))
    f = files.note_info(docs(spark, sf).select("doc_id", F.concat(F.lit("d"), s, F.lit(".md")).alias("path"), c.alias("content")))
    return f.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("doc_id"), "title", F.array_join("aliases", ";").alias("aliases"), F.array_join("headers", ";").alias("headers"))


@query("headings", r"""SELECT doc_id, unnest([1, 3])::BIGINT AS level, unnest(['One ' || doc_id, 'Three']) AS heading, unnest([0, 28 + length(doc_id::VARCHAR)])::BIGINT AS start FROM documents""")
def headings(spark, sf):
    s = F.col("doc_id").cast("string")
    c = F.concat(F.lit("# One "), s, F.lit("\n```\n## not one\n```\nx\n### Three\n#### Four"))
    return I.headings(docs(spark, sf).select(s.alias("path"), c.alias("content"))).select(F.col("path").cast("long").alias("doc_id"), "level", "heading", "start")


@query("conflict_halves", "SELECT doc_id, 'l' || doc_id || chr(10) AS local, 'r' || chr(10) AS remote FROM documents")
def conflict_halves(spark, sf):
    s = F.col("doc_id").cast("string")
    t = F.concat(F.lit("a\n<<<<<<< HEAD\nl"), s, F.lit("\n=======\nr\n>>>>>>> other\nb"))
    return docs(spark, sf).select("doc_id", index.conflict_halves(t).alias("c")).select("doc_id", "c.local", "c.remote")


@query("changed_files", "SELECT 'dir/f ' || doc_id || '.md' AS path, CASE doc_id % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'added' WHEN 2 THEN 'deleted' ELSE 'updated' END AS change FROM documents")
def changed_files(spark, sf):
    code = F.element_at(F.array(*map(F.lit, ("A", "??", "D", "M", "R"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return index.changed_files(docs(spark, sf).select(F.concat(code, F.lit("\tdir/f "), F.col("doc_id").cast("string"), F.lit(".md")).alias("line")))


@query("image_links", "SELECT doc_id, 'i/' || doc_id || '.png' AS image FROM documents UNION ALL SELECT doc_id, 'w.jpg' FROM documents")
def image_links(spark, sf):
    s = F.col("doc_id").cast("string")
    c = F.concat(F.lit("![a](i/"), s, F.lit(".png) ![b](http://x/y.png) ![[w.jpg|200]]"))
    return I.image_references(docs(spark, sf).select(s.alias("path"), c.alias("content"))).select(F.col("path").cast("long").alias("doc_id"), "image")
