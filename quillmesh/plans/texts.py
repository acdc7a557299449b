"""Registered queries over text: scalar functions, links, pages, chunks, hashes, searches, conversations, changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..operators import chunk, expand, index, links, merkle, retrieve, search_text, sessions
from ..session import table
from ..streaming import jobs
from .common import NOTES_SQL, docs, norm_sql, notes, tidy

QUERIES, SQL = {}, {}
TOK = r"list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 1)"


def tok(c: str) -> str:
    return TOK.format(c=c)


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, sf: tidy(f(spark, sf))
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("tokenize_docs", f"SELECT doc_id, CAST(len(t) AS BIGINT) AS tokens, array_to_string(t, ' ') AS text FROM (SELECT doc_id, {tok('text')} AS t FROM documents)")
def tokenize_docs(spark, sf):
    return docs(spark, sf).select("doc_id", T.tokenize("text").alias("t")).select("doc_id", F.size("t").alias("tokens"), F.array_join("t", " ").alias("text"))


@query("term_df", f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest({tok('text')}) AS term FROM documents) GROUP BY term")
def term_df(spark, sf):
    return retrieve.term_stats(docs(spark, sf), "doc_id", "text").select("term", "df", "tf")


@query("normalize_titles", f"SELECT page_id, {norm_sql('url')} AS title, CAST(length(url) AS BIGINT) AS n FROM pages")
def normalize_titles(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.normalize_title("url").alias("title"), F.length("url").alias("n"))


@query(
    "normalize_paths",
    r"SELECT page_id, trim(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(p), '\.md$', ''), '[-_\s]+', ' ', 'g'), '^\./', ''), '^/', ''), '\', '/')) AS path FROM (SELECT page_id, './Notes_' || page_id || '--Some File.MD' AS p FROM pages)",
)
def normalize_paths(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.concat(F.lit("./Notes_"), F.col("page_id").cast("string"), F.lit("--Some File.MD")).alias("p"))
    return p.select("page_id", T.normalize_path("p").alias("path"))


@query("html_to_text", r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '</(p|div|h[1-6]|li|tr|br)>', chr(10), 'gi'), '<br\s*/?>', chr(10), 'gi'), '<[^>]+>', '', 'g') AS t FROM a),
c AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '\s+', ' ', 'g')) AS t FROM b)
SELECT page_id, CASE WHEN length(t) > 10000 THEN t[1:10000] || '...' ELSE t END AS text FROM c""")
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.html_to_text("html").alias("text"))


@query("page_title", r"SELECT page_id, trim(regexp_extract(html, '(?i)<title[^>]*>([^<]*)</title>', 1)) AS title, regexp_extract(html, '(?i)<meta[^>]+name=[""'']description[""''][^>]+content=[""'']([^""'']*)[""'']', 1) AS description FROM pages")
def page_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.html_title("html").alias("title"), T.html_description("html").alias("description"))


@query("page_links", "SELECT page_id, CAST(len(l) AS BIGINT) AS links, array_to_string(list_distinct(l).list_sort(), ' ') AS targets FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS l FROM pages)")
def page_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.html_links("html").alias("l")).select("page_id", F.size("l").alias("links"), F.array_join(F.array_sort(F.array_distinct("l")), " ").alias("targets"))


@query("detect_language_counts", r"""
SELECT lang, CASE WHEN ko + ja + zh < 10 THEN 'en' WHEN ko > ja AND ko > zh THEN 'ko' WHEN ja > 0 THEN 'ja' WHEN zh > ko THEN 'zh' ELSE 'en' END AS detected, count(*) AS n FROM (
 SELECT lang, len(regexp_extract_all(text, '[\x{AC00}-\x{D7AF}]')) AS ko, len(regexp_extract_all(text, '[\x{3040}-\x{30FF}]')) AS ja, len(regexp_extract_all(text, '[\x{4E00}-\x{9FFF}]')) AS zh FROM documents) GROUP BY 1, 2""")
def detect_language_counts(spark, sf):
    return docs(spark, sf).groupBy("lang", T.detect_language("text").alias("detected")).agg(F.count("*").alias("n"))


@query("scalar_hashes", "SELECT doc_id, sha256(text) AS content_hash, sha256(text)[1:16] AS cache_key, 'q-' || sha1(text)[1:12] AS stable_id, CAST(ceil(length(text) / 3.0) AS BIGINT) AS tokens3, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens4, CASE WHEN length(text) > 100 THEN text[1:100] || '...' ELSE text END AS preview FROM documents")
def scalar_hashes(spark, sf):
    return docs(spark, sf).select("doc_id", T.content_hash("text").alias("content_hash"), T.cache_key("text").alias("cache_key"), T.stable_id("text").alias("stable_id"), T.estimate_tokens("text", 3).alias("tokens3"), T.estimate_tokens("text", 4).alias("tokens4"), T.preview("text", 100).alias("preview"))


@query("wikilink_targets", f"WITH {NOTES_SQL} SELECT doc_id, array_to_string(list_transform(regexp_extract_all(content, '\\[\\[([^\\]|#]+)(?:#([^\\]|]+))?(?:\\|([^\\]]+))?\\]\\]', 1), lambda x: trim(x)), ';') AS targets, CAST(len(regexp_extract_all(content, '\\[\\[([^\\]|#]+)(?:#([^\\]|]+))?(?:\\|([^\\]]+))?\\]\\]')) AS BIGINT) AS links FROM notes")
def wikilink_targets(spark, sf):
    return notes(spark, sf).select("doc_id", F.array_join(T.wikilink_targets("content"), ";").alias("targets"), T.wikilink_count("content").alias("links"))


@query("link_context", f"""WITH {NOTES_SQL}, s AS (SELECT doc_id, content, instr(content, '[[') - 1 AS a, instr(content, ']]') + 1 AS b FROM notes),
t AS (SELECT doc_id, content, greatest(a - 50, 0) AS x, least(b + 50, length(content)) AS y FROM s)
SELECT doc_id, trim(regexp_replace(CASE WHEN x > 0 THEN '...' ELSE '' END || content[x + 1:y] || CASE WHEN y < length(content) THEN '...' ELSE '' END, chr(10) || '+', ' ', 'g')) AS context FROM t""")
def link_context(spark, sf):
    n = notes(spark, sf).withColumn("a", F.instr("content", "[[") - 1).withColumn("b", F.instr("content", "]]") + 1)
    return n.select("doc_id", T.link_context("content", F.col("a"), F.col("b")).alias("context"))


@query("grep_docs", "SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)license|copyright')) AS BIGINT) AS matches FROM documents WHERE regexp_matches(text, '(?i)license|copyright') ORDER BY doc_id LIMIT 50")
def grep_docs(spark, sf):
    return search_text.grep(docs(spark, sf), "license|copyright")


@query("line_search", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)
SELECT doc_id, count(*) AS score, CAST(min(pos) + 1 AS BIGINT) AS first_line, min_by(regexp_extract(line, '(?i)the [a-z]+', 0), pos) AS first_match FROM l WHERE regexp_matches(line, '(?i)the [a-z]+') GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 50""")
def line_search(spark, sf):
    return search_text.line_search(docs(spark, sf), "the [a-z]+")


@query("fixed_chunks", """WITH c AS (SELECT doc_id, text, length(text) AS n, CASE WHEN length(text) <= 1000 THEN 1 ELSE 1 + CAST(ceil((length(text) - 1000) / 800.0) AS BIGINT) END AS k FROM documents WHERE length(text) > 0),
e AS (SELECT doc_id, text, n, unnest(range(k)) AS i FROM c)
SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, CAST(i * 800 AS BIGINT) AS start, CAST(least(i * 800 + 1000, n) AS BIGINT) AS "end", trim(substring(text, i * 800 + 1, 1000)) AS content FROM e""")
def fixed_chunks(spark, sf):
    return chunk.fixed_chunks(docs(spark, sf))


@query("paragraph_chunks", """WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 0) AS p FROM documents)
SELECT doc_id, CAST(unnest(range(len(p))) AS BIGINT) AS chunk_index, unnest(p) AS content FROM p""")
def paragraph_chunks(spark, sf):
    return chunk.paragraph_chunks(docs(spark, sf), separator="\n")


@query("sentence_chunks")
def sentence_chunks(spark, sf):
    return chunk.chunk_notes(notes(spark, sf)).select("path", "chunk_index", "start", "end", "content")


@query("extract_anchors")
def extract_anchors(spark, sf):
    return links.extract_anchors(notes(spark, sf))


@query("concepts", r"""WITH w AS (SELECT doc_id, concept, count(*) AS n FROM (SELECT doc_id, unnest(list_filter(""" + tok("text") + r""", lambda w: length(w) >= 4)) AS concept FROM documents) GROUP BY ALL HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, concept) AS r FROM w)
SELECT doc_id, concept, 'repeated' AS kind, n FROM r WHERE r <= 5
UNION ALL SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b'))), 'proper', 1 FROM documents
UNION ALL SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\b[A-Z]{2,6}\b'))), 'term', 1 FROM documents""")
def concepts(spark, sf):
    return links.concepts(docs(spark, sf))


#: A small lexicon of this library's own.
SYNONYMS = {"developer": ["engineer", "programmer"], "research": ["study", "paper"], "license": ["permission", "terms"], "sea": ["search engine", "research"]}
PHRASES = [("(?i)developer.*the", ["the developers", "guild"]), ("(?i)never matches this", ["nothing"])]


def expand_sql() -> str:
    q = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    lexicon = ", ".join(f"({i}, '{k}', {q(v)})" for i, (k, v) in enumerate(SYNONYMS.items()))
    return rf"""WITH q AS (SELECT item_id AS query_id, 'developer research ' || text AS text FROM benchmark), lex(i, k, v) AS (VALUES {lexicon}),
    w AS (SELECT query_id, text, list_filter(regexp_split_to_array(lower(text), '[\s,.?!;:''"()\[\]{{}}]+'), lambda x: length(x) > 1 AND NOT list_contains({q(expand.STOP_WORDS)}, x)) AS keywords FROM q),
    e AS (SELECT query_id, unnest(range(len(keywords))) AS pos, unnest(keywords) AS kw FROM w),
    m AS (SELECT query_id, pos, i, kw, unnest(range(len(v))) AS j, unnest(v) AS term FROM e JOIN lex ON kw = k OR contains(kw, k) OR contains(k, kw)),
    p AS (SELECT query_id, -1 AS pos, 0 AS i, unnest([0, 1]) AS j, unnest({q(PHRASES[0][1])}) AS term FROM q WHERE regexp_matches(text, '{PHRASES[0][0]}')),
    a AS (SELECT query_id, term, min((pos, i, j)) AS place FROM (SELECT query_id, pos, i, j, term FROM m WHERE lower(term) <> kw UNION ALL SELECT * FROM p) GROUP BY ALL),
    f AS (SELECT a.query_id, term, row_number() OVER (PARTITION BY a.query_id ORDER BY place) AS r FROM a JOIN w USING (query_id) WHERE NOT list_contains(keywords, lower(term)))
    SELECT w.query_id, array_to_string(any_value(keywords), ' ') AS keywords, coalesce(string_agg(term, ';' ORDER BY r), '') AS expansions FROM w LEFT JOIN f ON w.query_id = f.query_id AND r <= 8 GROUP BY w.query_id"""


@query("expand_query", expand_sql())
def expand_query(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("developer research "), "text").alias("text"))
    return q.select("query_id", expand.expand_query("text", SYNONYMS, PHRASES).alias("e")).select("query_id", F.array_join("e.keywords", " ").alias("keywords"), F.array_join("e.expansions", ";").alias("expansions"))


EDITED_SQL = """edited AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0
UNION ALL SELECT doc_id + 1000000000, text FROM documents WHERE doc_id % 13 = 0)"""


def edited(d):
    """The corpus a while later: some texts changed, some notes gone, some new."""
    same = d.filter("doc_id % 11 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return same.union(d.filter("doc_id % 13 = 0").select(F.col("doc_id") + 1_000_000_000, "text"))


@query("merkle_changes", f"""WITH {EDITED_SQL} SELECT CAST(coalesce(d.doc_id, e.doc_id) AS VARCHAR) AS key, CASE WHEN d.doc_id IS NULL THEN 'added' WHEN e.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM documents d FULL JOIN edited e ON d.doc_id = e.doc_id WHERE d.doc_id IS NULL OR e.doc_id IS NULL OR d.text IS DISTINCT FROM e.text""")
def merkle_changes(spark, sf):
    d = docs(spark, sf).select("doc_id", "text")
    return merkle.changed_keys(d, edited(d))


@query("corpus_hash", """SELECT corpus_hash, documents FROM (SELECT sha256(string_agg(h, chr(10) ORDER BY b)) AS corpus_hash, CAST(sum(n) AS BIGINT) AS documents FROM (
SELECT b, sha256(string_agg(line, chr(10) ORDER BY doc_id)) AS h, count(*) AS n FROM (SELECT doc_id, CAST(doc_id AS VARCHAR) || chr(0) || sha256(coalesce(text, '')) AS line, doc_id % 4096 AS b FROM documents) GROUP BY b))""")
def corpus_hash(spark, sf):
    return search_text.corpus_hash(docs(spark, sf), bucket=F.pmod("doc_id", F.lit(4096)))


@query("message_search", """SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, substring(text, greatest(i - 30, 1), i - greatest(i - 30, 1) + 70) AS context FROM (SELECT *, instr(lower(text), 'the') AS i FROM conversations WHERE contains(lower(text), 'the') AND contains(lower(text), 'of')) ORDER BY conv_id DESC, turn LIMIT 20""")
def message_search(spark, sf):
    return sessions.message_search(table(spark, sf, "conversations"), ["the", "of"])


@query("session_summary", """SELECT conv_id, count(*) AS messages, CASE WHEN length(f) > 100 THEN f[1:100] || '...' ELSE f END AS first_user, CASE WHEN length(l) > 80 THEN l[1:80] || '...' ELSE l END AS last_message FROM (
SELECT *, min_by(text, turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) AS f, max_by(text, turn) OVER (PARTITION BY conv_id) AS l FROM conversations) GROUP BY conv_id, f, l""")
def session_summary(spark, sf):
    return sessions.session_summary(table(spark, sf, "conversations"))


@query("session_stats", "SELECT role, count(*) AS messages, count(DISTINCT conv_id) AS conversations, CAST(sum(length(text)) AS BIGINT) AS characters FROM conversations GROUP BY role")
def session_stats(spark, sf):
    return sessions.session_stats(table(spark, sf, "conversations"))


@query("session_merge", """WITH a AS (SELECT conv_id, turn, role, text, 0 AS priority FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, role, text, 1 FROM conversations WHERE turn % 3 = 0 UNION ALL SELECT conv_id, turn, role, text, 2 FROM conversations)
SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text, CAST(priority AS BIGINT) AS priority FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role || ':' || text[1:100] ORDER BY priority, turn, text) AS rn FROM a) WHERE rn = 1""")
def session_merge(spark, sf):
    c = table(spark, sf, "conversations")
    return sessions.merge_messages(c.filter("turn % 3 = 0"), c.filter("turn % 2 = 0"), c)


@query("session_export", "SELECT conv_id, string_agg('## ' || upper(role[1]) || role[2:] || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn, role, text) AS markdown FROM conversations GROUP BY conv_id")
def session_export(spark, sf):
    return sessions.export_markdown(table(spark, sf, "conversations"))


@query("cdc_diff", """WITH f AS (SELECT doc_id, sha256(text) AS h, doc_id AS mtime FROM documents WHERE doc_id % 10 <> 0),
o AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN sha256('old' || text) ELSE sha256(text) END AS h, CASE WHEN doc_id % 11 = 0 THEN doc_id - 1 ELSE doc_id END AS mtime FROM documents WHERE doc_id % 9 <> 0)
SELECT CAST(coalesce(f.doc_id, o.doc_id) AS VARCHAR) AS path, CASE WHEN o.h IS NULL THEN 'added' WHEN f.h IS NULL THEN 'removed' WHEN f.h <> o.h OR o.mtime < f.mtime THEN 'changed' ELSE 'same' END AS change FROM f FULL JOIN o ON f.doc_id = o.doc_id""")
def cdc_diff(spark, sf):
    d = docs(spark, sf).withColumn("path", F.col("doc_id").cast("string"))
    files = d.filter("doc_id % 10 <> 0").select("path", T.content_hash("text").alias("content_hash"), F.col("doc_id").alias("mtime"))
    meta = d.filter("doc_id % 9 <> 0").select("path", F.when(F.col("doc_id") % 7 == 0, T.content_hash(F.concat(F.lit("old"), "text"))).otherwise(T.content_hash("text")).alias("content_hash"), F.when(F.col("doc_id") % 11 == 0, F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("mtime"))
    return index.cdc(files, meta)


@query("index_upsert", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, n_chars + 1 FROM documents WHERE doc_id % 5 = 0 AND doc_id % 4 = 0")
def index_upsert(spark, sf):
    d = docs(spark, sf).select("doc_id", "n_chars")
    return index.upsert(d.filter("doc_id % 5 <> 0"), d.filter("doc_id % 4 = 0").withColumn("n_chars", F.col("n_chars") + 1), "doc_id", "n_chars")


@query("index_delete", "SELECT doc_id, n_chars FROM documents WHERE doc_id % 3 <> 0")
def index_delete(spark, sf):
    d = docs(spark, sf).select("doc_id", "n_chars")
    return index.delete(d, d.filter("doc_id % 3 = 0"), "doc_id")


@query("index_validate", """WITH h AS (SELECT 'v' || vec_id AS path, count(*) AS chunks, count(*) FILTER (WHERE len(embedding) <> 64) AS bad FROM embeddings WHERE vec_id % 5 <> 0 GROUP BY ALL), m AS (SELECT 'v' || vec_id AS path, CASE WHEN vec_id % 13 = 0 THEN 2 ELSE 1 END AS e FROM embeddings WHERE vec_id % 7 <> 0)
SELECT * FROM (SELECT coalesce(h.path, m.path) AS path, CASE WHEN m.e IS NULL THEN 'orphaned' WHEN h.chunks IS NULL THEN 'missing' WHEN h.chunks <> m.e THEN 'count_mismatch' WHEN h.bad > 0 THEN 'dimension_mismatch' END AS problem FROM h FULL JOIN m ON h.path = m.path) WHERE problem IS NOT NULL""")
def index_validate(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("path", F.concat(F.lit("v"), F.col("vec_id").cast("string")))
    meta = e.filter("vec_id % 7 <> 0").select("path", F.when(F.col("vec_id") % 13 == 0, 2).otherwise(1).alias("chunk_count"))
    return index.validate(e.filter("vec_id % 5 <> 0"), meta, 64)


@query("relative_time", """SELECT event_id, CASE WHEN s >= 0 THEN t || ' ago' ELSE 'in ' || t END AS said FROM (SELECT event_id, s, CASE WHEN a < 60 THEN a || ' second' || CASE WHEN a = 1 THEN '' ELSE 's' END WHEN a < 3600 THEN a // 60 || ' minute' || CASE WHEN a // 60 = 1 THEN '' ELSE 's' END WHEN a < 86400 THEN a // 3600 || ' hour' || CASE WHEN a // 3600 = 1 THEN '' ELSE 's' END WHEN a < 604800 THEN a // 86400 || ' day' || CASE WHEN a // 86400 = 1 THEN '' ELSE 's' END WHEN a < 2592000 THEN a // 604800 || ' week' || CASE WHEN a // 604800 = 1 THEN '' ELSE 's' END ELSE a // 2592000 || ' month' || CASE WHEN a // 2592000 = 1 THEN '' ELSE 's' END END AS t FROM (SELECT event_id, s, abs(s) AS a FROM (SELECT event_id, CAST(floor(epoch(TIMESTAMP '2024-01-15 12:00:00')) - floor(epoch(ts)) AS BIGINT) AS s FROM events)))""")
def relative_time(spark, sf):
    return table(spark, sf, "events").select("event_id", T.relative_time("ts", F.lit("2024-01-15 12:00:00").cast("timestamp")).alias("said"))


@query("map_folder", """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'projects' WHEN c_mktsegment = 'MACHINERY' THEN 'resources' ELSE 'inbox' END AS folder FROM customer""")
def map_folder(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", T.map_folder(F.concat(F.lit("vault/"), "c_mktsegment", F.lit("/note.md")), [("building", "projects"), ("machinery", "resources")]).alias("folder"))


@query("dice_similarity", """WITH p AS (SELECT p_partkey, lower(trim(p_name)) AS n FROM part), g AS (SELECT p_partkey, CASE WHEN length(n) < 2 THEN [n] ELSE list_distinct(list_transform(range(1, length(n)), lambda i: substring(n, CAST(i AS BIGINT), 2))) END AS g FROM p)
SELECT a.p_partkey AS a, b.p_partkey AS b, round(2.0 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)), 6) AS dice FROM g a JOIN g b ON b.p_partkey = a.p_partkey + 1""")
def dice_similarity(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_partkey").alias("b"), F.col("p_name").alias("other"))
    return p.join(q, "p_partkey").select(F.col("p_partkey").alias("a"), "b", S.dice("p_name", "other").alias("dice"))


@query("token_jaccard", r"""WITH p AS (SELECT p_partkey, list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[\s\-_.,;:!?''"()\[\]{}]+'), lambda w: length(w) > 0)) AS t, lower(trim(p_name)) AS n FROM part)
SELECT a.p_partkey AS a, b.p_partkey AS b, round(len(list_intersect(a.t, b.t))::DOUBLE / greatest(len(list_distinct(list_concat(a.t, b.t))), 1), 6) AS jaccard, round(CASE WHEN contains(a.n, b.n) OR contains(b.n, a.n) THEN least(length(a.n), length(b.n))::DOUBLE / greatest(length(a.n), length(b.n)) ELSE 0.0 END, 6) AS containment FROM p a JOIN p b ON b.p_partkey = a.p_partkey + 1""")
def token_jaccard(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_partkey").alias("b"), F.col("p_name").alias("other"))
    return p.join(q, "p_partkey").select(F.col("p_partkey").alias("a"), "b", S.token_jaccard("p_name", "other").alias("jaccard"), S.containment("p_name", "other").alias("containment"))


@query("jaro_winkler_pairs")
def jaro_winkler_pairs(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_partkey").alias("b"), F.col("p_name").alias("other"))
    return p.join(q, "p_partkey").select(F.col("p_partkey").alias("a"), "b", S.jaro_winkler("p_name", "other").alias("jaro_winkler"), S.composite("p_name", "other").alias("composite"))


@query("events_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf):
    return jobs.tumbling(table(spark, sf, "events"))


@query("events_sliding", "SELECT b - INTERVAL 1 HOUR * k AS start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS b, event_type FROM events), (SELECT unnest([0, 1]) AS k) GROUP BY ALL")
def events_sliding(spark, sf):
    return jobs.sliding(table(spark, sf, "events"))


@query("events_sessions", """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, k""")
def events_sessions(spark, sf):
    return jobs.sessions(table(spark, sf, "events"))


@query("events_rollup", "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ROLLUP (event_type, CAST(ts AS DATE))")
def events_rollup(spark, sf):
    return table(spark, sf, "events").withColumn("day", F.to_date("ts")).rollup("event_type", "day").agg(F.count("*").alias("n"))
