"""Link suggestion: anchor spans in text, targets for them, and suggestions; concept extraction; hold-out of links."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import bound_batches, materialize

#: Words that are no anchors by themselves.
STOP_EN = frozenset(
    "the a an is are was were be been being have has had do does did will would could should may might must can this that these those i you he she it we they what which who when where why how all each every both few more most other some such no nor not only own same so than too very just also".split()
)
STOP_KO = frozenset("이 그 저 것 수 등 및 또는 그리고 하지만 때문에 위해 통해 대해 에서 으로 에게 부터".split())
#: Kinds of anchors, best first, and the patterns that find them.
PRIORITY = {"title_match": 0, "header_match": 1, "technical_term": 2, "proper_noun": 3, "noun_phrase": 4}
TECHNICAL = [re.compile(p, re.A) for p in (r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b", r"\b[A-Z]{2,6}\b", r"\b[a-zA-Z]+-[a-zA-Z]+(?:-[a-zA-Z]+)*\b")]
PROPER = re.compile(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,4}\b", re.A)
HANGUL = re.compile(r"[가-힣]+(?:\s*[가-힣a-zA-Z0-9]+)*")
HAN_KANA = re.compile(r"[一-鿿぀-ゟ゠-ヿ]+")
LINK = re.compile(r"\[\[([^\]|#]+)(?:#([^\]|]+))?(?:\|([^\]]+))?\]\]")
#: A word's edge, with ASCII word characters only.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: Code points by which texts that may hold one another are found.
BLOCK = 64
ANCHORS = "path string, text string, start int, end int, kind string"


def anchors_of(text: str, titles: list[str] = (), least: int = 2, most: int = 100, most_words: int = 10, spans: list[tuple[int, int]] = ()) -> list[tuple[str, int, int, str]]:
    """Non-overlapping anchor spans in order: at a start the best kind, then the longest; earlier spans win.

    Spans within existing links are left out. Titles match as substrings whatever their case, kind title_match; `spans` are
    places of titles that are found already.
    """
    taken = [m.span() for m in LINK.finditer(text)]
    found: list[tuple[int, int, int, str]] = []

    def add(start: int, end: int, kind: str) -> None:
        if least <= end - start <= most and not any(start < b and end > a for a, b in taken):
            found.append((start, PRIORITY[kind], -(end - start), kind))

    for a, b in spans:
        add(a, b, "title_match")
    low = text.lower()
    for title in titles:
        t = title.lower()
        at = low.find(t) if len(t) >= least else -1
        while at >= 0:
            add(at, at + len(t), "title_match")
            at = low.find(t, at + 1)
    for p in TECHNICAL:
        for m in p.finditer(text):
            add(*m.span(), "technical_term")
    for m in PROPER.finditer(text):
        words = m[0].split()
        if len(words) == 1 and (m.start() == 0 or re.search(r"[.!?]\s*$", text[max(0, m.start() - 40) : m.start()])):
            continue
        if len(words) <= most_words and m[0].lower() not in STOP_EN:
            add(*m.span(), "proper_noun")
    for m in HANGUL.finditer(text):
        if m[0] not in STOP_KO:
            add(*m.span(), "noun_phrase")
    for m in HAN_KANA.finditer(text):
        add(*m.span(), "noun_phrase")
    out, last, seen = [], -1, -1
    for start, _, size, kind in sorted(found):
        if start != seen and start >= last:
            out.append((text[start : start - size], start, start - size, kind))
            last = start - size
        seen = start
    return out


def extract_anchors(notes: DataFrame, titles: list[str] | DataFrame | None = None) -> DataFrame:
    """Anchor spans (see ANCHORS) of notes with path and content, and the places where titles stand, whatever their case.

    `titles` are a bounded list that travels with the tasks, or any number of rows (path, title), which automata find; of
    the latter, a note's own title counts only if another note has it, too. Null contents have no anchors.
    """
    from .titles import title_hits

    few = [] if titles is None or isinstance(titles, DataFrame) else list(titles)
    asked = notes.select("path", "content", F.lit(None).cast("array<struct<a:int,b:int>>").alias("spans"))
    if isinstance(titles, DataFrame):
        hits = title_hits(notes, titles, overlapping=True).groupBy("path").agg(F.collect_set(F.struct(F.col("start").alias("a"), F.col("end").alias("b"))).alias("spans"))
        asked = notes.select("path", "content").join(hits, "path", "left")

    def run(batches):
        for b in batches:
            spans = [[(x["a"], x["b"]) for x in s] if s is not None else [] for s in b["spans"]]
            rows = [(p, *a) for p, t, s in zip(b["path"], b["content"], spans, strict=True) for a in anchors_of(t or "", few, spans=s)]
            yield pd.DataFrame(rows, columns=["path", "text", "start", "end", "kind"])

    bound_batches(notes.sparkSession)
    return asked.mapInPandas(run, ANCHORS)


def _blocks(texts: DataFrame, name: str, lengths: list[int], side: int) -> DataFrame:
    """Distinct texts with hashes by which those that hold one another meet: on one side a text's first BLOCK code points,
    on the other its substrings as long as such starts are (`lengths`, those of the other table's) and it is at most twice."""
    n = F.length(name)
    of_size = lambda m: F.transform(F.sequence(F.lit(1), n - m + 1), lambda i: F.xxhash64(F.substring(F.col(name), i, m)))
    sizes = F.filter(F.lit(lengths).cast("array<int>"), lambda m: (m <= n) & ((2 * m >= n) | (m == BLOCK)))
    at = lambda k, h: F.struct(F.lit(k).alias("side"), h.alias("block"))
    held = F.transform(F.array_distinct(F.flatten(F.transform(sizes, of_size))), lambda h: at(1 - side, h))
    return texts.filter(n > 0).select(name, F.explode(F.concat(F.array(at(side, F.xxhash64(F.substring(name, 1, BLOCK)))), held)).alias("b")).select("b.side", "b.block", name)


def _first(rows: DataFrame, name: str, k: int) -> DataFrame:
    """The k + 1 rows of least path for each value of a column: k, and one that may be the anchor's own note."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(name).orderBy("path"))).filter(F.col("_n") <= k + 1).drop("_n")


def semantic_targets(anchors: DataFrame, notes: DataFrame, index: DataFrame, quantizer, chunks: DataFrame, *, embedder=None, threshold: float = 0.3, k: int = 3, probes: int | None = None) -> DataFrame:
    """key, path, title, base: for each distinct anchor text (key, in lower case without outer blanks) the notes of its 2 k
    nearest chunks by meaning whose cosine reaches the threshold, with their best chunk's.

    index and quantizer are an approximate vector index (see ann) of chunks (id, path); texts are embedded by the same
    embedder as the chunks. probes: lists asked; None is the exact way, for which index may also be the chunks' vectors (id,
    vector) and quantizer None. For match_targets.
    """
    from .ann import exact, search
    from .index import embed

    keys = anchors.select(F.lower(F.trim("text")).alias("key")).filter("key is not null").distinct().withColumn("query_id", F.xxhash64("key"))
    asked = embed(keys, "key", embedder).select("query_id", F.col("embedding").alias("vector"))
    hits = exact(index, asked, 2 * k, threshold) if quantizer is None else search(index, quantizer, asked, 2 * k, probes=probes)
    hits = hits.filter(F.col("similarity") >= threshold)
    best = hits.join(chunks.select("id", "path"), "id").groupBy("query_id", "path").agg(F.max("similarity").alias("base"))
    return best.join(keys, "query_id").join(notes.select("path", "title"), "path").select("key", "path", "title", "base")


def match_targets(anchors: DataFrame, notes: DataFrame, threshold: float = 0.3, k: int = 3, semantic: DataFrame | None = None) -> DataFrame:
    """anchors with their best k targets: exact title 1, alias .95, header .85, partial title .7 * overlap (at least half).

    Exact, alias and header matches are equi-joins on the lower-case text; every note with the header is a target, and of
    notes that share a title or alias one is exact and the titles of the others are partial. Partial ones join the shorter
    text's first BLOCK code points with the longer's substrings of each length that titles have, over distinct texts, so
    all containments of at least half are found. A note is no target of its own anchors. Notes that share a header or title
    score alike and rank by path, so the first k + 1 of them, and of an anchor's targets, are enough for the best k.

    With `semantic` (see semantic_targets) an anchor of fewer than k targets also gets notes that are near by meaning, at .8
    of their similarity; a note that is a target already keeps its score.
    """
    low = F.lower(F.trim("title"))
    title = notes.groupBy(low.alias("key")).agg(F.max(F.struct("path", "title")).alias("m")).select("key", "m.path", "m.title", F.lit(1.0).alias("base"), F.lit("exact").alias("match"))
    alias = notes.select("path", "title", F.explode("aliases").alias("a")).groupBy(F.lower(F.trim("a")).alias("key")).agg(F.min(F.struct("path", "title")).alias("m")).select("key", "m.path", "m.title", F.lit(0.95).alias("base"), F.lit("alias").alias("match"))
    heads = notes.select("path", "title", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?m)^#{1,3}\s+(.+)$"), F.lit(1)))).alias("h"))
    header = heads.select(F.lower(F.trim("h")).alias("key"), "path", "title", F.lit(0.85).alias("base"), F.lit("header").alias("match")).distinct()
    header = _first(header, "key", k)
    asked = anchors.withColumn("key", F.lower(F.trim("text"))).withColumnRenamed("path", "src_path")
    keys, titles = asked.select("key").distinct(), notes.select(low.alias("tl")).distinct()
    lengths = lambda df, c: sorted(r[0] for r in df.select(F.least(F.length(c), F.lit(BLOCK))).distinct().collect() if r[0])
    of_titles = lengths(titles, "tl")
    longest = 2 * max(of_titles, default=0)
    of_keys = list(range(1, min(BLOCK, longest) + 1)) if longest else []
    held = _blocks(keys, "key", of_titles, 0).join(_blocks(titles, "tl", of_keys, 1), ["side", "block"])
    ratio = F.least(F.length("key"), F.length("tl")) / F.greatest(F.length("key"), F.length("tl"))
    texts = held.select("key", "tl").filter((F.contains("key", F.col("tl")) | F.contains("tl", F.col("key"))) & (ratio >= 0.5)).distinct()
    near = texts.join(_first(notes.select("path", "title", low.alias("tl")).distinct(), "tl", k), "tl").select("key", "path", "title", (0.7 * ratio).alias("base"), F.lit("partial").alias("match"))
    all_ = title.union(alias).union(header).union(near).filter(F.col("base") >= threshold)
    best = all_.groupBy("key", "path", "title").agg(F.max(F.struct("base", "match")).alias("m")).select("key", "path", "title", F.col("m.base").alias("score"), "m.match")
    order = Window.partitionBy("key").orderBy(F.desc("score"), "path")
    targets = best.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    best = asked.distinct().join(targets, "key").filter(F.col("src_path") != F.col("path")).select("src_path", "text", "start", "end", "kind", "path", "title", "score", "match")
    if semantic is not None:
        near = asked.distinct().join(semantic.select("key", "path", "title", (0.8 * F.col("base")).alias("score"), F.lit("semantic").alias("match")), "key").filter(F.col("src_path") != F.col("path"))
        by, said = ["src_path", "start", "end"], F.col("match") != "semantic"
        both = best.union(near.select(*best.columns)).withColumn("_direct", F.count_if(said).over(Window.partitionBy(*by)))
        both = both.filter(said | ((F.col("_direct") < k) & (F.col("score") >= threshold)))
        once = Window.partitionBy(*by, "path").orderBy((F.col("match") == "semantic").cast("int"))
        best = both.withColumn("_o", F.row_number().over(once)).filter("_o = 1").drop("_direct", "_o")
    w = Window.partitionBy("src_path", "start", "end").orderBy(F.desc("score"), "path")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def suggestion_confidence(score: Column, kind: Column) -> Column:
    factor = F.when(kind == "title_match", 1.2).when(kind == "header_match", 1.1).when(kind == "technical_term", 1.0).when(kind == "proper_noun", 0.95).otherwise(0.9)
    return F.least(F.greatest(score * factor, F.lit(0.0)), F.lit(1.0))


def suggest_links(matches: DataFrame, linked: DataFrame, most: int = 10) -> DataFrame:
    """One target an anchor, no target twice or already linked (src_path, path) from the note; the first `most` in text
    order, then by confidence."""
    best = matches.filter("rank = 1").join(linked.select("src_path", "path").distinct(), ["src_path", "path"], "left_anti")
    once = best.withColumn("o", F.row_number().over(Window.partitionBy("src_path", "path").orderBy("start"))).filter("o = 1")
    first = once.withColumn("n", F.row_number().over(Window.partitionBy("src_path").orderBy("start"))).filter(F.col("n") <= most)
    conf = first.withColumn("confidence", F.round(suggestion_confidence(F.col("score"), F.col("kind")), 6))
    reason = F.when(F.col("match") == "exact", "title").when(F.col("match") == "alias", "alias").when(F.col("match") == "header", "heading").when(F.col("match") == "partial", "part of a title").otherwise("similar")
    return conf.withColumn("reason", reason).withColumn("rank", F.row_number().over(Window.partitionBy("src_path").orderBy(F.desc("confidence"), "start"))).drop("o", "n")


def concepts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = 2, top: int = 5) -> DataFrame:
    """id, concept, kind, n: capitalised phrases, acronyms, and words of four letters or more repeated at least `least` times (top by count)."""
    proper = docs.select(id_col, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(rf"{EDGE}[A-Z][a-z]+(?: [A-Z][a-z]+)+{EDGE}"), F.lit(0)))).alias("concept"), F.lit("proper").alias("kind"), F.lit(1).cast("long").alias("n"))
    acronym = docs.select(id_col, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(EDGE + "[A-Z]{2,6}" + EDGE), F.lit(0)))).alias("concept"), F.lit("term").alias("kind"), F.lit(1).cast("long").alias("n"))
    words = docs.select(id_col, F.explode(F.filter(T.tokenize(text), lambda w: F.length(w) >= 4)).alias("concept")).groupBy(id_col, "concept").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    ranked = words.withColumn("r", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("n"), "concept"))).filter(F.col("r") <= top).select(id_col, "concept", F.lit("repeated").alias("kind"), "n")
    return proper.union(acronym).union(ranked)


def apply_wikilinks(content: str, terms: list[str], most: int = 30, repeats: bool = False) -> str:
    """Wraps occurrences of terms as links, longest first, outside existing links; the first of each unless repeats."""
    done = 0
    for term in sorted(set(terms), key=lambda t: (-len(t), t)):
        spans = [m.span() for m in LINK.finditer(content)]
        hits = [m.span() for m in re.finditer(rf"(?<!\w){re.escape(term)}(?!\w)", content) if not any(m.start() < b and m.end() > a for a, b in spans)]
        for a, b in reversed(hits if repeats else hits[:1]):
            if done < most:
                content, done = f"{content[:a]}[[{content[a:b]}]]{content[b:]}", done + 1
    return content


def hold_out_links(notes: DataFrame, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """path, target, alias, start and end (in the text without the removed links) of the links held out of each note:
    max(1, floor(n * ratio)) of n, those of least seeded hash, so the choice depends on neither order nor layout."""
    import hashlib

    def run(batches):
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["content"], strict=True):
                found = list(LINK.finditer(text or ""))
                if not found:
                    continue
                key = lambda m, path=path: hashlib.sha256(f"{seed}\0{path}\0{m.start()}".encode()).digest()
                out = sorted(sorted(found, key=key)[: max(1, int(len(found) * ratio))], key=lambda m: m.start())
                gone = 0
                for m in out:
                    anchor = m[3] or m[1]
                    start = m.start() - gone
                    rows.append((path, m[1].strip(), m[3], start, start + len(anchor)))
                    gone += len(m[0]) - len(anchor)
            yield pd.DataFrame(rows, columns=["path", "target", "alias", "start", "end"])

    bound_batches(notes.sparkSession)
    return notes.select("path", "content").mapInPandas(run, "path string, target string, alias string, start int, end int")


def overlaps(spans: DataFrame, excluded: DataFrame) -> DataFrame:
    """Spans (path, start, end) that touch no excluded span of their path."""
    e = excluded.select(F.col("path").alias("_p"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return spans.join(e, (F.col("path") == F.col("_p")) & (F.col("start") < F.col("_e")) & (F.col("end") > F.col("_s")), "left_anti")


def similar_to(targets: DataFrame, target: str, threshold: float = 0.7) -> DataFrame:
    """The other targets whose composite similarity to one reaches the threshold, most similar first."""
    from ..functions import similarity as S

    scored = targets.filter(F.col("target") != target).withColumn("similarity", F.round(S.composite(F.lit(target), F.col("target")), 6))
    return scored.filter(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "target")


def suggest_concepts(found: DataFrame, id_col: str = "doc_id", most: int = 20, repeated: int = 5) -> DataFrame:
    """Of concepts (id, concept, kind, n), each text's suggestions in order: proper nouns, terms, and the `repeated` most
    frequent words; one of those that differ in case only, the first; `most` at most. id, concept, rank."""
    place = F.when(F.col("kind") == "proper", 0).when(F.col("kind") == "term", 1).otherwise(2)
    order = Window.partitionBy(id_col, "kind").orderBy(F.desc("n"), "concept")
    some = found.withColumn("_k", F.row_number().over(order)).filter((F.col("kind") != "repeated") | (F.col("_k") <= repeated)).withColumn("_p", place)
    once = some.withColumn("_o", F.row_number().over(Window.partitionBy(id_col, F.lower("concept")).orderBy("_p", "_k"))).filter("_o = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy("_p", "_k"))).filter(F.col("rank") <= most).select(id_col, "concept", "rank")


def suggestions_for(suggestions: DataFrame, queries: DataFrame) -> DataFrame:
    """Suggestions (path, text, start, end) of each query (id, path, anchor, start, end): of the same anchor text but for
    case and outer blanks, or whose span overlaps the query's."""
    q = queries.select("id", "path", F.lower(F.trim("anchor")).alias("_a"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    hit = (F.lower(F.trim("text")) == F.col("_a")) | F.coalesce((F.col("start") < F.col("_e")) & (F.col("end") > F.col("_s")), F.lit(False))
    return suggestions.join(q, "path").filter(hit).drop("_a", "_s", "_e")


def similar_clusters(targets: DataFrame, threshold: float = 0.7, most: int | None = None) -> DataFrame:
    """Clusters of similar dangling targets (target, occurrences, sources): component, representative, member, similarity,
    total occurrences and the members' average similarity; with `most`, the clusters that occur most.

    Pairs are those that reach the composite similarity (see fuzzy.similar_pairs); clusters are their components of two
    members or more; the representative occurs most, then has most sources, then is first.
    """
    from .fuzzy import similar_pairs
    from .graph import connected_components

    scored = materialize(similar_pairs(targets, threshold), "similar-pairs")
    comp = connected_components(targets.select(F.col("target").alias("v")), scored.select(F.col("target").alias("a"), F.col("other").alias("b")))
    members = comp.withColumnRenamed("v", "target").join(targets, "target")
    sized = members.groupBy("component").agg(F.count("*").alias("size"), F.min(F.struct((-F.col("occurrences")).alias("o"), (-F.col("sources")).alias("s"), F.col("target"))).alias("r"), F.sum("occurrences").alias("total")).filter("size > 1")
    joined = members.join(sized.select("component", F.col("r.target").alias("representative"), "total"), "component")
    both = scored.select("target", F.col("other").alias("representative"), "similarity").union(scored.select("other", "target", "similarity"))
    out = joined.join(both, ["target", "representative"], "left").select("component", "representative", F.col("target").alias("member"), F.when(F.col("target") == F.col("representative"), 1.0).otherwise(F.coalesce("similarity", F.lit(0.0))).alias("similarity"), "total")
    stats = out.groupBy("component").agg(F.round(F.avg("similarity"), 6).alias("average"), F.max("total").alias("_t"))
    if most is not None:
        stats = stats.orderBy(F.desc("_t"), "component").limit(most)
    return out.join(stats.drop("_t"), "component")
