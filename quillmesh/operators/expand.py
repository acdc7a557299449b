"""Query expansion: keywords, synonyms and phrase patterns, as expressions over a column of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Korean and English stop words of query keywords.
STOP_WORDS = (
    "이 가 을 를 에 의 로 으로 에서 와 과 도 은 는 이나 거나 하고 에게 한테 께 보다 처럼 같이 만큼 이랑 랑 하면 으면 면 어서 아서 니까 므로 는데 지만 어도 아도 여도 야 이야 거든 더니 다가 "
    "그 저 이것 저것 그것 누구 무엇 어디 언제 어떻게 왜 뭐 뭘 어떤 있어 없어 했어 있는 없는 하는 된 할 수 것 거 등 중 때 년 월 일 적 "
    "the a an is are was were be been being have has had do does did will would could should may might can must and or but if then so because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further once i me my myself we our ours ourselves you your yours yourself he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am"
).split()


def lexicon_of(rows: DataFrame, most: int = 10_000) -> dict[str, list[str]]:
    """A table (key, related array) as expand_query's synonyms; more than `most` rows are an error."""
    got = rows.select("key", "related").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a lexicon travels with the query: it may have {most} keys at most")
    return {r["key"]: list(r["related"]) for r in sorted(got, key=lambda r: r["key"])}


def expand_query(text: Column | str, synonyms: dict[str, list[str]], phrases: list[tuple[str, list[str]]] = (), stop_words: list[str] = STOP_WORDS, most: int = 8) -> Column:
    """struct<keywords, expansions>: up to `most` terms, those of matching phrases first, then synonyms.

    The lexicon is the caller's: related terms by key (lexicon_of reads a table), and patterns with what they add. A synonym key matches a keyword that equals it, holds it or is held by it; a keyword is no expansion of its own query.
    """
    keys = T.keywords(text, stop_words)
    none = F.array().cast("array<string>")
    said = [F.when(F.rlike(T.col(text), F.lit(p)), F.array(*map(F.lit, e))).otherwise(none) for p, e in phrases]
    table = F.array(*[F.struct(F.lit(k.lower()).alias("k"), F.array(*map(F.lit, v)).alias("v")) for k, v in synonyms.items()]) if synonyms else None

    def related(w: Column) -> Column:
        hit = F.filter(table, lambda x: (x["k"] == w) | F.contains(w, x["k"]) | F.contains(x["k"], w))
        return F.filter(F.flatten(F.transform(hit, lambda x: x["v"])), lambda t: F.lower(t) != w)

    syn = F.flatten(F.transform(keys, related)) if synonyms else none
    found = F.array_distinct(F.concat(*said, syn) if said else syn)
    low = F.transform(keys, F.lower)
    return F.struct(keys.alias("keywords"), F.slice(F.filter(found, lambda t: ~F.array_contains(low, F.lower(t))), 1, most).alias("expansions"))


def search_terms(queries: DataFrame, synonyms: dict[str, list[str]], weight: float = 0.3, **how) -> DataFrame:
    """query_id, term, weight: a query's own terms at 1, its expansions' at `weight`; a term keeps its larger weight."""
    e = queries.withColumn("e", expand_query("text", synonyms, **how))
    own = e.select("query_id", F.explode(F.array_distinct(T.tokenize("text"))).alias("term"), F.lit(1.0).alias("weight"))
    more = e.select("query_id", F.explode(F.array_distinct(F.flatten(F.transform("e.expansions", T.tokenize)))).alias("term"), F.lit(weight).alias("weight"))
    return own.union(more).groupBy("query_id", "term").agg(F.max("weight").alias("weight"))
