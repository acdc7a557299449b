"""Fuzzy joins: by edit distance over tries of sorted texts, and by the composite similarity through prefixes of sets.

The right texts are sorted and cut into runs of RIGHT_PART; in a run, texts of one length form a trie, whose nodes are ranges
of the sorted rows. The left texts walk down it together, a row of the distance table for each text and node, all rows of a
level at once. A node is left as soon as no text below it can be near enough, and texts that begin alike are compared with
their common beginning once. So work grows with the nodes that stay within reach, not with the product of the sides.

Before that, texts at distance 1 or less are joined by what is left of them without one code point. A left text whose k best
are among those, or that nothing farther can be similar enough to, does not walk at all.

The composite similarity is bounded by the sets of bigrams and tokens of two texts, so a pair that reaches the threshold has
so many bigrams or tokens in common, or the one text holds the other. Such pairs share a member among the rarest few of both.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..session import materialize, no_broadcasts

#: Right texts in a run and left texts that meet it in one task.
RIGHT_PART, LEFT_PART = 2048, 8192
#: Texts of a gram that are dealt to one part.
GRAM_ROWS = 2000
#: Cells of distance tables at once in a task.
TABLE_CELLS = 1 << 21
#: Code points of a left text up to which it is joined without one of them; longer ones walk.
CLOSE_LENGTH = 256
#: Pairs that a task holds before it keeps the k nearest of each text, and right texts of a beginning or end that give bounds.
HELD_PAIRS, BOUNDING = 1 << 20, 8


def codes_of(texts: list[str], length: int) -> np.ndarray:
    """Texts of one length as rows of code points."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), length) if length else np.zeros((len(texts), 0), np.uint32)


class Trie:
    """Sorted distinct rows of one length: for each depth, where each node's rows begin and where its children do."""

    def __init__(self, rows: np.ndarray):
        n, m = rows.shape
        new = np.zeros(n, bool)
        new[:1] = True
        starts = np.zeros(min(n, 1), np.int64)
        self.rows, self.length, self.children, self.chars = rows, m, [], []
        for t in range(m):
            new[1:] |= rows[1:, t] != rows[:-1, t]
            below = np.flatnonzero(new)
            self.children.append(np.append(np.searchsorted(below, starts), len(below)))
            self.chars.append(rows[below, t])
            starts = below

    def near(self, left: np.ndarray, budget: int | np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(left rows, trie's rows, distances) of all pairs within the budget, one for all or one for each left row, which
        may shrink while pairs are taken; left rows are of one length, too. Counts of the tables' rows that were filled are
        added to `self.steps`."""
        budget = np.broadcast_to(budget, len(left))
        width, m = left.shape[1], self.length
        columns = np.arange(width + 1, dtype=np.int16)
        first = np.broadcast_to(columns, (len(left), width + 1))
        waiting = [(0, np.arange(len(left)), np.zeros(len(left), np.int64), first)] if len(self.rows) and len(left) else []
        self.steps = 0
        while waiting:
            depth, at, node, table = waiting.pop()
            if depth == m:
                yield at, node, table[:, width]
                continue
            begin, end = self.children[depth][node], self.children[depth][node + 1]
            counts = end - begin
            most = max(1, TABLE_CELLS // (width + 1))
            if counts.sum() > most and len(at) > 1:
                half = len(at) // 2
                waiting += [(depth, at[:half], node[:half], table[:half]), (depth, at[half:], node[half:], table[half:])]
                continue
            row = np.repeat(np.arange(len(at)), counts)
            child = np.repeat(begin, counts) + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            before, who = table[row], at[row]
            self.steps += len(row)
            best = np.minimum(before[:, :-1] + (left[who] != self.chars[depth][child][:, None]), before[:, 1:] + 1) if width else before[:, 1:]
            new = np.concatenate((before[:, :1] + 1, best), axis=1).astype(np.int16)
            new = np.minimum.accumulate(new - columns, axis=1) + columns
            rest = np.abs((width - columns) - (m - depth - 1))
            keep = (new + rest).min(axis=1) <= budget[who]
            waiting.append((depth + 1, who[keep], child[keep], new[keep]))


class _Nearest:
    """The k most similar rows of each left text so far, ties by the rows' order; HELD_PAIRS and k a text at most are held."""

    def __init__(self, k: int, order: np.ndarray):
        self.k, self.order, self.size = k, order, 0
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

    def add(self, at: np.ndarray, row: np.ndarray, sim: np.ndarray) -> bool:
        """Whether there are so many that `best` is due."""
        self.held.append((at, row, sim))
        self.size += len(at)
        return self.size > HELD_PAIRS

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Left texts, rows, similarities and places (from 0) of the k best, best first."""
        at, row, sim = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((self.order[row], -sim, at))
        at, row, sim = at[order], row[order], sim[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        own = place < self.k
        at, row, sim, place = at[own], row[own], sim[own], place[own]
        self.held, self.size = [(at, row, sim)], 0
        return at, row, sim, place


def _pairs(threshold: float, k: int):
    """cogroup: left (text, low, length, bound) and right (other, low, length) of one run and length -> text, other,
    similarity: each left text's k nearest of these. What is less similar than a text's bound is not looked for."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values(["low", "other"], ignore_index=True)
            m = len(right["low"][0])
            lows, first = np.unique(right["low"].to_numpy(object), return_index=True)
            upto = np.append(first[1:], len(right))
            trie = Trie(codes_of(list(lows), m))
            others, long_of = right["other"].to_numpy(object), right["length"].to_numpy(np.int64)
            order = np.empty(len(others), np.int64)
            order[np.argsort(others, kind="stable")] = np.arange(len(others))
            for width, own in left.groupby(left["low"].str.len()):
                texts, longs = own["text"].to_numpy(object), own["length"].to_numpy(np.int64)
                most = np.maximum(longs, max(width, m, long_of.max()))
                within = lambda least, most: np.floor(most * (1 - least) + 1e-9).astype(np.int64)
                budget, nearest = within(np.maximum(own["bound"].to_numpy(float) - 1e-6, threshold), most), _Nearest(k, order)
                for at, node, d in trie.near(codes_of(list(own["low"]), int(width)), budget):
                    # texts that differ in case only are one leaf
                    n = upto[node] - first[node]
                    row = np.repeat(first[node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    at, d = np.repeat(at, n), np.repeat(d, n)
                    longest = np.maximum(longs[at], long_of[row])
                    size = np.maximum(longest, 1)
                    sim = np.where(longest == 0, 1.0, (2_000_000 * (longest - d.astype(np.int64)) + size) // (2 * size) / 1e6)  # to six digits, halves up
                    near = sim >= threshold
                    if nearest.add(at[near], row[near], sim[near]):
                        at, _, sim, place = nearest.best()
                        full, kth = at[place == k - 1], sim[place == k - 1]
                        budget[full] = np.minimum(budget[full], within(kth - 1e-6, most[full]))
                at, row, sim, _ = nearest.best()
                out.append(pd.DataFrame({"text": texts[at], "other": others[row], "similarity": sim}))
        if not out:
            return pd.DataFrame({"text": [], "other": [], "similarity": []}).astype({"text": object, "other": object})
        return pd.concat(out)

    return run


def _bounded(left: DataFrame, right: DataFrame, threshold: float, k: int) -> DataFrame:
    """left with `bound`: the similarity of the k-th most similar of some right texts, those that begin or end alike, up to
    BOUNDING of each beginning and end; the threshold where there are fewer than k. So the k best of all reach the bound."""
    n = F.length("low")
    sizes = F.filter(F.array_distinct(F.array(n, n - 1, n - 2, F.floor(n * 3 / 4).cast("int"), F.floor(n / 2).cast("int"), F.floor(n / 4).cast("int"))), lambda m: m > 0)
    ends = F.concat(F.transform(sizes, lambda m: F.xxhash64(F.lit(0), F.substring(F.col("low"), F.lit(1), m))), F.transform(sizes, lambda m: F.xxhash64(F.lit(1), F.right(F.col("low"), m))))
    filed = right.select("other", F.col("low").alias("_low"), F.col("length").alias("_length"), F.explode(ends).alias("_end"))
    filed = filed.withColumn("_r", F.row_number().over(Window.partitionBy("_end").orderBy("other"))).filter(F.col("_r") <= BOUNDING)
    met = left.select("text", "low", "length", F.explode(ends).alias("_end")).join(filed, "_end")
    longest = F.greatest("length", "_length")
    met = met.select("text", "other", F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein("low", "_low") / longest).alias("s"))
    best = F.sort_array(F.transform(F.collect_set(F.struct("other", "s")), lambda x: x["s"]), asc=False)
    bounds = met.filter(F.col("s") > threshold).groupBy("text").agg(F.try_element_at(best, F.lit(k)).alias("bound"))
    return left.join(bounds.filter("bound is not null"), "text", "left").withColumn("bound", F.coalesce("bound", F.lit(float(threshold))))


def _shortened(low: Column) -> Column:
    """Hashes of a text and of what is left of it without each of its code points. Texts at distance 1 or less share one; as a
    hash stands for few texts that are one code point longer, however many texts there are, few others do."""
    n = F.length(low)
    without = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.concat(F.substring(low, F.lit(1), i - 1), F.substring(low, i + 1, n))))
    return F.array_distinct(F.concat(F.array(F.xxhash64(low)), without))


def _close(left: DataFrame, right: DataFrame, threshold: float, k: int) -> DataFrame:
    """text, other, similarity, rank: the k most similar right texts of those left texts of which all are at distance 1 or
    less, for certain; a row of null other for those that have none at all. Other left texts have no row.

    At a distance d of 2 or more the longer text has m + d code points at most, if the left one has m in lower case, as lower
    case is never shorter than what it is made of. So 1 - 2 / (m + 2) bounds the similarity of all that is farther.
    """
    some = left.filter(F.col("m") <= CLOSE_LENGTH)
    filed = right.filter(F.col("m") <= CLOSE_LENGTH + 1).select("other", F.col("low").alias("_low"), F.col("length").alias("_length"), F.explode(_shortened(F.col("low"))).alias("_key"))
    met = some.select("text", "low", "length", F.explode(_shortened(F.col("low"))).alias("_key")).join(filed, "_key")
    longest = F.greatest("length", "_length").cast("long")
    d, size = F.levenshtein("low", "_low", 1).cast("long"), F.greatest(longest, F.lit(1))
    met = met.select("text", "other", longest.alias("longest"), size.alias("size"), d.alias("d")).filter("d >= 0")
    exact = F.expr("(2000000L * (longest - d) + size) div (2 * size)") / F.lit(1e6)  # to six digits, halves up
    met = met.select("text", "other", F.when(F.col("longest") == 0, 1.0).otherwise(exact).alias("similarity")).filter(F.col("similarity") >= threshold).distinct()
    best = met.withColumn("rank", F.row_number().over(Window.partitionBy("text").orderBy(F.desc("similarity"), "other"))).filter(F.col("rank") <= k)
    best = materialize(best, "fuzzy-close")
    kth = best.filter(F.col("rank") == k).select("text", F.col("similarity").alias("kth"))
    settled = some.join(kth, "text", "left").filter(F.coalesce("kth", F.lit(float(threshold))) > 1 - 2 / (F.col("m") + 2) + 1e-6)
    return settled.select("text").join(best, "text", "left").select("text", "other", "similarity", "rank")


def fuzzy_candidates(left: DataFrame, right: DataFrame, threshold: float = 0.6, k: int = 5) -> DataFrame:
    """For each left text its k most similar right texts by Levenshtein similarity (case aside): text, other, similarity, rank.

    Texts are taken once each, nulls left out; an empty side gives no rows, and empty texts are alike to each other. Left texts
    whose k best are at distance 1 or less are known by a join. For the others the right texts, sorted by length and lower case, are a written table of runs; a left text meets the runs that have lengths
    within its reach. How similar its k best are at least is known beforehand by texts that begin or end alike, so that only
    what is as near is walked. A run is RIGHT_PART long on average (of very many texts up to 32 times that), whatever the
    lengths or beginnings, and its left texts are dealt in parts (up to 8 times LEFT_PART), so no task grows with the data
    beyond that. Each task holds bounded pairs and hands on k rows a text. Only the runs' lengths are broadcast: texts by their
    keys or ends are many times the files that Spark would judge them by.
    """
    with no_broadcasts(left.sparkSession):
        side = lambda df, c, name: df.select(F.col(c).alias(name)).filter(F.col(name).isNotNull()).distinct().withColumns({"low": F.lower(name), "length": F.length(name)}).withColumn("m", F.length("low"))
        a, b = materialize(side(left, "text", "text"), "fuzzy-left"), materialize(side(right, "text", "other"), "fuzzy-right")
        close = materialize(_close(a, b, threshold, k), "fuzzy-settled")
        found = close.filter("other is not null")
        a = materialize(a.join(close.select("text"), "text", "left_anti"), "fuzzy-left")
        lefts, rights = a.count(), b.count()
        if not lefts:
            return found
        runs = -(-rights // max(RIGHT_PART, min(32 * RIGHT_PART, rights // 128)))
        deals = -(-lefts // max(LEFT_PART, min(8 * LEFT_PART, lefts // 16)))
        a = materialize(_bounded(a, b, threshold, k), "fuzzy-bounds")
        b = materialize(b.repartitionByRange(max(runs, 1), "m", "low", "other").withColumn("run", F.spark_partition_id()), "fuzzy-runs")
    a = a.withColumn("deal", F.pmod(F.xxhash64("text"), F.lit(max(deals, 1))).cast("int")).withColumnRenamed("m", "l")
    least = F.greatest(F.col("bound") - 1e-6, F.lit(threshold))
    low, high = F.ceil(F.col("l") * least - 1e-9).cast("int"), F.floor(F.col("l") / least + 1e-9).cast("int")
    asked = a.select("text", "low", "length", "bound", "deal", F.explode(F.sequence(low, high)).alias("m")).join(F.broadcast(b.select("run", "m").distinct()), "m")
    told = b.select(*[F.col(c).alias(c) for c in b.columns], F.explode(F.sequence(F.lit(0), F.lit(max(deals, 1) - 1))).alias("deal"))
    # Few bytes but much work a row: a stated number of partitions is not merged into fewer.
    parts = max(2 * runs * max(deals, 1), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = ["run", "m", "deal"]
    near = asked.repartition(parts, *keys).groupBy(*keys).cogroup(told.repartition(parts, *keys).groupBy(*keys)).applyInPandas(lambda x, y: _pairs(threshold, k)(x, y), "text string, other string, similarity double")
    return found.union(near.withColumn("rank", F.row_number().over(Window.partitionBy("text").orderBy(F.desc("similarity"), "other"))).filter(F.col("rank") <= k))


def _ranked_sets(texts: DataFrame, members: Column) -> DataFrame:
    """text, n, t: a text's set as an array of (how many texts have the member, member), rarest first."""
    flat = texts.select("text", F.explode(F.array_distinct(members)).alias("member"))
    often = flat.groupBy("member").agg(F.count("*").alias("c"))
    ranked = flat.join(often, "member").groupBy("text").agg(F.array_sort(F.collect_list(F.struct("c", "member"))).alias("t"))
    return ranked.withColumn("n", F.size("t"))


def _members(sets: DataFrame, name: str, upto: Column) -> DataFrame:
    """name, its set's size, place and member, and the member's texts, of each set's first `upto` members that others have."""
    first = sets.select(F.col("text").alias(name), F.col("n").alias(f"{name}_n"), F.posexplode(F.slice("t", F.lit(1), upto)).alias(f"{name}_at", "m"))
    return first.filter("m.c > 1").select(name, f"{name}_n", f"{name}_at", "m.member", "m.c")


def _met(asked: DataFrame, filed: DataFrame) -> DataFrame:
    """The join by member; what is filed under one that many share is dealt in parts, each of which all that ask it meet."""
    parts = F.floor((F.col("c") - 1) / GRAM_ROWS) + 1
    filed = filed.withColumn("part", F.pmod(F.xxhash64("y"), parts)).drop("c")
    return asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("c").join(filed, ["member", "part"])


def _sharing(sets: DataFrame, of_both: float, of_smaller: float) -> DataFrame:
    """(x, y): pairs whose sets share at least of_both of the sum of their sizes, which takes a smaller set of at least
    of_smaller of the larger.

    A set that is filed meets larger ones only, so its overlap is 2 * of_both of its size at least; one that asks meets
    smaller ones, of of_smaller of its size at least. Either overlap has one of the rarest members that are not needed to
    make it up, and one more.
    """
    n = F.col("n")
    first = lambda share: n - F.ceil(n * share - 1e-9).cast("int") + 1
    filed, asked = _members(sets, "y", first(2 * of_both)), _members(sets, "x", first(of_both * (1 + of_smaller)))
    larger = (F.col("x_n") > F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x") > F.col("y")))
    left = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
    enough = (F.col("y_n") >= of_smaller * F.col("x_n") - 1e-9) & (left >= of_both * (F.col("x_n") + F.col("y_n")) - 1e-9)
    return _met(asked, filed).filter(larger & enough).select("x", "y")


def candidate_pairs(targets: DataFrame, threshold: float) -> DataFrame:
    """(target, other), target < other, each once: all pairs of distinct texts that may reach the composite similarity.

    With Jaro-Winkler at its most, 1, texts of which neither holds the other need dice + jaccard >= (threshold - .4) / .3, so
    one of them is at least half of that: dice of bigrams over the sum of both sizes, jaccard of tokens. A text that holds
    another has all its bigrams, so it has the rarest.
    """
    if threshold <= 0.4:
        raise ValueError("a threshold of .4 or less can be reached without anything in common")
    half = (threshold - 1e-6 - 0.4) / 0.6
    texts = targets.select(F.col("target").alias("text")).filter("text is not null").distinct()
    grams = materialize(_ranked_sets(texts, S._grams(F.col("text"), 2)), "fuzzy-grams")
    by_grams = _sharing(grams, half / 2, half / (2 - half))
    by_tokens = _sharing(_ranked_sets(texts, T.similarity_tokens("text")), half / (1 + half), half)
    held, holding = _members(grams, "x", F.lit(1)), _members(grams, "y", F.col("n"))
    low = lambda c: F.lower(F.trim(c))
    inside = F.contains(low("y"), low("x")) & (2 * F.length(low("x")) > F.length(low("y"))) & (F.col("x") != F.col("y"))
    by_text = _met(held, holding).filter(inside).select("x", "y")
    pairs = by_grams.union(by_tokens).union(by_text)
    return pairs.select(F.least("x", "y").alias("target"), F.greatest("x", "y").alias("other")).distinct()


def similar_pairs(targets: DataFrame, threshold: float = 0.7) -> DataFrame:
    """target, other (target < other), similarity: all pairs of distinct texts whose composite similarity, to six digits,
    reaches the threshold (over .4). Null targets are left out; an empty table gives no rows."""
    pairs = candidate_pairs(targets, threshold)
    # What can't reach the threshold with a Jaro-Winkler of 1 needs none computed.
    inside, rest = S.containment("target", "other"), 0.2 * S.dice("target", "other") + 0.2 * S.token_jaccard("target", "other")
    bound = F.when(inside > 0.5, 0.3 + rest + 0.3 * inside).otherwise(0.4 + 1.5 * rest)
    near = materialize(pairs.filter(bound >= threshold - 1e-6), "fuzzy-pairs")
    return near.withColumn("similarity", F.round(S.composite("target", "other"), 6)).filter(F.col("similarity") >= threshold)
