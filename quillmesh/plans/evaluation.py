"""Registered queries of evaluation: ranking and link metrics, answerability, percentiles, snapshots, dataset statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.percentiles import exact_percentiles
from ..session import table
from .common import tidy

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, sf: tidy(f(spark, sf))
        if sql:
            SQL[name] = sql
        return f

    return keep


#: Items made from events in both engines: ten retrieved paths, and up to three expected ones.
ITEMS_SQL = """i AS (SELECT event_id AS id, list_transform(range(10), lambda k: 'n' || ((event_id * 31 + k * 17) % 53)) AS got, list_distinct(list_transform(range(event_id % 4), lambda k: 'n' || ((event_id * 31 + k * 34 + 17 * (event_id % 3)) % 53))) AS want, value, event_type, event_id % 5 <> 0 AS answerable FROM events),
r AS (SELECT *, list_transform(got, lambda p: CASE WHEN list_contains(want, p) THEN 1 ELSE 0 END) AS rel FROM i),
m AS (SELECT *, CASE WHEN len(want) > 0 THEN rel[1] ELSE 0 END AS hit_at_1, CASE WHEN len(want) > 0 THEN list_max(rel) ELSE 0 END AS hit_at_k,
 CASE WHEN len(want) > 0 AND list_position(rel, 1) > 0 THEN 1.0::DOUBLE / list_position(rel, 1) ELSE 0 END AS rr,
 CASE WHEN len(want) > 0 THEN len(list_intersect(want, got))::DOUBLE / len(want) ELSE 0 END AS recall,
 CASE WHEN len(want) > 0 THEN list_sum(list_transform(rel, lambda x, k: x / log2(k + 1)::DOUBLE)) / list_sum(list_transform(range(1, greatest(least(len(want), 10), 1) + 1), lambda k: 1 / log2(k + 1)::DOUBLE)) ELSE 0 END AS ndcg FROM r)"""


def items(spark, sf):
    e = table(spark, sf, "events")
    ten = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.concat(F.lit("n"), ((F.col("event_id") * 31 + k * 17) % 53).cast("string")))
    n = (F.col("event_id") % 4).cast("int")
    few = F.transform(F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), F.lit(1), n), lambda k: F.concat(F.lit("n"), ((F.col("event_id") * 31 + k * 34 + 17 * (F.col("event_id") % 3)) % 53).cast("string")))
    return e.select(F.col("event_id").alias("id"), ten.alias("retrieved"), F.array_distinct(few).alias("expected"), F.col("value").alias("latency_ms"), "event_type", (F.col("event_id") % 5 != 0).alias("answerable"))


@query("search_metrics", f"WITH {ITEMS_SQL} SELECT id, CAST(hit_at_1 AS BIGINT) AS hit_at_1, CAST(hit_at_k AS BIGINT) AS hit_at_k, round(rr, 6) AS reciprocal_rank, round(recall, 6) AS recall_at_k, round(ndcg, 6) AS ndcg_at_k FROM m")
def search_metrics(spark, sf):
    return M.search_item_metrics(items(spark, sf)).select("id", "hit_at_1", "hit_at_k", "reciprocal_rank", "recall_at_k", "ndcg_at_k")


SUMMARY = "count(*) AS items, round(avg(hit_at_1) FILTER (WHERE u), 6) AS hit_at_1, round(avg(hit_at_k) FILTER (WHERE u), 6) AS hit_at_k, round(avg(rr) FILTER (WHERE u), 6) AS mrr, round(avg(recall) FILTER (WHERE u), 6) AS recall_at_k, round(avg(ndcg) FILTER (WHERE u), 6) AS ndcg_at_k, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95"


@query("search_summary", f"WITH {ITEMS_SQL} SELECT {SUMMARY} FROM (SELECT *, answerable AND len(want) > 0 AS u FROM m)")
def search_summary(spark, sf):
    return M.search_summary(M.search_item_metrics(items(spark, sf)))


@query("search_summary_by_type", f"WITH {ITEMS_SQL} SELECT event_type, {SUMMARY} FROM (SELECT *, answerable AND len(want) > 0 AS u FROM m) GROUP BY ROLLUP (event_type)")
def search_summary_by_type(spark, sf):
    return M.search_summary(M.search_item_metrics(items(spark, sf)), ["event_type"])


@query("link_metrics", f"""WITH {ITEMS_SQL}, l AS (SELECT id, got[1:event_id_k] AS s, want, known FROM (SELECT id, got, want, id % 7 AS event_id_k, list_transform(range(3), lambda k: 'n' || ((id * 31 + k * 51) % 53)) AS known FROM i)),
x AS (SELECT *, s[1:5] AS t FROM l), y AS (SELECT *, len(list_filter(t, lambda p: list_contains(want, p))) AS h FROM x),
z AS (SELECT *, CASE WHEN len(t) > 0 THEN h::DOUBLE / len(t) ELSE 0 END AS p, CASE WHEN len(want) > 0 THEN len(list_intersect(want, t))::DOUBLE / len(want) ELSE 0 END AS r FROM y)
SELECT id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, CAST(h > 0 AS BIGINT) AS hit, round(CASE WHEN len(t) > 0 THEN len(list_filter(t, lambda q: NOT list_contains(known, q)))::DOUBLE / len(t) ELSE 0 END, 6) AS novelty FROM z""")
def link_metrics(spark, sf):
    known = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.concat(F.lit("n"), ((F.col("id") * 31 + k * 51) % 53).cast("string")))
    i = items(spark, sf).select("id", F.slice("retrieved", F.lit(1), (F.col("id") % 7).cast("int")).alias("suggested"), "expected", known.alias("existing"))
    return M.link_item_metrics(i).select("id", "precision", "recall", "f1", "hit", "novelty")


@query("percentile_latency", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def percentile_latency(spark, sf):
    return exact_percentiles(table(spark, sf, "events"), "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ["event_type"])


@query("unanswerable_confusion", """WITH c AS (SELECT count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn, count(*) FILTER (WHERE NOT t AND NOT p) AS tn FROM (SELECT quality = 0 AS t, toxic = 0 AS p FROM labels)),
d AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM c)
SELECT tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1, round(CASE WHEN tp + fn > 0 THEN fn / (tp + fn) ELSE 0 END, 6) AS false_answer_rate, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM d""")
def unanswerable_confusion(spark, sf):
    return M.confusion(table(spark, sf, "labels"), F.col("quality") == 0, F.col("toxic") == 0)


@query("unanswerable_decision", "SELECT event_id, value IS NULL OR value < 50 OR event_id % 3 = 0 AS unanswerable FROM events")
def unanswerable_decision(spark, sf):
    return table(spark, sf, "events").select("event_id", M.unanswerable(F.when(F.col("event_id") % 3 != 0, F.col("value")), 50.0).alias("unanswerable"))


@query("dataset_stats", "SELECT 'language' AS facet, lang AS value, count(*) AS items FROM documents GROUP BY lang UNION ALL SELECT 'difficulty', CASE WHEN n_chars < 1000 THEN 'easy' WHEN n_chars < 3000 THEN 'mid' ELSE 'hard' END, count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'tag', t, count(*) FROM (SELECT unnest([source, lang]) AS t FROM documents) GROUP BY 2")
def dataset_stats(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("language"), F.when(F.col("n_chars") < 1000, "easy").when(F.col("n_chars") < 3000, "mid").otherwise("hard").alias("difficulty"), F.array("source", "lang").alias("tags"))
    return M.dataset_stats(d)


@query("worst_cases", f"WITH {ITEMS_SQL} SELECT id, round(rr, 6) AS reciprocal_rank FROM m ORDER BY rr, id LIMIT 10")
def worst_cases(spark, sf):
    return M.worst_cases(M.search_item_metrics(items(spark, sf)).withColumn("precision", F.lit(0.0))).select("id", "reciprocal_rank")


@query("snapshot_regression", """WITH b(metric, category, baseline) AS (VALUES ('hit_at_1', 'quality', 0.5::DOUBLE), ('mrr', 'quality', 0.6), ('p95', 'latency', 100.0), ('cold', 'cold_start', 1000.0), ('far', 'inverted', 0.1), ('gone', 'quality', 0.3)), c(metric, current) AS (VALUES ('hit_at_1', 0.47::DOUBLE), ('mrr', 0.61), ('p95', 130.0), ('cold', 1100.0), ('far', 0.2))
SELECT metric, category, baseline, current, round(current - baseline, 6) AS change, CASE WHEN current IS NULL THEN false WHEN category = 'latency' THEN (current - baseline) / baseline > 0.15 OR current - baseline > 200 WHEN category = 'cold_start' THEN (current - baseline) / baseline > 0.2 OR current - baseline > 120000 WHEN category = 'inverted' THEN current - baseline > 0.02 ELSE current - baseline < -0.02 END AS regression FROM b LEFT JOIN c USING (metric)""")
def snapshot_regression(spark, sf):
    b = spark.createDataFrame([(0.5, 0.6, 100.0, 1000.0, 0.1, 0.3)], "hit_at_1 double, mrr double, p95 double, cold double, far double, gone double")
    c = spark.createDataFrame([(0.47, 0.61, 130.0, 1100.0, 0.2)], "hit_at_1 double, mrr double, p95 double, cold double, far double")
    kinds = {"hit_at_1": "quality", "mrr": "quality", "p95": "latency", "cold": "cold_start", "far": "inverted", "gone": "quality"}
    return M.compare_snapshots(M.unpivot_metrics(b, kinds), M.unpivot_metrics(c, {k: v for k, v in kinds.items() if k != "gone"}))
