"""Shared pieces of the registered queries: the note view, its SQL, rounding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as X

from ..operators import graph as G
from ..session import table

LINK_SQL = r"\[\[([^\]|#]+)(?:#([^\]|]+))?(?:\|([^\]]+))?\]\]"


def norm_sql(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '\.md$', ''), '[-_]', ' ', 'g'), '\s+', ' ', 'g'))"


#: The tables hold no links, so both engines derive notes with two links each, some of which dangle.
NOTES_SQL = """m AS (SELECT ((max(doc_id) + 1) * 11) // 10 AS m FROM documents),
notes AS (SELECT 'notes/doc-' || doc_id || '.md' AS path, 'n' || doc_id AS id, 'Doc ' || doc_id AS title, 'doc-' || doc_id AS basename,
  text || ' [[Doc ' || ((doc_id * 7 + 3) % m) || ']] [[doc-' || ((doc_id * 13 + 5) % m) || '|see]]' AS content, doc_id FROM documents, m)"""

GRAPH_SQL = f"""{NOTES_SQL},
mentions AS (SELECT path AS src_path, unnest(range(len(regexp_extract_all(content, '{LINK_SQL}', 1)))) AS pos,
  trim(unnest(regexp_extract_all(content, '{LINK_SQL}', 1))) AS target, nullif(trim(unnest(regexp_extract_all(content, '{LINK_SQL}', 3))), '') AS alias FROM notes),
keys AS (SELECT key, max(path) AS path, max_by(title, path) AS title FROM (
  SELECT {norm_sql('title')} AS key, path, title FROM notes UNION ALL SELECT {norm_sql('basename')}, path, title FROM notes UNION ALL SELECT {norm_sql('id')}, path, title FROM notes) GROUP BY key),
resolved AS (SELECT mentions.*, keys.path AS dst_path, keys.title AS dst_title FROM mentions LEFT JOIN keys ON {norm_sql('mentions.target')} = keys.key),
edges AS (SELECT DISTINCT src_path, dst_path FROM resolved WHERE dst_path IS NOT NULL)"""


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """The note view; one row gives the modulus of link targets."""
    d = docs(spark, sf)
    m = ((d.agg(F.max("doc_id")).first()[0] or 0) + 1) * 11 // 10
    s = lambda c: c.cast("string")
    link = F.concat(F.col("text"), F.lit(" [[Doc "), s((F.col("doc_id") * 7 + 3) % m), F.lit("]] [[doc-"), s((F.col("doc_id") * 13 + 5) % m), F.lit("|see]]"))
    return d.select(
        F.concat(F.lit("notes/doc-"), s(F.col("doc_id")), F.lit(".md")).alias("path"),
        F.concat(F.lit("n"), s(F.col("doc_id"))).alias("id"),
        F.concat(F.lit("Doc "), s(F.col("doc_id"))).alias("title"),
        F.concat(F.lit("doc-"), s(F.col("doc_id"))).alias("basename"),
        F.array().cast("array<string>").alias("aliases"),
        link.alias("content"),
        "doc_id",
    )


def resolved(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    n = notes(spark, sf)
    return n, G.resolve(G.mentions(n), G.note_keys(n))


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Integers as long, doubles rounded, so that both engines give the same values."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (X.IntegerType, X.ShortType, X.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (X.DoubleType, X.FloatType)):
            c = F.round(c.cast("double"), digits)
        out.append(c.alias(f.name))
    return df.select(*out)
