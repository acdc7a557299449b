"""A training-corpus pipeline over documents: quality filter, toxicity filter, near-dedup, packing.

STAGES are applied in order by run(); each stage's rows are written as Parquet to the shared folder and read again as the
next stage's documents, so a lost executor costs one stage at most. All stages but the last return documents' columns.
Models are trained on labels of the original tables (bounded samples; see quillmesh.llm.labelled).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import forget, materialize, no_broadcasts
from quillmesh.llm.minhash import near_duplicates, row_key
from quillmesh.llm.packing import pack_documents
from quillmesh.llm.quality import quality_scores
from quillmesh.llm.quality import train as train_quality
from quillmesh.llm.toxicity import THRESHOLD, toxicity_scores
from quillmesh.llm.toxicity import train as train_toxicity
from quillmesh.session import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores at 0.5 or more.

    Every row is scored by its whole text: a null or empty one like any other, repeated rows and null ids each for
    themselves. docs keeps its columns, whatever their names; an empty table gives no rows, and without labels every score
    is 0.5, so all stay.
    """
    model = train_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_scores(docs, model, "_quality_score").filter("_quality_score >= 0.5").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose worst window scores under the threshold.

    Every row is scored by its whole text: a null or empty one like any other, repeated rows and null ids each for
    themselves. docs keeps its columns, whatever their names; an empty table gives no rows.
    """
    model = train_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity_scores(docs, model, "_toxicity_score").filter(F.col("_toxicity_score") < THRESHOLD).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that of smallest doc_id, null last.

    Words are taken five at a time at a similarity of 0.8, as stages are to where no contract says otherwise (that of op6
    says four). Rows are known by their doc_id and a hash of doc_id and text, so neither rows whose doc_id is null nor the
    texts of a doc_id that repeats go with one another; of rows equal in both, one stays. Null and empty texts are in no
    group and all stay. docs keeps its columns, whatever their names; an empty table gives no rows.

    Only the rows that go or repeat are joined, so most of the corpus is not dealt anew: they are under the broadcast
    threshold or Spark sorts both sides. While groups are looked for nothing is broadcast unasked: the driver of a small
    corpus would hold a hash table for each of some thirty joins.
    """
    with no_broadcasts(spark):
        groups = near_duplicates(docs.select("doc_id", "text"), width=5, keyed=True)
        marked = groups.filter("n_shingles > 0").groupBy("rid", F.col("doc_id").alias("id")).agg(F.count("*").alias("rows"), F.bool_or("stays").alias("stays"))
        fate = materialize(marked.filter("rows > 1 or not stays"), "fate")
        forget(*groups._written)
    key = row_key(docs)
    once = docs.join(fate, (key == fate.rid) & docs["doc_id"].eqNullSafe(fate.id), "left_anti")
    again = fate.filter("stays").select("rid", "id")
    row = F.struct(*[docs[c] for c in docs.columns])
    same = docs.join(again, (key == again.rid) & docs["doc_id"].eqNullSafe(again.id))
    one = same.groupBy(again.rid, again.id).agg(F.min_by(row, F.xxhash64(*[docs[c] for c in docs.columns])).alias("_row"))
    return once.union(one.select("_row.*"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of at most 2048 tokens; see pack_documents.

    A null or empty text is its end token alone; repeated rows and null ids are each packed; columns other than doc_id
    and text are not read; an empty table gives no pieces.
    """
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_dedup", near_dedup), ("packing", packing)]

#: Trained models, shingle sets and a tokenizer: SQL can't express these rows. tests/llm checks each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in order over the whole of documents; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(before)  # the table before the first stage is the input, which is no written one
    return docs
