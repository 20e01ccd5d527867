"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing, sharding.

Each stage reads the documents that its predecessor kept as a written Parquet table and returns documents with the same columns; the last
returns the shards. Null columns, empty and repeated rows and extra columns pass through every stage under the cases that its operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgersift.llm import decontam, langid, mixing, nearcopies, sharding, simhash
from ledgersift.llm.sizes import sent
from ledgersift.scratch import Scratch

#: A name that no column of documents has.
_OWN = "__pipeline"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model does not reject.

    Where no row has a language to learn from there is no model, and nothing can be rejected: all documents stay. Very long texts are read whole.
    """
    model = langid.train(docs)
    if model is None:
        return docs
    return langid.predict(docs, model, out=_OWN).filter(~F.col(f"{_OWN}.rejected")).select(*_names(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies (five-word shingles, similarity 0.8 or more).

    Candidates are the groups that op 6's BK-trees make of the fingerprints, and the MinHash bands of what those trees do not reach; both are compared whole.
    Where other texts share that id, or a component has no id, the text with the smallest hash stays; of equal rows one stays. What goes is
    taken away from the documents, so that texts are shuffled only if too many go for a broadcast. Very long texts are compared whole.
    """
    scratch = Scratch(spark, "pipeline-6")
    trees = Scratch(spark, "pipeline-6-trees")
    found = simhash.near_duplicates(docs, trees).select("text_hash", "component").distinct()
    copies, heads = nearcopies.copies_and_heads(docs, scratch, groups=trees.save(found, "groups"))
    mine = heads.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"))
    gone = copies.join(mine, copies.doc_id.eqNullSafe(mine.d) & (copies.text_hash == mine.t), "left_anti")
    repeated = heads.filter("n > 1")
    away = scratch.save(_keys(gone).unionByName(_keys(repeated)), "away")
    once = docs.join(sent(away, F.lit(24)), _same_row(), "left_anti")
    again = docs.join(sent(_keys(repeated), F.lit(24)), _same_row(), "left_semi")  # only here rows repeat: few as a rule
    first = Window.partitionBy("doc_id", "text").orderBy(F.lit(1))
    return once.unionByName(again.withColumn(_OWN, F.row_number().over(first)).filter(F.col(_OWN) == 1).select(*_names(docs)))


def _keys(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("doc_id").alias(f"{_OWN}_id"), F.col("text_hash").alias(f"{_OWN}_hash"))


def _same_row():
    """A document's row against the id and text hash found for it."""
    return F.col("doc_id").cast("long").eqNullSafe(F.col(f"{_OWN}_id")) & F.xxhash64(F.col("text").cast("string")).eqNullSafe(F.col(f"{_OWN}_hash"))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage, very long ones included."""
    scratch = Scratch(spark, "pipeline-1")
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scratch)
    hit = scratch.save(_keys(found.filter("n_hit > 0")), "hit")
    return docs.join(sent(hit, F.lit(24)), _same_row(), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks."""
    return mixing.mix(docs, Scratch(spark, "pipeline-7"))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix."""
    return sharding.shard(docs, Scratch(spark, "pipeline-10"))


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", uncontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: SQL cannot express the trained model of the first stage; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def _names(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = tables.save(docs, name)
    return docs
