"""From raw documents to a training mix: judge, cut copies and repeats, drop leaks, mix sources.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read back as the
``docs`` of the next one. All stages but the last return the columns of ``docs``, whatever further ones
there are and whatever they are named. Every stage gives an empty table for an empty one.
"""

from pyspark.sql import functions as F

from labelgauge.llm import decontam, mixing, near_dedup, quality_nb, suffix_dedup
from labelgauge.session import shared_dir
from labelgauge.sources.writers import stored


def quality(spark, docs, sf_dir):
    """The documents that the classifier, learned from all labelled documents, gives 0.5 or more.

    A null text is scored as an empty one; rows that repeat a row share its score and stay or go with it.
    Without labels of both classes there is nothing to tell documents apart by, and all of them stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_nb.fit(quality_nb.labelled(docs, labels), key="doc_id")
    if model is None:
        return docs
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("o"), F.col("text").alias("t"))
    return quality_nb.score(whole, model, "t").where("score >= 0.5").select("o.*")


def near_duplicates(spark, docs, sf_dir):
    """One document of each near-duplicate class: the one with the smallest doc_id.

    A null doc_id comes first, equal ones go by a hash of the text. Of rows that agree in doc_id and text
    one stays; null texts and texts without a word are classes of their own.
    """
    return near_dedup.first_of_classes(docs)


def repeats(spark, docs, sf_dir):
    """Documents without the 200-byte strings that stand elsewhere too; those left empty go.

    A character cut in two by a removed string goes as a whole; n_chars is that of the new text. Null and
    empty texts stay as they are; a row that repeats a row has all its strings elsewhere, so both go.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("o"), "doc_id", "text")
    rows = suffix_dedup.remove_repeats(rows)
    kept = F.try_validate_utf8(F.col("kept").cast("string"))
    whole = F.coalesce(kept, F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit("")))
    text = F.when(F.col("n_removed") > 0, whole).otherwise(F.col("o.text"))
    rows = rows.where("n_removed < n_bytes OR n_bytes = 0").withColumn("text", text)
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("o.n_chars"))}
    kinds = dict(docs.dtypes)
    return rows.select(*[new.get(c, F.col(f"o.`{c}`")).cast(kinds[c]).alias(c) for c in docs.columns])


def decontaminate(spark, docs, sf_dir):
    """The documents that hold no benchmark item, in part or whole.

    Null and empty texts stay; rows that repeat a row stay or go with it; without benchmark items all stay.
    """
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark, docs, sf_dir):
    """All documents with their slot and place in the mix of sources by the roots of their sizes.

    A null source is a source like any other. Rows that repeat a row have a place each. Columns named slot,
    place or in_mix are replaced.
    """
    return mixing.mix(docs, mixing.root_weights(docs))


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("suffix array dedup", repeats),
    ("decontamination", decontaminate),
    ("source mix", mixed),
]

#: No stage before the last can be told in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages, one after the other, over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, shared_dir(spark, name.replace(" ", "-")))
    return docs
