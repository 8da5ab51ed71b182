"""Substring dedup by super-k-mers: 50-word windows that stand in a document with a smaller id are removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import runs
from glyphmill.storage import materialize

#: Windows of 50 words; minimisers of 8 words. Consecutive windows with one minimiser travel as one packed string.
SPEC = runs.Spec("words", 50, 8, within=False)
GAPS = r"[\x20\x09-\x0D]+"


def dedup(docs: DataFrame, spec: runs.Spec = SPEC) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed, kept_sha256, kept (null where nothing is removed); a row for each row.

    A null text has no words; its digest is that of the empty text. A null doc_id counts as the largest. Rows with the
    same doc_id don't remove each other's words. Words are compared unchanged, as bytes.
    """
    base = runs.prepared(docs)
    texts, marks = runs.repeated(base, spec)
    changed = materialize(runs.removed(texts, marks, spec).dropDuplicates(["key"]), "changed")
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(
        "doc_id",
        F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(runs.LAST)), F.col("text").cast("binary")).alias("key"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"),
        F.sha2(F.trim(F.regexp_replace(text, GAPS, " ")), 256).alias("sha"),
    )
    out = plain.join(changed, "key", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept")


def op6(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text")).drop("kept")
