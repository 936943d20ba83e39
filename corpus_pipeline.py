"""The training-data pipeline: language ID, line dedup, near-duplicate documents,
benchmark decontamination, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.llm import decontam, jaccard, langid, lines, pieces, store


SURE, LONG = 0.6, 200  # a text of LONG characters at this score is not in another language than predicted


def language(spark, docs, sf_dir):
    """Documents whose language is identified. Rejected, and gone, are those without a
    letter or text (und), and those that the parse surely finds in another language than
    the declared one (score SURE or more over LONG characters or more)."""
    shared = spark.sparkContext.broadcast(_folded(langid.learn(docs)))
    at, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts, declared = b.column(at).to_pylist(), b.column(lang).to_pylist()
            found = zip(*langid.predict(shared.value, texts))
            keep = [x != "und" and (y is None or x == y or score < SURE or len(t) < LONG) for (x, score), y, t in zip(found, declared, texts)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _folded(model):
    low, _ = langid.folds()
    model.classes = model.classes[low]
    return model


def line_dedup(spark, docs, sf_dir):
    """Texts without lines that repeat an earlier line; documents left without a word go.
    n_chars, where it is a column, follows the text."""
    out = lines.dedup_lines(docs).select(docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.where(F.translate(F.coalesce("text", F.lit("")), " \t\n\x0b\x0c\r", "") != "").select(docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of linked documents: the one with the least doc_id."""
    return jaccard.dedup(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold no benchmark item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark, docs, sf_dir):
    """doc_id with the ids of the whole text and whether they decode to it."""
    import public_tokenizers

    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL can express neither the parses of the first stage nor the last stage's pieces.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, store.table(stage(spark, docs, sf_dir), f"stage-{name}")
        store.drop(before)  # deletes tables of stages only
    return docs
