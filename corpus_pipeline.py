"""Corpus preparation: language ID, near duplicates, repeated passages, benchmark contamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame; all but the last
return the columns of ``docs``. ``run`` writes every stage as Parquet to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.llm._common import cut, fresh, fresh_dir, id_key, key_filter
from sparkprep.llm.decontaminate import find_benchmark
from sparkprep.llm.jaccard import similar_rows
from sparkprep.llm.langid import learn, predict
from sparkprep.llm.packing import packed_sequences
from sparkprep.llm.substring_dedup import dedup_corpus


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those between two languages: score under 0.5, for words of average evidence.

    The model learns from documents whose crc32(doc_id) mod 3 is not 1, a bounded sample of them.
    """
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = learn(docs.filter(~F.coalesce(held, F.lit(False))))
    (out,) = fresh(docs, "language")
    found = predict(docs, model, out=out)
    return found.filter((F.col(f"{out}.lang") != "und") & (F.col(f"{out}.score") >= 0.5)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows linked by Jaccard >= 0.9 over 5-word shingles, that with the smallest id stays.

    Decided by row, known by id and text hash: of a group's rows with its smallest id, or of those without an id where none has
    one, the text with the smallest hash stays. Rows that repeat an id and text count as one group too. Texts without a word
    link with nothing, so all such rows without an id stay.
    """
    similar = similar_rows(docs)
    lost = F.col("first").isNotNull() & ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("x") == F.col("first.x")))
    key, hashed, g, h, gone, rows, row = fresh(docs, "__k", "__x", "__g", "__h", "__gone", "__rows", "__row")
    flags = similar.filter("n > 0 or id is not null").groupBy(id_key("id").alias(g), F.col("x").alias(h)).agg(F.max(lost).alias(gone), F.count("*").alias(rows))
    flags = cut(flags.filter(F.col(gone) | (F.col(rows) > 1)))
    keyed = docs.withColumn(key, id_key("doc_id")).withColumn(hashed, F.xxhash64("text"))
    flagged = key_filter(flags, g, h)(key, hashed)  # documents that it doesn't hold stay where they are
    left = keyed.filter(~flagged).select(*docs.columns)
    kept = keyed.filter(flagged).join(flags, (F.col(key) == F.col(g)) & (F.col(hashed) == F.col(h)), "left").filter(~F.coalesce(F.col(gone), F.lit(False)))
    once = kept.filter(F.col(rows).isNull()).select(*docs.columns)
    if flags.filter(~F.col(gone)).isEmpty():  # no row that stays is there twice
        return left.union(once)
    more = kept.filter(F.col(rows) > 1).groupBy(key, hashed).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(row))
    return left.union(once).union(more.select(f"{row}.*"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out words covered by a 20-word window that also starts earlier; documents left without a word go."""
    (out,) = fresh(docs, "dedup")
    got = dedup_corpus(docs, out=out)
    text = F.when(F.col(f"{out}.n_removed") > 0, F.col(f"{out}.text")).otherwise(F.col("text"))
    got = got.filter((F.col(f"{out}.n_removed") == 0) | (F.col(f"{out}.n_removed") < F.col(f"{out}.n_words")))
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.when(F.col(f"{out}.n_removed") > 0, F.char_length(F.col(f"{out}.text")).cast("long")).otherwise(F.col("n_chars")))
    return got.withColumn("text", text).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark passage: 8 words in a row, or more, covered by windows of benchmark items.

    One item is enough. Items of fewer words count only where, side by side, they come to as many: a few words in common
    are no evidence.
    """
    (out,) = fresh(docs, "match")
    found = find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out=out)
    return found.filter(~F.exists(f"{out}.spans", lambda s: s["end"] - s["start"] >= 8)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document, as token ids with an end id, into sequences of permitted lengths, a row a sequence."""
    return packed_sequences(docs)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

#: The first and last stage have no SQL: tests compare the pipeline with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        at = fresh_dir(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
