"""The registered queries of this package, one per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.llm.tables import bucket, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from vigilframe.llm.exact import exact_groups

    return exact_groups(read(spark, folder, "documents"))


@query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from vigilframe.llm import toxic

    docs = read(spark, folder, "documents")
    model = toxic.fit(docs, read(spark, folder, "labels").where(bucket(F.col("doc_id"), 5) != 0))
    return toxic.score(docs, model, keep=["doc_id"]).select(
        "doc_id", (bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from vigilframe.llm.decontaminate import hits

    found = hits(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


@query
def op1_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from vigilframe.llm.neardup import near_groups

    return near_groups(read(spark, folder, "documents"), shingle=3, percent=85)


@query
def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    from vigilframe.llm.bpe import encode

    return encode(read(spark, folder, "documents"), keep=["doc_id"], with_ids=False)


@query
def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    from vigilframe.llm import language

    docs, fold = read(spark, folder, "documents"), bucket(F.col("doc_id"), 3)
    model = language.fit(docs.where(fold != 1))
    return language.identify(docs, model, keep=["doc_id"]).select(
        "doc_id", (fold == 1).alias("held_out"), "lang_pred", "score")


@query
def op8_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    from vigilframe.llm import lm

    fold = bucket(F.col("doc_id"), 10)
    return lm.score(read(spark, folder, "documents"), fold != 0).withColumn(
        "held_out", bucket(F.col("doc_id"), 10) == 0)


#: 16 shards over a prime number of slots, a hundred for each
SHARDS, SLOTS = [f"shard-{i:02d}" for i in range(16)], 1613


@query
def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    from vigilframe.llm.sharding import place_rows

    return place_rows(read(spark, folder, "documents").select("doc_id"), "doc_id", SHARDS, SLOTS)


@query
def op3_warc_fixity(spark: SparkSession, folder: str) -> DataFrame:
    """Audits a replica of ``pages`` in which one record in 37 has one character changed and one in
    101 is lost, by the checksum of its place."""
    from vigilframe.llm.fixity import audit, lay_out
    from vigilframe.llm.tables import Scratch

    scratch = Scratch(spark, "fixity")
    records = scratch.write(lay_out(read(spark, folder, "pages")), "records")
    mark = F.crc32(F.concat_ws("/", "file", "seq").cast("binary"))
    damaged = F.when(mark % 37 == 3, F.overlay("record", F.lit("#"), F.lit(60))).otherwise(F.col("record"))
    replica = records.where(mark % 101 != 5).withColumn("record", damaged)
    return audit(records, replica, scratch=scratch)


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


@query
def op10_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    from vigilframe.llm import licences

    docs = read(spark, folder, "documents")
    return licences.scan(docs, licences.fit(docs))


@query
def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    from vigilframe.llm.crosstok import align

    return align(read(spark, folder, "documents"))


@query
def op11_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from vigilframe.llm.quality import judge

    return judge(read(spark, folder, "documents"))


@query
def op12_phrases(spark: SparkSession, folder: str) -> DataFrame:
    from vigilframe.llm.phrases import mine

    return mine(read(spark, folder, "documents"))
