"""The corpus queries: one for each operator, over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from cladeworks.llm import ann_forest, bpe_duckdb, exact_dedup, html_main, language_cnn, lexical, line_templates, packing, periodic, phrase_automata, simhash, toxicity, warc_zstd


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(table(spark, sf_dir, "pages"))


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zstd.round_trip(table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="max")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann_forest.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4)


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_automata.remove_repeats(table(spark, sf_dir, "documents"), width=13)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = language_cnn.train(docs.where(~language_cnn.held_out()).select("doc_id", "text", "lang"))
    found = language_cnn.predict(docs, network)
    return found.select("doc_id", language_cnn.held_out().alias("held_out"), "lang_pred", "score")


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_templates(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_duckdb.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which every tenth text, by the crc32 of its id, goes round in circles from some word on."""
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    split = F.when((F.col("h") % 10 == 0) & F.col("text").isNotNull(), words).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("w", split).withColumn("n", F.size("w").cast("long")).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("a", F.expr("g % greatest(n, 1)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    turned = F.expr("array_join(concat(slice(w, 1, int(a)), transform(sequence(a, n - 1), i -> w[int(a + (i - a) % p)])), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, turned).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(looped(table(spark, sf_dir, "documents")), least=12)
    longest = F.expr("array_sort(runs, (x, y) -> case when x.length != y.length then int(sign(y.length - x.length)) when x.start != y.start then int(sign(x.start - y.start)) else int(sign(x.period - y.period)) end)[0]")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, char(10))), '')")
    out = found.withColumn("top", F.when(F.size("runs") > 0, longest))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), F.col("top.length").alias("length"), F.col("top.period").alias("period"),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs.where(~language_cnn.held_out()), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, least=0.7).withColumn("held_out", language_cnn.held_out()).select("doc_id", "held_out", "score", "predicted")


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_hilbert_packing, op2_main_text, op3_warc_round_trip, op4_exact_dedup, op5_nearest, op6_simhash, op7_repeated_passages, op8_language, op9_line_templates, op10_byte_bpe, op11_periodic_runs, op12_toxicity, op13_lexical)} | {"pipeline": corpus_pipeline.run}

SQL: dict[str, str] = {"op4_exact_dedup": exact_dedup.ORACLE, "op7_repeated_passages": phrase_automata.ORACLE, "op9_line_templates": line_templates.ORACLE, "op13_lexical": lexical.ORACLE}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
