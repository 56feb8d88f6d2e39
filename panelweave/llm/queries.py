"""The registered queries of this package, one per operator, and their SQL counterparts.

Each query runs its operator over the whole table and derives the columns it returns from the
operator's own output. SQL files lie in ``sql/``; queries without one are tested by brute force.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm import (
    chat,
    decontamination,
    html_text,
    lm_scoring,
    near_dedup,
    packing,
    period_runs,
    quality_rules,
    secrets,
    sharding,
    token_counts,
    toxicity,
    vector_codes,
)
from panelweave.llm.common import SPACE, let, ship, split_words, whole_number

SHARDS = 24


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(of: int) -> Column:
    """Whether a row's id falls into fold ``of`` of five."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == of


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(_table(spark, sf_dir, "documents"), _fold(1))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after the personal data of each document gives way to marks."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    edits = token_counts.redactions(F.coalesce("text", F.lit("")))
    return token_counts.apply_edits(token_counts.build_trees(docs).withColumn("edits", edits))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.coalesce(decontamination.covered_words(F.col("spans")), whole_number(0))
    items = F.sort_array(F.transform("items", lambda i: i.cast("string")))
    ids = F.coalesce(F.array_join(items, ","), F.lit(""))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.col("m")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *counts, "base_failed", "kept")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents")).drop("text_hash", "group")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    own = spark.sql("SELECT -7L AS conv_id, explode(array(0L, 1L)) AS turn").select(
        "conv_id", "turn", F.when(F.col("turn") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(said).alias("text")
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = chat.render(chat.fold_events(chat.streamed(rows)))
    read = out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss")).alias("learned"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        rank = secrets.KINDS.index(kind)
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(secrets.digest(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.digest(F.col("spans")).alias("spans"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ~_fold(0))
    return scored.select("doc_id", F.coalesce(_fold(0), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_text.extract(_table(spark, sf_dir, "pages"))
    return text.withColumn("n_chars", F.char_length("text").cast("long"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    size, crc = (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    dealt = sharding.shuffled_shards(_table(spark, sf_dir, "documents").select("doc_id", size, crc), SHARDS)
    return dealt.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """The texts of a tenth of the documents repeat a stretch of theirs to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, whole_number(8))))
        word = lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + F.pmod(i - a, p)).cast("int")))
        return F.when(n > 0, F.array_join(F.transform(words, word), " ")).otherwise(F.lit(""))

    text = F.when(F.pmod(h, whole_number(10)) == 0, let(split_words(F.col("text"), SPACE), planted)).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op13_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = period_runs.periodic_runs(_with_planted_runs(_table(spark, sf_dir, "documents")))
    order = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    line = lambda r: F.concat(F.array_join(F.array(*[r[c].cast("string") for c in ("start", "length", "period")]), ","), F.lit("\n"))
    best = found.withColumn("best", F.array_max(order))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_token_counts": op2_token_counts,
    "op3_decontamination": op3_decontamination,
    "op4_packing": op4_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_near_dedup": op6_near_dedup,
    "op7_chat_format": op7_chat_format,
    "op8_secret_scan": op8_secret_scan,
    "op9_toxicity": op9_toxicity,
    "op10_html_text": op10_html_text,
    "op11_vector_codes": op11_vector_codes,
    "op12_sharding": op12_sharding,
    "op13_period_runs": op13_period_runs,
}

LLM_SQL: dict[str, str] = {
    file.stem: file.read_text(encoding="utf-8") for file in sorted((Path(__file__).parent / "sql").glob("*.sql")) if file.stem in LLM_QUERIES
}
