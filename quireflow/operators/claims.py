"""Claims against evidence: scores of pairs to labels, and map-reduce summaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: In the order of the scores.
LABELS = ("REFUTED", "SUPPORTED", "NEI")
THRESHOLDS = {"REFUTED": 0.80, "SUPPORTED": 0.65, "NEI": 0.60}
SECOND_STAGE, MOST_EVIDENCE = 0.70, 10


def pair_evidence(claims: DataFrame, evidence: DataFrame, key: str, order: list[str], most: int = MOST_EVIDENCE) -> DataFrame:
    """Each claim with its first pieces of evidence."""
    first = evidence.withColumn("position", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("position") <= most)
    return claims.join(first, key)


def label_scores(pairs: DataFrame, key: str, scale: int = 100) -> DataFrame:
    """(key, p_refuted, p_supported, p_nei, chunks_used): maxima of the first two scores, mean of the third, made to sum to 1.

    Scores are whole numbers of 1 / scale, so sums are the same in any order.
    """
    agg = pairs.groupBy(key).agg(F.max("refuted").alias("r"), F.max("supported").alias("s"), F.sum("nei").alias("n"), F.count("*").cast("int").alias("chunks_used"))
    # r, s and n / k over their sum, all times k: whole numbers up to the one division.
    whole = F.col("r") * F.col("chunks_used") + F.col("s") * F.col("chunks_used") + F.col("n")
    part = lambda c: F.when(whole > 0, c.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))
    return agg.select(key, part(F.col("r") * F.col("chunks_used")).alias("p_refuted"), part(F.col("s") * F.col("chunks_used")).alias("p_supported"), part(F.col("n")).alias("p_nei"), "chunks_used")


def verdict(scores: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """Adds label, confidence, threshold and needs_stage2; the first of equal scores wins.

    A score under its label's threshold falls back to NEI with NEI's score; the threshold told is that of the first label. Scores are rounded to four digits before they are compared.
    """
    p = F.array("p_refuted", "p_supported", "p_nei")
    first = F.array_position(p, F.array_max(p)).cast("int")
    out = scores.withColumn("__first", F.element_at(F.array(*map(F.lit, LABELS)), first)).withColumn("__score", F.round(F.array_max(p), 4))
    out = out.withColumn("threshold", F.element_at(F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv]), F.col("__first")))
    low = F.col("__score") < F.col("threshold")
    out = out.withColumn("label", F.when(low, "NEI").otherwise(F.col("__first"))).withColumn("confidence", F.when(low, F.round("p_nei", 4)).otherwise(F.col("__score")))
    return out.withColumn("needs_stage2", (F.col("confidence") < SECOND_STAGE) | (F.col("label") == "NEI")).drop("__first", "__score")


def verify(claims: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """A verdict per claim; a claim without evidence is NEI, confidence 1, no chunks, second stage."""
    judged = verdict(label_scores(pairs, key))
    none = {"label": F.lit("NEI"), "confidence": F.lit(1.0), "threshold": F.lit(THRESHOLDS["NEI"]), "needs_stage2": F.lit(True), "chunks_used": F.lit(0), "p_refuted": F.lit(0.0), "p_supported": F.lit(0.0), "p_nei": F.lit(1.0)}
    return claims.join(judged, key, "left").withColumns({c: F.coalesce(F.col(c), v) for c, v in none.items()})


def normal_label(label: Column) -> Column:
    fixed = F.upper(label)
    return F.when(fixed.isin("REFUTED", "NEI"), fixed).otherwise("SUPPORTED")


def percent(confidence: Column) -> Column:
    return F.coalesce(F.format_string("%.1f%%", confidence * 100), F.lit("N/A")) if confidence is not None else F.lit("N/A")


def notice(label: Column) -> Column:
    """warning for refuted answers, disclaimer where evidence is not enough."""
    return F.when(label == "REFUTED", "warning").when(label == "NEI", "disclaimer")


# --- summaries

WINDOW, FLAT_CHUNKS, GROUP, MODEL_TOKENS = 874, 5, 4, 1024


def strategy(tokens: Column, chunks: Column) -> Column:
    return F.when(tokens <= WINDOW, "single").when(chunks <= FLAT_CHUNKS, "flat").otherwise("hierarchical")


def model_input(tokens: Column, prompt_tokens: int = 0) -> Column:
    """The tokens that the model sees; the rest is cut."""
    return F.slice(tokens, 1, MODEL_TOKENS - prompt_tokens)


def leading(words: int):
    """A stand-in for a summarizing model, without network: the first words."""

    @F.pandas_udf("string")
    def summarize(text: pd.Series) -> pd.Series:
        return text.map(lambda t: " ".join((t or "").split()[:words]))

    return summarize


def reduce_groups(parts: DataFrame, key: str, position: str, text: str, size: int = GROUP) -> DataFrame:
    """(key, position, text): consecutive parts joined in groups."""
    rows = parts.select(key, F.floor(F.col(position) / size).cast("int").alias("__g"), F.struct(F.col(position).alias("p"), F.col(text).alias("t")).alias("__row"))
    joined = rows.groupBy(key, "__g").agg(F.array_join(F.transform(F.array_sort(F.collect_list("__row")), lambda r: r["t"]), " ").alias(text))
    return joined.withColumnRenamed("__g", position)


def summarize(docs: DataFrame, key: str, text: str, *, mapper=None, reducer=None, final=None) -> DataFrame:
    """(key, strategy, summary): windows are summarized in parallel, joined, in groups of four first if there are more than five, and summarized again."""
    mapper, reducer, final = mapper or leading(128), reducer or leading(200), final or leading(256)
    from ..functions.text import words
    from .retrieval import token_windows

    rows = docs.select(key, words(F.col(text)).alias("tokens")).withColumn("windows", token_windows(F.col("tokens")))
    rows = rows.withColumn("strategy", strategy(F.size("tokens"), F.size("windows")))
    parts = rows.select(key, "strategy", F.posexplode("windows").alias("position", "window")).withColumn("part", mapper(F.array_join("window", " ")))
    deep = reduce_groups(parts.where("strategy = 'hierarchical'"), key, "position", "part").withColumn("part", reducer("part"))
    level = parts.where("strategy <> 'hierarchical'").select(key, "position", "part").unionByName(deep)
    joined = reduce_groups(level, key, "position", "part", size=1 << 30).withColumn("summary", final("part"))
    return rows.select(key, "strategy").join(joined.select(key, "summary"), key, "left").withColumn("summary", F.coalesce("summary", F.lit("")))
