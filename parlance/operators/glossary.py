"""Glossaries, rules and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.functions.text import trimmed


def glossary_lines(entries: DataFrame, variants: DataFrame) -> DataFrame:
    """(id, line): the variants of each entry in order, with its target."""
    joined = variants.join(entries.select(F.col("id").alias("entry_id"), "target"), "entry_id")
    sources = F.array_join(F.array_sort(F.collect_list("source")), " / ")
    return joined.groupBy(F.col("entry_id").alias("id"), "target").agg(sources.alias("s")).select("id", F.concat("s", F.lit(" → "), "target").alias("line"))


def glossary_text(entries: DataFrame, variants: DataFrame, group: str) -> DataFrame:
    """(group, glossary): the lines of all entries of a group, by entry id."""
    lines = glossary_lines(entries, variants).join(entries.select("id", group), "id")
    ordered = F.array_sort(F.collect_list(F.struct("id", "line")))
    return lines.groupBy(group).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("glossary"))


def match_terms(terms: DataFrame, entries: DataFrame, variants: DataFrame, null_safe: bool = False) -> DataFrame:
    """terms (term_id, sources, source_lang, target_lang, doc_type) plus entry_id of the entry that the first known source hits.

    Plain equality never meets a NULL doc_type; `null_safe` does.
    """
    known = variants.join(entries.select(F.col("id").alias("entry_id"), F.col("source_lang").alias("sl"), F.col("target_lang").alias("tl"), F.col("doc_type").alias("dt")), "entry_id").select("entry_id", F.col("source").alias("s"), "sl", "tl", "dt")
    asked = terms.select("*", F.posexplode("sources").alias("__n", "__source"))
    kind = F.col("doc_type").eqNullSafe(F.col("dt")) if null_safe else F.col("doc_type") == F.col("dt")
    hits = asked.join(known, (F.col("__source") == F.col("s")) & (F.col("source_lang") == F.col("sl")) & (F.col("target_lang") == F.col("tl")) & kind)
    best = hits.groupBy("term_id").agg(F.min(F.struct("__n", "entry_id")).alias("b")).select("term_id", F.col("b.entry_id").alias("entry_id"))
    return terms.join(best, "term_id", "left")


def active_rules(rules: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (key, doc_type, target_lang) with the texts of the enabled rules that apply; NULL in a rule fits anything.

    Rules are few by nature; the join is a nested loop over the broadcast rules only if Spark finds them small enough.
    """
    r = rules.where("enabled").select(F.col("doc_type").alias("rd"), F.col("target_lang").alias("rt"), "sort_order", F.col("id").alias("rule_id"), trimmed(F.col("content")).alias("text")).where("text <> ''")
    fits = (F.col("rd").isNull() | (F.col("rd") == F.col("doc_type"))) & (F.col("rt").isNull() | (F.col("rt") == F.col("target_lang")))
    ordered = F.array_sort(F.collect_list(F.struct("sort_order", "rule_id", "text")))
    return wanted.join(r, fits).groupBy(*wanted.columns).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("rules"))


def settings_row(settings: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """One row: each known setting, or its default where it is missing or empty."""
    return settings.agg(*[F.coalesce(F.nullif(F.max(F.when(F.col("key") == k, F.col("value"))), F.lit("")), F.lit(v)).alias(k) for k, v in defaults.items()])


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
