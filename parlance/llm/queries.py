"""Queries pN_... of the training-data operators. Each takes (spark, folder) and runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import align, chunking, conversations, defects, langid, mixing, packing, spans, tokens
from parlance.llm.refusals import Refusals
from parlance.llm.sentences import blank, sentences
from parlance.operators.ranking import positions
from parlance.operators.versions import current_rows
from parlance.session import written
from parlance.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def samples(spark: SparkSession, folder: str) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(text, language) of lang_samples, a table of fixed size (at most langid.SAMPLES rows), and of labelled messages.

    Of the messages of langid.LENGTHS code points whose label names a language, those with the least hash in each of
    langid.NOISY slots; so the driver reads a bounded sample.
    """
    rows = table(spark, folder, "lang_samples").orderBy("sample_id").select("text", "want").limit(langid.SAMPLES + 1).collect()
    h = F.xxhash64("id", "updated_at", "source_lang")
    m = table(spark, folder, "messages").where(F.length("original_content").between(*langid.LENGTHS)).join(code_bases(spark, folder).where("base IS NOT NULL"), F.col("source_lang") == F.col("code")).withColumn("h", h)
    drawn = m.groupBy(F.pmod("h", F.lit(langid.NOISY)).alias("slot")).agg(F.min("h").alias("h")).select("h")
    noisy = m.join(F.broadcast(drawn), "h").groupBy("h").agg(F.min("original_content").alias("text"), F.min("base").alias("base")).orderBy("h").collect()
    return [(r["text"], r["want"]) for r in rows], [(r["text"], r["base"]) for r in noisy]


def language_model(spark: SparkSession, folder: str) -> langid.Model:
    return langid.widened(*samples(spark, folder))


def models(spark: SparkSession, folder: str) -> tuple[langid.Model, Refusals]:
    """The model of languages and that of refusals, whose ordinary sentences are those of the same samples."""
    known, noisy = samples(spark, folder)
    return langid.widened(known, noisy), Refusals([x for t, _ in [*known, *noisy] for x in sentences(t)])


def code_bases(spark: SparkSession, folder: str) -> DataFrame:
    """(code, base), broadcast: the spellings in use, a table of fixed size."""
    return F.broadcast(table(spark, folder, "lang_codes").where("code IS NOT NULL").groupBy("code").agg(F.max("base").alias("base")))


def p4_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every current message with letters: language, confidence and place of each of its segments."""
    m = table(spark, folder, "messages")
    own = F.coalesce(F.col("original_content").rlike("\\p{L}") & ~F.col("original_content").startswith("📎"), F.lit(False))
    texts = m.withColumn("text", F.when(own, F.col("original_content")))
    found = langid.with_segments(texts, "text", language_model(spark, folder), ["id", "updated_at", "source_lang"])
    return current_rows(found, {"source_lang": F.col("source_lang"), "segments": F.col("segments")}, keep=F.size("segments") > 0)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = p4_segments(spark, folder).join(code_bases(spark, folder), F.col("source_lang") == F.col("code"), "left")
    wanted = rows.where(F.col("base").isNull() | (F.size("segments") > 1) | (F.col("segments")[0]["lang"] != F.col("base")))
    return wanted.select(F.col("id").alias("message_id"), F.inline("segments")).select("message_id", "seg_no", "lang")


def translated_messages(spark: SparkSession, folder: str) -> DataFrame:
    """(id, mode, src, tgt) of the current messages that hold both texts."""
    both = ~blank(F.col("original_content")) & ~blank(F.col("translated_content"))
    rows = current_rows(table(spark, folder, "messages"), {"mode": F.col("display_mode"), "src": F.col("original_content"), "tgt": F.col("translated_content")}, keep=both)
    return written(rows, "translated")


def glossary_terms(spark: SparkSession, folder: str) -> DataFrame:
    """(source, target, target_lang) of every variant of every entry."""
    entries = table(spark, folder, "glossary_entries").select(F.col("id").alias("entry_id"), "target", F.col("target_lang").alias("code"))
    variants = table(spark, folder, "glossary_variants").select("entry_id", "source")
    return variants.join(entries, "entry_id").join(code_bases(spark, folder), "code").select("source", "target", F.col("base").alias("target_lang"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    rows, (model, refusals) = translated_messages(spark, folder), models(spark, folder)
    lexicon = align.lexicon(rows, "src", "tgt", model, glossary_terms(spark, folder))
    bilingual = rows.where("mode = 'bilingual'")
    return align.aligned(bilingual, "id", "src", "tgt", model, lexicon, refusals).withColumnRenamed("id", "message_id")


LIMIT, OVERLAP = 2_500, 100


def long_messages(spark: SparkSession, folder: str) -> DataFrame:
    """(id, text) of the current messages that are too long for one piece."""
    long = F.length(F.regexp_replace("original_content", "^[ \\t\\n]+|[ \\t\\n]+$", "")) > LIMIT
    return current_rows(table(spark, folder, "messages"), {"text": F.col("original_content")}, keep=long)


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every oversized current message."""
    return chunking.split(long_messages(spark, folder), "text", ["id"], LIMIT, OVERLAP).withColumnRenamed("id", "message_id")


def p2_tiling(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the pieces of each message: no text lost, none too long, no overlap too long, all numbered."""
    cores = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", F.expr("substring(piece, core - start + 1)").alias("t")))), lambda x: x["t"]), "")
    rows = p2_pieces(spark, folder).groupBy("message_id").agg(
        F.sum(F.col("end") - F.col("core")).cast("int").alias("chars"), (F.max(F.length("piece")) <= LIMIT).alias("fits"), (F.max(F.col("core") - F.col("start")) <= OVERLAP).alias("overlaps"), (F.max("piece_no") + 1 == F.count("*")).alias("numbered"), F.md5(cores).alias("digest")
    )
    return rows.select("message_id", "chars", "fits", "overlaps", "numbered", "digest")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = chunking.split(long_messages(spark, folder), "text", ["id"], LIMIT, OVERLAP, with_text=False)
    return found.where("piece_no = 0").select(F.col("id").alias("message_id"), "boundary")


def conversation_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Current messages without their texts: id, session_id, role, display_order, created_at, usable."""
    said = F.when(conversations.role_of(F.col("role")) == "assistant", ~blank(F.col("translated_content"))).otherwise(~blank(F.col("original_content")))
    return current_rows(table(spark, folder, "messages"), {c: F.col(c) for c in ("session_id", "role", "display_order", "created_at")} | {"usable": said})


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    kept = conversations.conversations(conversation_rows(spark, folder), "session_id", "id", "role", ["display_order", "created_at"], "usable")
    return kept.select("session_id", "turn_no", F.col("id").alias("message_id"), "role")


def p3_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """The turns of conversations parted at gaps of inactivity longer than the calibrated one, roles inferred where they are missing."""
    rows = written(conversation_rows(spark, folder), "rows")
    order = ["display_order", "created_at"]
    seconds = conversations.calibrated_gap(conversations.gap_histogram(rows, "session_id", "id", "role", order, "created_at"))
    kept = conversations.conversations(rows, "session_id", "id", "role", order, "usable", "created_at", seconds, infer=True)
    return kept.withColumn("gap_seconds", F.lit(seconds))


def reply_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(id, prompt, reply, target) of the assistant rows with a prompt; target is the base code of target_lang.

    Turn numbers are found on narrow rows, so that a session of any size is spread over many tasks; the text of a turn
    before then joins by (session, turn number), which doesn't repeat. Rows that hold their own prompt join nothing.
    """
    m = table(spark, folder, "messages")
    role = conversations.role_of(F.col("role"))
    place = {c: F.col(c) for c in ("session_id", "display_order", "created_at")} | {"role": role}
    turns = written(current_rows(m, place).where("session_id IS NOT NULL AND NOT (role <=> 'system')"), "turns")
    numbers = written(positions(turns, ["session_id"], [F.col("display_order"), F.col("created_at"), F.col("id")], "turn").select("id", "session_id", "turn", "role"), "numbers")
    texts = {"role": role, "src": F.when(~blank(F.col("original_content")), F.col("original_content")), "tgt": F.when(role == "assistant", F.col("translated_content")), "code": F.col("target_lang")}
    # the three readers below share one shuffle of the texts
    cur = current_rows(m, texts, keep=F.coalesce(role.isin("user", "assistant"), F.lit(False)))
    assistants = cur.where("role = 'assistant'").join(code_bases(spark, folder), "code", "left")
    own = assistants.where("src IS NOT NULL").select("id", F.col("src").alias("prompt"), F.col("tgt").alias("reply"), F.col("base").alias("target"))
    bare = assistants.where("src IS NULL").select("id", "tgt", "base").join(numbers.drop("role"), "id")
    users = cur.where("role = 'user' AND src IS NOT NULL").select("id", "src").join(numbers.drop("role"), "id").select("session_id", (F.col("turn") + 1).alias("turn"), F.col("src").alias("prompt"))
    before = bare.join(users, ["session_id", "turn"]).select("id", "prompt", F.col("tgt").alias("reply"), F.col("base").alias("target"))
    return own.unionByName(before)


def trained_judge(spark: SparkSession, folder: str, pairs: DataFrame) -> defects.Judge:
    """Judge trained on a bounded sample: of the pairs with replies shorter than defects.LENGTH the one with the least hash
    in each of 4 * defects.SAMPLE slots, if sound."""
    model, refusals = models(spark, folder)
    lexicon = align.lexicon(pairs.where("reply IS NOT NULL"), "prompt", "reply", model, glossary_terms(spark, folder))
    hashed = pairs.where("reply IS NOT NULL AND target IS NOT NULL").where((F.length("reply") < defects.LENGTH) & (F.length("prompt") < defects.LENGTH)).withColumn("h", F.xxhash64("id"))
    drawn = hashed.groupBy(F.pmod("h", F.lit(4 * defects.SAMPLE)).alias("slot")).agg(F.min("h").alias("h")).select("h")
    sample = hashed.join(F.broadcast(drawn), "h").orderBy("h").select("prompt", "reply", "target").collect()
    sound = [(r["prompt"], r["reply"], r["target"]) for r in sample if defects.is_sound(model, refusals, r["prompt"], r["reply"], r["target"])]
    return defects.Judge(model, refusals, lexicon).train(sound)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = written(reply_pairs(spark, folder), "reply_pairs")
    found = defects.defects(pairs, "prompt", "reply", "target", ["id"], trained_judge(spark, folder, pairs))
    return found.where("defect IS NOT NULL").select(F.col("id").alias("message_id"), "defect")


def document_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return written(tokens.token_counts(table(spark, folder, "documents"), "text", ["doc_id", "source"]), "tokens")


def packed_documents(spark: SparkSession, folder: str) -> list[tuple[str, int, DataFrame]]:
    """(box, capacity, packing) of each row of pack_sizes, a table of fixed size."""
    sizes = document_tokens(spark, folder)
    boxes = table(spark, folder, "pack_sizes").where("capacity > 0").orderBy("capacity", "box").limit(100).collect()
    return [(r["box"], r["capacity"], packing.pack(sizes.select("doc_id", "tokens"), "doc_id", "tokens", r["capacity"])) for r in boxes]


def p7_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Box of every part of every document, for each capacity."""
    done = [p.select(F.lit(box).alias("box_size"), "doc_id", "part", F.col("size").alias("tokens"), F.col("box").alias("box_no")) for box, _, p in packed_documents(spark, folder)]
    return reduce(DataFrame.unionByName, done)


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the boxes of each capacity are."""
    done = [packing.fill(p, capacity).select(F.lit(box).alias("box_size"), F.lit(capacity).alias("capacity"), "boxes", "tokens", "fullest", "filled") for box, capacity, p in packed_documents(spark, folder)]
    return reduce(DataFrame.unionByName, done)


def p7_whole(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of each packing: every document whole and once, no box over its capacity, only what is larger divided."""
    done = []
    for box, capacity, p in packed_documents(spark, folder):
        docs = p.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("part").alias("parts"), F.max("part").alias("last"), F.sum("size").alias("size"))
        items = docs.agg(F.count("*").alias("documents"), F.coalesce(F.bool_and(F.expr(f"n = parts AND n = last + 1 AND n = greatest(1, ceil(size / {capacity}))")), F.lit(True)).alias("whole"))
        fits = packing.fill(p, capacity).select((F.coalesce("fullest", F.lit(0)) <= capacity).alias("fits"))
        done.append(items.join(F.broadcast(fits), F.lit(True)).select(F.lit(box).alias("box_size"), "documents", "whole", "fits"))
    return reduce(DataFrame.unionByName, done)


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Documents drawn, with their copies."""
    return mixing.mix(document_tokens(spark, folder), "doc_id", "source", "tokens", table(spark, folder, "mix_targets"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares reached, by source."""
    return mixing.shares(p8_mix(spark, folder), "source", "tokens", table(spark, folder, "mix_targets"))


def p8_caps(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of each source: no record above the cap on repeats, none drawn in two rows, none unknown, shares that add up."""
    targets = table(spark, folder, "mix_targets").where("source IS NOT NULL").select("source", "max_repeats")
    mixed = written(p8_mix(spark, folder), "mixed")
    got = mixed.groupBy("source").agg(F.max("copies").alias("most"), (F.count("*") == F.count_distinct("doc_id")).alias("once"))
    strange = mixed.join(table(spark, folder, "documents").select("doc_id", "source"), ["doc_id", "source"], "left_anti").groupBy("source").agg(F.count("*").alias("strange"))
    rows = targets.join(got, "source", "left").join(strange, "source", "left")
    return rows.select("source", "max_repeats", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("capped"), F.coalesce("once", F.lit(True)).alias("once"), F.col("strange").isNull().alias("known"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_spans(table(spark, folder, "documents"), "doc_id", "text", 200).withColumnRenamed("shared", "shared_chars")


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p2_found": p2_found, "p2_pieces": p2_pieces, "p2_tiling": p2_tiling, "p3_found": p3_found, "p3_gaps": p3_gaps, "p4_found": p4_found, "p4_segments": p4_segments, "p6_found": p6_found, "p7_pack": p7_pack, "p7_fill": p7_fill, "p7_whole": p7_whole, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_caps": p8_caps, "p9_found": p9_found}
