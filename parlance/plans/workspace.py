"""Queries of the translation workspace over its own tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.functions import text as X
from parlance.operators import batching, glossary, markers, mutate, reading, regions, render
from parlance.operators.versions import current_rows
from parlance.sources import office
from parlance.sources.tables import table
from parlance.streaming import folds

SEARCHED = "lease"
TODAY = "2026-06-30"


def current(spark: SparkSession, folder: str, name: str, columns: str, keep: Column | None = None) -> DataFrame:
    """Latest versions of a keyed table with the given columns; of those that `keep` marks, if given."""
    return current_rows(table(spark, folder, name), {c: F.col(c) for c in columns.split()}, keep=keep)


def stated_files(spark, folder, columns):
    """Current files, of which every fifth has failed and every fifth is cancelled."""
    f = current(spark, folder, "files", f"{columns} file_size".replace("file_size file_size", "file_size"))
    n = F.col("file_size") % 5
    return f.withColumns({"status": F.when(n == 0, "error").when(n == 1, "cancelled").otherwise(F.col("status"))} | ({"error_msg": F.when(n == 0, "failed").otherwise(F.col("error_msg"))} if "error_msg" in columns.split() else {}))


def messages(spark, folder, columns):
    return current(spark, folder, "messages", columns)


def hot_session(spark, folder, columns):
    """Messages of the session with most rows; the session is found on one narrow column."""
    ids = table(spark, folder, "messages").groupBy("session_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "session_id").limit(1).select("session_id")
    # ids of the session first, in any version, then the versions of those alone
    m = table(spark, folder, "messages")
    own = m.join(ids, "session_id", "left_semi").select("id").distinct()
    rows = current_rows(m.join(own, "id", "left_semi"), {c: F.col(c) for c in f"session_id {columns}".split()})
    return rows.join(ids, "session_id", "left_semi")


def search_messages(spark, folder):
    # only hits travel with their texts
    m = current(spark, folder, "messages", "session_id role original_content translated_content created_at", keep=reading.hit(SEARCHED))
    return reading.search(m, current(spark, folder, "sessions", "title status"), SEARCHED)


def search_blank(spark, folder):
    """A blank query finds nothing; the sum over no rows."""
    m = messages(spark, folder, "session_id role original_content translated_content created_at")
    return reading.search(m, current(spark, folder, "sessions", "title status"), "  ").agg(F.count("*").alias("hits"))


def sessions_sorted(spark, folder):
    s = current(spark, folder, "sessions", "title status updated_at").where(~F.col("status").isin("deleted", "archived"))
    # the first hundred with their places, so that the order itself is part of the result
    top = s.withColumn("rest", F.when(F.col("status") == "pinned", 0).otherwise(1)).orderBy("rest", F.desc("updated_at"), "id").limit(100)
    place = F.row_number().over(Window.orderBy("rest", F.desc("updated_at"), "id"))
    return top.withColumn("place", place).drop("rest")


def messages_page_first(spark, folder):
    return reading.page(hot_session(spark, folder, "display_order role")).select("id", "display_order", "role")


def messages_page_cursor(spark, folder):
    return reading.page(hot_session(spark, folder, "display_order role"), before=500, size=60).select("id", "display_order", "role")


def messages_page_has_more(spark, folder):
    return reading.page_envelope(hot_session(spark, folder, "display_order"))


def message_with_file_size(spark, folder):
    f = current(spark, folder, "files", "file_size").select(F.col("id").alias("file_id"), "file_size")
    return messages(spark, folder, "file_id").join(f, "file_id", "left").select("id", "file_id", F.coalesce("file_size", F.lit(0)).alias("file_size"))


def cancelled_files(spark, folder):
    return stated_files(spark, folder, "session_id status").where("status = 'cancelled'").select("id", "session_id")


def next_display_order(spark, folder):
    return messages(spark, folder, "session_id display_order").where("session_id IS NOT NULL").groupBy("session_id").agg((F.coalesce(F.max("display_order"), F.lit(0)) + 1).alias("next_order"))


def prev_next_message(spark, folder):
    rows = reading.numbered(messages(spark, folder, "session_id display_order created_at role"), ["role"])
    return reading.with_neighbours(rows, ["id", "role"], ["id", "role"]).select("id", F.when(F.lower(F.trim("prev_role")) == "user", F.col("prev_id")).alias("prev_user_id"), F.when(F.lower(F.trim("next_role")) == "assistant", F.col("next_id")).alias("next_assistant_id"))


def date_separators(spark, folder):
    rows = reading.numbered(messages(spark, folder, "session_id display_order created_at"), [])
    day = F.to_date("created_at")
    return reading.with_neighbours(rows, ["created_at"], []).select("id", (~day.eqNullSafe(F.to_date("prev_created_at"))).alias("separator"))


def quoted_message_join(spark, folder):
    m = messages(spark, folder, "original_message_id original_content")
    quoted = m.select(F.col("id").alias("original_message_id"), X.quote_snippet(F.col("original_content")).alias("quote"), F.lit(True).alias("found"))
    return m.where("original_message_id <> ''").join(quoted, "original_message_id", "left").select("id", "original_message_id", "quote", F.coalesce("found", F.lit(False)).alias("found"))


def search_hit_remap(spark, folder):
    hit = F.coalesce(reading.matches(F.col("original_content"), SEARCHED), F.lit(False))
    m = current_rows(table(spark, folder, "messages"), {c: F.col(c) for c in ("session_id", "display_order", "created_at", "role")} | {"hit": hit})
    rows = reading.with_neighbours(reading.numbered(m, ["role", "hit"]), [], ["id", "role"])
    user = (F.lower(F.trim("role")) == "user") & (F.lower(F.trim("next_role")) == "assistant")
    return rows.where("hit").select("id", F.when(user, F.col("next_id")).otherwise(F.col("id")).alias("shown_id"))


def sessions_by_day(spark, folder):
    s = current(spark, folder, "sessions", "status updated_at").where(~F.col("status").isin("deleted", "archived"))
    return s.groupBy(F.to_date("updated_at").alias("day")).agg(F.count("*").alias("sessions"), F.max("updated_at").alias("newest"), F.min("id").alias("first_id"))


def pinned_partition(spark, folder):
    s = current(spark, folder, "sessions", "status")
    return s.groupBy(F.coalesce(F.col("status") == "pinned", F.lit(False)).alias("pinned")).agg(F.count("*").alias("sessions"))


def page_union_dedup(spark, folder):
    m = hot_session(spark, folder, "display_order")
    a = reading.page(m, size=60).withColumn("page", F.lit(1))
    b = reading.page(m, size=100).withColumn("page", F.lit(2))
    return reading.merged_pages(a, b, "id").select("id", "display_order", "page")


def page_upsert_last_wins(spark, folder):
    m = hot_session(spark, folder, "display_order tokens")
    page = reading.page(m, size=60).select("id", "display_order", "tokens")
    return mutate.upsert(page, reading.page(m, size=10).select("id", "display_order", F.lit(-1).cast("bigint").alias("tokens")), ["id"])


def settings(spark):
    rows = [("model", "standard"), ("style", ""), ("target_lang", "vi")]
    return spark.createDataFrame(rows, "key string, value string")


def settings_upsert(spark, folder):
    changes = spark.createDataFrame([("style", "casual"), ("theme", "dark")], "key string, value string")
    return mutate.upsert(settings(spark), changes, ["key"])


def settings_map_defaults(spark, folder):
    return glossary.settings_row(settings(spark), {"model": "none", "style": "business", "theme": "light"})


def insert_or_ignore(spark, folder):
    new = table(spark, folder, "glossary_entries").where("doc_type IS NOT NULL").select(F.col("doc_type").alias("id"), X.title_case_id(F.col("doc_type")).alias("name"))
    return mutate.insert_or_ignore(table(spark, folder, "doc_types").select("id", "name"), new.distinct(), ["id"]).select("id")


def update_by_key(spark, folder):
    f = stated_files(spark, folder, "status error_msg").drop("file_size")
    changes = f.where("status = 'error'").select("id", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error_msg"))
    return mutate.update_by_key(f, changes, "id", ["status", "error_msg"])


def clear_tag_update(spark, folder):
    e = table(spark, folder, "glossary_entries").select("id", "current_file_name")
    tagged = F.col("current_file_name").like("%.docx")
    return mutate.update_where(e, tagged, {"current_file_name": F.lit(None).cast("string")})


def delete_rows(spark, folder):
    return mutate.delete_where(stated_files(spark, folder, "status"), F.col("status").isin("cancelled", "error")).select("id")


def delete_cascade(spark, folder):
    kept = current(spark, folder, "sessions", "status").where("status <> 'deleted'")
    return mutate.cascade(messages(spark, folder, "session_id"), "session_id", kept, "id").select("id", "session_id")


def delete_set_null(spark, folder):
    f = stated_files(spark, folder, "status").where("NOT (status <=> 'cancelled')")
    return mutate.set_null(messages(spark, folder, "file_id"), "file_id", f, "id").select("id", "file_id")


def check_violations(spark, folder):
    m = messages(spark, folder, "role display_mode session_id")
    return mutate.check_violations(m, "id", {"role": F.col("role").isin("user", "assistant"), "mode": F.col("display_mode").isin("bubble", "bilingual", "file"), "session": F.col("session_id").isNotNull()})


def unique_violations(spark, folder):
    return mutate.unique_violations(messages(spark, folder, "session_id display_order"), ["session_id", "display_order"])


def migration_recode(spark, folder):
    return messages(spark, folder, "file_id display_mode").select("id", F.when(F.col("file_id").isNotNull() & (F.col("display_mode") == "bilingual"), "file").otherwise(F.col("display_mode")).alias("display_mode"))


def glossary_for_file(spark, folder):
    e = table(spark, folder, "glossary_entries").where("current_file_name IS NOT NULL")
    return glossary.glossary_text(e.select("id", "target", "current_file_name"), table(spark, folder, "glossary_variants"), "current_file_name")


def glossary_match_or_insert(spark, folder):
    e, v = table(spark, folder, "glossary_entries"), table(spark, folder, "glossary_variants")
    asked = e.join(v.groupBy(F.col("entry_id").alias("id")).agg(F.array_sort(F.collect_list("source")).alias("sources")), "id")
    return glossary.match_terms(asked.select(F.col("id").alias("term_id"), "sources", "source_lang", "target_lang", "doc_type"), e, v).select("term_id", "entry_id", F.col("entry_id").isNull().alias("is_new"))


RULES = [
    ("r1", "Be formal.", None, None, True, 1),
    ("r2", " Use legal terms. ", "legal", None, True, 2),
    ("r3", "Use polite forms.", None, "ja", True, 0),
    ("r4", "Old rule.", None, None, False, 0),
    ("r5", "  ", None, None, True, 0),
]


def rules(spark):
    return spark.createDataFrame(RULES, "id string, content string, doc_type string, target_lang string, enabled boolean, sort_order int")


def active_rules_join(spark, folder):
    wanted = table(spark, folder, "glossary_entries").select("doc_type", "target_lang").distinct()
    return glossary.active_rules(rules(spark), wanted)


def active_rules(spark, folder):
    wanted = spark.createDataFrame([("legal", "ja")], "doc_type string, target_lang string")
    return glossary.active_rules(rules(spark), wanted)


def doc_type_title_case(spark, folder):
    return table(spark, folder, "doc_types").select("id", X.title_case_id(F.col("id")).alias("title"))


def _documents(spark, folder, **columns):
    return table(spark, folder, "documents").select("doc_id", *[c.alias(n) for n, c in columns.items()])




def token_estimate(spark, folder):
    return _documents(spark, folder, tokens=X.token_estimate(F.col("text")))


def file_info_estimates(spark, folder):
    chunks = X.estimated_chunks(F.col("char_count"))
    return table(spark, folder, "file_infos").select("file_id", chunks.alias("chunks"), X.estimated_minutes(chunks).alias("minutes"))


def char_page_counts(spark, folder):
    n = F.length("text")
    return _documents(spark, folder, chars=F.coalesce(n, F.lit(0)), pages=X.page_count(n))


def language_hint_backend(spark, folder):
    return _documents(spark, folder, hint=F.coalesce(X.language_hint(F.col("text")), F.lit("auto")))


def language_hint_frontend(spark, folder):
    return _documents(spark, folder, guess=F.coalesce(X.language_guess(F.col("text")), F.lit("unknown")))


def letter_ratios(spark, folder):
    c = F.col("text")
    return _documents(spark, folder, letters=X.letters(c), upper=X.letters(c, "\\p{Lu}"), ascii=X.letters(c, "A-Za-z"))


def _lines(spark, folder):
    return batching.lines_of(table(spark, folder, "documents"), "doc_id", "text")


def _marked_lines(spark, folder):
    """Lines of which every fourth is a bullet and every fourth a row of a table with an empty column."""
    n, line = F.col("idx") % 4, F.col("line")
    return _lines(spark, folder).withColumn("line", F.when(n == 1, F.concat(F.lit("• "), line)).when(n == 2, F.concat(F.lit("| "), line, F.lit(" | |"))).otherwise(line))


def heading_level(spark, folder):
    return _lines(spark, folder).select("doc_id", "idx", X.heading_level(F.col("line")).alias("level")).where("level > 0")


def bullet_normalize(spark, folder):
    out = X.bullet(F.col("line"))
    return _marked_lines(spark, folder).select("doc_id", "idx", out.alias("line"), F.col("line").alias("was")).where("line <> was").drop("was")


def markdown_likeness(spark, folder):
    return _documents(spark, folder, markdown=F.coalesce(X.looks_markdown(F.col("text")), F.lit(False)))


def strip_tags(spark, folder):
    return _documents(spark, folder, plain=F.md5(X.strip_tags(F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>")))))


def escape_html(spark, folder):
    return _documents(spark, folder, html=F.md5(X.escape_html(F.col("text"))))


def escape_xml(spark, folder):
    return _documents(spark, folder, xml=F.md5(X.escape_xml(F.col("text"))), same=X.unescape_xml(X.escape_xml(F.col("text"))) == F.col("text"))


def truncate_runes(spark, folder):
    return _documents(spark, folder, short=X.truncated(F.col("text"), 80))


def session_title(spark, folder):
    s = current(spark, folder, "sessions", "title")
    titled = F.when(F.length("title") % 3 != 0, F.col("title"))
    return s.select("id", X.session_title(titled, F.concat(F.lit("## About "), "title", F.lit("\nsecond"))).alias("title"))


def content_title(spark, folder):
    return _documents(spark, folder, title=X.title_of(F.col("text")))


def quote_snippet(spark, folder):
    return messages(spark, folder, "original_content").select("id", X.quote_snippet(F.col("original_content")).alias("quote"))


def search_snippet(spark, folder):
    return _documents(spark, folder, snippet=X.search_snippet(F.col("text"), SEARCHED))


def keyword_highlight(spark, folder):
    return _documents(spark, folder, n=F.regexp_count(X.highlighted(F.col("text"), SEARCHED), F.lit("<mark>"))).where("n > 0")


def file_size_label(spark, folder):
    return current(spark, folder, "files", "file_size").select("id", X.file_size_label(F.col("file_size")).alias("label"))


def file_titles(spark, folder):
    return current(spark, folder, "files", "file_name").select("id", X.file_title(F.col("file_name")).alias("title"))


def attachment_names(spark, folder):
    c = F.col("original_content")
    return current_rows(table(spark, folder, "messages"), {"name": X.attachment_name(c)}, keep=c.startswith("📎"))


def date_label(spark, folder):
    s = current(spark, folder, "sessions", "updated_at").where("updated_at IS NOT NULL")
    return s.select("id", X.date_label(F.to_date("updated_at"), F.to_date(F.lit(TODAY))).alias("label"))


def refusal_filter(spark, folder):
    return current_rows(table(spark, folder, "messages"), {"refused": F.lit(True)}, keep=X.is_refusal(F.col("translated_content"))).select("id")


def json_salvage(spark, folder):
    """Answers around a JSON object; every third breaks off inside it, every fifth has none."""
    n = F.length(F.coalesce("text", F.lit("")))
    whole = F.concat(F.lit('Sure: {"doc_type": "'), F.coalesce("doc_type", F.lit("")), F.lit('", "summary": "s'), F.col("doc_id").cast("string"), F.lit('"} done'))
    raw = F.when(n % 5 == 0, "none").when(n % 3 == 0, F.substring(whole, 1, 20)).otherwise(whole)
    parsed = F.from_json(X.json_body(raw), "doc_type string, summary string")
    return table(spark, folder, "documents").select("doc_id", F.coalesce(parsed["doc_type"], F.lit("")).alias("kind"), F.coalesce(parsed["summary"], F.lit("")).alias("summary"))


def paragraph_batches(spark, folder):
    return batching.batched(table(spark, folder, "documents"), "doc_id", "text", 2_500)


def xlsx_batches(spark, folder):
    return batching.batched(table(spark, folder, "documents"), "doc_id", "text", 2_500, separator=0)


def _segments(spark, folder):
    sized = F.transform(F.filter(F.split("text", "\n"), lambda x: X.trimmed(x) != ""), lambda x: F.struct(F.length(x).cast("bigint").alias("size"), x.startswith("#").alias("is_html")))
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", sized.alias("s"))


def segment_batches(spark, folder):
    zipped = F.arrays_zip("s", batching.segment_batch_numbers(F.col("s")).alias("b"))
    return _segments(spark, folder).select("doc_id", F.posexplode(zipped).alias("idx", "x")).select("doc_id", "idx", F.col("x.b").alias("batch"))


def batch_offsets(spark, folder):
    """First item of every batch: the sizes of the batches before it, summed up. The window is one document's batches."""
    sizes = paragraph_batches(spark, folder).groupBy("doc_id", "batch").agg(F.count("*").alias("items"))
    before = Window.partitionBy("doc_id").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("first", F.coalesce(F.sum("items").over(before), F.lit(0)).cast("int"))


def marker_encode(spark, folder):
    lines = F.filter(F.split("text", "\n"), lambda x: X.trimmed(x) != "")
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.md5(markers.encoded(lines)).alias("encoded"))


def marker_decode(spark, folder):
    lines = F.filter(F.transform(F.split("text", "\n"), X.trimmed), lambda x: (x != "") & ~x.startswith("<"))
    rows = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", lines.alias("lines")).where("size(lines) > 0")
    back = markers.decoded(markers.encoded(F.col("lines")), F.size("lines"))
    return rows.select("doc_id", F.size(back).alias("n"), (back == F.col("lines")).alias("same"))


def translation_fallback(spark, folder):
    m = messages(spark, folder, "role original_content translated_content").where("lower(trim(role)) = 'assistant'")
    bad = (F.coalesce(X.trimmed(F.col("translated_content")), F.lit("")) == "") | X.is_refusal(F.col("translated_content"))
    return m.select("id", F.md5(F.when(bad, F.col("original_content")).otherwise(F.col("translated_content"))).alias("shown"))


def token_rollup(spark, folder):
    m = messages(spark, folder, "session_id tokens translated_content").where("session_id IS NOT NULL")
    sums = m.groupBy("session_id").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("used"), F.sum(X.token_estimate(F.col("translated_content"))).alias("guess"))
    return sums.select("session_id", F.when(F.col("used") > 0, F.col("used")).otherwise(F.col("guess")).alias("tokens"))


def stream_events(spark, folder):
    """The events table as a stream of each user: views and clicks are chunks, purchases usage, signups done."""
    e = table(spark, folder, "events")
    kind = F.when(F.col("event_type").isin("view", "click"), "chunk").when(F.col("event_type") == "purchase", "usage").when(F.col("event_type") == "error", "error").otherwise("done")
    return e.select(F.col("user_id").cast("string").alias("stream_id"), F.col("event_id").alias("seq"), kind.alias("type"), F.concat(F.col("event_id").cast("string"), F.lit(";")).alias("content"), F.when(F.col("event_type") == "purchase", F.floor("value").cast("bigint")).alias("tokens"))


def stream_fold_batch(spark, folder):
    return folds.fold_batch(stream_events(spark, folder)).select("stream_id", "status", F.md5("text").alias("text"), "tokens")


def progress_percent(spark, folder):
    done = F.col("display_order")
    return messages(spark, folder, "session_id display_order").where("display_order >= 0").select("id", X.percent(done, F.lit(250)).alias("percent"))


def progress_thinning(spark, folder):
    percents = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(F.split("text", "\n")))), lambda i: F.floor(i * 100 / F.size(F.split("text", "\n"))).cast("int"))
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(batching.thinned(percents).cast("array<string>"), ",").alias("emitted"))


def blocks_from_markdown(spark, folder):
    b = regions.blocks(F.col("text"))
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.size(b).alias("blocks"), F.md5(F.array_join(b, "\x01")).alias("digest"))


def regions_from_markdown(spark, folder):
    return regions.regions(table(spark, folder, "documents"), "doc_id", "text")


def translatable_segments(spark, folder):
    return regions.segments(regions_from_markdown(spark, folder), "doc_id")


def block_filters(spark, folder):
    lines = _lines(spark, folder)
    c = F.col("line")
    return lines.select("doc_id", "idx", regions.is_noise(c).alias("noise"), regions.is_stamp(c).alias("stamp"), regions.is_bold_heading(c).alias("bold"), regions.is_implied_heading(c).alias("implied")).where("noise OR stamp OR bold OR implied")


def table_cells(spark, folder):
    rows = _marked_lines(spark, folder).where(F.col("line").contains("|"))
    return rows.select("doc_id", "idx", F.posexplode(regions.cells(X.trimmed(F.col("line")))).alias("col", "cell"))


def table_drop_empty_columns(spark, folder):
    """Cells whose column holds something anywhere in the document's bar lines."""
    cells = table_cells(spark, folder)
    used = cells.where("cell <> ''").select("doc_id", "col").distinct()
    return cells.join(used, ["doc_id", "col"], "left_semi").select("doc_id", "idx", "col", "cell")


def title_run_merge(spark, folder):
    found = regions_from_markdown(spark, folder)
    return render.title_runs(found, "doc_id", regions.mergeable_title(F.col("content"))).select("doc_id", "first_idx", "type", F.size("lines").alias("n"))


def html_assembly(spark, folder):
    found = regions_from_markdown(spark, folder)
    return render.page_html(render.title_runs(found, "doc_id", regions.mergeable_title(F.col("content"))), "doc_id")


def docx_paragraphs(spark, folder):
    """Documents packed as DOCX and read back: one row per non-blank line."""
    docs = table(spark, folder, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("path"), F.pandas_udf(_pack_docx, "binary")(F.col("text")).alias("content"))
    return office.read_docx(docs).select(F.col("path").cast("bigint").alias("doc_id"), "idx", F.md5("text").alias("digest"))


def xlsx_strings(spark, folder):
    docs = table(spark, folder, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("path"), F.pandas_udf(_pack_xlsx, "binary")(F.col("text")).alias("content"))
    return office.read_xlsx(docs).select(F.col("path").cast("bigint").alias("doc_id"), "idx", F.md5("text").alias("digest"), "translatable")


def _pack_docx(c: pd.Series) -> pd.Series:
    return c.map(lambda t: office.make_docx(t.split("\n")))


def _pack_xlsx(c: pd.Series) -> pd.Series:
    return c.map(lambda t: office.make_xlsx(t.split("\n")))


def sentence_split(spark, folder):
    parts = F.split(F.regexp_replace(F.regexp_replace("text", "([.!?])(\\s)", "$1\x01$2"), "([。！？])", "$1\x01"), "[\x01\n]")
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.filter(parts, lambda x: x.rlike("[\\p{L}\\p{N}]"))).alias("idx", "s")).select("doc_id", "idx", F.length("s").alias("n"))


def external_map_stub(spark, folder):
    """The boundary where a translator would be called, with its deterministic stand-in."""
    return messages(spark, folder, "target_lang original_content").where("original_content <> ''").select("id", F.md5(F.concat(F.lit("["), F.coalesce("target_lang", F.lit("")), F.lit("] "), F.col("original_content"))).alias("digest"))


_NAMES = """search_messages search_blank sessions_sorted messages_page_first messages_page_cursor messages_page_has_more message_with_file_size cancelled_files
next_display_order prev_next_message date_separators quoted_message_join search_hit_remap sessions_by_day pinned_partition page_union_dedup
page_upsert_last_wins settings_upsert settings_map_defaults insert_or_ignore update_by_key clear_tag_update delete_rows delete_cascade delete_set_null
check_violations unique_violations migration_recode glossary_for_file glossary_match_or_insert active_rules active_rules_join doc_type_title_case
token_estimate file_info_estimates char_page_counts language_hint_backend language_hint_frontend letter_ratios heading_level bullet_normalize
markdown_likeness strip_tags escape_html escape_xml truncate_runes session_title content_title quote_snippet search_snippet keyword_highlight
file_size_label file_titles attachment_names date_label refusal_filter json_salvage paragraph_batches xlsx_batches segment_batches batch_offsets
marker_encode marker_decode translation_fallback token_rollup stream_fold_batch progress_percent progress_thinning blocks_from_markdown
regions_from_markdown translatable_segments block_filters table_cells table_drop_empty_columns title_run_merge html_assembly docx_paragraphs
xlsx_strings sentence_split external_map_stub"""

QUERIES = {n: globals()[n] for n in _NAMES.split()}
