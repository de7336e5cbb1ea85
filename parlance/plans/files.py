"""Queries of files, pages, translations, display and streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from parlance.functions import display as D
from parlance.functions import text as X
from parlance.operators import glossary, markdown, mutate, pages, regions
from parlance.operators.versions import current_rows
from parlance.plans.workspace import _documents, _lines, current, glossary_for_file, hot_session, messages, regions_from_markdown, rules, stream_events
from parlance.operators import reading
from parlance.session import shared_folder, written
from parlance.sources import office, sinks
from parlance.sources.tables import table
from parlance.streaming import folds


def _key(df, column="id"):
    """A key to look up: the least one, read off one narrow column."""
    return df.agg(F.min(column)).first()[0]


def file_by_id(spark, folder):
    key = _key(table(spark, folder, "files"))
    found = table(spark, folder, "files").where(F.col("id") == key)
    return current_rows(found, {c: F.col(c) for c in ("file_name", "status")}).limit(1)


def session_lookup(spark, folder):
    key = _key(table(spark, folder, "sessions"))
    found = current_rows(table(spark, folder, "sessions").where(F.col("id") == key), {c: F.col(c) for c in ("title", "status")})
    return found.where(F.col("status").isin("active", "pinned")).limit(1)


def pdf_scan_info(spark, folder):
    """Documents of a session as the pages of one file."""
    d = table(spark, folder, "documents").where("session_id IS NOT NULL")
    return pages.scan_info(d.select("session_id", "doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")), "session_id", [F.col("doc_id")], F.col("n"))


def page_texts(spark, folder):
    printed = F.replace(F.col("text"), F.lit("\n\n"), F.lit("\f"))
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(pages.form_feed_pages(printed)).alias("page", "t")).select("doc_id", "page", F.md5("t").alias("digest"))


def converter_cleanup(spark, folder):
    raw = F.concat(F.lit('<img src="a.png" width="3"/>'), F.regexp_replace("text", "(?m)^", "> "), F.lit("<sup>12</sup>\n\n\n\n<table><tr><td>x</td></tr></table>"))
    return _documents(spark, folder, digest=F.md5(X.converter_cleaned(raw)))


def _responses(spark, folder):
    """Documents as responses of text recognition, a page per paragraph."""
    found = F.transform(F.split("text", "\n\n"), lambda p, i: F.struct(i.alias("index"), p.alias("markdown")))
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.to_json(F.struct(found.alias("pages"), F.lit("m").alias("model"))).alias("response"))


def ocr_pages(spark, folder):
    return pages.recognised(_responses(spark, folder), "doc_id", "response").select("doc_id", "page_no", F.md5("markdown").alias("digest"))


def ocr_first_pages(spark, folder):
    found = pages.first_pages(pages.recognised(_responses(spark, folder), "doc_id", "response"), "doc_id", 3)
    return found.select("doc_id", F.md5("text").alias("digest"))


def ocr_preview(spark, folder):
    return pages.preview(regions_from_markdown(spark, folder), "doc_id").select("doc_id", F.md5("text").alias("digest"))


def file_dispatch(spark, folder):
    f = current(spark, folder, "files", "file_name file_size page_count char_count")
    return pages.file_info(f, "id", F.col("file_name"), F.col("file_size"), F.col("page_count"), F.col("char_count"))


def insert_rows(spark, folder):
    """Glossary entries with those of another language pair added."""
    e = table(spark, folder, "glossary_entries").select("id", "source_lang", "target_lang", "target")
    new = e.where("source_lang = 'en'").select(F.concat(F.lit("copy-"), "id").alias("id"), F.col("target_lang").alias("source_lang"), F.col("source_lang").alias("target_lang"), "target")
    return e.unionByName(new)


def insert_numbered_messages(spark, folder):
    """Each document becomes a message at the end of its session."""
    base = current(spark, folder, "messages", "session_id display_order")
    new = table(spark, folder, "documents").select("doc_id", "session_id")
    return mutate.insert_numbered(base, new, "session_id", "display_order", [F.col("doc_id")]).select("session_id", "doc_id", "display_order")


def insert_select_filtered(spark, folder):
    return current(spark, folder, "files", "file_type file_size").where(F.col("file_type").isin("docx"))


def publish_tables(spark, folder):
    """Two tables published together and read back."""
    place = f"{shared_folder(spark)}/parlance/published"
    e = table(spark, folder, "glossary_entries").select("id", "target")
    v = table(spark, folder, "glossary_variants").select("entry_id", "source")
    sinks.publish({"entries": e, "variants": v}, place)
    a, b = sinks.published(spark, place, "entries"), sinks.published(spark, place, "variants")
    return a.select(F.lit("entries").alias("name"), F.col("id").alias("key"), F.col("target").alias("text")).unionByName(b.select(F.lit("variants").alias("name"), F.col("entry_id").alias("key"), F.col("source").alias("text")))


def log_lines(spark, folder):
    f = current(spark, folder, "files", "file_name status updated_at")
    line = D.log_line(F.col("updated_at"), F.upper(F.lit("info")), F.lit("FileStatus"), {"name": F.coalesce("file_name", F.lit("")), "status": F.coalesce("status", F.lit(""))})
    return f.where("updated_at IS NOT NULL").select("id", line.alias("line"), F.regexp_extract(line, "^\\[[^\\]]*\\] \\[(\\w+) *\\]", 1).alias("level"), F.regexp_extract(line, "\\] (\\w+) \\|", 1).alias("event"))


def validation_flags(spark, folder):
    m = table(spark, folder, "messages")
    empty = lambda c: F.coalesce(X.trimmed(F.col(c)), F.lit("")) == ""
    return current_rows(m, {"no_content": empty("original_content"), "no_target": empty("target_lang"), "no_session": empty("session_id")})


def _sides(spark, folder):
    """(id, src, tgt): lines of both contents of current messages that hold both."""
    both = F.col("original_content").isNotNull() & F.col("translated_content").isNotNull()
    return current_rows(table(spark, folder, "messages"), {"src": F.split("original_content", "\n"), "tgt": F.split("translated_content", "\n")}, keep=both & (F.col("original_content") != "") & (F.col("translated_content") != ""))


def region_translations(spark, folder):
    """Source regions with the translations of their keys; a region without one stays, without text."""
    sides = written(_sides(spark, folder), "sides")
    src = sides.select("id", F.posexplode("src").alias("idx", "s"))
    tgt = sides.select("id", F.posexplode("tgt").alias("idx", "t"))
    return src.join(tgt, ["id", "idx"], "left").select("id", "idx", F.length("s").alias("source_chars"), F.md5("t").alias("digest"))


def translated_html(spark, folder):
    """Translations of a page's regions as one page of HTML; blank ones are left out."""
    sides = _sides(spark, folder)
    html = F.array_join(F.transform(F.filter(F.slice("tgt", F.lit(1), F.size("src")), lambda x: X.trimmed(x) != ""), lambda x: F.concat(F.lit("<p>"), X.escape_html(X.trimmed(x)), F.lit("</p>\n"))), "")
    return sides.select("id", F.md5(F.concat(F.lit('<div class="page" id="page-1">\n'), html, F.lit("</div>\n"))).alias("digest"))


def zip_paragraphs(spark, folder):
    """Paragraphs with the translations at their places, and whether both lists are as long."""
    sides = _sides(spark, folder)
    rows = sides.select("id", (F.size("src") == F.size("tgt")).alias("same"), F.posexplode(F.arrays_zip("src", "tgt")).alias("idx", "z"))
    return rows.select("id", "idx", "same", F.length("z.src").alias("source_chars"), F.length("z.tgt").alias("target_chars"))


def _sentences(c):
    return F.filter(F.split(F.regexp_replace(F.regexp_replace(c, "([.!?])(\\s)", "$1\x01$2"), "([。！？])", "$1\x01"), "\x01"), lambda x: X.trimmed(x) != "")


def bilingual_pairs(spark, folder):
    """Sentences of both sides by (block, sentence); what has no counterpart stays."""
    sides = written(_sides(spark, folder), "sides")

    def side(c, name):
        blocks = F.filter(c, lambda x: X.trimmed(x) != "")
        rows = sides.select("id", F.posexplode(blocks).alias("block", "b")).select("id", "block", F.posexplode(_sentences(F.col("b"))).alias("sentence", "s"))
        return rows.select("id", "block", "sentence", F.length(X.trimmed(F.col("s"))).alias(name))

    return side(F.col("src"), "source_chars").join(side(F.col("tgt"), "target_chars"), ["id", "block", "sentence"], "full")


def translatable_chars(spark, folder):
    n = F.aggregate(F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike("\\p{L}")), F.length), F.lit(0), lambda a, x: a + x)
    return _documents(spark, folder, chars=F.coalesce(n, F.lit(0)))


def region_counts(spark, folder):
    b = regions.blocks(F.col("text"))
    return table(spark, folder, "documents").where("text IS NOT NULL").groupBy("source").agg(F.sum(F.size(b)).alias("blocks"))


def glossary_line_counts(spark, folder):
    return glossary_for_file(spark, folder).select("current_file_name", F.when(X.trimmed(F.col("glossary")) == "", 0).otherwise(F.regexp_count("glossary", F.lit("\n")) + 1).cast("int").alias("n"))


def sessions_of_day(spark, folder):
    """Sessions of each day, the latest first, days by their latest; a day's sessions fit one row."""
    s = current(spark, folder, "sessions", "status updated_at").where(~F.col("status").isin("deleted", "archived"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("updated_at").cast("timestamp"))).alias("t"), "id")))
    return s.groupBy(F.to_date("updated_at").alias("day")).agg(F.array_join(F.transform(ordered, lambda x: x["id"]), ",").alias("ids"))


def page_ascending(spark, folder):
    """The newest page in ascending order."""
    page = reading.page(hot_session(spark, folder, "display_order"), size=60)
    return page.orderBy("display_order", F.desc("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("display_order", "id"))), lambda x: x["id"]), ",").alias("ids"))


def names_in_order(spark, folder):
    """Names in code point order with their places; a small table."""
    names = table(spark, folder, "doc_types").agg(F.sort_array(F.collect_list("name")).alias("n"))
    return names.select(F.posexplode("n").alias("place", "name"))


def prepend_session(spark, folder):
    """A session put in front of a page, and taken out of where it was."""
    s = current(spark, folder, "sessions", "updated_at")
    page = s.orderBy(F.desc("updated_at"), "id").limit(20)
    new = s.orderBy("updated_at", "id").limit(1).unionByName(page.orderBy("updated_at", "id").limit(1))
    return reading.merged_pages(new.withColumn("place", F.lit(0)), page.withColumn("place", F.lit(1)), "id").select("id", "place")


def _tables(spark, folder):
    """Documents as tables on the pages of their sources: bracketed ones go on over the page."""
    d = table(spark, folder, "documents").where("source IS NOT NULL").select("source", F.col("doc_id").alias("page"), F.lit(0).alias("nth"))
    row = F.concat(F.lit("<tr><td>["), F.col("page").cast("string"), F.lit("]</td><td>a</td></tr>"))
    head = F.lit('<table><thead><tr><th>k</th><th>v</th></tr></thead><tbody>')
    more = F.when(F.col("page") % 3 == 0, "").otherwise('<tr><th colspan="2">b</th></tr><tr><td>c</td><td>d</td></tr>')
    return d.withColumn("html", F.concat(head, row, more, F.lit("</tbody></table>")))


def cross_page_tables(spark, folder):
    fixed = pages.repaired(_tables(spark, folder), "source", "page", "html", regions.crosses_pages(F.col("html")), regions.merge_companion)
    return fixed.select("source", "page", F.md5("html").alias("digest"))


def table_columns(spark, folder):
    return _tables(spark, folder).select("page", pages.header_columns(F.col("html")).alias("head"), pages.body_columns(F.col("html")).alias("body"))


def docx_whitespace(spark, folder):
    return _documents(spark, folder, digest=F.md5(X.collapsed_lines(F.col("text"))))


def docx_plain(spark, folder):
    """Documents as the XML of a document part, with a deletion, a break and fields, read as markdown."""
    body = F.concat(F.lit("<w:p><w:r><w:t>"), X.escape_xml(F.col("text")), F.lit('</w:t></w:r></w:p><w:p><w:del w:id="1"><w:t>gone</w:t></w:del><w:t>a</w:t><w:br/><w:t>b</w:t><w:tab/>c</w:p><w:p>INCLUDEPICTURE "http://x/y.png" \\* MERGEFORMATINET and hyperlink "http://z" end &amp;amp; &quot;q&quot;</w:p>'))
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.md5(X.docx_markdown(body)).alias("digest"))


def html_unescape(spark, folder):
    return _documents(spark, folder, digest=F.md5(X.unescape_html(X.escape_html(F.col("text")))))


def keyword_marks(spark, folder):
    return _documents(spark, folder, digest=F.md5(X.highlighted(F.col("text"), "the")))


def footer_time(spark, folder):
    return messages(spark, folder, "created_at").select("id", D.footer_time(F.col("created_at")).alias("shown"))


def lang_labels(spark, folder):
    return messages(spark, folder, "source_lang target_lang").select("id", D.target_label(F.col("target_lang")).alias("label"), D.source_key(F.col("source_lang")).alias("source_key"))


def style_and_model(spark, folder):
    m = messages(spark, folder, "style model_used role")
    return m.select("id", D.style_or(F.col("style"), "business").alias("style"), D.model_used(F.col("role"), F.col("model_used"), F.lit("active")).alias("model"))


def heading_continuation(spark, folder):
    """Every other line in capitals, every fourth in parentheses."""
    line = F.when(F.col("idx") % 2 == 1, F.upper("line")).when(F.col("idx") % 4 == 2, F.concat(F.lit("("), "line", F.lit(")"))).otherwise(F.col("line"))
    return _lines(spark, folder).withColumn("line", line).where(X.heading_continues(F.col("line"))).select("doc_id", "idx")


def display_flags(spark, folder):
    """How each message is shown; whether a user's text is shown as pasted also depends on the reply after it."""
    m = table(spark, folder, "messages")
    own = F.coalesce("original_content", F.lit(""))
    rows = current_rows(m, {c: F.col(c) for c in ("session_id", "display_order", "created_at", "role", "file_id")} | {"own": D.long_text(F.col("display_mode"), own), "reply": D.long_text(F.col("display_mode"), F.col("translated_content")), "heavy": D.heavy_file(F.col("file_id"), own), "lazy": F.length(own) >= D.LAZY})
    placed = reading.with_neighbours(reading.numbered(rows, ["role", "file_id", "own", "reply", "heavy", "lazy"]), [], ["role", "reply"])
    reply = F.coalesce((F.lower(X.trimmed(F.col("next_role"))) == "assistant") & F.col("next_reply"), F.lit(False))
    return placed.select("id", "own", "reply", "heavy", "lazy", D.pasted(F.col("role"), F.col("file_id"), F.col("own"), reply).alias("pasted"))


def _errors(spark, folder):
    e = table(spark, folder, "events")
    status = F.when(F.col("event_id") % 4 == 0, F.lit(None).cast("int")).otherwise((F.col("event_id") % 150 + 400).cast("int"))
    said = F.when(F.col("event_id") % 3 == 0, F.lit("Connection refused")).when(F.col("event_id") % 5 == 0, F.lit("read: unexpected EOF")).otherwise("bad request")
    return e.select("event_id", status.alias("status"), said.alias("said"))


def retryable_errors(spark, folder):
    e = _errors(spark, folder)
    return e.select("event_id", D.retryable_status(F.col("status"), F.col("said")).alias("model"), D.retryable_scan(F.col("status"), F.col("said")).alias("scan"))


def retry_delays(spark, folder):
    attempts = spark.range(0, 6).withColumn("attempt", (F.col("id") - 1).cast("int"))
    return attempts.select("attempt", *[D.backoff_millis(F.col("attempt"), F.lit(j)).alias(n) for n, j in (("least", -1), ("even", 0), ("most", 1))], D.scan_delay_seconds(F.col("attempt")).alias("scan"))


def log_values(spark, folder):
    return table(spark, folder, "glossary_variants").where("source IS NOT NULL").select("id", D.log_value(F.col("source")).alias("shown"))


def paragraphs(spark, folder):
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(markdown.paragraphs(F.col("text"))).alias("idx", "p")).select("doc_id", "idx", F.md5("p").alias("digest"))


def inferred_markdown(spark, folder):
    return _documents(spark, folder, digest=F.md5(markdown.inferred(X.trimmed(F.col("text")))))


def markdown_batches(spark, folder):
    found = markdown.pieces_of(table(spark, folder, "documents"), "doc_id", "text", lambda t: markdown.paragraph_pieces(t, 2_500))
    return found.select("doc_id", "idx", F.length("piece").alias("n"), F.md5("piece").alias("digest"))


def hard_pieces(spark, folder):
    found = markdown.pieces_of(table(spark, folder, "documents"), "doc_id", "text", lambda t: markdown.hard_pieces("".join(t.split()), 500))
    return found.select("doc_id", "idx", F.md5("piece").alias("digest"))


def screen_pieces(spark, folder):
    found = markdown.pieces_of(table(spark, folder, "documents"), "doc_id", "text", markdown.screen_pieces)
    return found.select("doc_id", "idx", F.length("piece").alias("n"), F.md5("piece").alias("digest"))


def xlsx_preview(spark, folder):
    kept = F.filter(F.split("text", "\n"), lambda x: X.trimmed(x) != "")
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.md5(F.array_join(kept, "\n\n")).alias("digest"))


def glossary_upsert(spark, folder):
    """Extracted terms put into the glossary and read back as its text: known entries take new variants, others are added."""
    e, v = table(spark, folder, "glossary_entries").where("doc_type IS NOT NULL AND target IS NOT NULL").select("id", "target", "source_lang", "target_lang", "doc_type"), table(spark, folder, "glossary_variants").where("source IS NOT NULL").select("entry_id", "source")
    # what was extracted: the terms of every entry in capitals, for one doc_type more than there is
    asked = e.join(v.groupBy(F.col("entry_id").alias("id")).agg(F.array_sort(F.collect_set("source")).alias("s")), "id")
    terms = asked.select(F.concat(F.lit("new-"), "id").alias("term_id"), F.concat(F.col("s"), F.transform("s", F.upper)).alias("sources"), "source_lang", "target_lang", F.when(F.col("doc_type") == "legal", "lease").otherwise(F.col("doc_type")).alias("doc_type"), "target")
    matched = written(glossary.match_terms(terms, e, v), "matched")
    fresh = matched.where("entry_id IS NULL").select(F.col("term_id").alias("id"), "target", "source_lang", "target_lang", "doc_type")
    entries = e.unionByName(fresh)
    sources = matched.select(F.coalesce("entry_id", "term_id").alias("entry_id"), F.explode("sources").alias("source")).distinct()
    variants = mutate.insert_or_ignore(v.distinct(), sources, ["entry_id", "source"])
    return glossary.glossary_text(entries, variants, "doc_type").select("doc_type", F.md5("glossary").alias("digest"))


def prompt_parts(spark, folder):
    """What a translation is asked with: context, glossary and rules of a file, each only if there is any."""
    files = table(spark, folder, "glossary_entries").where("current_file_name IS NOT NULL").groupBy("current_file_name").agg(F.max("doc_type").alias("doc_type"), F.max("target_lang").alias("target_lang"))
    ruled = glossary.active_rules(rules(spark), files.select("doc_type", "target_lang").distinct())
    texts = files.join(glossary_for_file(spark, folder), "current_file_name", "left").join(ruled, ["doc_type", "target_lang"], "left")
    parts = F.array(F.concat(F.lit("Translate into "), D.target_label(F.col("target_lang")), F.lit(".")), F.concat(F.lit("Glossary:\n"), F.col("glossary")), F.concat(F.lit("Rules:\n"), F.col("rules")))
    return texts.select("current_file_name", F.md5(F.array_join(parts, "\n\n")).alias("digest"))


def stream_retries(spark, folder):
    return folds.retries(stream_events(spark, folder))


def stream_states(spark, folder):
    """State of each stream; the users with an even number cancel after their tenth event."""
    e = stream_events(spark, folder)
    nth = e.groupBy("stream_id").agg(F.min("seq").alias("a"), F.max("seq").alias("b"))
    cancels = nth.where(F.col("stream_id").cast("bigint") % 2 == 0).select("stream_id", F.floor((F.col("a") + F.col("b")) / 2).cast("bigint").alias("seq"), F.lit("cancel").alias("type"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("bigint").alias("tokens"))
    return folds.states(e.unionByName(cancels))


def stream_progress(spark, folder):
    e = stream_events(spark, folder).where("type = 'chunk'")
    total = e.groupBy("stream_id").agg(F.count("*").alias("total"))
    return folds.progress(e.join(total, "stream_id"), "stream_id", "seq", "total").select("stream_id", "seq", "done", "percent")


def stream_flushes(spark, folder):
    """Chunks joined until 40 bytes are held; a stream's end flushes the rest."""
    return folds.coalesced(stream_events(spark, folder), 40)


def _texts(spark, folder):
    return table(spark, folder, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("path"), "text")


def _rich_docx(c: pd.Series) -> pd.Series:
    return c.map(lambda t: office.make_rich_docx(t.split("\n"), "Head & " + t[:5].strip() + ".", "Boxed"))


def _rich_xlsx(c: pd.Series) -> pd.Series:
    return c.map(lambda t: office.make_rich_xlsx(t.split("\n"), 'Tab "1" & more'))


def docx_parts(spark, folder):
    """Documents with headers, fields, deletions and text boxes, read back."""
    files = _texts(spark, folder).select("path", F.pandas_udf(_rich_docx, "binary")("text").alias("content"))
    return office.read_docx(files).select("path", "part", "idx", F.md5("text").alias("digest"))


def docx_translated(spark, folder):
    """The same with every second paragraph replaced, written and read back."""
    files = written(_texts(spark, folder).select("path", F.pandas_udf(_rich_docx, "binary")("text").alias("content")), "docx")
    texts = office.read_docx(files).where("idx % 2 = 0").select("path", "part", "idx", F.concat(F.lit("<"), "text", F.lit(">")).alias("text"))
    return office.read_docx(office.write_docx(files, texts)).select("path", "part", "idx", F.md5("text").alias("digest"))


def xlsx_translated(spark, folder):
    """Workbooks with plain strings and such of several runs, every string with letters replaced, written and read back."""
    files = written(_texts(spark, folder).select("path", F.pandas_udf(_rich_xlsx, "binary")("text").alias("content")), "xlsx")
    texts = office.read_xlsx(files).where("translatable").select("path", "idx", F.concat(F.lit("<"), "text", F.lit(">")).alias("text"))
    names = office.read_sheets(files).select("path", "name", F.concat("name", F.lit("!")).alias("text"))
    done = written(office.write_xlsx(files, texts, names), "xlsx")
    strings = office.read_xlsx(done).select("path", "idx", F.md5("text").alias("digest"))
    return strings.unionByName(office.read_sheets(done).select("path", (-F.col("idx") - 1).alias("idx"), F.md5("name").alias("digest")))


_NAMES = """docx_parts docx_translated xlsx_translated file_by_id session_lookup pdf_scan_info page_texts converter_cleanup ocr_pages ocr_first_pages ocr_preview file_dispatch insert_rows
insert_numbered_messages insert_select_filtered publish_tables log_lines validation_flags region_translations translated_html zip_paragraphs
bilingual_pairs translatable_chars region_counts glossary_line_counts sessions_of_day page_ascending names_in_order prepend_session
cross_page_tables table_columns docx_whitespace docx_plain html_unescape keyword_marks footer_time lang_labels style_and_model
heading_continuation display_flags retryable_errors retry_delays log_values paragraphs inferred_markdown markdown_batches hard_pieces
screen_pieces xlsx_preview glossary_upsert prompt_parts stream_retries stream_states stream_progress stream_flushes"""

QUERIES = {n: globals()[n] for n in _NAMES.split()}
