"""Labels, display thresholds, retry rules and log values as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.text import trimmed

# Fixed values.
TARGET_LABELS = {
    "en": "English (United States)",
    "en-US": "English (United States)",
    "en-GB": "English (United Kingdom)",
    "en-AU": "English (Australia)",
    "vi": "Vietnamese",
    "vi-VN": "Vietnamese",
    "ko": "Korean",
    "ko-KR": "Korean",
    "ja": "Japanese",
    "ja-JP": "Japanese",
    "zh-CN": "Simplified Chinese",
    "zh-TW": "Traditional Chinese",
    "fr": "French",
    "fr-FR": "French",
    "de": "German",
    "de-DE": "German",
    "es": "Spanish",
    "es-ES": "Spanish",
}
STYLES = ("business", "academic", "casual")
DEFAULT_MODEL = "gpt-4o-mini"
LONG, HEAVY, LAZY = 1_000, 28_000, 12_000
RETRIED = (429, 500, 502, 503)
TRANSIENT = ("deadline exceeded", "timeout", "connection reset", "EOF", "connection refused")


def target_label(code: Column) -> Column:
    """Name of a target language; an empty code is English, an unknown one stands for itself."""
    known = F.create_map(*[F.lit(x) for pair in TARGET_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, trimmed(code)), F.when(code == "", "English (United States)").otherwise(code))


def source_key(code: Column) -> Column:
    """vi for all its spellings, auto where nothing is known, else the code in lower case."""
    c = F.lower(trimmed(F.coalesce(code, F.lit(""))))
    return F.when(c.startswith("vi"), "vi").when(c.isin("auto", "", "unknown"), "auto").otherwise(c)


def style_or(style: Column, default: str) -> Column:
    c = F.lower(trimmed(F.coalesce(style, F.lit(""))))
    return F.when(c.isin(*STYLES), c).otherwise(default)


def model_used(provider: Column, model: Column, active: Column) -> Column:
    """The model asked for if a provider is named, its default if no model is, else the active one."""
    named, wanted = trimmed(F.coalesce(provider, F.lit(""))), trimmed(F.coalesce(model, F.lit("")))
    return F.when((named != "") & (wanted != ""), wanted).when(named != "", DEFAULT_MODEL).otherwise(active)


def footer_time(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "HH:mm"), F.lit(""))


def long_text(mode: Column, text: Column) -> Column:
    """Shown as a card: bilingual or long."""
    return F.coalesce(mode == "bilingual", F.lit(False)) | (F.length(F.coalesce(text, F.lit(""))) >= LONG)


def heavy_file(file_id: Column, text: Column) -> Column:
    """Too heavy to be opened in place."""
    return (F.coalesce(file_id, F.lit("")) != "") & (F.length(F.coalesce(text, F.lit(""))) >= HEAVY)


def pasted(role: Column, file_id: Column, own_long: Column, reply_long: Column) -> Column:
    """A user's long text is shown as pasted, unless it is a file's."""
    return (F.lower(trimmed(F.coalesce(role, F.lit("")))) == "user") & (F.coalesce(file_id, F.lit("")) == "") & (own_long | reply_long)


def retryable_status(status: Column, message: Column) -> Column:
    """Of calls to a model: busy or failing, but not a refused connection."""
    return F.coalesce(status.isin(*RETRIED), F.lit(False)) & ~F.lower(F.coalesce(message, F.lit(""))).contains("connection refused")


def retryable_scan(status: Column, message: Column) -> Column:
    """Of calls to text recognition: any failing server if it gave a status, else what reads like a lost connection."""
    lost = F.lit(False)
    for t in TRANSIENT:
        lost = lost | F.coalesce(message, F.lit("")).contains(t)
    return F.when(status.isNotNull(), status >= 500).otherwise(lost)


def backoff_millis(attempt: Column, jitter: Column) -> Column:
    """A second doubled with each attempt, moved by a fifth at most (jitter -1 to 1), at least 50 ms."""
    base = F.lit(1_000) * F.pow(F.lit(2), F.greatest(attempt, F.lit(0)))
    return F.greatest(F.lit(50), F.floor(base + base * 0.2 * jitter)).cast("bigint")


def scan_delay_seconds(attempt: Column) -> Column:
    return (F.greatest(attempt, F.lit(0)) * 5).cast("int")


def log_value(c: Column) -> Column:
    """Quoted, with escapes, if it holds a blank, a tab, a newline or a quote."""
    quoted = c
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")):
        quoted = F.replace(quoted, F.lit(a), F.lit(b))
    return F.when(c.rlike("[ \\t\\n\"]"), F.concat(F.lit('"'), quoted, F.lit('"'))).otherwise(c)


def log_line(ts: Column, level: Column, event: Column, fields: dict[str, Column]) -> Column:
    """[time] [LEVEL] event | key=value ..."""
    head = F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("] ["), F.rpad(level, 5, " "), F.lit("] "), event)
    return F.concat(head, F.lit(" |"), *[F.concat(F.lit(f" {k}="), log_value(v)) for k, v in fields.items()]) if fields else head
