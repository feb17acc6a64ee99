"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for "not given".
PLACEHOLDERS = ("", "无", "暂无", "没有", "未明确", "不明确", "待确认", "n/a", "none", "null", "仍需确认的问题", "风险、限制或依赖项")
# How unnamed speakers are shown.
UNASSIGNED, SPEAKER_LABEL = "未指定", "发言人"
# Phases and progress of a product by the stage of its run.
PHASES = {
    "awaiting_audio": "uploading", "audio_upload": "uploading", "segmentation": "transcribing", "batch_asr": "transcribing", "transcript_prepare": "transcribing",
    "processing": "transcribing", "llm_summary": "synthesizing", "compat_export": "synthesizing", "meeting_ready": "synthesizing",
}
PROGRESS = {"awaiting_audio": 5, "audio_upload": 8, "segmentation": 12, "batch_asr": 35, "transcript_prepare": 58, "llm_summary": 68, "compat_export": 92, "meeting_ready": 100}
# Categories of errors by stage and by code, and what may be tried again.
STAGE_CATEGORIES = {"preflight": "environment", "segmentation": "segmentation", "batch_asr": "asr", "transcript_prepare": "transcript", "llm_summary": "llm", "compat_export": "export", "pipeline": "unknown"}
CODE_CATEGORIES = {
    "missing_script": "environment", "invalid_previous_config": "environment", "process_failed": "resource", "invalid_artifacts": "validation", "validation_failed": "validation",
    "request_failed": "llm", "export_failed": "export", "internal_error": "unknown",
}
RETRY_CATEGORIES = ("environment", "resource", "segmentation", "asr", "llm", "export", "unknown")
RETRY_CAUSES = ("finish_reason_length", "context_truncated", "invalid_json", "missing_speaker_summaries")
# How a log tells its level, and what may stand before a result.
LOG_LEVEL = r"^[\[(]?[IEWDF]\s"
RESULT_NAME = r"(?i)^(?:result|asr result|recognition result|final result|final commit result)\s*[:：]\s*"
# Words of a log line that is no transcript.
LOG_WORDS = (
    "rknn", "rknnapi", "model", "init", "load", "elapsed", "rtf", "time", "ms", "fps", "input", "output", "version", "usage", "warning", "error", "encoder", "token", "tokenizer", "vocab", "special_",
    "bos", "eos", "eog", "audio", "wav", "path", "device", "commit", "final", "llama", "tensor", "infer", "malloc", "free", "shape", "dtype", "core", "server", "errno",
)


def normalize_speaker(c: Column) -> Column:
    """Blank and unknown become ``unknown``; others carry the prefix ``speaker_``."""
    t = F.trim(c)
    return F.when(c.isNull() | (t == "") | (t == "unknown"), "unknown").when(t.startswith("speaker_"), t).otherwise(F.concat(F.lit("speaker_"), t))


def seconds_to_ms(c: Column) -> Column:
    """Half to even; negative and non-finite values become null."""
    return F.when((c >= 0) & ~F.isnan(c) & (c < float("inf")), F.rint(c * 1000.0).cast("long"))


def format_ms(c: Column) -> Column:
    """``1m05s``, rounded to seconds."""
    s = F.floor((c + 500) / 1000)
    return F.concat(F.floor(s / 60).cast("string"), F.lit("m"), F.lpad((s % 60).cast("string"), 2, "0"), F.lit("s"))


def clock(c: Column) -> Column:
    """``HH:MM:SS.mmm`` of milliseconds; null stays null."""
    def two(x: Column) -> Column:
        return F.lpad(x.cast("string"), 2, "0")

    s = F.floor(c / 1000)
    return F.concat(two(F.floor(s / 3600)), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60), F.lit("."), F.lpad((c % 1000).cast("string"), 3, "0"))


def clean_text(c: Column) -> Column:
    """White space collapsed and trimmed; placeholders become null."""
    t = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(~F.lower(t).isin(*PLACEHOLDERS), t)


def last_chars(c: Column, n: int) -> Column:
    """The last n code points."""
    return F.substring(c, F.greatest(F.length(c) - n + 1, F.lit(1)), F.lit(n))


def bool_of(c: Column) -> Column:
    """Null is false; words that are neither become null."""
    t = F.lower(F.trim(c))
    return F.when(c.isNull(), False).when(t.isin("1", "true", "t", "yes", "y", "on"), True).when(t.isin("0", "false", "f", "no", "n", "off"), False)


def compact_ref(segment_id: Column, fallback: Column) -> Column:
    """``seg-000123`` becomes ``r123``; other ids get the fallback number."""
    n = F.regexp_extract(segment_id, r"^seg-(\d+)$", 1)
    return F.concat(F.lit("r"), F.when(n != "", n.cast("long")).otherwise(fallback).cast("string"))


def safe_name(c: Column) -> Column:
    """Only letters, digits and ``_.-``, without underscores around; ``x`` if nothing is left."""
    name = F.btrim(F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "_"), F.lit("_"))
    return F.when(name == "", "x").otherwise(name)


def strip_control(c: Column) -> Column:
    """Without ANSI sequences and ``<|tags|>``; carriage returns become line feeds."""
    return F.regexp_replace(F.replace(F.regexp_replace(c, "\x1b\\[[0-9;?]*[A-Za-z]", ""), F.lit("\r"), F.lit("\n")), r"<\|[^|]+\|>", "")


def _two(x: Column) -> Column:
    t = x.cast("string")
    return F.when(F.length(t) < 2, F.lpad(t, 2, "0")).otherwise(t)


def hms(ms: Column) -> Column:
    """``HH:MM:SS`` of milliseconds, rounded half to even; null becomes question marks."""
    s = F.rint(ms / 1000).cast("long")
    return F.when(ms.isNull(), "??:??:??").otherwise(F.concat(_two(F.floor(s / 3600)), F.lit(":"), _two(F.floor(s / 60) % 60), F.lit(":"), _two(s % 60)))


def minute_clock(ms: Column) -> Column:
    """``MM:SS.mmm`` of milliseconds; minutes go on beyond 60."""
    return F.concat(_two(F.floor(ms / 60_000)), F.lit(":"), _two(F.floor(ms / 1000) % 60), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def parse_minute_clock(c: Column) -> Column:
    """Milliseconds of ``MM:SS.mmm``."""
    part = F.split(c, ":")
    return F.rint(part[0].try_cast("double") * 60_000 + part[1].try_cast("double") * 1000).cast("long")


def whole_seconds(ms: Column) -> Column:
    """``1m05s`` of milliseconds cut to seconds; null becomes dashes."""
    s = F.greatest(F.lit(0).cast("long"), F.floor(ms / 1000))
    return F.when(ms.isNull(), "--:--").otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m"), _two(s % 60), F.lit("s")))


def seconds_of(c: Column) -> Column:
    """Seconds to 3 decimals of milliseconds given as text or number; null where they are none or not finite."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.round(x / 1000, 3))


def preview(c: Column, limit: int = 180) -> Column:
    """One line, cut at the limit with dots behind."""
    t = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit), F.lit("...")))


def clean_lines(c: Column) -> Column:
    """Lines without ANSI sequences, white space collapsed, blank ones left out."""
    lines = F.split(F.replace(F.regexp_replace(c, "\x1b\\[[0-9;]*[A-Za-z]", ""), F.lit("\r"), F.lit("\n")), "\n")
    return F.array_join(F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != ""), "\n")


def is_transcript_line(c: Column) -> Column:
    """Whether a line of a log is what somebody said: Chinese text, or enough letters without words of a log."""
    s = F.btrim(c)
    chinese, log = s.rlike("[一-鿿]"), F.lower(s).rlike("|".join(LOG_WORDS))
    level = s.rlike(LOG_LEVEL)
    enough = (F.length(F.regexp_replace(s, "[^A-Za-z]", "")) >= 8) & (F.length(s) >= 12)
    return F.when((s == "") | (log & ~chinese) | level, False).otherwise(chinese | enough)


def clean_candidate(c: Column) -> Column:
    """A line without control sequences, the name of a result before it and quotes around it."""
    s = F.btrim(strip_control(c), F.lit(" \t\n\r"))
    s = F.regexp_replace(s, RESULT_NAME, "")
    return F.btrim(s, F.lit(" \t\n\r\"'"))


def speaker_kind(speaker: Column) -> Column:
    return F.when(speaker == "unknown_boundary", "boundary").when(speaker == "unknown_fragment", "fragment").when(speaker.startswith("speaker_"), "main").otherwise("unknown")


def wanted_for_asr(speaker: Column, ms: Column, least: int, least_boundary: int, least_fragment: int, boundary: bool = True, fragments: bool = False, unknown: bool = False) -> Column:
    """Whether a segment is recognised: long enough for its kind, and a kind that is asked for."""
    kind = speaker_kind(speaker)
    return F.when(kind == "main", ms >= least).when(kind == "boundary", F.lit(boundary) & (ms >= least_boundary)).when(kind == "fragment", F.lit(fragments) & (ms >= least_fragment)).otherwise(F.lit(unknown) & (ms >= least))


def speaker_label(speaker: Column, names: Column | None = None) -> Column:
    """The given name, else a numbered label of ``speaker_N``, else the id; without a speaker the label for that."""
    number = F.regexp_extract(speaker, r"^speaker_(\d+)$", 1)
    made = F.when(F.coalesce(speaker, F.lit("")) == "", UNASSIGNED).when(number != "", F.concat(F.lit(SPEAKER_LABEL), number.cast("long").cast("string"))).otherwise(speaker)
    return made if names is None else F.coalesce(F.nullif(F.try_element_at(names, F.coalesce(speaker, F.lit(""))), F.lit("")), made)


def lookup(c: Column, table: dict, default) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.coalesce(c, F.lit(""))), F.lit(default))


def error_category(stage: Column, code: Column) -> Column:
    """By code, else by stage."""
    return F.coalesce(F.nullif(lookup(code, CODE_CATEGORIES, ""), F.lit("")), F.nullif(lookup(stage, STAGE_CATEGORIES, ""), F.lit("")), F.lit("unknown"))


def error_cause(code: Column, message: Column) -> Column:
    m = F.lower(message)
    def has(x):
        return F.contains(m, F.lit(x))

    return (
        F.when(has("finish_reason") & has("length"), "finish_reason_length").when(has("context_truncated") | has("input was truncated"), "context_truncated")
        .when((code == "invalid_json") | has("not valid json"), "invalid_json").when((code == "missing_speaker_summaries") | has("missing speaker summaries"), "missing_speaker_summaries")
    )


def retryable(category: Column, cause: Column, told: Column) -> Column:
    """What an error says of itself, else by its category and cause."""
    return F.coalesce(told, category.isin(*RETRY_CATEGORIES) | F.coalesce(cause.isin(*RETRY_CAUSES), F.lit(False)))


def compact_speaker(speaker: Column, number: Column) -> Column:
    """``speaker_7`` becomes ``sp7``; others get the number given."""
    n = F.regexp_extract(speaker, r"^speaker_(\d+)$", 1)
    return F.concat(F.lit("sp"), F.when(n != "", n.cast("long")).otherwise(number).cast("string"))


def integer_or(c: Column, default: int = 0) -> Column:
    return F.coalesce(c.try_cast("long"), F.lit(default).cast("long"))


def token_estimate(text: Column, chars_per_token: float = 1.3, overhead: int = 0) -> Column:
    return (F.ceil(F.length(text) / F.lit(chars_per_token)) + overhead).cast("long")


def overlap_ms(start: Column, end: Column, start2: Column, end2: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(end, end2) - F.greatest(start, start2))


# Where requests of a kind lie, and versions that are written in two ways.
REQUEST_KINDS = {"blocks/": "block-summary", "requests/full_summary": "full-summary", "requests/action_review": "action-review", "requests/speaker_batches": "speaker-batch"}
VERSION_NAMES = {"meeting_minutes_vO": "meeting_minutes_v0", "meeting_minutes_map_vO": "meeting_minutes_map_v0"}


def request_kind(path: Column) -> Column:
    """Of a folder below the root of requests."""
    found = F.lit("other")
    for prefix, kind in reversed(REQUEST_KINDS.items()):
        found = F.when(path.startswith(prefix), kind).otherwise(found)
    return found


def heading(c: Column) -> Column:
    """On one line."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def schema_version(c: Column) -> Column:
    """Trimmed, and under its usual name."""
    t = F.btrim(c)
    found = t
    for other, name in VERSION_NAMES.items():
        found = F.when(t == other, name).otherwise(found)
    return found


def kilo_to_mega(c: Column) -> Column:
    return F.round(c / 1024, 3)


def board_error_code(c: Column, fallback: str) -> Column:
    t = F.upper(F.btrim(c))
    return F.when(t != "", t).otherwise(fallback.upper())


def message_tokens(messages: Column, chars_per_token: float, overhead: int) -> Column:
    """Estimated from the length of the messages' compact JSON."""
    return (F.ceil(F.length(F.to_json(messages)) / chars_per_token) + overhead).cast("long")
