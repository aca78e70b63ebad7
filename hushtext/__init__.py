"""De-identification of text columns on Spark."""

from hushtext.functions import normalize_text, tidy_text
from hushtext.operators.redact import redact, redact_rule
from hushtext.operators.report import (
    counts_json,
    counts_total,
    format_report,
    observe_redactions,
    redaction_report,
    redaction_summary,
)
from hushtext.plans.dictionary import build_dictionary
from hushtext.plans.options import Options
from hushtext.plans.rules import RULE_IDS
from hushtext.sources.config import load_options, parse_options
from hushtext.sources.files import read_files, redact_files, redact_to_files
from hushtext.sources.tables import read_table, spread, write_redacted
from hushtext.sources.text_files import write_texts
from hushtext.streaming import redact_file_stream, redact_stream, stream_totals

__all__ = [
    "RULE_IDS",
    "Options",
    "build_dictionary",
    "counts_json",
    "counts_total",
    "format_report",
    "load_options",
    "normalize_text",
    "observe_redactions",
    "parse_options",
    "read_files",
    "read_table",
    "redact",
    "redact_file_stream",
    "redact_files",
    "redact_rule",
    "redact_stream",
    "redact_to_files",
    "redaction_report",
    "redaction_summary",
    "spread",
    "stream_totals",
    "tidy_text",
    "write_redacted",
    "write_texts",
]
