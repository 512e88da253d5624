"""Outgoing files: quarantine by extension, and a scan of text-like content."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textwarden.fixed_values import EXTERNAL_TIERS, RESTRICTED_EXTENSIONS, TEXT_EXTENSIONS
from textwarden.functions.destination import root_domain, tier_of, tier_score
from textwarden.functions.text import quote
from textwarden.operators.scan import scan
from textwarden.options import DEFAULTS, ScanOptions


def _in(values: list[str]) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


def with_extension(files: DataFrame) -> DataFrame:
    """Files (path, length, content, host[, mime]) with their name, extension and tier."""
    return (files
            .withColumn("name", F.element_at(F.split("path", "/"), -1))
            .withColumn("ext", F.regexp_extract(F.lower("name"), r"\.[^.]*$", 0))
            .withColumn("_root", F.expr(root_domain("host")))
            .withColumn("tier", F.expr(tier_of("host", "_root"))).drop("_root"))


def quarantined(files: DataFrame, options: ScanOptions = DEFAULTS) -> DataFrame:
    """Restricted file types on their way out: blocked whatever they hold."""
    if not options.quarantine_files:
        return with_extension(files).filter("false").select("path")
    return (with_extension(files)
            .filter(f"ext IN {_in(RESTRICTED_EXTENSIONS)} AND tier IN {_in(EXTERNAL_TIERS)}")
            .selectExpr(
                "path", "name", "length AS text_length", "tier",
                "array('CREDENTIAL') AS categories",
                "array('FILE_TRANSFER', 'KEY_FILE', 'CREDENTIAL') AS detected_tags",
                f"named_struct('s', 100, 'd', {tier_score('tier')}, 'v', 80, 'a', 85, 'c', 100) AS factors",
                "100 AS risk_score", "'BLOCK' AS final_decision",
                "concat('High-risk file extension (', ext, ') blocked from external upload.') AS reason"))


def text_like(files: DataFrame, options: ScanOptions = DEFAULTS) -> DataFrame:
    """Text-like files on their way out that are to be scanned."""
    named = with_extension(files)
    mime = "OR coalesce(mime, '') LIKE 'text/%'" if "mime" in files.columns else ""
    wanted = named.filter(
        f"(ext IN {_in(TEXT_EXTENSIONS)} {mime}) AND length > 0 AND tier IN {_in(EXTERNAL_TIERS)}")
    if options.quarantine_files:
        wanted = wanted.filter(f"ext NOT IN {_in(RESTRICTED_EXTENSIONS)}")
    return wanted


def text_files(files: DataFrame, options: ScanOptions = DEFAULTS) -> DataFrame:
    """Text-like files on their way out, with their whole content as text.

    Bytes that are not valid UTF-8 become replacement characters, so no file ends the job.
    Large files are better read in pieces (``large_files``).
    """
    return text_like(files, options).selectExpr(
        "path", "name", "host", "'file_upload' AS action_type",
        "make_valid_utf8(cast(content AS string)) AS text")


def scan_files(files: DataFrame, options: ScanOptions = DEFAULTS) -> DataFrame:
    """Verdicts on text-like files; silent ones (ALLOW) are left out."""
    return scan(text_files(files, options), options=options).filter("final_decision IN ('BLOCK', 'WARN')")


def scan_typed(payloads: DataFrame, options: ScanOptions = DEFAULTS) -> DataFrame:
    """Typed messages: at least 8 characters, external destination, and a verdict worth showing."""
    from textwarden.functions.text import trimmed, utf16_length

    # the tier needs only the host, so text for internal hosts is never scanned
    tier = tier_of("host", f"({root_domain('host')})", options.approved_ai_domains, options.restricted_destinations)
    typed = (payloads.withColumn("action_type", F.lit("keystroke_typing"))
             .filter(f"({utf16_length(trimmed('text'))}) >= 8").filter(f"({tier}) <> 'INTERNAL'"))
    judged = scan(typed, options=options)
    return judged.filter("tier <> 'INTERNAL' AND (final_decision = 'BLOCK' "
                         "OR (final_decision = 'WARN' AND risk_score >= 70))")
