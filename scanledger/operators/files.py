"""Which files are scanned, which are skipped and why, and what admits a server."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffixes, folders and name parts that decide about a file.
SUFFIXES = [".py", ".ts", ".js", ".tsx", ".jsx", ".json", ".md"]
SKIP_FOLDERS = [".git", "node_modules", ".venv", "venv", "dist", "build", "__pycache__"]
NOT_RUN_FOLDERS = ["test", "tests", "__tests__", "spec", "specs", "example", "examples", "sample", "samples", "demo", "demos", "script", "scripts", "benchmark", "benchmarks", "e2e", "fixture", "fixtures", ".erb"]
NOT_RUN_PARTS = ["test", "spec", "config", "bench", "e2e"]
MOST_BYTES = 1024 * 1024
LANGUAGES = {".py": "python", ".ts": "typescript", ".js": "typescript", ".tsx": "tsx", ".jsx": "tsx"}
EVIDENCE_SUFFIXES = [".py", ".ts", ".js", ".jsx", ".tsx", ".mjs", ".cjs", ".json"]
SERVER_MARKERS = r"@modelcontextprotocol/sdk/server|@modelcontextprotocol/server|from\s+mcp\.server|import\s+mcp\.server|\bFastMCP\s*\(|\bMCPServer\s*\(|new\s+McpServer\s*\("


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix_of(path: Column) -> Column:
    """The last dot and what follows, in lower case; none where the name's only dot comes first."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.].*?(\.[^.]*)$|^[^.]+(\.[^.]*)$", 1))


def folders_of(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def inner_parts(path: Column) -> Column:
    """Parts between dots of the name without its first and last; a leading dot's first part is no suffix."""
    parts = F.split(F.regexp_replace(file_name(path), r"^\.", ""), r"\.")
    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), F.lower)


def any_of(parts: Column, values: list[str]) -> Column:
    return F.arrays_overlap(parts, F.array(*[F.lit(x) for x in values]))


def scannable(path: Column) -> Column:
    folders = folders_of(path)
    return suffix_of(path).isin(SUFFIXES) & ~any_of(folders, SKIP_FOLDERS) & ~any_of(F.transform(folders, F.lower), NOT_RUN_FOLDERS) & ~any_of(inner_parts(path), NOT_RUN_PARTS)


def scannable_files(files: DataFrame) -> DataFrame:
    return files.where(scannable(F.col("path")))


def skip_reason(is_text: Column) -> Column:
    """Why a file within the scan's reach is skipped, or null."""
    return F.when(F.col("is_symlink"), "symlink").when(F.col("size") > MOST_BYTES, "too-large").when(~is_text, "undecodable")


def skipped_files(files: DataFrame) -> DataFrame:
    """server_id, path, reason; files out of reach are no skips."""
    is_text = F.col("is_text") if "is_text" in files.columns else F.is_valid_utf8("content")
    return scannable_files(files).select("server_id", "path", skip_reason(is_text).alias("reason")).where("reason is not null")


def decoded(files: DataFrame) -> DataFrame:
    """Files to scan with their source, a leading byte order mark dropped."""
    source = F.decode("content", "UTF-8") if "content" in files.columns else F.col("source")
    is_text = F.col("is_text") if "is_text" in files.columns else F.is_valid_utf8("content")
    keep = scannable_files(files).where(skip_reason(is_text).isNull())
    return keep.withColumn("source", F.regexp_replace(source, "^\ufeff", ""))


def language_of(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, suffix_of(path)), F.lit("other"))


def safe_path(raw: Column) -> Column:
    """Bytes of a path as text, what is not UTF-8 replaced."""
    return F.make_valid_utf8(raw.cast("string"))


def server_evidence(files: DataFrame, source: str = "source") -> DataFrame:
    """Per server the first file, by path components, that names a server marker, with the leftmost match."""
    reach = files.where(suffix_of(F.col("path")).isin(EVIDENCE_SUFFIXES) & ~any_of(folders_of(F.col("path")), SKIP_FOLDERS) & ~F.col("is_symlink") & (F.col("size") <= MOST_BYTES))
    found = reach.select("server_id", "path", F.regexp_extract(source, SERVER_MARKERS, 0).alias("marker")).where("marker <> ''")
    first = found.groupBy("server_id").agg(F.min_by(F.struct("marker", "path"), F.split("path", "/")).alias("e"))
    return first.select("server_id", "e.marker", "e.path")


def admit(outcomes: DataFrame, evidence: DataFrame) -> DataFrame:
    """server_id, admitted, note for outcomes (server_id, discovered_via, status)."""
    joined = outcomes.join(evidence, "server_id", "left")
    registry, found, failed = F.col("discovered_via") == "registry", F.col("marker").isNotNull(), F.col("status") == "failed"
    note = F.when(failed | registry, F.lit(None)).when(found, F.concat_ws(" in ", "marker", "path")).otherwise("no server SDK import found")
    return joined.select("server_id", (~failed & (registry | found)).alias("admitted"), note.alias("note"))


def scan_status_counts(outcomes: DataFrame) -> DataFrame:
    scanned, failed = F.count_if(F.col("status") == "scanned"), F.count_if(F.col("status") == "failed")
    return outcomes.agg(scanned.alias("scanned"), failed.alias("failed"), (F.count("*") - scanned - failed).alias("skipped"))
