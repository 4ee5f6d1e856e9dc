"""Tables exported from code hosts: repository facts and file blobs."""

from pyspark.sql import DataFrame, functions as F

from sourcelode.functions.paths import sanitize_path

def repo_metadata(scans: DataFrame, repos: DataFrame) -> DataFrame:
    """Attach URL, ``owner/repo`` name, branch and commit to scans (keyed by ``repo``).

    ``repos`` has one row per repository; a scan without a branch gets the default branch, an
    unknown commit stays NULL.
    """
    facts = repos.select("repo", "repository_url", "repository_name", "default_branch", "commit_hash")
    return (
        scans.join(facts, "repo", "left")
        .withColumn("branch", F.coalesce("branch", "default_branch"))
        .drop("default_branch")
    )


def _judged(blobs: DataFrame, max_bytes: int | None) -> DataFrame:
    """Blobs with their bytes, safe path and the reason for which they are no text row (NULL: none)."""
    # Hosts wrap base64 in lines.
    packed = F.regexp_replace("blob", r"\s", "")
    raw = blobs.withColumn("_bytes", F.try_to_binary(packed, F.lit("base64"))).withColumn("_path", sanitize_path("file_path"))
    reason = F.when(F.col("_bytes").isNull(), "not base64")
    if max_bytes is not None:
        reason = reason.when(F.length("_bytes") > max_bytes, "too large")
    reason = reason.when(~F.is_valid_utf8(F.col("_bytes").cast("string")), "not text")
    return raw.withColumn("_reason", reason.when(F.col("_path").isNull(), "unsafe path"))


def decode_blobs(blobs: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Base64 blobs -> text rows with safe paths. Binary and unsafe entries, and with ``max_bytes`` larger ones, are
    left out; :func:`skipped_blobs` lists them."""
    kept = _judged(blobs, max_bytes).where(F.col("_reason").isNull())
    return kept.withColumns({"file_path": F.col("_path"), "content": F.col("_bytes").cast("string")}).drop("_bytes", "_path", "_reason", "blob")


def skipped_blobs(blobs: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """The entries that :func:`decode_blobs` leaves out, with the ``reason``."""
    lost = _judged(blobs, max_bytes).where(F.col("_reason").isNotNull())
    return lost.withColumnRenamed("_reason", "reason").drop("_bytes", "_path", "blob")
