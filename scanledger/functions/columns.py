"""Column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import GATED


def permits_cloning(url: Column) -> Column:
    """Whether the scheme is https, in any case, after leading control characters and blanks."""
    return F.coalesce(url.rlike(r"(?i)^[\x00-\x20]*https:"), F.lit(False))


def canonical_url(url: Column) -> Column:
    """Without trailing slashes, then without one ``.git``, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(url, "/+$", ""), r"\.git$", ""))


def linkable(url: Column) -> Column:
    """Whether a trimmed URL is http or https and names a host."""
    return F.coalesce(F.trim(url).rlike(r"(?i)^https?://[^/?#\s]+"), F.lit(False))


def server_slug(server: Column) -> Column:
    return F.lower(F.replace(server, F.lit("/"), F.lit("--")))


def finding_id(server: str = "server_id", rule: str = "rule_id", file: str = "file", line: str = "line", evidence: str = "evidence") -> Column:
    """Identity of a finding across commits; evidence is hashed first, so its delimiters can't forge a boundary."""
    place = F.concat_ws(":", F.col(file), F.col(line).cast("string"))
    return F.sha2(F.concat_ws("|", F.col(server), F.col(rule), place, F.sha2(F.encode(F.col(evidence), "UTF-8"), 256)), 256)


def cache_key(arm: Column, rule: Column, language: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", arm, rule, language, F.sha2(F.encode(text, "UTF-8"), 256)), 256)


def draw_hash(seed: int | str, key: Column) -> Column:
    """Rank key of the hashed draw: sha256 of ``seed:key``."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256)


def stamp(ts: Column) -> Column:
    """UTC seconds as text."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def gated(severity: Column) -> Column:
    return severity.isin(GATED)


def verdict(probability: Column, threshold: float = 0.5) -> Column:
    return probability >= threshold
