"""URLs, repository names and fields cut out of advisory pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskpanel.functions.dates import iso_date
from riskpanel.functions.text import blank_to_null

# --- fixed values: page patterns ---
TITLE_PATTERN = r"(?is)<title>(.*?)</title>"
SECTION_ID_PATTERN = r"\bSECURITY-\d+\b"
SEVERITY_PATTERN = (
    r"(?i)\b(SECURITY-\d+)\b\s+is\s+considered\s+\b(low|medium|high|critical)\b"
)
CALCULATOR_PATTERN = r"(?i)(https?://www\.first\.org/cvss/calculator/[^\"'\s>]+)"
ADVISORY_PATH_PATTERN = r"/security/advisory/(\d{4}-\d{2}-\d{2})/?$"


def strip_query_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def canonical_url(url: Column, bare_host: str, canonical_host: str) -> Column:
    """Trimmed URL on https, with the bare host replaced, without query and fragment."""
    text = strip_query_fragment(F.trim(url))
    secure = F.regexp_replace(text, r"^(?i)http://", "https://")
    schemed = F.when(secure.startswith("//"), F.concat(F.lit("https:"), secure)).otherwise(secure)
    return F.regexp_replace(
        schemed, rf"^https://{bare_host.replace('.', '[.]')}(?=/|$)", f"https://{canonical_host}"
    )


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def date_from_advisory_url(url: Column) -> Column:
    return iso_date(F.regexp_extract(strip_query_fragment(url), ADVISORY_PATH_PATTERN, 1))


def page_title(html: Column) -> Column:
    title = F.regexp_extract(html, TITLE_PATTERN, 1)
    return F.when(
        html.rlike(r"(?is)<title>.*?</title>"), F.trim(F.regexp_replace(title, r"\s+", " "))
    )


def section_severities(html: Column) -> Column:
    """Array of (security_id, label) structs in page order."""
    ids = F.regexp_extract_all(html, F.lit(SEVERITY_PATTERN), 1)
    labels = F.regexp_extract_all(html, F.lit(SEVERITY_PATTERN), 2)
    return F.transform(
        F.arrays_zip(ids.alias("i"), labels.alias("l")),
        lambda p: F.struct(F.upper(p["i"]).alias("security_id"), F.lower(p["l"]).alias("label")),
    )


def security_sections(html: Column) -> Column:
    """Array of (security_id, chunk): each chunk runs from its id to the next id."""
    chunks = F.split(html, r"(?=\bSECURITY-\d+\b)")
    headed = F.filter(chunks, lambda c: c.rlike(r"^SECURITY-\d+\b"))
    return F.transform(
        headed,
        lambda c: F.struct(
            F.regexp_extract(c, r"^(SECURITY-\d+)", 1).alias("security_id"), c.alias("chunk")
        ),
    )


def calculator_url(chunk: Column) -> Column:
    return blank_to_null(F.regexp_extract(chunk, CALCULATOR_PATTERN, 1))


def vector_from_url(url: Column) -> Column:
    """Severity vector held in the fragment of a calculator link."""
    return blank_to_null(F.regexp_extract(url, r"#(CVSS:.*)$", 1))


def vector_version(vector: Column) -> Column:
    return blank_to_null(F.regexp_extract(vector, r"^CVSS:([^/]*)", 1))


def repo_full_name(url: Column, host: str = "github.com") -> Column:
    """``owner/name`` of an http(s) repository URL on exactly this host, else null."""
    pattern = rf"^(?i:https?)://(?i:{host.replace('.', '[.]')})/+([^/?#]+)/+([^/?#]+)"
    owner = F.regexp_extract(url, pattern, 1)
    name = F.regexp_replace(F.regexp_extract(url, pattern, 2), r"\.git$", "")
    return F.when(owner != "", F.concat_ws("/", owner, name))


def linked_repo(url: Column) -> Column:
    """``owner/name`` from a project link; the host may carry a www prefix."""
    pattern = (
        r"(?i)^https?://(?:www\.)?github\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)"
    )
    owner = F.regexp_extract(url, pattern, 1)
    name = F.regexp_replace(F.regexp_extract(url, pattern, 2), r"\.git$", "")
    return F.when((owner != "") & (name != ""), F.concat_ws("/", owner, name))


# --- fixed values: project link names, most reliable first ---
PROJECT_LINK_KEYS = (
    "Source", "source", "Source Code", "source_code", "Repository", "repository", "Code", "code",
    "Homepage", "homepage", "Home", "home",
)


def project_repo(project_urls: Column, home_page: Column) -> Column:
    """First repository among the named links, then any other link, then the home page."""
    named = [linked_repo(F.try_element_at(project_urls, F.lit(k))) for k in PROJECT_LINK_KEYS]
    others = F.filter(
        F.transform(F.map_values(project_urls), linked_repo), lambda x: x.isNotNull()
    )
    return F.coalesce(*named, F.get(others, F.lit(0)), linked_repo(home_page))


def split_repo(full_name: Column) -> tuple[Column, Column]:
    """Owner and name around the first slash; text without a slash gives nulls."""
    parts = F.split(F.trim(full_name), "/", 2)
    owner = F.when(F.size(parts) == 2, blank_to_null(F.get(parts, F.lit(0))))
    name = F.when(F.size(parts) == 2, blank_to_null(F.get(parts, F.lit(1))))
    return owner, name
