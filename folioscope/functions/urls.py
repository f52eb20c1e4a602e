"""Approved project links and repository names found in text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------
LINK_IN_TEXT = r"(?iU)https://[^\s<>\"']+"
TRAILING = r"[.,;:!?)\]}]+$"
EXACT_HOSTS = ["github.com", "gitlab.com", "huggingface.co", "codeberg.org"]
HOST_SUFFIXES = [".github.io", ".gitlab.io"]
LINKS_PER_TEXT = 3
LINK_LENGTH = 2_048
# scheme, authority, path, query, fragment
URL_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
# -------------------------------------------------------------------------------------------


def _part(url: Column, index: int) -> Column:
    return F.regexp_extract(url, URL_PARTS, index)


def path_parts(url: Column) -> Column:
    return F.filter(F.split(_part(url, 3), "/"), lambda p: p != "")


def approved_url(
    url: Column,
    hosts: Sequence[str] = EXACT_HOSTS,
    suffixes: Sequence[str] = HOST_SUFFIXES,
) -> Column:
    """The link without its fragment when it is an allowed project page, else NULL."""
    authority = F.lower(_part(url, 2))
    host = F.regexp_extract(authority, r"^([^:@]+)(?::\d*)?$", 1)
    port = F.regexp_extract(authority, r":(\d*)$", 1)
    exact = host.isin(list(hosts))
    suffix = F.lit(False)
    for ending in suffixes:
        suffix = suffix | host.endswith(ending)
    query = _part(url, 4)
    rebuilt = F.concat(
        F.lit("https://"), authority, _part(url, 3), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")
    )
    return F.when(
        (F.length(url) <= LINK_LENGTH)
        & (F.lower(_part(url, 1)) == "https")
        & (host != "")
        & (port.isin("", "443"))
        & (_part(url, 3) != "")
        & (exact | suffix)
        & (~exact | (F.size(path_parts(url)) >= 2)),
        rebuilt,
    )


def project_urls(
    text: Column,
    hosts: Sequence[str] = EXACT_HOSTS,
    suffixes: Sequence[str] = HOST_SUFFIXES,
    most: int = LINKS_PER_TEXT,
) -> Column:
    """The first approved project links of a text, in text order."""
    found = F.transform(
        F.regexp_extract_all(text, F.lit(LINK_IN_TEXT), F.lit(0)),
        lambda u: approved_url(F.regexp_replace(u, TRAILING, ""), hosts, suffixes),
    )
    return F.slice(F.array_distinct(F.filter(found, lambda u: u.isNotNull())), 1, most)


def repository_of(url: Column, host: str = "github.com") -> Column:
    """``owner/name`` of a link to one repository, else NULL."""
    parts = path_parts(url)
    name = F.regexp_replace(F.get(parts, F.lit(1)), r"\.git$", "")
    return F.when(
        (_part(url, 1) == "https")
        & (F.regexp_extract(F.lower(_part(url, 2)), r"^(?:[^@]*@)?([^:]+)", 1) == host)
        & (F.size(parts) == 2)
        & (name != ""),
        F.concat_ws("/", F.get(parts, F.lit(0)), name),
    )
