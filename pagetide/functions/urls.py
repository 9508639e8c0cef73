"""Web addresses."""

from __future__ import annotations

import posixpath
from urllib.parse import SplitResult, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DEFAULT_PORTS = {"http": 80, "https": 443}


def normalized(url: str | None) -> str | None:
    """The address in one form, or None unless it is absolute http(s) without credentials.

    Scheme and host in lower case, no default port, no fragment, dots in the path resolved; the query stays as it is.
    """
    if url is None:
        return None
    try:
        parts = urlsplit(url)
        scheme, host, port = parts.scheme.lower(), parts.hostname, parts.port
        credentials = parts.username is not None or parts.password is not None
    except ValueError:
        return None
    if scheme not in DEFAULT_PORTS or not host or credentials:
        return None
    place = f"[{host.lower()}]" if ":" in host else host.lower()
    if port is not None and port != DEFAULT_PORTS[scheme]:
        place += f":{port}"
    return urlunsplit(SplitResult(scheme, place, clean_path(parts.path), parts.query, ""))


def clean_path(path: str) -> str:
    if not path:
        return "/"
    clean = "/" + posixpath.normpath(path).removeprefix("/")
    return clean if clean.endswith("/") or not path.endswith("/") else clean + "/"


def origin(url: str) -> tuple[str, str, int | None]:
    parts = urlsplit(url)
    return parts.scheme, parts.hostname or "", parts.port


def bare_host(url: str) -> str:
    """A host for comparison: international names in ASCII, no www. and no final dot; a domain property counts as its domain."""
    host = url.removeprefix("sc-domain:") if url.startswith("sc-domain:") else urlsplit(url).hostname or ""
    try:
        host = host.encode("idna").decode()
    except UnicodeError:
        pass
    return host.lower().rstrip(".").removeprefix("www.")


def displayable(url: str | None) -> str | None:
    """The address if it can be shown as a link: http(s), a host, no credentials or control characters."""
    if not url or any(ord(c) < 32 or ord(c) == 127 for c in url):
        return None
    return url if normalized(url) is not None else None


@F.pandas_udf(StringType())
def normalize_url(urls: pd.Series) -> pd.Series:
    return urls.map(normalized, na_action="ignore")


@F.pandas_udf(StringType())
def host_of(urls: pd.Series) -> pd.Series:
    return urls.map(bare_host, na_action="ignore")


@F.pandas_udf(StringType())
def external_url(urls: pd.Series) -> pd.Series:
    return urls.map(displayable, na_action="ignore")
