"""Which addresses may be fetched; nothing is resolved or fetched here."""

from __future__ import annotations

import ipaddress
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def private(ip: ipaddress.IPv4Address | ipaddress.IPv6Address) -> bool:
    """Loopback, private, link-local, multicast, unspecified, and IPv4 from 224 up."""
    if ip.version == 4:
        first = int(ip) >> 24
        return ip.is_loopback or ip.is_unspecified or ip.is_link_local or first >= 224 or any(ip in ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"))
    return ip.is_loopback or ip.is_unspecified or ip.is_multicast or ip in ipaddress.ip_network("fc00::/7") or ip in ipaddress.ip_network("fe80::/10")


def refusal(url: str | None) -> str | None:
    """Why a URL may not be fetched; None for https with a public host."""
    try:
        parts = urlsplit(url or "")
        host = parts.hostname or ""
    except ValueError:
        return "invalid"
    if parts.scheme.lower() != "https":
        return "scheme"
    if not host:
        return "no_host"
    if host == "localhost" or host.endswith(".localhost"):
        return "loopback"
    try:
        return "private" if private(ipaddress.ip_address(host)) else None
    except ValueError:
        return None


def url_refusal(url) -> Column:
    @F.pandas_udf("string")
    def of(c: pd.Series) -> pd.Series:
        return c.map(refusal)

    return of(url)
