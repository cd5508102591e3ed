"""Addresses as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://(?:([^/?#@]*)@)?([^/?#]*)([^?#]*)(\?[^#]*)?(?:#.*)?$"


def normal_url(url: Column, root_slash: bool = True, keep_query: bool = True) -> Column:
    """Scheme and host in lower case, no fragment, ``/`` for an empty path if ``root_slash``.
    Anything that is no address loses its fragment only."""
    part = lambda k: F.regexp_extract(url, PARTS, k)
    path = F.when((part(4) == "") & F.lit(root_slash), F.lit("/")).otherwise(part(4))
    user = F.when(part(2) != "", F.concat(part(2), F.lit("@"))).otherwise("")
    query = part(5) if keep_query else F.lit("")
    address = F.concat(F.lower(part(1)), F.lit("://"), user, F.lower(part(3)), path, query)
    return F.when(url.rlike(PARTS), address).otherwise(F.regexp_replace(url, r"(?s)#.*$", ""))


def host(url: Column, strip_www: bool = False) -> Column:
    """Lower-case host without user and port; null if there is none."""
    name = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(name, r"^www\.", "") if strip_www else name, F.lit(""))


def host_matches(name: Column, target: Column, subdomains: bool = True) -> Column:
    exact = name == target
    return exact | F.endswith(name, F.concat(F.lit("."), target)) if subdomains else exact
