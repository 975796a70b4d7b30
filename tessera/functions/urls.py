"""URL expressions: parts, glob filters, redaction, safety of literal hosts."""

from __future__ import annotations

import fnmatch
import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tessera.functions.redact import Redaction, redact

#: Hosts that serve instance metadata, and the shared address space.
METADATA_HOSTS = ("169.254.169.254", "metadata.google.internal", "metadata", "instance-data.ec2.internal")
SHARED_SPACE = "100.64.0.0/10"


def part(url: Column, name: str) -> Column:
    """U6."""
    return F.try_parse_url(url, F.lit(name))


def glob_match(path: Column, pattern: str) -> Column:
    """Shell globs, made a regular expression on the driver."""
    translated = fnmatch.translate(pattern)
    return path.rlike("^" + translated.replace(r"\\z", "$").replace(r"\\Z", "$"))


def passes(url: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """by the path alone; exclude wins over include; no patterns pass all."""
    path = F.coalesce(part(url, "PATH"), F.lit(""))
    any_of = lambda patterns: F.exists(F.array(*[glob_match(path, p) for p in patterns]), lambda b: b)
    ok = any_of(include) if include else F.lit(True)
    return ok & ~any_of(exclude) if exclude else ok


def path_include(path: str) -> list[str] | None:
    """A path and all below it."""
    path = path.rstrip("/")
    return [path, f"{path}/*"] if path else None


def is_sitemap(url: Column) -> Column:
    """Whether the last name of the path is a sitemap's."""
    last = F.regexp_extract(F.lower(F.coalesce(part(url, "PATH"), F.lit(""))), r"([^/]*)$", 1)
    return last.rlike(r"^sitemap.*(\.xml|\.xml\.gz|\.txt)$") | (last == "sitemap")


def bare_url(url: Column, config: Redaction = Redaction()) -> Column:
    """Scheme, host, port and path only, then redacted."""
    port = F.regexp_extract(F.coalesce(part(url, "AUTHORITY"), F.lit("")), r":(\d+)$", 1)
    host = F.lower(F.coalesce(part(url, "HOST"), F.lit("")))
    bare = F.concat(part(url, "PROTOCOL"), F.lit("://"), host, F.when(port != "", F.concat(F.lit(":"), port)).otherwise(F.lit("")), F.coalesce(part(url, "PATH"), F.lit("")))
    return redact(bare, config)


@F.pandas_udf(BooleanType())
def _blocked_address(hosts: pd.Series) -> pd.Series:
    """Only for hosts that are IP addresses; a mapped IPv4 address counts as itself."""

    def blocked(host: str | None) -> bool:
        try:
            address = ipaddress.ip_address((host or "").strip("[]"))
        except ValueError:
            return False
        address = getattr(address, "ipv4_mapped", None) or address
        kinds = ("is_private", "is_loopback", "is_link_local", "is_reserved", "is_multicast", "is_unspecified")
        return any(getattr(address, k) for k in kinds) or (address.version == 4 and address in ipaddress.ip_network(SHARED_SPACE))

    return hosts.map(blocked)


def is_safe(url: Column) -> Column:
    """http(s) to a host that is no metadata service, no '.local' name and no internal address. Names aren't resolved."""
    host = F.lower(F.coalesce(part(url, "HOST"), F.lit("")))
    refused = host.isin(*METADATA_HOSTS) | host.endswith(".local") | (host == "") | (host == "localhost")
    return F.coalesce(part(url, "PROTOCOL").isin("http", "https"), F.lit(False)) & ~refused & ~_blocked_address(host)


def web_fetch(payload: Column) -> Column:
    """struct(url, content) of a fetch event: an http(s) URL, and the body held in the JSON-encoded response."""
    url = F.get_json_object(payload, "$.tool_input.url")
    response = F.get_json_object(payload, "$.tool_response")
    inner = F.coalesce(F.get_json_object(response, "$.result"), F.from_json(F.concat(F.lit('{"v":'), response, F.lit("}")), "v string")["v"])
    whole = F.when(response.startswith("{"), F.get_json_object(response, "$.result")).when(response.startswith('"'), inner)
    return F.struct(
        F.when(url.rlike("^https?://"), url).alias("url"), F.when(F.length(F.trim(whole)) > 0, whole).alias("content")
    )
