"""Search by host, port and path over canonical keys."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import is_active
from tidemark.schema import SEARCH_LIMIT


@dataclass(frozen=True)
class Match:
    """A text to be found whole (``exact``) or as a domain with its subdomains, or as the start of a path."""

    text: str
    exact: bool = False


def reversed_host(host: str) -> str:
    return ",".join(reversed(host.strip(".").split(".")))


def key_pattern(host: Match | None = None, port: int | None = None, path: Match | None = None, mode: str = "compat") -> str:
    """The regular expression that keys must hold.

    ``compat`` isn't anchored and takes the path as an expression, so an exact path finds
    all that begin with it, and labels with a hyphen aren't subdomains. ``strict`` is
    anchored, takes texts literally and knows hyphens.
    """
    if mode not in ("compat", "strict"):
        raise ValueError(f"mode is compat or strict, not {mode}")
    strict = mode == "strict"
    literal = re.escape if strict else str
    out = ".*"
    if host:
        out = literal(reversed_host(host.text)) + ("" if host.exact else "(,[a-z0-9-]+)*" if strict else "(,[a-z0-9]+){0,}")
    elif strict:
        out = "[^)]*?"
    if port is not None:
        out += f":{port}"
    elif not out.endswith(".*"):
        out += "(:[0-9]{1,5})?"
    if not out.endswith(".*"):
        out += r"\)"
    if path:
        out += literal(path.text) + ("" if path.exact else ".*")
    elif not out.endswith(".*"):
        out += ".*"
    if strict:
        return f"^{out}" + (r"(\?.*)?$" if path and path.exact else "$")
    return out


def search(
    records: DataFrame, host: Match | None = None, port: int | None = None, path: Match | None = None, limit: int | None = SEARCH_LIMIT,
    mode: str = "compat", active_only: bool = False, key: str = "massaged_url", order: str = "id",
) -> DataFrame:
    """Records whose key holds the pattern, the first ``limit`` of them by id; all of them if that is None.

    Strict mode with a host also asks for the key's beginning, by which Parquet passes over row groups.
    """
    found = records.where(F.col(key).rlike("(?s)" + key_pattern(host, port, path, mode)))
    if mode == "strict" and host:
        found = found.where(F.col(key).startswith(reversed_host(host.text)))
    if active_only:
        found = found.where(is_active(F.col("flags")))
    return found if limit is None else found.orderBy(order).limit(limit)


def search_args(host=None, domain=None, port=None, path=None, exact_path=None) -> dict:
    """Keyword arguments of ``search`` from those of a command line: a host beats a domain, an exact path a path."""
    return {
        "host": Match(host, True) if host is not None else Match(domain) if domain is not None else None,
        "port": port,
        "path": Match(exact_path, True) if exact_path is not None else Match(path) if path is not None else None,
    }


def http_search_args(params: list[tuple[str, str]]) -> dict:
    """The same from the parameters of a request: of ``host`` and ``domain``, and of ``path`` and ``path_exact``, the last holds."""
    out: dict = {"host": None, "port": None, "path": None}
    for name, value in params:
        if name in ("host", "domain"):
            out["host"] = Match(value, name == "host")
        elif name in ("path", "path_exact"):
            out["path"] = Match(value, name == "path_exact")
        elif name == "port":
            out["port"] = int(value) if re.fullmatch("[0-9]+", value) and int(value) < 65536 else 0
    return out


def as_tsv(found: DataFrame) -> DataFrame:
    """type, identifier, uri or "", date, collection."""
    return found.select("type", "identifier", F.coalesce("uri", F.lit("")).alias("uri"), "date", "collection")


def as_json(found: DataFrame) -> DataFrame:
    return found.select("id", F.to_json(F.struct("uri", "identifier", "type", "collection", F.col("date").cast("string").alias("date"))).alias("json"))
