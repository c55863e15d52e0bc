"""Canonical keys of URLs: reversed host, port, path and sorted query."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import parse_qsl, quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
_IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
#: URLs that columns alone can handle: the others need a full URL parser.
_SIMPLE = (
    r"^(?i:(https?))://(?:[A-Za-z0-9._~-]+(?::[A-Za-z0-9._~-]*)?@)?"
    r"([A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*\.?)(?::([0-9]{0,5}))?"
    r"((?:/[A-Za-z0-9_.~!$&'()*+,;=:@%/-]*)?)"
    r"(?:\?((?:[A-Za-z0-9_.~=&+*!(),;:@/-]|%[0-7][0-9A-Fa-f])*))?(?:#[\x21-\x7E]*)?$"
)
#: Of these, URLs whose host is certain to be a name: the last label begins with a letter, and the port has four digits at most.
_SURE = _SIMPLE.replace(r"([A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*\.?)", r"((?:[A-Za-z0-9_-]+\.)*[A-Za-z][A-Za-z0-9_-]*\.?)").replace("{0,5}", "{0,4}")
_DOTS = r"(?i)/(?:\.|%2e){1,2}(?:/|$)"


def domain_reverse(host: Column) -> Column:
    """``a.example.com`` as ``com,example,a``; outer dots don't count."""
    return F.array_join(F.reverse(F.split(F.trim(host, F.lit(".")), r"\.")), ",")


def default_port(scheme: Column) -> Column:
    return F.when(scheme == "http", 80).when(scheme == "https", 443)


def encode_value(text: Column) -> Column:
    """Percent-encoding of all but letters, digits and ``-_.~``."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def sorted_pairs(query: Column) -> Column:
    """``k=v`` pairs of a query, keys decoded, values encoded anew, in order of key, then value."""
    part = lambda p, k: F.url_decode(F.regexp_extract(p, r"^([^=]*)=?(.*)$", k))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(part(p, 1).alias("k"), encode_value(part(p, 2)).alias("v")))
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _native(url: Column) -> Column:
    """The key of a URL that columns alone can handle, null for others; the long expression is matched once."""
    marked = F.regexp_replace(url, _SIMPLE, "$1\u0001$2\u0001$3\u0001$4\u0001$5")

    def key(p: Column) -> Column:
        return _let(F.lower(F.get(p, F.lit(1))), lambda host: _let(F.nullif(F.get(p, F.lit(2)), F.lit("")).cast("int"), lambda port: F.when(fits(host, port), shown(p, host, port))))

    def fits(host: Column, port: Column) -> Column:
        numeric = host.rlike(r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)\.?$") & ~host.rlike(_IPV4)
        return ~numeric & ~host.rlike(r"(?:^|\.)xn--") & (F.coalesce(port, F.lit(0)) <= 65535)

    def shown(p: Column, host: Column, port: Column) -> Column:
        own = port.isNull() | (port == default_port(F.lower(F.get(p, F.lit(0)))))
        path, pairs = F.get(p, F.lit(3)), sorted_pairs(F.get(p, F.lit(4)))
        return F.concat(
            F.when(host.rlike(_IPV4), host).otherwise(domain_reverse(host)), F.when(own, "").otherwise(F.concat(F.lit(":"), port.cast("string"))), F.lit(")"),
            F.when(path == "", "/").otherwise(path), F.when(pairs == "", "").otherwise(F.concat(F.lit("?"), pairs)),
        )

    plain = ~url.contains("\u0001") & ~url.rlike(_DOTS)
    return F.when(plain, _let(F.split(marked, "\u0001", -1), lambda p: F.when(F.size(p) == 5, key(p))))


def massage_url(url: Column, odd: bool = True) -> Column:
    """The canonical key: reversed host, ``:port`` unless it is the scheme's own, ``)``, path, ``?`` and sorted pairs.

    Scheme, user and fragment aren't part of it. Null or unparsable: "". Plain URLs are
    handled by columns; with ``odd`` the rest (other schemes, IPv6, dot segments,
    international hosts, characters to be encoded) is sent to a URL parser in Python,
    without it they give "". Only those rows carry their text there.
    """
    native = _native(url)
    if not odd:
        return F.coalesce(native, F.lit(""))
    sure = url.rlike(_SURE) & ~url.rlike(_DOTS) & ~url.rlike("(?i)xn--")
    return F.coalesce(F.when(sure, native), _parsed(F.when(~sure, url)), F.lit(""))


@F.pandas_udf(StringType())
def _parsed(urls: pd.Series) -> pd.Series:
    return urls.map(lambda u: None if u is None else key_of(u))


def _number(text: str) -> int:
    if text[:2].lower() == "0x":
        return int(text[2:] or "0", 16)
    return int(text, 8) if len(text) > 1 and text[0] == "0" else int(text)


def _host(raw: str, special: bool) -> tuple[str, bool]:
    """The host as a URL shows it, and whether it is a domain."""
    if raw.startswith("["):
        if not raw.endswith("]"):
            raise ValueError(raw)
        return f"[{ipaddress.IPv6Address(raw[1:-1]).compressed}]", False
    if not special:
        if re.search(r"[\x00 #/<>?@\[\\\]^|]", raw):
            raise ValueError(raw)
        return quote(raw, safe="!$%&'()*+,-.:;=_~"), False
    from urllib.parse import unquote

    host = unquote(raw, errors="strict").lower()
    if not host.isascii():
        host = ".".join(part.encode("idna").decode() if part else "" for part in re.split("[.\u3002\uff0e\uff61]", host))
    if not host or re.search(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]", host):
        raise ValueError(raw)
    parts = host[:-1].split(".") if host.endswith(".") else host.split(".")
    if re.fullmatch(r"[0-9]+|0x[0-9a-f]*", parts[-1]):
        if len(parts) > 4:
            raise ValueError(raw)
        numbers = [_number(p) for p in parts]
        if any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
            raise ValueError(raw)
        return str(ipaddress.IPv4Address(sum(n << 8 * (3 - k) for k, n in enumerate(numbers[:-1])) + numbers[-1])), False
    return host, True


def _path(raw: str, special: bool) -> str:
    out: list[str] = []
    parts = re.split(r"[/\\]" if special else "/", raw)[1:] if raw[:1] in ("/", "\\") else re.split("/", raw)
    for k, part in enumerate(parts):
        last, plain = k == len(parts) - 1, part.lower().replace("%2e", ".")
        if plain == "..":
            del out[-1:]
        if plain in (".", ".."):
            if last:
                out.append("")
        else:
            out.append(quote(part, safe="!$%&'()*+,-./:;=@_~[]|^\\"))
    return "/" + "/".join(out)


def key_of(url: str) -> str:
    """``massage_url`` of one URL, by the rules that browsers follow."""
    try:
        text = re.sub("[\t\n\r]", "", url.strip("".join(map(chr, range(33)))))
        found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", text)
        if not found:
            return ""
        scheme, rest = found[1].lower(), text[found.end() :].partition("#")[0]
        special = scheme in _PORTS
        rest, asked, query = rest.partition("?")
        host, port = "", ""
        if special and scheme != "file":
            rest = "//" + re.sub(r"^[/\\]*", "", rest)
        if rest.startswith("//"):
            place = re.match(r"[^/\\]*" if special else "[^/]*", rest[2:])[0]
            path = rest[2 + len(place) :]
            place = place.rpartition("@")[2]
            split = re.fullmatch(r"(\[.*\]|[^:]*)(?::([0-9]*))?", place)
            if not split:
                return ""
            if split[1] or (special and scheme != "file"):
                host, domain = _host(split[1], special)
                if domain:
                    host = ",".join(reversed(host.strip(".").split(".")))
            if split[2]:
                if int(split[2]) > 65535:
                    return ""
                port = "" if int(split[2]) == _PORTS.get(scheme, -1) else f":{int(split[2])}"
            path = _path(path, special) if path or special else ""
        else:
            path = _path(rest, special) if rest.startswith("/") or special else quote(rest, safe="!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ ")
        pairs = sorted((k, quote(v, safe="-_.~")) for k, v in parse_qsl(query, keep_blank_values=True, errors="replace", max_num_fields=None)) if asked else []
        return f"{host}{port}){path}" + ("?" + "&".join(f"{k}={v}" for k, v in pairs) if pairs else "")
    except (ValueError, UnicodeError):
        return ""
