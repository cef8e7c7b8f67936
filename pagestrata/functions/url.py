"""URL functions as Columns."""

from __future__ import annotations

import re
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: path segments, query parameters and hosts that are sensitive
SENSITIVE_STEMS = (
    "login", "signin", "sign-in", "sign_in", "signup", "sign-up", "logout", "auth", "oauth", "account", "billing", "payment", "checkout",
    "password", "passwd", "credentials", "secret", "token", "session", "admin", "settings", "profile",
)
CREDENTIAL_PARAMS = (
    "token", "access_token", "refresh_token", "id_token", "code", "key", "api_key", "apikey", "secret", "client_secret", "signature", "sig",
    "session", "sessionid", "session_id", "sid", "auth", "authorization", "password", "passwd", "pwd", "passphrase", "private_key", "jwt",
)
SENSITIVE_HOSTS = ("accounts.google.com", "mail.google.com", "mail.yahoo.com", "outlook.live.com", "paypal.com")
PAGE_KEYS = ("page", "p", "pg")


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def host(url: Column) -> Column:
    return F.lower(part(url, "HOST"))


def origin(url: Column) -> Column:
    """Scheme, host and a port that is not the scheme's own."""
    scheme, port = F.lower(part(url, "PROTOCOL")), F.regexp_extract(part(url, "AUTHORITY"), r":(\d+)$", 1)
    own = ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80")) | (port == "")
    return F.concat(scheme, F.lit("://"), host(url), F.when(own, F.lit("")).otherwise(F.concat(F.lit(":"), port)))


def params(url: Column) -> Column:
    return F.filter(F.split(F.coalesce(part(url, "QUERY"), F.lit("")), "&"), lambda p: p != "")


def is_sensitive_path(url: Column) -> Column:
    """A path with a sensitive segment; one that cannot be read or decoded is taken for sensitive."""
    path = F.try_url_decode(F.replace(part(url, "PATH"), F.lit("+"), F.lit("%2B")))
    return F.coalesce(F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*map(F.lit, SENSITIVE_STEMS))), F.lit(True))


def is_sensitive_host(url: Column) -> Column:
    """A listed host or one below it."""
    return F.exists(F.array(*map(F.lit, SENSITIVE_HOSTS)), lambda h: (host(url) == h) | host(url).endswith(F.concat(F.lit("."), h)))


def _name(p: Column) -> Column:
    """A parameter's decoded name in lower case; null if it cannot be decoded."""
    return F.lower(F.try_url_decode(F.replace(F.split(p, "=")[0], F.lit("+"), F.lit("%2B"))))


def deny_reason(url: Column) -> Column:
    """Why a url must not be shown: parse, scheme, host or path; null if it may."""
    return (
        F.when(part(url, "PROTOCOL").isNull(), "parse").when(~F.lower(part(url, "PROTOCOL")).isin("http", "https"), "scheme").when(part(url, "HOST").isNull(), "parse").when(is_sensitive_host(url), "host").when(is_sensitive_path(url), "path")
    )


def sanitized(url: Column) -> Column:
    """The url without user, fragment and credential parameters; null if it must not be shown."""
    keep = F.filter(params(url), lambda p: F.coalesce(~_name(p).isin(*CREDENTIAL_PARAMS), F.lit(False)))
    query = F.when(F.size(keep) > 0, F.concat(F.lit("?"), F.array_join(keep, "&"))).otherwise(F.lit(""))
    return F.when(deny_reason(url).isNull(), F.concat(origin(url), F.coalesce(part(url, "PATH"), F.lit("/")), query))


def redacted_params(url: Column) -> Column:
    return F.size(F.filter(params(url), lambda p: F.coalesce(_name(p).isin(*CREDENTIAL_PARAMS), F.lit(True))))


# fixed values: query parameters and path segments that number the pages of a list
_PAGE_PARAM, _PAGE_SEGMENT = r"(?i)^(?:page|p|pg)=\d+$", r"^(.*?/)(?:page|p)/(\d+)(/.*)?$"


def _page_at(url: Column) -> Column:
    """The place, from 0, of the first page parameter among all; -1 if there is none."""
    return F.coalesce(F.array_position(F.transform(params(url), lambda p: p.rlike(_PAGE_PARAM)), True), F.lit(0)).cast("int") - 1


def page_selector(url: Column) -> Column:
    """key=value of the first numeric page parameter, else /page/ and the number of a page path; null if there is neither."""
    at, seg = _page_at(url), F.regexp_extract(part(url, "PATH"), _PAGE_SEGMENT, 2)
    return F.when(at >= 0, F.lower(F.get(params(url), at))).when(seg != "", F.concat(F.lit("/page/"), seg))


def page_path(url: Column) -> Column:
    """The path that all pages of one paginated list share: without the first page parameter, else without the page segment."""
    at, path = _page_at(url), F.coalesce(F.nullif(part(url, "PATH"), F.lit("")), F.lit("/"))
    kept = F.filter(params(url), lambda p, i: i != at)
    by_query = F.concat(path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    cut = F.regexp_replace(F.regexp_replace(path, _PAGE_SEGMENT, "$1$3"), r"/{2,}", "/")
    return F.when(at >= 0, by_query).otherwise(F.regexp_replace(cut, r"(.)/$", "$1"))


def snapshot_group(url: Column, title: Column) -> Column:
    """What snapshots of one page have in common: trailing numbers and page parameters do not count."""
    path = F.regexp_replace(F.regexp_replace(F.coalesce(part(url, "PATH"), F.lit("")), r"/{2,}", "/"), r"(?:/\d+)*/?$", "")
    rest = F.array_sort(F.filter(params(url), lambda p: ~F.lower(p).rlike(r"^(?:page|p|pg)=\d+$")))
    key = F.concat_ws("|", origin(url), path, F.array_join(rest, "&"), F.coalesce(title, F.lit("")))
    return F.when(part(url, "HOST").isNotNull(), key).otherwise(F.concat_ws("|", F.lit("raw"), url, F.coalesce(title, F.lit(""))))


def safe(url: str) -> str | None:
    """``sanitized`` for one url within a task."""
    try:
        u = urlsplit(url)
        name, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return None
    if u.scheme.lower() not in ("http", "https") or not name or any(name == h or name.endswith(f".{h}") for h in SENSITIVE_HOSTS):
        return None
    if re.search(r"%(?![0-9A-Fa-f]{2})", u.path) or not set(SENSITIVE_STEMS).isdisjoint(unquote(u.path).lower().split("/")):
        return None
    kept = [p for p in u.query.split("&") if p and not re.search(r"%(?![0-9A-Fa-f]{2})", p.split("=")[0]) and unquote(p.split("=")[0]).lower() not in CREDENTIAL_PARAMS]
    own = f":{port}" if port and (u.scheme.lower(), port) not in (("http", 80), ("https", 443)) else ""
    return f"{u.scheme.lower()}://{name}{own}{u.path}" + (f"?{'&'.join(kept)}" if kept else "")
