"""URLs, e-mail addresses and phone numbers as column expressions: they stay in the JVM and need no Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EMAIL_LIKE, PHONE_LIKE, URL_LIKE

# The patterns of the three kinds.  Letters count in both cases for the first two; \b, \s and \d are Unicode-aware but in the SQL of the queries.
FORMS = {
    "url": r"\b(?:https?://|www\.)[^\s\x22'<>]+",
    "email": r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "phone": r"\b\+?\d[\d\s().-]{6,}\d\b",
}
URL, EMAIL, PHONE = "(?iU)" + FORMS["url"], "(?iU)" + FORMS["email"], "(?U)" + FORMS["phone"]
URL_TAIL = ".,;:)]}\"'><"


def hint_flags(text: Column) -> Column:
    """Bits for what a text may hold."""
    low = F.lower(text)
    url = low.contains("http") | low.contains("www.")
    digits = F.length(F.regexp_replace(text, "[^0-9]", "")) >= 10
    return F.when(url, URL_LIKE).otherwise(0) + F.when(text.contains("@"), EMAIL_LIKE).otherwise(0) + F.when(digits, PHONE_LIKE).otherwise(0)


def asked(flags: Column, bit: int) -> Column:
    """Whether a kind is looked for: its hint is set, or no hint is."""
    hints = flags.bitwiseAND(URL_LIKE | EMAIL_LIKE | PHONE_LIKE)
    return (hints == 0) | (flags.bitwiseAND(bit) != 0)


def _labels_ok(host: Column) -> Column:
    return F.forall(F.split(host, r"\."), lambda x: F.octet_length(x).between(1, 63))


def url_host(url: Column) -> Column:
    """Up to the first slash after the scheme, then up to the first colon."""
    rest = F.regexp_replace(url, "(?i)^https?://", "")
    return F.split_part(F.split_part(rest, F.lit("/"), F.lit(1)), F.lit(":"), F.lit(1))


def normal_url(raw: Column) -> Column:
    """Without trailing punctuation, or null if it is implausible."""
    url = F.rtrim(raw, F.lit(URL_TAIL))
    host = url_host(url)
    ok = F.octet_length(url).between(8, 2048) & host.contains(".") & (F.octet_length(host) <= 253) & _labels_ok(host)
    return F.when(ok, url)


def normal_email(raw: Column) -> Column:
    """Without trailing dots, or null if it is implausible."""
    mail = F.rtrim(raw, F.lit(URL_TAIL))
    local, domain = F.substring_index(mail, "@", 1), F.substring_index(mail, "@", -1)
    ok = F.octet_length(mail).between(6, 254) & F.octet_length(local).between(1, 64) & (F.octet_length(domain) <= 253) & domain.contains(".") & _labels_ok(domain) & domain.rlike("[A-Za-z]")
    return F.when(ok, mail)


def plausible_phone(raw: Column) -> Column:
    """The text as found, or null: 10 to 15 digits, four of them different."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    ok = F.length(digits).between(10, 15) & (F.size(F.array_distinct(F.split(digits, ""))) >= 4)
    return F.when(ok, raw)


def extract(text: Column, kind: str) -> Column:
    """All artefacts of a kind in a text, normalised, in order."""
    pattern, keep = {"url": (URL, normal_url), "email": (EMAIL, normal_email), "phone": (PHONE, plausible_phone)}[kind]
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), keep), lambda x: x.isNotNull())


def url_parts(url: Column) -> dict[str, Column]:
    """scheme, host, port, path, query and fragment; www. counts as http, schemes are told in lower case only."""
    scheme = F.when(url.startswith("https://"), "https").when(url.startswith("http://") | url.startswith("www."), "http")
    rest = F.regexp_replace(url, "^https?://", "")
    fragment = F.when(rest.contains("#"), F.regexp_extract(rest, "(?s)#(.*)$", 1))
    plain = F.split_part(rest, F.lit("#"), F.lit(1))
    query = F.when(plain.contains("?"), F.regexp_extract(plain, r"(?s)\?(.*)$", 1))
    plain = F.split_part(plain, F.lit("?"), F.lit(1))
    authority = F.split_part(plain, F.lit("/"), F.lit(1))
    path = F.when(plain.contains("/"), F.regexp_extract(plain, "(?s)(/.*)$", 1))
    port = F.regexp_extract(authority, ":([0-9]{1,5})$", 1)
    has = (port != "") & (F.coalesce(port.try_cast("int"), F.lit(70000)) <= 65535)
    return {"scheme": scheme, "host": F.when(has, F.regexp_replace(authority, ":[0-9]{1,5}$", "")).otherwise(authority), "port": F.when(has, port.try_cast("int")), "path": path, "query": query, "fragment": fragment}


def email_parts(mail: Column) -> tuple[Column, Column]:
    """(local part, domain), cut at the first at sign."""
    return F.substring_index(mail, "@", 1), F.regexp_extract(mail, "(?s)@(.*)$", 1)
