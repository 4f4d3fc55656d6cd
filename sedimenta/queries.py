"""Registered queries: each operator over the supplied tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

import hashlib
import os
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import samples
from .config import EngineConfig
from .functions import artefacts as A
from .functions import naming as N
from .operators import browser, carve, limits, scan, sqlite_pages
from .sources import evidence, ewf, sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


DEMO = [("demo", "nn", b"nn"), ("demo", "th", b"Th"), ("demo", "hah", b"hah"), ("demo", "a_umlaut", "ä".encode())]


def document_chunks(spark, sf, chunk=4096, overlap=16):
    return evidence.chunks_of_column(table(spark, sf, "documents"), "doc_id", "encode(text, 'UTF-8')", chunk, overlap)


# artefacts

#: The forms as SQL text.
EXTRACT = {k: ("" if k == "phone" else "(?i)") + v.replace("'", "''") for k, v in A.FORMS.items()}
URL_OK = "octet_length(encode(u)) BETWEEN 8 AND 2048 AND contains(host, '.') AND octet_length(encode(host)) <= 253 AND len(list_filter(string_split(host, '.'), lambda x: octet_length(encode(x)) NOT BETWEEN 1 AND 63)) = 0"
URLS_SQL = rf"""
WITH t AS (SELECT page_id, html AS x FROM pages UNION ALL SELECT page_id, url FROM pages),
m AS (SELECT page_id, unnest(regexp_extract_all(x, '{EXTRACT["url"]}')) AS raw FROM t),
u AS (SELECT page_id, rtrim(raw, '.,;:)]}}"''><') AS u FROM m),
h AS (SELECT page_id, u, split_part(split_part(regexp_replace(u, '(?i)^https?://', ''), '/', 1), ':', 1) AS host FROM u)
SELECT page_id, u AS url FROM h WHERE {URL_OK}
"""


@query(URLS_SQL)
def artefact_urls(spark, sf):
    """URLs of pages and their addresses."""
    pages = table(spark, sf, "pages")
    text = pages.select("page_id", F.explode(F.array("html", "url")).alias("x"))
    return text.select("page_id", F.explode(A.extract(F.col("x"), "url")).alias("url"))


MAILS_SQL = rf"""
WITH t AS (SELECT 'document' AS origin, doc_id AS id, text AS x FROM documents UNION ALL SELECT 'page', page_id, html FROM pages),
m AS (SELECT origin, id, rtrim(unnest(regexp_extract_all(x, '{EXTRACT["email"]}')), '.,;:)]}}"''><') AS mail FROM t),
p AS (SELECT *, split_part(mail, '@', 1) AS local, split_part(mail, '@', -1) AS domain FROM m)
SELECT origin, id, mail AS email, local, domain FROM p
WHERE strlen(mail) BETWEEN 6 AND 254 AND strlen(local) BETWEEN 1 AND 64 AND strlen(domain) <= 253 AND contains(domain, '.') AND regexp_matches(domain, '[A-Za-z]')
"""


@query(MAILS_SQL)
def artefact_emails(spark, sf):
    """Addresses of documents and pages, with their parts."""
    docs = table(spark, sf, "documents").select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), F.col("text").alias("x"))
    text = docs.unionByName(table(spark, sf, "pages").select(F.lit("page").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("x")))
    local, domain = A.email_parts(F.col("email"))
    return text.where(F.col("x").contains("@")).select("origin", "id", F.explode(A.extract(F.col("x"), "email")).alias("email")).withColumn("local", local).withColumn("domain", domain)


PHONES_SQL = rf"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{EXTRACT["phone"]}')) AS phone FROM documents),
d AS (SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS digits FROM m)
SELECT doc_id, phone FROM d WHERE length(digits) BETWEEN 10 AND 15 AND len(list_distinct(regexp_extract_all(digits, '.'))) >= 4
"""


@query(PHONES_SQL)
def artefact_phones(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(A.extract(F.col("text"), "phone")).alias("phone"))


@query(rf"""
SELECT page_id, url, CASE WHEN starts_with(url, 'https://') THEN 'https' WHEN starts_with(url, 'http://') OR starts_with(url, 'www.') THEN 'http' END AS scheme,
    regexp_replace(split_part(split_part(split_part(regexp_replace(url, '^https?://', ''), '#', 1), '?', 1), '/', 1), ':[0-9]{1,5}$', '') AS host,
    try_cast(nullif(regexp_extract(split_part(split_part(split_part(regexp_replace(url, '^https?://', ''), '#', 1), '?', 1), '/', 1), ':([0-9]{1,5})$', 1), '') AS INTEGER) AS port,
    nullif(regexp_extract(split_part(split_part(regexp_replace(url, '^https?://', ''), '#', 1), '?', 1), '/.*$'), '') AS path,
    CASE WHEN contains(split_part(url, '#', 1), '?') THEN regexp_extract(split_part(url, '#', 1), '\?(.*)$', 1) END AS query,
    CASE WHEN contains(url, '#') THEN regexp_extract(url, '#(.*)$', 1) END AS fragment
FROM pages
""")
def url_components(spark, sf):
    parts = A.url_parts(F.col("url"))
    return table(spark, sf, "pages").select("page_id", "url", *(parts[k].alias(k) for k in ("scheme", "host", "port", "path", "query", "fragment")))


@query("""
SELECT doc_id, (CASE WHEN contains(lower(text), 'http') OR contains(lower(text), 'www.') THEN 16 ELSE 0 END + CASE WHEN contains(text, '@') THEN 32 ELSE 0 END
    + CASE WHEN length(regexp_replace(text, '[^0-9]', '', 'g')) >= 10 THEN 64 ELSE 0 END)::INTEGER AS flags FROM documents
""")
def hint_flags(spark, sf):
    return table(spark, sf, "documents").select("doc_id", A.hint_flags(F.col("text")).alias("flags"))


@query(f"""
WITH f AS (SELECT doc_id, text, (contains(lower(text), 'http') OR contains(lower(text), 'www.')) AS u, contains(text, '@') AS e, length(regexp_replace(text, '[^0-9]', '', 'g')) >= 10 AS p FROM documents),
n AS (SELECT doc_id, len(regexp_extract_all(text, '{EXTRACT["email"]}')) AS n FROM f WHERE e OR NOT (u OR e OR p))
SELECT doc_id, n::BIGINT AS n_emails FROM n WHERE n > 0
""")
def hinted_emails(spark, sf):
    """Only texts whose hints ask for e-mail, or that have no hint, are searched."""
    docs = table(spark, sf, "documents").where(A.asked(A.hint_flags(F.col("text")), A.EMAIL_LIKE))
    return docs.select("doc_id", F.size(A.extract(F.col("text"), "email")).cast("long").alias("n_emails")).where("n_emails > 0")


@query(f"SELECT domain, count(*) AS n, count(DISTINCT email) AS n_distinct FROM ({MAILS_SQL}) GROUP BY domain ORDER BY n DESC, domain LIMIT 20")
def email_domains(spark, sf):
    out = artefact_emails(spark, sf).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("email").alias("n_distinct"))
    return out.orderBy(F.desc("n"), "domain").limit(20)


@query(f"SELECT phone, count(*) AS n FROM ({PHONES_SQL}) GROUP BY phone")
def phone_frequency(spark, sf):
    return artefact_phones(spark, sf).groupBy("phone").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT page_id, url FROM ({URLS_SQL}) WHERE contains(url, 'utm_source')")
def urls_with_tracking(spark, sf):
    return artefact_urls(spark, sf).where(F.col("url").contains("utm_source"))


# chunks, hits and hashes


@query("""
WITH d AS (SELECT doc_id, strlen(text)::BIGINT AS total FROM documents), c AS (SELECT doc_id, total, unnest(range(0, (total + 1023) // 1024)) AS chunk_id FROM d)
SELECT doc_id, chunk_id, chunk_id * 1024 AS start, least(total - chunk_id * 1024, 1088) AS length, least(total - chunk_id * 1024, 1024) AS valid_length FROM c
""")
def chunk_plan(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("long").alias("total"))
    return evidence.plan_chunks(docs, 1024, 64).drop("total")


HITS_SQL = """
WITH p AS (SELECT * FROM (VALUES ('nn'), ('Th'), ('hah'), ('ä')) v(pattern)),
s AS (SELECT doc_id, pattern, string_split(text, pattern) AS parts FROM documents, p),
l AS (SELECT doc_id, pattern, unnest(parts) AS part, generate_subscripts(parts, 1) AS i, len(parts) AS n FROM s),
o AS (SELECT doc_id, pattern, i, n, sum(strlen(part)) OVER (PARTITION BY doc_id, pattern ORDER BY i) + (i - 1) * strlen(pattern) AS place FROM l)
SELECT doc_id, CASE pattern WHEN 'Th' THEN 'th' WHEN 'ä' THEN 'a_umlaut' ELSE pattern END AS pattern_id, place::BIGINT AS global_offset FROM o WHERE i < n AND pattern NOT IN ('nn', 'hah')
"""


@query(HITS_SQL)
def signature_hits(spark, sf):
    """Places of patterns that do not overlap themselves, from overlapping chunks: each place once."""
    hits = scan.find_hits(document_chunks(spark, sf), [x for x in DEMO if x[1] in ("th", "a_umlaut")])
    return hits.select(F.col("evidence").cast("long").alias("doc_id"), "pattern_id", "global_offset")


@query("""
WITH r AS (SELECT 'nn' AS pattern_id, sum(list_sum(list_transform(regexp_extract_all(text, 'n{2,}'), lambda x: length(x) - 1))) AS n FROM documents
UNION ALL SELECT 'hah', sum(list_sum(list_transform(regexp_extract_all(text, 'h(?:ah)+'), lambda x: (length(x) - 1) // 2))) FROM documents
UNION ALL SELECT 'th', sum(len(string_split(text, 'Th')) - 1) FROM documents UNION ALL SELECT 'a_umlaut', sum(len(string_split(text, 'ä')) - 1) FROM documents)
SELECT pattern_id, n::BIGINT AS n FROM r WHERE n > 0
""")
def signature_hits_overlapping(spark, sf):
    """Overlapping matches are all kept."""
    return scan.find_hits(document_chunks(spark, sf), DEMO).groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, strlen(text)::BIGINT AS size, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def hash_inventory(spark, sf):
    data = F.encode("text", "UTF-8")
    return table(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"), F.md5(data).alias("md5"), F.sha2(data, 256).alias("sha256"))


HEADERS = [*EngineConfig().patterns(), ("markup", "paragraph", b"<p"), ("markup", "heading", b"<h1>")]
HEADERS_SQL = ", ".join(f"('{kind}', '{name}', '{header.decode()}')" for kind, name, header in HEADERS if header.isascii() and header.decode().isprintable() and b"'" not in header)


@query(f"""
WITH p AS (SELECT * FROM (VALUES {HEADERS_SQL}) v(file_type, pattern_id, pattern)),
s AS (SELECT page_id, file_type, pattern_id, pattern, string_split(html, pattern) AS parts FROM pages, p),
l AS (SELECT page_id, file_type, pattern_id, pattern, unnest(parts) AS part, generate_subscripts(parts, 1) AS i, len(parts) AS n FROM s),
o AS (SELECT *, sum(strlen(part)) OVER (PARTITION BY page_id, file_type, pattern_id ORDER BY i) + (i - 1) * strlen(pattern) AS place FROM l)
SELECT page_id, file_type, pattern_id, place::BIGINT AS global_offset FROM o WHERE i < n
""")
def header_hits(spark, sf):
    """All 44 headers and two of markup over whole pages, by the run's own single pass; headers that are no printable text don't occur in text."""
    chunks = evidence.chunks_of_column(table(spark, sf, "pages"), "page_id", "encode(html, 'UTF-8')", 4096, 64)
    hits = scan.scanned(scan.scan_once(chunks, HEADERS), "hit")
    return hits.select(F.col("evidence").cast("long").alias("page_id"), "file_type", "pattern_id", "global_offset")


ASCII_RUN, UTF8_RUN = r"[\t\x20-\x7E]{6,}", r"[\t\x20-\x7E\x{A0}-\x{10FFFF}]{6,}"


def runs_sql(source: str, key: str, text: str) -> str:
    """(key, encoding, begins, run): printable runs of a text with their places in bytes; UTF-8 ones only with another character."""
    one = lambda kind, form, where: f"""
SELECT {key}, '{kind}' AS encoding, (sum(strlen(gap)) OVER w + coalesce(sum(strlen(run)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS begins, run
FROM (SELECT {key}, unnest(string_split_regex({text}, '{form}')) AS gap, unnest(list_append(regexp_extract_all({text}, '{form}'), NULL)) AS run, unnest(range(0, len(regexp_extract_all({text}, '{form}')) + 1)) AS i FROM {source} WHERE {text} IS NOT NULL)
WINDOW w AS (PARTITION BY {key} ORDER BY i) QUALIFY run IS NOT NULL {where}"""  # noqa: E731
    return f"({one('ascii', ASCII_RUN, '')}) UNION ALL ({one('utf-8', UTF8_RUN, 'AND strlen(run) > length(run)')})"


WHOLE, ENDLESS = 1 << 30, 1 << 30


@query(f"SELECT doc_id, run FROM ({runs_sql('documents', 'doc_id', 'text')}) WHERE encoding = 'ascii'")
def ascii_runs(spark, sf):
    """ASCII runs by the scan, and their bytes."""
    spans = scan.find_spans(document_chunks(spark, sf, WHOLE, 0), 6, ENDLESS).where(F.col("flags") % 8 == 0)
    text = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("evidence"), "doc_id", F.encode("text", "UTF-8").alias("data"))
    return spans.join(text, "evidence").select("doc_id", F.decode(F.expr("substring(data, int(local_start) + 1, length)"), "UTF-8").alias("run"))


HINTS = "(CASE WHEN contains(lower(run), 'http') OR contains(lower(run), 'www.') THEN 16 ELSE 0 END + CASE WHEN contains(run, '@') THEN 32 ELSE 0 END + CASE WHEN length(regexp_replace(run, '[^0-9]', '', 'g')) >= 10 THEN 64 ELSE 0 END)"


@query(f"SELECT doc_id, begins AS local_start, strlen(run)::INTEGER AS length, (CASE encoding WHEN 'utf-8' THEN 4 ELSE 0 END + {HINTS})::INTEGER AS flags FROM ({runs_sql('documents', 'doc_id', 'text')})")
def string_spans(spark, sf):
    """Runs of whole documents with their hints."""
    spans = scan.find_spans(document_chunks(spark, sf, WHOLE, 0), 6, ENDLESS, True)
    return spans.select(F.col("evidence").cast("long").alias("doc_id"), "local_start", "length", "flags")


def placed_sql(kind: str, bit: int, good: str) -> str:
    form = EXTRACT[kind]
    return f"""
SELECT page_id, '{kind}' AS kind, content, encoding, begins + place AS global_start, begins + place + strlen(content) - 1 AS global_end FROM (
    SELECT page_id, encoding, begins, (sum(strlen(gap)) OVER v + coalesce(sum(strlen(raw)) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS place, raw, {"raw" if kind == "phone" else "rtrim(raw, '.,;:)]}" + chr(34) + "''><')"} AS content
    FROM (SELECT page_id, encoding, begins, unnest(string_split_regex(run, '{form}')) AS gap, unnest(list_append(regexp_extract_all(run, '{form}'), NULL)) AS raw, unnest(range(0, len(regexp_extract_all(run, '{form}')) + 1)) AS k FROM r WHERE hints = 0 OR hints & {bit} <> 0)
    WINDOW v AS (PARTITION BY page_id, encoding, begins ORDER BY k) QUALIFY raw IS NOT NULL)
WHERE {good}"""


LABELS = "len(list_filter(string_split({0}, '.'), lambda x: strlen(x) NOT BETWEEN 1 AND 63)) = 0 AND contains({0}, '.') AND strlen({0}) <= 253"
HOST, DOMAIN = "split_part(split_part(regexp_replace(content, '(?i)^https?://', ''), '/', 1), ':', 1)", "split_part(content, '@', -1)"


@query(f"""
WITH r AS (SELECT *, {HINTS} AS hints FROM ({runs_sql('pages', 'page_id', 'html')})),
a AS ({placed_sql("url", 16, "strlen(content) BETWEEN 8 AND 2048 AND " + LABELS.format(HOST))}
UNION ALL {placed_sql("email", 32, "strlen(content) BETWEEN 6 AND 254 AND strlen(split_part(content, '@', 1)) BETWEEN 1 AND 64 AND regexp_matches(" + DOMAIN + ", '[A-Za-z]') AND " + LABELS.format(DOMAIN))}
UNION ALL {placed_sql("phone", 64, "length(regexp_replace(content, '[^0-9]', '', 'g')) BETWEEN 10 AND 15 AND len(list_distinct(regexp_extract_all(regexp_replace(content, '[^0-9]', '', 'g'), '.'))) >= 4")})
SELECT page_id, kind, content, encoding, global_start, global_end::BIGINT AS global_end FROM a
""")
def placed_artefacts(spark, sf):
    """Artefacts of pages with their places, by the run's own single pass."""
    chunks = evidence.chunks_of_column(table(spark, sf, "pages"), "page_id", "encode(html, 'UTF-8')", WHOLE, 0)
    found = scan.scanned(scan.scan_once(chunks, [], (6, ENDLESS, False), ("url", "email", "phone")), "artefact")
    return found.select(F.col("evidence").cast("long").alias("page_id"), "kind", "content", "encoding", "global_start", "global_end")


# entropy

WINDOW, THRESHOLD = 256, 4.2
ENTROPY_SQL = f"""
WITH w AS (SELECT doc_id, encode(text) AS b, unnest(range(0, strlen(text) // {WINDOW})) AS w FROM documents),
x AS (SELECT doc_id, w, unnest(regexp_extract_all(hex(array_slice(b, w * {WINDOW} + 1, w * {WINDOW} + {WINDOW})), '..')) AS byte FROM w),
c AS (SELECT doc_id, w, byte, count(*) AS n FROM x GROUP BY ALL)
SELECT doc_id, w::BIGINT AS w, round(-sum(n / {WINDOW}.0::DOUBLE * log2(n / {WINDOW}.0::DOUBLE)), 6) AS entropy FROM c GROUP BY doc_id, w
"""


@query(ENTROPY_SQL)
def entropy_windows(spark, sf):
    out = scan.entropy_windows(document_chunks(spark, sf, 1 << 30, 0), WINDOW)
    return out.select(F.col("evidence").cast("long").alias("doc_id"), "w", F.round("entropy", 6).alias("entropy"))


@query(f"""
WITH h AS (SELECT doc_id, w, entropy, w - row_number() OVER (PARTITION BY doc_id ORDER BY w) AS island FROM ({ENTROPY_SQL}) WHERE entropy >= {THRESHOLD})
SELECT doc_id, (min(w) * {WINDOW})::BIGINT AS start, ((max(w) + 1) * {WINDOW} - 1)::BIGINT AS "end", max(entropy) AS entropy, {WINDOW}::BIGINT AS window_size FROM h GROUP BY doc_id, island
""")
def entropy_regions(spark, sf):
    windows = scan.entropy_windows(document_chunks(spark, sf, 1 << 30, 0), WINDOW).withColumn("entropy", F.round("entropy", 6))
    return scan.entropy_regions(windows, WINDOW, THRESHOLD).withColumn("doc_id", F.col("evidence").cast("long")).drop("evidence")


@query(f"SELECT count(*) FILTER (entropy >= {THRESHOLD}) AS high, count(*) AS windows, round(count(*) FILTER (entropy >= {THRESHOLD}) / count(*)::DOUBLE, 9) AS ratio FROM ({ENTROPY_SQL})")
def high_entropy_ratio(spark, sf):
    w = entropy_windows(spark, sf)
    high = F.count(F.when(F.col("entropy") >= THRESHOLD, 1))
    return w.agg(high.alias("high"), F.count(F.lit(1)).alias("windows"), F.round(high / F.count(F.lit(1)), 9).alias("ratio"))


# browser tables

VISITS_SQL = """
WITH v AS (SELECT event_id, user_id AS url, epoch_us(ts) + 11644473600000000 AS visit_time, event_id % 300 AS transition FROM events)
SELECT event_id, c_name AS title, make_timestamp(visit_time - 11644473600000000) AS visit_time,
    CASE WHEN transition % 256 > 10 THEN 'other' ELSE list_extract(['link', 'typed', 'auto_bookmark', 'auto_subframe', 'manual_subframe', 'generated', 'start_page', 'form_submit', 'reload', 'keyword', 'keyword_generated'], (transition % 256 + 1)::BIGINT) END AS visit_source
FROM v JOIN customer ON url = c_custkey
"""


@query(VISITS_SQL)
def chrome_visits(spark, sf):
    """Visits with their pages: events as visits (times since 1601), customers as pages."""
    pages = table(spark, sf, "customer").select(F.lit("f").alias("source_file"), F.col("c_custkey").alias("page_id"), F.col("c_name").alias("title"))
    micros = F.unix_micros(F.col("ts").cast("timestamp")) + F.lit(11644473600000000)
    visits = table(spark, sf, "events").select(F.lit("f").alias("source_file"), "event_id", F.col("user_id").alias("url"), micros.alias("at"), (F.col("event_id") % 300).alias("transition"))
    return browser.visits_joined(visits, pages, "url", "page_id").select("event_id", "title", N.webkit_time(F.col("at")).alias("visit_time"), N.transition_label(F.col("transition")).alias("visit_source"))


@query("""
SELECT event_id, c_name AS title, ts AS visit_time, CASE WHEN event_id % 10 BETWEEN 1 AND 8 THEN list_extract(['link', 'typed', 'bookmark', 'embed', 'redirect_permanent', 'redirect_temporary', 'download', 'framed_link'], event_id % 10) ELSE 'other' END AS visit_source
FROM events JOIN customer ON user_id = c_custkey
""")
def firefox_visits(spark, sf):
    pages = table(spark, sf, "customer").select(F.lit("f").alias("source_file"), F.col("c_custkey").alias("page_id"), F.col("c_name").alias("title"))
    visits = table(spark, sf, "events").select(F.lit("f").alias("source_file"), "event_id", F.col("user_id").alias("place_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_id") % 10).alias("kind"))
    return browser.visits_joined(visits, pages, "place_id", "page_id").select("event_id", "title", N.unix_time(F.col("at")).alias("visit_time"), N.visit_type_label(F.col("kind")).alias("visit_source"))


@query(f"SELECT hour(visit_time)::INTEGER AS hour, count(*) AS n FROM ({VISITS_SQL}) GROUP BY 1")
def visits_per_hour(spark, sf):
    return chrome_visits(spark, sf).groupBy(F.hour("visit_time").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderkey, coalesce('part/' || l_partkey::VARCHAR, o_orderpriority) AS url, o_orderdate AS started, o_orderstatus AS state
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber = 1
""")
def download_links(spark, sf):
    """Downloads with the first link of their chain, else another address: orders as downloads, lineitems as links."""
    items = table(spark, sf, "lineitem").select(F.lit("f").alias("source_file"), F.col("l_orderkey").alias("id"), (F.col("l_linenumber") - 1).alias("chain_index"), F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("url"))
    orders = table(spark, sf, "orders").withColumn("source_file", F.lit("f")).withColumn("id", F.col("o_orderkey"))
    return browser.with_first_link(orders, items).select("o_orderkey", F.coalesce("chain_url", "o_orderpriority").alias("url"), F.col("o_orderdate").alias("started"), F.col("o_orderstatus").alias("state"))


@query("SELECT c_custkey AS id, c_mktsegment AS host, NULL::VARCHAR AS path, c_acctbal::BIGINT != 0 AS secure FROM customer")
def optional_columns(spark, sf):
    """The first of several column names that a table has; none gives null.  Amounts become whole numbers as SQL's cast makes them, halves to the even one."""
    c = table(spark, sf, "customer").withColumn("c_acctbal", F.rint("c_acctbal"))
    return c.select(N.pick(c, "id", "C_CUSTKEY", kind="bigint").alias("id"), N.pick(c, "host_key", "c_mktsegment").alias("host"), N.pick(c, "path").alias("path"), (N.pick(c, "is_secure", "c_acctbal", kind="bigint") != 0).alias("secure"))


@query("""
SELECT user_id % 50 AS url_id, min_by(event_type, event_id) FILTER (event_type <> 'click') AS title, min_by(event_id, event_id) FILTER (event_id % 3 = 0) AS visit_micros FROM events GROUP BY 1
""")
def merged_recoveries(spark, sf):
    """First title and time of each URL, each on its own, in the order of pages and cells."""
    e = table(spark, sf, "events")
    cells = e.select(F.lit("f").alias("source_file"), (F.col("user_id") % 50).cast("string").alias("url"), (F.col("event_id") / 100).cast("int").alias("page"), (F.col("event_id") % 100).cast("int").alias("cell"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("title"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("visit_micros"))
    return sqlite_pages.merge_cells(cells).select(F.col("url").cast("long").alias("url_id"), "title", "visit_micros")


# analyses of the tables


@query("SELECT p_brand AS file_type, count(*) AS n FROM part GROUP BY 1")
def count_by_type(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("file_type")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_type AS file_type, count(*) AS n, sum(p_size)::BIGINT AS total FROM part GROUP BY 1 ORDER BY total DESC, 1")
def size_by_type(spark, sf):
    out = table(spark, sf, "part").groupBy(F.col("p_type").alias("file_type")).agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("total"))
    return out.orderBy(F.desc("total"), "file_type")


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 40")
def size_threshold(spark, sf):
    return table(spark, sf, "part").where("p_size > 40").select("p_partkey", "p_size")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'P') ORDER BY o_orderkey DESC LIMIT 100")
def last_by_place(spark, sf):
    return table(spark, sf, "orders").where(F.col("o_orderstatus").isin("F", "P")).orderBy(F.desc("o_orderkey")).limit(100).select("o_orderkey", "o_orderpriority")


@query("SELECT l_orderkey, l_linenumber, l_returnflag || '; ' || l_linestatus AS errors FROM lineitem WHERE l_returnflag = 'R' OR l_discount > 0.09")
def faulty_rows(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_returnflag = 'R' or l_discount > 0.09")
    return sinks.flat(rows.select("l_orderkey", "l_linenumber", F.array("l_returnflag", "l_linestatus").alias("errors")))


@query("SELECT c_name AS path, count(*) AS visits FROM customer JOIN events ON user_id = c_custkey GROUP BY 1")
def files_with_history(spark, sf):
    files = table(spark, sf, "customer").select(F.col("c_custkey").alias("path_id"), F.col("c_name").alias("path"))
    return table(spark, sf, "events").join(files, F.col("user_id") == F.col("path_id")).groupBy("path").agg(F.count(F.lit(1)).alias("visits"))


@query("""
SELECT p_partkey, 'x_' || regexp_replace(p_type, '[^A-Za-z0-9_.-]', '_', 'g') AS safe, regexp_replace(p_brand, '[^A-Za-z0-9_.-]', '_', 'g') || '/' || regexp_replace(p_brand, '[^A-Za-z0-9_.-]', '_', 'g') || '_' || printf('%012X', p_partkey * 4096) || '.bin' AS path,
    (p_partkey * 4096 + CASE WHEN p_size = 0 THEN 0 ELSE p_size - 1 END)::BIGINT AS global_end FROM part
""")
def carved_names(spark, sf):
    p, start = table(spark, sf, "part"), F.col("p_partkey") * 4096
    return p.select("p_partkey", N.component(F.concat(F.lit("x "), F.col("p_type"))).alias("safe"), N.carved_path(F.col("p_brand"), start, F.lit("BIN")).alias("path"), N.global_end(start, F.col("p_size")).alias("global_end"))


CHUNKS_SQL = """
WITH d AS (SELECT doc_id, strlen(text)::BIGINT AS total FROM documents), c AS (SELECT doc_id, total, unnest(range(0, (total + 511) // 512)) AS chunk_id FROM d),
k AS (SELECT doc_id, chunk_id, chunk_id * 512 AS start, least(total - chunk_id * 512, 528) AS length FROM c)
"""


def short_chunks(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("evidence"), F.octet_length("text").cast("long").alias("total"))
    return evidence.plan_chunks(docs, 512, 16)


@query(f"""
{CHUNKS_SQL}, b AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY doc_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT doc_id AS evidence, chunk_id, least(length, 1300 - before)::BIGINT AS length FROM b WHERE before < 1300
""")
def first_bytes(spark, sf):
    return limits.limit_bytes(short_chunks(spark, sf), 1300).select("evidence", "chunk_id", "length")


@query(f"{CHUNKS_SQL} SELECT doc_id AS evidence, chunk_id FROM k WHERE chunk_id < 3 AND start >= 512")
def resumed_chunks(spark, sf):
    return limits.resume(limits.limit_chunks(short_chunks(spark, sf), 3), 512).select("evidence", "chunk_id")


@query("SELECT l_orderkey AS evidence, l_linenumber::BIGINT AS global_start FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 50")
def first_files(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("evidence"), F.col("l_linenumber").cast("long").alias("global_start"), F.lit("x").alias("file_type"))
    return limits.limit_files(rows, 50).select("evidence", "global_start")


@query(f"""
WITH n AS (SELECT strlen(text) AS n FROM documents)
SELECT sum(n)::BIGINT AS bytes_scanned, count(*) AS chunks, (SELECT count(*) FROM ({HITS_SQL})) AS hits, 0::BIGINT AS files, (SELECT count(*) FROM documents WHERE length(text) > 3) AS spans, (SELECT count(*) FROM ({PHONES_SQL})) AS artefacts, 0::BIGINT AS errors FROM n WHERE n > 0
""")
def run_summary(spark, sf):
    chunks = document_chunks(spark, sf, 1 << 30, 0)
    docs = table(spark, sf, "documents")
    return limits.summary(chunks.drop("data"), signature_hits(spark, sf), docs.where("false"), docs.where(F.length("text") > 3), artefact_phones(spark, sf))


@query("SELECT CASE WHEN r_name IN ('AFRICA') THEN 'files_zip' ELSE 'files_other' END AS category, r_regionkey FROM region")
def file_categories(spark, sf):
    r = table(spark, sf, "region").withColumn("t", F.when(F.col("r_name") == "AFRICA", "docx").otherwise(F.lower("r_name")))
    return r.select(sinks.file_category(F.col("t")).alias("category"), "r_regionkey")


def image_sql() -> str:
    """What the synthetic image holds, from its layout: the files laid in it; the later frames and pages inside of them, where a file can begin too; and a header without a known end, which
    takes the rest."""
    data, places = samples.image()
    found = [(name.split(".")[0], at, len(content)) for name, (at, content) in places.items()]
    mp3, ogg, gz = places["mp3"], places["ogg"], places["gzip"]
    found += [("mp3", mp3[0] + k, len(mp3[1]) - k) for k in (30, 30 + 417)]
    page = ogg[1].index(b"OggS", 1)
    found += [("ogg", ogg[0] + page, len(ogg[1]) - page), ("gzip", gz[0] + len(gz[1]), len(data) - gz[0] - len(gz[1]))]
    row = lambda kind, at, n: f"('{kind}', {at}, {at + n - 1}, {n}, '{hashlib.md5(data[at : at + n], usedforsecurity=False).hexdigest()}', '{hashlib.sha256(data[at : at + n]).hexdigest()}')"
    return f"SELECT file_type, global_start::BIGINT AS global_start, global_end::BIGINT AS global_end, size::BIGINT AS size, md5, sha256, true AS validated FROM (VALUES {', '.join(row(*x) for x in found)}) v(file_type, global_start, global_end, size, md5, sha256)"


def carve_written(spark, names: list[str], parts: list[bytes]) -> DataFrame:
    """Carves the evidence whose files are written to the shared folder, so that executors read it too."""
    from pyarrow import fs

    folder = sinks.work_folder(spark)
    filesystem, root = fs.FileSystem.from_uri(folder)
    filesystem.create_dir(root, recursive=True)
    for name, data in zip(names, parts, strict=True):
        with filesystem.open_output_stream(f"{root}/{name}") as out:
            out.write(data)
    config = EngineConfig(chunk_size=256 << 10, overlap=64)
    chunks = evidence.read_evidence(spark, f"{folder.rstrip('/')}/{names[0]}", config.chunk_size, config.overlap)
    files = carve.carve(scan.scanned(scan.scan_once(chunks, config.patterns()), "hit"), config, 8)
    return files.select("file_type", "global_start", "global_end", "size", "md5", "sha256", "validated")


@query(image_sql())
def carved_image(spark, sf):
    """A synthetic image with a file of every format, carved and hashed."""
    return carve_written(spark, [f"image-{uuid.uuid4().hex}.raw"], [samples.image()[0]])


@query(image_sql())
def carved_ewf_image(spark, sf):
    """The same image as EWF segments, some chunks compressed."""
    parts, name = samples.ewf_image(samples.image()[0]), f"image-{uuid.uuid4().hex}.E01"
    return carve_written(spark, [ewf.segment_path(name, n) for n in range(1, len(parts) + 1)], parts)


@query("""
SELECT 'sqlite_page' AS browser, 'unknown' AS profile, 'https://site' || i || '.example.com/page' AS url, 'Title ' || i || ' of a page' AS title,
    make_timestamp(13303449600000000 - 11644473600000000 + i) AS visit_time, 'page_scan' AS visit_source, 'a.sqlite' AS source_file FROM (SELECT unnest(range(0, 20)) AS i)
UNION ALL SELECT 'sqlite_page', 'unknown', 'https://long.example.com/', NULL, NULL, 'page_scan', 'a.sqlite'
""")
def recovered_history(spark, sf):
    """History from the pages of a SQLite file, beside what the database tells."""
    files = spark.createDataFrame([("a.sqlite", samples.history_db()), ("b.sqlite", b"broken")], "source_file string, data binary")
    return sqlite_pages.recover_history(files, None, datetime(2026, 1, 1, tzinfo=timezone.utc))


SMALLEST = "/root/testdata/sf0.001"


def entry(spark: SparkSession, sf: str | None = None) -> DataFrame:
    """The flagship: URLs with their parts; of the smallest tables if no folder is given."""
    parts = A.url_parts(F.col("url"))
    out = artefact_urls(spark, sf or os.environ.get("SEDIMENTA_TABLES", SMALLEST))
    return out.select("page_id", "url", *(parts[k].alias(k) for k in ("scheme", "host", "port", "path", "query", "fragment")))
