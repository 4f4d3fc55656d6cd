"""Browser databases: tables of carved SQLite files as rows, and the joins and labels that make history, cookies and downloads of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.naming import transition_label, unix_time, visit_type_label, webkit_time

TABLES = ("urls", "visits", "moz_places", "moz_historyvisits", "cookies", "moz_cookies", "downloads", "downloads_url_chains", "moz_downloads")


def read_sqlite_tables(files: DataFrame) -> DataFrame:
    """(source_file, tab, row) of every row of the known tables in ``files`` (source_file, data); row maps lower-case column names to text, without nulls.

    Each file is opened read-only from a temporary copy in the task's own folder, which is deleted at once.  A file that is no database, or is broken, gives the rows
    read so far and a row of tab ``!error``.
    """

    def run(batches):
        import os
        import sqlite3
        import tempfile

        import pyarrow as pa

        kind = pa.map_(pa.string(), pa.string())
        for batch in batches:
            for source, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = []
                with tempfile.TemporaryDirectory() as folder:
                    path = os.path.join(folder, "db")
                    with open(path, "wb") as f:
                        f.write(data or b"")
                    try:
                        db = sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)
                        have = {r[0].lower(): r[0] for r in db.execute("select name from sqlite_master where type = 'table'")}
                        for tab in TABLES:
                            if tab in have:
                                rows = db.execute(f'select * from "{have[tab]}"')
                                names = [d[0].lower() for d in rows.description]
                                for r in rows:
                                    out.append((source, tab, [(n, v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)) for n, v in zip(names, r, strict=True) if v is not None]))
                        db.close()
                    except sqlite3.Error as e:
                        out.append((source, "!error", [("error", f"{type(e).__name__}: {e}")]))
                for i in range(0, len(out), 10_000):
                    cols = list(zip(*out[i : i + 10_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], kind)], names=["source_file", "tab", "row"])

    return files.select("source_file", "data").mapInArrow(run, "source_file string, tab string, row map<string,string>")


def of(row: Column, *names: str, kind: str = "string") -> Column:
    """The first of some columns that the row has."""
    return F.coalesce(*(F.try_element_at(row, F.lit(n)) for n in names)).try_cast(kind) if len(names) > 1 else F.try_element_at(row, F.lit(names[0])).try_cast(kind)


def visits_joined(visits: DataFrame, pages: DataFrame, visit_key: str, page_key: str) -> DataFrame:
    """Visits with their pages: an inner join on file and key."""
    return visits.join(pages, (visits["source_file"] == pages["source_file"]) & (visits[visit_key] == pages[page_key])).drop(pages["source_file"])


def history(rows: DataFrame) -> DataFrame:
    """Visits of both browsers; a file without a table of visits gives its pages instead."""
    tab = lambda name: rows.where(F.col("tab") == name)
    parts = []
    for browser, page, visit, key, when, label, last in (
        ("chrome", "urls", "visits", "url", "visit_time", lambda r: transition_label(of(r, "transition", kind="bigint")), "last_visit_time"),
        ("firefox", "moz_places", "moz_historyvisits", "place_id", "visit_date", lambda r: visit_type_label(of(r, "visit_type", kind="bigint")), "last_visit_date"),
    ):
        time = webkit_time if browser == "chrome" else unix_time
        pages = tab(page).select("source_file", of(F.col("row"), "id", kind="bigint").alias("page_id"), of(F.col("row"), "url").alias("url"), of(F.col("row"), "title").alias("title"), time(of(F.col("row"), last, kind="bigint")).alias("last"))
        visits = tab(visit).select("source_file", of(F.col("row"), key, kind="bigint").alias("to_page"), time(of(F.col("row"), when, kind="bigint")).alias("visit_time"), label(F.col("row")).alias("visit_source"))
        with_visits = tab(visit).select("source_file").distinct()
        seen = visits_joined(visits, pages, "to_page", "page_id").select(F.lit(browser).alias("browser"), F.lit("Default").alias("profile"), "url", "title", "visit_time", "visit_source", "source_file")
        alone = pages.join(with_visits, "source_file", "left_anti").select(F.lit(browser).alias("browser"), F.lit("Default").alias("profile"), "url", "title", F.col("last").alias("visit_time"), F.lit(None).cast("string").alias("visit_source"), "source_file")
        parts += [seen, alone.where("url is not null")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cookies(rows: DataFrame) -> DataFrame:
    """Both browsers' cookies; older column names count too."""
    r = F.col("row")
    flag = lambda *names: of(r, *names, kind="bigint") != 0
    micros = lambda c: F.when(c > F.lit((1 << 63) // 1_000_000), F.lit((1 << 63) - 1)).otherwise(c * 1_000_000)
    common = [F.lit("Default").alias("profile"), of(r, "host_key", "host").alias("host"), of(r, "name").alias("name"), of(r, "value").alias("value"), of(r, "path").alias("path")]
    chrome = rows.where("tab = 'cookies'").select(
        F.lit("chrome").alias("browser"), *common, webkit_time(of(r, "expires_utc", kind="bigint")).alias("expires"), webkit_time(of(r, "last_access_utc", "last_access", kind="bigint")).alias("last_access"),
        webkit_time(of(r, "creation_utc", "creation_time", kind="bigint")).alias("created"), flag("is_secure", "secure").alias("secure"), flag("is_httponly", "httponly").alias("http_only"), "source_file",
    )
    firefox = rows.where("tab = 'moz_cookies'").select(
        F.lit("firefox").alias("browser"), *common, unix_time(micros(of(r, "expiry", kind="bigint"))).alias("expires"), unix_time(of(r, "lastaccessed", kind="bigint")).alias("last_access"),
        unix_time(of(r, "creationtime", kind="bigint")).alias("created"), flag("issecure").alias("secure"), flag("ishttponly").alias("http_only"), "source_file",
    )
    return chrome.unionByName(firefox)


def with_first_link(downloads: DataFrame, chains: DataFrame) -> DataFrame:
    """Downloads with the first link of their chain as chain_url: a left join whose condition on the chain stays on its side."""
    first = chains.where("chain_index = 0").select(F.col("source_file").alias("chain_file"), F.col("id").alias("chain_id"), F.col("url").alias("chain_url"))
    return downloads.join(first, (downloads["source_file"] == first["chain_file"]) & (downloads["id"] == first["chain_id"]), "left").drop("chain_file", "chain_id")


def downloads(rows: DataFrame) -> DataFrame:
    """Both browsers' downloads; the address is the first that is known of several."""
    r = F.col("row")
    num = lambda *names: of(r, *names, kind="bigint")
    chains = rows.where("tab = 'downloads_url_chains'").select("source_file", num("id").alias("id"), num("chain_index").alias("chain_index"), of(r, "url").alias("url"))
    chrome = rows.where("tab = 'downloads'").select("source_file", num("id").alias("id"), "row")
    chrome = with_first_link(chrome, chains).select(
        F.lit("chrome").alias("browser"), F.lit("Default").alias("profile"), F.coalesce("chain_url", of(r, "tab_url", "url", "referrer", "site_url", "origin_url")).alias("url"), of(r, "target_path", "current_path").alias("target"),
        webkit_time(num("start_time")).alias("started"), webkit_time(num("end_time")).alias("ended"), num("total_bytes").alias("total_bytes"), of(r, "state").alias("state"), "source_file",
    )
    firefox = rows.where("tab = 'moz_downloads'").select(
        F.lit("firefox").alias("browser"), F.lit("Default").alias("profile"), of(r, "source", "url").alias("url"), of(r, "target").alias("target"), unix_time(num("starttime", "start_time")).alias("started"),
        unix_time(num("endtime", "end_time")).alias("ended"), num("totalbytes", "maxbytes", "total_bytes").alias("total_bytes"), of(r, "state").alias("state"), "source_file",
    )
    return chrome.unionByName(firefox)
