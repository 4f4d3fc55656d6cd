"""Deterministic sharded WARC archives.

Records are sorted by page id, then by a hash of payload and URL (the tie), and cut into shards of about equal size: a shard begins where the running sum of payload sizes passes a multiple
of the target.  The sums are exact and made in two passes over sorted keys (sums of partitions, then sums within them), so bounds depend on the rows alone, not on partitions, and a shard
always has the same bytes.  Null and repeated ids are split like others; rows alike in id, payload and URL that fill several shards are dealt to these in turn, and only which of them gets which is open.  A task
writes a shard's records as gzip members and begins a new file when the compressed size passes the limit.  Headers, record ids and digests are
generated from the row.  A file is written under a temporary name, renamed when it is whole, and entered in the manifest; the manifest is committed
in the same way after all tasks have ended, and readers use only files that it names.  So a task that is run again replaces its files by equal ones.

Of equal payloads of ``LEAST`` bytes or more, the smallest page id is stored; others become revisit records that refer to it.
Which ones do is found on (id, digest) alone.  The result travels as rows of its own that sort just before the page they speak of, so pages
are shuffled once, by shard, and a digest that many pages share is no hot key for them.
"""

from __future__ import annotations

import json
import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_sized, new_folder

#: Payloads below LEAST bytes are never revisits; compressed size at which a file ends; shards have about 1/SHARDS of all bytes, but no less and no more than these.
LEAST, ROLL, SHARDS, SMALLEST, LARGEST = 100, 32 << 20, 64, 4 << 20, 96 << 20
#: Bytes that a record's headers are taken to have, and the id that null sorts as.
HEADERS, NULL_ID = 600, -(1 << 63)
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "manifest.jsonl"
FILES = "shard long, file string, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, html binary, file string, digest_ok boolean"


def open_folder(path: str):
    """A file system and the path in it: local folders and all others that Arrow knows (hdfs, s3, gs, ...)."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def header_url(url: str) -> list[str]:
    """Header lines of a URL: as it is if a header can hold it, else with the UTF-8 bytes of other characters percent-encoded, and the exact URL in a header of its own."""
    import base64

    if url and url == url.strip() and url.isprintable() and " " not in url:
        return [f"WARC-Target-URI: {url}"]
    data = url.encode("utf-8", "surrogatepass")
    coded = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)
    return [f"WARC-Target-URI: {coded}", f"X-Target-URI-Base64: {base64.b64encode(data).decode()}"]


def make_record(page_id, url, payload: bytes, digest: str, refers_to, date: str = DATE) -> bytes:
    """A response record, or a revisit record without the payload if it refers to another page."""
    import hashlib

    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        lines += header_url(url)
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    lines.append(f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "replace") + block + b"\r\n\r\n"


class Placement:
    """Shards of rows, from the keys (id, tie) at which shards begin; rows of a key that begins several shards are dealt to these in turn."""

    def __init__(self, bounds: list[tuple[int, int]]):
        import numpy as np

        self.ids, self.ties = (np.array([b[k] for b in bounds], "int64") for k in (0, 1))

    def ranges(self, page_id, tie):
        """The first and last shard of each key."""
        import numpy as np

        page_id = np.array([NULL_ID if x is None else x for x in page_id], "int64")
        tie = np.asarray(tie, "int64")
        low, high = np.searchsorted(self.ids, page_id, "left"), np.searchsorted(self.ids, page_id, "right")
        first, last = high.copy(), high.copy()
        for k in np.flatnonzero(high > low):  # ids at which a shard begins
            part = self.ties[low[k] : high[k]]
            last[k] = low[k] + np.searchsorted(part, tie[k], "right")
            first[k] = min(last[k], low[k] + np.searchsorted(part, tie[k], "left") + 1)
        return first, last

    def shards(self, page_id, tie, row):
        import numpy as np

        first, last = self.ranges(page_id, tie)
        return first + np.asarray(row, "int64") % (last - first + 1)


def shard_bounds(sizes: DataFrame, target: int) -> list[tuple[int, int]]:
    """Keys (id, tie) at which a new shard begins, once for each shard that begins there (the first shard has no lower bound).  ``sizes``: (page_id, tie, bytes).

    What the driver gets is a number for each partition and a key for each shard.
    """
    spark = sizes.sparkSession
    keys = sizes.groupBy(F.coalesce("page_id", F.lit(NULL_ID)).alias("page_id"), "tie").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = cut(keys.repartitionByRange(parts, "page_id", "tie").sortWithinPartitions("page_id", "tie").withColumn("part", F.spark_partition_id()))
    before, total = {}, 0
    for r in sorted(keys.groupBy("part").agg(F.sum("bytes").alias("bytes")).collect()):
        before[r["part"]], total = total, total + r["bytes"]
    shared = spark.sparkContext.broadcast(before)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            page_id, tie, size, rows, part = (batch.column(k).to_numpy() for k in range(5))
            at = shared.value[int(part[0])] if at is None else at
            ends = at + np.cumsum(size)
            starts = (np.concatenate([[at], ends[:-1]]) + target - 1) // target  # shards that begin here or later
            n = (ends + target - 1) // target - starts
            if at == 0:
                n[0] -= 1  # the first shard
            n = np.clip(n, 0, rows)  # a row is in one shard, however long it is
            at = int(ends[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x, n)) for x in (page_id, tie)], names=["page_id", "tie"])

    return sorted(tuple(r) for r in keys.select("page_id", "tie", "bytes", "n", "part").mapInArrow(run, "page_id long, tie long").collect())


def write_archives(pages: DataFrame, folder: str, roll: int = ROLL, shard: int | None = None, least: int = LEAST, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for each row of ``pages`` to ``folder`` and returns the manifest (shard, file, records, bytes, sha256).

    Null html counts as empty, null urls give records without a target.  A row whose id is null or the smallest of its payload is a response (repeated ids
    with equal payloads all are).  Other columns are ignored; an empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    html = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html")).withColumn("digest", F.sha2("html", 256)).withColumn("tie", F.xxhash64("digest", "url"))
    marks = cut(pages.select("page_id", "digest", "tie", F.length("html").cast("long").alias("bytes")))
    first = marks.where((F.col("bytes") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last")
    first = cut(first)
    known, total = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("bytes") + HEADERS), F.lit(0))).first()
    revisits = join_sized(marks.where("page_id is not null").select("page_id", "digest", "tie").distinct(), first, ["digest"], known, 64).where("page_id > first")
    shard = shard or min(LARGEST, max(SMALLEST, total // SHARDS))
    bounds = shard_bounds(marks.select("page_id", "tie", (F.col("bytes") + HEADERS).alias("bytes")), shard)
    shared = spark.sparkContext.broadcast(Placement(bounds))

    @F.pandas_udf("long")
    def shard_of(page_id, tie, row):
        import pandas as pd

        ids = [None if x is None or x != x else int(x) for x in page_id.astype(object)]
        return pd.Series(shared.value.shards(ids, tie.to_numpy("int64"), row.to_numpy("int64")))

    @F.pandas_udf("array<long>")
    def shards_of(page_id, tie):
        import pandas as pd

        return pd.Series([list(range(a, b + 1)) for a, b in zip(*shared.value.ranges(page_id, tie.to_numpy("int64")), strict=True)])

    asked = revisits.withColumn("shard", F.explode(shards_of("page_id", "tie")))
    asked = asked.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"), "digest", F.col("first").alias("refers_to"), F.lit(0).alias("kind"), "tie", "shard")
    rows = pages.withColumn("refers_to", F.lit(None).cast("long")).withColumn("kind", F.lit(1)).withColumn("shard", shard_of("page_id", "tie", F.monotonically_increasing_id()))
    rows = rows.select(asked.columns).unionByName(asked)
    parts = max(1, min(len(bounds) + 1, 20_000))
    # shards go to tasks in turn, so that none gets several while another has none
    rows = rows.repartitionById(parts, (F.col("shard") % parts).cast("int")).sortWithinPartitions("shard", "page_id", "tie", "digest", "kind", "url")

    def write(batches):
        import hashlib
        import zlib

        import pyarrow as pa

        filesystem, root = open_folder(folder)
        filesystem.create_dir(root, recursive=True)
        state = {"out": None}
        done = []

        def close():
            if state["out"] is not None:
                state["out"].close()
                filesystem.move(state["tmp"], posixpath.join(root, state["name"]))
                done.append((state["shard"], state["name"], state["records"], state["bytes"], state["sha"].hexdigest()))
                state["out"] = None

        def begin(shard_no, part):
            name = f"pages-{shard_no:08d}-{part:04d}.warc.gz"
            tmp = posixpath.join(root, f".{name}.{uuid.uuid4().hex}.tmp")
            state.update(out=filesystem.open_output_stream(tmp, compression=None), tmp=tmp, name=name, shard=shard_no, part=part, records=0, bytes=0, sha=hashlib.sha256())

        try:
            told = None
            for batch in batches:
                for page_id, url, data, digest, refers_to, kind, shard_no in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "kind", "shard")), strict=True):
                    if kind == 0:
                        told = (page_id, digest, refers_to)
                        continue
                    if state["out"] is None or state["shard"] != shard_no:
                        close()
                        begin(shard_no, 0)
                    elif state["bytes"] >= roll:
                        part = state["part"] + 1
                        close()
                        begin(shard_no, part)
                    to = told[2] if told is not None and told[:2] == (page_id, digest) else None
                    z = zlib.compressobj(3, zlib.DEFLATED, 31)
                    member = z.compress(make_record(page_id, url, data, digest, to)) + z.flush()
                    state["out"].write(member)
                    state["sha"].update(member)
                    state["records"] += 1
                    state["bytes"] += len(member)
                while len(done) > 100:
                    yield pa.RecordBatch.from_pylist([dict(zip(("shard", "file", "records", "bytes", "sha256"), d, strict=True)) for d in done], schema=FILES_ARROW())
                    done.clear()
            close()
        finally:
            if state["out"] is not None:
                state["out"].close()
                filesystem.delete_file(state["tmp"])
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(("shard", "file", "records", "bytes", "sha256"), d, strict=True)) for d in done], schema=FILES_ARROW())

    manifest = cut(rows.select("page_id", "url", "html", "digest", "refers_to", "kind", "shard").mapInArrow(write, FILES))
    filesystem, root = open_folder(folder)
    filesystem.create_dir(root, recursive=True)
    tmp = posixpath.join(root, f".{MANIFEST}.{uuid.uuid4().hex}.tmp")
    with filesystem.open_output_stream(tmp) as out:  # a line for each file, not each record
        for r in manifest.orderBy("file").toLocalIterator():
            out.write((json.dumps(r.asDict()) + "\n").encode())
    filesystem.move(tmp, posixpath.join(root, MANIFEST))
    return manifest


def FILES_ARROW():
    import pyarrow as pa

    return pa.schema([("shard", pa.int64()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


def members(stream, block: int = 1 << 20):
    """The content of each gzip member of a stream, in order."""
    import zlib

    z, parts, data = zlib.decompressobj(31), [], b""
    while True:
        if not data:
            data = stream.read(block)
            if not data:
                if parts:
                    raise ValueError("the archive ends within a record")
                return
        parts.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []


def parse_record(record: bytes) -> tuple[dict, dict, bytes, str, bool]:
    """(headers, HTTP headers, payload, its SHA-256, whether the digests hold) of one record; header names in lower case."""
    import hashlib

    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    web = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode("latin-1").split("\r\n")[1:])}
    ok = headers["warc-block-digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
    digest = hashlib.sha256(payload).hexdigest()
    if headers["warc-type"] == "response":
        ok = ok and headers["warc-payload-digest"] == "sha256:" + digest and len(payload) == int(web["content-length"])
    return headers, web, payload, digest, ok


def read_archives(spark: SparkSession, folder: str, payloads: bool = True, strict: bool = False) -> DataFrame:
    """A row for each record of the files that the manifest names, in the columns of ``RECORDS``; html is null for revisits, or without ``payloads``.

    payload_bytes and payload_digest are those of the payload that was read, or for a revisit, which has none, those that it names.
    digest_ok says whether the record's digests are those of its content; with ``strict``, a record for which it is false is an error.  Files are read as streams, one record at a time.
    """
    files = spark.read.schema(FILES).json(posixpath.join(folder, MANIFEST))
    n = files.count()

    def read(batches):
        import base64

        import pyarrow as pa

        filesystem, root = open_folder(folder)
        names = [x.strip().split(" ")[0] for x in RECORDS.split(",")]
        schema = pa.schema(list(zip(names, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.bool_()), strict=True)))
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with filesystem.open_input_stream(posixpath.join(root, name), compression=None, buffer_size=1 << 20) as stream:
                    for record in members(stream):
                        h, web, payload, digest, ok = parse_record(record)
                        if strict and not ok:
                            raise ValueError(f"a record's content is not that of its digest: page {h.get('x-page-id')} in {name}")
                        url = h.get("warc-target-uri")
                        if "x-target-uri-base64" in h:
                            url = base64.b64decode(h["x-target-uri-base64"]).decode("utf-8", "surrogatepass")
                        page, to, response = h.get("x-page-id"), h.get("x-refers-to-page-id"), h["warc-type"] == "response"
                        rows.append((page and int(page), url, h["warc-type"], to and int(to), len(payload) if response else int(web["content-length"]), digest if response else h["warc-payload-digest"].partition(":")[2], payload if response and payloads else None, name, ok))
                        size += len(record) if payloads else 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.select("file").repartition(max(1, min(n, 20_000)), "file").mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """What the archives of ``pages`` hold when they are read back; a record that doesn't agree with its digests is an error."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    write_archives(pages, folder, **options)
    return read_archives(pages.sparkSession, folder, payloads=False, strict=True)
