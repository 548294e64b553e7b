"""WARC archives and the transactions in them.

``write`` turns pages into archives: for each page a request, a response (or a revisit,
where another page has the same payload) and a metadata record, tied by
``WARC-Concurrent-To``, each a gzip member of its own. Tasks stream their pages into
files with fresh names in the shared folder and hand on only the names; what a lost or
repeated task left behind is in no name list and is never read.

``records`` reads archives record by record, of any size and by any writer; payloads are
hashed as they pass. ``captures`` assembles transactions: requests and metadata find
their response or revisit through concurrent-to identifiers, in either direction and
through one record in between, and each capture becomes one nested row.

Equal payloads are found by SHA-256 over partial aggregates. Only groups of two and more
are joined back to the pages: payloads are shuffled only if those groups are beyond the
broadcast limit.

Defined results: a null page counts as empty; a null url is left out of its records, line
breaks in one are written as %0D and %0A. Of pages with equal payloads the smallest
``page_id`` (nulls last, then the smallest url) is the response; if that very page is
repeated, one of the repeats is, and the others revisit it. Payloads under ``min_bytes``
are responses throughout. An empty table gives no archives and no rows. Other columns of
the pages are not read. A record that breaks off raises ``EOFError``.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.llm.batches import cut
from rankflow.llm.rows import ROW
from rankflow.operators.joins import lookup
from rankflow.session import materialize, qualified, scratch_path

#: Bytes of an archive after which the next is begun.
ARCHIVE_BYTES = 128 << 20
#: Bytes of a payload that are hashed at a time, and payload bytes of a batch of records.
PIECE = 1 << 20
BATCH_ROWS = 2000
DATE = "2000-01-01T00:00:00Z"
#: Fixed: names of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Record types with an HTTP response, whose payload follows the HTTP header, and those that describe one.
HEADS, PARTS = ("response", "revisit"), ("request", "metadata")

RECORD = ("record_id string, kind string, concurrent array<string>, refers_to string, target_uri string, date string, "
          "digest string, n_bytes long, fields map<string,string>")


def base32_sha1(data: Column) -> Column:
    """SHA-1 of ``data`` in base 32: four characters for every five hexadecimal ones."""
    digits = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def marked(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
           html_col: str = "html") -> DataFrame:
    """``id``, ``url``, ``html``, ``digest``, ``key``, ``anchor`` and ``revisits`` for every page.

    ``anchor``: others revisit this page; ``revisits``: it revisits the anchor with its ``key``.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    pages = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    keyed = pages.withColumn("key", F.when(F.octet_length("html") >= min_bytes, F.sha2(F.col("html"), 256)))
    order = F.struct(F.isnull("id").alias("no_id"), "id", F.isnull("url").alias("no_url"), "url")
    same = keyed.where("key IS NOT NULL").groupBy("key", "id", "url").agg(F.count("*").alias("n"))
    groups = materialize(same.groupBy("key").agg(F.sum("n").alias("total"), F.min(order).alias("first"), F.min_by("n", order).alias("repeats"))
                         .where("total > 1").select("key", F.col("first.id").alias("first_id"),
                                                    F.col("first.url").alias("first_url"), "repeats"), "same-payload")
    joined = lookup(keyed, groups, ["key"], "left", salt_by=["id", "url"])
    first = F.col("repeats").isNotNull() & F.col("id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url"))
    joined = joined.withColumn("anchor", first).withColumn("revisits", F.col("repeats").isNotNull() & ~first)
    names = ["id", "url", "html", "key", "anchor", "revisits"]
    rows = joined.where("NOT (anchor AND repeats > 1)").select(*names)
    if not groups.where("repeats > 1").isEmpty():
        again = materialize(joined.where("anchor AND repeats > 1").select(
            *names, F.monotonically_increasing_id().alias(ROW)), "repeated-pages")
        chosen = again.groupBy("key").agg(F.min(ROW).alias("chosen"))
        again = lookup(again, chosen, ["key"], salt_by=[ROW])
        rows = rows.union(again.withColumn("anchor", F.col(ROW) == F.col("chosen"))
                          .withColumn("revisits", F.col(ROW) != F.col("chosen")).select(*names))
    return rows.withColumn("digest", base32_sha1(F.col("html")))


def _urn(digits: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hex=digits[:32])}>"


class _Archive:
    """One file of gzip members, one record each."""

    def __init__(self, files: pf.FileSystem, folder: str) -> None:
        self.name = uuid.uuid4().hex
        self.sink = files.open_output_stream(f"{folder}/{self.name}.warc.gz", compression=None)
        self.n_records = self.n_bytes = 0

    def fresh_id(self) -> str:
        self.n_records += 1
        return _urn(f"{self.name[:20]}{self.n_records:012x}")

    def add(self, kind: str, record_id: str, date: str, block: bytes, content: str, more: list[tuple[str, str | None]]) -> None:
        head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), *more,
                ("Content-Type", content), ("Content-Length", str(len(block)))]
        text = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = pack.compress(f"WARC/1.1\r\n{text}\r\n".encode() + block + b"\r\n\r\n") + pack.flush()
        self.sink.write(data)
        self.n_bytes += len(data)


def _one_line(value: str | None) -> str | None:
    return None if value is None else value.replace("\r", "%0D").replace("\n", "%0A")


def _get(url: str | None) -> bytes:
    try:
        parts = urlsplit(url or "")
        host = parts.netloc
    except ValueError:
        return b"GET / HTTP/1.1\r\n\r\n"
    target = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"GET {target} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()


def _transaction(out: _Archive, row: dict, date: str) -> None:
    payload, url = row["html"].encode(), _one_line(row["url"])
    head_id = _urn(row["key"]) if row["anchor"] else out.fresh_id()
    digest = "sha1:" + row["digest"]
    about = [("WARC-Target-URI", url), ("WARC-Concurrent-To", head_id)]
    out.add("request", out.fresh_id(), date, _get(url), "application/http;msgtype=request", about)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if row["revisits"]:
        out.add("revisit", head_id, date, http, "application/http;msgtype=response", [
            ("WARC-Target-URI", url), ("WARC-Payload-Digest", digest), ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", _urn(row["key"]))])
    else:
        out.add("response", head_id, date, http + payload, "application/http;msgtype=response",
                [("WARC-Target-URI", url), ("WARC-Payload-Digest", digest)])
    fields = "" if row["id"] is None else f"pageId: {quote(row['id'], safe='')}\r\n"
    out.add("metadata", out.fresh_id(), date, fields.encode(), "application/warc-fields", about)


def write(pages: DataFrame, path: str, min_bytes: int = 0, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES,
          id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write archives of ``pages`` into the folder ``path``; the table (``archive``, ``n_records``, ``n_bytes``) of them."""
    spark = pages.sparkSession
    uri = qualified(spark, path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pf.FileSystem.from_uri(uri)
        out, done = None, []
        for batch in cut(batches, "html"):
            for row in batch.to_pylist():
                if out is None:
                    out = _Archive(files, folder)
                _transaction(out, row, date)
                if out.n_bytes >= archive_bytes:
                    out.sink.close()
                    done.append(out)
                    out = None
        if out is not None:
            out.sink.close()
            done.append(out)
        yield pa.RecordBatch.from_arrays([pa.array([f"{uri}/{a.name}.warc.gz" for a in done], pa.string()),
                                          pa.array([a.n_records for a in done], pa.int64()),
                                          pa.array([a.n_bytes for a in done], pa.int64())], ["archive", "n_records", "n_bytes"])

    rows = marked(pages, min_bytes, id_col, url_col, html_col).withColumn("id", F.col("id").cast("string"))
    return materialize(rows.mapInArrow(store, "archive string, n_records long, n_bytes long"), "archives")


def listed(spark: SparkSession, pattern: str) -> DataFrame:
    """The table of archives that ``pattern`` matches; only names are read."""
    return spark.read.format("binaryFile").load(pattern).select(F.col("path").alias("archive"))


def _line(stream) -> bytes:
    line = stream.readline()
    if not line.endswith(b"\n"):
        raise EOFError("a record breaks off")
    return line.rstrip(b"\r\n")


def _fields(stream) -> list[tuple[str, str]]:
    """Named fields up to an empty line; a line that begins with white space continues the last."""
    out: list[tuple[str, str]] = []
    while line := _line(stream):
        text = line.decode("utf-8", "replace")
        if text[0] in " \t" and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        else:
            name, _, value = text.partition(":")
            out.append((name.strip().lower(), value.strip()))
    return out


class _Block:
    """The ``size`` bytes of a record's block."""

    def __init__(self, stream, size: int) -> None:
        self.stream, self.left = stream, size

    def readline(self) -> bytes:
        line = self.stream.readline(self.left)
        self.left -= len(line)
        return line

    def pieces(self) -> Iterator[bytes]:
        while self.left:
            piece = self.stream.read(min(PIECE, self.left))
            if not piece:
                raise EOFError("a record breaks off")
            self.left -= len(piece)
            yield piece


def _bare(value: str | None) -> str | None:
    return value and value.strip("<>").removeprefix("urn:uuid:")


def parse(stream, payloads: bool = False) -> Iterator[dict]:
    """The records of an opened archive, gzipped or plain, in order."""
    while start := stream.readline():
        if not start.strip():
            continue
        if not start.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = _fields(stream)
        named = dict(reversed(head))
        block = _Block(stream, int(named.get("content-length", 0)))
        kind, fields, body = named.get("warc-type"), [], None
        hashed, size = hashlib.sha1(usedforsecurity=False), 0
        if kind in HEADS and block.left:
            while line := block.readline().rstrip(b"\r\n"):  # status and HTTP header, as far as the block goes
                name, _, value = line.decode("utf-8", "replace").partition(":")
                fields.append((name.strip().lower(), value.strip()))
        elif kind == "metadata" and named.get("content-type") == "application/warc-fields":
            while block.left:
                name, colon, value = block.readline().decode("utf-8", "replace").partition(":")
                if colon:
                    fields.append((name.strip().lower(), value.strip()))
        kept = []
        for piece in block.pieces():
            hashed.update(piece)
            size += len(piece)
            if payloads:
                kept.append(piece)
        if payloads and kind not in PARTS:
            body = b"".join(kept)
        stated = named.get("warc-payload-digest", "").rpartition(":")[2] or None
        yield {"record_id": _bare(named.get("warc-record-id")), "kind": kind,
               "concurrent": [_bare(v) for k, v in head if k == "warc-concurrent-to"], "refers_to": _bare(named.get("warc-refers-to")),
               "target_uri": named.get("warc-target-uri"), "date": named.get("warc-date"),
               "digest": stated if kind == "revisit" else base64.b32encode(hashed.digest()).decode(), "n_bytes": size,
               "fields": list(dict(reversed(fields)).items()), "payload": body}


def records(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of ``archives`` (column ``archive``), with ``payload`` if asked for.

    ``digest`` is computed over the payload; that of a revisit, which has none, is the stated one.
    """
    schema = RECORD + (", payload binary" if payloads else "")
    arrow = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("concurrent", pa.list_(pa.string())),
                       ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("digest", pa.string()),
                       ("n_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())),
                       *([("payload", pa.binary())] if payloads else [])])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                files, path = pf.FileSystem.from_uri(uri)
                opened = files.open_input_stream(path, compression=None)
                with (gzip.GzipFile(fileobj=opened) if path.endswith(".gz") else io.BufferedReader(opened)) as stream:
                    held, size = [], 0
                    for record in parse(stream, payloads):
                        held.append(record)
                        size += len(record["payload"] or b"")
                        if len(held) == BATCH_ROWS or size >= PIECE:
                            yield pa.RecordBatch.from_pylist(held, arrow)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, arrow)

    # a task per archive; few names would else be read by one
    return archives.select("archive").repartition(max(1, archives.count())).mapInArrow(read, schema)


def captures(rows: DataFrame) -> DataFrame:
    """One nested row per response or revisit: ``capture_id``, ``head``, ``request``, ``metadata``, ``n_records``.

    ``rows`` are read several times: give a written table. Of several requests or metadata records of one capture the
    first by identifier is kept, all are counted. Records that no capture claims are left out.
    """
    links = rows.select("record_id", "kind", F.explode("concurrent").alias("to")).where("record_id <> to")
    # a link counts in both directions; parts look for heads
    forth = links.where(F.col("kind").isin(*PARTS)).select(F.col("record_id").alias("part"), F.col("to").alias("via"))
    back = links.select(F.col("to").alias("part"), F.col("record_id").alias("via"))
    ways = forth.union(back)
    heads = rows.where(F.col("kind").isin(*HEADS)).select(F.col("record_id").alias("via"))
    near = lookup(ways, heads.distinct(), ["via"], salt_by=["part"]).groupBy("part").agg(F.min("via").alias("capture_id"))
    far = ways.join(near.select("part"), "part", "left_anti")
    between = near.select(F.col("part").alias("via"), "capture_id")
    far = lookup(far, between, ["via"], salt_by=["part"]).groupBy("part").agg(F.min("capture_id").alias("capture_id"))
    owned = near.union(far).withColumnRenamed("part", "record_id")
    parts = rows.where(F.col("kind").isin(*PARTS)).join(owned, "record_id")
    whole = rows.where(F.col("kind").isin(*HEADS)).withColumn("capture_id", F.col("record_id")).unionByName(parts)
    nested = F.struct(*[F.col(c) for c in rows.columns])
    first = {kind: F.min_by(F.when(F.col("kind") == kind, nested), F.when(F.col("kind") == kind, F.col("record_id"))).alias(kind)
             for kind in PARTS}
    head = F.min_by(F.when(F.col("kind").isin(*HEADS), nested), F.when(F.col("kind").isin(*HEADS), F.col("record_id")))
    return whole.groupBy("capture_id").agg(head.alias("head"), *first.values(), F.count("*").alias("n_records"))


def pages_of(nested: DataFrame, id_type: str = "string") -> DataFrame:
    """``page_id``, ``url``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` of captures, a row each.

    A revisit has the length, and names the page, of the response that it refers to.
    """
    page = F.url_decode(F.try_element_at(F.col("metadata.fields"), F.lit("pageid"))).cast(id_type)
    rows = materialize(nested.select("capture_id", page.alias("page_id"), F.col("head.target_uri").alias("url"),
                                     F.col("head.n_bytes").alias("payload_bytes"), F.col("head.digest").alias("payload_digest"),
                                     F.col("head.kind").alias("record_type"), F.col("head.refers_to").alias("to")), "captures")
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type"]
    plain = rows.where("record_type = 'response'").select(*names, F.lit(None).cast(id_type).alias("refers_to"))
    sources = rows.where("record_type = 'response'").select(
        F.col("capture_id").alias("to"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("bytes"))
    again = lookup(rows.where("record_type = 'revisit'"), sources, ["to"], "left", salt_by=["capture_id"])
    return plain.union(again.withColumn("payload_bytes", F.col("bytes")).select(*names, "refers_to"))


def round_trip(pages: DataFrame, path: str | None = None, min_bytes: int = 0, id_col: str = "page_id",
               url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` to archives, read these and assemble their captures: a row of ``pages_of`` for each page."""
    path = path or scratch_path(pages.sparkSession, "warc")
    archives = write(pages, path, min_bytes, id_col=id_col, url_col=url_col, html_col=html_col)
    return pages_of(captures(materialize(records(archives), "records")), pages.schema[id_col].dataType.simpleString())
