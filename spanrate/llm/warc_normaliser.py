"""WARC archives: monolithic gzip streams rewritten as one gzip member per record.

``write_monolithic`` stores a record per page, each archive one gzip stream as crawlers and tar-like
tools leave them: nothing can be read without inflating all that comes before. ``normalise`` inflates
each stream once, writes every record as a member of its own and a sidecar index of offsets beside
the archive. On the way, records whose payload another record holds become revisit records without
the payload. ``read_records`` opens single members by the index.

Archives are rolled at ``file_bytes`` of content, so a task never holds more than one record and no
group grows with the data. Files have fresh names and only those named in a written table count, so
a task that runs twice, or is lost, leaves at most files that nobody reads.

Of equal payloads of at least ``min_bytes`` bytes the record with the largest page id is the
response; of records that repeat that id, one. Null html is an empty payload, a null id is smaller
than any other and a null url is ``urn:none``. Only id, url and html are read.

The folder must be one that every machine writes to; its scheme must be one that pyarrow opens.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanrate.llm.work import keep, new_path, send_package

SALTS = 32
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN = "file string, ordinal long, page_id long, url string, payload_bytes long, digest string"
INDEXED = "file string, ordinal long, page_id long, offset long, length long"
RECORDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string,"
    " refers_to long, payload binary"
)


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"file:/", uri):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None, file: str, ordinal: int) -> str:
    name = "" if page_id is None else page_id
    return f"<urn:page:{name}:{file}:{ordinal}>"


def record_head(kind: str, identity: str, url: str, digest: str, block: int, more: dict[str, str]) -> bytes:
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": identity,
        "WARC-Date": DATE,
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha1:{digest}",
        **more,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode()


def http_head(payload_bytes: int) -> bytes:
    return (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {payload_bytes}\r\n\r\n"
    ).encode()


def parse_fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return dict(line.split(": ", 1) for line in lines if line)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _writer(folder: str, file_bytes: int):
    def write(batches):
        system, root = open_folder(folder)
        system.create_dir(root, recursive=True)
        rows: list[tuple] = []
        file, sink, stream, size = "", None, None, 0

        def batch():
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            names = ["file", "ordinal", "page_id", "url", "payload_bytes", "digest"]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for pages in batches:
            for at in range(0, pages.num_rows, 256):
                for row in pages.slice(at, 256).to_pylist():
                    if stream is None:
                        file, size = uuid.uuid4().hex, 0
                        sink = system.open_output_stream(f"{root}/{file}.warc.gz", compression=None)
                        stream = gzip.GzipFile(fileobj=sink, mode="wb", compresslevel=1, mtime=0)
                    payload = (row["html"] or "").encode()
                    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"] or "urn:none")
                    digest = payload_digest(payload)
                    http = http_head(len(payload))
                    identity = record_id(row["page_id"], file, len(rows))
                    block = len(http) + len(payload)
                    head = record_head("response", identity, url, digest, block, {})
                    stream.write(head + http + payload + b"\r\n\r\n")
                    rows.append((file, len(rows), row["page_id"], url, len(payload), digest))
                    size += len(head) + block
                    if size >= file_bytes:
                        stream.close()
                        sink.close()
                        yield batch()
                        rows, stream = [], None
        if stream is not None:
            stream.close()
            sink.close()
            yield batch()

    return write


def write_monolithic(
    pages: DataFrame, folder: str, id_col: str, url_col: str, html_col: str, file_bytes: int
) -> DataFrame:
    """Write the archives; (file, ordinal, page_id, url, payload_bytes, digest) per record."""
    send_package(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
    )
    return keep(rows.mapInArrow(_writer(folder, file_bytes), WRITTEN), "written")


def assign_types(written: DataFrame, min_bytes: int) -> DataFrame:
    """``written`` with the record that holds the payload: holder(page_id, file, ordinal) or null."""
    place = F.struct("page_id", "file", "ordinal")
    equal = written.where(F.col("payload_bytes") >= min_bytes).groupBy("digest", "payload_bytes")
    holders = equal.agg(F.count("*").alias("n"), F.max(place).alias("holder")).where(F.col("n") > 1)
    holders = holders.select(
        "digest", "payload_bytes", "holder", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    # A payload that a third of all pages share is dealt to SALTS tasks.
    salted = written.withColumn("salt", F.pmod(F.xxhash64("file", "ordinal"), F.lit(SALTS)).cast("int"))
    joined = salted.join(holders, ["digest", "payload_bytes", "salt"], "left")
    own = (F.col("holder.file") == F.col("file")) & (F.col("holder.ordinal") == F.col("ordinal"))
    return joined.withColumn("holder", F.when(~own, F.col("holder"))).drop("salt")


class Inflated:
    """Records of one gzip stream, one at a time."""

    def __init__(self, source):
        self.stream = gzip.GzipFile(fileobj=source, mode="rb")

    def __iter__(self):
        while True:
            head = self._until_blank()
            if not head:
                return
            fields = parse_fields(head)
            block = self._exactly(int(fields["Content-Length"]))
            if self._exactly(4) != b"\r\n\r\n":
                raise ValueError("a record does not end with two line breaks")
            yield head, fields, block

    def _until_blank(self) -> bytes:
        lines = []
        while True:
            line = self.stream.readline()
            if not line:
                if lines:
                    raise ValueError("the stream ends inside a record's head")
                return b""
            if line == b"\r\n":
                return b"".join(lines)
            lines.append(line)

    def _exactly(self, n: int) -> bytes:
        data = self.stream.read(n)
        if len(data) != n:
            raise ValueError("the stream ends inside a record")
        return data


def _normaliser(source: str, target: str, level: int):
    def normalise(frame: pd.DataFrame) -> pd.DataFrame:
        file = frame["file"].iloc[0]
        frame = frame.sort_values("ordinal")
        system, root = open_folder(source)
        out_system, out_root = open_folder(target)
        out_system.create_dir(out_root, recursive=True)
        fresh = uuid.uuid4().hex
        offsets, lengths, offset = [], [], 0
        with (
            system.open_input_stream(f"{root}/{file}.warc.gz", compression=None) as raw,
            out_system.open_output_stream(f"{out_root}/{fresh}.warc.gz", compression=None) as out,
        ):
            records = zip(Inflated(raw), frame.itertuples(), strict=True)
            for (head, fields, block), row in records:
                content = head + b"\r\n" + block
                if isinstance(row.holder_file, str):
                    content = _revisit(fields, block, row)
                member = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = member.compress(content + b"\r\n\r\n") + member.flush()
                out.write(data)
                offsets.append(offset)
                lengths.append(len(data))
                offset += len(data)
        ids = [None if pd.isna(x) else int(x) for x in frame["page_id"]]
        with out_system.open_output_stream(f"{out_root}/{fresh}.idx", compression=None) as side:
            for row in zip(offsets, lengths, ids, frame["url"], frame["digest"], strict=True):
                side.write(("\t".join("" if x is None else str(x) for x in row) + "\n").encode())
        return pd.DataFrame(
            {
                "file": fresh,
                "ordinal": range(len(offsets)),
                "page_id": pd.array(ids, "Int64"),
                "offset": offsets,
                "length": lengths,
            }
        )

    return normalise


def _revisit(fields: dict[str, str], block: bytes, row) -> bytes:
    """The record without its payload, pointing at the one that holds it."""
    http = block[: block.index(b"\r\n\r\n") + 4]
    held = None if pd.isna(row.holder_page) else int(row.holder_page)
    more = {
        "WARC-Profile": PROFILE,
        "WARC-Refers-To": record_id(held, row.holder_file, int(row.holder_ordinal)),
    }
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    head = record_head("revisit", fields["WARC-Record-ID"], fields["WARC-Target-URI"], digest, len(http), more)
    return head + http


def normalise(written: DataFrame, source: str, target: str, level: int = 6) -> DataFrame:
    """Rewrite the archives named in ``written`` (with ``holder``); the index, a row per member."""
    rows = written.select(
        "file",
        "ordinal",
        "page_id",
        "url",
        "digest",
        F.col("holder.page_id").alias("holder_page"),
        F.col("holder.file").alias("holder_file"),
        F.col("holder.ordinal").alias("holder_ordinal"),
    )
    groups = by_file(rows).groupBy("file")
    return keep(groups.applyInPandas(_normaliser(source, target, level), INDEXED), "index")


def by_file(rows: DataFrame) -> DataFrame:
    """A partition per archive: its rows are few, its bytes are not, so none may be put together."""
    files = rows.select("file").distinct().count()
    return rows.repartition(max(1, files), "file")


def parse_member(data: bytes) -> dict:
    """One record from the bytes of its member."""
    content = zlib.decompress(data, 31)
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = parse_fields(head)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page, refers = (_page(fields.get(k)) for k in ("WARC-Record-ID", "WARC-Refers-To"))
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and payload_digest(payload) != digest:
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not fit its digest")
    return {
        "page_id": page,
        "url": fields["WARC-Target-URI"],
        "payload_bytes": int(parse_fields(http)["Content-Length"]),
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": refers,
        "payload": None if revisit else payload,
    }


def _page(identity: str | None) -> int | None:
    name = identity.split(":")[2] if identity else ""
    return int(name) if name else None


def _reader(folder: str, names: list[str]):
    kinds = {
        "page_id": pa.int64(),
        "url": pa.string(),
        "payload_bytes": pa.int64(),
        "payload_digest": pa.string(),
        "record_type": pa.string(),
        "refers_to": pa.int64(),
        "payload": pa.binary(),
    }
    schema = pa.schema([(k, kinds[k]) for k in names])

    def read(batches):
        system, root = open_folder(folder)
        name, source = "", None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["file"] != name:
                    if source is not None:
                        source.close()
                    name = row["file"]
                    source = system.open_input_file(f"{root}/{name}.warc.gz")
                source.seek(row["offset"])
                record = parse_member(source.read(row["length"]))
                rows.append({k: record[k] for k in names})
                if len(rows) == 256:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
        if source is not None:
            source.close()

    return read


def read_records(index: DataFrame, folder: str, columns: list[str] | None = None) -> DataFrame:
    """The records that ``index`` names; ``payload`` is null for revisits."""
    send_package(index.sparkSession)
    wanted = [x.strip().split(" ") for x in RECORDS.split(",")]
    names = columns or [n for n, _ in wanted]
    schema = ", ".join(f"{n} {k}" for n, k in wanted if n in names)
    names = [n for n, _ in wanted if n in names]
    rows = by_file(index.select("file", "offset", "length")).sortWithinPartitions("file", "offset")
    return rows.mapInArrow(_reader(folder, names), schema)


def archive_pages(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
    file_bytes: int = 64 << 20,
    level: int = 6,
) -> tuple[DataFrame, str]:
    """Write and normalise archives of ``pages``; the index and the folder of the archives."""
    source = new_path(pages.sparkSession, "warc-monolithic")
    target = new_path(pages.sparkSession, "warc")
    written = write_monolithic(pages, source, id_col, url_col, html_col, file_bytes)
    return normalise(assign_types(written, min_bytes), source, target, level), target
