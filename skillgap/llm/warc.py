"""WARC archives: pages written as records, records read back and assembled into captures.

Archives are gzip files of WARC/1.1 records, made and read by Spark's own text
source with the empty line behind a record as separator, so they may lie in any
store that Spark reaches. A reading task streams its files piece by piece and
puts a record together by its length.

Writing. Each page gives a request, a response or revisit, and a metadata
record; the other two name the second in ``WARC-Concurrent-To``. Of pages with
equal payloads of at least ``least_bytes`` bytes, the one with the largest id
is the response (of equal ids, the later row), the others are revisits without a
payload that refer to it. A null payload counts as empty, a null address is
left out, null ids sort first. Pages must come from a source that gives the
same rows in the same order when read twice (files, a written table).
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgap.sources.scratch import materialize

_END = "\r\n\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(payload: Column) -> Column:
    """The bare base32 SHA-1: five hex digits are four base32 digits."""
    code = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(code, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), _DIGITS32, _BASE32)


def _urn(kind: str, row: Column) -> Column:
    code = F.md5(F.concat(F.lit(kind + "|"), row))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(code, a, n) for a, n in cuts]), F.lit(">"))


def _record(kind: Column, record_id: Column, date: str, block: Column, *headers: tuple[str, Column]) -> Column:
    """A record without the two line ends behind it, which the writer adds; null headers are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id)]
    lines.append(F.lit(f"WARC-Date: {date}"))
    lines += [F.concat(F.lit(name + ": "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(_END), block)


def write_archives(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html",
    date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0,
) -> None:
    """Write three records per page under ``path``; other columns of ``pages`` are left out."""
    rows = pages.select(
        F.col(key).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("body"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = rows.withColumn("digest", base32_sha1(F.col("body").cast("binary")))
    rows = rows.withColumn("size", F.octet_length("body").cast("long"))
    # One row per payload that occurs again; counted in each task before the shuffle. Staged: Spark knows
    # its size then, and pages move only if it is too large to go to every task, with hot payloads split.
    heads = materialize(
        rows.filter(F.col("size") >= least_bytes)
        .groupBy("digest", "size").agg(F.max(F.struct("id", "row")).alias("head"), F.count("*").alias("n"))
        .filter("n > 1").select("digest", "size", "head"),
        "heads",
    )
    rows = rows.join(heads, ["digest", "size"], "left")
    name = lambda id_, row: F.concat_ws("|", F.coalesce(id_.cast("string"), F.lit("null")), row.cast("string"))
    own = name(F.col("id"), F.col("row"))
    revisit = F.col("head").isNotNull() & (F.col("head.row") != F.col("row"))
    clean = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    host = F.regexp_extract(clean, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    target = F.regexp_replace(clean, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    size = F.col("size").cast("string")
    page = F.col("id").cast("string")
    second = _urn("page", own)
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), size, F.lit(_END)
    )
    ask = F.concat(
        F.lit("GET "), F.coalesce(F.nullif(F.split_part(target, F.lit("#"), F.lit(1)), F.lit("")), F.lit("/")),
        F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit(_END),
    )
    about = F.concat_ws("\r\n", F.concat(F.lit("page-id: "), page), F.concat(F.lit("payload-length: "), size), F.lit(""))
    uri = ("WARC-Target-URI", clean)
    concurrent = ("WARC-Concurrent-To", second)
    records = F.array(
        _record(F.lit("request"), _urn("request", own), date, ask, concurrent, uri,
                ("Content-Type", F.lit("application/http; msgtype=request"))),
        _record(
            F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), second, date,
            F.when(revisit, head).otherwise(F.concat(head, F.col("body"))), uri,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Refers-To", F.when(revisit, _urn("page", name(F.col("head.id"), F.col("head.row"))))),
            ("WARC-Profile", F.when(
                revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ),
        _record(F.lit("metadata"), _urn("metadata", own), date, about, concurrent, uri,
                ("Content-Type", F.lit("application/warc-fields"))),
    )
    rows.select(F.explode(records).alias("value")).write.option("lineSep", _END).option("compression", "gzip").text(path)


_RECORDS = (
    "record_id string, type string, date string, target_uri string, concurrent_to array<string>, refers_to string, "
    "payload_digest string, payload_bytes long, computed_digest string, fields map<string,string>, block binary"
)
_SCHEMA = pa.schema([
    ("record_id", pa.string()), ("type", pa.string()), ("date", pa.string()), ("target_uri", pa.string()),
    ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("payload_digest", pa.string()),
    ("payload_bytes", pa.int64()), ("computed_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())),
    ("block", pa.binary()),
])


def _parse(header: bytes, block: bytes, keep: bool) -> dict:
    """One record. A record that says no length has type ``damaged``; its header is its block."""
    named: dict[str, list[str]] = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", header).split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        named.setdefault(name.strip().lower().decode("utf-8", "replace"), []).append(value.strip().decode("utf-8", "replace"))
    one = lambda name: (named.get(name) or [None])[0]
    kind = one("warc-type") or "damaged"
    row = {
        "record_id": one("warc-record-id"), "type": kind, "date": one("warc-date"), "target_uri": one("warc-target-uri"),
        "concurrent_to": named.get("warc-concurrent-to", []), "refers_to": one("warc-refers-to"),
        "payload_digest": (one("warc-payload-digest") or "").rpartition(":")[2] or None,
        "payload_bytes": None, "computed_digest": None, "fields": [], "block": block if keep else None,
    }
    if kind in ("response", "revisit") and (one("content-type") or "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        if kind == "response":
            row["payload_bytes"] = len(payload)
            row["computed_digest"] = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        elif found := re.search(rb"(?im)^content-length:\s*(\d+)", http):
            row["payload_bytes"] = int(found[1])
    elif one("content-type") == "application/warc-fields":
        pairs = [line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n") if ":" in line]
        row["fields"] = list({a.strip(): b.strip() for a, _, b in pairs}.items())
    return row


def _records(keep: bool):
    """The function for ``mapInArrow``: fragments of files, in order, as records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        file, header, need, parts, have = None, None, 0, [], 0

        def unfinished() -> list[dict]:
            if header is None:
                return []
            return [_parse(header, b"\r\n\r\n".join(parts), keep) | {"type": "damaged"}]

        for batch in batches:
            for path, start, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if start:
                    raise ValueError(f"{path} was split; archives must be gzip files")
                if path != file:
                    rows += unfinished()
                    file, header = path, None
                while value is not None:
                    if header is None:
                        # Anything else between records is padding.
                        value = value.lstrip(b"\r\n")
                        if value.startswith(b"WARC/"):
                            found = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", value.replace(b"\r\n", b"\n"))
                            if found:
                                header, need, parts, have = value, int(found[1]), [], -len(_END)
                            else:
                                rows.append(_parse(value, value, keep) | {"type": "damaged"})
                        break
                    parts.append(value)
                    have += len(_END) + len(value)
                    value = None
                    if have >= need:
                        # A block that ends in line ends shares them with the separator; what follows is the next record.
                        block = b"\r\n\r\n".join(parts)
                        value = block[need:].lstrip(b"\r\n") or None
                        row = _parse(header, block[:need], keep)
                        rows.append(row if value is None or value.startswith(b"WARC/") else row | {"type": "damaged"})
                        held += need if keep else 0
                        header = None
                if len(rows) >= 2000 or held >= 8_000_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                    rows, held = [], 0
        rows += unfinished()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return run


def read_archives(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """One row per record of the gzip archives under ``path``; ``blocks=False`` leaves their blocks null.

    A file that ends in the middle of a record, or a record whose length is
    missing or wrong, gives a row of type ``damaged``.
    """
    fragments = spark.read.option("lineSep", _END).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("value"),
    )
    return fragments.mapInArrow(_records(blocks), _RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id``, ``response``, ``requests``, ``metadata``.

    A capture is a response, revisit or resource with all requests and metadata
    records that reach it through concurrent-to identifiers, directly or by way
    of one other record that is none of these three, in either direction. Records
    that reach none stand in a capture of their own whose response is null.
    Records of other types and damaged ones are left to the reader.

    Each row of a response, revisit or resource gives a capture. Rows of one
    identifier, as of an archive read twice, each have all records that reach
    it; requests and metadata that are equal in every column are one record read
    again and stand in a list once. A record without an identifier can name
    others but not be named; the ``capture_id`` of its own capture is null.

    Identifiers are joined on their own; the records themselves move once for
    that, requests and metadata once more for their lists.
    ``records`` is read several times, so stage it where reading it is dear.
    """
    body = [c for c in records.columns if c != "concurrent_to"]
    main, side = F.col("type").isin("response", "revisit", "resource"), F.col("type").isin("request", "metadata")
    # What has no identifier goes by its contents.
    contents = F.concat(F.lit("\0"), F.sha2(F.to_json(F.struct(*records.columns)), 256))
    name = F.when(F.col("record_id").isNotNull(), F.col("record_id")).otherwise(contents)
    ids = records.select(name.alias("name"), main.alias("main"), side.alias("side"), "concurrent_to")
    mains = ids.filter("main").select(F.col("name").alias("to")).distinct()
    said = ids.filter("side").select(F.col("name").alias("from"), F.explode("concurrent_to").alias("to"))
    back = ids.filter("main").select(F.explode("concurrent_to").alias("from"), F.col("name").alias("to"))
    reach = said.join(mains, "to").select("from", "to").union(back).distinct()
    way = reach.join(mains.select(F.col("to").alias("from")), "from", "left_anti").select(F.col("from").alias("way"), F.col("to").alias("far"))
    beside = said.select("from", F.col("to").alias("way")).union(said.select(F.col("to").alias("from"), F.col("from").alias("way")))
    further = beside.join(way, "way").select("from", F.col("far").alias("to"))
    links = reach.union(further).distinct()
    # Maps cannot be compared; their entries can.
    whole, plain = F.struct(*body), F.struct(*[F.map_entries(c).alias(c) if c == "fields" else F.col(c) for c in body])
    restored = lambda x: x.withField("fields", F.map_from_entries(x["fields"])) if "fields" in body else x
    listed = lambda k: F.transform(
        F.array_sort(
            F.collect_set(F.when(F.col("type") == k, plain)),
            lambda a, b: F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0),
        ),
        restored,
    )
    placed = records.filter(side).select(*body, name.alias("from")).join(links, "from", "left")
    lists = placed.groupBy(F.coalesce("to", F.concat(F.lit("\0lone "), "from")).alias("name")).agg(
        F.min(F.when(F.col("to").isNull(), F.col("record_id"))).alias("lone"),
        listed("request").alias("requests"), listed("metadata").alias("metadata"),
    )
    none = lambda c: F.coalesce(c, F.array().cast(lists.schema[c].dataType)).alias(c)
    found = records.filter(main).select(name.alias("name"), F.col("record_id").alias("own"), whole.alias("response"))
    return found.join(lists, "name", "full_outer").select(
        F.coalesce("own", "lone").alias("capture_id"), "response", none("requests"), none("metadata")
    )


def page_report(captures: DataFrame) -> DataFrame:
    """Per capture of a page: its payload's figures, and for a revisit the id of the page it refers to.

    Of several responses under one identifier, the largest page id is the one referred to.
    """
    page = F.element_at(F.get("metadata", F.lit(0))["fields"], "page-id").cast("long")
    kind = F.col("response.type")
    # Staged: with plain tables on both sides Spark splits a page that very many revisit. A response looks up itself.
    flat = materialize(
        captures.filter("response is not null").select(
            page.alias("page_id"), "capture_id", kind.alias("record_type"), F.col("response.payload_bytes").alias("payload_bytes"),
            F.coalesce("response.computed_digest", "response.payload_digest").alias("payload_digest"),
            F.when(kind == "revisit", F.col("response.refers_to")).otherwise(F.col("capture_id")).alias("head"),
        ),
        "captures",
    )
    # One row per identifier; staged for the same reason.
    named = materialize(
        flat.filter("record_type = 'response' AND capture_id IS NOT NULL")
        .groupBy(F.col("capture_id").alias("head")).agg(F.max("page_id").alias("named")),
        "named",
    )
    refers = F.when(F.col("record_type") == "revisit", F.col("named")).alias("refers_to")
    return flat.join(named, "head", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", refers)
