"""WARC derivatives: metadata and plain-text conversion records of response records.

Every response gives a `metadata` record (JSON: the source record's headers, all of them, its HTTP status and
headers, title, meta tags and links of the page) and a `conversion` record (the page's text). Both
carry the response's target URI and date, refer to it by WARC-Refers-To, name each other by
WARC-Concurrent-To, and keep its digests; their own blocks have digests too. Record ids follow from
the source's id, so a job that runs again makes the same records. One pass, no shuffle.

Markup is read tag by tag in time linear in the page: comments, scripts, styles and the like go (an
unclosed one takes the rest of the page, as in browsers; a self-closed svg or math is empty), block elements break
lines, other tags vanish, character references are decoded, runs of white space become one blank or line break. A quoted
attribute may hold '>'.

:func:`write_warc` writes records to WARC files.

Defined results: HTTP headers that come more than once keep all their values, in order; a null page is a response without payload and gives an empty conversion; a null
URI has no WARC-Target-URI header; a null page_id stays null; equal rows give equal records; bytes
that are not UTF-8 are replaced in the derived text, not in the digests; other columns pass by unread.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comparo.llm.tables import table

DATE = "2024-01-01T00:00:00Z"
VERSION = "WARC/1.1"
#: Headers of a source record that hold for what is derived from it too.
CARRIED = ("warc-warcinfo-id", "warc-identified-payload-type", "warc-ip-address")

#: What stands in a tag after its name: quoted values may hold '>'; a quote without its partner is a sign like others.
_REST = r"""(?:(?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+(?=>)|[^<>]*+)"""
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|(?:svg|math)(?!\b" + _REST.replace("(?=>)", "(?<=/)(?=>)").replace(
    "|[^<>]*+)", "|[^<>]*+(?<=/)(?=>))") + r")|iframe)\b" + _REST + r">.*?(?:</\1\s*>|\Z)"
                     r"|<head\b" + _REST + r">.*?(?:</head\s*>|(?=<body\b)|\Z)|<[!?][^<>]*>", re.S | re.I)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|caption|dd|details|div|dl|dt|fieldset|"
                    r"figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|option|p|pre|"
                    r"section|select|summary|table|tbody|td|textarea|tfoot|th|thead|tr|ul)\b" + _REST + ">", re.I)
_TAG = re.compile(r"</?[a-z]" + _REST + ">", re.I)
_TITLE = re.compile(r"<title\b" + _REST + r">(.*?)(?:</title\s*>|\Z)", re.S | re.I)
_LINKED = re.compile(r"<(a|area|base|link|img|script|iframe|form|source|embed|video|audio|object)\b(" + _REST + ")>", re.I)
_META = re.compile(r"<meta\b(" + _REST + ")>", re.I)
_ATTRIBUTE = re.compile(r"""([a-z][a-z0-9:_-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+))""", re.I)
_SPACE = re.compile(r"[^\S\n]+")
_LINES = re.compile(r"\s*\n\s*")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def plain_text(page: str) -> str:
    text = _TAG.sub("", _BLOCK.sub("\n", _HIDDEN.sub(" ", page)))
    return _LINES.sub("\n", _SPACE.sub(" ", html.unescape(text))).strip()


def _attributes(text: str) -> dict[str, str]:
    return {m[0].lower(): html.unescape(m[1] or m[2] or m[3]) for m in reversed(_ATTRIBUTE.findall(text))}


def page_metadata(page: str) -> dict:
    """Title, meta tags and links in the order of the page."""
    page = _COMMENT.sub(" ", page)
    title = _TITLE.search(page)
    links = []
    for tag, rest in _LINKED.findall(page):
        own = _attributes(rest)
        for name in ("href", "src", "action", "data"):
            if name in own:
                links.append({"path": f"{tag.upper()}@/{name}", "url": own[name]})
    return {"Title": " ".join(html.unescape(title[1]).split()) if title else None,
            "Metas": [m for m in map(_attributes, _META.findall(page)) if m], "Links": links}


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record; headers without a value are left out."""
    lines = [VERSION, *[f"{k}: {v}" for k, v in headers if v is not None], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """(headers, block) of concatenated records."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if version != VERSION:
            raise ValueError(f"not a record: {version[:20]!r}")
        headers = dict(line.split(": ", 1) for line in lines)
        size = int(headers["Content-Length"])
        out.append((headers, data[end + 4:end + 4 + size]))
        if data[end + 4 + size:end + 8 + size] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        at = end + 8 + size
    return out


def _id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source}#{kind}')}>"


def http_headers(lines: list[str]) -> dict:
    """Header fields by name; one that is repeated has the list of its values. A folded line goes on with the line before it."""
    fields: list[list[str]] = []
    for line in lines:
        if line[:1] in " \t" and fields:
            fields[-1][1] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            fields.append([name.strip(), value.strip()])
    out: dict = {}
    for name, value in fields:
        same = next((k for k in out if k.lower() == name.lower()), None)
        if same is None:
            out[name] = value
        else:
            out[same] = [*(out[same] if isinstance(out[same], list) else [out[same]]), value]
    return out


def _one_line(value: str | None) -> str | None:
    return None if value is None else re.sub(r"[\r\n]+", " ", value)


def derive(record_id: str, target: str | None, date: str, block: bytes, headers: list | None = None) -> list[tuple]:
    """(type, id, content type, block, record) of the metadata and the conversion record; `headers` are the source record's
    own, (name, value) pairs, kept as they stand beside those that follow from the block."""
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    page = payload.decode("utf-8", "replace")
    target = _one_line(target)
    digests = {"WARC-Block-Digest": digest(block), "WARC-Payload-Digest": digest(payload)}
    source = {"WARC-Type": "response", "WARC-Record-ID": record_id, "WARC-Target-URI": target, "WARC-Date": date,
              **digests, "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    given = http_headers([f"{k}: {_one_line(v)}" for k, v in headers or () if v is not None])
    source = {k: v for k, v in source.items() if k.lower() not in {g.lower() for g in given}} | given
    version, _, reason = status.partition(" ")
    code, _, message = reason.partition(" ")
    described = {"Envelope": {
        "WARC-Header-Metadata": {k: v for k, v in source.items() if v is not None},
        "Payload-Metadata": {"HTTP-Response-Metadata": {
            "Response-Message": {"Version": version, "Status": code, "Reason": message},
            "Headers": http_headers(lines),
            "Headers-Length": len(head) + 4, "Entity-Length": len(payload),
            "HTML-Metadata": page_metadata(page)}}}}
    ids = {kind: _id(record_id, kind) for kind in ("metadata", "conversion")}
    blocks = {"metadata": ("application/json", json.dumps(described, ensure_ascii=False, sort_keys=True).encode()),
              "conversion": ("text/plain", plain_text(page).encode())}
    out = []
    kept = [(k, v) for k, v in headers or () if k.lower() in CARRIED]
    for kind, other in (("metadata", "conversion"), ("conversion", "metadata")):
        kind_of, own = blocks[kind]
        fields = [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Refers-To", record_id),
                   ("WARC-Concurrent-To", ids[other]), ("WARC-Target-URI", target), ("WARC-Date", date),
                   ("WARC-Source-Block-Digest", digests["WARC-Block-Digest"]),
                   ("WARC-Source-Payload-Digest", digests["WARC-Payload-Digest"]),
                   ("WARC-Block-Digest", digest(own)), ("Content-Type", kind_of), *kept]
        out.append((kind, ids[kind], ids[other], kind_of, len(own), digest(own), digests["WARC-Block-Digest"],
                    digests["WARC-Payload-Digest"], own.decode(), record(fields, own)))
    return out


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(page_id, record_id, target_uri, date, block): pages as the response records of their fetch."""
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    key = F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")),
                      F.coalesce("url", F.lit("")), F.md5(payload))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.length(payload).cast("string"), F.lit("\r\n\r\n")).cast("binary")
    return pages.select(
        F.col("page_id").cast("long"),
        F.concat(F.lit("<urn:uuid:"), F.regexp_replace(
            F.md5(key.cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">")).alias("record_id"),
        F.col("url").cast("string").alias("target_uri"), F.lit(date).alias("date"), F.concat(head, payload).alias("block"))


_FIELDS = (("page_id", pa.int64()), ("warc_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()),
           ("concurrent_to", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()),
           ("content_type", pa.string()), ("content_length", pa.int64()), ("block_digest", pa.string()),
           ("source_block_digest", pa.string()), ("source_payload_digest", pa.string()), ("block", pa.string()),
           ("record", pa.binary()))


def derivatives(records: DataFrame, piece: int = 256) -> DataFrame:
    """Two rows for every response: fields, block and the whole record as bytes. Of `records` the columns of
    :func:`responses` are read and, if it is there, `warc_headers`, an array of (name, value) of the source record's headers."""
    schema = pa.schema(_FIELDS)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for at in range(0, batch.num_rows, piece):
                out = []
                for r in batch.slice(at, piece).to_pylist():
                    for kind, own, other, kind_of, size, own_digest, block, payload, text, whole in derive(
                            r["record_id"], r["target_uri"], r["date"], r["block"],
                            [(h["name"], h["value"]) for h in r.get("warc_headers") or ()]):
                        out.append((r["page_id"], kind, own, r["record_id"], other, r["target_uri"], r["date"], kind_of,
                                    size, own_digest, block, payload, text, whole))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    more = ["warc_headers"] if "warc_headers" in records.columns else []
    return records.select("page_id", "record_id", "target_uri", "date", "block", *more).mapInArrow(
        run, ", ".join(f"{n} {names[t]}" for n, t in _FIELDS))


def write_warc(derived: DataFrame, path: str) -> None:
    """Write the records of :func:`derivatives` to WARC files in the new folder `path`, one a task.

    A record ends with two line ends; Spark's text writer ends each row with one, which is the second of them.
    """
    rows = derived.select(F.expr("substring(record, 1, length(record) - 2)").cast("string").alias("value"))
    rows.write.option("lineSep", "\r\n").option("compression", "none").text(path)


def op10_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all pages."""
    return derivatives(responses(table(spark, sf_dir, "pages")))
