"""WARC derivatives: metadata and plain-text conversion records of responses.

Every response gives a metadata record (application/warc-fields: the source's digest, length, type,
HTTP headers, title, language and number of links) and a conversion record (its visible text). Both
refer to the response's WARC-Record-ID, keep its target URI and date, and carry block digests of
their own. derive() is column expressions only; read_records(), response_rows() and serialise() handle
bytes in Python.

The source's digests are kept: derive() takes WARC-Payload-Digest and WARC-Block-Digest and the body's
bytes from the optional columns source_payload_digest, source_block_digest and source_body, as
response_rows() gives them. Digest and length of the source are those of its bytes; source_digest is
the one the source declares, else the body's SHA-256. A body's text is decoded by its declared
charset (UTF-8 if there is none or an unknown one) after its declared transfer and content encodings
(chunked, gzip, deflate); bytes that do not decode become U+FFFD, and a body whose encoding is broken
or another one is decoded as it stands.

Defined cases: a null or empty payload gives both records, the conversion with an empty block; null
URI, date or headers leave those lines out; a null record_id leaves WARC-Refers-To out, and the
derived ids then come from the payload alone; a very long payload, or one tag with very many
attributes, is read whole, with a stack that does not grow with it; rows that repeat a response repeat its records; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import codecs
import gzip
import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinesieve.functions.rotation import let

#: Elements without visible text, elements that break lines, and named entities.
HIDDEN = ("script", "style", "noscript", "template", "svg", "head")
BREAKING = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "©", "reg": "®", "trade": "™", "middot": "·", "hellip": "…", "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "bull": "•", "euro": "€", "pound": "£", "deg": "°", "times": "×", "amp": "&"}
#: The rest of a tag, quoted values included. Nothing in it can match in two ways, so its repeats are
#: possessive: Java then walks them in a loop, where it would go one call deeper for each attribute.
INSIDE = r"""[^'">]*+(?:"[^"]*+"[^'">]*+|'[^']*+'[^'">]*+)*+>"""
CRLF = "\r\n"
#: Bytes of a gzip member that are unpacked at a time.
PIECE = 1 << 16


def decoded(text: Column) -> Column:
    """Character references resolved, each once; unknown ones stay as they are."""

    def one(part: Column, i: Column) -> Column:
        number = F.regexp_extract(part, r"^#([0-9]{1,7});", 1)
        code = F.regexp_extract(part, r"^#[xX]([0-9a-fA-F]{1,6});", 1)
        value = F.when(number != "", number.cast("int")).when(code != "", F.conv(code, 16, 10).cast("int"))
        sound = value.between(1, 0xD7FF) | value.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(value), 8, "0")), "UTF-32")
        rest = F.regexp_replace(part, r"^#[xX]?[0-9a-fA-F]{1,7};", "")
        name = F.regexp_extract(part, r"^([a-z]{2,6});", 1)
        named = F.create_map(*[F.lit(x) for k, v in ENTITIES.items() for x in (k, v)])
        known = F.try_element_at(named, name)
        return (
            F.when(i == 0, part)
            .when(sound, F.concat(char, rest))
            .when(known.isNotNull(), F.concat(known, F.substr(part, F.length(name) + 2)))
            .otherwise(F.concat(F.lit("&"), part))
        )

    return F.when(F.instr(text, "&") == 0, text).otherwise(F.array_join(F.transform(F.split(text, "&", -1), one), ""))


def tidy(text: Column) -> Column:
    """Runs of blanks as one space, no blanks at line ends, no empty lines."""
    text = F.regexp_replace(text, r"[ \t\r\f\x0b\xa0]+", " ")
    text = F.regexp_replace(text, r" *\n[ \n]*", "\n")
    return F.btrim(text, F.lit(" \n"))


#: Bytes from which a page is looked at for closers first.
LONG = 1 << 14


def up_to_last(text: Column, closer: str, change: Callable[[Column], Column]) -> Column:
    """change(text), which only matches what `closer` (a pattern) ends. It sees what comes before the
    last closer alone: behind it every opener would be tried up to the end in vain."""
    head = F.regexp_extract(text, rf"(?is)^.*{closer}", 0)
    return let(head, lambda h: F.concat(change(h), F.substr(text, F.length(h) + 1)))


#: A page's text is what these leave of it, one after another: (pattern, what takes its place, closer). The
#: head goes after the other hidden elements, as scripts in it may quote its end.
STEPS = [
    (r"(?s)<!--.*?-->", " ", "-->"),
    *[(rf"(?is)<({'|'.join(names)})(?:\s[^>]*)?>.*?</\1\s*>", " ", rf"</(?:{'|'.join(names)})\s*>") for names in (HIDDEN[:-1], HIDDEN[-1:])],
    (r"[\r\n]+", " ", None),
    (rf"(?i)</?(?:{BREAKING})(?:[\s/]{INSIDE}|>)", "\n", ">"),
    (rf"</?[a-zA-Z!?]{INSIDE}", "", ">"),
]


def stripped(html: Column, steps: list[tuple[str, str, str | None]], cautious: bool) -> Column:
    if not steps:
        return html
    (pattern, by, closer), *others = steps
    change = lambda x: F.regexp_replace(x, pattern, by)
    if not cautious:
        return stripped(change(html), others, cautious)
    return let(up_to_last(html, closer, change) if closer else change(html), lambda x: stripped(x, others, cautious))


def by_length(html: Column, short: Column, long: Column) -> Column:
    """Both give the same; the second takes linear time on pages whose openers nothing closes."""
    return F.when(F.octet_length(html) < LONG, short).otherwise(long)


def visible_text(html: Column) -> Column:
    return let(by_length(html, stripped(html, STEPS, False), stripped(html, STEPS, True)), lambda x: tidy(decoded(x)))


def found_in(html: Column, closer: str, look: Callable[[Column], Column]) -> Column:
    """look(html), for which nothing behind the last closer counts."""
    return by_length(html, look(html), let(F.regexp_extract(html, rf"(?is)^.*{closer}", 0), look))


def title_of(html: Column) -> Column:
    inside = found_in(html, "</title", lambda x: F.regexp_extract(x, r"(?is)<title(?:\s[^>]*)?>(.*?)</title", 1))
    return let(F.regexp_replace(inside, r"[\r\n]+", " "), lambda x: tidy(decoded(x)))


def uuid_of(text: Column) -> Column:
    """A record id made from a text: the same text has the same id on every run."""
    h = F.md5(text)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def line(name: str, value: Column, end: str = CRLF) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(end))).otherwise("")


def responses_of(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Crawled pages(page_id, url, html) as responses; ids come from the page's id and address."""
    return pages.select(
        F.col("page_id"),
        uuid_of(F.concat(F.lit("response "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(" "), F.coalesce("url", F.lit("")))).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.lit("Content-Type: text/html; charset=utf-8").alias("http_headers"),
        F.col("html").alias("payload"),
    )


def derive(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two records for each response(record_id, target_uri, date, http_headers, payload), with the
    columns named in `keep` beside them: type, record_id, refers_to, target_uri, date, content_type,
    content_length, block_digest, source_digest, headers (the WARC header block) and block. Optional
    columns: source_body (binary), source_payload_digest and source_block_digest."""
    given = [x for x in ("source_body", "source_payload_digest", "source_block_digest") if x in responses.columns and x not in keep]
    payload = F.coalesce(F.col("payload"), F.lit(""))
    base = responses.select(*keep, *given, "record_id", "target_uri", "date", "http_headers", payload.alias("payload"))
    body = F.coalesce(F.col("source_body"), F.col("payload").cast("binary")) if "source_body" in base.columns else F.col("payload")
    declared = F.col("source_payload_digest") if "source_payload_digest" in base.columns else None
    base = base.withColumn("source_digest", digest(body) if declared is None else F.coalesce(declared, digest(body))).withColumn("text", visible_text(F.col("payload")))
    language = lambda x: F.regexp_extract(x, r"""(?is)<html\s[^>]*?lang\s*=\s*["']?([a-zA-Z-]+)""", 1)
    base = base.withColumns({"__title": title_of(F.col("payload")), "__lang": found_in(F.col("payload"), r"""lang\s*=\s*["']?[a-zA-Z-]+""", language)})
    title, found = F.col("__title"), F.col("__lang")
    fields = F.concat(
        line("source-payload-digest", F.col("source_digest")),
        *([line("source-body-digest", F.when(declared.isNotNull(), digest(body)))] if declared is not None else []),
        *([line("source-block-digest", F.col("source_block_digest"))] if "source_block_digest" in base.columns else []),
        line("source-content-length", F.octet_length(body)),
        F.array_join(F.transform(F.filter(F.split(F.coalesce("http_headers", F.lit("")), "\r?\n"), lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("source-header: "), F.btrim(x), F.lit(CRLF))), ""),
        line("title", F.when(title != "", title)),
        line("html-lang", F.when(found != "", found)),
        line("outlinks", found_in(F.col("payload"), "href", lambda x: F.regexp_count(x, F.lit(r"(?i)<a\s[^>]*href")))),
    )
    record = lambda kind, mime, block: F.struct(F.lit(kind).alias("type"), F.lit(mime).alias("content_type"), block.alias("block"))
    both = base.select("*", F.explode(F.array(record("metadata", "application/warc-fields", fields), record("conversion", "text/plain", F.col("text")))).alias("r"))
    out = both.select(*keep, F.col("r.type").alias("type"), F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("r.content_type").alias("content_type"), F.col("r.block").alias("block"), "source_digest")
    out = out.withColumn("record_id", uuid_of(F.concat("type", F.lit(" "), F.coalesce("refers_to", "source_digest"))))
    out = out.withColumn("content_length", F.octet_length("block").cast("long")).withColumn("block_digest", digest(F.col("block")))
    headers = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Date", F.col("date")),
        line("WARC-Block-Digest", F.col("block_digest")),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", F.col("content_length")),
    )
    return out.withColumn("headers", headers).select(*keep, "type", "record_id", "refers_to", "target_uri", "date", "content_type", "content_length", "block_digest", "source_digest", "headers", "block")


def serialise(records: DataFrame) -> DataFrame:
    """(record_id, member): each record as a gzip member; a WARC file is members one after another."""

    @F.pandas_udf("binary")
    def member(headers: pd.Series, block: pd.Series) -> pd.Series:
        return pd.Series([gzip.compress(h.encode() + b"\r\n" + b.encode() + b"\r\n\r\n", 6, mtime=0) for h, b in zip(headers, block)])

    return records.select("record_id", member("headers", "block").alias("member"))


def members_of(data: bytes) -> Iterator[bytes]:
    """The parts of a WARC file: its gzip members unpacked, or what is not gzipped as it stands."""
    view, at = memoryview(data), 0
    while at < len(data):
        if data[at : at + 2] != b"\x1f\x8b":
            yield data[at:]
            return
        stream, out = zlib.decompressobj(31), []
        while not stream.eof and at < len(data):
            out.append(stream.decompress(view[at : at + PIECE]))
            at = min(len(data), at + PIECE) - len(stream.unused_data)
        yield b"".join(out)


def parse_members(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a WARC file, gzipped or plain."""
    for part in members_of(data):
        at = 0
        while at < len(part):
            if part[at] in b"\r\n":
                at += 1
                continue
            end = part.find(b"\r\n\r\n", at)
            head = part[at:] if end < 0 else part[at:end]
            at = len(part) if end < 0 else end + 4
            fields: dict[str, str] = {}
            for x in head.decode("utf-8", "replace").split("\r\n")[1:]:
                name, _, value = x.partition(":")
                fields[name.strip().lower()] = value.strip()
            size = int(fields.get("content-length", len(part) - at))
            yield fields, part[at : at + size]
            at += size


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, type, record_id, refers_to, target_uri, date, headers map, block) of WARC files; a file
    is one row of Spark's binaryFile source, so files are read side by side."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for where, data in zip(pdf["path"], pdf["content"]):
                for h, block in parse_members(data):
                    row = (where, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), h, block)
                    yield pd.DataFrame([row], columns=["path", "type", "record_id", "refers_to", "target_uri", "date", "headers", "block"])

    schema = "path string, type string, record_id string, refers_to string, target_uri string, date string, headers map<string,string>, block binary"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def dechunked(body: bytes) -> bytes:
    """The data of a chunked body; ValueError if it is not one."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].partition(b";")[0], 16)
        if size < 0 or end + 2 + size > len(body):
            raise ValueError("chunk size")
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def text_of(head: str, body: bytes) -> str:
    """The body's text by its HTTP headers, as the module's docstring defines it."""
    fields: dict[str, str] = {}
    for x in re.split("\r?\n", head):
        name, _, value = x.partition(":")
        fields[name.strip().lower()] = value.strip()
    try:
        data = dechunked(body) if "chunked" in fields.get("transfer-encoding", "").lower() else body
    except ValueError:
        data = body
    for kind in reversed(fields.get("content-encoding", "").lower().replace(" ", "").split(",")):
        try:
            if kind in ("gzip", "x-gzip"):
                data = gzip.decompress(data)
            elif kind == "deflate":
                try:
                    data = zlib.decompress(data)
                except zlib.error:
                    data = zlib.decompress(data, -15)
        except (OSError, EOFError, zlib.error):
            break
    found = re.search(r"""(?i)charset\s*=\s*["']?([^\s;"']+)""", fields.get("content-type", ""))
    try:
        return codecs.decode(data, found[1] if found else "utf-8", "replace")
    except (LookupError, TypeError, ValueError):
        return data.decode("utf-8", "replace")


def response_rows(records: DataFrame) -> DataFrame:
    """The responses of read_records() as derive() takes them: HTTP headers apart from the payload,
    with the source's digests and the body's bytes."""

    @F.pandas_udf("http_headers string, payload string, source_body binary")
    def parts(block: pd.Series) -> pd.DataFrame:
        rows = []
        for x in block:
            head, split, body = (b"", b"", None) if x is None else bytes(x).partition(b"\r\n\r\n")
            if body is not None and not split:
                head, body = b"", head
            head = re.sub(r"\AHTTP/[^\r\n]*(\r?\n|\Z)", "", head.decode("utf-8", "replace"))
            text = None if body is None else text_of(head, body)
            # lone surrogates, which some charsets decode to, are not text
            rows.append((head if split else None, text and text.encode("utf-8", "replace").decode(), body))
        return pd.DataFrame(rows, columns=["http_headers", "payload", "source_body"])

    digests = [F.try_element_at("headers", F.lit(f"warc-{x}-digest")).alias(f"source_{x}_digest") for x in ("payload", "block")]
    out = records.filter("type = 'response'").select("record_id", "target_uri", "date", *digests, parts("block").alias("p"))
    return out.select("record_id", "target_uri", "date", "p.*", "source_payload_digest", "source_block_digest")
