"""Linked metadata and plain-text records from WARC responses.

Every response gives one ``metadata`` record (title and outlinks as warc-fields) and
one ``conversion`` record (the page's text). Both refer to the response by its record
id and to each other, keep its target, date, HTTP headers and payload digest, and carry
digests and lengths of their own blocks. All of that is column work within a row.

``write`` puts records into gzipped WARC files, and ``read`` takes the records of such
files, ours or others', apart again: Spark cuts a file at version lines, and a record
whose block holds such a line is put together by its length. ``verified`` compares digests.

Defined results: a NULL page is an empty payload, whose conversion is empty; a NULL
url leaves the target NULL and out of the header. Record ids follow from key, type and
payload, so repeated rows give equal records and a rebuild gives the same files. A link's
address may be quoted either way or not at all. Character references are decoded once,
named ones of HTML 4 and numbers; a number that is no character is U+FFFD, and what has
no name or no semicolon stays. A file that ends within a record is an error.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: digits of base 32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Elements without text, and elements that break lines.
SILENT = ("script", "style", "noscript", "template")
BREAKING = (
    "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h1|h2|h3|h4|h5|h6|head|"
    "header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
)
#: Names of characters in HTML 4; a blank that holds words together counts as any blank.
NAMED = {"amp": "&", "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
NAMED |= {name: chr(at) for name, at in name2codepoint.items() if name not in NAMED}
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{0,31});"
NO_CHARACTER = "\ufffd"
HTTP_HEADER = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
DATE = "2024-01-01T00:00:00Z"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
_ADDRESS = r"""href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
OUTLINK = rf"(?i)<a\s(?:[^>]*?\s)?{_ADDRESS}"
#: The address of what OUTLINK found.
ADDRESS = rf"(?is)^.*?\s{_ADDRESS}$"
VERSION = "WARC/1.1\r\n"


def base32_sha1(block: Column) -> Column:
    """``sha1:`` and the base-32 digest of a text's UTF-8 bytes."""
    digest = F.sha1(block.cast("binary"))
    letters = []
    for k in range(8):
        chunk = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            place = F.shiftright(chunk, shift).bitwiseAND(F.lit(31)) + 1
            letters.append(F.substr(F.lit(BASE32), place, F.lit(1)))
    return F.concat(F.lit("sha1:"), *letters)


def record_id(*parts: Column) -> Column:
    """A name-based UUID (version 5 layout) of some texts."""
    digest = F.sha1(F.concat_ws("|", *parts).cast("binary"))
    piece = lambda at, n: F.substring(digest, at, n)
    uuid = F.concat_ws(
        "-", piece(1, 8), piece(9, 4), F.concat(F.lit("5"), piece(14, 3)), F.concat(F.lit("a"), piece(18, 3)),
        piece(21, 12),
    )
    return F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))


def decoded(text: Column) -> Column:
    """A text with its character references as characters, each step a field for the next."""
    table = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")

    def named(piece: Column, at: Column) -> Column:
        return F.struct(piece.alias("piece"), at.alias("at"), F.regexp_extract(piece, REFERENCE, 1).alias("name"))

    def character(name: Column) -> Column:
        hexadecimal = F.lower(F.substr(name, F.lit(2), F.lit(1))) == "x"
        digits = F.when(hexadecimal, F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(F.substr(name, F.lit(2)))

        def letter(number: Column) -> Column:
            valid = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
            spelled = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
            return F.when(number == 0xA0, " ").when(valid, spelled).otherwise(NO_CHARACTER)

        return _let(digits.try_cast("int"), letter)

    def joined(r: Column) -> Column:
        name, same = r["name"], F.concat(F.lit("&"), r["piece"])
        rest = F.substr(r["piece"], F.length(name) + 2)
        return (
            F.when(r["at"] == 0, r["piece"])
            .when(name == "", same)
            .when(F.left(name, F.lit(1)) == "#", F.concat(character(name), rest))
            .otherwise(F.coalesce(F.concat(F.element_at(table, name), rest), same))
        )

    return F.array_join(F.transform(F.transform(F.split(text, "&"), named), joined), "")


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _without_silent(text: Column) -> Column:
    """A page without the elements that have no text; those it lacks are not sought."""

    def cut(low: Column) -> Column:
        out = text
        for name in SILENT:
            cleared = F.regexp_replace(out, rf"(?is)<{name}(?:\s[^>]*)?>.*?</{name}\s*>", "")
            out = F.when(low.contains(f"<{name}"), cleared).otherwise(out)
        return out

    return _let(F.lower(text), cut)


def plain_text(html: Column) -> Column:
    """Text of a page: no markup, a line for each block, single blanks."""
    text = _let(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), _without_silent)
    text = F.regexp_replace(text, rf"(?i)</?(?:{BREAKING})(?:\s[^>]*)?/?>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    text = F.regexp_replace(decoded(text), r"[ \t\r\f]{2,}|[\t\r\f]", " ")
    return F.trim(F.regexp_replace(text, r" ?\n[\n ]*", "\n"), F.lit("\n "))


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages as response records: (key, record_id, target_uri, date, http_header, payload, payload_digest)."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    digest = base32_sha1(payload)
    return pages.select(
        F.col(key).alias("key"),
        record_id(F.lit("response"), name, F.coalesce(F.col(url), F.lit("")), digest).alias("record_id"),
        F.col(url).alias("target_uri"),
        F.lit(DATE).alias("date"),
        F.lit(HTTP_HEADER).alias("http_header"),
        payload.alias("payload"),
        digest.alias("payload_digest"),
    )


def _header(kind: Column) -> Column:
    """A record's WARC header; its lines end with CRLF and an empty line follows."""
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), F.col("record_id")),
        F.concat(F.lit("WARC-Refers-To: "), F.col("refers_to")),
        F.concat(F.lit("WARC-Concurrent-To: "), F.col("concurrent_to")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("target_uri")),
        F.concat(F.lit("WARC-Date: "), F.col("date")),
        F.concat(F.lit("WARC-Source-Payload-Digest: "), F.col("source_digest")),
        F.concat(F.lit("WARC-Block-Digest: "), F.col("block_digest")),
        F.concat(F.lit("Content-Type: "), F.col("content_type")),
        F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))


def derivatives(records: DataFrame) -> DataFrame:
    """Two records of each response: (key, record_type, ..., block, warc_header)."""
    title = F.regexp_replace(plain_text(F.regexp_extract("payload", TITLE, 1)), r"\s+", " ")
    links = F.regexp_extract_all("payload", F.lit(OUTLINK), F.lit(0))
    links = F.transform(links, lambda x: F.regexp_replace(decoded(F.regexp_replace(x, ADDRESS, "$1$2$3")), r"\s+", " "))
    fields = F.concat_ws(
        "\r\n",
        F.concat(F.lit("title: "), title),
        F.concat(F.lit("http-content-type: "), F.regexp_extract("http_header", r"Content-Type: ([^\r\n]*)", 1)),
        F.transform(links, lambda x: F.concat(F.lit("outlink: "), x)),
    )
    both = records.withColumns({"_meta": F.concat(fields, F.lit("\r\n")), "_text": plain_text(F.col("payload"))})
    both = both.withColumns({f"{b}_digest": base32_sha1(F.col(b)) for b in ("_meta", "_text")})
    both = both.withColumns(
        {
            f"{b}_id": record_id(F.lit(kind), F.col("record_id"), F.col(f"{b}_digest"))
            for b, kind in (("_meta", "metadata"), ("_text", "conversion"))
        }
    )

    def made(kind: str, content: str, own: str, other: str) -> Column:
        return F.struct(
            F.lit(kind).alias("record_type"),
            F.lit(content).alias("content_type"),
            F.col(own).alias("block"),
            F.col(f"{own}_digest").alias("block_digest"),
            F.col(f"{own}_id").alias("record_id"),
            F.col(f"{other}_id").alias("concurrent_to"),
        )

    built = both.select(
        "key",
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "date",
        F.col("http_header").alias("source_header"),
        F.col("payload_digest").alias("source_digest"),
        F.inline(
            F.array(
                made("metadata", "application/warc-fields", "_meta", "_text"),
                made("conversion", "text/plain", "_text", "_meta"),
            )
        ),
    )
    return built.withColumn("content_length", F.octet_length("block").cast("long")).withColumn(
        "warc_header", _header(F.col("record_type"))
    )


def response_records(records: DataFrame) -> DataFrame:
    """Responses as (warc_header, block): the HTTP header, an empty line and the payload."""
    block = F.concat(F.col("http_header"), F.lit("\r\n\r\n"), F.col("payload"))
    lines = [
        F.lit(VERSION.strip()),
        F.lit("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: "), F.col("record_id")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("target_uri")),
        F.concat(F.lit("WARC-Date: "), F.col("date")),
        F.concat(F.lit("WARC-Payload-Digest: "), F.col("payload_digest")),
        F.concat(F.lit("WARC-Block-Digest: "), base32_sha1(block)),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    header = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))
    return records.select(header.alias("warc_header"), block.alias("block"))


def write(records: DataFrame, path: str) -> None:
    """Records (warc_header, block) as WARC files, each compressed as a whole."""
    whole = F.concat("warc_header", "block").alias("value")
    records.select(whole).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(record_type, record_id, header, block) of the WARC files at ``path``; blocks are bytes.

    A gzipped file is one task's stream, with a record at a time in memory.
    """
    lines = spark.read.option("lineSep", VERSION).text(path).select(F.col("value").cast("binary").alias("value"))
    mark = VERSION.encode()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple[str, bytes]]:
            held = b""
            for batch in batches:
                for value in batch.column(0).to_pylist():
                    held = held + mark + value if held else value
                    if not held.strip():
                        held = b""
                        continue
                    head, _, rest = held.partition(b"\r\n\r\n")
                    size = int(re.search(rb"(?im)^content-length:\s*(\d+)", head).group(1))
                    if len(rest) >= size:
                        yield head.decode("utf-8", "replace"), rest[:size]
                        held = b""
            if held:
                raise ValueError("a WARC file ends within a record")

        for header, block in records():
            yield pa.RecordBatch.from_arrays([pa.array([header]), pa.array([block], pa.binary())], names=["header", "block"])

    found = lines.mapInArrow(whole, "header string, block binary")
    return found.select(field("WARC-Type").alias("record_type"), field("WARC-Record-ID").alias("record_id"), "header", "block")


def field(name: str) -> Column:
    """A header's field; NULL where it isn't there."""
    return F.nullif(F.regexp_extract("header", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def read_responses(records: DataFrame) -> DataFrame:
    """The response records of ``read`` as ``responses`` gives them; the key is the record id.

    Payloads are taken as UTF-8; what is none becomes U+FFFD and fails the digest.
    """
    text = F.decode("block", "UTF-8")
    end = F.instr(text, "\r\n\r\n")
    return records.filter("record_type = 'response'").select(
        F.col("record_id").alias("key"),
        "record_id",
        field("WARC-Target-URI").alias("target_uri"),
        field("WARC-Date").alias("date"),
        F.substr(text, F.lit(1), end - 1).alias("http_header"),
        F.substr(text, end + 4).alias("payload"),
        field("WARC-Payload-Digest").alias("payload_digest"),
    )


def verified(records: DataFrame) -> DataFrame:
    """``read``'s records with ``intact``: whether the block's digest is the one stated; NULL if none is."""
    return records.withColumn("intact", field("WARC-Block-Digest") == base32_sha1(F.col("block")))


def derivatives_sql() -> str:
    """The same records of ``pages`` in DuckDB's SQL, without the WARC header."""

    def digest(block: str) -> str:
        pick = " || ".join(
            f"substr('{BASE32}', ((('0x' || substr(sha1({block}), i * 5 + 1, 5)) :: INTEGER >> {s}) & 31) + 1, 1)"
            for s in (15, 10, 5, 0)
        )
        return f"'sha1:' || array_to_string(list_transform(range(8), lambda i: {pick}), '')"

    def uuid(name: str) -> str:
        h = f"sha1({name})"
        return (
            f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3)"
            f" || '-a' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12) || '>'"
        )

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    table = ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in NAMED.items())

    def references(text: str) -> str:
        named = f"{{'name': regexp_extract(x, '{REFERENCE}', 1)}}"
        digits = "CASE WHEN lower(r.name[2]) = 'x' THEN '0x' || r.name[3:] ELSE r.name[2:] END"
        number = f"{{'name': r.name, 'n': CASE WHEN r.name[1] = '#' THEN ({digits}) :: INTEGER END}}"
        letter = f"""CASE WHEN r.name = '' THEN NULL WHEN r.name[1] <> '#' THEN (MAP {{{table}}})[r.name] WHEN r.n = 160 THEN ' '
          WHEN r.n > 0 AND r.n <= 1114111 AND r.n NOT BETWEEN 55296 AND 57343 THEN chr(r.n) ELSE '{NO_CHARACTER}' END"""
        return f"""array_to_string(list_transform(string_split({text}, '&'), lambda x, i: CASE WHEN i = 1 THEN x ELSE
          list_transform(list_transform([{named}], lambda r: {number}),
            lambda r: coalesce(({letter}) || x[length(r.name) + 2:], '&' || x))[1] END), '')"""

    def plain(html: str) -> str:
        text = f"regexp_replace({html}, '(?s)<!--.*?-->', '', 'g')"
        for name in SILENT:
            text = f"regexp_replace({text}, '(?is)<{name}(?:\\s[^>]*)?>.*?</{name}\\s*>', '', 'g')"
        text = f"regexp_replace({text}, '(?i)</?(?:{BREAKING})(?:\\s[^>]*)?/?>', chr(10), 'g')"
        text = f"regexp_replace({text}, '<[^>]*>', '', 'g')"
        text = f"regexp_replace({references(text)}, '[ \\t\\r\\f]{{2,}}|[\\t\\r\\f]', ' ', 'g')"
        text = f"regexp_replace({text}, ' ?\\n[\\n ]*', chr(10), 'g')"
        return f"trim({text}, chr(10) || ' ')"

    title = plain(f"regexp_extract(payload, '{TITLE}', 1)")
    address = references(f"regexp_replace(y, {quoted(ADDRESS)}, '\\1\\2\\3')")
    return f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
r AS (SELECT *, {digest("payload")} AS source_digest FROM p),
s AS (SELECT *, {uuid("'response|' || page_id || '|' || coalesce(url, '') || '|' || source_digest")} AS refers_to FROM r),
b AS (
  SELECT *, {plain("payload")} AS text, array_to_string(['title: ' || regexp_replace({title}, '\\s+', ' ', 'g'),
      'http-content-type: text/html; charset=utf-8']
      || list_transform(regexp_extract_all(payload, {quoted(OUTLINK)}, 0),
           lambda y: 'outlink: ' || regexp_replace({address}, '\\s+', ' ', 'g')), chr(13) || chr(10)) || chr(13) || chr(10) AS meta
  FROM s),
d AS (SELECT *, {digest("meta")} AS meta_digest, {digest("text")} AS text_digest FROM b),
i AS (SELECT *, {uuid("'metadata|' || refers_to || '|' || meta_digest")} AS meta_id,
  {uuid("'conversion|' || refers_to || '|' || text_digest")} AS text_id FROM d),
u AS (SELECT page_id, url, source_digest, refers_to, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
    meta AS block, meta_digest AS block_digest, meta_id AS record_id, text_id AS concurrent_to FROM i
  UNION ALL SELECT page_id, url, source_digest, refers_to, 'conversion', 'text/plain', text, text_digest, text_id, meta_id FROM i)
SELECT page_id, record_type, record_id, concurrent_to, refers_to, url AS target_uri, '{DATE}' AS date,
  'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' AS source_header,
  source_digest, content_type, CAST(strlen(block) AS BIGINT) AS content_length, block_digest, block
FROM u"""
