"""Media columns as interleaved document sequences.

Payloads are stored losslessly as PNG images of 64 RGB pixels a row (8-bit samples),
named by the digest of the stored form, each text once however often it comes. Pages refer to them by digest; parsing a page
gives its texts and media references in order, and a join on the digest resolves each
reference at its position, with its caption.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at_most, hot_from, join_counted, load, sha, stored, texts

WIDTH, ROW = 64, 192
#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEME = "media:"
#: Digests of repeated texts up to this number are broadcast.
BROADCAST_KEYS = 1_000_000
MEDIA_TAGS = ("img", "audio", "video", "source", "embed")

ITEM = "struct<pos:int,kind:string,text:string,ref:string,caption:string>"


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """payload, of a positive multiple of 192 bytes, as an RGB image 64 pixels wide."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.data, 1)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """The samples, a row for each line; raises where a signature, checksum, shape or filter is not as written."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, height, packed = 8, 0, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("wrong checksum")
        if kind == b"IHDR":
            width, height = struct.unpack(">II", body[:8])
            if width != WIDTH or body[8:] != b"\x08\x02\x00\x00\x00":
                raise ValueError("another kind of image")
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, ROW + 1)
    if lines[:, 0].any():
        raise ValueError("another filter")
    return lines[:, 1:]


def feature(rows: np.ndarray) -> str:
    """Size, each channel's sum, and a histogram of 8 bins over all samples."""
    sums = rows.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    bins = np.bincount(rows.ravel() >> 5, minlength=8)
    return f"{WIDTH}x{len(rows)};sum={','.join(map(str, sums))};hist={','.join(map(str, bins))}"


STORED = "same string, n long, n_bytes long, digest string, media binary"


def store_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(same, n, text) to the stored form of the padded text."""
    names, kinds = [x.split()[0] for x in STORED.split(", ")], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def give(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        rows: list[tuple] = []
        size = 0
        for same, n, data in zip(batch.column("same").to_pylist(), batch.column("n").to_pylist(), texts(batch), strict=True):
            media = to_png(data.ljust(max(ROW, -(-len(data) // ROW) * ROW), b" "))
            rows.append((same, n, len(data), sha(media), media))
            size += len(media)
            if size > 16 << 20:
                yield give(rows)
                rows, size = [], 0
        if rows:
            yield give(rows)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and `same`, the digest of the text (null: empty)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("same"))


def store_payloads(docs: DataFrame) -> DataFrame:
    """same (digest of the text), n (rows with it), n_bytes, digest, media: each text's payload once.

    A null text is empty; an empty one is a row of spaces. Of rows with equal texts the one of
    the smallest doc_id is stored (rows without any come last; rows that repeat doc_id and
    text are stored as often as they come); an empty table gives no rows; only doc_id and text are used.
    """
    rows = keyed(docs)
    # only texts that repeat are listed; a hot one is a single row here
    repeated = stored(rows.groupBy("same").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1"))
    if at_most(repeated, BROADCAST_KEYS):
        marked = rows.join(F.broadcast(repeated), "same", "left")
    else:
        marked = join_counted(rows, repeated.withColumn("times", F.col("n")), ["same"], "times", hot_from(rows.count()), "left")
    once = marked.where("n IS NULL OR doc_id <=> first").select("same", F.coalesce("n", F.lit(1)).alias("n"), "text")
    return once.mapInArrow(store_batches, STORED)


def pages_of(docs: DataFrame, media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, html: for each document a page that shows its payload, by digest, with a caption."""
    rows = keyed(docs).select("doc_id", "same")
    known = media.select("same", "n", "n_bytes", "digest").dropDuplicates(["same"])
    found = join_counted(rows, known, ["same"], "n", hot_from(rows.count()))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("without id"))
    page = F.concat(F.lit("<article><h1>Document "), name, F.lit(f'</h1><figure><img src="{SCHEME}'), "digest", F.lit('"><figcaption>text of '), "n_bytes", F.lit(" bytes</figcaption></figure></article>"))
    return found.select("doc_id", "n_bytes", page.alias("html"))


READ = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for digest, media in zip(batch.column("digest").to_pylist(), batch.column("media").to_pylist(), strict=True):
            samples = from_png(media)
            payload = samples.tobytes()
            rows.append((digest, len(payload), sha(payload), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_media(media: DataFrame) -> DataFrame:
    """Digests and features from stored bytes (digest, media), one row for each digest; payloads are not shuffled.

    Bytes that are no such image raise, as a lossless store must not pass over them; an empty table gives no rows.
    """
    return media.select("digest", "media").mapInArrow(read_batches, READ).dropDuplicates(["digest"])


class Sequence(HTMLParser):
    """Texts and media references in page order.

    A figcaption is the caption of its figure's media; without media it is a text. It ends
    with its end tag or its figure's; one that the page never ends is a text too, as nothing
    tells what belongs to it. Scripts, styles and titles are no texts; markup that is broken
    is read as far as it goes, never an error.
    """

    QUIET = ("script", "style", "title")
    BLOCKS = ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "br", "hr", "table", "tr", "td", "th", "blockquote", "pre", "article", "section", "header", "footer", "main", "nav", "body")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.quiet: str | None = None
        self.caption: list[str] | None = None
        self.figure: list[dict] | None = None
        self.said = ""

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)

    def give_text(self, parts: list[str]) -> None:
        if words := " ".join("".join(parts).split()):
            self.items.append({"kind": "text", "text": words, "ref": None, "caption": None})

    def flush(self) -> None:
        if self.caption is None:
            self.give_text(self.text)
            self.text = []
        else:
            self.caption.append(" ")

    def end_caption(self) -> None:
        if self.caption is not None:
            said = " ".join("".join(self.caption).split())
            self.caption = None
            self.said = f"{self.said} {said}".strip()
            if self.figure is None:
                self.end_figure()

    def end_figure(self) -> None:
        for item in self.figure or []:
            item["caption"] = self.said or item["caption"]
        if not self.figure:
            self.give_text([self.said])
        self.figure, self.said = None, ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.QUIET:
            self.quiet = tag
            return
        if self.quiet == "title" and tag in ("body", *self.BLOCKS):
            self.quiet = None
        if tag in ("figure", "figcaption"):
            self.end_caption()
            self.flush()
            if tag == "figcaption":
                self.caption = []
            else:
                self.end_figure()
                self.figure = []
        elif tag in MEDIA_TAGS and (ref := dict(attrs).get("src")):
            self.flush()
            item = {"kind": "media", "text": None, "ref": ref, "caption": dict(attrs).get("alt") or None}
            self.items.append(item)
            if self.figure is not None:
                self.figure.append(item)
        elif tag in self.BLOCKS:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag == self.quiet or (tag == "head" and self.quiet == "title"):
            self.quiet = None
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure":
            self.end_caption()
            self.flush()
            self.end_figure()
        elif tag in self.BLOCKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.quiet:
            (self.text if self.caption is None else self.caption).append(data)

    def close(self) -> None:
        super().close()
        if self.caption is not None:
            self.text, self.caption = self.caption, None
        self.flush()
        self.end_figure()


def sequence_of(page: str | None) -> list[dict]:
    parser = Sequence()
    parser.feed(page or "")
    parser.close()
    return [{"pos": k, **item} for k, item in enumerate(parser.items)]


def sequence_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("pos", pa.int32()), *((x, pa.string()) for x in ("kind", "text", "ref", "caption"))]))
    for batch in batches:
        at = batch.schema.get_field_index("html")
        items = pa.array([sequence_of(x) for x in batch.column(at).to_pylist()], kind)
        yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if k != at), items], [*(x for x in batch.schema.names if x != "html"), "items"])


def interleave(pages: DataFrame) -> DataFrame:
    """Replaces the column html by `items`: the page's texts and media references in order.

    A null or empty page has no items; any text is a page, however malformed; other columns
    stay (one named items is replaced); repeated rows give equal items; an empty table stays empty.
    """
    pages = pages.drop("items")
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != "html"]
    return pages.mapInArrow(sequence_batches, ", ".join([*kept, f"items array<{ITEM}>"]))


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """One row for each item of each sequence, with the media table's columns where its digest is known.

    Items keep pos, text, ref and caption; texts and unknown references have null media
    columns. The media table has one row for each digest, and only its rows are sent for
    digests that very many items share. A sequence without items gives no rows; columns of
    sequences named like an item's or the media table's are replaced by these. Sequences
    are read up to three times, so they are best stored; media is stored here where a digest is hot.
    """
    taken = {"pos", "kind", "text", "ref", "caption", "items", *media.columns}
    rows = sequences.select(*[f"`{c}`" for c in sequences.columns if c not in taken], F.inline("items"))
    rows = rows.withColumn("digest", F.when(F.startswith("ref", F.lit(SCHEME)), F.substring("ref", len(SCHEME) + 1, 64)))
    named = rows.where("digest IS NOT NULL")
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in media.schema if f.name != "digest"]
    without = rows.where("digest IS NULL").select("*", *others)
    hot = hot_from(named.count())
    # hot_from bounds how many digests these are, so one file holds them
    many = stored(named.groupBy("digest").count().where(F.col("count") >= hot).select("digest", F.lit(True).alias("_hot")).repartition(1)) if hot else None
    if many is None or many.isEmpty():
        return named.join(media, "digest", "left").unionByName(without)
    marked, media = named.join(F.broadcast(many), "digest", "left"), stored(media)
    few = marked.where("_hot IS NULL").drop("_hot").join(media.join(F.broadcast(many), "digest", "left_anti"), "digest", "left")
    often = marked.where("_hot").drop("_hot").join(F.broadcast(media.join(F.broadcast(many), "digest", "left_semi")), "digest", "left")
    return often.unionByName(few).unionByName(without)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    media = stored(store_payloads(docs))
    sequences = stored(interleave(pages_of(docs, media)))
    found = resolve(sequences, read_media(media))
    return found.where("kind = 'media'").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")
