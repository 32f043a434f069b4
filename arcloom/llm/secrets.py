"""Secret scans with structural confirmation.

Pattern matches are the base. Beyond them, base64 and hex runs are decoded and
reported only if their bytes parse: DER keys, whose nested lengths must fit exactly,
OpenSSH key containers, PEM private keys, and signed tokens whose header is JSON that
names an algorithm. DER and OpenSSH data tell their own length, so they are tried at
every place where one can start, whatever stands before or behind, and over wrapped lines;
a PEM private key that was encoded in base64 once more is decoded twice.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_parts, load, sha, texts

#: Kinds in the order in which spans are listed.
KINDS = ["assign", "access", "hex", "pem", "jwt", "der", "openssh"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
PEM = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s]|\\+(?:[nrt]|(?=/)))+)-----END \1-----")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)(?![A-Za-z0-9_-])")
WORDS = (b"passw", b"secret", b"token", b"api")
OPENSSH = b"openssh-key-v1\0"
#: What may stand between the pieces of a wrapped key: white space, quotes, escaped line ends, the backslash of an escaped slash.
SPACE = b"\t\n\v\f\r \"'"
BREAK = re.compile(rb"[\t-\r \"']+|\\+(?:[nrt]|(?=/))")
PEM_BREAK = re.compile(r"\s+|\\+(?:[nrt]|(?=/))")
#: Places where a DER sequence, the magic of OpenSSH or an encoded PEM can start, and what its run goes on with.
BASE64_START, BASE64_RUN = re.compile(rb"M(?:[A-H]|I[E-T])|b3BlbnNzaC1rZXktdjEA|LS0tLS1CRUdJTi"), re.compile(rb"[A-Za-z0-9+/_-]*")
HEX_START, HEX_RUN = re.compile(rb"30(?:[0-7]|8[1-4])"), re.compile(rb"[0-9a-fA-F]*")
#: Least characters of a key in base64 (with padding) and hex; least characters of a wrapped key's pieces but the last.
LEAST_BASE64, LEAST_HEX, LEAST_PIECE = 40, 64, 16

CLASS = np.zeros(256, np.uint8)
CLASS[list(b"0123456789abcdef")] |= 1


def decoded(run: bytes) -> bytes | None:
    try:
        run = run.rstrip(b"=").translate(bytes.maketrans(b"-_", b"+/"))
        return base64.b64decode(run + b"=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values in data[at:end], or None unless their lengths fill it exactly."""
    items = []
    while at < end:
        if at + 2 > end:
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if at + n > end:
            return None
        items.append((tag, at, at + n))
        at += n
    return items


def is_der_key(data: bytes) -> bool:
    """A sequence that is shaped like a private key (PKCS 1, SEC 1, PKCS 8) or an encrypted one."""
    top = der_items(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    items = der_items(data, *top[0][1:])
    if not items:
        return False
    tags = [x[0] for x in items]
    if tags[:1] == [2] and data[items[0][1] : items[0][2]] in (b"\0", b"\1"):
        if len(tags) >= 6 and set(tags) == {2}:
            return True
        if tags[1:2] == [4]:
            return items[1][2] - items[1][1] >= 16
        if tags[1:3] == [0x30, 4]:
            return bool((inner := der_items(data, *items[1][1:])) and inner[0][0] == 6)
    if tags == [0x30, 4]:
        return bool((inner := der_items(data, *items[0][1:])) and inner[0][0] == 6 and items[1][2] - items[1][1] >= 16)
    return False


def openssh_size(data: bytes) -> int | None:
    """Bytes of the container at the start of data: the magic, then cipher, KDF, its options, a count and that many keys, each with its length."""
    if not data.startswith(OPENSSH):
        return None
    at, count = len(OPENSSH), None
    for k in range(99):
        if at + 4 > len(data):
            return None
        n, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if k == 3:
            count = n
            continue
        if at + n > len(data):
            return None
        at += n
        if count is not None and k >= 4 + count:
            return at
    return None


def is_openssh(data: bytes) -> bool:
    return openssh_size(data) == len(data)


def der_size(head: bytes) -> int | None:
    """Bytes of the sequence that starts with head if it can be a private key: next is a version of 0 or 1, or a sequence."""
    if len(head) < 2 or head[0] != 0x30:
        return None
    n, at = head[1], 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4:
            return None
        n, at = int.from_bytes(head[2 : 2 + k], "big"), 2 + k
    fits = head[at : at + 1] == b"\x30" or head[at : at + 3] in (b"\2\1\0", b"\2\1\1")
    return at + n if fits else None


def is_pem(m: re.Match) -> bool:
    data = decoded(PEM_BREAK.sub("", m[2]).encode())
    return bool(data) and (is_der_key(data) or is_openssh(data))


def base64_key(run: bytes) -> tuple[str, int] | None:
    """(kind, characters) of the key at the start of run, which has no padding."""
    if run.startswith(b"L"):
        text = (decoded(run[: len(run) - (len(run) % 4 == 1)]) or b"").decode("latin-1")
        m = PEM.match(text)
        end = m.end() + (text[m.end() : m.end() + 1] == "\n") if m and is_pem(m) else 0
        return ("pem", -(-4 * end // 3)) if end else None
    if run.startswith(b"b"):
        n = openssh_size(decoded(run[: len(run) - (len(run) % 4 == 1)]) or b"")
        return ("openssh", -(-4 * n // 3)) if n else None
    n = der_size(decoded(run[:12]) or b"")
    size = -(-4 * n // 3) if n else 0
    if not n or size > len(run) or size + -size % 4 < LEAST_BASE64:
        return None
    return ("der", size) if is_der_key(decoded(run[:size]) or b"") else None


def hex_key(run: bytes) -> tuple[str, int] | None:
    n = der_size(bytes.fromhex(run[: min(18, len(run) & ~1)].decode()))
    if not n or not LEAST_HEX <= 2 * n <= len(run):
        return None
    return ("der", 2 * n) if is_der_key(bytes.fromhex(run[: 2 * n].decode())) else None


def keys_in(doc: bytes) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end), in bytes, of the DER and OpenSSH keys.

    Of a wrapped key all pieces but the last have LEAST_PIECE characters or more and the
    last ends with the key, so that words behind a cut key do not complete it.
    """
    dense = BREAK.sub(b"", doc) if b"\\" in doc else doc.translate(None, SPACE)
    places = None
    for start, run, key_of in ((BASE64_START, BASE64_RUN, base64_key), (HEX_START, HEX_RUN, hex_key)):
        at, end = 0, 0
        while m := start.search(dense, at):
            at = m.start() + 1
            if m.end() > end:
                end = run.match(dense, m.start()).end()
            if not (found := key_of(dense[m.start() : end])):
                continue
            if places is None:
                here = np.ones(len(doc), bool)
                for gap in BREAK.finditer(doc):
                    here[gap.start() : gap.end()] = False
                places = np.flatnonzero(here)
            kind, size = found
            own = places[m.start() : m.start() + size]
            a, b = int(own[0]), int(own[-1]) + 1
            # a backslash alone (of an escaped slash) does not end a piece
            cuts = [c for c in (np.flatnonzero(np.diff(own) > 1) + 1).tolist() if doc[own[c - 1] + 1 : own[c]].strip(b"\\")]
            if cuts and (min(np.diff([0, *cuts])) < LEAST_PIECE or doc[b : b + 1].isalnum()):
                continue
            while doc[b : b + 1] == b"=":
                b += 1
            yield kind, a, b
            at = m.start() + size


def is_token(header: str, payload: str) -> bool:
    try:
        head = json.loads(decoded(header.encode()) or b"")
        return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(json.loads(decoded(payload.encode()) or b""), dict)
    except (ValueError, RecursionError):
        return False


def long_runs(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of the runs of True of that length at least; mask starts and ends with False."""
    edges = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    keep = ends - starts >= least
    return list(zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))


def scan_batch(docs: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, kind's number, end) in code points, sorted."""
    joined = b"\n" + b"\n".join(docs) + b"\n"
    starts = np.cumsum([1, *(len(x) + 1 for x in docs)])
    found: dict[int, set[tuple[int, int, int]]] = {}

    def owner(at: int) -> int:
        return int(np.searchsorted(starts, at, side="right")) - 1

    def holds(*words: bytes, within: bytes = joined) -> set[int]:
        out = set()
        for w in words:
            at = within.find(w)
            while at >= 0:
                out.add(k := owner(at))
                at = within.find(w, int(starts[k + 1]))
        return out

    def add(kind: str, k: int, start: int, end: int) -> None:
        found.setdefault(k, set()).add((start, KINDS.index(kind), end))

    counted: dict[int, np.ndarray | None] = {}

    def points(k: int, a: int, b: int) -> tuple[int, int]:
        """Code points of the bytes a..b (which are ASCII, or wrapped by ASCII) of text k; each text is counted once."""
        if k not in counted:
            counted[k] = None if docs[k].isascii() else np.cumsum((np.frombuffer(docs[k], np.uint8) & 0xC0) != 0x80, dtype=np.int64)
        at, n = a - int(starts[k]), b - a
        start = at if counted[k] is None or not at else int(counted[k][at - 1])
        return start, start + n

    for k in holds(*WORDS, within=joined.lower()):
        for m in ASSIGN.finditer(docs[k].decode("utf-8", "replace")):
            if len(m[2]) >= 6:
                add("assign", k, *m.span())
    for k in holds(b"AKIA"):
        for m in ACCESS.finditer(docs[k].decode("utf-8", "replace")):
            if len(m[0]) >= 20:
                add("access", k, *m.span())
    for k in holds(b"PRIVATE KEY-----"):
        for m in PEM.finditer(docs[k].decode("utf-8", "replace")):
            if is_pem(m):
                add("pem", k, *m.span())
    for k in holds(b"eyJ"):
        for m in TOKEN.finditer(docs[k].decode("utf-8", "replace")):
            if is_token(m[1], m[2]):
                add("jwt", k, *m.span())
    classes = CLASS[np.frombuffer(joined, np.uint8)]
    for a, b in long_runs((classes & 1) > 0, 24):
        add("hex", k := owner(a), *points(k, a, b))
    for k, doc in enumerate(docs):
        for kind, a, b in keys_in(doc):
            add(kind, k, *points(k, a + int(starts[k]), b + int(starts[k])))
    return [sorted(found.get(k, ())) for k in range(len(docs))]


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_parts(batches):
        spans = [[{"kind": KINDS[kind], "start": a, "end": b} for a, kind, b in x] for x in scan_batch(texts(batch))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, SPAN)], [*batch.schema.names, "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Adds `spans`: array of (kind, start, end), code points, by start and then kind.

    A null text has no spans; every row keeps its columns (a column `spans` is replaced);
    repeated rows are scanned alike; an empty table stays empty.
    """
    kept = docs.drop("spans")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
    return kept.mapInArrow(scan_batches, ", ".join([*fields, "spans array<struct<kind:string,start:int,end:int>>"]))


def redact_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            if spans:
                parts, at = [], 0
                for s in spans:
                    if s["end"] > at:
                        parts += [text[at : max(at, s["start"])], f"[{s['kind'].upper()}]"] if s["start"] >= at else []
                        at = s["end"]
                text = "".join([*parts, text[at:]])
            out.append(text)
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pa.array(out, pa.string()))


def redact(docs: DataFrame) -> DataFrame:
    """docs (with `spans`) with each run of overlapping spans replaced by its first kind in brackets."""
    return docs.mapInArrow(redact_batches, docs.schema)


def scan_and_redact(docs: DataFrame) -> DataFrame:
    """What scan_secrets and then redact give, in one pass: a task keeps one Python worker instead of two."""
    kept = docs.drop("spans")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
    return kept.mapInArrow(lambda b: redact_batches(scan_batches(b)), ", ".join([*fields, "spans array<struct<kind:string,start:int,end:int>>"]))


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in scan_batches(batches):
        spans = batch.column("spans").to_pylist()
        said = [[f"{s['kind']}:{s['start']}:{s['end']}" for s in x] for x in spans]
        base = [[t for t, s in zip(y, x, strict=True) if s["kind"] in KINDS[:3]] for y, x in zip(said, spans, strict=True)]
        counts = [pa.array([sum(s["kind"] == kind for s in x) for x in spans], pa.int64()) for kind in KINDS[:3]]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array([sha(",".join(x).encode()) for x in base]), pa.array([",".join(x) for x in said])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(digest_batches, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
