"""Byte-level BPE over a minimal acyclic transducer.

The corpus's frequent words are compiled into the minimal acyclic automaton that
accepts them; equal suffixes share states, and the counts of words passed by along a
path number each word, so its ids are an array slice. Automaton, merges and token
bytes lie in one file that goes to each executor once and is memory-mapped there.
Pieces of text walk the automaton together, a byte at a time in numpy; a piece that it
doesn't accept is merged exactly, by rank. The lexicon thus changes speed only, never ids.
"""

from __future__ import annotations

import heapq
import json
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, in_parts, load, sha, stored, texts

#: Fixed value: the pattern by which a text is cut into pieces before the merges.
PIECE = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Words in the lexicon, and how often one must occur.
LEXICON, LEAST = 32_768, 8
#: Longest word in the lexicon and longest piece merged in numpy, in bytes; bytes of text handled at once.
LONGEST, WIDE, BLOCK = 32, 64, 1 << 20
NONE = np.int32(2**31 - 1)
#: Folders of the driver with lexicon files; they go when the process ends.
SERVED: list[tempfile.TemporaryDirectory] = []


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_vocabulary(path: str) -> dict:
    """Token bytes by id, merges (left, right, result) by rank, and special tokens, from a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, vocab = byte_letters(), spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    tokens = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for token, k in vocab.items():
        tokens[k] = bytes(letters[c] for c in token)
    for token, k in special.items():
        tokens[k] = token.encode()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64)
    first = np.zeros(256, np.int32)
    for c, b in letters.items():
        first[b] = vocab[c]
    return {"tokens": tokens, "merges": merges, "first": first, "special": special}


class Merger:
    """Exact BPE of pieces: of several at once in numpy, of a long one with a heap."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray, results: np.ndarray, first: np.ndarray):
        self.keys, self.ranks, self.results, self.first = keys, ranks, results, first

    @classmethod
    def of(cls, vocabulary: dict) -> Merger:
        m = vocabulary["merges"]
        keys = (m[:, 0] << 32) | m[:, 1]
        order = np.argsort(keys)
        return cls(keys[order], order.astype(np.int32), m[:, 2].astype(np.int32), vocabulary["first"])

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NONE where the pair isn't merged, or right is absent (-1)."""
        key = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0) & (left >= 0), self.ranks[at], NONE)

    def wide(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        symbols = np.where(np.arange(width) < sizes[:, None], self.first[raw], -1).astype(np.int32)
        ranks = np.full((n, width), NONE, np.int32)
        ranks[:, :-1] = self.rank(symbols[:, :-1], symbols[:, 1:])
        live, columns = np.arange(n), np.arange(width)
        while len(live):
            r = ranks[live]
            j = r.argmin(axis=1)
            best = r[np.arange(len(live)), j]
            go = best < NONE
            live, j, best, r = live[go], j[go], best[go], r[go]
            if not len(live):
                break
            s, rows = symbols[live], np.arange(len(live))
            source = np.minimum(columns + (columns > j[:, None]), width - 1)
            s, r = np.take_along_axis(s, source, 1), np.take_along_axis(r, source, 1)
            s[:, -1], r[:, -1] = -1, NONE
            s[rows, j] = self.results[best]
            r[rows, j] = np.where(j + 1 < width, self.rank(s[rows, j], s[rows, np.minimum(j + 1, width - 1)]), NONE)
            before = j > 0
            r[rows[before], j[before] - 1] = self.rank(s[rows[before], j[before] - 1], s[rows[before], j[before]])
            symbols[live], ranks[live] = s, r
        counts = (symbols >= 0).sum(axis=1)
        flat = symbols[symbols >= 0]
        return np.split(flat, np.cumsum(counts)[:-1])

    def long(self, piece: bytes) -> np.ndarray:
        n = len(piece)
        ids = self.first[np.frombuffer(piece, np.uint8)].tolist()
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.rank(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(first[k]), k, ids[k], ids[k + 1]) for k in np.flatnonzero(first < NONE)]
        heapq.heapify(heap)
        known = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True)) if n > 4096 else None

        def look(a: int, b: int) -> int:
            key = (a << 32) | b
            if known is not None:
                return known.get(key, -1)
            at = int(np.searchsorted(self.keys, key))
            return int(self.ranks[at]) if at < len(self.keys) and self.keys[at] == key else -1

        while heap:
            rank, k, a, b = heapq.heappop(heap)
            if ids[k] != a or after[k] >= n or ids[after[k]] != b:
                continue
            gone = after[k]
            ids[k], ids[gone], after[k] = int(self.results[rank]), -1, after[gone]
            if after[k] < n:
                prior[after[k]] = k
                if (x := look(ids[k], ids[after[k]])) >= 0:
                    heapq.heappush(heap, (x, k, ids[k], ids[after[k]]))
            if prior[k] >= 0 and (x := look(ids[prior[k]], ids[k])) >= 0:
                heapq.heappush(heap, (x, prior[k], ids[prior[k]], ids[k]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(pieces)
        for low, width in ((0, 8), (8, 16), (16, 32), (32, WIDE)):
            some = [k for k, p in enumerate(pieces) if low < len(p) <= width]
            if some:
                for k, ids in zip(some, self.wide([pieces[k] for k in some], width), strict=True):
                    out[k] = ids
        for k, p in enumerate(pieces):
            if len(p) > WIDE:
                out[k] = self.long(p)
        return out


def minimal_automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool]]:
    """States (byte -> state) and which accept, of sorted distinct words; equal right sides are one state.

    The register of states that are already minimal makes each addition touch only the
    last word's suffix. State 0 is the root.
    """
    edges: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # (parent, byte, child), not yet minimized
    free: list[int] = []

    def minimize(down_to: int) -> None:
        while len(path) > down_to:
            parent, byte, child = path.pop()
            key = (final[child], tuple(edges[child].items()))
            same = register.setdefault(key, child)
            if same != child:
                edges[parent][byte] = same
                free.append(child)

    previous = b""
    for word in words:
        shared = 0
        while shared < min(len(word), len(previous)) and word[shared] == previous[shared]:
            shared += 1
        minimize(shared)
        state = path[-1][2] if path else 0
        for byte in word[shared:]:
            if free:
                new = free.pop()
                edges[new], final[new] = {}, False
            else:
                new = len(edges)
                edges.append({})
                final.append(False)
            edges[state][byte] = new
            path.append((state, byte, new))
            state = new
        final[state] = True
        previous = word
    minimize(0)
    return edges, final


def pack(edges: list[dict[int, int]], final: list[bool]) -> dict[str, np.ndarray]:
    """The automaton as arrays: state s goes by byte c to target[base[s] + c] if check[base[s] + c] is s.

    skip has, for each transition, how many accepted words come before it in the state.
    """
    below = [-1] * len(edges)
    stack = [0]
    while stack:
        s = stack[-1]
        todo = [t for t in edges[s].values() if below[t] < 0]
        if todo:
            stack += todo
            continue
        stack.pop()
        below[s] = final[s] + sum(below[t] for t in edges[s].values())
    reachable = sorted((s for s in range(len(edges)) if below[s] >= 0), key=lambda s: -len(edges[s]))
    room = 256 + 2 * sum(len(edges[s]) for s in reachable) + 256
    taken = bytearray(room)
    base, check, target, skip = np.zeros(len(edges), np.int32), np.full(room, -1, np.int32), np.zeros(room, np.int32), np.zeros(room, np.int32)
    lowest = 256
    for s in reachable:
        if not edges[s]:
            continue
        keys = sorted(edges[s])
        at = lowest
        while taken[at] or any(taken[at - keys[0] + c] for c in keys):
            at += 1
        while taken[lowest]:
            lowest += 1
        b, passed = at - keys[0], int(final[s])
        base[s] = b
        for c in keys:
            taken[b + c], check[b + c], target[b + c], skip[b + c] = 1, s, edges[s][c], passed
            passed += below[edges[s][c]]
        while taken[lowest]:
            lowest += 1
    return {"base": base, "final": np.array(final, np.int32), "check": check, "target": target, "skip": skip}


def save(path: str, arrays: dict[str, np.ndarray], special: dict[str, int]) -> None:
    head, at = {"special": special, "arrays": {}}, 65_536
    for name, a in arrays.items():
        head["arrays"][name] = [str(a.dtype), at, len(a)]
        at += -(-a.nbytes // 64) * 64
    with open(path, "wb") as f:
        f.write(json.dumps(head).encode().ljust(65_536))
        for name, a in arrays.items():
            f.seek(head["arrays"][name][1])
            f.write(a.tobytes())
        f.truncate(max(at, f.tell()))


def compile_lexicon(spark: SparkSession, vocabulary_path: str, words: list[str]) -> str:
    """Compiles vocabulary and words into one file and gives it to all executors; returns its name there."""
    vocabulary = read_vocabulary(vocabulary_path)
    merger = Merger.of(vocabulary)
    listed = sorted({x for w in words for x in ((" " + w).encode(), w.encode()) if 0 < len(x) <= LONGEST})
    # only what is one piece by the pattern may be looked up as one
    listed = [w for w in listed if PIECE.fullmatch(w.decode())]
    ids = merger.encode(listed)
    sizes, tokens = np.array([len(x) for x in ids], np.int64), vocabulary["tokens"]
    arrays = pack(*minimal_automaton(listed)) | {
        "word_at": np.concatenate(([0], np.cumsum(sizes))),
        "word_ids": np.concatenate([*ids, np.empty(0, np.int32)]).astype(np.int32),
        "token_at": np.concatenate(([0], np.cumsum([len(t) for t in tokens]))),
        "token_bytes": np.frombuffer(b"".join(tokens), np.uint8),
        "keys": merger.keys, "ranks": merger.ranks, "results": merger.results, "first": merger.first,
    }
    folder = tempfile.TemporaryDirectory(prefix="arcloom-")  # the driver serves the file from there until it ends
    SERVED.append(folder)
    path = os.path.join(folder.name, f"lexicon-{uuid.uuid4().hex}.bin")
    save(path, arrays, vocabulary["special"])
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + sizes[0] - 1, then those of the next, and so on."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Lexicon:
    """The memory-mapped file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            head = json.loads(f.read(65_536))
        data = np.memmap(path, np.uint8, "r")
        for name, (kind, at, n) in head["arrays"].items():
            setattr(self, name, data[at : at + n * np.dtype(kind).itemsize].view(kind))
        self.special = head["special"]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.merger = Merger(self.keys, self.ranks, self.results, self.first)

    def walk(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of each piece in the lexicon, or -1."""
        out = np.full(len(starts), -1, np.int64)
        who = np.flatnonzero(sizes <= LONGEST)
        state, number = np.zeros(len(who), np.int32), np.zeros(len(who), np.int32)
        at, left = starts[who], sizes[who]
        step = 0
        while len(who):
            over = left == step
            if over.any():
                ended = who[over]
                out[ended] = np.where(self.final[state[over]] > 0, number[over], -1)
                go = ~over
                who, state, number, at, left = who[go], state[go], number[go], at[go], left[go]
            slot = self.base[state] + data[at + step]
            ok = self.check[slot] == state
            if not ok.all():
                slot, who, number, at, left = slot[ok], who[ok], number[ok], at[ok], left[ok]
            state, number = self.target[slot], number + self.skip[slot]
            step += 1
        return out

    def pieces(self, text: str) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Ends of the text's pieces in code points, and (index, id) of those that are special tokens."""
        if self.cut is None or not any(s in text for s in self.special):
            if len(text) > BLOCK:
                return np.fromiter((m.end() for m in PIECE.finditer(text)), np.int64), []
            return np.cumsum(np.fromiter(map(len, PIECE.findall(text)), np.int64)), []
        sizes, marks, at = [], [], 0
        for m in [*self.cut.finditer(text), None]:
            sizes += map(len, PIECE.findall(text[at : m.start() if m else len(text)]))
            if m:
                marks.append((len(sizes), self.special[m[0]]))
                sizes.append(len(m[0]))
                at = m.end()
        return np.cumsum(np.array(sizes, np.int64)), marks

    def encode(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all docs, and where each doc's begin (n + 1)."""
        joined = np.frombuffer(b"".join(docs), np.uint8)
        points = np.append(np.flatnonzero((joined & 0xC0) != 0x80), len(joined))
        ends, marks, per_doc, point, count = [], [], [], 0, 0
        for d in docs:
            text = d.decode("utf-8", "replace")
            e, m = self.pieces(text)
            marks += [(count + k, i) for k, i in m]
            ends.append(e + point)
            per_doc.append(len(e))
            count, point = count + len(e), point + len(text)
        stop = points[np.concatenate([*ends, np.empty(0, np.int64)])]
        start = np.concatenate(([0], stop[:-1]))[: len(stop)]
        number = self.walk(joined, start, stop - start)
        for k, _ in marks:
            number[k] = -1
        known = number >= 0
        begin, size = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        begin[known], size[known] = self.word_at[number[known]], self.word_at[number[known] + 1] - self.word_at[number[known]]
        special, data = dict(marks), joined.tobytes()
        seen: dict = {}
        unknown = np.flatnonzero(~known)
        a, b = start[unknown].tolist(), stop[unknown].tolist()
        which = [seen.setdefault(special[k] if k in special else data[x:y], len(seen)) for k, x, y in zip(unknown.tolist(), a, b, strict=True)] if special else [seen.setdefault(data[x:y], len(seen)) for x, y in zip(a, b, strict=True)]
        words = [w for w in seen if isinstance(w, bytes)]
        merged = dict(zip(words, self.merger.encode(words), strict=True))
        fresh = [merged[w] if isinstance(w, bytes) else np.array([w], np.int32) for w in seen]
        sizes = np.array([len(x) for x in fresh], np.int64)
        pool = np.concatenate([self.word_ids, *fresh])
        which = np.array(which, np.int64)
        begin[unknown], size[unknown] = (len(self.word_ids) + np.cumsum(sizes) - sizes)[which], sizes[which]
        totals = np.concatenate(([0], np.cumsum(size)))
        return pool[ranges(begin, size)], totals[np.concatenate(([0], np.cumsum(per_doc)))]

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids, and where each id's end."""
        size = self.token_at[ids + 1] - self.token_at[ids]
        return self.token_bytes[ranges(self.token_at[ids], size)].tobytes(), np.cumsum(size)


IDS = pa.list_(pa.int32())


def encode_batches(batches: Iterator[pa.RecordBatch], lexicon: str) -> Iterator[pa.RecordBatch]:
    """Replaces text by ids."""
    lex = Lexicon(SparkFiles.get(lexicon))
    for part in in_parts(batches, BLOCK):
        at = part.schema.get_field_index("text")
        ids, bounds = lex.encode(texts(part))
        yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(part.columns) if k != at), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))], [*(x for x in part.schema.names if x != "text"), "ids"])


def decode_batches(batches: Iterator[pa.RecordBatch], lexicon: str, most: int = BLOCK // 4) -> Iterator[pa.RecordBatch]:
    """Adds text, decoded from ids: rows of `most` ids at once (or one row), as the work takes many times their size."""
    lex = Lexicon(SparkFiles.get(lexicon))
    for batch in batches:
        bounds, done = np.asarray(batch.column("ids").offsets).astype(np.int64), 0
        while done < batch.num_rows:
            to = max(done + 1, int(np.searchsorted(bounds, bounds[done] + most, side="right")) - 1)
            part, at = batch.slice(done, to - done), bounds[done : to + 1]
            data, ends = lex.decode(np.asarray(batch.column("ids").values)[at[0] : at[-1]])
            cuts = np.concatenate(([0], ends))[at - at[0]].tolist()
            out = [data[x:y].decode("utf-8", "replace") for x, y in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], [*batch.schema.names, "text"])
            done = to


def frequent_words(docs: DataFrame, most: int = LEXICON, least: int = LEAST) -> list[str]:
    """The runs of letters that are most frequent in all texts, at most `most`.

    A histogram of the counts (16 bins an octave, so a few hundred rows at any size) gives
    the bin from which on `most` words are enough, so that neither tasks nor the driver see
    more words than that; words of the bin that would pass `most` are left out.
    """
    words = docs.select(F.explode(F.split("text", r"[^\p{L}]+")).alias("word")).where(f"word <> '' AND octet_length(word) < {LONGEST}")
    counts = stored(words.groupBy("word").agg(F.count("*").alias("n")).where(f"n >= {least}").withColumn("bin", F.floor(F.log2("n") * 16)))
    start, total = None, 0
    for r in counts.groupBy("bin").agg(F.count("*").alias("words")).orderBy(F.desc("bin")).collect():
        total += r.words
        if total > most:
            break
        start = r.bin
    found = [] if start is None else [r.word for r in counts.where(F.col("bin") >= start).select("word").collect()]
    discard(counts)
    return found


def encode_texts(docs: DataFrame, lexicon: str) -> DataFrame:
    """docs with `text` replaced by `ids` (array<int>).

    A null or empty text has no ids; a special token's string in a text is that token;
    other columns stay (one named ids is replaced); repeated rows are encoded alike; an
    empty table stays empty. A text of any length is encoded whole, by itself if it is longer
    than BLOCK; of equal ranks the leftmost pair is merged first.
    """
    kept = docs.drop("ids")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text"]
    return kept.mapInArrow(lambda b: encode_batches(b, lexicon), ", ".join([*fields, "ids array<int>"]))


def decode_ids(encoded: DataFrame, lexicon: str) -> DataFrame:
    """Adds `text`, special tokens included; null ids give an empty text, an empty table stays empty."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema]
    return encoded.mapInArrow(lambda b: decode_batches(b, lexicon), ", ".join([*fields, "text string"]))


def encode_and_decode(docs: DataFrame, lexicon: str) -> DataFrame:
    """decode_ids(encode_texts(docs)) in one Python worker a task, so that ids are decoded in blocks as small as they are made."""
    kept = docs.drop("ids")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text"]
    return kept.mapInArrow(lambda b: decode_batches(encode_batches(b, lexicon), lexicon), ", ".join([*fields, "ids array<int>", "text string"]))


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        bounds, flat = np.asarray(ids.offsets), np.asarray(ids.values).astype("<u4")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds).astype(np.int64)), pa.array([sha(flat[a:b].tobytes()) for a, b in zip(bounds, bounds[1:], strict=False)]), pa.array([sha(x) for x in texts(batch)])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = compile_lexicon(spark, default_vocabulary(), frequent_words(docs))
    return docs.mapInArrow(lambda b: digest_batches(decode_batches(encode_batches(b, lexicon), lexicon)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
