"""Chat formatting by columnar byte assembly.

A turn is written as  <s>[INST] role [/INST]text</s>.  Control strings inside roles
and texts get a backslash after their first character and backslashes are doubled,
so no text can open or close a turn, and dropping each backslash that precedes a
character gives the text back. The bytes of a whole batch of turns are laid out with
numpy: segment lengths, their running sum, and scatter indices into one buffer that
becomes the Arrow column.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_from, load

#: The template.
OPEN, MID, CLOSE = b"<s>[INST] ", b" [/INST]", b"</s>"
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]"]
TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\](.*?)</s>", re.DOTALL)
#: Bytes laid out at once; a longer turn is laid out by itself.
BLOCK = 4 << 20

FORMATTED = "conv_id long, part long, n_turns long, formatted string, loss array<struct<start:int,end:int>>"


def escape(column: pa.Array) -> pa.Array:
    column = pc.replace_substring(column, "\\", "\\\\")
    for c in CONTROL:
        column = pc.replace_substring(column, c, f"{c[0]}\\{c[1:]}")
    return column


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and data of a string column."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)


def assemble(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns, where each turn ends, and where each turn's text starts."""
    n, (ro, rd), (to, td) = len(role), bytes_of(role), bytes_of(text)
    lengths = np.empty((n, 5), np.int64)
    lengths[:] = [len(OPEN), 0, len(MID), 0, len(CLOSE)]
    lengths[:, 1], lengths[:, 3] = np.diff(ro), np.diff(to)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    starts = ends - lengths
    out = np.empty(int(ends[-1, 4]) if n else 0, np.uint8)
    for k, header in ((0, OPEN), (2, MID), (4, CLOSE)):
        out[starts[:, k, None] + np.arange(len(header))] = np.frombuffer(header, np.uint8)
    for k, offsets, data in ((1, ro, rd), (3, to, td)):
        if n == 1:
            out[starts[0, k] : ends[0, k]] = data[offsets[0] : offsets[1]]
        elif n:
            shift = np.repeat(starts[:, k] - offsets[:-1], lengths[:, k])
            out[shift + np.arange(offsets[0], offsets[-1])] = data[offsets[0] : offsets[-1]]
    return out, ends[:, 4], starts[:, 3]


def format_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn; a conversation that goes on in the next block, or task, gets a further part."""
    last, part, base_part = object(), 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(size, base + BLOCK)))
            block, at = batch.slice(at, stop - at), stop
            empty = pa.array([""] * block.num_rows)
            role, text = (escape(pc.coalesce(block.column(c).cast(pa.string()), empty)) for c in ("role", "text"))
            out, ends, text_at = assemble(role, text)
            ids = block.column("conv_id").to_pylist()
            first = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
            parts = []
            for i in first:
                part = part + 1 if ids[i] == last else base_part
                last = ids[i]
                parts.append(part)
            bounds = np.array([*first, len(ids)])
            offsets = np.concatenate(([0], ends))[bounds]
            points = np.concatenate(([0], np.cumsum((out & 0xC0) != 0x80)))
            learnt = np.flatnonzero(np.asarray(pc.equal(role, "assistant")))
            owner = np.searchsorted(bounds, learnt, side="right") - 1
            zero = points[offsets[owner]]
            spans = pa.StructArray.from_arrays([pa.array(points[text_at[learnt]] - zero, pa.int32()), pa.array(points[ends[learnt] - len(CLOSE)] - zero, pa.int32())], ["start", "end"])
            where = np.searchsorted(owner, np.arange(len(first) + 1))
            formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out))
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in first], pa.int64()), pa.array(parts, pa.int64()), pa.array(np.diff(bounds), pa.int64()), formatted, pa.ListArray.from_arrays(pa.array(where, pa.int32()), spans)], ["conv_id", "part", "n_turns", "formatted", "loss"])


def split_hot(conversations: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of most conversations, and those of conversations with very many turns, if there are any."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    hot = hot_from(rows.count())
    if hot is None:
        return rows, None
    many = rows.groupBy(F.col("conv_id").alias("many")).agg(F.count("*").alias("n")).where(F.col("n") >= hot).select("many")
    if many.isEmpty():
        return rows, None
    is_hot = F.col("conv_id").eqNullSafe(F.col("many"))  # hot_from bounds how many there are
    return rows.join(F.broadcast(many), is_hot, "left_anti"), rows.join(F.broadcast(many), is_hot, "left_semi")


def formatted_rows(rows: DataFrame, hot: bool) -> DataFrame:
    """Formatted parts, a conversation in one task; or a hot one dealt over tasks by ranges of turns."""
    dealt = rows.repartitionByRange("conv_id", "turn", "role") if hot else rows.repartition("conv_id")
    return dealt.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(format_batches, FORMATTED)


def format_chat(conversations: DataFrame) -> DataFrame:
    """Formats each conversation: conv_id, part, n_turns, formatted, loss (spans of code points).

    Rows go by turn, ties by role and text; repeated rows are repeated turns; a null role
    or text is empty; rows with null conv_id are one conversation; an empty table gives no
    rows; further columns are not used. A conversation is cut into parts of a few MB,
    which ascend by `part` (not always by one), so that no task has to hold a whole one; one
    of very many turns is dealt over tasks. Only assistant texts lie in loss spans.
    """
    rows, hot = split_hot(conversations)
    out = formatted_rows(rows, False)
    return out if hot is None else out.unionByName(formatted_rows(hot, True))


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parses formatted parts, by conversation and part, back into turns and masked text; only digests are held."""
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def give(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    conv, n, turns, chars, loss, total, done = object(), 0, hashlib.sha256(), 0, hashlib.sha256(), 0, []
    for batch in batches:
        for c, text, spans in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "formatted", "loss")), strict=True):
            if c != conv:
                if n:
                    done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))
                conv, n, turns, chars, loss, total = c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
            for m in TURN.finditer(text):
                turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                n += 1
            for s in spans:
                masked = unescape(text[s["start"] : s["end"]])
                chars += len(masked)
                loss.update(masked.encode())
            total += len(text)
        if done:
            yield give(done)
            done = []
    if n:
        yield give([(conv, n, turns.hexdigest(), chars, loss.hexdigest(), total)])


def read_digests(formatted: DataFrame, dealt: bool = False) -> DataFrame:
    """One row for each conversation, read back from its parts.

    A digest goes over a whole conversation, so its parts stream through one task in order.
    As format_chat gives them they are in order already unless conversations were `dealt`
    over tasks; then (or if the table was stored) they are brought together first. An empty
    table gives no rows.
    """
    if dealt:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(read_batches, DIGESTS)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", trap), (-1, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    most, hot = split_hot(rows.unionByName(more))
    out = read_digests(formatted_rows(most, False))
    return out if hot is None else out.unionByName(read_digests(formatted_rows(hot, True), dealt=True))


_ESCAPED = r"""replace(replace(replace(replace(replace({0}, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')"""
SQL = {
    "op4_chat_format": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(22 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
}
