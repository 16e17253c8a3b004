"""Chat formatting with offset-aligned loss masks (operator 10).

A conversation is rendered to one string and encoded once, with offsets.  The
template's marks are special tokens, so no token crosses the border of a text.
Sorted spans of the assistant's texts are intersected with the sorted token
spans by binary search; tokens inside get loss 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfit.llm import common, tokens

#: The template's control strings.
PROMPT, PROMPT_END, REPLY, REPLY_END, SEP = "[INST]", "[/INST]", "<s>", "</s>", "<t>"
CONTROLS = (PROMPT, PROMPT_END, REPLY, REPLY_END, SEP)
#: A control string with any number of backslashes before its last character.
GUARD = re.compile(r"(\[/?INST|</?s|<t)(\\*)([\]>])")
TRAINED = "assistant"


def escape(text: str) -> str:
    """The text with one more backslash before the last character of each control string."""
    return GUARD.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return GUARD.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def _header(role: str | None) -> str:
    return "~" if role is None else "=" + escape(role)


def render(turns: list[tuple[str | None, str]], trained: str = TRAINED) -> tuple[str, np.ndarray]:
    """The formatted text, and the spans (k x 2, code points) of the trained role's texts."""
    parts, at, spans = [], 0, []
    for role, text in turns:
        begin, end = (REPLY, REPLY_END) if role == trained else (PROMPT, PROMPT_END)
        head, body = f"{begin}{_header(role)}{SEP}", escape(text)
        if role == trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, end]
        at += len(head) + len(body) + len(end)
    return "".join(parts), np.array(spans, dtype=np.int64).reshape(-1, 2)


TURN = re.compile(r"(?:\[INST\]|<s>)(~|=.*?)<t>(.*?)(?:\[/INST\]|</s>)", re.DOTALL)


def parse(formatted: str) -> list[tuple[str | None, str]]:
    """The turns of a rendered conversation."""
    return [(None if m[1] == "~" else unescape(m[1][1:]), unescape(m[2])) for m in TURN.finditer(formatted)]


def loss_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """1 for each token that overlaps a span; both are sorted."""
    mask = np.zeros(len(offsets), dtype=np.uint8)
    if len(spans) and len(offsets):
        k = np.searchsorted(spans[:, 1], offsets[:, 0], side="right")  # the first span that ends behind the token's start
        inside = k < len(spans)
        mask[inside] = spans[k[inside], 0] < offsets[inside, 1]
    return mask


def loss_texts(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> list[str]:
    """The unescaped texts under the mask, one for each run of masked tokens."""
    edge = np.diff(np.r_[0, mask.astype(np.int8), 0])
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    return [unescape(formatted[offsets[a, 0] : offsets[b, 1]]) for a, b in zip(first, last, strict=True)]


def offsets_of(formatted: str, lengths: np.ndarray) -> np.ndarray:
    """Offsets (code points) of tokens that stand for ``lengths`` bytes each; a part of a character has all of it."""
    raw = np.frombuffer(formatted.encode(), np.uint8)
    place = np.cumsum((raw & 0xC0) != 0x80) - 1  # the code point of each byte
    end = np.cumsum(lengths)
    return np.stack([place[end - lengths], place[end - 1] + 1], axis=1).astype("<u4").reshape(-1, 2)


def encode_with_offsets(encoder: tokens.UnitEncoder, formatted: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and offsets of each string.

    Where a token's characters are bytes, offsets follow from their numbers, and
    words met before aren't encoded again; else the library gives both.
    """
    if encoder.style != "spaced":
        for e in encoder.tok.encode_batch(formatted, add_special_tokens=False):
            yield np.array(e.ids, dtype="<u4"), np.array(e.offsets, dtype="<u4").reshape(-1, 2)
        return
    lengths = encoder.byte_lengths()
    for at, ids, ends in encoder.encode(pa.array(formatted, pa.large_string())):
        for k in range(len(ends) - 1):
            own = ids[ends[k] : ends[k + 1]]
            yield own.astype("<u4"), offsets_of(formatted[at + k], lengths[own])


FORMATTED = "conv_id long, n_turns long, formatted string, ids binary, offsets binary, mask binary"


def format_conversations(df: DataFrame, tokenizer: str, trained: str = TRAINED) -> DataFrame:
    """Formats ``conv_id, turn, role, text`` rows; one row for each conversation.

    ids, offsets (pairs of code points) and mask are little-endian u32, u32 and
    u8 arrays.  Rows are taken by turn (null first; ties by role, then text, so
    repeated rows stay).  Null text is an empty text, and a null role stays null.
    Rows without conv_id belong to no conversation: each makes one of its own
    (equal ones one), with a null conv_id.  Further columns are not read.  A
    conversation is one output row, so its turns meet in one task; long texts
    are rendered and encoded whole.
    """
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), common.text_of().alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    grouped = df.groupBy(F.col("conv_id").cast("long").alias("conv_id"), alone.alias("alone")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    flat = grouped.select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: t["text"]).alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.UnitEncoder.of(tokenizer, controls=CONTROLS)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, roles, texts = (c.to_pylist() for c in batch.slice(at, 256).columns)
                done = [render(list(zip(r, t, strict=True)), trained) for r, t in zip(roles, texts, strict=True)]
                cols: list[list] = [[], [], []]
                for (_, spans), (coded, offsets) in zip(done, encode_with_offsets(encoder, [d[0] for d in done]), strict=True):
                    for c, x in zip(cols, (coded, offsets, loss_mask(offsets.astype(np.int64), spans)), strict=True):
                        c.append(x.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(r) for r in roles], pa.int64()), pa.array([d[0] for d in done], pa.string()), *(pa.array(c, pa.binary()) for c in cols)], ["conv_id", "n_turns", "formatted", "ids", "offsets", "mask"])

    return flat.mapInArrow(run, FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted rows say: digests of the parsed turns and of the text under the mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            rows = []
            for conv_id, text, offsets, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = parse(text)
                spans, bits = np.frombuffer(offsets, "<u4").reshape(-1, 2).astype(np.int64), np.frombuffer(mask, np.uint8)
                loss = "".join(loss_texts(text, spans, bits))
                told = "".join(f"{role or ''}\n{body}\n" for role, body in turns)
                rows.append((conv_id, len(turns), sha256(told.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(text), len(bits), int(bits.sum())))
            if rows:
                names = [x.split()[0] for x in DIGESTS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if "sha" in n else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)

    return formatted.select("conv_id", "formatted", "offsets", "mask").mapInArrow(run, DIGESTS)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    formatted = format_conversations(rows.unionByName(extra), tokens.tokenizer_path("byte_bpe_50k.json"))
    return read_back(common.stash(formatted, "chat")).drop("n_tokens", "loss_tokens")


#: For DuckDB: each text once more than it stands in the template, with a backslash in each control string.
SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(text, '(\[/?INST|</?s|<t)(\\*)([\]>])', '\1\2\\\3', 'g') AS body,
    CASE WHEN role IS NULL THEN '~' ELSE '=' || regexp_replace(role, '(\[/?INST|</?s|<t)(\\*)([\]>])', '\1\2\\\3', 'g') END AS head FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(head) + length(body) + CASE WHEN role = 'assistant' THEN 10 ELSE 16 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
