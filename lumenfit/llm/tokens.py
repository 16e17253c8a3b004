"""Tokenizing whole columns with the ``tokenizers`` library and a unit memo.

Encoding cost is dominated by repeated words.  A text is cut into *units* at
places where the tokenizer always starts a new pre-token, equal units of a
batch are found by Arrow dictionary encoding, and only units that this worker
hasn't met are given to the tokenizer.  Texts where the cuts aren't provably
pre-token borders, and texts that hold one of the tokenizer's added tokens
(``<|endoftext|>``), are encoded whole, so ids always equal those of
``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lumenfit.llm.bytehash import BYTES, Spans, ragged

MARK = "\x01"
SPACES = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Bytes of text that are cut into units at once; bounds memory for long texts.
SLICE_BYTES = 2 << 20


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def cut_style(path: str) -> str:
    """How texts may be cut: ``spaced`` (byte-level pattern, a space belongs to
    the next word), ``dropped`` (white space is removed) or ``whole``."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, norm = json.dumps(spec.get("pre_tokenizer")), json.dumps(spec.get("normalizer"))
    if norm == "null" and '"ByteLevel"' in pre and '"use_regex": true' in pre and '"add_prefix_space": false' in pre:
        return "spaced"
    if '"behavior": "Removed", "invert": true' in pre and "Lowercase" in norm:
        return "dropped"
    return "whole"


def added_pattern(path: str) -> str:
    """A pattern of the added tokens, in any case, as a normaliser may fold it; empty without any."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f).get("added_tokens") or []
    return "(?i)" + "|".join(re.escape(t["content"]) for t in held) if held else ""


class UnitMemo:
    """Ids of units met before, in flat arrays of about 40 bytes a unit.

    A unit is looked up by a 64-bit hash, and its bytes are compared.
    """

    def __init__(self, most: int):
        self.most = most
        self.hash, self.order = np.empty(0, np.uint64), np.empty(0, np.int64)  # sorted hashes, and whose they are
        self.raw, self.end = np.empty(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.ids_end = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def find(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and number (-1: not met) of each unit."""
        h = Spans(BYTES[raw]).of(start, end)
        if not len(self.hash):
            return h, np.full(len(h), -1)
        k = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        size, at = end - start, self.order[k]
        alike = (self.hash[k] == h) & (self.end[at + 1] - self.end[at] == size)
        some = np.flatnonzero(alike)
        differ = np.r_[0, np.cumsum(raw[ragged(start[some], size[some])] != self.raw[ragged(self.end[at[some]], size[some])])]
        ends = np.cumsum(size[some])
        alike[some[differ[ends] > differ[ends - size[some]]]] = False
        return h, np.where(alike, at, -1)

    def add(self, h: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        n = min(len(h), self.most - len(self.hash))
        if n <= 0:
            return
        first, h, start, end, sizes = len(self.order), h[:n], start[:n], end[:n], sizes[:n]
        self.raw = np.concatenate([self.raw, raw[ragged(start, end - start)]])
        self.end = np.concatenate([self.end, self.end[-1] + np.cumsum(end - start)])
        self.ids = np.concatenate([self.ids, ids[: int(sizes.sum())]])
        self.ids_end = np.concatenate([self.ids_end, self.ids_end[-1] + np.cumsum(sizes)])
        both = np.concatenate([self.hash, h])
        at = np.argsort(both, kind="stable")
        self.hash, self.order = both[at], np.concatenate([self.order, first + np.arange(n)])[at]


class UnitEncoder:
    """``encode(texts)`` gives the ids of each text, concatenated, and offsets.

    max_units bounds the memo; beyond it units are still encoded, but not kept.
    controls are further special tokens, of which none overlaps another.
    """

    _kept: dict = {}

    def __init__(self, path: str, max_units: int = 700_000, controls: tuple[str, ...] = ()):
        self.tok, self.style, self.memo = load(path), cut_style(path), UnitMemo(max_units)
        self.added, self.controls = added_pattern(path), controls
        if controls:
            from tokenizers import AddedToken

            self.tok.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in controls])
            self.style = self.style if self.style == "spaced" else "whole"

    @classmethod
    def of(cls, path: str, max_units: int = 700_000, controls: tuple[str, ...] = ()) -> UnitEncoder:
        """One encoder for each file in a worker: tasks that follow reuse its memo."""
        key = (path, max_units, controls)
        if key not in cls._kept:
            cls._kept[key] = cls(*key)
        return cls._kept[key]

    def byte_lengths(self) -> np.ndarray:
        """Bytes of text that each id stands for; only where a character of a token is a byte (``spaced``)."""
        if not hasattr(self, "_lengths"):
            vocab = self.tok.get_vocab(with_added_tokens=True)
            self._lengths = np.zeros(max(vocab.values()) + 1, np.int64)
            for token, i in vocab.items():
                self._lengths[i] = len(token)
            for i, token in self.tok.get_added_tokens_decoder().items():
                self._lengths[i] = len(token.content.encode())
        return self._lengths

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids and their number by text."""
        ids, sizes = [np.empty(0, np.uint32)], []
        for at in range(0, len(texts), 4000):
            flat: list[int] = []
            for e in self.tok.encode_batch_fast(texts[at : at + 4000], add_special_tokens=False):
                got = e.ids
                sizes.append(len(got))
                flat += got
            ids.append(np.array(flat, np.uint32))
        return np.concatenate(ids), np.array(sizes, np.int64)

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool of ids, first, size): where the ids of each unit stand."""
        ends = np.frombuffer(units.buffers()[1], np.int64)[units.offset : units.offset + len(units) + 1]
        raw = np.frombuffer(units.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint8)
        start, end = ends[:-1] - ends[0], ends[1:] - ends[0]
        h, known = self.memo.find(raw, start, end)
        new = np.flatnonzero(known < 0)
        ids, sizes = self._whole(units.take(pa.array(new)).to_pylist())
        first, size = self.memo.ids_end[known], self.memo.ids_end[known + 1] - self.memo.ids_end[known]
        first[new], size[new] = len(self.memo.ids) + np.cumsum(sizes) - sizes, sizes
        pool = np.concatenate([self.memo.ids, ids]) if len(new) else self.memo.ids
        self.memo.add(h[new], raw, start[new], end[new], ids, sizes)
        return pool, first, size

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids and offsets of texts that may be cut at spaces and line ends."""
        if self.style == "spaced":
            marked = pc.replace_substring(pc.replace_substring(texts, " ", MARK + " "), "\n", f"{MARK}\n{MARK}")
            for c in self.controls:
                marked = pc.replace_substring(marked, c, MARK + c + MARK)
            lists = pc.split_pattern(marked, MARK)
        else:
            lists = pc.split_pattern(pc.ascii_lower(pc.replace_substring(texts, "\n", " ")), " ")
        flat, ends = lists.flatten(), lists.offsets.to_numpy()
        ends = ends - ends[0]
        coded = flat.dictionary_encode()
        index = coded.indices.to_numpy()
        pool, first, size = self._units(coded.dictionary.cast(pa.large_string()))
        lens = size[index]
        done = np.zeros(len(lens) + 1, dtype=np.int64)
        np.cumsum(lens, out=done[1:])
        return pool[ragged(first[index], lens)], done[ends]

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.style == "whole":
            odd = np.ones(len(texts), dtype=bool)
        elif self.style == "spaced":
            odd = pc.match_substring_regex(texts, f"{SPACES}{SPACES}|{MARK}").to_numpy(zero_copy_only=False)
        else:
            odd = np.zeros(len(texts), dtype=bool)
        if self.added:
            odd |= pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._cut(texts)
        parts: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        even = np.flatnonzero(~odd)
        if len(even):
            ids, ends = self._cut(texts.take(pa.array(even)))
            for k, i in enumerate(even):
                parts[i] = ids[ends[k] : ends[k + 1]]
        rest = np.flatnonzero(odd)
        ids, sizes = self._whole(texts.take(pa.array(rest)).to_pylist())
        for i, part in zip(rest, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
            parts[i] = part
        ends = np.zeros(len(parts) + 1, dtype=np.int64)
        np.cumsum([len(p) for p in parts], out=ends[1:])
        return np.concatenate(parts), ends

    def encode(self, texts: pa.Array):
        """Yields (first row, ids, offsets) for slices of bounded size."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lens = pc.binary_length(texts).to_numpy()
        slot = (np.cumsum(lens) - lens) // SLICE_BYTES
        starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(lens) else []
        for k, at in enumerate(starts):
            to = starts[k + 1] if k + 1 < len(starts) else len(lens)
            ids, ends = self._slice(texts.slice(at, to - at))
            pa.default_memory_pool().release_unused()  # workers live on, and other operators run in them
            yield at, ids, ends


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each text."""
    return np.insert(ids, ends[1:], end_id), ends + np.arange(len(ends))
