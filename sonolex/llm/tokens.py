"""Token ids by the tokenizers library, with a memory of words.

Byte-level BPE never merges across the borders of its pre-tokenizer. Where all white space of a text is single spaces and
line breaks between visible characters, a space belongs to the word that follows and a line break stands alone; so each word
(with its space) has ids of its own, and so has punctuation behind a letter. A column's words are cut in place, as an Arrow array over the texts' own bytes, and looked up
once for each different word; ids of words come from the library's model and are kept for the next time. All other texts, those
that may hold a special token's string, and vocabularies of another kind are encoded whole.
"""

from __future__ import annotations

import json
import os
from array import array
from functools import lru_cache
from itertools import pairwise
from operator import attrgetter

import numpy as np
import pyarrow as pa
import regex

from .common import bytes_of

END, KEPT = 0, 400_000
_ID = attrgetter("id")
#: The pre-tokenizer's pattern and its map from bytes to characters (public, from byte-level BPE).
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_CHARS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}

#: White space other than spaces and line breaks; texts with any of it are encoded whole.
_ODD = [c.encode() for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_ODD_LONG = [c for c in _ODD if len(c) > 1]
#: What each byte may be: punctuation that is cut off, the last of a letter, odd white space or the first of it, a space or line break.
_MARK, _LETTER, _ODD_BYTE, _ODD_LEAD, _SPACE = 1, 2, 4, 8, 16
_KIND = np.zeros(256, np.uint8)
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = _MARK
_KIND[[*range(65, 91), *range(97, 123), *range(128, 192)]] = _LETTER
_KIND[[c[0] for c in _ODD if len(c) == 1]] |= _ODD_BYTE
_KIND[[*{c[0] for c in _ODD if len(c) > 1}]] |= _ODD_LEAD
_KIND[[10, 32]] |= _SPACE
_KIND = _KIND.tobytes()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class _Memory:
    """Ids of units: words with their space, punctuation behind a word, or line breaks. The units met last are kept, ``KEPT`` at least
    and twice as many at most: a full memory becomes the old one, and what is met again moves on from there."""

    def __init__(self, model):
        self.tokenize, self.new, self.old = model.tokenize, {}, {}

    def ids(self, units: list[str]) -> list[bytes]:
        out = [*map(self.new.get, units)]
        lost = [i for i, x in enumerate(out) if x is None]
        if not lost:
            return out
        for i in lost:
            out[i] = self.old.get(units[i])
        fresh = [i for i in lost if out[i] is None]
        for i, x in zip(fresh, self._encoded([units[i] for i in fresh])):
            out[i] = x
        if len(self.new) + len(lost) > KEPT:
            self.old, self.new = self.new, {}
        self.new.update((units[i], out[i]) for i in lost[:KEPT])
        return out

    def _encoded(self, units: list[str]) -> list[bytes]:
        """Ids of units by the library's model: a word is one token of the pre-tokenizer, other units are cut as it cuts them."""
        flat, edge = [], [0]
        for u in units:
            if u.isalpha() or u[1:].isalpha() and u[0] == " ":
                flat.append(u)
            else:
                flat += _WORD.findall(u)
            edge.append(len(flat))
        if not flat:
            return [b""] * len(units)
        joined = "\0".join(flat)
        if joined.count("\0") >= len(flat):
            shown = [x.encode().decode("latin-1").translate(_CHARS) for x in flat]
        else:
            shown = joined.encode().decode("latin-1").translate(_CHARS).split(_CHARS[0])
        ids, size = array("I"), [0]
        for x in shown:  # one at a time, so that the library's tokens are freed at once
            ids.extend(map(_ID, self.tokenize(x)))
            size.append(4 * len(ids))
        raw = ids.tobytes()
        return [raw[size[a] : size[b]] for a, b in pairwise(edge)]


def _marks(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Places of punctuation right behind a letter (ASCII, or of Latin-1 in two bytes); the pre-tokenizer always cuts there. An
    apostrophe may go on as a contraction, so it isn't one."""
    at = np.flatnonzero((kind[1:] & (kind[:-1] >> 1) & _MARK).view(bool)) + 1
    two = at[data[at - 1] >= 128]
    two = two[two > 1]
    sure = (data[two - 2] == 0xC3) & (data[two - 1] != 0x97) & (data[two - 1] != 0xB7)
    return np.concatenate([at[data[at - 1] < 128], two[sure]])


def _odd_places(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Places of white space that is neither a space nor a line break."""
    found = [np.flatnonzero(kind & _ODD_BYTE)]
    lead = np.flatnonzero(kind & _ODD_LEAD)
    for c in _ODD_LONG if len(lead) else ():
        at = lead[lead + len(c) <= len(data)]
        for i, byte in enumerate(c):
            at = at[data[at + i] == byte]
        found.append(at)
    return np.concatenate(found)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        pre = kind["pre_tokenizer"] or {}
        self.plain = kind["normalizer"] is None and kind["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.special = [t["content"].encode() for t in kind["added_tokens"]]
        self.memory = _Memory(self.tokenizer.model)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _plain_texts(self, raw: bytes, data: np.ndarray, kind: np.ndarray, space: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which texts may be cut into words."""
        n, full = len(at) - 1, at[1:] > at[:-1]
        out = np.full(n, bool(self.plain))
        out[full] &= ~(space[at[:-1][full]] | space[at[1:][full] - 1])
        bad = [np.flatnonzero(space[1:] & space[:-1]), _odd_places(data, kind)]
        for s in self.special:
            i = raw.find(s) if s else -1
            while i >= 0:
                bad.append(np.array([i]))
                i = raw.find(s, i + 1)
        out[np.searchsorted(at, np.concatenate(bad), "right") - 1] = False
        return out

    def column(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts of a string column, each followed by ``end`` if given, and the n + 1 borders of the texts in
        them; a null is empty."""
        data, at = bytes_of(texts)
        at = np.asarray(at, np.int64)
        raw = data.tobytes()
        kind = np.frombuffer(raw.translate(_KIND), np.uint8)
        space = (kind & _SPACE) > 0
        plain = self._plain_texts(raw, data, kind, space, at)
        cut = np.flatnonzero(space)
        if not plain.all():
            cut = cut[plain[np.searchsorted(at, cut, "right") - 1]]
        after = cut[data[cut] == 10] + 1  # a line's first word has no space
        marks = _marks(data, kind)
        if not plain.all():
            marks = marks[plain[np.searchsorted(at, marks, "right") - 1]]
        cuts = np.concatenate([cut, after, marks, at])
        first = np.zeros(len(data) + 1, bool)
        first[cuts] = True
        cuts = np.flatnonzero(first)  # every unit's start, and the end of the data
        units = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        codes = units.indices.to_numpy()
        odd = np.zeros(len(units.dictionary), bool)
        odd[codes[np.searchsorted(cuts, at[:-1][~plain & (at[1:] > at[:-1])])]] = True
        words = units.dictionary.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist
        if odd.any():
            flags = odd.tolist()
            known = iter(self.memory.ids([w for w, o in zip(words, flags) if not o]))
            ids = [_bytes(self.whole(w)) if o else next(known) for w, o in zip(words, flags)]
        else:
            ids = self.memory.ids(words)
        flat_ids, upto = bytes_of(pa.array(ids, pa.large_binary()))
        lists = pa.LargeListArray.from_arrays(pa.array(upto // 4), pa.array(flat_ids.view("<u4")))
        flat = lists.take(units.indices)
        borders = flat.offsets.to_numpy()[np.searchsorted(cuts, at)]
        out = flat.values.to_numpy()[flat.offsets[0].as_py() : flat.offsets[-1].as_py()]
        borders = borders - borders[0]
        if end is None:
            return out, borders
        return np.insert(out, borders[1:], np.uint32(end)), borders + np.arange(len(borders))

    def __call__(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a text, without the end id; a null is empty."""
        return self.column(pa.array([text], pa.large_string()))[0].astype("<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for a Python worker: its memory, bounded by ``KEPT`` words, lasts over tasks."""
    return Encoder(path)
