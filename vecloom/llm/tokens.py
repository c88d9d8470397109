"""Whole-text tokenization with the ``tokenizers`` library, cached by chunk.

Byte-level BPE pre-tokenizers of this family never join what stands before a
single space (or line feed) between two non-blank characters with what stands
after it.  Texts are cut exactly there, each distinct chunk is encoded by the
library once per worker, and ids are joined again: the result is the one of
encoding the whole text.  ``can_split`` checks the tokenizer's declaration;
any other tokenizer encodes whole texts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Python's white space includes Unicode's, so a cut is never made beside any blank.
_SPACE = re.compile(r"(?<=\S) (?=\S)")
_STOPS = frozenset(".,;:!?")
#: Marks the key of a text's first chunk, which has no space before it; no later key begins so.
_FIRST = "\n\n"
#: Chunks cached per worker process, the bound of the cache's memory.
CACHE_CHUNKS = 600_000
#: Text that is numbered at once.
SLICE_BYTES = 16 << 20
_OPEN: dict[str, "Encoder"] = {}


#: All blanks of Unicode as Python has them, but the space and the line feed; and the last letter that counts as Latin here.
_OTHER_BLANKS = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
_LATIN = "\u024f"
#: Texts in which a blank is not one space or one line feed between two words.
_ODD_BLANKS = "[ \n]{2}|^[ \n]|[ \n]$|[" + "".join(_OTHER_BLANKS) + "]"


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256 and on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()
_SPACE_LETTER = " ".translate(_BYTE_LETTERS)


def can_split(declaration: dict) -> bool:
    pre = declaration.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])) for t in declaration.get("added_tokens") or ())
    return bool(plain and added and not declaration.get("normalizer") and not declaration.get("post_processor"))


def _chunk(key: str) -> str:
    """The piece of text that a cache key stands for: most keys are words, with the space before them left out."""
    return key[2:] if key.startswith(_FIRST) else key if key.startswith("\n") else " " + key


class Encoder:
    """Encodes whole texts; ids are kept as little-endian unsigned 32-bit bytes."""

    def __init__(self, declaration: str):
        # one thread a task: the library's own pool costs more than it gives on small inputs
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if sys.byteorder != "little":
            raise NotImplementedError("ids are kept in the machine's order, which must be little-endian")
        self.tokenizer = Tokenizer.from_str(declaration)
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.split = can_split(json.loads(declaration))
        #: Two generations: what is still used moves from the old to the young one.
        self.young: dict[str, bytes] = {_FIRST: b""}
        self.old: dict[str, bytes] = {}
        self.single = {c: self._ids([c])[0] for c in ("\n", *_STOPS)}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _simple(self, key: str) -> bytes | None:
        """Ids of a line feed or nothing, a run of Latin letters, and one punctuation mark or nothing; None for other keys.

        A run of letters with or without a space before it is one pre-token, so
        the library's model is enough; the run ends before punctuation.
        """
        line = key[0] == "\n"
        first = line and key[1:2] == "\n"
        word = key[2:] if first else key[1:] if line else key
        stop = b""
        if not word.isalpha():
            stop = self.single.get(word[-1:])
            word = word[:-1]
            if stop is None or not word.isalpha():
                return None
        ids = None if line else self.young.get(word)
        if ids is None:
            if word.isascii():
                text = word
            elif max(word) > _LATIN:
                return None
            else:
                text = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
            ids = array("I", [t.id for t in self.model.tokenize(text if line else _SPACE_LETTER + text)]).tobytes()
        return self.single["\n"] + ids + stop if line and not first else ids + stop

    def _learn(self, keys: set[str]) -> None:
        """Fill the young generation with what ``keys`` stand for (see ``_chunk``)."""
        if len(self.young) > CACHE_CHUNKS // 2:
            self.old, self.young = self.young, {_FIRST: b""}
        young, old, simple = self.young, self.old.get, self._simple
        other: list[str] = []
        for key in keys:
            ids = old(key) or simple(key)
            if ids is None:
                other.append(key)
            else:
                young[key] = ids
        if other:
            young.update(zip(other, self._ids([_chunk(k) for k in other])))

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids of the whole text; null counts as empty."""
        if not text:
            return b""
        if not self.split:
            return self._ids([text])[0]
        keys = text.replace("\n", " \n").split(" ")
        # each blank must be one space or one line feed between two words
        if "" in keys or "\n" in keys or any(c in text for c in _OTHER_BLANKS):
            keys = _SPACE.split(text)
        keys[0] = _FIRST + keys[0]
        young = self.young
        found = list(map(young.get, keys))
        if None in found:
            at = [i for i, f in enumerate(found) if f is None]
            self._learn({keys[i] for i in at})
            young = self.young
            for i in at:
                found[i] = young[keys[i]]
        return b"".join(found)

    def encode_all(self, texts: pa.Array, end: int | None = None, slice_bytes: int = SLICE_BYTES) -> Iterator[np.ndarray]:
        """Ids of each text, in order, for a whole Arrow batch.

        Texts are cut and their chunks numbered by Arrow, so each distinct chunk
        of a slice is looked up once; ids are then gathered by number.
        """
        tail = np.array([] if end is None else [end], dtype="<u4")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), pa.scalar("", pa.large_string()))
        ahead = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
        at = 0
        while at < len(texts):
            until = max(at + 1, int(np.searchsorted(ahead, ahead[at] + slice_bytes, "right")) - 1)
            yield from (np.concatenate([ids, tail]) for ids in self._encode_slice(texts.slice(at, until - at)))
            at = until

    def _encode_slice(self, part: pa.Array) -> Iterator[np.ndarray]:
        odd = pc.match_substring_regex(part, _ODD_BLANKS).to_numpy(zero_copy_only=False) if self.split else np.ones(len(part), bool)
        plain = pc.if_else(pa.array(odd), pa.scalar("", part.type), part)
        marked = pc.binary_join_element_wise(pa.scalar(_FIRST, part.type), pc.replace_substring(plain, "\n", " \n"), pa.scalar("", part.type))
        keys = pc.split_pattern(marked, " ")
        numbered = keys.values.dictionary_encode()
        border, code = keys.offsets.to_numpy(), numbered.indices.to_numpy()
        words = numbered.dictionary.to_numpy(zero_copy_only=False)
        found = list(map(self.young.get, words))
        at = [i for i, f in enumerate(found) if f is None]
        if at:
            self._learn({words[i] for i in at})
            young = self.young
            for i in at:
                found[i] = young[words[i]]
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        start = np.cumsum(size) - size
        del keys, numbered, words, found, marked, plain
        for first in range(0, len(part), 256):  # gathered for some texts at a time
            last = min(first + 256, len(part))
            own = code[border[first] : border[last]]
            each = size[own]
            until = np.concatenate([[0], np.cumsum(each)])
            ids = flat[np.arange(until[-1]) + np.repeat(start[own] - until[:-1], each)]
            for i in range(first, last):
                if odd[i]:
                    yield np.frombuffer(self.encode_bytes(part[i].as_py()), dtype="<u4")
                else:
                    yield ids[until[border[i] - border[first]] : until[border[i + 1] - border[first]]]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4").tolist()

    def encode_array(self, text: str | None, end: int | None = None) -> np.ndarray:
        tail = b"" if end is None else int(end).to_bytes(4, "little")
        return np.frombuffer(self.encode_bytes(text) + tail, dtype="<u4")


def encoder(declaration: str) -> Encoder:
    """The worker's encoder for this declaration, made once and kept over tasks."""
    key = hashlib.sha1(declaration.encode()).hexdigest()
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Encoder(declaration)
    return _OPEN[key]


def read_declaration(path: str) -> str:
    """The tokenizer file as text, read on the driver and shipped; its size does not depend on the data."""
    with open(path, encoding="utf-8") as f:
        return f.read()
