"""Encoding whole texts with a vocabulary of the ``tokenizers`` library, one process-wide cache.

The library's own end-to-end path spends most of its time in normalising and splitting.
For texts made only of characters on which those two steps are plain (``PLAIN`` below:
ASCII and composed Latin letters) a word between white space is encoded once by the
library's model and its ids are reused; any other text goes through the library whole.
The two ways give the same ids; ``tests/llm`` compares them.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

END_ID = 1
#: Words, and letter runs, that a worker keeps in each of two generations.
CACHE_WORDS, CACHE_PIECES = 100_000, 250_000

#: Texts with any other character are encoded by the library as a whole.
_NOT_PLAIN = re.compile("[^\x20-\x7e\t\n\r\x0b\x0cÀ-į]")
_LETTERS = "a-zßà-öø-į"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_alphabet() -> dict[int, str]:
    """The usual printable stand-in for each byte: printable bytes stay, the rest follow 255 in order."""
    stays = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(stays)]
    return {b: chr(b) for b in stays} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _is_plain_word_bpe(spec: dict) -> bool:
    """Whether the vocabulary file has the normaliser and splitter that the word cache assumes."""
    norm = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    rule = pre[0].get("pattern", {}).get("Regex") if pre and pre[0]["type"] == "Split" else None
    return (
        norm == ["NFC", "Replace", "Lowercase"]
        and rule == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        and spec["model"]["type"] == "BPE"
    )


class _Recent(dict):
    """A cache in two generations: when the young one is full it becomes the old one, and what is asked for again moves back.
    So frequent keys stay, and memory is bounded by twice ``most``."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def made(self, key: str) -> bytes:
        raise NotImplementedError

    def __missing__(self, key: str) -> bytes:
        found = self.old.pop(key, None)
        if found is None:
            found = self.made(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class _Pieces(_Recent):
    """Letter runs and symbol runs to the bytes of their ids."""

    def __init__(self, model, dtype):
        super().__init__(CACHE_PIECES)
        self.tokenize, self.dtype, self.table = model.tokenize, dtype, _byte_alphabet()

    def made(self, key: str) -> bytes:
        # Printable ASCII stands for itself.
        spelled = key if key.isascii() else key.encode().decode("latin-1").translate(self.table)
        ids = [t.id for t in self.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}{'H' if self.dtype.itemsize == 2 else 'I'}", *ids)


class _Words(_Recent):
    def __init__(self, pieces: _Pieces):
        super().__init__(CACHE_WORDS)
        self.pieces = pieces

    def made(self, key: str) -> bytes:
        if key.isascii() and key.isalpha():
            return self.pieces[key]
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(key)))


class Encoder:
    """Text to the little-endian bytes of its ids (2 bytes an id where the vocabulary allows, else 4)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path) as f:
            self.by_word = _is_plain_word_bpe(json.load(f))
        self.words = _Words(_Pieces(self.tokenizer.model, self.dtype))

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype=self.dtype).tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word or _NOT_PLAIN.search(text):
            return self.whole(text)
        return b"".join(map(self.words.__getitem__, text.lower().split()))

    def end(self, end_id: int) -> bytes:
        return np.array([end_id], dtype=self.dtype).tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for ``path``; made once a process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def as_uint32(ids: bytes, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(ids, dtype=dtype).astype("<u4")


def batches(rows: Iterator[pa.RecordBatch], most: int = 2000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most``, without the empty ones."""
    for batch in rows:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)
