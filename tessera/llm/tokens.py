"""Encoding of whole texts with public tokenizers; vocabulary files are named by path.

Most of an encoder's time goes to words that it has met before. For the two pre-tokenizers that are
recognised below, a text falls apart at its spaces into chunks whose ids do not depend on each other, so
chunks are kept in a bounded table. Chunks of plain letters and punctuation go to the library's BPE
model directly; all others, and all texts of other tokenizers, go through the whole tokenizer.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .common import give_back

#: Letters and punctuation on which the library and Python agree; the apostrophe starts contractions.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class Odd(Exception):
    """A space beside other white space, or at an end: such runs aren't split at spaces."""


def _closed(chunk: str) -> None:
    if not chunk or chunk[0].isspace() or chunk[-1].isspace():
        raise Odd


#: Chunks kept in a worker; beyond this the table starts anew.
KEPT = 1_200_000


def _printable() -> dict[int, str]:
    """Byte-level BPE writes printable bytes as themselves and the others as code points from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in shown else next(rest)) for b in range(256)}


class Encoder(dict):
    """encode(text) gives little-endian ids as bytes of `dtype`; the dict keeps chunks that stand after a space."""

    def __init__(self, path: str, kept: int = KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.kept = kept
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        steps = [x["type"] for x in (normal or {}).get("normalizers", [])]
        self.kind = ""
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and normal is None:
            self.kind = "byte"
        elif steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in before.get("pretokenizers", [])] == ["Split", "ByteLevel"]:
            self.kind = "word"
        self.bytes = str.maketrans({chr(b): c for b, c in _printable().items()})
        self.parts: dict[str, bytes] = {}
        self.as_bytes = [i.to_bytes(self.dtype.itemsize, "little") for i in range(self.whole.get_vocab_size())].__getitem__

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _model(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.bytes))]
        return b"".join(map(self.as_bytes, ids))

    def _part(self, piece: str) -> bytes:
        """A single pre-token that does not stand after a space."""
        out = self.parts.get(piece)
        if out is None:
            if len(self.parts) >= self.kept:
                self.parts.clear()
            out = self.parts[piece] = self._model(piece)
        return out

    def _lines(self, chunk: str, space: str) -> bytes:
        """Lines that are parted by single line feeds, with nothing else that is white space."""
        out = []
        for k, line in enumerate(chunk.split("\n")):
            m = PLAIN.fullmatch(line)
            if not m:
                return self._whole(space + chunk)
            out += [self._part("\n"), self._part(m[1])] if k else [self[m[1]] if space else self._part(m[1])]
            if m[2]:
                out.append(self._part(m[2]))
        return b"".join(out)

    def __missing__(self, chunk: str) -> bytes:
        m = PLAIN.fullmatch(chunk)
        if m and m[2]:
            known = m[1] in self
            out = self[m[1]] + self._part(m[2])
            if known:  # a word met once more with the same mark is worth its place
                self[chunk] = out
            return out
        if not m:
            if self.kind == "byte":
                _closed(chunk)
                if "\n" in chunk:
                    return self._lines(chunk, " ")
            out = self._whole(chunk if self.kind == "word" else " " + chunk)
        elif self.kind == "word":
            low = chunk.lower()
            out = self._model(low) if low == chunk else self[low]
        else:
            out = self._model(" " + chunk)
        if len(self) >= self.kept:
            self.clear()
        self[chunk] = out
        return out

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.kind or ("<|" in text and any(s in text for s in self.special)):
            return self._whole(text)
        if self.kind == "word":
            return b"".join(map(self.__getitem__, filter(None, text.replace("\n", " ").split(" "))))
        try:
            first, *rest = text.split(" ")
            _closed(first)
            return self._lines(first, "") + b"".join(map(self.__getitem__, rest))
        except Odd:
            return self._whole(text)


_kept: dict[str, Encoder] = {}


def encoder(path: str, kept: int = KEPT) -> Encoder:
    """One encoder for a worker process; it lives on in reused workers, with at most `kept` chunks."""
    if path not in _kept or _kept[path].kept != kept:
        release()
        _kept[path] = Encoder(path, kept)
    return _kept[path]


def release() -> None:
    """Drop the worker's encoder and give its memory back to the system."""
    if _kept:
        _kept.clear()
        give_back()
