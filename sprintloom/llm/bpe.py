"""Byte-level BPE ids of whole texts, as a published tokenizer gives them, with remembered pieces.

The tokenizer's pattern never joins what lies on either side of a single blank between two visible
characters, so a text may be cut before such blanks and equal pieces be tokenized once. Pieces of plain
Latin letters are cut further by the pattern; anything else goes to the tokenizer as it is.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import regex
from tokenizers import Tokenizer

from sprintloom.llm.common import worker_cache

# The pattern and the byte letters of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SAFE = re.compile(r"(?<=\S) (?=\S)")
# White space other than blank and line feed, as ``str.isspace`` has it.
_OTHER_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_SLICE = 1 << 20
# Remembered pieces per worker, about 200 bytes each. Fewer cost time, never ids.
_PIECES, _TOKENS = 1_200_000, 300_000
_PLAIN = re.compile("[\x00-ɏ]*")


def _byte_letters() -> dict[int, str]:
    """Visible Latin-1 characters stand for themselves, other bytes for characters from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in visible]
    return {b: chr(b) if b in visible else chr(256 + other.index(b)) for b in range(256)}


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _single_blanks(text: str) -> bool:
    """Whether every blank stands between two visible characters; may be wrongly false."""
    return not (text[:1] == " " or text[-1:] == " " or "  " in text or " \n" in text or "\n " in text
                or any(c in text for c in _OTHER_SPACES))


class _Remembered(dict):
    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(self) < self.most:
            self[key] = value
        return value


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit numbers in a byte string, no special ids added."""

    def __init__(self, path: str, remembered: int = _PIECES):
        self.tokenizer = Tokenizer.from_file(path)
        self.letters, self.pattern = _byte_letters(), regex.compile(PATTERN)
        self.tokens = _Remembered(self._token, _TOKENS)
        self.pieces = _Remembered(self._after_blank, remembered)

    @classmethod
    def of(cls, path: str, remembered: int = _PIECES) -> Encoder:
        """The worker's encoder for a vocabulary file; it serves all tasks that the worker runs."""
        cache = worker_cache("bpe")
        if (path, remembered) not in cache:
            cache[path, remembered] = cls(path, remembered)
        return cache[path, remembered]

    def _token(self, token: str) -> bytes:
        spelled = token.encode().decode("latin-1").translate(self.letters)
        return _bytes([t.id for t in self.tokenizer.model.tokenize(spelled)])

    def _after_blank(self, piece: str) -> bytes:
        """Ids of a blank and ``piece``. Most pieces are a word, or a word and a mark."""
        if piece.isalpha() and _PLAIN.fullmatch(piece):
            return self._token(" " + piece)
        if piece[-1] in ",." and piece[:-1].isalpha() and _PLAIN.fullmatch(piece):
            return self.pieces[piece[:-1]] + self.tokens[piece[-1]]
        return self._piece(" " + piece)

    def _piece(self, piece: str) -> bytes:
        if "<|" in piece or not _PLAIN.fullmatch(piece):
            return _bytes(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        tokens = self.tokens
        return b"".join([tokens[t] for t in self.pattern.findall(piece)])

    def _slices(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > 2 * _SLICE:
            cut = _SAFE.search(text, start + _SLICE)
            if not cut:
                break
            yield text[start:cut.start()]
            start = cut.start()
        yield text[start:]

    def encode(self, text: str) -> bytes:
        out = []
        for part in self._slices(text):
            lead = part.startswith(" ") and not part[1:2].isspace() and len(part) > 1 and bool(out)
            body = part[1:] if lead else part  # the blank before a later slice belongs to its first piece
            pieces = body.split(" ") if _single_blanks(body) else _SAFE.split(body)
            if lead:
                out.append(self.pieces[pieces[0]])
            else:
                out.append(self._piece(pieces[0]))
            out.append(b"".join(map(self.pieces.__getitem__, pieces[1:])))
        return b"".join(out)
