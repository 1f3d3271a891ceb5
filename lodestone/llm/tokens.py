"""Byte-level BPE ids of whole texts by the tokenizers library, each distinct word encoded once.

The byte-level pre-tokenizer never lets a token cross from a non-space into the white space behind it, so
a text's ids are those of its pieces put together, where a piece is a word with the one space before it.
Random access by a dictionary from piece to ids is several times faster than encoding running text.
"""

from __future__ import annotations

import gc
import os
import re
from array import array

from .common import keeps, working

#: Unicode White_Space, which the pre-tokenizer splits on (fixed values of the Unicode standard).
SPACE = "\t-\r \x85\xa0  -     　"
#: White space that doesn't stand alone between two words; the plain split is only exact without it.
ODD = re.compile(f"[{SPACE}][{SPACE}]|^[{SPACE}]|[{SPACE}]\\Z|\x00")
#: White space besides the space and the line feed, for a quick look; the first five are ASCII.
RARE = "\t\x0b\x0c\r\x00\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Punctuation that a token behind letters never shares with them (not the apostrophe, which contracts).
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
PIECE = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
#: Pieces kept per Python worker (about 200 bytes each); beyond it, new ones are encoded without being kept.
KEPT_PIECES = 1_200_000

_open: dict[str, "PieceEncoder"] = {}
keeps("tokens", _open.clear)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PieceEncoder:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, keep: int = KEPT_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain: dict[str, bytes] = {}  # "w" stands for " w", "\0w" for "w" without the space
        self.keep = keep

    @classmethod
    def of(cls, path: str, keep: int = KEPT_PIECES) -> "PieceEncoder":
        """One encoder for each vocabulary and worker, kept between tasks."""
        working("tokens")
        if path not in _open:
            _open[path] = cls(path, keep)
            gc.set_threshold(100_000, 50, 50)  # a worker makes many short-lived lists and no cycles
        _open[path].keep = keep
        return _open[path]

    def _learn(self, names: set[str]) -> dict[str, bytes]:
        """The ids of pieces that aren't kept: those of the letters and of the punctuation behind them."""
        get, parts = self.plain.get, {}
        for name in names:
            word = name.rstrip(TAIL)
            parts[name] = (word, "\x00" + name[len(word) :]) if word and len(word) < len(name) and word[-1].isalpha() else (name,)
        new = [p for p in {p for ps in parts.values() for p in ps} if get(p) is None]
        codes = self.tokenizer.encode_batch_fast([p[1:] if p[:1] == "\x00" else " " + p for p in new], add_special_tokens=False) if new else ()
        found = {p: array("I", e.ids).tobytes() for p, e in zip(new, codes, strict=True)}
        whole = {name: b"".join([found[p] if p in found else get(p) for p in ps]) for name, ps in parts.items()}
        if len(self.plain) < self.keep:
            self.plain.update(found)
            self.plain.update(whole)
        return whole

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text; null counts as empty."""
        if not text:
            return b""
        if any(t in text for t in self.added):  # they take part in no piece
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        rare = any(c in text for c in (RARE[:5] if text.isascii() else RARE))
        names = None if rare and ODD.search(text) else ("\x00" + text.replace("\n", " \x00\n \x00")).split(" ")
        if names is None or "" in names or "\x00" in names:
            if "\x00" in text:
                return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            names = [p[1:] if p[0] == " " and len(p) > 1 else "\x00" + p for p in PIECE.findall(text)]
        parts = list(map(self.plain.get, names))
        if None in parts:
            found = self._learn({n for n, p in zip(names, parts, strict=True) if p is None})
            parts = [found[n] if p is None else p for n, p in zip(names, parts, strict=True)]
        return b"".join(parts)
