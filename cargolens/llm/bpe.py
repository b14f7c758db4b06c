"""Byte-level BPE ids of a public vocabulary, with the words of a task remembered."""

from __future__ import annotations

import base64
import functools
import json
import os
import re
from array import array

import tiktoken

_REMEMBERED = 1_000_000
_BLOCK = 1 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens(vocabulary: str | None = None) -> dict[str, int]:
    """Tokens beside the merges, of the ``tokenizers`` file that lies beside the ranks."""
    path = os.path.splitext(vocabulary or default_vocabulary())[0] + ".json"
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}


class _Words(dict):
    """Ids of a word with the space before it, as little-endian 32-bit integers."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str):
        if len(self) > _REMEMBERED:
            self.clear()
        # After white space the next space belongs to the run before it: no cut there.
        ids = None if not word or word[-1].isspace() else self.encode(" " + word)
        if len(word) < 64:
            self[word] = ids
        return ids


class Encoder:
    """text -> ids as bytes.

    A new token always starts where a space follows anything but white space, so a text is
    the words of that cut, each looked up or encoded by itself.  Texts with runs of white
    space are encoded as they are.  A text is first cut at the ``added`` tokens (name: id),
    each of which has its own id; without them their names are ordinary text.
    """

    def __init__(self, vocabulary: str | None = None, added: dict[str, int] | None = None):
        import public_tokenizers

        with open(vocabulary or default_vocabulary(), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding(
            "bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.words = _Words(self._ids)
        self.added = {name: array("I", [i]).tobytes() for name, i in (added or {}).items()}
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, longest))) if longest else None

    def _ids(self, text: str) -> bytes:
        return array("I", self.bpe.encode_ordinary(text)).tobytes()

    def _block(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            try:
                return self._ids(first) + b"".join(map(self.words.__getitem__, rest))
            except TypeError:  # a word ends in white space
                pass
        return self._ids(text)

    def __call__(self, text: str) -> bytes:
        if self.cut is None:
            return self._plain(text)
        done, start = [], 0
        for found in self.cut.finditer(text):
            done += [self._plain(text[start : found.start()]), self.added[found[0]]]
            start = found.end()
        done.append(self._plain(text[start:]))
        return b"".join(done)

    def _plain(self, text: str) -> bytes:
        done, start = [], 0
        while len(text) - start > _BLOCK:
            end = text.find(" ", start + _BLOCK)
            while end > 0 and text[end - 1].isspace():
                end = text.find(" ", end + 1)
            if end < 0:
                break
            done.append(self._next(text[start:end], start))
            start = end
        done.append(self._next(text[start:], start))
        return b"".join(done)

    def _next(self, block: str, start: int) -> bytes:
        if start == 0:
            return self._block(block)
        # Starts with the space of its first word.
        words = block[1:].split(" ")
        try:
            return b"".join(map(self.words.__getitem__, words))
        except TypeError:
            return self._ids(block)


@functools.cache
def encoder(vocabulary: str | None = None) -> Encoder:
    """One for a worker process, so that its later tasks find the words of earlier ones.

    Its ids are those of the ``tokenizers`` library, added tokens included.
    """
    return Encoder(vocabulary, added_tokens(vocabulary))
