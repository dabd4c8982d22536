"""Whole-text encoding with a public tokenizer file, used inside tasks.

The tokenizer's normaliser and splitter never look across ASCII white space, so a text's ids are
those of its white-space chunks in order.  Chunks repeat a lot: each worker keeps the ids of
chunks that it has met twice (two bounded tables) and encodes only others.  Chunks of plain Latin
letters, with a full stop or comma after them or not, go straight to the vocabulary's merges; all
others take the tokenizer's whole path.
"""

from __future__ import annotations

import unicodedata
from array import array

import numpy as np

#: Chunks remembered per worker, and the longest chunk (bytes) worth remembering.
CHUNKS, CHUNK_BYTES = 600_000, 48


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, others for 256, 257, ..."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """``encode(texts)`` returns one little-endian uint32 array per text (null: empty text)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        letters = _byte_letters()
        # letters below U+0250 are their own canonical composition, so only case and bytes remain
        low = {chr(c): chr(c).lower() for c in range(0x250) if chr(c).isalpha() and unicodedata.is_normalized("NFC", chr(c))}
        self.letters = {c: "".join(letters[b] for b in x.encode()) for c, x in low.items() if len(x) == 1 and x.isalpha()}
        self.known: dict[bytes, bytes] = {}
        self.once: set[bytes] = set()

    def _word(self, chunk: bytes) -> list | None:
        """Tokens of a lower-case chunk of Latin letters, perhaps with a full stop or comma; else None."""
        tail = chunk[-1:]
        if tail == b"." or tail == b",":
            word = chunk[:-1]
            if word.isalpha():
                return self.merges(word.decode()) + self.merges(tail.decode())
        else:
            word, tail = chunk, b""
            if word.isalpha():
                return self.merges(word.decode())
        if not word or word.isascii():
            return None
        try:
            mapped = "".join(map(self.letters.__getitem__, word.decode()))
        except KeyError:
            return None
        return self.merges(mapped) + self.merges(tail.decode()) if tail else self.merges(mapped)

    def _whole(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in encoded]

    def encode(self, texts) -> list[np.ndarray]:
        known, once = self.known, self.once
        raw = [(t or "").encode("utf-8") for t in texts]
        # names of special tokens are case-sensitive: such texts take the whole path
        named = {i: t for i, (t, b) in enumerate(zip(texts, raw)) if b"<|" in b}
        split = [() if i in named else b.lower().split() for i, b in enumerate(raw)]
        new = set().union(*split).difference(known)
        now, slow = {}, []
        for c in new:
            tokens = self._word(c)
            if tokens is None:
                slow.append(c)
            else:
                now[c] = array("I", [t.id for t in tokens]).tobytes()
        if slow:
            now.update(zip(slow, self._whole([c.decode() for c in slow])))
        known.update(now)
        out = [b"".join(map(known.__getitem__, chunks)) for chunks in split]
        if named:
            for i, ids in zip(named, self._whole(list(named.values()))):
                out[i] = ids
        short = {c for c in now if len(c) <= CHUNK_BYTES}
        for c in now.keys() - (short & once):  # only what has been met before stays
            del known[c]
        once.update(short)
        if len(once) > CHUNKS:
            once.clear()
        if len(known) > CHUNKS:
            known.clear()
        return [np.frombuffer(x, dtype="<u4") for x in out]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
