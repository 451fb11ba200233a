"""Exact subword ids through a cache over white-space separated chunks.

The tokenizer drops white space and never matches across it, so a text's ids are the ids of
its chunks one after another.  A worker keeps the chunks it has seen; a miss is split further
where that is provably neutral and only then given to the library.
"""

from __future__ import annotations

import os
import string

#: Trailing ASCII punctuation always forms its own pre-token behind a letter or digit.
_PUNCT = string.punctuation.encode()
_LONGEST_CACHED = 64
_workers: dict = {}


def _byte_symbols() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the rest follow from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in printable}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(printable))
    return table


class ChunkIds(dict):
    """chunk bytes -> its ids as little-endian unsigned 32-bit integers.

    Bounded: beyond ``limit`` entries the cold part is forgotten and only ``frequent`` stays.
    """

    def __init__(self, path: str, limit: int, frequent: dict[bytes, bytes] | None = None):
        super().__init__(frequent or {})
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.limit = limit + len(self)
        self.frequent = dict(frequent or {})
        self.symbols = _byte_symbols()

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self._encode(chunk)
        if len(chunk) <= _LONGEST_CACHED:
            if len(self) >= self.limit:
                self.clear()
                self.update(self.frequent)
            self[chunk] = ids
        return ids

    def _encode(self, chunk: bytes) -> bytes:
        if b"<|" not in chunk:
            core = chunk.rstrip(_PUNCT)
            if core and len(core) < len(chunk) and _ends_in_letter(core):
                return self[core] + self[chunk[len(core) :]]
            if chunk.isalpha():  # ASCII letters only
                lowered = chunk.lower()
                if lowered != chunk:
                    return self[lowered]
                return _packed(t.id for t in self.model.tokenize(chunk.decode()))
            word = chunk.decode("utf-8", "replace")
            if _plain_letters(word):
                word = word.lower().encode()
                return _packed(t.id for t in self.model.tokenize("".join(map(self.symbols.__getitem__, word))))
        return _packed(self.library.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def text_ids(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def _packed(ids) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


def _plain_letters(word: str) -> bool:
    """Letters below U+0180 are composed already and lower-case one to one (but for U+0130)."""
    return word.isalpha() and max(word) < "ƀ" and "İ" not in word


def _ends_in_letter(core: bytes) -> bool:
    if core[-1] < 128:
        return core[-1:].isalnum()
    return _plain_letters(core[-2:].decode("utf-8", "replace")[-1])


def chunk_ids(name: str, limit: int, frequent: dict[bytes, bytes] | None = None, key: object = None) -> ChunkIds:
    """This worker's cache for a vocabulary file (of ``public_tokenizers``, or a path)."""
    at = (name, limit, key)
    if at not in _workers:
        _workers.clear()
        _workers[at] = ChunkIds(vocabulary_path(name), limit, frequent)
    return _workers[at]


def vocabulary_path(name: str) -> str:
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
