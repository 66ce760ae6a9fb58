"""Token ids of whole texts with the tokenizers library.

The vocabularies of this package drop white space before they look at words, so the ids of a text are those of its
space-separated words in order, and a word needs to be encoded once per worker. Only ASCII white space separates here; other
spaces stay inside a word and are left to the library. Words are remembered in two generations of bounded size.

A word of Latin letters (with or without one mark behind) is one piece for the usual byte-level pre-tokenizer, so it goes
straight to the library's BPE model, which is a third of the work of the whole chain. An encoder takes this way only if it
gives the same ids on ``PROBES``; all other words go through the whole chain.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from marketebb.llm.words import worker_cache

REMEMBERED = 300_000
BATCH_BYTES = 2 << 20
PROBES = ("THE", "Straße", "élève,", "Ñandú.", "Ærøskøbing", "naïveté", "ŐSZŰ", "x", "thonanontioniner", "ª", "ǅ")


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes. The tokenizer must drop white space (checked on use)."""

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        one, two = (self.tokenizer.encode(x, add_special_tokens=False).ids for x in ("a b", " a\n\tb "))
        if one != two:
            raise ValueError("this tokenizer keeps white space; its texts can't be encoded word by word")
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        # the printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.shown = {b: b for b in plain} | {b: 0x100 + i for i, b in enumerate(sorted({*range(256)} - {*plain}))}
        self.marks: dict[str, bytes] = {"": b""}
        for mark in ".,;:!?":
            self.marks[mark] = self._bytes(self.tokenizer.encode(mark, add_special_tokens=False).ids)
        self.direct = True
        self.direct = [self._word(w) for w in PROBES] == [self._bytes(e.ids) for e in self.tokenizer.encode_batch_fast([*PROBES], add_special_tokens=False)]

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def _word(self, word: str) -> bytes | None:
        """The ids of a word that is one piece and at most a mark, else None."""
        mark = word[-1:] if word[-1:] in self.marks else ""
        core = word[:-1] if mark else word
        if not core.isalpha() or not (core.isascii() or (max(core) < "\u0250" and "\u0130" not in core)):
            return None
        core = core.lower()
        if not core.isascii():
            core = core.encode().decode("latin-1").translate(self.shown)
        return self._bytes([t.id for t in self.tokenizer.model.tokenize(core)]) + self.marks[mark]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        young, old = self.young, self.old
        rest, one = [], self._word if self.direct else lambda w: None
        for w in set().union(*split) - young.keys():
            if (known := old.get(w)) is None and (known := one(w.decode("utf-8", "replace"))) is None:
                rest.append(w)
            else:
                young[w] = known
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False)
        for w, e in zip(rest, found, strict=True):
            young[w] = self._bytes(e.ids)
        out = [b"".join(map(young.__getitem__, ws)) for ws in split]
        if len(young) > REMEMBERED:
            self.old, self.young = young, {}
        return out


def encoder(path: str) -> Encoder:
    """One for each file and worker."""
    cache = worker_cache()
    if ("encoder", path) not in cache:
        cache["encoder", path] = Encoder(path)
    return cache["encoder", path]


def encoded(column: pa.Array, path: str, end: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, ids with the end id) of the texts of a column, some megabytes of text at a time; null counts as empty."""
    use, tail = encoder(path), np.array([end], "<u4").tobytes()
    column = column.cast(pa.large_binary())
    first, texts, size = 0, [], 0
    for i, x in enumerate(column):
        t = x.as_py() or b""
        if texts and size + len(t) > BATCH_BYTES:
            yield first, [ids + tail for ids in use.encode(texts)]
            first, texts, size = i, [], 0
        texts.append(t)
        size += len(t)
    if texts:
        yield first, [ids + tail for ids in use.encode(texts)]
