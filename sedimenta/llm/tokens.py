"""Tokenising whole texts with the ``tokenizers`` library, one encoding per distinct
white-space-delimited chunk.

The vocabularies used here drop white space and never join across it, so a text's ids
are its chunks' ids one after another.  Each Python worker keeps a bounded table of the
chunks it has met, and only unseen chunks go through the library, many in one text.  The
vocabulary composes characters before it lower-cases them, so ASCII letters are lower-cased
here only where no combining mark could have joined them: in texts without the lead bytes of
U+0300 to U+037F, and in chunks of ASCII alone."""

from __future__ import annotations

import os
from itertools import chain, repeat

import numpy as np
from tokenizers import Tokenizer

#: Chunks that a worker remembers before it starts afresh: a bound on memory alone.
REMEMBERED = 1_000_000
#: Chunks that go through the library as one text.
JOINED = 256
#: Signs that never join the ASCII letter or digit before them.
TAILS = b",.;:!?"
MARK = b"\x01"

_ENCODERS: dict[str, "ChunkEncoder"] = {}


class ChunkEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # A chunk that stands between others in one text: a single id that no other chunk has.
        mark = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 and self.tokenizer.id_to_token(mark[0]) not in (None, self.tokenizer.model.unk_token) else None
        self.tails = self._library([bytes([x]) for x in TAILS])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts = np.zeros(1 << 16, np.int64)
        self.sizes = np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _library(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks in a row, number of ids a chunk)."""
        if self.mark is None or any(MARK in c for c in chunks):
            each = [e.ids for e in self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            return np.fromiter(chain.from_iterable(each), np.uint32, int(sizes.sum())), sizes
        texts = [(b" " + MARK + b" ").join([*chunks[i : i + JOINED], b""]).decode() for i in range(0, len(chunks), JOINED)]
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.flatnonzero(flat == self.mark)
        return np.delete(flat, ends), np.diff(ends, prepend=-1) - 1

    def _learn(self, chunks: list[bytes]) -> None:
        # A chunk such as b"word," is b"word" and b",": only the word needs encoding.
        bodies = [c[:-1] if len(c) > 1 and c[-1] in TAILS and (97 <= c[-2] <= 122 or 48 <= c[-2] <= 57) else c for c in chunks]
        at = np.fromiter(map(self.known.get, bodies, repeat(-1)), np.int64, len(bodies))
        unseen = np.flatnonzero(at < 0)
        new = list(dict.fromkeys(bodies[i] for i in unseen.tolist()))
        starts, sizes = self.starts[at], self.sizes[at].astype(np.int64)
        if new:
            ids, own = self._library(new)
            begin = self._append(ids) + np.cumsum(own) - own
            number = dict(zip(new, range(len(new)), strict=True))
            place = np.fromiter((number[bodies[i]] for i in unseen.tolist()), np.int64, len(unseen))
            starts[unseen], sizes[unseen] = begin[place], own[place]
        tailed = np.fromiter((len(b) < len(c) for b, c in zip(bodies, chunks, strict=True)), bool, len(chunks)).nonzero()[0]
        if len(tailed):
            ids, own = self.tails
            tail = np.fromiter((TAILS.index(chunks[i][-1]) for i in tailed.tolist()), np.int64, len(tailed))
            begin, body, size = starts[tailed], sizes[tailed], sizes[tailed] + own[tail]
            first = np.cumsum(size) - size
            out = np.empty(int(size.sum()), np.uint32)
            within = np.arange(len(out)) - np.repeat(first, size)
            inside = within < np.repeat(body, size)
            out[inside] = self.ids[(np.repeat(begin, size) + within)[inside]]
            out[~inside] = ids[(np.repeat((np.cumsum(own) - own)[tail] - body, size) + within)[~inside]]
            starts[tailed], sizes[tailed] = self._append(out) + first, size
        n = len(self.known)
        while n + len(chunks) > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, len(self.starts) * 2), np.resize(self.sizes, len(self.sizes) * 2)
        self.starts[n : n + len(chunks)], self.sizes[n : n + len(chunks)] = starts, sizes
        self.known.update(zip(chunks, range(n, n + len(chunks)), strict=True))

    def _append(self, ids: np.ndarray) -> int:
        at = self.used
        while at + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, len(self.ids) * 2)
        self.ids[at : at + len(ids)] = ids
        self.used = at + len(ids)
        return at

    @staticmethod
    def chunks(data: bytes) -> list[bytes]:
        # The names of special tokens count with their own case only.
        if b"<|" in data:
            return data.split()
        return data.lower().split() if data.isascii() or (b"\xcc" not in data and b"\xcd" not in data) else [c.lower() if c.isascii() else c for c in data.split()]

    def encode(self, texts: list[bytes], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets), each text followed by ``end``."""
        if len(self.known) > REMEMBERED:
            self._forget()
        split = [self.chunks(t) for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        chunks = list(chain.from_iterable(split))
        flat = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(flat < 0).tolist()
        if new:
            self._learn(list({chunks[i] for i in new}))
            flat[new] = np.fromiter((self.known[chunks[i]] for i in new), np.int64, len(new))
        sizes = self.sizes[flat].astype(np.int64)
        sums = np.concatenate(([0], np.cumsum(sizes)))
        first = np.concatenate(([0], np.cumsum(counts)))
        pure = sums[first]
        extra = 0 if end is None else 1
        offsets = pure + extra * np.arange(len(pure))
        out = np.empty(int(offsets[-1]), np.uint32)
        if len(flat):
            row = np.repeat(np.arange(len(texts)), np.diff(pure))
            at = np.arange(len(row)) + extra * row
            out[at] = self.ids[np.repeat(self.starts[flat] - sums[:-1], sizes) + np.arange(len(row))]
        if end is not None:
            out[offsets[1:] - 1] = end
        return out, offsets


def encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def default_vocabulary() -> str:
    """The word vocabulary's file, wherever the public package has put it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
