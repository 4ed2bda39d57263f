"""Token ids of whole texts from public vocabularies, encoding each distinct piece of text once.

A text is cut where its vocabulary's own pre-tokenizer must cut too: before a run of white space that follows
anything else, and between an ASCII letter and a sentence mark.  So the ids of the pieces laid end to end are
the ids of the text.  Texts with white space beyond ASCII, or with "<|", which may open a special token, are
encoded whole.  What pieces have become is remembered by two hashes, in flat arrays of bounded size.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import SPACES, Texts, Words, find_words, hash_words, text_slices

def vocabulary(name: str) -> str:
    """Where the file of a public vocabulary lies on this machine."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


_MARK = np.zeros(256, bool)
_MARK[list(b".,!?;:")] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_WHITE = np.zeros(256, bool)
_WHITE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32



class PieceStore:
    """Byte strings by hash -> their numbers, in flat arrays.

    encode gives the numbers of new ones.  When there are more than `most`, all are forgotten and learnt anew
    as they come.  A second, independent hash of every piece is held against that of the string that was learnt,
    so what is known is told apart by 128 bits; a piece whose second hash differs is encoded by itself.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int, wide: bool = False):
        self.encode, self.most, self.dtype = encode, most, np.uint32 if wide else np.uint16
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.check = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.pool = np.zeros(1 << 16, self.dtype)
        self.used = 0

    def _store(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lays the numbers of texts at the end of the pool: where they begin and how many they are."""
        flat: list[int] = []
        size = np.empty(len(texts), np.int32)
        at = 0
        for k in range(0, len(texts), 20_000):
            for ids in self.encode(texts[k : k + 20_000]):
                flat += ids
                size[at] = len(ids)
                at += 1
        need = self.used + len(flat)
        if need > len(self.pool):
            grown = np.zeros(max(need, len(self.pool) * 3 // 2), self.dtype)
            grown[: self.used] = self.pool[: self.used]
            self.pool = grown
        self.pool[self.used : need] = flat
        begin = self.used + np.cumsum(size, dtype=np.int64) - size
        self.used = need
        return begin, size

    def _learn(self, keys: np.ndarray, check: np.ndarray, texts: list[str]) -> None:
        begin, size = self._store(texts)
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.check = np.insert(self.check, where, check)
        self.begin = np.insert(self.begin, where, begin)
        self.size = np.insert(self.size, where, size)

    def lookup(self, t: Texts, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place and number of the numbers of each distinct piece, and which of those each piece is."""
        h, h2 = hash_words(t, w), hash_words(t, w, 1)
        keys, first, which = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        if len(self.keys):
            new = np.flatnonzero((at >= len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != keys))
        else:
            new = np.arange(len(keys))
        if len(new):
            if len(self.keys) + len(new) > self.most:
                self.forget()
                new = np.arange(len(keys))
            self._learn(keys[new], h2[first[new]], self._pieces(t, w, first[new]))
            at = np.searchsorted(self.keys, keys)
        begin, size = self.begin[at], self.size[at]
        odd = np.flatnonzero(self.check[at][which] != h2)
        if len(odd):  # other strings under a known hash
            b, n = self._store(self._pieces(t, w, odd))
            which[odd] = len(begin) + np.arange(len(odd))
            begin, size = np.concatenate([begin, b]), np.concatenate([size, n])
        return begin, size, which

    @staticmethod
    def _pieces(t: Texts, w: Words, at: np.ndarray) -> list[str]:
        return [t.buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]

    def laid_out(self, begin: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all pieces end to end, and where each piece's end."""
        count = size[which]
        end = np.cumsum(count, dtype=np.int64)
        return self.pool[np.repeat(begin[which] - (end - count), count) + np.arange(end[-1] if len(end) else 0)], end


_encoders: dict[tuple[str, bool], TextEncoder] = {}


def text_encoder(name: str, spaced: bool) -> TextEncoder:
    """One encoder for each worker process, so what it knows lasts from task to task."""
    if (name, spaced) not in _encoders:
        _encoders[name, spaced] = TextEncoder(name, spaced)
    return _encoders[name, spaced]


class TextEncoder:
    """Ids of whole texts with the tokenizers library.

    spaced: white space goes to the word after it (byte-level kinds); otherwise it only separates, and
    letters are lower-cased one by one.
    """

    def __init__(self, name: str, spaced: bool, most: int = 2_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.spaced = spaced
        self.tokenizer = Tokenizer.from_file(vocabulary(name))
        self.whole = r"<\||[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
        self.store = PieceStore(self._many, most, self.tokenizer.get_vocab_size() > 1 << 16)

    def _many(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, t: Texts) -> Words:
        """Pieces as byte ranges."""
        buf = t.buf
        n = len(buf)
        if not n:
            return find_words(t)
        white = _WHITE[buf]
        start = np.zeros(n, bool)
        begins = t.offs[:-1]
        start[begins[begins < n]] = True
        if self.spaced:
            start[1:] |= white[1:] & ~white[:-1]
        else:
            start[1:] |= ~white[1:] & white[:-1]
        start[1:] |= _MARK[buf[1:]] & _LETTER[buf[:-1]]
        at = np.flatnonzero(start)
        end = np.append(at[1:], n)
        if not self.spaced:
            # a piece ends where white space begins; one that begins with white space (at a text's start) is none
            gap = np.flatnonzero(white[1:] & ~white[:-1]) + 1
            k = np.searchsorted(gap, at, side="right")
            stop = np.where(k < len(gap), gap[np.minimum(k, max(len(gap) - 1, 0))] if len(gap) else n, n)
            end = np.minimum(end, stop)
            at, end = at[~white[at]], end[~white[at]]
        bound = np.searchsorted(at, t.offs)
        return Words(at, end, np.repeat(np.arange(len(t)), np.diff(bound)), bound)

    def __call__(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For runs of texts: place of the first, ids laid end to end, len + 1 bounds."""
        for t in text_slices(texts, 3 << 20):
            yield t.first, *self._run(texts.slice(t.first, len(t)), t)

    def _run(self, texts: pa.Array, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        odd = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, self.whole), False).to_numpy(zero_copy_only=False))
        if not self.spaced:
            t = Texts(_LOWER[t.buf], t.offs, t.first)
        w = self._cut(t)
        begin, size, which = self.store.lookup(t, w)
        ids, end = self.store.laid_out(begin, size, which)
        bound = np.concatenate([[0], end])[w.bound]
        if len(odd):  # put the ids of whole texts in place
            parts = [ids[a:b] for a, b in zip(bound[:-1], bound[1:], strict=True)]
            for i in odd:
                parts[i] = np.array(self._many([texts[int(i)].as_py()])[0], ids.dtype)
            ids = np.concatenate(parts)
            bound = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, bound


def with_end(ids: np.ndarray, bound: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with end_id after each text."""
    n = len(bound) - 1
    out = np.empty(len(ids) + n, "<u4")
    last = bound[1:] + np.arange(n)
    body = np.ones(len(out), bool)
    body[last] = False
    out[body] = ids
    out[last] = end_id
    return out, bound + np.arange(n + 1)
