"""Token ids of a byte-level vocabulary by way of pieces that repeat.

A pre-token of such a vocabulary holds white space at its start only, or is nothing else. So the ids of a text are those of
its pieces, one after another, where a piece begins at each run of ASCII white space that follows another character, and
at ASCII punctuation that follows a letter.
`tests/llm/test_dominance.py` holds that against whole texts.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable
from functools import cache

import numpy as np

from trolley.llm.textblock import OTHER_VALUE, SPACE, PrefixHash
from trolley.llm.vocab import _ASCII, _LATIN, _PUNCT, FLAT, JOINED, MEMO, Memo, vocabulary_path

#: Bytes of a text that are cut at a time.
SLAB = 1 << 20
#: White space outside ASCII, as UTF-8 (U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000).
WIDE_SPACE = [chr(x).encode() for x in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_WIDE = np.array([int.from_bytes(x) for x in WIDE_SPACE])


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters of Latin-1."""
    lead = np.zeros(len(data), bool)
    lead[:-1] = (data[:-1] == 0xC3) & _LATIN[data[1:]]
    out = _ASCII[data] | lead
    out[1:] |= lead[:-1]
    return out


def starts(data: np.ndarray, letter: np.ndarray, marks: np.ndarray = _PUNCT) -> np.ndarray:
    """Where a piece begins, but for the first: ASCII white space behind a character that is none, one of the marks behind a letter of Latin-1."""
    space = SPACE[data[1:]] & ~SPACE[data[:-1]]
    wide = np.flatnonzero(space & (data[:-1] >= 0x80) & ~letter[:-1]) + 1
    if len(wide):
        last = np.zeros(len(wide), np.int64)
        for back in (3, 2, 1):
            last = last << 8 | np.where(wide >= back, data[np.maximum(wide - back, 0)], 0)
        space[wide[np.isin(last, _WIDE) | np.isin(last & 0xFFFF, _WIDE)] - 1] = False
    return np.flatnonzero(space | (marks[data[1:]] & letter[:-1])) + 1


class Pieces(Memo):
    """As its base, with pieces that keep the white space before them. special: tokens that a text may spell out; no piece begins inside."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], words: Callable[[list[str]], list[bytes]], special: list[str]):
        super().__init__(encode, words)
        if any(c.isspace() for x in special for c in x):
            raise ValueError("a special token with white space can't be kept whole")
        self.marks = _PUNCT.copy()
        self.marks[[b for x in special for a, b in zip(x.encode(), x.encode()[1:], strict=False) if _ASCII[a] or a >= 0x80]] = False

    def stream(self, data: np.ndarray, o: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        if self.known.n > MEMO or self.used > FLAT:
            self._forget()
        letter = letters(data)
        begin = np.sort(np.concatenate([starts(data, letter, self.marks), o[:-1][o[:-1] < o[1:]]]), kind="stable")
        begin = begin[np.append(True, begin[1:] > begin[:-1])[: len(begin)]]
        stop, doc = np.append(begin[1:], len(data))[: len(begin)], np.searchsorted(o, begin, "right") - 1
        a, b = PrefixHash(data).of(begin, stop), PrefixHash(data, OTHER_VALUE).of(begin, stop)
        at = self.known.find(a, b)
        new = np.flatnonzero(at < 0)
        if len(new):
            by = new[np.lexsort((b[new], a[new]))]
            first = np.append(True, (a[by[1:]] != a[by[:-1]]) | (b[by[1:]] != b[by[:-1]]))
            by = by[first]
            inside = np.concatenate([[0], np.cumsum(letter)])
            x, y = begin[by], stop[by]
            word = (data[x] == 0x20) & (y > x + 1) & (inside[y] - inside[x] == y - x - 1)  # a space and letters
            self._learn(data, x, y, word, a[by], b[by])
            at[new] = self.known.find(a[new], b[new])
        n = self.count[at]
        ids = self.flat[np.repeat(self.start[at] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        ends = np.cumsum(np.bincount(doc, n, len(o) - 1).astype(np.int64))
        if end is not None:
            ids, ends = np.insert(ids, ends, end), ends + np.arange(1, len(o))
        return ids, np.concatenate([[0], ends])

    def long(self, data: np.ndarray, end: int) -> np.ndarray:
        """The ids of one text and the end id, slab by slab: beside its ids a slab's arrays are all that is held."""
        out, at, size = [], 0, SLAB
        while at < len(data):
            slab = data[at : at + size]
            inner = starts(slab, letters(slab), self.marks)
            if at + len(slab) < len(data):
                if not len(inner):  # one piece longer than the slab
                    size *= 2
                    continue
                slab = slab[: inner[-1]]
            out.append(self.stream(slab, np.array([0, len(slab)]))[0])
            at, size = at + len(slab), SLAB
        return np.concatenate([*out, np.array([end], self.kind)])


@cache
def byte_bpe(name: str = "byte_bpe_50k.json") -> Pieces:
    """A byte-level JSON vocabulary of the tokenizers library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path(name))
    leads = np.zeros(tokenizer.get_vocab_size(), bool)
    leads[[i for token, i in tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True  # fixed value: how a space is spelt

    def encode(pieces: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def words(strings: list[str]) -> list[bytes]:
        """The ids of pieces of a space and letters: a text of many is cut before the tokens that begin with a space."""
        out = []
        for a in range(0, len(strings), JOINED):
            part = strings[a : a + JOINED]
            ids = np.array(tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            first = np.flatnonzero(leads[ids])
            if len(first) == len(part) and first[0] == 0:
                whole, at = ids.tobytes(), [*(4 * first).tolist(), 4 * len(ids)]
                out += [whole[i:j] for i, j in zip(at, at[1:], strict=False)]
            else:
                out += encode(part)
        return out

    return Pieces(encode, words, [x.content for x in tokenizer.get_added_tokens_decoder().values()])
