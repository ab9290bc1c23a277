"""Public tokenisers inside tasks, with a bounded memo of words they have already cut.

A pre-token of these tokenisers never holds ASCII white space, so a text's ids are those of its
white-space separated pieces, one after another. `tests/llm/test_vocab.py` holds that against whole texts.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable
from functools import cache

import numpy as np

from trolley.llm.hashtable import Growing
from trolley.llm.textblock import OTHER_VALUE, SPACE, PrefixHash, spans

MEMO = 500_000
LONG = 48
#: Words whose ids are asked for as one text.
JOINED = 2000
#: Ids that are remembered at most, but for one block of texts.
FLAT = 1 << 23
#: Letters of a simple word, by byte: ASCII, and behind the lead byte 0xC3 the other letters of Latin-1.
_ASCII, _LATIN, _PUNCT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True
_LATIN[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def vocabulary_path(name: str) -> str:
    """A public vocabulary's file; a path of the caller's own is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo:
    """Token ids of texts by way of their white-space separated pieces, of which a bounded number is remembered.

    encode gives the ids of whole pieces as bytes of `kind`. Where words is given, a piece that is a word of Latin-1
    letters with ASCII punctuation behind it is cut in two, as the tokeniser itself does, and words gives the ids of
    such lower-cased words. Pieces are told apart by 128-bit hashes, looked up a block of texts at a time.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], words: Callable[[list[str]], list[bytes]] | None = None, kind: str = "<u4"):
        self.encode, self.words, self.kind = encode, words, np.dtype(kind)
        self._forget()

    def _forget(self) -> None:
        self.known, self.flat, self.used = Growing(), np.zeros(1 << 18, self.kind), 0
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, word: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Remember pieces that are not known, each given once; word: which are lower-case words."""
        whole = data.tobytes()
        pieces = [whole[i:j].decode("utf-8", "replace") for i, j in zip(start.tolist(), end.tolist(), strict=True)]
        by = np.argsort(~word, kind="stable")
        n = int(word.sum())
        ordered = [pieces[k] for k in by.tolist()]
        ids = [*(self.words(ordered[:n]) if n else []), *self.encode(ordered[n:])]
        size = np.array([len(x) for x in ids], np.int64) // self.kind.itemsize
        new = np.frombuffer(b"".join(ids), self.kind)
        if self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + 2 * len(new), self.kind)])
        self.flat[self.used : self.used + len(new)] = new
        self.start, self.count = np.concatenate([self.start, self.used + np.cumsum(size) - size]), np.concatenate([self.count, size])
        self.used += len(new)
        self.known.add(a[by], b[by])

    def _cut(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
        """The bytes with simple words in lower case, and the pieces: starts, ends, whether it is a word, the piece it came from."""
        lead = np.zeros(len(data), bool)
        lead[:-1] = (data[:-1] == 0xC3) & _LATIN[data[1:]]
        letter = _ASCII[data] | lead
        letter[1:] |= lead[:-1]
        odd = np.flatnonzero(~letter & ~SPACE[data])  # punctuation, digits, other characters
        first = np.searchsorted(odd, start)
        last = np.searchsorted(odd, stop)
        mid = np.where(first < last, np.append(odd, len(data))[first], stop)  # where the letters end
        marks = np.concatenate([[0], np.cumsum(_PUNCT[data[odd]])])
        simple = (mid > start) & (last - first == stop - mid) & (marks[last] - marks[first] == last - first) & (stop - start <= LONG)
        out = data.copy()
        upper = np.flatnonzero((data >= 65) & (data <= 90))
        out[upper] += 32
        high = np.flatnonzero(lead) + 1
        high = high[(data[high] <= 0x9E)]
        out[high] += 0x20
        for i, j in zip(start[~simple].tolist(), stop[~simple].tolist(), strict=True):
            out[i:j] = data[i:j]
        n = 1 + (simple & (mid < stop))
        of = np.repeat(np.arange(len(start)), n)
        rest = np.zeros(len(of), bool)
        rest[1:] = of[1:] == of[:-1]
        return out, np.where(rest, mid[of], start[of]), np.where(simple[of] & ~rest, mid[of], stop[of]), simple[of] & ~rest, of

    def stream(self, data: np.ndarray, o: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts data[o[i]:o[i + 1]], one after another, each with the end id behind it if there is one, and where each text's begin."""
        if self.known.n > MEMO or self.used > FLAT:
            self._forget()
        start, stop, doc = spans(~SPACE[data], o)
        word = np.zeros(len(start), bool)
        if self.words and len(start):
            data, start, stop, word, of = self._cut(data, start, stop)
            doc = doc[of]
        a, b = PrefixHash(data).of(start, stop), PrefixHash(data, OTHER_VALUE).of(start, stop)
        at = self.known.find(a, b)
        new = np.flatnonzero(at < 0)
        if len(new):
            by = new[np.lexsort((b[new], a[new]))]
            first = np.ones(len(by), bool)
            first[1:] = (a[by[1:]] != a[by[:-1]]) | (b[by[1:]] != b[by[:-1]])
            by = by[first]
            self._learn(data, start[by], stop[by], word[by], a[by], b[by])
            at[new] = self.known.find(a[new], b[new])
        n = self.count[at]
        ids = self.flat[np.repeat(self.start[at] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        ends = np.cumsum(np.bincount(doc, n, len(o) - 1).astype(np.int64))
        if end is not None:
            ids, ends = np.insert(ids, ends, end), ends + np.arange(1, len(o))
        return ids, np.concatenate([[0], ends])

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as bytes."""
        ids, first = self.stream(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
        return [ids[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)]


@cache
def word_bpe(name: str = "word_bpe_49k.json") -> Memo:
    """A JSON vocabulary of the tokenizers library; each id is four little-endian bytes."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path(name))
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    ends[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def encode(pieces: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def words(strings: list[str]) -> list[bytes]:
        """The ids of words of letters: a text of many is cut behind the tokens that end a word."""
        out = []
        for a in range(0, len(strings), JOINED):
            part = strings[a : a + JOINED]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(ends[ids]) + 1
            if len(last) == len(part) and len(ids) == (last[-1] if len(last) else 0):
                whole, at = ids.tobytes(), (4 * last).tolist()
                out += [whole[i:j] for i, j in zip([0, *at], at, strict=False)]
            else:
                out += encode(part)
        return out

    probe = ["Word", "\u00c9t\u00e9,", "x!?"]
    e = encode(["word", "\u00e9t\u00e9", ",", "x", "!?"])
    fits = encode(probe) == [e[0], e[1] + e[2], e[3] + e[4]]
    return Memo(encode, words if fits else None)


@cache
def piece_bpe(name: str = "piece_bpe_32k.model") -> tuple[Memo, np.ndarray]:
    """A sentencepiece model: ids of each word as two or four little-endian bytes, and which ids are byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(name))
    kind = "H" if model.vocab_size() <= 1 << 16 else "I"

    def encode(pieces: list[str]) -> list[bytes]:
        return [array(kind, x).tobytes() for x in model.encode(pieces, num_threads=1)]

    return Memo(encode, kind="<u2" if kind == "H" else "<u4"), np.array([model.is_byte(i) for i in range(model.vocab_size())])
