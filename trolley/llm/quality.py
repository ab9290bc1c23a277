"""Quality rules by tokeniser fertility.

A public vocabulary with byte fallback cuts the words of a text. Text of a language it knows yields a
steady number of characters per token, few byte pieces and a broad spread of tokens; encoded blobs,
repeated phrases and symbol noise do not. Each language (or, where the language is null, each script)
gets bands for all three from the quartiles of all its documents, and a document outside a band is rejected.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trolley.llm.textblock import SPACE, WORD, PrefixHash, as_batch, blocks, mixed, raw, spans
from trolley.llm.vocab import piece_bpe
from trolley.llm.workspace import ROW_KEY, Workspace, by_key, keyed, restored

WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
#: Half width of a band in half quartile distances, and the least such distance that a band assumes.
WIDTH, LEAST = 6.0, {"fallback_share": 0.02, "chars_per_token": 0.04, "entropy_ratio": 0.05}
#: Measures of which only too much counts against a document.
HIGH = {"fallback_share"}
#: A document of n tokens gets bands wider by sqrt(1 + SHORT / n): its mean scatters more.
SHORT = 120
MEASURES = "n_tokens long, chars_per_token double, fallback_share double, entropy_ratio double, script string"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Letters, as bytes: punctuation and symbols cost tokens but are no characters of a word. Digits, a token
#: each, are left out on both sides, so that numbers in prose do not count against it.
_LETTER = WORD.copy()
_LETTER[65:91] = True
_LETTER[48:58] = False
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
#: Scripts by the lead bytes of their characters in UTF-8.
_SCRIPTS = {"greek": (0xCE, 0xCF), "cyrillic": (0xD0, 0xD3), "hebrew": (0xD6, 0xD7), "arabic": (0xD8, 0xDB), "indic": (0xE0, 0xE0), "cjk": (0xE3, 0xED)}
_SCRIPT = np.zeros(256, np.int64)
_SCRIPT[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)]] = 1
for _k, (_a, _b) in enumerate(_SCRIPTS.values(), 2):
    _SCRIPT[_a : _b + 1] = _k
_NAMES = np.array(["none", "latin", *_SCRIPTS])


def _per_doc(flags: np.ndarray, o: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[o[1:]] - total[o[:-1]]


def _repeated(data: np.ndarray, o: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Words by document that lie in a window of WINDOW words found twice or more in the document."""
    n = len(o) - 1
    m = len(start) - WINDOW + 1
    if m <= 0:
        return np.zeros(n, np.int64)
    word = PrefixHash(data).of(start, end)
    at = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :])
    h = word[at] + mixed(doc[at].astype(np.uint64) + np.uint64(1))
    for k in range(1, WINDOW):
        h = h * np.uint64(0x9E3779B97F4A7C15) + word[at + k]
    h = mixed(h)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(at) + 1, bool)
    twice[:-1][order[1:][same]] = True
    twice[:-1][order[:-1][same]] = True
    cover = np.zeros(len(start) + 1, np.int64)
    hit = at[twice[:-1]]
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    return np.bincount(doc, np.cumsum(cover)[:-1] > 0, n).astype(np.int64)


def _entropy_ratio(ids: np.ndarray) -> float:
    """Entropy of the token ids over the logarithm of their number: 1 if all differ, 0 if all are the same."""
    n = len(ids)
    if n < 2:
        return 1.0
    ids = np.sort(ids, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]]))
    p = np.diff(edge) / n
    return float(-(p * np.log(p)).sum() / np.log(n))


def measures(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """One row per row of docs (doc_id, lang, text): counts of the words and the tokeniser's measures.

    A null text is empty; a text without words has no tokens and null measures.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *[(x.split()[0], pa.int64()) for x in BASE.split(", ")], ("n_tokens", pa.int64()), ("chars_per_token", pa.float64()), ("fallback_share", pa.float64()), ("entropy_ratio", pa.float64()), ("script", pa.string())])

    def run(batches):
        memo, fallback = piece_bpe(vocabulary)
        for batch, text in blocks(batches):
            o, data = raw(text)
            space = SPACE[data]
            start, end, doc = spans(~space, o)
            n_words = np.bincount(doc, minlength=len(text))
            first_byte = (data & 0xC0) != 0x80
            chars = _per_doc(~space & first_byte, o)
            letters = _per_doc(_LETTER[data] & first_byte, o)
            whole = data.tobytes()
            texts = [whole[a:b] for a, b in zip(o[:-1], o[1:], strict=True)]
            dup = []
            for t in texts:
                lines = [x for x in t.split(b"\n") if x.strip()]
                dup.append(len(lines) - len(set(lines)))
            flat, first = memo.stream(data, o)
            ids = [flat[i:j] for i, j in zip(first[:-1], first[1:], strict=True)]
            n = np.array([len(x) for x in ids])
            cut = np.maximum(n - _per_doc(_DIGIT[data], o), 0)
            scripts = np.stack([np.bincount(_SCRIPT[data[a:b]], minlength=len(_NAMES)) for a, b in zip(o[:-1], o[1:], strict=True)])
            scripts[:, 0] = 0
            with np.errstate(all="ignore"):
                yield as_batch(
                    schema, doc_id=batch.column("doc_id"), lang=batch.column("lang"), n_words=n_words, word_chars=chars, n_symbols=_per_doc(_SYMBOL[data], o), n_dup_lines=dup, n_repeat_words=_repeated(data, o, start, end, doc),
                    n_tokens=n, chars_per_token=pa.array(letters / cut, mask=cut == 0), fallback_share=pa.array(np.array([fallback[x].sum() for x in ids]) / n, mask=n == 0),
                    entropy_ratio=pa.array([_entropy_ratio(x) for x in ids], mask=n == 0), script=_NAMES[scripts.argmax(1)].tolist(),
                )

    return docs.select("doc_id", "lang", "text").mapInArrow(run, f"doc_id long, lang string, {BASE}, {MEASURES}")


def bands(measured: DataFrame) -> DataFrame:
    """By language, or by script where that is null: the middle and half width of the accepted measures."""
    failed = base_failed()
    out = measured.where(~failed).groupBy(_group().alias("band"))
    quartiles = [F.percentile_approx(m, [0.25, 0.5, 0.75], 10_000).alias(m) for m in LEAST]
    limits = []
    for m, least in LEAST.items():
        wide = WIDTH * F.greatest(F.lit(least), (F.col(m)[2] - F.col(m)[0]) / 2)
        limits += [F.col(m)[1].alias(f"{m}_mid"), wide.alias(f"{m}_wide")]
    return out.agg(*quartiles).select("band", *limits)


def _group() -> Column:
    return F.coalesce(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("script:"), "script"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def judged(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """Every document's counts, measures and verdict: base_failed, kept and, where rejected, the reason.

    Bands are wider for documents of few tokens. A text that fails the counts has no part in the bands; a group
    of such texts only has none. Repeated rows are judged each. Quartiles are approximate (one part in 10,000 of the
    documents), so with another layout of the table a text at the very edge of a band may fall to its other side.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "quality")
    measured = work.table(measures(docs, vocabulary), "measured")
    limits = work.table(bands(measured), "bands")
    few = limits.count() <= 10_000  # languages; more than that are joined by a shuffle
    joined = measured.withColumn("band", _group()).join(F.broadcast(limits) if few else limits, "band", "left")
    reason = F.when(base_failed(), "base")
    for m in LEAST:
        off = F.col(m) - F.col(f"{m}_mid")
        off = off if m in HIGH else F.abs(off)
        reason = reason.when(F.coalesce(off > F.col(f"{m}_wide") * F.sqrt(1 + SHORT / F.greatest("n_tokens", F.lit(1))), F.lit(False)), m)
    return joined.withColumn("reason", reason).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), F.col("reason").isNull().alias("kept"), "reason", "n_tokens", "chars_per_token", "fallback_share", "entropy_ratio", "script")


def kept(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """The rows of docs that pass, with all their columns. Each row is judged by itself, whatever its doc_id."""
    rows = keyed(docs, Workspace(docs.sparkSession, "kept"))
    bad = judged(by_key(rows), vocabulary).where(~F.col("kept")).select(F.col("doc_id").alias(ROW_KEY))
    return restored(rows.join(bad, ROW_KEY, "left_anti"), docs.columns)


def base_of(text: str | None) -> tuple[int, int, int, int, int]:
    """The counts of one text, plainly: what the tests hold `measures` against."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - WINDOW + 1):
        windows.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(WINDOW)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
