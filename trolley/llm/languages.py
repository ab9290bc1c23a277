"""Language identification by nearest centroid.

A text is a TF-IDF vector of its lower-cased byte n-grams (1 to 3 bytes), folded into a fixed number of
dimensions and scaled to length one. Each language has several centroids, found by spherical k-means over
a bounded sample of its labelled texts; the language of the centroid with the largest cosine is predicted,
and a text farther from it than nearly all of that centroid's own texts is marked as rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trolley.llm.textblock import as_batch, blocks, fixed_binary, mixed, raw
from trolley.llm.workspace import prepare

DIMENSIONS = 4096
#: Bounds of the sample that the classifier is fitted on: texts a language, and over all languages.
PER_LANGUAGE, SAMPLE = 600, 6000
CENTROIDS, ROUNDS = 4, 12
#: A language's own texts closer than its rejection distance.
OWN_SHARE = 0.999
UNKNOWN = "und"


def _fold() -> np.ndarray:
    return (mixed(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(DIMENSIONS)).astype(np.uint16)


class _Vectors:
    """TF vectors of texts: one row of DIMENSIONS counts each."""

    def __init__(self):
        self.pair = _fold()
        self.single = self.pair[:256]
        self.third = (mixed(np.arange(256, dtype=np.uint64) + np.uint64(1 << 20)) % np.uint64(DIMENSIONS)).astype(np.uint16)

    def of(self, text: pa.Array) -> np.ndarray:
        o, data = raw(pc.utf8_lower(text))
        out = np.zeros((len(text), DIMENSIONS), np.float32)
        for i, (a, b) in enumerate(zip(o[:-1], o[1:], strict=True)):
            x = data[a:b]
            two = self.pair[x[:-1].astype(np.uint16) << 8 | x[1:]]
            three = two[:-1] ^ self.third[x[2:]] if len(x) > 2 else two[:0]
            out[i] = np.bincount(self.single[x], minlength=DIMENSIONS) + np.bincount(two, minlength=DIMENSIONS) + np.bincount(three, minlength=DIMENSIONS)
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(counts, out=counts) * idf)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(labelled: DataFrame) -> dict:
    """The classifier of labelled rows (doc_id, text, lang), from at most SAMPLE texts spread over the languages.

    The sample takes the rows with the smallest hashes of doc_id, a share of each language's rows; rows whose
    language or text is null, or whose text has no letter, teach nothing. Without any row there is no language.
    """
    usable = labelled.where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    share = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE).collect()}
    if not share:
        return {"languages": [], "idf": np.ones(DIMENSIONS, np.float32), "centroids": np.zeros((0, DIMENSIONS), np.float32), "owner": np.zeros(0, int), "least": np.zeros(0)}
    most = max(1, min(PER_LANGUAGE, SAMPLE // len(share)))
    rate = F.create_map(*[F.lit(x) for k, n in share.items() for x in (k, most / n)])[F.col("lang")]
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)

    def vectors(batches):
        make = _Vectors()
        schema = pa.schema([("lang", pa.string()), ("counts", pa.binary())])
        for batch, text in blocks(batches, limit=1 << 20):
            yield as_batch(schema, lang=batch.column("lang"), counts=fixed_binary(np.minimum(make.of(text), 65535).astype(np.uint16)))

    rows = usable.where(draw < rate).select("lang", "text").mapInArrow(vectors, "lang string, counts binary").limit(2 * SAMPLE).toArrow()
    labels = np.array(rows["lang"].to_pylist())
    counts = np.frombuffer(b"".join(rows["counts"].to_pylist()), np.uint16).reshape(len(labels), DIMENSIONS).astype(np.float32)
    order = np.lexsort((counts.sum(1), labels))
    labels, counts = labels[order], counts[order]
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    x = _weigh(counts, idf)
    languages, centres, owner, least = sorted(set(labels)), [], [], []
    for k, name in enumerate(languages):
        own = x[labels == name]
        centre = own[np.linspace(0, len(own) - 1, min(CENTROIDS, len(own))).astype(int)]
        for _ in range(ROUNDS):
            nearest = (own @ centre.T).argmax(1)
            centre = _unit(np.stack([own[nearest == j].sum(0) if (nearest == j).any() else centre[j] for j in range(len(centre))]))
        cosine = own @ centre.T
        centres.append(centre)
        owner += [k] * len(centre)
        least += [np.quantile(cosine.max(1), 1 - OWN_SHARE)] * len(centre)
    return {"languages": languages, "idf": idf, "centroids": np.concatenate(centres), "owner": np.array(owner), "least": np.array(least)}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score (largest cosine, 0 to 1), rejected, of every row's whole text.

    A null text, or one without a letter, is `und` with score 0, and rejected; so is all of it if no
    language was learned.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches):
        m, make = sent.value, _Vectors()
        names = np.array([*m["languages"], UNKNOWN], object)
        for batch, text in blocks(batches, limit=1 << 20):
            letter = batch.column("letter").to_numpy(zero_copy_only=False)
            best, score, out = np.full(len(text), -1), np.zeros(len(text)), np.ones(len(text), bool)
            if len(m["languages"]):
                for a in range(0, len(text), 256):
                    cosine = _weigh(make.of(text.slice(a, 256)), m["idf"]) @ m["centroids"].T
                    j = cosine.argmax(1)
                    best[a : a + 256], score[a : a + 256] = m["owner"][j], cosine[np.arange(len(j)), j]
                    out[a : a + 256] = score[a : a + 256] < m["least"][j]
            best = np.where(letter, best, -1)
            yield as_batch(schema, doc_id=batch.column("doc_id"), lang_pred=names[best].tolist(), score=np.where(best >= 0, np.clip(score, 0, 1), 0.0), rejected=out | (best < 0))

    return docs.select("doc_id", "text", has_letter(F.col("text")).alias("letter")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(folds: int, fold: int) -> Column:
    """Whether crc32 of doc_id, written as text, leaves `fold` on division by folds; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """Predictions for all rows of docs by a classifier that learns from the rows outside the held-out third."""
    prepare(docs.sparkSession)
    model = fit(docs.where(~held_out(3, 1)).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score", "rejected")
