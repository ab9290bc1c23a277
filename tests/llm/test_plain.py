"""Methods, pieces and the whole pipeline against plain versions."""

import gzip
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from test_operators import SCHEMA, WORDS, docs, empty, in_order, rows, shingles, similar_lines  # noqa: F401  fixtures

import corpus_pipeline
from trolley.llm import hashtable, languages, packing, quality, suffixes, textblock, vocab, warc


def test_sort_within_and_growing():
    rng = np.random.default_rng(1)
    group = np.sort(rng.integers(0, 50, 2000))
    value = rng.integers(0, 40, 2000).astype(np.uint64) << np.uint64(rng.integers(0, 58))
    tie = rng.integers(0, 9, 2000)
    by = textblock.sort_within(group, value, tie)
    assert list(zip(group[by], value[by], tie[by])) == sorted(zip(group, value, tie))
    table, a = hashtable.Growing(), rng.integers(0, 2**63, 5000).astype(np.uint64)
    a[1] = a[0]  # equal in the first half only
    b = rng.integers(0, 2**63, 5000).astype(np.uint64)
    for part in np.array_split(np.arange(5000), 7):
        assert (table.find(a[part], b[part]) == -1).all()
        table.add(a[part], b[part])
    assert (table.find(a, b) == np.arange(5000)).all() and table.find(a[:1], b[3:4])[0] == -1


def test_inflates_in_bounded_chunks(tmp_path):
    data = b"\0" * 3_000_000 + bytes(range(256)) * 10
    path = tmp_path / "a.gz"
    path.write_bytes(gzip.compress(data) + gzip.compress(b"") + gzip.compress(b"tail" * 5))
    chunks = list(warc.inflated(str(path), 4096))
    assert b"".join(chunks) == data + b"tail" * 5 and max(map(len, chunks)) <= 4096


def test_cut_texts_have_the_same_windows(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 5000).astype(np.uint8)
    o = np.array([0, 10, 2500, 2500, 5000])
    windows = lambda found: {(int(d), int(f) + k, int(p)) for d, f, n, _, p in zip(*found) for k in range(int(n))}
    whole = windows(suffixes.anchors(o, data))
    monkeypatch.setattr(suffixes, "WINDOWS", 700)
    assert windows(suffixes.anchors(o, data)) == whole and len(whole) == (2490 - 199) + (2500 - 199)


def plain_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(vocab.vocabulary_path("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids, 1]


def test_pieces_are_those_of_the_ids(docs, rows):  # noqa: F811
    window = 64
    want = Counter()
    for i, t, *_ in rows:
        ids = plain_ids(t)
        for at in range(0, len(ids), window):
            part = np.array(ids[at : at + window], "<u4")
            want[i, at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    got = packing.packed(docs, window=window, group=200)
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got.collect()) == want


def test_best_fit_against_a_plain_search():
    rng = np.random.default_rng(5)
    for window in (7, 64, 100):
        lengths = sorted(rng.integers(1, window + 1, 400).tolist(), reverse=True)
        room, want = [], []
        for n in lengths:
            tight = min((r for r in room if r >= n), default=None)
            want.append(window if tight is None else tight)
            if tight is None:
                room.append(window - n)
            else:
                room[room.index(tight)] -= n
        sequence, offset = packing.best_fit(lengths, window)
        assert [window - x for x in offset] == want and max(sequence) + 1 == len(room)


def test_measures_and_verdicts(docs, rows):  # noqa: F811
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocab.vocabulary_path("piece_bpe_32k.model"))
    measured = quality.measures(docs)
    got = Counter((r.doc_id, r.n_tokens, *[None if x is None else round(x, 9) for x in (r.chars_per_token, r.fallback_share, r.entropy_ratio)]) for r in measured.collect())
    want = Counter()
    for i, t, *_ in rows:
        ids = [x for w in re.findall(r"[^\x20\x09-\x0D]+", t or "") for x in model.encode(w)]
        letters, digits = len(re.findall(r"[A-Za-z\u0080-\U0010ffff]", t or "")), len(re.findall("[0-9]", t or ""))
        cut, n = max(len(ids) - digits, 0), Counter(ids)
        entropy = 1.0 if len(ids) < 2 else -sum(c / len(ids) * math.log(c / len(ids)) for c in n.values()) / math.log(len(ids))
        want[i, len(ids), round(letters / cut, 9) if cut else None, round(sum(model.is_byte(x) for x in ids) / len(ids), 9) if ids else None, round(entropy, 9) if ids else None] += 1
    assert got == want
    bands = {r.band: r for r in quality.bands(measured).collect()}
    for r in quality.judged(docs.withColumn("doc_id", F.monotonically_increasing_id())).join(docs.withColumn("doc_id", F.monotonically_increasing_id()).select("doc_id", "lang"), "doc_id").collect():
        band = bands.get(f"lang:{r.lang}" if r.lang else f"script:{r.script}")
        off = {m: (r[m] - band[f"{m}_mid"]) * (1 if m in quality.HIGH else math.copysign(1, r[m] - band[f"{m}_mid"])) for m in quality.LEAST} if band and r.n_tokens else {}
        outside = [m for m, x in off.items() if x > band[f"{m}_wide"] * math.sqrt(1 + quality.SHORT / r.n_tokens)]
        reason = "base" if r.base_failed else outside[0] if outside else None
        assert (r.reason, r.kept) == (reason, reason is None)


def test_each_measure_rejects(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'en'").select("doc_id", "lang", "text")
    rng = np.random.default_rng(6)
    odd = {
        9001: " ".join("".join(chr(0x10900 + int(x)) for x in rng.integers(0, 20, 6)) for _ in range(60)),  # letters that the vocabulary spells in bytes
        9002: " ".join("".join(rng.choice([*"bcdfghjklmnpqrstvwxz"], 12)) for _ in range(120)),
    }
    got = {r.doc_id: r.reason for r in quality.judged(table.union(spark.createDataFrame([(i, "en", t) for i, t in odd.items()], table.schema))).where("doc_id > 9000").collect()}
    assert got[9001] == "fallback_share" and got[9002] == "chars_per_token"


def test_nearest_centroid_against_a_plain_search(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = languages.fit(table)
    assert len(model["centroids"]) > len(model["languages"])  # several a language
    pair, mix = languages._fold(), textblock.mixed
    third = (mix(np.arange(256, dtype=np.uint64) + np.uint64(1 << 20)) % np.uint64(languages.DIMENSIONS)).astype(int)

    def plain(text):
        x, count = text.lower().encode(), Counter()
        for k in range(len(x)):
            count[int(pair[x[k]])] += 1
            if k + 1 < len(x):
                count[int(pair[x[k] << 8 | x[k + 1]])] += 1
            if k + 2 < len(x):
                count[int(pair[x[k] << 8 | x[k + 1]]) ^ int(third[x[k + 2]])] += 1
        v = np.zeros(languages.DIMENSIONS)
        for d, n in count.items():
            v[d] = math.log1p(n) * model["idf"][d]
        cosine = model["centroids"] @ (v / np.linalg.norm(v))
        best = int(cosine.argmax())
        return model["languages"][model["owner"][best]], float(cosine[best]), bool(cosine[best] < model["least"][best])

    odd = spark.createDataFrame([(9001, "#### 1234 x ????"), (9002, "zzzz qqqq xxxx")], "doc_id long, text string")
    some = table.select("doc_id", "text").limit(60).union(odd)
    texts = {r.doc_id: r.text for r in some.collect()}
    for r in languages.predict(some, model).collect():
        lang, score, rejected = plain(texts[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - min(1, score)) < 1e-5 and (r.rejected == rejected or abs(score - min(model["least"])) < 1e-4)
    assert any(r.rejected for r in languages.predict(odd, model).collect())


def near(texts):
    """By index, the first index of its component of similar texts."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return [top(k) for k in range(len(texts))]


def stages(spark, docs, items):  # noqa: F811
    """Rows (doc_id, text) after each stage but the last, plainly but for the verdicts of the quality rules."""
    keyed = docs.withColumn("k", F.monotonically_increasing_id())
    kept = {r.doc_id for r in quality.judged(keyed.withColumn("doc_id", F.col("k"))).where("kept").collect()}
    left = sorted(((r.doc_id, r.text, r.k) for r in keyed.orderBy("k").collect() if r.k in kept), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    left = [r[:2] for r in left]
    yield left
    out = []
    for (i, t), (n, e, s) in zip(left, similar_lines([t for _, t in left]), strict=True):
        gone = {*e, *s}
        if not n or n > len(gone):
            out.append((i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone) if gone else t))
    yield out
    roots = near([t for _, t in out])
    out = [r for k, r in enumerate(out) if roots[k] == k]
    yield out
    five = lambda t: {s for s in shingles(t) if len(s) == 5}
    sets = [s for x in items if (s := five(x))]
    yield [(i, t) for i, t in out if not any(len(five(t) & s) >= 0.8 * len(s) for s in sets)]


def test_pipeline_stage_by_stage(spark, docs, rows, empty, tmp_path):  # noqa: F811
    long = [t for _, t, *_ in rows if t and len(t.split()) > 80]
    items = [" ".join(long[3].split()[10:50]), " ".join(long[-1].split()[:60]), "too short", None]
    spark.createDataFrame([(k, x) for k, x in enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table = docs.select(*corpus_pipeline.COLUMNS)
    words = max(long[8:40], key=lambda t: len(set(t.split()))).split()[:160]
    wrap = lambda first: "\n".join([" ".join(words[:first]), *(" ".join(words[k : k + 20]) for k in range(first, len(words), 20))])  # noqa: E731  no line is like another's, the documents are
    extra = spark.createDataFrame([(7001, wrap(20), "en", "s", 0), (7002, wrap(10), "en", "s", 0), (None, long[5], "en", "s", 0), (None, long[6], "en", "s", 0), (3, long[7] + " and more words here", "en", "s", 0)], table.schema)
    table.union(extra).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    current = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes = [current.count()]
    for n, ((_, stage), want) in enumerate(zip(corpus_pipeline.STAGES[:-1], stages(spark, current, items), strict=True)):
        stage(spark, current.withColumn("_removed", F.lit(1)).withColumn("row", F.lit(1)).withColumn("_row_key", F.lit(1)), str(tmp_path)).write.parquet(str(tmp_path / f"stage-{n}"))
        current = spark.read.parquet(str(tmp_path / f"stage-{n}"))
        assert current.columns == corpus_pipeline.COLUMNS
        assert Counter((r.doc_id, r.text) for r in current.collect()) == Counter(want)
        sizes.append(current.count())
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == len(sizes)  # every stage decides something here
    want = Counter((i, len(plain_ids(t))) for i, t in want)
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    tokens = got.groupby("doc_id", dropna=False)["length"].sum()
    assert tokens.sum() == sum(n * times for (_, n), times in want.items())
    own = defaultdict(int)
    for (i, n), times in want.items():
        own[-1 if i is None else i] += n * times
    assert {-1 if math.isnan(k) else int(k): int(v) for k, v in tokens.items()} == dict(own)


def test_pipeline_of_nothing(spark, empty, tmp_path):  # noqa: F811
    empty.select(*corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert not corpus_pipeline.run(spark, str(tmp_path)).count()
