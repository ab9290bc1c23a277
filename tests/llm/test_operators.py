"""The text operators against plain versions, on a table with copies, near copies, nulls, empty and long texts."""

import functools
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from trolley.llm import decontaminate, idstore, jaccard, languages, lines, packing, ppm, quality, suffixes, vocab, warc

WORDS = re.compile("[0-9a-z\u0080-\U0010ffff]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, starts int, place int, key long, root string"


@pytest.fixture(scope="module")
def rows():
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:70]
    base = max(texts, key=len)[:6000]
    for i in range(12):  # near copies of one text
        words = base.split(" ")
        words[7 * i] = f"odd{i}"
        texts.append(" ".join(words))
    texts += [base] * 3 + [None, "", " \n\t", "one", "one", "a b c", "x" * 30_000, "ab" * 400, base + base, "\n".join(["same line of five words"] * 4), "the cat sat on\nthe cat sat on mat", "ß ÉTÉ あ z", "w " * 3000]
    ids = [*range(len(texts) - 2), 3, None]  # one id twice, one null
    return [(i, t, ["en", "fr", None][k % 3], "s", 0) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 1, 1, "x") for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df, *columns):
    return sorted(df.select("doc_id", *columns).collect(), key=lambda r: (r[0] is None, r))


def shingles(text):
    words = WORDS.findall((text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_containment(spark, docs, rows, empty):
    items = [(1, " ".join(rows[0][1].split()[3:40])), (1, None), (2, "one two"), (None, rows[5][1]), (9, ""), (4, rows[-1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for i, t, *_ in rows:
        own = {s for s in shingles(t) if len(s) == 5}
        for k, x in items:
            s = {y for y in shingles(x) if len(y) == 5}
            if s and len(own & s) >= 0.8 * len(s):
                want[i, k, len(s), len(own & s)] += 1
    got = decontaminate.contained(docs, bench)
    assert Counter(tuple(r)[:4] for r in got.collect()) == want and want
    assert not decontaminate.contained(empty, bench).count() and not decontaminate.contained(docs, bench.limit(0)).count()
    gone = {w[0] for w in want}
    assert decontaminate.decontaminated(docs, bench).count() == sum(r[0] not in gone for r in rows)


def test_long_item_needs_a_sketch():
    assert [decontaminate.hits_needed(n) for n in (24, 32, 48)] == sorted(decontaminate.hits_needed(n) for n in (24, 32, 48))


def test_warc(spark, empty):
    big = "<p>" + "x" * 1200
    pages = [(1, "http://a/b\r\nc", big), (2, None, big), (5, "u", big), (3, "u", "small"), (4, "u", "small"), (6, "u", None), (None, "u", big), (7, "u", big + "é"), (5, "u", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in warc.archived(df).collect())
    want = Counter()
    for p, _, h in pages:
        data = (h or "").encode()
        revisit = h == big and p != 5
        want[p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None, None if revisit else data] += 1
    assert {(k[0], *k[1:5]): v for k, v in got.items()} == {(k[0], *k[1:5]): v for k, v in want.items()}
    assert {bytes(k[5]) for k in got if k[5] is not None} == {k[5] for k in want if k[5] is not None}
    assert not warc.archived(df.limit(0)).count()


def test_base_score_and_ppm(spark, docs, rows, empty):
    train = [t or "" for i, t, *_ in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    count = Counter(w for t in train for w in [*t.encode().translate(lower).split(), b" end"])
    n, v = sum(count.values()), len(count)
    got = by_row(ppm.scored(docs), "n_tokens", "n_known", "train_tokens", "base_score", "score", "held_out")
    want = []
    for i, t, *_ in rows:
        words = [*(t or "").encode().translate(lower).split(), b" end"]
        want.append((i, len(words), sum(count[w] > 0 for w in words), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)))
    want.sort(key=lambda r: (r[0] is None, r))
    assert [tuple(r)[:4] for r in got] == [w[:4] for w in want]
    assert np.allclose([r.base_score for r in got], [w[4] for w in want])
    assert all(r.score < 0 for r in got) and not ppm.scored(empty).count()


@pytest.mark.parametrize("hot", [1000, 3])
def test_many_repeated_payloads(spark, monkeypatch, hot):
    monkeypatch.setattr(warc, "FEW", 0, raising=False)
    monkeypatch.setattr(warc, "HOT", hot, raising=False)
    a, b, c = ("<p>" + x * 1200 for x in "abc")
    pages = [(1, a), (5, a), (5, a), (5, "alone" + b), (1, b), (5, b), (None, a), (None, a), (None, b), (None, c), (None, c), (5, "small"), (None, None), (7, None)]
    df = spark.createDataFrame([(p, "u", h) for p, h in pages], "page_id long, url string, html string")
    last = {a: 5, b: 5}
    want = Counter((p, hashlib.sha1((h or "").encode()).hexdigest(), last[h] if h in last and p != last[h] else None) for p, h in pages)
    assert Counter((r.page_id, r.payload_digest, r.refers_to) for r in warc.archived(df).collect()) == want
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    joined = warc._joined(df, warc._revisits(df), payload).collect()
    assert Counter((r.page_id, hashlib.sha1(r.payload).hexdigest(), None if r.page_id == r.first else r.first) for r in joined) == want


@pytest.mark.parametrize(("chunk", "part"), [(32 << 20, 1 << 23), (20_000, 900)])
def test_ppm_scores_by_every_context(docs, rows, monkeypatch, chunk, part):
    monkeypatch.setattr(ppm, "CHUNK", chunk)
    monkeypatch.setattr(ppm, "PART", part)
    monkeypatch.setattr(ppm, "SORTED", 5000)
    order = ppm.ORDER
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    padded = lambda t: b"\xff" * order + (t or "").encode().translate(lower) + b"\xff"
    seen = defaultdict(Counter)
    for i, t, *_ in rows:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            x = padded(t)
            for at in range(order, len(x)):
                for k in range(order + 1):
                    seen[x[at - k : at]][x[at]] += 1

    @functools.cache
    def log10(context, symbol):
        excluded, out = set(), 0.0
        for k in range(order, -1, -1):
            live = {s: n for s, n in seen.get(context[order - k :], {}).items() if s not in excluded}
            if live:
                mass = sum(live.values()) + len(live)
                if symbol in live:
                    return out + math.log10(live[symbol] / mass)
                out += math.log10(len(live) / mass)
                excluded |= live.keys()
        return out - math.log10(256 - len(excluded))

    want = []
    for i, t, *_ in rows:
        x = padded(t)
        want.append((i, sum(log10(x[at - order : at], x[at]) for at in range(order, len(x)))))
    got = [tuple(r) for r in by_row(ppm.scored(docs), "score")]
    want.sort(key=lambda r: (r[0] is None, r))
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-9)


def test_trie_is_a_distribution():
    data = np.frombuffer(b"abracadabra abracadabra", np.uint8)
    codes, counts = [], []
    gram, _ = ppm.grams(np.array([0, len(data)]), data, 3)
    for k in range(4):
        c, n = np.unique(gram & ppm._low(k), return_counts=True)
        codes.append(c)
        counts.append(n)
    trie = ppm.Trie(codes, counts).searchable()
    for context in (0x616272, 0x7A7A7A, 0xFFFFFF, 0x616161):
        every = np.uint64(context) << np.uint64(8) | np.arange(256, dtype=np.uint64)
        assert abs((10 ** trie.log10(every)).sum() - 1) < 1e-9
    assert ppm.adaptive_log10(b"ab" * 50) > ppm.adaptive_log10(bytes(range(100)))


def test_adaptive_scores(spark, empty):
    texts = [(1, "Abracadabra abracadabra"), (2, None), (None, ""), (2, "é")]
    got = Counter((r.doc_id, r.n_bytes, r.score) for r in ppm.adaptive(spark.createDataFrame(texts, "doc_id long, text string"), 2).collect())

    def plain(text, order=2):
        x, total, seen = b"\xff" * order + text + b"\xff", 0.0, []
        for i in range(order, len(x)):
            excluded = set()
            for k in range(order, -1, -1):
                followers = [x[j] for j in range(order, i) if x[j - k : j] == x[i - k : i]]
                live = [b for b in followers if b not in excluded]
                if live:
                    mass = len(live) + len(set(live))
                    if x[i] in live:
                        total += math.log10(live.count(x[i]) / mass)
                        break
                    total += math.log10(len(set(live)) / mass)
                excluded |= set(followers)
            else:
                total -= math.log10(256 - len(excluded))
        return total

    want = [(i, len((t or "").encode()), plain((t or "").lower().encode())) for i, t in texts]
    assert [k[:2] for k in sorted(got, key=str)] == [w[:2] for w in sorted(want, key=str)]
    assert np.allclose(sorted(k[2] for k in got.elements()), sorted(w[2] for w in want))
    assert not ppm.adaptive(empty).count()

def test_quality_counts(docs, rows, empty):
    got = by_row(quality.judged(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    want = sorted(((i, *quality.base_of(t)) for i, t, *_ in rows), key=lambda r: (r[0] is None, r))
    assert [tuple(r)[:6] for r in got] == want
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality.kept(docs).columns == docs.columns and not quality.judged(empty).count()


def lines_of(t):
    return [(k, w) for k, x in enumerate((t or "").lower().split("\n")) if (w := tuple(sorted(set(WORDS.findall(x)))))]


def similar_lines(texts):
    """By text, in order: lines with a word, and numbers of those that an equal or else a similar line precedes, in this or an earlier text."""
    first, out = {}, []
    for n, t in enumerate(texts):
        for k, w in lines_of(t):
            first.setdefault(w, (n, k))
    sets = {w: set(w) for w in first}
    gone = {w for w in first for x in first if first[x] < first[w] and 5 * len(sets[w] & sets[x]) >= 4 * len(sets[w] | sets[x])}
    for n, t in enumerate(texts):
        own = lines_of(t)
        exact = [k for k, w in own if first[w] < (n, k)]
        out.append((len(own), exact, [k for k, w in own if w in gone and k not in exact]))
    return out


def in_order(docs):
    """Rows (doc_id, text) by doc_id, null last, and as they come."""
    found = [(r.doc_id, r.text) for r in docs.withColumn("m", F.monotonically_increasing_id()).orderBy("m").collect()]
    return sorted(found, key=lambda r: (r[0] is None, r[0] or 0))


@pytest.mark.parametrize(("likeliest", "crowd"), [(1, 3), (1, 40)])
def test_lines(spark, docs, empty, monkeypatch, likeliest, crowd):
    monkeypatch.setattr(lines, "LIKELIEST", likeliest)
    monkeypatch.setattr(lines, "CROWD", crowd)
    monkeypatch.setattr(lines, "SEEN", 5)
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(60)]
    crowded = [" ".join(rng.choice(vocabulary, 12, False)) for _ in range(30)]
    base = vocabulary[:20]
    crowded += [" ".join([*base[:k], f"odd{k}", *base[k + 1 :]]) for k in range(20)]
    extra = spark.createDataFrame([(int(rng.integers(50, 900)), "\n".join(crowded[a : a + 4]), "en", "s", 0, "x", 1, 1, 1, "x") for a in range(0, 50, 2)], docs.schema)
    both = docs.union(extra).repartition(4).cache()
    order = in_order(both)
    want = similar_lines([t for _, t in order])
    got = Counter((r.doc_id, r.n_lines, r.n_exact, r.n_near, tuple(r.removed)) for r in lines.by_document(both).collect())
    assert got == Counter((i, n, len(e), len(s), tuple(sorted(e + s))) for (i, _), (n, e, s) in zip(order, want, strict=True))
    clash = both.withColumn("removed", F.lit(1)).withColumn("row", F.lit(2)).withColumn("emptied", F.lit(3))
    kept = lines.deduplicated(clash)
    left = Counter()
    for (i, t), (n, e, s) in zip(order, want, strict=True):
        if not n or n > len(e) + len(s):
            left[i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in {*e, *s}) if e or s else t] += 1
    assert kept.columns == clash.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == left
    assert not lines.by_document(empty).count() and not lines.deduplicated(empty).count()


def test_id_store(docs, rows, empty):
    store = idstore.write(docs)
    got = sorted(store.read().collect(), key=lambda r: r.start)
    ids = vocab.word_bpe().ids([(t or "").encode() for _, t, *_ in rows])
    want = Counter((i, len(x) // 4 + 1, zlib.crc32(x + b"\1\0\0\0")) for (i, *_), x in zip(rows, ids, strict=True))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert [r.doc_id is not None and r.doc_id for r in got][1:] == sorted(r.doc_id for r in got[1:])
    assert store.index.count() == store.index.select("digest").distinct().count() and len(store.root()) == 32
    assert not idstore.write(empty).read().count()


def test_suffix_order():
    rng = np.random.default_rng(1)
    for alphabet in (1, 2, 5):
        text = np.append(rng.integers(97, 97 + alphabet, 300), 255).astype(np.uint8)
        assert suffixes.suffix_order(text, 400).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tobytes())


@pytest.mark.parametrize("crowd", [400, 1])
def test_suffixes(docs, rows, empty, monkeypatch, crowd):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(x[k : k + 200] for _, x in data for k in range(len(x) - 199))
    want = []
    for i, x in data:
        stay = np.ones(len(x), bool)
        for k in range(len(x) - 199):
            if seen[x[k : k + 200]] > 1:
                stay[k : k + 200] = False
        kept = bytes(np.frombuffer(x, np.uint8)[stay])
        want.append((i, len(x), len(x) - len(kept), int((np.diff(np.concatenate([[1], stay.astype(int)])) == -1).sum()), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in by_row(suffixes.cleaned(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256")]
    assert got == sorted(want, key=lambda r: (r[0] is None, r))
    assert not suffixes.cleaned(empty).count()


def test_packing(docs, rows, empty):
    got = packing.packed(docs).toPandas()
    assert got["length"].sum() == sum(len(x) // 4 + 1 for x in vocab.word_bpe().ids([(t or "").encode() for _, t, *_ in rows]))
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["length"].sum() <= packing.WINDOW and own["offset"].tolist() == (own["length"].cumsum() - own["length"]).tolist()
    assert not packing.packed(empty).count()
    sequence, offset = packing.best_fit([9, 7, 5, 3, 1], 10)
    assert sequence == [0, 1, 2, 1, 0] and offset == [0, 0, 0, 7, 9]


def test_languages(spark, empty):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = languages.identified(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.9
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 34", "fr"), (4, "word", None)], "doc_id long, text string, lang string")
    assert {r.doc_id: (r.lang_pred, r.score) for r in languages.identified(odd).collect()} == {k: ("und", 0.0) for k in (1, 2, 3, 4)}
    assert not languages.identified(empty).count()


@pytest.mark.parametrize("block", [128, 3])
def test_jaccard(docs, rows, empty, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)  # groups of more are compared in pairs of blocks
    rows = [r for r in rows if r[0] is not None]
    sets = [shingles(t) for _, t, *_ in rows]
    links, root = Counter(), list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = top(a), top(b)
                if rows[x][0] > rows[y][0]:
                    x, y = y, x
                root[y] = x
    want = sorted((r[0], rows[top(k)][0], links[k]) for k, r in enumerate(rows))
    got = [tuple(r) for r in by_row(jaccard.joined(docs.where("doc_id is not null")), "class_id", "n_links")]
    assert [g for g in got if g[0] != 3] == [w for w in want if w[0] != 3]
    assert jaccard.joined(docs).where("doc_id is null").first()["n_links"] == 0
    assert jaccard.deduplicated(docs).columns == docs.columns and not jaccard.joined(empty).count()


def test_rows_of_one_id_are_told_apart(spark, rows):
    texts = [t for _, t, *_ in rows[:8]]
    bench = spark.createDataFrame([(1, " ".join(texts[4].split()[:40]))], "item_id long, text string")
    held = [(3, texts[0]), (3, "one"), (3, texts[1]), (None, texts[2]), (None, "bad"), (None, texts[2]), (7, texts[0]), (None, texts[4]), (3, texts[4]), (3, texts[5]), (None, texts[6]), (3, texts[0])]
    order = sorted(range(len(held)), key=lambda k: (held[k][0] is None, held[k][0] or 0, k))
    place = {k: n for n, k in enumerate(order)}
    table = lambda ids: spark.createDataFrame([(i, t, "en", "s", len(t), k) for k, (i, (_, t)) in enumerate(zip(ids, held, strict=True))], "doc_id long, text string, lang string, source string, n_chars long, k int")
    ours, unique = table([i for i, _ in held]), table([place[k] for k in range(len(held))])
    for f in (quality.kept, lines.deduplicated, jaccard.deduplicated, lambda d: decontaminate.decontaminated(d, bench)):
        got, want = (sorted((r.k, r.text) for r in f(d).collect()) for d in (ours, unique))
        assert got == want and 0 < len(got) < len(held)
    ids = {place[k]: i for k, (i, _) in enumerate(held)}
    want = Counter((ids[r.doc_id], ids[r.class_id], r.n_links) for r in jaccard.joined(unique).collect())
    assert Counter(map(tuple, jaccard.joined(ours).collect())) == want
