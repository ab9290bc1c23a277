"""Cases that once went wrong: large ids beside nulls, clashing columns, many equal rows, crowded bands, damaged stores."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trolley.llm import idstore, jaccard, lines, packing, suffixes, vocab

BIG = 2**53


def test_packing_keeps_large_ids_beside_nulls(spark):
    texts = ["some words", "more words here", "a"] * 3
    ids = [BIG + 1, None, BIG + 3, BIG + 5, None, -BIG - 1, 7, BIG + 7, BIG + 9]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").coalesce(1)
    got = packing.packed(df)
    assert Counter(r.doc_id for r in got.collect()) == Counter(ids)
    assert dict(got.dtypes)["doc_id"] == "bigint"


def test_packing_of_a_whole_table_is_near_the_least(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.packed(docs).select("length", "sequence_id").toPandas()
    least = max(-(-got["length"].sum() // packing.WINDOW), (got["length"] > packing.WINDOW // 2).sum())
    assert got["sequence_id"].nunique() <= least + 1


@pytest.mark.parametrize("name", ["_text", "_doc", "_removed", "_emptied", "row", "key", "_row_key", "_row_key_of_docs", "line", "near", "exact", "words", "place", "group"])
def test_line_dedup_with_clashing_columns(spark, name):
    rows = [(1, "a line of five words\nother words stand here too", "x"), (2, "a line of five words\nand this is new text", "y"), (3, None, "z")]
    df = spark.createDataFrame(rows, f"doc_id long, text string, `{name}` string")
    got = lines.deduplicated(df)
    assert got.columns == df.columns
    assert sorted((r[0], r[1] or "", r[2]) for r in got.collect()) == [(1, rows[0][1], "x"), (2, "and this is new text", "y"), (3, "", "z")]


def test_removals_by_document_behind_a_shuffle(spark):
    rows = [(k % 7, f"line {k % 5} of words here and there\nown words of row {k} are these") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).groupBy("doc_id", "text").agg(F.count("*").alias("n"))
    got = lines.by_document(df)
    assert got.agg(F.sum("n_exact")).first()[0] == 60 - 5 and got.count() == 60


def test_equal_rows_have_spans_of_their_own(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(600))
    once = "".join(rng.choice("abcdefgh ") for _ in range(600))
    df = spark.createDataFrame([(None, text)] * 5000 + [(1, once)], "doc_id long, text string").repartition(6)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.cleaned(df).collect())
    assert got == {(None, 600, 600, 1, hashlib.sha256(b"").hexdigest()): 5000, (1, 600, 0, 0, hashlib.sha256(once.encode()).hexdigest()): 1}


def test_suffixes_with_many_open_segments(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = Counter(tuple(r) for r in suffixes.cleaned(docs).drop("kept").collect())
    monkeypatch.setattr(suffixes, "MARKS", 0)
    assert Counter(tuple(r) for r in suffixes.cleaned(docs).drop("kept").collect()) == want
    assert any(r[2] for r in want)


@pytest.mark.parametrize("block", [4, 10_000])
def test_crowded_bands_give_the_pairs_that_all_pairs_give(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SKETCHES", 8)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**32, (12, jaccard.KEPT), dtype=np.uint32)
    signature = base[rng.integers(0, 12, 60)]
    signature[rng.random(signature.shape) < 0.1] = 5
    band = [(b, k) for k in range(60) for b in {0, 1 + k % 3}]
    home = (np.arange(60) % 9).tolist()
    n = Counter(b for b, _ in band)
    apart = spark.createDataFrame([(b, k, home[k], n[b]) for b, k in band], "band long, rep long, home long, n long")
    sketches = spark.createDataFrame([(k, bytearray(signature[k].tobytes())) for k in range(60)], "rep long, signature binary")
    got = {(r.a, r.b) for r in jaccard.crossing(apart, sketches).collect()}
    every = [(a, b) for a in range(60) for b in range(60) if home[a] < home[b]]
    alive = {every[i] for i in jaccard.prune(signature, signature, *np.array(every).T)}
    assert got == (alive if block == 4 else set(every))
    assert 0 < len(alive) < len(every)


def test_a_band_of_many_homes_gives_no_pairs_of_unlike_classes(spark):
    n = 6000
    rng = np.random.default_rng(9)
    sketches = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(rng.integers(0, 2**32, (n, jaccard.KEPT), dtype=np.uint32))], "rep long, signature binary")
    apart = spark.range(n).select(F.lit(1).cast("long").alias("band"), F.col("id").alias("rep"), F.col("id").alias("home"), F.lit(n).cast("long").alias("n"))
    assert not jaccard.crossing(apart, sketches).count()


@pytest.mark.parametrize("n", range(20))
def test_tree_of_leaves_one_by_one(n):
    leaves, tree = [bytes([k]) * 16 for k in range(n)], idstore.Tree()
    for x in leaves:
        tree.add(x)
    assert tree.root() == idstore.merkle(leaves) and len(tree.full) <= max(1, n.bit_length())


def test_store_of_one_part_with_many_documents_and_its_damage(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        docs = spark.range(400).select("id", F.concat(F.lit("text of document "), "id").alias("text")).withColumnRenamed("id", "doc_id").coalesce(1)
        store = idstore.write(docs)
        assert store.manifest.agg(F.sum("n_docs")).first()[0] == 400
        for m in store.manifest.collect():
            roots = [bytes(r.root) for r in store.recipes.where(F.col("part") == m.part).orderBy("local").collect()]
            assert idstore.merkle(roots) == bytes(m.root) and m.n_docs == len(roots)
        got = store.read().orderBy("start").collect()
        assert [r.doc_id for r in got] == list(range(400)) and got[5].ids == vocab.word_bpe().ids([b"text of document 5"])[0] + (1).to_bytes(4, "little")
        folder = store.work.path("packs").removeprefix("file://")
        one = next(os.path.join(folder, x) for x in os.listdir(folder) if x.endswith(".ids"))
        data = bytearray(open(one, "rb").read())
        data[len(data) // 2] ^= 0xFF
        open(one, "wb").write(data)
        with pytest.raises(Exception, match="damaged|zstd|Zstd|decompress"):
            store.read().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
