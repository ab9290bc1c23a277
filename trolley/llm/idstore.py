"""A content-addressed store of token ids.

A document's id stream is cut where a rolling hash over 16 ids says so, so equal passages are cut alike
wherever they stand. Every distinct chunk is stored once, in pack files, under the digest of its ids. A
document is a recipe: its chunks' digests in order and their Merkle root. Recipes lie in ascending doc_id
order in part files; the manifest has each part's documents, ids and Merkle root over its documents' roots.

Packs are written twice: first by the tasks that encode (each chunk once a task), then only the one copy of
each digest that the index points to. A task that is run again writes files of other names, and only names
that reach the written tables are ever read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trolley.llm.files import Readers, create
from trolley.llm.textblock import as_batch, blocks, mixed, raw
from trolley.llm.vocab import word_bpe
from trolley.llm.workspace import Workspace, partitions

END = 1
SPAN, LEAST, MEAN, MOST = 16, 64, 512, 4096
DIGEST = 16


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over the leaves; an odd one out moves up as it is. Without leaves, the digest of nothing."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\x01" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class Tree:
    """`merkle` of leaves that come one by one: a root of each full subtree is held, so as many as the number of leaves has bits."""

    def __init__(self):
        self.n, self.full = 0, []

    def add(self, leaf: bytes) -> None:
        self.n += 1
        n = self.n
        while n % 2 == 0:
            leaf = digest(b"\x01" + self.full.pop() + leaf)
            n //= 2
        self.full.append(leaf)

    def root(self) -> bytes:
        if not self.full:
            return merkle([])
        out = self.full[-1]
        for x in self.full[-2::-1]:
            out = digest(b"\x01" + x + out)
        return out


def cuts(ids: np.ndarray, first: np.ndarray) -> list[list[int]]:
    """For streams ids[first[d]:first[d + 1]]: where each chunk ends, counted from the stream's start.

    The rolling hash at an id depends on it and the 15 before it; a chunk has LEAST to MOST ids but the last.
    """
    gear = mixed(ids.astype(np.uint64) + np.uint64(1))
    rolled = gear.copy()
    for k in range(1, SPAN):
        rolled[k:] += gear[:-k] << np.uint64(k)
    at = np.flatnonzero(rolled >> np.uint64(3) & np.uint64(MEAN - 1) == 0) + 1
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        own, last = [], 0
        for x in at[np.searchsorted(at, a + LEAST) : np.searchsorted(at, b)] - a:
            while x - last > MOST:
                last += MOST
                own.append(last)
            if x - last >= LEAST:
                last = int(x)
                own.append(last)
        n = int(b - a)
        while n - last > MOST:
            last += MOST
            own.append(last)
        out.append([*own, n])
    return out


def _squeeze(chunk: bytes, press: zstandard.ZstdCompressor) -> bytes:
    wide = np.frombuffer(chunk, "<u4")
    return press.compress(b"\x02" + wide.astype("<u2").tobytes() if wide.max() < 1 << 16 else b"\x04" + chunk)


def _unsqueeze(data: bytes, press: zstandard.ZstdDecompressor) -> bytes:
    x = press.decompress(data)
    return np.frombuffer(x, "<u2", offset=1).astype("<u4").tobytes() if x[0] == 2 else x[1:]


class IdStore:
    """The store's tables (recipes, index, manifest) and its pack files; see `write`."""

    def __init__(self, work: Workspace, recipes: DataFrame, index: DataFrame, manifest: DataFrame):
        self.work, self.recipes, self.index, self.manifest = work, recipes, index, manifest

    def root(self) -> str:
        """Merkle root over the manifest's parts, in order: one row a part, so few."""
        return merkle([bytes(r["root"]) for r in self.manifest.orderBy("part").select("root").collect()]).hex()

    def read(self) -> DataFrame:
        """Every document rebuilt from its chunks: doc_id, start, n_tokens, ids_crc32, n_chunks, root, ids.

        A chunk that does not have its digest, or a document that does not have its root, fails the job.
        """
        packs = self.work.path("packs")
        parts = self.recipes.select("part", "doc_id", "local", "n_tokens", "root", F.posexplode(_slices("chunks")).alias("i", "digest"))
        found = parts.join(self.index, "digest").groupBy("part", "local", "doc_id", "n_tokens", "root").agg(F.sort_array(F.collect_list(F.struct("i", "digest", "pack", "at", "size"))).alias("chunks"))
        offset = self.manifest.select("part", F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        placed = found.join(offset, "part").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "root", "chunks", F.col("chunks")[0]["pack"].alias("home"), F.floor(F.col("chunks")[0]["at"] / (4 << 20)).alias("near"), F.col("chunks")[0]["at"].alias("at"))
        placed = placed.repartition(partitions(self.work.spark), "home", "near").sortWithinPartitions("home", "at")
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("n_chunks", pa.int64()), ("root", pa.string()), ("ids", pa.binary())])

        def run(batches):
            files, press = Readers(packs), zstandard.ZstdDecompressor()
            for batch in batches:
                for part in (batch.slice(a, 256) for a in range(0, batch.num_rows, 256)):
                    whole = []
                    for root, chunks in zip(part.column("root").to_pylist(), part.column("chunks").to_pylist(), strict=True):
                        data = [_unsqueeze(files.read(c["pack"], c["at"], c["size"]), press) for c in chunks]
                        if any(digest(x) != c["digest"] for x, c in zip(data, chunks, strict=True)) or merkle([c["digest"] for c in chunks]) != root:
                            raise ValueError("a chunk or a recipe is damaged")
                        whole.append(b"".join(data))
                    n = np.array([len(x) // 4 for x in whole], np.int64)
                    if (n != part.column("n_tokens").to_numpy()).any():
                        raise ValueError("a document's length differs from its recipe")
                    yield as_batch(schema, doc_id=part.column("doc_id"), start=part.column("start"), n_tokens=n, ids_crc32=[zlib.crc32(x) for x in whole], n_chunks=[len(c) for c in part.column("chunks")], root=[r.hex() for r in part.column("root").to_pylist()], ids=whole)

        return placed.select("doc_id", "start", "n_tokens", "root", "chunks").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, n_chunks long, root string, ids binary")


def _slices(column: str):
    """A binary column's consecutive values of DIGEST bytes, as an array."""
    return F.transform(F.sequence(F.lit(0), (F.length(column) / DIGEST).cast("int") - 1), lambda i: F.substring(F.col(column), (i * DIGEST + 1).cast("int"), F.lit(DIGEST)))


def write(docs: DataFrame, vocabulary: str = "word_bpe_49k.json") -> IdStore:
    """Encode every row (doc_id, text), each with the end id 1, and store the ids.

    A null text has the end id alone. Rows of the same doc_id are kept apart, in the order of their roots;
    a null doc_id comes first. An empty table gives an empty store.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "idstore")
    staging, packs = work.path("staging"), work.path("packs")
    rows = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary()), ("chunks", pa.binary()), ("digest", pa.binary()), ("pack", pa.string()), ("at", pa.int64()), ("size", pa.int32())])

    def encode(batches):
        memo, press, have, at, pack, out = word_bpe(vocabulary), zstandard.ZstdCompressor(level=1), set(), 0, None, None
        for batch, text in blocks(batches):
            ids, first = memo.stream(*reversed(raw(text)), END)
            whole, begins = ids.astype("<u4", copy=False).tobytes(), (4 * first).tolist()
            recipes, new = [], []
            for doc, begin, stop, ends in zip(batch.column("doc_id").to_pylist(), begins[:-1], begins[1:], cuts(ids, first), strict=True):
                names = []
                for a, b in zip([0, *ends], ends, strict=False):
                    chunk = whole[begin + 4 * a : begin + 4 * b]
                    names.append(name := digest(chunk))
                    if name not in have:
                        have.add(name)
                        if out is None:
                            pack, out = create(staging, ".ids")
                        packed = _squeeze(chunk, press)
                        out.write(packed)
                        new.append((name, pack, at, len(packed)))
                        at += len(packed)
                recipes.append((doc, (stop - begin) // 4, merkle(names), b"".join(names)))
            r, c = list(zip(*recipes, strict=True)), list(zip(*new, strict=True)) or [[]] * 4
            n, m = len(recipes), len(new)
            yield as_batch(rows, doc_id=[*r[0], *[None] * m], n_tokens=[*r[1], *[None] * m], root=[*r[2], *[None] * m], chunks=[*r[3], *[None] * m], digest=[*[None] * n, *c[0]], pack=[*[None] * n, *c[1]], at=[*[None] * n, *c[2]], size=[*[None] * n, *c[3]])
        if out is not None:
            out.close()

    encoded = work.table(docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, n_tokens long, root binary, chunks binary, digest binary, pack string, at long, size int"), "encoded")

    one = encoded.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min(F.struct("pack", "at", "size")).alias("place")).select("digest", "place.*")
    found = pa.schema([("digest", pa.binary()), ("pack", pa.string()), ("at", pa.int64()), ("size", pa.int32())])

    def compact(batches):
        files, at, pack, out = Readers(staging), 0, None, None
        for batch in batches:
            to = []
            for name, start, size in zip(*(batch.column(c).to_pylist() for c in ("pack", "at", "size")), strict=True):
                if out is None:
                    pack, out = create(packs, ".ids")
                out.write(files.read(name, start, size))
                to.append(at)
                at += size
            yield as_batch(found, digest=batch.column("digest"), pack=[pack] * len(to), at=to, size=batch.column("size"))
        if out is not None:
            out.close()

    dealt = one.repartition(partitions(spark), "pack", F.floor(F.col("at") / (4 << 20))).sortWithinPartitions("pack", "at")
    index = work.table(dealt.mapInArrow(compact, "digest binary, pack string, at long, size int"), "index")
    work.drop("staging")

    whole = "doc_id long, n_tokens long, root binary, chunks binary, part long, local long, n_docs long"
    names = [x.split()[0] for x in whole.split(", ")]

    def place(batches):
        """The recipes with their part and place there, and behind them one row for the part itself."""
        part, local, tree = TaskContext.get().partitionId(), 0, Tree()
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            start = local + np.cumsum(n) - n
            local += int(n.sum())
            for root in batch.column("root").to_pylist():
                tree.add(root)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, np.int64)), pa.array(start.astype(np.int64)), pa.nulls(len(n), pa.int64())], names=names)
        if tree.n:
            own = dict(doc_id=None, n_tokens=local, root=tree.root(), chunks=None, part=part, local=None, n_docs=tree.n)
            yield pa.RecordBatch.from_arrays([pa.array([own[c]], pa.binary() if c in ("root", "chunks") else pa.int64()) for c in names], names=names)

    recipes = encoded.where(F.col("root").isNotNull()).select("doc_id", "n_tokens", "root", "chunks", F.monotonically_increasing_id().alias("row"))
    order = [F.asc_nulls_first("doc_id"), "root", "row"]  # rows of one id, null too, are spread as well
    recipes = recipes.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).drop("row")
    placed = work.table(recipes.mapInArrow(place, whole), "recipes")
    recipes, manifest = placed.where("n_docs IS NULL").drop("n_docs"), placed.where("n_docs IS NOT NULL").select("part", "n_docs", "n_tokens", "root")
    return IdStore(work, recipes, index, manifest)
