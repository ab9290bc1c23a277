"""Near-duplicate documents: n-gram Jaccard join with Bayesian candidate pruning.

A document is its set of five-word shingles; documents of equal sets are one class, represented by its
smallest doc_id. Classes that agree in a band of MinHash values are candidates. For candidates, MinHash values
are compared a few at a time, and a pair is dropped as soon as the posterior probability that its Jaccard
similarity reaches the threshold (uniform prior) falls below a tolerance. Pairs that survive are verified by
the exact size of their sets' intersection.

Candidates are never written pair by pair. Two rounds of taking the smallest class of one's bands give each
class a home; classes of one home are compared within blocks of a bounded size that carry their sets, so a
group of m near copies costs block pairs, not m^2 rows. Candidates whose homes differ become pairs; where a band
has many classes they become so only behind the comparison of MinHash values, which is done in blocks too.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trolley.llm.textblock import Words, as_batch, blocks, fixed_binary, minhashes, mixed
from trolley.llm.workspace import ROW_KEY, Workspace, by_key, keyed, partitions, restored

THRESHOLD = 0.8
#: Bands of ROWS values each: a pair at 0.8 is missed with probability (1 - 0.8^6)^48 < 10^-6.
BANDS, ROWS = 48, 6
#: MinHash values kept for the comparison, how many are compared at a time, and the tolerance of a drop.
KEPT, STEP, TOLERANCE = 96, 16, 1e-7
BLOCK = 128
#: Classes of a block whose MinHash values alone are compared, and pairs compared at a time.
SKETCHES, PAIRS = 1024, 1 << 16
#: Ids that may be broadcast (8 bytes each); more are joined by a shuffle.
FEW = 2_000_000


@cache
def least_matches(threshold: float = THRESHOLD) -> tuple[int, ...]:
    """By number of values compared: fewer matches make similarity of `threshold` less likely than TOLERANCE.

    With m matches of n and a uniform prior the similarity is Beta(m + 1, n - m + 1); the mass above the
    threshold is a binomial sum.
    """
    from math import comb

    out = []
    for n in range(STEP, KEPT + 1, STEP):
        tail, m = 0.0, 0
        # P(similarity > t | m of n) = P(Binomial(n + 1, t) <= m)
        while m <= n:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= TOLERANCE:
                break
            m += 1
        out.append(m)
    return tuple(out)


def prune(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs (left[a], right[b]) of signatures survive every step."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(least_matches(threshold)):
        part = slice(k * STEP, (k + 1) * STEP)
        matches = matches + (left[a[alive], part] == right[b[alive], part]).sum(1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
    return alive


def _shared(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[a] and sets[b]. Shingles that only one set has are left out first."""
    used = np.unique(np.concatenate([a, b]))
    every = np.concatenate([sets[i] for i in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    _, code, count = np.unique(every, return_inverse=True, return_counts=True)
    several = count > 1
    column = np.cumsum(several) - 1
    keep = several[code]
    owner, code, width = owner[keep], column[code[keep]], int(several.sum())
    at = np.searchsorted(used, np.stack([a, b]))
    out = np.zeros(len(a), np.int64)
    for low in range(0, width, 1 << 14):  # the dense part stays within 2 * BLOCK x 2^14 cells
        inside = (code >= low) & (code < low + (1 << 14))
        dense = np.zeros((len(used), min(width - low, 1 << 14)), np.float32)
        dense[owner[inside], code[inside] - low] = 1
        out += np.rint((dense @ dense.T)[at[0], at[1]]).astype(np.int64)
    return out


def similar(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs have a Jaccard similarity of `threshold` or more, exactly."""
    if not len(a):
        return np.zeros(0, bool)
    size = np.array([len(s) for s in sets])
    shared = _shared(sets, a, b)
    return 1000 * shared >= round(1000 * threshold) * (size[a] + size[b] - shared)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key_a and key_b (digest of the shingle set), n_shingles, bands, signature of each row with a word."""
    schema = pa.schema([("doc_id", pa.int64()), ("key_a", pa.int64()), ("key_b", pa.int64()), ("n_shingles", pa.int64()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary())])

    def run(batches):
        for batch, text in blocks(batches):
            where, sets = _sets(text)
            if not sets:
                continue
            starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
            values = minhashes(np.concatenate(sets), starts, BANDS * ROWS)
            h = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
            for k in range(ROWS):
                h = mixed(h + values[:, k * BANDS : (k + 1) * BANDS])
            digest = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
            yield as_batch(
                schema, doc_id=batch.column("doc_id").take(pa.array(where)), key_a=digest[:, 0], key_b=digest[:, 1], n_shingles=[len(s) for s in sets],
                bands=pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(h.ravel().view(np.int64))), signature=fixed_binary(values[:, :: BANDS * ROWS // KEPT]),
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key_a long, key_b long, n_shingles long, bands array<long>, signature binary")


def _sets(text: pa.Array) -> tuple[list[int], list[np.ndarray]]:
    """Indexes of the texts with a word, and their sorted distinct shingle hashes."""
    words = Words(text)
    hashes, at = words.shingles()
    first = np.searchsorted(words.doc[at], np.arange(len(text) + 1))
    where, sets = [], []
    for d in range(len(text)):
        own = np.sort(hashes[first[d] : first[d + 1]]) if first[d] < first[d + 1] else words.whole(d)
        if len(own):
            new = np.ones(len(own), bool)
            new[1:] = own[1:] != own[:-1]
            where.append(d)
            sets.append(own[new])
    return where, sets


def _shingles(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("rep", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        for batch, text in blocks(batches):
            where, sets = _sets(text)
            if where:
                yield as_batch(schema, rep=batch.column("rep").take(pa.array(where)), shingles=[s.tobytes() for s in sets])

    return docs.mapInArrow(run, "rep long, shingles binary")


def _compare_block(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one block pair: representatives, each one's smallest linked representative here, and documents it links to."""
    rep, size, sub = (rows[c].to_numpy() for c in ("rep", "size", "sub"))
    signature = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint32).reshape(len(rows), KEPT)
    a, b = _pairs_of_block(sub, rows["low"][0].as_py(), rows["high"][0].as_py())
    alive = prune(signature, signature, a, b)
    a, b = a[alive], b[alive]
    sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"].to_pylist()]
    ok = similar(sets, a, b)
    a, b = a[ok], b[ok]
    links = np.bincount(a, size[b], len(rows)) + np.bincount(b, size[a], len(rows))
    root = np.arange(len(rows))
    by = np.argsort(rep, kind="stable")
    rank = np.empty(len(rows), int)
    rank[by] = np.arange(len(rows))
    a, b = rank[a], rank[b]
    while True:  # smallest member of each component of the block
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = least[least]
        if (least == root).all():
            break
        root = least
    return rep, rep[by][root[rank]], links.astype(np.int64)


def _pairs_of_block(sub: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of a block, or those of a row of block low and one of block high."""
    if low == high:
        return np.triu_indices(len(sub), 1)
    left, right = np.flatnonzero(sub == low), np.flatnonzero(sub == high)
    return np.repeat(left, len(right)), np.tile(right, len(left))


def across_block(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of one block pair of a band: pairs of representatives of different homes whose MinHash values stay likely to reach the threshold."""
    rep, home, sub = (rows[c].to_numpy() for c in ("rep", "home", "sub"))
    signature = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint32).reshape(len(rows), KEPT)
    a, b = _pairs_of_block(sub, rows["low"][0].as_py(), rows["high"][0].as_py())
    apart = home[a] != home[b]
    a, b = a[apart], b[apart]
    a, b = np.where(home[a] < home[b], a, b), np.where(home[a] < home[b], b, a)
    alive = [prune(signature, signature, a[i : i + PAIRS], b[i : i + PAIRS]) for i in range(0, len(a), PAIRS)]
    at = np.concatenate([np.zeros(0, np.int64), *[i * PAIRS + x for i, x in enumerate(alive)]])
    return rep[a[at]], rep[b[at]]


def blocked(rows: DataFrame, key: str, size: int) -> DataFrame:
    """rows (key, rep, n: rows of the key) with sub, low and high: each row in every pair of its key's blocks of about `size` rows that holds its own."""
    dealt = rows.withColumn("subs", F.ceil(F.col("n") / size).cast("int")).withColumn("sub", F.pmod(F.xxhash64("rep"), F.col("subs")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).withColumn("low", F.least("sub", "other")).withColumn("high", F.greatest("sub", "other")).drop("subs", "other", "n")
    return dealt.repartition(partitions(rows.sparkSession), key, "low", "high").sortWithinPartitions(key, "low", "high")


def crossing(apart: DataFrame, signatures: DataFrame) -> DataFrame:
    """a, b: representatives of different homes that share a band; those of crowded bands only if their MinHash values agree enough.

    apart: band, rep, home, n (the band's representatives). signatures: rep, signature.
    """
    two = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches):
        for rows in grouped(batches, ["band", "low", "high"]):
            a, b = across_block(rows)
            if len(a):
                yield as_batch(two, a=a, b=b)

    few, crowd = apart.where(F.col("n") <= BLOCK), apart.where(F.col("n") > BLOCK)
    side = lambda rep, home: few.select("band", F.col("rep").alias(rep), F.col("home").alias(home))
    pairs = side("a", "ha").join(side("b", "hb"), "band").where("ha < hb").select("a", "b")
    found = blocked(crowd.join(signatures, "rep").select("band", "rep", "home", "n", "signature"), "band", SKETCHES).mapInArrow(compare, "a long, b long")
    return pairs.union(found).distinct()


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """node, root: the smallest node of each connected component of edges (a, b); nodes without edges are left out.

    Each round a node takes the smallest label among its neighbours and itself, then its label's label;
    the labels are written after each round.
    """
    both = work.table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = work.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels-0")
    for k in range(1, 64):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").select(F.col("a").alias("node"), "root")
        least = near.union(labels).groupBy("node").agg(F.min("root").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        new = work.table(least.join(jump, "root", "left").select("node", F.least("root", "further").alias("root")), f"labels-{k}")
        if not new.join(labels.withColumnRenamed("root", "before"), "node").where("root <> before").limit(1).count():
            return new
        labels = new
    raise RuntimeError("labels did not settle")


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links of every row: the smallest doc_id of its component of similar documents, and how many others are similar to it.

    Links count documents, exact copies included; a component joins documents that links connect, directly or not.
    A text without a word (null, empty) is similar to nothing, and is its own class. A text of one to four
    words has one shingle, all its words. Rows of equal or null doc_id are documents of their own; the class_id is
    null where all ids of the component are.
    """
    work = Workspace(docs.sparkSession, "jaccard")
    found = _classes(keyed(docs, work), work)
    least = found.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return found.join(least, "root").select("doc_id", "class_id", "n_links")


def _classes(rows: DataFrame, work: Workspace) -> DataFrame:
    """ROW_KEY, doc_id, root (the smallest key of its component), n_links of each row of `keyed`."""
    found = work.table(_linked(by_key(rows).select("doc_id", "text"), work), "linked")
    classes = work.table(rows.select(ROW_KEY, "doc_id").join(found.select(F.col("doc_id").alias(ROW_KEY), F.col("class_id").alias("root"), "n_links"), ROW_KEY), "classes")
    work.clear("keyed", "classes")
    return classes


def _linked(docs: DataFrame, work: Workspace) -> DataFrame:
    """`joined` for rows whose doc_ids are unique and not null."""
    spark = docs.sparkSession
    marks = work.table(fingerprints(docs), "marks")
    members = marks.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"))
    members = work.table(members, "members")
    reps = marks.join(members.select("rep", "size", F.col("key_a").alias("ka"), F.col("key_b").alias("kb")), (F.col("doc_id") == F.col("rep")) & (F.col("key_a") == F.col("ka")) & (F.col("key_b") == F.col("kb")))
    reps = work.table(reps.select("rep", "size", "bands", "signature").dropDuplicates(["rep", "bands"]), "reps")

    banded = reps.select("rep", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("least")).where("n > 1").select("band", "least")
    near = work.table(banded.join(shared, "band"), "near")
    home = near.groupBy("rep").agg(F.min("least").alias("home"))
    least = near.join(home, "rep").groupBy("band").agg(F.min("home").alias("home"))
    home = work.table(near.select("band", "rep").join(least, "band").groupBy("rep").agg(F.min("home").alias("home")), "home")

    placed = near.select("band", "rep").join(home, "rep")
    mixed_ = placed.groupBy("band").agg(F.min("home").alias("low"), F.max("home").alias("high"), F.count("*").alias("n")).where("low < high").select("band", "n")
    apart = work.table(placed.join(mixed_, "band"), "apart")
    across = work.table(crossing(apart, reps.select("rep", "signature").dropDuplicates(["rep"])), "across")

    wanted = home.select("rep")
    if few := wanted.count() <= FEW:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(wanted, "rep")
    sets = work.table(_shingles(texts).join(home, "rep").join(reps.select("rep", "size", "signature"), "rep").dropDuplicates(["rep"]), "sets")

    crowd = home.groupBy("home").agg(F.count("*").alias("n")).where("n > 1")
    dealt = blocked(sets.join(crowd, "home").select("home", "n", "rep", "size", "signature", "shingles"), "home", BLOCK)
    schema = pa.schema([("rep", pa.int64()), ("least", pa.int64()), ("links", pa.int64())])

    def compare(batches):
        for rows in grouped(batches, ["home", "low", "high"]):
            rep, least, links = _compare_block(rows)
            keep = (links > 0) | (rep != least)
            if keep.any():
                yield as_batch(schema, rep=rep[keep], least=least[keep], links=links[keep])

    inside = work.table(dealt.mapInArrow(compare, "rep long, least long, links long"), "inside")

    pairs = across.join(sets.select(F.col("rep").alias("a"), F.col("signature").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("signature").alias("sb")), "b")
    two = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def bayes(batches):
        for batch in batches:
            if batch.num_rows:
                sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, KEPT) for c in ("sa", "sb"))
                every = np.arange(batch.num_rows)
                keep = pa.array(prune(sa, sb, every, every))
                yield as_batch(two, a=batch.column("a").take(keep), b=batch.column("b").take(keep))

    def exact(batches):
        for batch in batches:
            for part in (batch.slice(i, BLOCK) for i in range(0, batch.num_rows, BLOCK)):
                n = part.num_rows
                every = [np.frombuffer(s, np.uint64) for c in ("xa", "xb") for s in part.column(c).to_pylist()]
                keep = pa.array(np.flatnonzero(similar(every, np.arange(n), np.arange(n, 2 * n))))
                yield as_batch(two, a=part.column("a").take(keep), b=part.column("b").take(keep))

    alive = pairs.mapInArrow(bayes, "a long, b long")
    verified = alive.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("xa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("xb")), "b")
    crossed = work.table(verified.select("a", "b", "xa", "xb").mapInArrow(exact, "a long, b long"), "crossed")

    sizes = sets.select("rep", "size")
    far = crossed.join(sizes.withColumnRenamed("rep", "b"), "b").select(F.col("a").alias("rep"), F.col("size").alias("links")).union(crossed.join(sizes.withColumnRenamed("rep", "a"), "a").select(F.col("b").alias("rep"), F.col("size").alias("links")))
    links = inside.select("rep", "links").union(far).groupBy("rep").agg(F.sum("links").alias("links"))
    edges = inside.where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")).union(crossed)
    roots = components(edges, work)

    classes = members.join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("key_a", "key_b", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    known = marks.select("doc_id", "key_a", "key_b").join(classes, ["key_a", "key_b"]).select("doc_id", "class_id", "n_links")
    rest = docs.select("doc_id").join(marks.select("doc_id").distinct(), "doc_id", "left_anti")
    return known.union(rest.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def grouped(batches, keys: list[str]):
    """Tables of consecutive rows with equal keys, from batches in the order of these keys."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        change = np.zeros(len(table) - 1, bool)
        for k in keys:
            x = table[k].to_numpy()
            change |= x[1:] != x[:-1]
        edges = [0, *(np.flatnonzero(change) + 1)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield table.slice(a, b - a).combine_chunks()
        held = table.slice(edges[-1])
    if held is not None:
        yield held.combine_chunks()


def deduplicated(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of each class, the first of them, with all its columns; null ids come last."""
    work = Workspace(docs.sparkSession, "jaccard")
    rows = keyed(docs, work)
    classes = _classes(rows, work)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW_KEY))[ROW_KEY]
    return restored(rows.join(classes.groupBy("root").agg(first.alias(ROW_KEY)).select(ROW_KEY), ROW_KEY, "left_semi"), docs.columns)
