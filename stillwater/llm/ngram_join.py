"""Similarity join of documents by the Jaccard coefficient of their word shingles, size-aware.

A document's set holds its distinct five-word shingles (64-bit hashes of lower-cased words).  Equal sets are one node.

Small sets, up to a size that the cost model chooses from the sizes found: two sets of sizes a and b link when they
share a subset of the fixed size that the threshold asks of (a, b), so each set is enumerated into its subsets of
those sizes and equal subsets link sets of size a with those of size b, without any check.  Two sets of the larger size
b don't link by a subset for (a, b): that size asks more of them.

Large sets: in one order of all shingles, rare ones first by exact counts, two sets that link share a shingle among their
first a - ceil(0.8 a) + 1.  These prefixes make the inverted lists.  A pair is a candidate where the places of a shared
shingle in both sets leave room for the intersection that their sizes need, and where the signatures of the sets, parities
of hashed shingles, differ in no more bits than the sets may in shingles.  Both conditions hold for every pair that links.

The lists are scanned twice.  First each node is checked against its likeliest neighbours in the lists, and links make
components; then only pairs of different components are candidates.  Short lists are joined with themselves, long ones
are dealt to tasks in pairs of blocks, which emit candidates alone.  Every candidate is verified by the words themselves.

Null texts and texts without words have an empty set, link with nothing and are their own component.  Rows without
doc_id take part but never name a component that has other ids.  Extra columns are read only by ``drop_near_copies``, to
choose among rows that repeat doc_id and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stillwater.llm import common
from stillwater.llm.components import components

WORDS = 5
#: The threshold as a fraction: intersection * DEN >= union * NUM.
NUM, DEN = 80, 100
#: Frequent shingles: at most so many, each in LEAST_DOCS documents at least.
FREQUENT, LEAST_DOCS = 1 << 20, 4
#: Shingles that a task holds before it sends them, and that one range of their values has on average.
BUFFER_SHINGLES, RANGE_SHINGLES = 4_000_000, 1 << 20
#: What a row of an inverted list costs against a row of a subset: scans, counts and a share of the checks.
LIST_COST = 4
LARGEST_BOUNDARY = 12
#: Lists of more rows are scanned in pairs of blocks, of about BLOCK rows each; a star has no more rows than STAR.
LONG, BLOCK, STAR = 128, 512, 1024
#: Rounds of stars end when one links fewer than one in ROUND_GAIN of the open nodes.
ROUNDS, ROUND_GAIN = 8, 20
#: Kinds of list rows: a subset of a set of the smaller or the larger of the list's sizes, a prefix shingle.
SMALLER, PREFIX, LARGER = 0, 1, 2

_STEP = np.uint64(0x9E3779B97F4A7C15)
_TRUE = np.ones(1, bool)


def needed(a, b):
    """The least intersection of sets of sizes a and b that link: intersection * (DEN + NUM) >= NUM * (a + b)."""
    return -(-NUM * (a + b) // (DEN + NUM))


def prefix_size(a):
    return a - (-(-NUM * a // DEN)) + 1


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; a text of fewer words than WORDS has one, of the whole sequence."""
    flat, sizes = common.word_hashes(texts, lower=True)
    n = len(flat)
    rolled = flat.copy()
    for k in range(1, min(WORDS, n)):
        rolled[: n - k] = rolled[: n - k] * _STEP + flat[k:]
    rolled = common.mix64(rolled)
    out, at = [], 0
    for size in sizes.tolist():
        if size >= WORDS:
            own = np.sort(rolled[at : at + size - WORDS + 1])
            out.append(own[np.concatenate([_TRUE, own[1:] != own[:-1]])])
        elif size:
            short = np.array([size], np.uint64)
            for k in range(at, at + size):
                short = common.mix64(short * _STEP + flat[k : k + 1])
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def node_of(own: np.ndarray, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little", signed=True)


def signature(own: np.ndarray) -> bytes:
    """Parities of the shingles' hashes: two sets differ in as many shingles as their signatures in bits, or more."""
    bits = 256
    while bits < 4 * len(own):
        bits *= 2
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def distances(xs: list[bytes], ys: list[bytes]) -> np.ndarray:
    """In how many bits each two signatures differ; the longer one is folded to the length of the other."""
    kinds = np.array([len(x) << 32 | len(y) for x, y in zip(xs, ys, strict=True)], np.int64)
    out = np.zeros(len(xs), np.int64)
    for kind in np.unique(kinds).tolist():
        places = np.flatnonzero(kinds == kind)
        x, y = (np.frombuffer(b"".join([side[i] for i in places.tolist()]), np.uint64).reshape(len(places), -1) for side in (xs, ys))
        while x.shape[1] != y.shape[1]:
            half = max(x.shape[1], y.shape[1]) // 2
            x, y = (z[:, :half] ^ z[:, half:] if z.shape[1] > half else z for z in (x, y))
        out[places] = np.bitwise_count(x ^ y).sum(1)
    return out


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, a hash of both, and the key of the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"), common.text_key().alias("own")).withColumn("row", F.xxhash64("doc_id", "text"))


def document_sets(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, row, own, n_shingles, node, check (a second hash of the set), signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), batch.column("own"), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s, seed) for s in sets], pa.int64()), pa.array([node_of(s, seed + 7919) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.binary())], names=["doc_id", "row", "own", "n_shingles", "node", "check", "signature"])

    return _rows(docs).mapInArrow(run, "doc_id long, row long, own binary, n_shingles long, node long, check long, signature binary")


def frequent_shingles(docs: DataFrame, scratch: common.Scratch, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The FREQUENT most frequent shingles and in how many documents each is, counted over all documents.

    A task sorts its shingles and sends them as runs, one a range of their values; the ranges are as many as ``total``, the
    number of all shingles, asks for, so a range fits in memory at any size.  The counts only order the prefixes and
    tell which lists are long; results don't depend on them.
    """
    ranges = max(1, -(-total // RANGE_SHINGLES))
    edges = (np.arange(1, ranges, dtype=object) * (1 << 64) // ranges).astype(np.uint64)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            found, n = np.unique(np.concatenate(held), return_counts=True)
            cut = [0, *np.searchsorted(found, edges).tolist(), len(found)]
            own = [k for k in range(ranges) if cut[k] < cut[k + 1]]
            small = zstandard.ZstdCompressor(level=1)
            # differences and counts take few bytes, which zstd then packs
            rows = [(small.compress(np.diff(found[cut[k] : cut[k + 1]], prepend=np.uint64(0)).tobytes()), small.compress(n[cut[k] : cut[k + 1]].astype(np.int32).tobytes())) for k in own]
            for a in range(0, len(rows), 64):
                part = rows[a : a + 64]
                yield pa.RecordBatch.from_arrays([pa.array(own[a : a + 64], pa.int32()), pa.array([x for x, _ in part], pa.binary()), pa.array([y for _, y in part], pa.binary())], names=["range", "steps", "n"])

        for batch in batches:
            for own in shingle_sets(batch.column(0).to_pylist()):
                held.append(own)
                size += len(own)
            if size > BUFFER_SHINGLES:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    def merged(table: pa.Table) -> pa.Table:
        big = zstandard.ZstdDecompressor()
        found = np.concatenate([np.cumsum(np.frombuffer(big.decompress(x), np.uint64), dtype=np.uint64) for x in table.column("steps").to_pylist()])
        n = np.concatenate([np.frombuffer(big.decompress(x), np.int32) for x in table.column("n").to_pylist()]).astype(np.int64)
        by = np.argsort(found)
        found, n = found[by], n[by]
        head = np.flatnonzero(np.concatenate([_TRUE[: len(found)], found[1:] != found[:-1]]))
        n = np.add.reduceat(n, head) if len(head) else n
        often = n >= LEAST_DOCS
        return pa.table({"shingle": pa.array(common.int64(found[head][often]), pa.int64()), "n": pa.array(n[often], pa.int64())})

    counted = docs.select(common.text_of().alias("text")).mapInArrow(runs, "range int, steps binary, n binary").groupBy("range").applyInArrow(merged, "shingle long, n long")
    counted = scratch.table(counted, "frequent")
    levels = sorted(counted.groupBy(F.floor(F.log2("n") * 8).alias("level")).count().collect(), key=lambda r: -r["level"])  # 8 a power of 2
    least, kept = 1 << 20, 0
    for row in levels:
        kept += row["count"]
        if kept > FREQUENT:
            break
        least = row["level"]
    rows = counted.where(F.floor(F.log2("n") * 8) >= least).toArrow()
    shingles, n = rows.column("shingle").to_numpy(), rows.column("n").to_numpy()
    by = np.argsort(shingles.view(np.uint64))
    return shingles[by], n[by].astype(np.int32)


def boundary(sizes: dict[int, int]) -> int:
    """The largest size whose sets are enumerated into subsets: the cheapest by the number of rows."""

    def subsets(a: int) -> int:
        return sum(comb(a, needed(a, b)) for b in range(1, 2 * a + 2) if needed(a, b) <= min(a, b) and not a == b == needed(a, b))

    small = {a: n for a, n in sizes.items() if a <= 2 * LARGEST_BOUNDARY}
    cost = {x: sum(n * subsets(a) for a, n in small.items() if a <= x) + sum(n * prefix_size(a) * LIST_COST for a, n in small.items() if a * DEN > x * NUM) for x in range(LARGEST_BOUNDARY + 1)}
    return min(cost, key=lambda x: (cost[x], x))


def _subset_rows(own: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """kind (SMALLER, LARGER: which of both sizes the set has) and hash of (sizes, subset), of a small set."""
    a = len(own)
    for b in range(1, limit + 1):
        size = needed(a, b)
        if size <= min(a, b) and not (a == b == size):
            head = f"{min(a, b)},{max(a, b)}:".encode()
            kind = SMALLER if a <= b else LARGER
            for chosen in combinations(own.tolist(), size):
                yield kind, int.from_bytes(hashlib.blake2b(head + np.array(chosen, np.uint64).tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_rows(docs: DataFrame, seed: int, limit: int, frequent) -> DataFrame:
    """One row a prefix shingle or subset of each node that a task sees: kind (SMALLER or LARGER subset, PREFIX), shingle,
    node, size, place (in the set's order), docs (of a frequent shingle: in how many documents it is, else 0).
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, counts = shared.value
        often = often.view(np.uint64)
        seen: set[int] = set()
        for batch in batches:
            keys, nodes, sizes, kinds, places, weights = [], [], [], [], [], []
            for own in shingle_sets(batch.column(0).to_pylist()):
                a = len(own)
                node = node_of(own, seed)
                if not a or node in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(node)
                if a <= limit:
                    found = list(_subset_rows(own, limit))
                    keys.append(np.array([key for _, key in found], np.int64))
                    kinds.append(np.array([kind for kind, _ in found], np.int8))
                    nodes.append(np.full(len(found), node))
                    sizes.append(np.full(len(found), a, np.int32))
                    places.append(np.zeros(len(found), np.int32))
                    weights.append(np.zeros(len(found), np.int32))
                if a * DEN > limit * NUM:
                    values = common.int64(own)
                    weight = np.zeros(a, np.int64)
                    if len(often):
                        at = np.minimum(np.searchsorted(often, own), len(often) - 1)
                        weight = np.where(often[at] == own, counts[at], 0)
                    by = np.lexsort((own, weight))[: prefix_size(a)] if weight.any() else np.arange(prefix_size(a))
                    first = values[by]
                    keys.append(first)
                    kinds.append(np.full(len(first), PREFIX, np.int8))
                    nodes.append(np.full(len(first), node))
                    sizes.append(np.full(len(first), a, np.int32))
                    places.append(np.arange(len(first), dtype=np.int32))
                    weights.append(weight[by].astype(np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds), pa.int8()), pa.array(np.concatenate(keys), pa.int64()), pa.array(np.concatenate(nodes), pa.int64()), pa.array(np.concatenate(sizes), pa.int32()), pa.array(np.concatenate(places), pa.int32()), pa.array(np.concatenate(weights), pa.int32())], names=["kind", "shingle", "node", "size", "place", "docs"])

    return docs.select(common.text_of().alias("text")).mapInArrow(run, "kind byte, shingle long, node long, size int, place int, docs int")


def exact_set(text: str) -> set[bytes]:
    words = common.space_words(text, lower=True)
    return {b" ".join(words[i : i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))}


def verified(docs: DataFrame, pairs: DataFrame, reps: DataFrame, scratch: common.Scratch, name: str) -> DataFrame:
    """Those pairs (u, v) whose sets, of the words themselves, link.  Each text moves once to its node and once a pair."""
    asked = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(reps.select("node", "row", "own"), "node")
    texts = common.packed(_rows(docs).select("row", "own", "text").join(asked, ["row", "own"]).select("node", "text"))
    texts = scratch.table(texts.groupBy("node").agg(F.first("text").alias("text")), f"{name}-texts")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, a = None, set()
        for batch in batches:
            keep = []
            for u, x, y in zip(*(batch.column(c).to_pylist() for c in ("u", "x", "y")), strict=True):
                x, y = common.unpack([x, y])
                if u != last:
                    last, a = u, exact_set(x)
                b = exact_set(y)
                same = len(a & b)
                keep.append(same * DEN >= NUM * (len(a) + len(b) - same))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.select("u", "v").join(texts.select(F.col("node").alias("v"), F.col("text").alias("y")), "v").join(texts.select(F.col("node").alias("u"), F.col("text").alias("x")), "u")
    return joined.select("u", "v", "x", "y").mapInArrow(check, "u long, v long")


def _open(rows: DataFrame, labels: DataFrame | None, scratch: common.Scratch, name: str) -> DataFrame:
    """Rows (shingle, node, size, place) of lists that still hold different components, with the components' labels and
    the lists' lengths n.
    """
    labelled = rows.select("shingle", "node", "size", "place")
    if labels is None:
        labelled = labelled.withColumn("label", F.col("node"))
    else:
        labelled = labelled.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).select("shingle", "node", "size", "place", "label")
    several = labelled.groupBy("shingle").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("n")).where("a != b").select("shingle", "n")
    several = scratch.table(several, f"{name}-lists")
    total = several.agg(F.sum("n")).first()[0] or 0
    return scratch.table(common.heavy_light_join(labelled, several, ["shingle"], "n", total), name)


#: In SQL, of two rows x and y of one list: different components, and places that leave room for a link.
_NEEDED = f"(({NUM} * (x.size + y.size) + {DEN + NUM - 1}) div {DEN + NUM})"
_MAY_LINK = f"x.label != y.label and x.place + {_NEEDED} <= x.size and y.place + {_NEEDED} <= y.size"


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those pairs (u, v) whose signatures allow a link, with the share of differing shingles that they tell (apart)."""
    signs = nodes.select("node", "size", "signature")
    both = pairs.join(signs.toDF("u", "a", "x"), "u").join(signs.toDF("v", "b", "y"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            apart = distances(batch.column("x").to_pylist(), batch.column("y").to_pylist())
            keep = apart <= a + b - 2 * needed(a, b)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(apart / (a + b))], names=["u", "v", "apart"]).filter(pa.array(keep))

    return both.select("u", "v", "a", "b", "x", "y").mapInArrow(run, "u long, v long, apart double")


def _neighbours(opened: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Pairs (u, v) of different components that stand side by side in a list: for each node the two that are most
    alike.  Only how many checks are needed depends on this choice.  Long lists are cut into stars, another way each round.
    """
    star = F.pmod(F.xxhash64("node", "shingle", F.lit(k)), F.ceil(F.col("n") / STAR).cast("long"))
    turn = Window.partitionBy("shingle", "star").orderBy(*(("size", "node") if k == 0 else (F.xxhash64("node", F.lit(k)), "node")))
    me = F.struct("node", "size", "label", "place")
    near = opened.withColumn("star", star).withColumns({"before": F.lag(me).over(turn), "earlier": F.lag(me, 2).over(turn), "first": F.first(me).over(turn)})
    near = near.select(me.alias("x"), F.explode(F.array_distinct(F.array("before", "earlier", "first"))).alias("y")).where(f"y is not null and {_MAY_LINK}")
    met = near.select(F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v")).distinct()
    best = F.row_number().over(Window.partitionBy("v").orderBy("apart", "u"))
    return _alike(met, nodes).withColumn("r", best).where("r <= 2").select("u", "v")


def _block_pairs(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) of the rows of long lists that may link.  A list is cut into blocks and each two blocks meet in one
    task, so a list of n rows moves n / BLOCK times and no pair leaves the task but those that all conditions allow.
    """
    parts = F.ceil(F.col("n") / BLOCK).cast("long")
    cut = rows.join(nodes.select("node", "signature"), "node").withColumns({"parts": parts, "part": F.pmod(F.xxhash64("node", "shingle"), parts)})
    cut = cut.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    cut = cut.select("shingle", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "size", "place", "label", "signature")

    def meet(table: pa.Table) -> pa.Table:
        i, j, part, node, size, place, label = (table.column(c).to_numpy() for c in ("i", "j", "part", "node", "size", "place", "label"))
        signs = table.column("signature").to_pylist()
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        us, vs = [], []
        for k in left.tolist():
            need = needed(size[k] + 0, size[right])
            own = right[(label[right] != label[k]) & (place[k] + need <= size[k]) & (place[right] + need <= size[right])]
            if i[0] == j[0]:
                own = own[node[own] > node[k]]
            if len(own):
                apart = distances([signs[k]] * len(own), [signs[o] for o in own.tolist()])
                own = own[apart <= size[k] + size[own] - 2 * needed(size[k], size[own])]
                us.append(np.minimum(node[k], node[own]))
                vs.append(np.maximum(node[k], node[own]))
        none = np.zeros(0, np.int64)
        return pa.table({"u": np.concatenate([none, *us]), "v": np.concatenate([none, *vs])})

    return cut.groupBy("shingle", "i", "j").applyInArrow(meet, "u long, v long")


def _rest(opened: DataFrame, nodes: DataFrame, scratch: common.Scratch) -> DataFrame:
    """All pairs (u, v) of different components that share a list and may link."""
    short = opened.where(F.col("n") <= LONG)
    joined = short.alias("x").join(short.alias("y"), F.col("x.shingle") == F.col("y.shingle")).where(F.expr(f"x.node < y.node and {_MAY_LINK}"))
    pairs = scratch.table(_alike(joined.select(F.col("x.node").alias("u"), F.col("y.node").alias("v")).distinct(), nodes).select("u", "v"), "rest-short")
    long = opened.where(F.col("n") > LONG)
    return pairs if long.isEmpty() else pairs.unionByName(_block_pairs(long, nodes)).distinct()


def _named(docs: DataFrame, scratch: common.Scratch) -> DataFrame:
    """One row a document: doc_id, own, n_shingles, label (the same for all documents of a component)."""
    spark = scratch.spark
    for seed in range(16):  # another seed should two sets ever share a hash
        documents = scratch.table(document_sets(docs, seed), f"documents-{seed}")
        if documents.groupBy("node").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a != b").isEmpty():
            break
    first = F.min(F.struct("row", "own")).alias("m")
    nodes = documents.where("n_shingles > 0").groupBy("node").agg(first, F.first("n_shingles").alias("size"), F.first("signature").alias("signature"))
    nodes = scratch.table(nodes.select("node", "m.row", "m.own", "size", "signature"), "nodes")
    sizes = {r["size"]: r["count"] for r in nodes.where(F.col("size") <= 2 * LARGEST_BOUNDARY).groupBy("size").count().collect()}
    limit = boundary(sizes)
    total = documents.agg(F.sum("n_shingles")).first()[0] or 0
    keyed = prefix_rows(docs, seed, limit, frequent_shingles(docs, scratch, total))
    # rows of a list stand together, but for those of shingles in very many documents, which all stay
    own_list = Window.partitionBy(F.col("kind") == PREFIX, "shingle", F.when(F.col("docs") > STAR, F.col("node")))
    lists = keyed.withColumns({"a": F.min("node").over(own_list), "b": F.max("node").over(own_list)}).where(f"a != b or docs > {STAR}").drop("a", "b", "docs").distinct()
    lists = scratch.table(lists, "lists")
    scratch.drop("frequent")
    common.release(spark)
    # small sets: the first of the smaller size in each list, linked with all others; those of the larger size link with it alone
    heads = lists.where(F.col("kind") == SMALLER).groupBy("shingle").agg(F.min("node").alias("u"), F.count("*").alias("n"))
    small = lists.where(F.col("kind") != PREFIX).select("shingle", F.col("node").alias("v"))
    small = small.join(heads, "shingle").where("u != v").select("u", "v").distinct()
    # large sets: neighbours in the lists, in another order each round, that look alike; links make components
    links, tried, labels, still = scratch.table(small, "small"), None, None, lists.where(F.col("kind") == PREFIX)
    for k in range(ROUNDS):
        opened = _open(still, labels, scratch, f"open-{k}")
        if opened.isEmpty():
            break
        chosen = _neighbours(opened, nodes, k)
        if tried is not None:
            chosen = chosen.join(tried, ["u", "v"], "left_anti")
        chosen = scratch.table(chosen, f"tried-{k}")
        found = scratch.table(verified(docs, chosen, nodes, scratch, f"found-{k}"), f"found-{k}")
        tried = chosen if tried is None else tried.unionByName(chosen)
        links, still = links.unionByName(found), opened.drop("label", "n")
        gained = found.count()
        if k == 0 or gained:
            labels = components(links, scratch, f"components-{k}")
        scratch.drop(f"found-{k}-texts")
        if k:
            scratch.drop(f"open-{k - 1}")
        else:
            scratch.drop("lists")
        common.release(spark)
        if gained * ROUND_GAIN < opened.select("node").distinct().count():
            break
    if labels is None:  # no list holds two large sets
        labels = components(links, scratch, "components-small")
    # what different components still share
    if not opened.isEmpty() and not (opened := _open(still, labels, scratch, "open")).isEmpty():
        left = scratch.table(_rest(opened, nodes, scratch).join(tried, ["u", "v"], "left_anti"), "left")
        common.release(spark)
        last = scratch.table(verified(docs, left, nodes, scratch, "last"), "last")
        if not last.isEmpty():
            labels = components(links.unionByName(last), scratch, "components")
    # documents of one node are as many as a text has copies
    copies = documents.groupBy("node").agg(F.count("*").alias("n")).join(labels, "node").select(F.col("node").cast("string").alias("node"), F.col("label").cast("string").alias("label"), "n")
    keyed = documents.select("doc_id", "row", "own", "n_shingles", F.col("node").cast("string").alias("node"))
    named = common.attach(keyed, copies, "node", "n", documents.count(), ["label"], ["row", "own"])
    return scratch.table(named.select("doc_id", "own", "n_shingles", F.coalesce("label", "node").alias("label")), "named")


def linked(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id."""
    named = _named(docs, common.Scratch(common.prepare(docs.sparkSession), "ngram_join"))
    groups = named.where("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("n"))
    joined = common.attach(named.drop("own"), groups.where("n > 1"), "label", "n", named.count(), ["smallest"], ["doc_id"])
    return joined.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("smallest", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component, that with the smallest doc_id, with all its columns.  Of rows that share it, the one
    with the smallest text key stays; rows without doc_id come last.  Rows without words stay.
    """
    scratch = common.Scratch(common.prepare(docs.sparkSession), "ngram_join")
    named = _named(docs, scratch).where("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("own").alias("c"))
    groups = named.groupBy("label").agg(F.min(order).alias("best"), F.count("*").alias("n"))
    groups = scratch.table(groups.where("n > 1").select("label", "n", F.col("best.b").alias("keep_id"), F.col("best.c").alias("keep_own")), "groups")
    joined = common.attach(named, groups, "label", "n", named.count(), ["keep_id", "keep_own"], ["doc_id", "own"])
    kept = F.col("keep_own").isNull() | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("own") == F.col("keep_own")))
    return common.drop_by_key(docs, joined.select("doc_id", "own", kept.alias("kept")), scratch)
