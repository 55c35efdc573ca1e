"""Operator 8, near-duplicate documents by SimHash and an LSH forest.

Each document gets a 256-bit SimHash of its word 3-grams. A forest of tries holds
the signatures with their bits permuted, a different permutation in each trie. Two
documents at the radius share the first d bits of a trie with probability
C(256 - radius, d) / C(256, d), as no bit is drawn twice, so the number of tries that the target recall asks for
follows from d; d follows from the number of documents, which keeps the share of
documents in a node, and so the work, in check as data grow.

The tries are distributed by their first d bits, a node at depth d to each group.
Within a node, subtrees are taken deepest first: what is alike merges there, and
on climbing to shorter prefixes, up to depth d where the target recall is met, only
documents of different components are compared. Every candidate is verified on
all 256 bits. A node returns a tree of edges for each component, never all pairs, so
a group of thousands costs thousands of rows; components across nodes and tries
are then joined by star contraction.

Where more than DENSE signatures share a node, as near copies do, the node is cut in the order of its deeper bits into
pieces of bounded size, each worked by itself. What the pieces and all other nodes have joined by then is one component;
only if several components are left in such a node are those outside its largest one compared with the node's pieces, so no link is lost.

Equal signatures, as copies have, enter the forest once.

Defined cases: a null or blank text has no signature and is never a duplicate; nor
is a row whose doc_id is null; both are always kept. A shorter text than three words is one
gram. Ids may be of any type that has an order. Rows that repeat a doc_id are told apart by their signatures: of those that share both, the
filter keeps one, the smallest by text; others stay or go by their own texts. Ties do not arise: the smallest doc_id of a
group stays. An empty table gives an empty result. Other columns, whatever their names, are passed through by the filter and not read otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import cluster, kernel

BITS = 256
RADIUS = 56
RECALL = 0.9
GRAM = 3
#: Documents that a node at the shallowest depth is to hold on average.
NODE = 2048
#: Signatures above which a node is cut into pieces.
DENSE = 16_384

_SALTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _lanes() -> np.ndarray:
    """Byte -> its eight bits in the eight bytes of a word."""
    v = np.arange(256, dtype=np.uint64)
    out = np.zeros(256, np.uint64)
    for k in range(8):
        out |= ((v >> np.uint64(k)) & np.uint64(1)) << np.uint64(8 * k)
    return out


_LANES = _lanes()


def signatures(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """n x 4 words of signature, and which rows have one."""
    n = len(arr)
    cp, starts = kernel.codepoints(arr)
    out = np.zeros((n, BITS // 64), np.uint64)
    if not len(cp):
        return out, np.zeros(n, bool)
    low = kernel.lower_codes()[cp]
    a, b, row = kernel.words(cp, starts)
    word = kernel.slice_hashes(kernel.char_hashes()[low], a, b)
    per = np.bincount(row, minlength=n)
    first = np.concatenate(([0], np.cumsum(per)))
    with np.errstate(over="ignore"):
        gram = word.copy()
        for k in range(1, GRAM):
            nxt = np.concatenate((word[k:], np.zeros(min(k, len(word)), np.uint64)))
            # the grams that would run past a short text hold what there is of it
            inside = np.arange(len(word)) + k < first[row + 1]
            gram = gram * np.uint64(0xD6E8FEB86659FD93) + np.where(inside, nxt, np.uint64(k))
        keys = np.stack([kernel.mix64(gram ^ s) for s in _SALTS], 1)
    parts = keys.view(np.uint8).reshape(len(word), BITS // 8)
    for r in np.flatnonzero(per):
        s, e = first[r], max(first[r] + 1, first[r + 1] - GRAM + 1)
        if e - s <= 255:
            count = _LANES[parts[s:e]].sum(0).view(np.uint8).astype(np.int64)
        else:
            count = np.zeros(BITS, np.int64)
            for x in range(s, e, 255):
                count += _LANES[parts[x : min(x + 255, e)]].sum(0).view(np.uint8)
        out[r] = np.packbits(2 * count > e - s, bitorder="little").view(np.uint64)
    return out, per > 0


def signature_udf():
    """Column function: text -> 32 bytes, null where there is no word."""

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for _, _, sub in kernel.sub_batches(texts):
            s, ok = signatures(sub)
            out += [bytes(x) if k else None for x, k in zip(s, ok, strict=True)]
        return pa.array(out, pa.binary())

    return cluster.arrow_column(run, "binary")


def plan(n: int, radius: int = RADIUS, recall: float = RECALL, node: int = NODE) -> tuple[int, int]:
    """Shallowest depth and number of tries for n signatures."""
    depth = max(4, min(48, math.ceil(math.log2(max(1, n) / node))))
    p = math.comb(BITS - radius, depth) / math.comb(BITS, depth)
    return depth, math.ceil(math.log(1 - recall) / math.log1p(-p))


def permutations(tries: int, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(BITS) for _ in range(tries)])


def _prefix_udf(depth: int, tries: int):
    """Column function: signature -> the node, trie and first `depth` permuted bits, in every trie."""
    perms = permutations(tries)[:, :depth]

    def run(sigs: pa.Array) -> pa.Array:
        if not len(sigs):
            return pa.array([], pa.list_(pa.int64()))
        bits = np.unpackbits(np.frombuffer(b"".join(sigs.to_pylist()), np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little")
        out = np.empty((len(bits), tries), np.int64)
        weight = (1 << np.arange(depth - 1, -1, -1)).astype(np.int64)
        for t in range(tries):
            out[:, t] = bits[:, perms[t]] @ weight + (t << depth)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1) * tries, pa.int32()), pa.array(out.ravel()))

    return cluster.arrow_column(run, "array<bigint>")


def _join(lab: np.ndarray, idx: np.ndarray, sig: np.ndarray, radius: int) -> None:
    """Merges, in lab, the components of rows idx that are within the radius; rows of one component aren't compared."""
    if len(np.unique(lab[idx])) < 2:
        return
    step = max(1, (1 << 21) // len(idx))
    for x in range(0, len(idx), step):
        some = idx[x : x + step]
        rest = idx[x:]
        far = lab[some][:, None] != lab[rest][None, :]
        if not far.any():
            continue
        dist = np.zeros(far.shape, np.uint16)
        for w in range(sig.shape[1]):
            dist += np.bitwise_count(sig[some, w][:, None] ^ sig[rest, w][None, :])
        near = (dist <= radius) & far
        for i in np.flatnonzero(near.any(1)):
            own = np.unique(lab[rest[near[i]]])
            own = own[own != lab[some[i]]]
            if len(own):
                m = min(int(own[0]), int(lab[some[i]]))
                lab[np.isin(lab, np.append(own, lab[some[i]]))] = m


def node_edges(ids: np.ndarray, sig: np.ndarray, order: np.ndarray, depth: int, radius: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A tree of edges for every component of one node: subtrees first, then climbing to the node. known: the components that rows are in already."""
    n = len(ids)
    lab = np.arange(n)
    if known is not None:
        _, first, inverse = np.unique(known, return_index=True, return_inverse=True)
        lab = first[inverse]
    if n > 64:
        bits = np.unpackbits(np.ascontiguousarray(sig).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")[:, order[depth : depth + 32]]
        key = np.ascontiguousarray(np.packbits(bits, axis=1)).view(">u4").ravel()
        at = np.argsort(key, kind="stable")
        for deeper in (32, 16, 8):
            k = key[at] >> (32 - deeper)
            cut = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if b - a > 1:
                    _join(lab, at[a:b], sig, radius)
    _join(lab, np.arange(n), sig, radius)
    root = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(root, lab, ids)
    own = root[lab]
    far = own != ids
    return ids[far], own[far]


def _cells(rows: DataFrame, radius: int, depth: int, perms: np.ndarray) -> DataFrame:
    """Edges (a, b) found within each cell; rows: i, s, node and cell, and c, the component that is known. Rows arrive sorted by cell; one may span several batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def done(parts):
            cell, node, ids, known, raw = (np.concatenate([p[k] for p in parts]) for k in range(5))
            cut = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
            out = [node_edges(ids[a:b], raw[a:b], perms[node[a] >> depth], depth, radius, known[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True) if b - a > 1]
            if out:
                a, b = (np.concatenate([o[k] for o in out]) for k in (0, 1))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, node, ids, known = (batch[c].to_numpy() for c in ("cell", "node", "i", "c"))
            raw = np.frombuffer(b"".join(batch["s"].to_pylist()), np.uint64).reshape(-1, BITS // 64)
            last = int(np.searchsorted(cell, cell[-1]))
            if last:
                yield from done([*held, (cell[:last], node[:last], ids[:last], known[:last], raw[:last])])
                held = []
            elif held and held[-1][0][-1] != cell[0]:
                yield from done(held)
                held = []
            held.append((cell[last:], node[last:], ids[last:], known[last:], raw[last:]))
        if held:
            yield from done(held)
        kernel.release()

    # what no cell needs is not shuffled
    return rows.repartition("cell").sortWithinPartitions("cell").select("i", "s", "node", "cell", "c").mapInArrow(run, "a bigint, b bigint").distinct()


def _deeper_udf(depth: int, perms: np.ndarray):
    """Column function: node and signature -> the 32 bits after the node's, in the node's trie."""

    def run(pairs: pa.Array) -> pa.Array:
        if not len(pairs):
            return pa.array([], pa.int64())
        node, sigs = pairs.field(0).to_numpy(), pairs.field(1).to_pylist()
        bits = np.unpackbits(np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little")
        at = perms[node >> depth][:, depth : depth + 32]
        return pa.array(np.take_along_axis(bits, at, 1).astype(np.int64) @ (1 << np.arange(31, -1, -1)))

    return cluster.arrow_column(run, "bigint")


def edges(sigs: DataFrame, radius: int = RADIUS, recall: float = RECALL, node: int = NODE, dense: int = DENSE) -> DataFrame:
    """Verified edges (a, b) between keys; sigs: i and a distinct s, written."""
    n = sigs.count()
    depth, tries = plan(n, radius, recall, node)
    perms = permutations(tries)
    nodes = sigs.select("i", "s", F.explode(_prefix_udf(depth, tries)(F.col("s"))).alias("node"))
    crowded = cluster.few(nodes.groupBy("node").agg(F.count("*").alias("many")).where(F.col("many") > dense).select(F.col("node").alias("d"), "many"))
    sparse = nodes.join(crowded, F.col("node") == F.col("d"), "left_anti").withColumn("cell", F.col("node")).withColumn("c", F.col("i"))
    found = _cells(sparse, radius, depth, perms)
    if crowded.isEmpty():
        return found
    full = nodes.join(crowded, F.col("node") == F.col("d")).drop("d")
    total = crowded.agg(F.sum("many")).first()[0]
    deeper = full.withColumn("deeper", _deeper_udf(depth, perms)(F.struct("node", "s")))
    pieces = cluster.written(deeper.repartitionByRange(-(-total // (dense // 2 or 1)), "node", "deeper", "i").withColumn("cell", F.xxhash64("node", F.spark_partition_id())).drop("deeper"))
    found = cluster.written(found.union(_cells(pieces.withColumn("c", F.col("i")), radius, depth, perms)))
    # components that are still apart in a crowded node
    roots = components_of(found)
    known = cluster.written(pieces.join(roots, F.col("i") == F.col("x"), "left").withColumn("c", F.coalesce("root", "i")).drop("x", "root"))
    share = known.groupBy("node", "c").agg(F.count("*").alias("n"))
    apart = cluster.few(share.groupBy(F.col("node").alias("d")).agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most")).where("all > most").select("d", "main", F.ceil((F.col("all") - F.col("most")) / dense).cast("int").alias("lots")))
    if apart.isEmpty():
        return found
    open_ = known.join(apart, F.col("node") == F.col("d"))
    lot = F.pmod(F.xxhash64("i"), F.col("lots")).cast("int")
    places = cluster.written(open_.select("node", F.col("cell").alias("piece"), "lots").distinct())
    # every piece meets every lot of the smaller components: in one cell each
    whole = open_.select("i", "s", "node", "c", F.col("cell").alias("piece"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"))
    lots = open_.where("c <> main").select("i", "s", "node", "c", lot.alias("lot")).join(places.select(F.col("node").alias("pn"), "piece"), F.col("node") == F.col("pn")).select("i", "s", "node", "c", "piece", "lot")
    both = whole.unionByName(lots).withColumn("cell", F.xxhash64("node", "piece", "lot"))
    return found.union(_cells(both, radius, depth, perms))


def components_of(found: DataFrame) -> DataFrame:
    """x and root of the components of edges a, b."""
    return cluster.components(found).select(F.col("node").alias("x"), "root")


def _classes(docs: DataFrame, radius: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """doc_id i and signature s of every row that has both, written; and of each signature s the smallest doc_id first and that of its group, root."""
    cluster.bounded_batches(docs.sparkSession)
    docs = cluster.spread(docs)
    sigs = cluster.written(docs.select(F.col("doc_id").alias("i"), signature_udf()(F.col("text").cast("string")).alias("s")).where("i is not null and s is not null"))
    same = sigs.groupBy("s").agg(F.min("i").alias("first"))
    # keys in the order of the smallest doc_id
    keyed = cluster.written(same.repartitionByRange("first", "s").sortWithinPartitions("first", "s").select(F.monotonically_increasing_id().alias("k"), "first", "s"))
    roots = cluster.written(components_of(edges(keyed.select(F.col("k").alias("i"), "s"), radius, recall)))
    tops = keyed.join(roots.select(F.col("root").alias("r")).distinct(), F.col("k") == F.col("r"), "left_semi").select(F.col("k").alias("top"), F.col("first").alias("top_id"))
    named = keyed.join(roots, F.col("k") == F.col("x"), "left").join(tops, F.col("root") == F.col("top"), "left")
    return sigs, cluster.written(named.select("s", "first", F.coalesce("top_id", "first").alias("root"), F.col("top").isNull().alias("leads")))


def duplicates(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL) -> DataFrame:
    """doc_id and duplicate_of, the smallest doc_id of its group, for every document but that one."""
    sigs, classes = _classes(docs, radius, recall)
    return sigs.join(classes, "s").where("i <> root").select(F.col("i").alias("doc_id"), F.col("root").alias("duplicate_of")).distinct()


def keep_one(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL) -> DataFrame:
    """The rows of docs less those of duplicates, with the columns of docs."""
    sigs, classes = _classes(docs, radius, recall)
    named = sigs.join(classes, "s").groupBy(F.col("i").alias("__i")).agg(F.count("*").alias("n"), F.bool_or("leads").alias("leads"), F.min("first").alias("first"))
    gone = named.where("n = 1 and not (leads and first = __i)").select("__i")
    again = cluster.few(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("__again")).agg(F.count("*").alias("__n")).where("__n > 1").select("__again"))
    once = docs.join(again, docs["doc_id"] == again["__again"], "left_anti")
    kept = once.join(gone, once["doc_id"] == gone["__i"], "left_anti")
    # of rows that repeat a doc_id, each by its own signature
    rows = docs.join(again, docs["doc_id"] == again["__again"], "left_semi")
    own = rows.select(F.struct(*[rows[c] for c in docs.columns]).alias("__row"), signature_udf()(rows["text"].cast("string")).alias("__s"))
    held = own.join(classes.select(F.col("s").alias("__t"), "first", "leads"), F.col("__s") == F.col("__t"), "left")
    bare = held.where("__s is null").select("__row.*")
    led = held.where(F.col("leads") & (F.col("first") == F.col("__row.doc_id"))).groupBy("__s").agg(F.min_by("__row", F.coalesce(F.col("__row.text").cast("string"), F.lit(""))).alias("__row")).select("__row.*")
    return kept.unionByName(bare).unionByName(led)
