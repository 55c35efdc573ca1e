"""Operator 1, exact top-k search with a bit-sliced index.

Of every query vector the k nearest others by inner product are found exactly. A
block of the corpus is held as bit slices: bitmap (d, b) has a bit for each row,
bit b of the quantised coordinate d. For a query, the slices are added with the
query's integer weights by bitmap arithmetic alone (carry-save adders by weight
position), giving the slices of a quantised score. The k-th best is found from the most significant slice
downward by counting bits; all rows that the error bound of quantisation can't rule out
form the boundary, and these few are scored exactly.

The corpus is shuffled once into blocks of bounded size, each indexed once; the queries are a table in the shared
folder that every block reads, a batch at a time. A first pass over about the root of the number of blocks gives each
query a floor, the k-th best so far, below which the other blocks neither score nor return rows: what is merged is
in proportion to the root of the number of blocks. Queries times rows is the nature of an exact search; the
bitmaps take 1 / 64 of the operations.

Defined cases: rows with a null id or vector, an empty vector or one with a null, NaN or infinite coordinate take no part. Vectors
of several lengths are searched among their own length. Coordinates of any finite size are taken, scaled by a power
of two where they are very large or small. Ids may be of any type that has an order. Equal scores rank by vec_id. A row's own id is not among its
neighbours; repeated rows are queries and neighbours each, identical results included. Fewer than k
others give fewer rows. Only vec_id and embedding are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import cluster, kernel

K = 10
BITS = 6
WEIGHT_BITS = 6
CORPUS_BLOCK = 1 << 16
#: A block has as many rows at least, where there are too few to give every core a full one.
LEAST_BLOCK = 1 << 11
QUERY_BLOCK = 1 << 12
#: Number of blocks from which a first pass looks for floors.
MANY_BLOCKS = 16


class Index:
    """Bit slices of one block."""

    def __init__(self, x: np.ndarray, bits: int = BITS):
        self.x, self.n, self.top = x, len(x), (1 << bits) - 1
        low, high = x.min(0), x.max(0)
        self.step = np.where(high > low, (high - low) / (1 << bits), 1.0)
        u = np.clip(np.floor((x - low) / self.step), 0, self.top)
        # a coordinate lies half a step around its cell's middle
        self.middle = low + self.step / 2
        self.rest = float(np.sqrt((((x - self.middle) - self.step * u) ** 2).sum(1)).max()) if self.n else 0.0
        self.spread = float(np.sqrt(((u - self.top / 2) ** 2).sum(1)).max()) if self.n else 0.0
        words = -(-self.n // 64)
        full = np.zeros((x.shape[1], bits, words * 64), np.uint8)
        for b in range(bits):
            full[:, b, : self.n] = ((u.astype(np.int64) >> b) & 1).T
        plus = np.packbits(full, axis=2, bitorder="little").view(np.uint64)
        all_rows = np.zeros(words * 64, np.uint8)
        all_rows[: self.n] = 1
        self.rows = np.packbits(all_rows, bitorder="little").view(np.uint64)
        self.bits = bits
        #: slice b of coordinate d is row d * bits + b; after all of these come those of top - u, for negative weights
        self.slices = np.concatenate((plus, ~plus & self.rows)).reshape(2 * x.shape[1] * bits, words)

    def add(self, q: np.ndarray, weight_bits: int = WEIGHT_BITS) -> tuple[list[np.ndarray], float, float, float]:
        """Slices of the quantised score, least first; the score of one unit; the score of zero units; the error, in score, of both together."""
        w = q * self.step
        unit = float(np.abs(w).max()) / ((1 << weight_bits) - 1) or 1.0
        whole = np.rint(np.abs(w) / unit).astype(np.int64)
        # the slices to add, by the position of the weight's bit
        base = (np.arange(len(q)) + np.where(w < 0, len(q), 0)) * self.bits
        on = [base[(whole >> t) & 1 == 1] for t in range(weight_bits)]
        out, carried, p = [], [], 0
        while carried or p < weight_bits + self.bits - 1:
            pile = [self.slices[on[t] + (p - t)] for t in range(weight_bits) if 0 <= p - t < self.bits] + carried
            x, carried, p = np.concatenate(pile), [], p + 1
            # carry-save adders, a third of the pile at once
            while len(x) > 2:
                third = len(x) // 3
                a, b, c = x[:third], x[third : 2 * third], x[2 * third : 3 * third]
                half = a ^ b
                carried.append((a & b) | (half & c))
                x = np.concatenate((half ^ c, x[3 * third :]))
            if len(x) == 2:
                carried.append(x[:1] & x[1:])
                x = x[:1] ^ x[1:]
            out.append(x[0] if len(x) else np.zeros_like(self.rows))
        while len(out) > 1 and not out[-1].any():
            out.pop()
        lost = np.abs(w) - unit * whole
        error = float(np.linalg.norm(q)) * self.rest + float(np.linalg.norm(lost)) * self.spread
        zero = float(q @ self.middle + (lost / 2 - np.where(w < 0, np.abs(w), 0.0)).sum() * self.top)
        return out, unit, zero, error

    def at_least(self, slices: list[np.ndarray], value: int) -> np.ndarray:
        """Bitmap of the rows whose sliced number is at least value."""
        above, equal = np.zeros_like(self.rows), self.rows.copy()
        if value <= 0:
            return equal
        if value.bit_length() > len(slices):
            return above
        for p in range(len(slices) - 1, -1, -1):
            if value >> p & 1:
                equal &= slices[p]
            else:
                above |= equal & slices[p]
                equal &= ~slices[p]
        return above | equal

    def kth(self, slices: list[np.ndarray], k: int) -> int:
        """The k-th largest sliced number, slice by slice from the most significant."""
        above, equal, value = 0, self.rows.copy(), 0
        for p in range(len(slices) - 1, -1, -1):
            ones = equal & slices[p]
            many = int(np.bitwise_count(ones).sum())
            if above + many >= k:
                equal, value = ones, value | 1 << p
            else:
                above += many
                equal &= ~slices[p]
        return value

    def search(self, q: np.ndarray, k: int, floor: float = -math.inf) -> np.ndarray:
        """Rows among which the k best by exact score that reach the floor are certain to be."""
        if self.n <= k:
            return np.arange(self.n)
        slices, unit, zero, error = self.add(q)
        least = self.kth(slices, k) - int(np.ceil(2 * error / unit)) - 1
        if floor > -math.inf:
            least = max(least, int(np.floor((floor - zero - error) / unit)) - 1)
        return np.flatnonzero(np.unpackbits(self.at_least(slices, least).view(np.uint8), bitorder="little")[: self.n])


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision; equal rows have equal scores wherever they stand."""
    return (x * q).cumsum(axis=1)[:, -1]


def _matrix(rows: pa.RecordBatch) -> np.ndarray:
    """Vectors of one length."""
    return rows["e"].flatten().to_numpy().reshape(rows.num_rows, -1)


def _by_length(rows: pa.RecordBatch) -> dict[int, pa.RecordBatch]:
    size = pc.list_value_length(rows["e"])
    return {n.as_py(): rows.filter(pc.equal(size, n)) for n in size.unique()}


class Block:
    """An index of the rows i, e of one length."""

    def __init__(self, rows: pa.RecordBatch):
        ids = rows["i"].dictionary_encode()
        self.ids = ids.dictionary
        # ids are compared by their places in order
        place = np.empty(len(self.ids), np.int64)
        place[pc.sort_indices(self.ids).to_numpy()] = np.arange(len(self.ids))
        self.code = ids.indices.to_numpy()
        self.rank, self.same = place[self.code], np.bincount(self.code, minlength=len(self.ids))
        self.index = Index(_matrix(rows))

    def top(self, queries: pa.RecordBatch, k: int) -> pa.RecordBatch:
        """q, j and s: for each of the queries q, i, e and floor the k best rows at most that reach its floor."""
        own = pc.index_in(queries["i"], value_set=self.ids).fill_null(-1).to_numpy()
        at, found, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for i, (me, v, floor) in enumerate(zip(own, _matrix(queries), queries["floor"].to_numpy(), strict=True)):
            rows = self.index.search(v, k + (int(self.same[me]) if me >= 0 else 0), floor)
            rows = rows[self.code[rows] != me]
            s = exact_scores(self.index.x[rows], v)
            rows, s = rows[s >= floor], s[s >= floor]
            best = np.lexsort((self.rank[rows], -s))[:k]
            at.append(np.full(len(best), i))
            found.append(rows[best])
            scores.append(s[best])
        j = self.ids.take(pa.array(self.code[np.concatenate(found)]))
        return pa.RecordBatch.from_arrays([queries["q"].take(pa.array(np.concatenate(at))), j, pa.array(np.concatenate(scores))], ["q", "j", "s"])


def _search(corpus: DataFrame, n: int, queries: DataFrame, k: int) -> DataFrame:
    """q, j and s of every block's best rows; queries: a written table of q, i, e and floor."""
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    files = sorted(queries.inputFiles())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pylist([])])
        if not held.num_rows:
            return
        blocks = {size: Block(rows) for size, rows in _by_length(held.combine_chunks().to_batches()[0]).items()}
        for uri in files:
            system, path = pafs.FileSystem.from_uri(uri)
            with system.open_input_file(path) as f:
                for batch in pq.ParquetFile(f).iter_batches(batch_size=QUERY_BLOCK):
                    for size, some in _by_length(batch).items():
                        if size in blocks:
                            yield blocks[size].top(some, k)
        kernel.release()

    n_blocks = max(1, -(-n // CORPUS_BLOCK), min(cores, -(-n // LEAST_BLOCK)))
    kind = corpus.schema["i"].dataType.simpleString()
    return corpus.repartition(n_blocks).mapInArrow(run, f"q bigint, j {kind}, s double")


def top_k(vectors: DataFrame, k: int = K, queries: DataFrame | None = None) -> DataFrame:
    """vec_id, neighbor_id and rank (1 to k) of the nearest rows of vectors for every row of queries, if not given every row of vectors."""
    whole = "i is not null and size(e) > 0 and not exists(e, x -> x is null or isnan(x) or abs(x) = double('Infinity'))"
    plain = lambda df: df.select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("e")).where(whole)
    v = plain(vectors)
    q = v if queries is None else plain(queries)
    sizes = [d.agg(F.count("*"), F.max(F.array_max(F.transform("e", F.abs)))).first() for d in ((v,) if queries is None else (v, q))]
    n, largest = sizes[0][0], max((s[1] or 0.0) for s in sizes)
    if largest and not 2.0**-200 < largest < 2.0**200:
        by = F.lit(2.0 ** (-math.frexp(largest)[1] // 2))
        v, q = (d.select("i", F.transform("e", lambda x: x * by * by).alias("e")) for d in (v, q))
    q = cluster.written(q.select(F.monotonically_increasing_id().alias("q"), "i", "e", F.lit(-math.inf).alias("floor")))
    order = Window.partitionBy("q").orderBy(F.desc("s"), "j")
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    n_blocks = -(-n // CORPUS_BLOCK)
    if n_blocks < MANY_BLOCKS:
        found = _search(v, n, q, k)
    else:
        share = math.isqrt(n_blocks) / n_blocks
        first = F.pmod(F.xxhash64(F.col("i").cast("string"), F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20))
        some = cluster.written(best(_search(v.where(first), int(n * share) + 1, q, k)).select("q", "j", "s", "rank"))
        floors = some.where(F.col("rank") == k).select(F.col("q").alias("__q"), F.col("s").alias("__floor"))
        q2 = q.join(floors, F.col("q") == F.col("__q"), "left").select("q", "i", "e", F.coalesce("__floor", "floor").alias("floor"))
        found = some.select("q", "j", "s").unionByName(_search(v.where(~first), int(n * (1 - share)) + 1, cluster.written(q2), k))
    return best(found).join(q.select(F.col("q").alias("__q"), F.col("i").alias("vec_id")), F.col("q") == F.col("__q")).select("vec_id", F.col("j").alias("neighbor_id"), "rank")
