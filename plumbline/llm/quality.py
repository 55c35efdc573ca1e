"""Operator 5, quality rules: how much of a text repeats itself.

For several n-gram lengths, words are hashed from one prefix sum over the code
points and n-grams by rolling over the word hashes, all in numpy. The measure of
a length is the share of the words' characters that lie inside an n-gram seen
earlier in the same document; overlapping n-grams count once. The same is done
for whole lines. A document is rejected when a share of characters exceeds its
threshold; the share of repeated lines, unsteady in short texts, is only reported.

A longer n-gram can only repeat where the shorter one starting at the same word
does, so each length looks only at the positions that its predecessor left.

Defined cases: a null or empty text has measures 0 and is kept; a row is
measured by itself, so repeated rows get equal measures, and other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import cluster, kernel

#: Share of characters in repeated n-grams above which a document is rejected.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Share of the lines' characters in lines seen earlier in the document above which it is rejected.
LINE_CHAR_LIMIT = 0.20

_ROLL = np.uint64(0xD6E8FEB86659FD93)


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and which of these are not the first occurrence."""
    n = len(keys)
    shared, later = np.zeros(n, bool), np.zeros(n, bool)
    if n < 2:
        return shared, later
    bits = min(24, max(8, int(4 * n).bit_length()))
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    few = np.flatnonzero(np.bincount(bucket, minlength=1 << bits)[bucket] > 1)
    if len(few):
        k = keys[few]
        order = np.argsort(k, kind="stable")
        same = k[order][1:] == k[order][:-1]
        later[few[order[1:][same]]] = True
        shared[few[order[1:][same]]] = True
        shared[few[order[:-1][same]]] = True
    return shared, later


def measure(arr: pa.Array, limits: dict[int, float] = NGRAM_LIMITS) -> dict[str, np.ndarray]:
    """Columns n_words, dup_lines, dup_line_chars and dup_<n> for one sub-batch."""
    n = len(arr)
    cp, starts = kernel.codepoints(arr)
    values = kernel.char_hashes()[cp]
    a, b, row = kernel.words(cp, starts)
    lengths = (b - a).astype(np.float64)
    total = kernel.row_sums(lengths, row, n)
    out = {"n_words": np.bincount(row, minlength=n) if len(row) else np.zeros(n, np.int64)}
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        word = kernel.slice_hashes(values, a, b)
        salt = kernel.mix64(row.astype(np.uint64) + np.uint64(0x51ED270B))
        rolled, at = word.copy(), np.arange(len(word))
        width = 1
        for size in sorted(limits):
            while width < size:
                whole = at + width < len(word)
                at, rolled = at[whole], rolled[whole]
                rolled = rolled * _ROLL + word[at + width]
                width += 1
            # positions whose n-gram stays inside the document
            ok = row[at] == row[at + size - 1] if len(at) else np.zeros(0, bool)
            at, rolled = at[ok], rolled[ok]
            shared, later = _repeats(kernel.mix64(rolled + salt[at]))
            edge = np.zeros(len(word) + 1, np.int32)
            np.add.at(edge, at[later], 1)
            np.add.at(edge, at[later] + size, -1)
            covered = np.cumsum(edge[:-1]) > 0
            out[f"dup_{size}"] = np.nan_to_num(kernel.row_sums(lengths[covered], row[covered], n) / total)
            at, rolled = at[shared], rolled[shared]
        la, lb, lrow = _lines(cp, starts)
        _, again = _repeats(kernel.mix64(kernel.slice_hashes(values, la, lb) + kernel.mix64(lrow.astype(np.uint64) + np.uint64(7))))
        size = (lb - la).astype(np.float64)
        out["dup_lines"] = np.nan_to_num(np.bincount(lrow[again], minlength=n) / np.bincount(lrow, minlength=n)) if len(lrow) else np.zeros(n)
        out["dup_line_chars"] = np.nan_to_num(kernel.row_sums(size[again], lrow[again], n) / kernel.row_sums(size, lrow, n))
    return out


def _lines(cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the lines that are not empty."""
    brk = np.flatnonzero(cp == 10)
    a = np.union1d(starts[:-1], brk + 1)
    a = a[a < len(cp)]
    if not len(a):
        return a, a, a
    b = np.concatenate((a[1:], [len(cp)])).astype(np.int64)
    b = b - (cp[b - 1] == 10)
    full = b > a
    a, b = a[full], b[full]
    return a, b, np.searchsorted(starts, a, side="right") - 1


def _columns(limits: dict[int, float]) -> list[tuple[str, pa.DataType]]:
    return [("n_words", pa.int64()), ("dup_lines", pa.float64()), ("dup_line_chars", pa.float64()), *((f"dup_{k}", pa.float64()) for k in sorted(limits)), ("keep", pa.bool_())]


def repetition_udf(limits: dict[int, float] = NGRAM_LIMITS, line_char_limit: float = LINE_CHAR_LIMIT):
    """Column function: text -> struct of measures and `keep`."""
    columns = _columns(limits)
    ddl = "struct<" + ",".join(f"{c}:{ {'int64': 'bigint', 'double': 'double', 'bool': 'boolean'}[str(t)] }" for c, t in columns) + ">"

    def run(texts: pa.Array) -> pa.Array:
        parts = [measure(sub, limits) for _, _, sub in kernel.sub_batches(texts)]
        out = {c: np.concatenate([p[c] for p in parts]) if parts else np.zeros(0) for c, _ in columns[:-1]}
        keep = out["dup_line_chars"] <= line_char_limit
        for k, most in limits.items():
            keep &= out[f"dup_{k}"] <= most
        return pa.StructArray.from_arrays([pa.array(x, t) for x, (_, t) in zip([*out.values(), keep], columns, strict=True)], [c for c, _ in columns])

    return cluster.arrow_column(run, ddl)


def repetition(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, the measures and `keep`, a row for each row of docs."""
    cluster.bounded_batches(docs.sparkSession)
    docs = cluster.spread(docs)
    return docs.select("doc_id", repetition_udf(**limits)(F.col("text").cast("string")).alias("m")).select("doc_id", "m.*")


def keep_unrepetitive(docs: DataFrame, **limits) -> DataFrame:
    """The rows of docs that pass every rule, with the columns of docs."""
    cluster.bounded_batches(docs.sparkSession)
    docs = cluster.spread(docs)
    return docs.where(repetition_udf(**limits)(docs["text"].cast("string"))["keep"])
