"""Operator 9, language identification by bit-sliced Bloom filters.

One Bloom filter per language over the same hash functions, stored sliced: cell i
holds a word whose bit l is bit i of language l's filter, or as many words of 64 bits as
the languages need. And-ing the cells of an
n-gram's hashes therefore gives, in one pass, the set of all languages that may
contain it. A document's n-grams are counted per language (the popcount of that
bit over its masks), the expected false positives of each filter are taken off,
and the language with the largest share decides.

The filters are filled from a sample of labelled rows, at most `per_language`
of each language; everything else reads all rows. A filter's size is a parameter, so what is sent to the
workers grows with the number of labels, by half a megabyte each, and not with the rows.

Defined cases: a null, empty or letterless text has no n-grams and gets no
language (null) and `keep` false; so has a text in which too few n-grams belong to
any language. Equal shares go to the language first in alphabetical order. Rows
whose label is null or whose text is null take no part in training; with no labelled rows at
all nothing is identified. Repeated rows get equal results. Columns other than
doc_id, text and the label, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import cluster, kernel

SIZES = (3, 4)


@dataclass
class Filters:
    languages: list[str]
    #: Of more than 64 languages, a row of words for each cell.
    cells: np.ndarray
    hashes: int
    false_positive: np.ndarray = field(default_factory=lambda: np.zeros(0))


def _letters() -> np.ndarray:
    """Lower-case code point of letters, 32 for all else, in 16 bits, so that four pack into a word. Letters beyond the BMP take places of its private area, which no letter of the BMP has and no two letters of one script share."""
    low = kernel.lower_codes()
    return np.where(kernel.is_alpha(), np.where(low > 0xFFFF, 0xE000 + low % 0x1900, low), 32).astype(np.uint64)


_TABLE: list[np.ndarray] = []


def grams(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of all sizes of the texts of one sub-batch, and the row of each; n-grams of white space or of a row's edge are left out."""
    if not _TABLE:
        _TABLE.append(_letters())
    cp, starts = kernel.codepoints(arr)
    # a space before and after each text
    n = len(arr)
    code = np.full(len(cp) + 2 * n, 32, np.uint64)
    row = np.repeat(np.arange(n), np.diff(starts) + 2)
    code[np.arange(len(cp)) + 2 * row_of(starts) + 1] = _TABLE[0][cp]
    # runs of other characters count as one space
    solid = code != 32
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    keep[starts[:-1] + 2 * np.arange(n)] = True
    code, row = code[keep], row[keep]
    out, rows = [], []
    packed = code.copy()
    for size in range(2, max(SIZES) + 1):
        if len(code) < size:
            break
        packed = packed[: len(code) - size + 1] | (code[size - 1 :] << np.uint64(16 * (size - 1)))
        if size in SIZES:
            ok = row[: len(packed)] == row[size - 1 :]
            # an n-gram holds a letter in its middle
            ok &= code[1 : len(packed) + 1] != 32
            out.append(packed[ok] + np.uint64(size << 60) if size < 4 else packed[ok])
            rows.append(row[: len(packed)][ok])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(rows)


def row_of(starts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def _cells(keys: np.ndarray, size: int, hashes: int):
    h = kernel.mix64(keys)
    step = kernel.mix64(h + np.uint64(0x632BE59B)) | np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(hashes):
            yield ((h + np.uint64(k) * step) >> np.uint64(20)) & np.uint64(size - 1)


def _word(cells: np.ndarray, bit: int) -> np.ndarray:
    """Of every cell, the word that holds the bit."""
    return cells if cells.ndim == 1 else cells[:, bit // 64]


def fit(sample: list[tuple[str, str]], bits: int = 22, hashes: int = 3, least: int = 3, ratio: float = 0.25) -> Filters:
    """Filters of 2 ** bits cells from (language, text) rows. An n-gram belongs to a language where it occurs `least` times and at a rate of at least `ratio` of that in the language where it is most frequent."""
    by: dict[str, list[str]] = {}
    for language, text in sample:
        by.setdefault(language, []).append(text)
    languages = sorted(by)
    width = next((t for n, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32)) if len(languages) <= n), np.uint64)
    cells = np.zeros(1 << bits if len(languages) <= 64 else (1 << bits, -(-len(languages) // 64)), width)
    counted = []
    for language in languages:
        keys = np.concatenate([grams(sub)[0] for _, _, sub in kernel.sub_batches(pa.array(by[language], pa.large_string()))] or [np.zeros(0, np.uint64)])
        k, c = np.unique(keys, return_counts=True)
        counted.append((k, c / max(1, len(keys)), c >= least))
    if counted:
        every = np.unique(np.concatenate([k for k, _, _ in counted]))
        top = np.zeros(len(every))
        for k, rate, _ in counted:
            at = np.searchsorted(every, k)
            top[at] = np.maximum(top[at], rate)
        for bit, (k, rate, often) in enumerate(counted):
            chosen = k[often & (rate >= ratio * top[np.searchsorted(every, k)])]
            for at in _cells(chosen, len(cells), hashes):
                np.bitwise_or.at(_word(cells, bit), at.astype(np.int64), width(1 << bit % 64))
    filled = np.array([np.count_nonzero(_word(cells, b) & width(1 << b % 64)) / len(cells) for b in range(len(languages))])
    return Filters(languages, cells, hashes, filled**hashes)


def shares(arr: pa.Array, filters: Filters) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of each row, and of these, corrected for false positives, the share in each language."""
    n, m = len(arr), len(filters.languages)
    keys, rows = grams(arr)
    total = np.bincount(rows, minlength=n)[:n] if len(rows) else np.zeros(n, np.int64)
    if not m or not len(keys):
        return total, np.zeros((n, m))
    mask = None
    for at in _cells(keys, len(filters.cells), filters.hashes):
        mask = filters.cells[at] if mask is None else mask & filters.cells[at]
    counts = np.zeros((n, m))
    for bit in range(m):
        hit = (_word(mask, bit) >> mask.dtype.type(bit % 64)) & mask.dtype.type(1)
        counts[:, bit] = np.bincount(rows[hit.astype(bool)], minlength=n)[:n]
    fp = filters.false_positive
    with np.errstate(divide="ignore", invalid="ignore"):
        corrected = np.clip((counts - total[:, None] * fp) / np.maximum(1e-9, 1 - fp), 0, None)
        return total, np.nan_to_num(corrected / total[:, None])


def labelled_sample(docs: DataFrame, label: str = "lang", per_language: int = 400) -> list[tuple[str, str]]:
    """The training rows: of each label the `per_language` with the smallest hash of doc_id. The sample's size is bounded by these parameters and the number of labels."""
    order = Window.partitionBy("l").orderBy("h", "d")
    rows = docs.select(F.col(label).cast("string").alias("l"), F.xxhash64(F.col("doc_id")).alias("h"), F.col("doc_id").alias("d")).where("l is not null")
    chosen = cluster.few(rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language).select("d").distinct())
    texts = docs.select(F.col(label).cast("string").alias("l"), F.col("doc_id").alias("d"), F.col("text").cast("string").alias("t"))
    got = texts.where("l is not null and t is not null").join(chosen, "d", "left_semi").select("l", "t", "d").collect()
    return [(r[0], r[1]) for r in sorted(got, key=lambda r: (r[0], r[2] if r[2] is not None else -1, r[1]))]


def identify_udf(filters: Filters, least_share: float = 0.35):
    """Column function: text -> struct of lang_id, share, n_grams and keep."""
    ddl = "struct<lang_id:string,share:double,n_grams:bigint,keep:boolean>"

    def run(texts: pa.Array) -> pa.Array:
        best, share, total = [], [], []
        for _, _, sub in kernel.sub_batches(texts):
            t, s = shares(sub, filters)
            total.append(t)
            best.append(s.argmax(1) if s.shape[1] else np.zeros(len(t), np.int64))
            share.append(s.max(1) if s.shape[1] else np.zeros(len(t)))
        best, share, total = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (best, share, total))
        keep = (share >= least_share) & (total > 0)
        names = pa.array([filters.languages[b] if k else None for b, k in zip(best, keep, strict=True)], pa.string())
        return pa.StructArray.from_arrays([names, pa.array(share, pa.float64()), pa.array(total, pa.int64()), pa.array(keep, pa.bool_())], ["lang_id", "share", "n_grams", "keep"])

    return cluster.arrow_column(run, ddl)


def identify(docs: DataFrame, label: str = "lang", least_share: float = 0.35, **sample) -> DataFrame:
    """doc_id, lang_id, share, n_grams and keep, a row for each row of docs."""
    cluster.bounded_batches(docs.sparkSession)
    docs = cluster.spread(docs)
    filters = fit(labelled_sample(docs, label, **sample))
    return docs.select("doc_id", identify_udf(filters, least_share)(F.col("text").cast("string")).alias("m")).select("doc_id", "m.*")


def keep_identified(docs: DataFrame, label: str = "lang", least_share: float = 0.35, **sample) -> DataFrame:
    """The rows of docs in a language that the filters know, with the columns of docs."""
    cluster.bounded_batches(docs.sparkSession)
    docs = cluster.spread(docs)
    filters = fit(labelled_sample(docs, label, **sample))
    return docs.where(identify_udf(filters, least_share)(docs["text"].cast("string"))["keep"])
