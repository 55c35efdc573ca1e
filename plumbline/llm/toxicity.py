"""Operator 4, toxicity by a weighted lexicon.

Texts are folded code point by code point with one table: case, accents-free
look-alikes from other alphabets, full-width and mathematical forms and the digits and signs used in place of letters.
Characters that show nothing (format characters, combining marks) are left out, and runs of white space count as one space.
Word edges are judged on the original characters. One
Aho-Corasick automaton holds the lexicon, whose entries were folded alike, and the
exception phrases; it runs once over a sub-batch of joined texts. A match counts
when it begins a word and, unless it is a stem, ends one, and lies in no exception
phrase. The score is the weight of the matches for each hundred words.

The lexicon is a list of built-in words and, if a labels table is given, words
and stems learned from a sample of labelled documents of at most `per_class` toxic and
twice as many other ones: those with enough distinct contexts in the toxic sample and a high log-odds.
Its size is bounded by the sample, never by the corpus.

Defined cases: a null, empty or wordless text scores 0 and isn't toxic. Repeated
rows score alike. Of matches that begin at one place the heaviest counts. Labels that are null, or of documents that are not there, are passed over; without
labels the built-in words alone are used. Columns other than doc_id, text and toxic aren't read.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import cluster, kernel

#: word -> weight
BUILT_IN = {w: 1.0 for w in ("idiot", "moron", "stupid", "pathetic", "worthless", "disgusting", "scum", "trash", "loser", "clown")}
#: phrases in which a word of the lexicon is harmless
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash collection", "clown fish", "circus clown", "sore loser rule", "pond scum", "soap scum")
#: weight for each hundred words from which a text is toxic: a word of weight 1 in 500 words
LEAST_SCORE = 0.2

_LOOKALIKES = {
    "a": "4@а@αΑАɑ", "b": "8ЬвВΒβ", "c": "сСϲ(", "d": "ԁ", "e": "3еЕεΕ€", "g": "9ɡ", "h": "НһΗ", "i": "1!|lіІιΙӏ¡ł", "j": "јЈ", "k": "кКκΚ", "m": "мМΜ",
    "n": "пΝη", "o": "0оОοΟσ", "p": "рРρΡ", "q": "ԛ", "s": "5$ѕЅ§", "t": "7тТτΤ+", "u": "υμц", "v": "νѵ", "w": "ԝωш", "x": "хХχΧ", "y": "уУγΥ", "z": "2ΖζѮ",
}
_JOIN = 0x1F


@cache
def fold_table() -> np.ndarray:
    """Code point -> folded code point. l, 1, i and the like become one letter, also in the lexicon."""
    out = np.arange(kernel.N_CODES, dtype=np.uint32)
    # letters of the first two planes; beyond them nothing looks like one
    for c in range(0x20, 0x20000):
        d = unicodedata.normalize("NFKD", chr(c))
        base = d[0].lower()
        # accents fall only within Latin, where they disguise; other letters keep theirs
        out[c] = ord(base) if len(base) == 1 and (len(d) > 1 and base.isascii() and base.isalpha() and not _native(c) or len(d) == 1) else ord(chr(c).lower()[0])
    for letter, signs in _LOOKALIKES.items():
        for s in signs:
            out[ord(s)] = ord(letter)
    out[ord("I")] = out[ord("L")] = out[ord("l")] = ord("i")
    out[_JOIN] = 32
    return out


@cache
def ignored() -> np.ndarray:
    """Code points that show nothing of their own and part no word: format characters and combining marks."""
    out = np.zeros(kernel.N_CODES, bool)
    for c in (*range(0x20000), *range(0xE0000, 0xE0200)):
        out[c] = unicodedata.category(chr(c)) in ("Cf", "Mn", "Me")
    return out


def _native(c: int) -> bool:
    """Accented letters of Latin-1 and Latin Extended-A are spelling, not disguise."""
    return 0xC0 <= c < 0x180


def fold(text: str) -> str:
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return fold_table()[cp].tobytes().decode("utf-32-le")


def automaton(words: dict[str, float], stems: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS) -> ahocorasick.Automaton:
    entries: dict[str, list] = defaultdict(lambda: [0.0, 0.0, False])
    for kind, table in enumerate((words, stems)):
        for w, weight in table.items():
            entries[fold(w)][kind] = max(entries[fold(w)][kind], weight)
    for phrase in exceptions:
        entries[fold(phrase)][2] = True
    out = ahocorasick.Automaton()
    for w, e in entries.items():
        out.add_word(w, (len(w), *e))
    if entries:
        out.make_automaton()
    return out


def score(arr: pa.Array, auto: ahocorasick.Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, counted matches and score of each row of a sub-batch."""
    n = len(arr)
    cp, starts = kernel.codepoints(arr)
    a, _, row = kernel.words(cp, starts)
    total = np.bincount(row, minlength=n) if len(a) else np.zeros(n, np.int64)
    hits, weight = np.zeros(n, np.int64), np.zeros(n)
    if len(auto) and len(cp):
        # without what is not seen, white space as one space, and a separator, no letter of any entry, after each text
        own = np.repeat(np.arange(n), np.diff(starts))
        space = kernel.is_space()[cp]
        at = np.flatnonzero(~ignored()[cp])
        again = np.zeros(len(at), bool)
        again[1:] = space[at[1:]] & space[at[:-1]] & (own[at[1:]] == own[at[:-1]])
        at = at[~again]
        code = np.where(space[at], np.uint32(32), fold_table()[cp[at]])
        place = np.arange(len(at)) + own[at]
        joined = np.full(len(at) + n, _JOIN, np.uint32)
        joined[place] = code
        alnum = np.zeros(len(joined) + 1, bool)
        alnum[place] = kernel.is_alnum()[cp[at]]
        bounds = np.concatenate(([0], np.cumsum(np.bincount(own[at], minlength=n) + 1)))
        found, free = [], []
        for end, (size, word, stem, harmless) in auto.iter(joined.tobytes().decode("utf-32-le", "replace")):
            begin = end - size + 1
            if begin and alnum[begin - 1]:
                continue
            whole = not alnum[end + 1]
            if harmless and whole:
                free.append((begin, end))
            w = max(word if whole else 0.0, stem)
            if w:
                found.append((begin, end, w))
        if found:
            # of the matches that begin a word only the heaviest counts
            best: dict[int, tuple[int, float]] = {}
            for begin, end, w in found:
                if w > best.get(begin, (0, 0.0))[1]:
                    best[begin] = (end, w)
            begin = np.fromiter(best, np.int64, len(best))
            end, w = (np.array([x[k] for x in best.values()]) for k in (0, 1))
            # of the phrases that begin no later, how far the farthest reaches
            phrases = np.array(sorted(free), np.int64).reshape(-1, 2)
            reach = np.concatenate(([-1], np.maximum.accumulate(phrases[:, 1])))
            bare = reach[np.searchsorted(phrases[:, 0], begin, side="right")] < end
            r = np.searchsorted(bounds, begin[bare], side="right") - 1
            hits = np.bincount(r, minlength=n)
            weight = np.bincount(r, w[bare], minlength=n)
    with np.errstate(divide="ignore", invalid="ignore"):
        return total, hits, np.nan_to_num(100 * weight / total)


def learn(sample: list[tuple[bool, str]], least_contexts: int = 5, least_odds: float = 4.0, least_share: float = 0.01, stem_sizes: tuple[int, ...] = (5, 4), least_forms: int = 4) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems, folded, of the toxic texts: those in at least `least_contexts` contexts (word before and after) in `least_share` of these texts and with log-odds of at least `least_odds`. A stem needs `least_forms` words beginning with it, of which no more than a fiftieth as many texts of the other class have one. Toxic texts that mostly repeat earlier ones are passed over, so that copies don't make their words look toxic. A word that a learned stem covers is left out."""
    contexts: dict[str, set] = defaultdict(set)
    forms: dict[str, set] = defaultdict(set)
    docs, n, known = (Counter(), Counter()), [0, 0], set()
    for toxic, text in sample:
        w = ["", *("".join(f if o.isalnum() else " " for f, o in zip(fold(text), text, strict=True)).split()), ""]
        three = [hash((w[k - 1], w[k], w[k + 1])) for k in range(1, len(w) - 1)]
        if toxic and sum(x in known for x in three) > 0.4 * len(three):
            continue
        n[toxic] += 1
        if toxic:
            known.update(three)
            for k in range(1, len(w) - 1):
                for x in _keys(w[k], stem_sizes):
                    contexts[x].add(three[k - 1])
                    forms[x].add(w[k])
        docs[toxic].update({x for y in set(w) for x in _keys(y, stem_sizes)})
    found = {}
    for key, own in contexts.items():
        if len(own) >= least_contexts and docs[True][key] >= max(least_contexts, least_share * n[True]) and (key[-1] != "*" or len(forms[key]) >= least_forms) and docs[False][key] * 50 <= docs[True][key]:
            odds = math.log((docs[True][key] + 0.5) / (n[True] + 1)) - math.log((docs[False][key] + 0.5) / (n[False] + 1))
            if odds >= least_odds:
                found[key] = round(odds / 4, 4)
    stems = {k[:-1]: v for k, v in found.items() if k[-1] == "*"}
    stems = {k: v for k, v in stems.items() if not any(k != o and k.startswith(o) for o in stems)}
    words = {k: v for k, v in found.items() if k[-1] != "*" and not any(k.startswith(s) for s in stems)}
    return words, stems


def _keys(word: str, stem_sizes: tuple[int, ...]) -> list[str]:
    return ([word] if len(word) >= 3 else []) + [word[:s] + "*" for s in stem_sizes if len(word) > s]


def lexicon(docs: DataFrame | None = None, labels: DataFrame | None = None, per_class: int = 2000) -> tuple[dict[str, float], dict[str, float]]:
    """The built-in words, and those learned if docs and labels are given."""
    if docs is None or labels is None:
        return dict(BUILT_IN), {}
    own = labels.select(F.col("doc_id").alias("i"), (F.col("toxic").cast("int") == 1).alias("x")).where("i is not null and x is not null").distinct()
    order = Window.partitionBy("x").orderBy(F.xxhash64("i"), "i")
    chosen = cluster.few(own.withColumn("k", F.row_number().over(order)).where(F.col("k") <= 2 * per_class).where(~F.col("x") | (F.col("k") <= per_class)).drop("k"))
    rows = docs.select(F.col("doc_id").alias("i"), F.col("text").cast("string").alias("t")).where("t is not null").join(chosen, "i").select("x", "i", "t").collect()
    words, stems = learn([(r[0], r[2]) for r in sorted(rows)])
    return {**words, **BUILT_IN}, stems


def score_udf(words: dict[str, float], stems: dict[str, float], least_score: float = LEAST_SCORE, exceptions: tuple[str, ...] = EXCEPTIONS):
    """Column function: text -> struct of n_words, hits, score and toxic."""
    held: list[ahocorasick.Automaton] = []

    def run(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(automaton(words, stems, exceptions))
        parts = [score(sub, held[0]) for _, _, sub in kernel.sub_batches(texts)]
        total, hits, s = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(3))
        return pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(hits, pa.int64()), pa.array(s, pa.float64()), pa.array((s >= least_score) & (hits > 0), pa.bool_())], ["n_words", "hits", "score", "toxic"])

    return cluster.arrow_column(run, "struct<n_words:bigint,hits:bigint,score:double,toxic:boolean>")


def toxicity(docs: DataFrame, labels: DataFrame | None = None, least_score: float = LEAST_SCORE, **sample) -> DataFrame:
    """doc_id, n_words, hits, score and toxic, a row for each row of docs."""
    cluster.bounded_batches(docs.sparkSession)
    docs = cluster.spread(docs)
    words, stems = lexicon(docs, labels, **sample)
    return docs.select("doc_id", score_udf(words, stems, least_score)(F.col("text").cast("string")).alias("m")).select("doc_id", "m.*")


def toxic_documents(docs: DataFrame, labels: DataFrame | None = None, **options) -> DataFrame:
    """The rows of `toxicity` that are toxic."""
    return toxicity(docs, labels, **options).where("toxic").drop("toxic")
