"""The ten operators against brute force, and on the cases that their docstrings define."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, cluster, kernel, langid, lm, mixing, neardup, quality, sharding, topk, toxicity, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, texts, **extra):
    """A documents table; extra: other columns, whose names may clash with those the operators use inside."""
    df = spark.createDataFrame([(i if i >= 0 else None, t, lang, "src0", None) for i, t, lang in texts], DOCS)
    for c, v in extra.items():
        df = df.withColumn(c, F.lit(v))
    return df


CLASH = {"keep": "x", "m": 1, "p": 2, "bytes": 3, "shard": 4, "__row": "r", "s": "t", "node": 5, "i": 6, "t": 7, "k": 8, "score": 9}
ODD = [(1, None, "en"), (2, "", "en"), (3, "   \n\t ", None), (-1, "a row without an id, of some words", "en"), (4, "one", "en"), (5, "x " * 40_000, "en"), (6, "the same words twice", "en"), (6, "the same words twice", "en"), (7, "é" * 3000 + "퟿", "fr"), (8, "a\x00b 😀 ﷺ", "de")]


# --- kernel


def test_words_and_hashes_match_python():
    texts = ["a  bb\nc", "", " x ", "ünï 　 zz", "last"]
    arr = kernel.as_strings(pa.array(texts))
    cp, starts = kernel.codepoints(arr)
    a, b, row = kernel.words(cp, starts)
    got = defaultdict(list)
    for x, y, r in zip(a, b, row, strict=True):
        got[r].append("".join(map(chr, cp[x:y])))
    assert [got[i] for i in range(len(texts))] == [t.split() for t in texts]
    h = kernel.slice_hashes(kernel.char_hashes()[cp], a, b)
    words = [w for t in texts for w in t.split()]
    assert len(set(h.tolist())) == len(set(words))
    again = kernel.as_strings(pa.array(["zz c", "bb"]))
    cp2, starts2 = kernel.codepoints(again)
    a2, b2, _ = kernel.words(cp2, starts2)
    h2 = kernel.slice_hashes(kernel.char_hashes()[cp2], a2, b2)
    assert h2.tolist() == [int(h[words.index(w)]) for w in ("zz", "c", "bb")]


def test_sub_batches_cover_everything():
    texts = ["x" * n for n in (0, 10, 5000, 3, 0, 9000, 1)]
    parts = list(kernel.sub_batches(pa.array(texts), 4000))
    assert [p[0] for p in parts] == [0, *[p[1] for p in parts[:-1]]] and parts[-1][1] == len(texts)
    assert [t for *_, p in parts for t in p.to_pylist()] == texts


# --- 1


@pytest.mark.parametrize("blocks", [None, (32, 2)])
def test_top_k_is_exact(spark, blocks, monkeypatch):
    if blocks:  # many blocks: floors from a first pass
        monkeypatch.setattr(topk, "CORPUS_BLOCK", blocks[0])
        monkeypatch.setattr(topk, "MANY_BLOCKS", blocks[1])
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 24))
    x[40] = x[41] = x[42]  # ties
    rows = [(int(i), [float(v) for v in e], 0, "c") for i, e in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, rank string")
    got = defaultdict(dict)
    for r in topk.top_k(df, 7).collect():
        got[r.vec_id][r["rank"]] = r.neighbor_id
    for i in range(len(x)):
        s = [(-round(float(topk.exact_scores(x[j : j + 1], x[i])[0]), 12), j) for j in range(len(x)) if j != i]
        assert [got[i][k] for k in range(1, 8)] == [j for _, j in sorted(s)[:7]]


@pytest.mark.parametrize("seed", range(4))
def test_bit_slices_add_up(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(130, 9))
    index, q = topk.Index(x), rng.normal(size=9)
    slices, unit, zero, error = index.add(q)
    total = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(np.int64) << p for p, s in enumerate(slices))
    gap = x @ q - unit * total
    assert np.abs(gap - zero).max() <= error + 1e-9
    assert index.kth(slices, 5) == np.sort(total)[-5]
    best = np.argsort(-(x @ q))
    assert set(best[:5]) <= set(index.search(q, 5))
    assert set(best[:3]) <= set(index.search(q, 5, float((x @ q)[best[2]])))


def test_top_k_odd_rows(spark):
    schema = "vec_id bigint, embedding array<double>, label int"
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0
    nan = float("nan")
    inf = float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [0.5, 0.5], 0), (None, [1.0, 1.0], 0), (3, None, 0), (4, [1.0], 0), (5, [nan, 1.0], 0), (6, [None, 1.0], 0), (2, [0.5, 0.5], 0), (7, [0.0, 0.0], None), (8, [inf, 1.0], 0), (9, [], 0)]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, schema), 2).collect())
    assert got == sorted([(1, 2, 1), (1, 2, 2), (2, 1, 1), (2, 7, 2), (2, 1, 1), (2, 7, 2), (7, 1, 1), (7, 2, 2)])


def test_top_k_of_several_lengths_sizes_and_string_ids(spark):
    rng = np.random.default_rng(2)
    short, scale = rng.normal(size=(30, 4)), {0: 1.0, 1: 1e300, 2: 1e-300}
    for power, by in scale.items():
        rows = [(f"urn:uuid:{i:03}", (v * by).tolist()) for i, v in enumerate(short)] + [("urn:uuid:long", [by] * 9), ("urn:uuid:longer", [by] * 9)]
        df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
        got = {(r.vec_id, r["rank"]): r.neighbor_id for r in topk.top_k(df, 3, df.where("vec_id in ('urn:uuid:005', 'urn:uuid:long')")).collect()}
        want = [j for j in np.argsort(-(short @ short[5])) if j != 5][:3]
        assert got == {("urn:uuid:005", k + 1): f"urn:uuid:{j:03}" for k, j in enumerate(want)} | {("urn:uuid:long", 1): "urn:uuid:longer"}, power


# --- 2


def test_shards_are_contiguous_and_even(spark):
    r = random.Random(1)
    rows = [(i, "é" * r.randint(0, 50), "en") for i in r.sample(range(1000), 400)] + ODD
    got = sorted(((-1 if x.doc_id is None else x.doc_id, x.bytes, x.shard) for x in sharding.shards(docs_of(spark, rows, **CLASH), 7).collect()))
    total, start = sum(b for _, b, _ in got), 0
    assert len(got) == len(rows)
    for _, b, s in got:
        assert s == min(6, start * 7 // total)
        start += b
    assert sharding.shards(spark.createDataFrame([], DOCS)).count() == 0
    assert {x.shard for x in sharding.shards(docs_of(spark, [(1, None, "en"), (2, "", "en")])).collect()} == {0}


# --- 3


def test_revisits(spark):
    h = {"etag": '"1"', "content-length": "9", "server": "a"}
    rows = [
        (1, "http://A.example/x/?b=2&a=1&utm_source=q#f", 10, "response", h),
        (2, "https://www.a.example:443/x?a=1&b=2", 20, "revisit", {"etag": 'W/"1"', "content-length": "0", "date": "d"}),
        (3, "a.example/x?b=2&a=1", 10, "revisit", {"etag": '"1"'}),
        (4, "a.example/x?a=1&b=2", 30, "revisit", {"etag": '"2"'}),
        (5, "a.example/x?a=1&b=2", 31, "revisit", {}),
        (6, "a.example/x?a=1&b=2", 31, "revisit", None),
        (7, None, 5, "revisit", {}),
        (8, "http://a.example/x?a=1&b=2", 40, "response", {"last-modified": "m"}),
        (9, "http://a.example/x?a=1&b=2", 40, "response", {"last-modified": "n"}),
        (10, "http://a.example/x?a=1&b=2", 41, "revisit", {"last-modified": "n", "server": "b"}),
        (11, "http://a.example/x?a=1&b=2", None, "response", {"last-modified": "z"}),
        (12, "http://a.example/x?a=1&b=2", 50, None, {}),
    ]
    df = spark.createDataFrame(rows, "record_id bigint, url string, ts bigint, kind string, headers map<string,string>").withColumn("status", F.lit(1)).withColumn("stored", F.lit(2))
    got = {r.record_id: (r.response_id, r.status, r.headers) for r in warc.resolve_revisits(df).collect()}
    assert got == {
        2: (1, "resolved", 'content-length: 9\ndate: d\netag: W/"1"\nserver: a'),
        3: (None, "no_response", None),
        4: (1, "validator_mismatch", None),
        5: (1, "unvalidated", None),
        6: (1, "unvalidated", None),
        7: (None, "no_response", None),
        10: (9, "resolved", "last-modified: n\nserver: b"),
    }
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_revisits_of_a_hot_url_with_string_ids_and_ports(spark):
    """A third of all records are of one URL, over many ranges; ids are names."""
    r = random.Random(6)
    urls = ["http://hot.example/"] * 300 + [f"http://a.example/{r.randrange(40)}" for _ in range(500)] + ["http://b.example:443/x", "http://b.example:80/x", "https://b.example:443/x", "https://b.example:80/x", "b.example/x"] * 6
    rows = [(f"urn:uuid:{i:04}", u, r.randrange(200), r.choice(["response", "revisit"]), {"etag": str(r.randrange(2))}) for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "record_id string, url string, ts bigint, kind string, headers map<string,string>").repartition(4)
    key = lambda u: u.replace("http://b.example:80", "b.example").replace("https://b.example:443", "b.example").split("://")[-1].rstrip("/")
    want = {}
    for i, u, t, k, h in rows:
        if k == "revisit":
            earlier = [(t2, j, h2) for j, u2, t2, k2, h2 in rows if k2 == "response" and key(u2) == key(u) and t2 < t]
            best = max(earlier, key=lambda x: x[:2]) if earlier else None
            want[i] = (best and best[1], "no_response" if best is None else "resolved" if best[2] == h else "validator_mismatch")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert {x.record_id: (x.response_id, x.status) for x in warc.resolve_revisits(df).collect()} == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


# --- 4


def test_toxic_words_disguises_and_exceptions(spark):
    rows = [(1, "you 1d10t, go", "en"), (2, "such а lоser", "en"), (3, "the trash can is full", "en"), (4, "trashy idiotsx pathways", "en"), (5, "$tup1d", "en"), (6, "ｍｏｒｏｎ", "en"), (7, "Idiot$$$ and TRASH!!", "en"), (8, "clean words only", "en"), *[(100 + i, t, lg) for i, t, lg in ODD]]
    got = {r.doc_id: (r.n_words, r.hits, r.toxic) for r in toxicity.toxicity(docs_of(spark, rows, **CLASH)).collect()}
    assert {i for i, x in got.items() if x[2]} == {1, 2, 5, 6, 7}
    assert got[7][:2] == (4 - 1, 2) and got[101] == (0, 0, False)
    assert toxicity.toxicity(docs_of(spark, [])).count() == 0


def _brute_toxic(text, words, stems, exceptions):
    """Words, matches and score, place by place."""
    own = [c for c in text if not toxicity.ignored()[ord(c)]]
    own = [c for i, c in enumerate(own) if not (c.isspace() and i and own[i - 1].isspace())]
    folded = "".join(" " if c.isspace() else toxicity.fold(c) for c in own)
    edge = lambda i: not (0 <= i < len(own) and own[i].isalnum())
    at = lambda w: [i for i in range(len(folded)) if folded.startswith(toxicity.fold(w), i) and edge(i - 1)]
    free = [(i, i + len(p)) for p in exceptions for i in at(p) if edge(i + len(p))]
    best = {}
    for table, whole in ((words, True), (stems, False)):
        for w, weight in table.items():
            for i in at(w):
                if not whole or edge(i + len(w)):
                    best[i] = max(best.get(i, (0, 0)), (weight, i + len(w)))
    kept = [w for i, (w, end) in best.items() if not any(a <= i and end <= b for a, b in free)]
    n = len(text.split())
    return n, len(kept), 100 * sum(kept) / n if n else 0.0


def test_toxicity_matches_brute_force():
    words, stems, exceptions = {"bad": 1.0, "bad dog": 2.5, "idiot": 1.0}, {"scu": 0.5}, ("bad luck", "so bad", "scuba dive")
    auto = toxicity.automaton(words, stems, exceptions)
    r = random.Random(12)
    parts = ["bad", "BAD", "b@d", "bаd", "𝐛𝐚𝐝", "b\u200bad", "ba\u0301d", "dog", "luck", "so", "idiot", "1d1ot", "scum", "scuba", "dive", " ", "  ", "\n", "\t ", ".", "-", "x", "é", "\u00ad", "日"]
    texts = ["".join(r.choice(parts) + r.choice(["", " ", "  "]) for _ in range(r.randint(0, 25))) for _ in range(1500)] + ["", " "]
    n, hits, score = toxicity.score(kernel.as_strings(pa.array(texts)), auto)
    for k, t in enumerate(texts):
        want = _brute_toxic(t, words, stems, exceptions)
        assert (n[k], hits[k], pytest.approx(score[k])) == want, t


def test_toxicity_of_long_texts_hidden_letters_and_length(spark):
    rows = [(1, "trash can idiot " * 20_000, "en"), (2, "trash  \n can", "en"), (3, "an 𝗶𝗱𝗶𝗼𝘁 here", "en"), (4, "i\u200bdi\u2060ot", "en"), (5, "idiot " + "word " * 600, "en"), (6, "idiot " + "word " * 400, "en")]
    got = {x.doc_id: (x.hits, x.toxic) for x in toxicity.toxicity(docs_of(spark, rows)).collect()}
    assert got == {1: (20_000, True), 2: (0, False), 3: (1, True), 4: (1, True), 5: (1, False), 6: (1, True)}


def test_lexicon_is_learned_and_copies_do_not_count():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    clean = [(False, " ".join(word() for _ in range(40))) for _ in range(200)]
    bad = [(True, " ".join([*(word() for _ in range(20)), "zzork" + r.choice("aeiou") + word(), "vexxi", word()])) for _ in range(40)]
    copied = [(True, "all of these are copies of one single bad vexxi text qqqqword")] * 60
    words, stems = toxicity.learn(clean + bad + copied)
    assert "vexxi" in words and any("zzork".startswith(s) for s in stems) and "qqqqword" not in words
    assert not any(w in words or w[:5] in stems for _, t in clean for w in map(toxicity.fold, t.split()))


# --- 5


def _covered(text, n):
    w, seen = text.split(), set()
    hit = [False] * len(w)
    for i in range(len(w) - n + 1):
        g = tuple(w[i : i + n])
        if g in seen:
            hit[i : i + n] = [True] * n
        seen.add(g)
    total = sum(map(len, w))
    return sum(len(x) for x, h in zip(w, hit, strict=True) if h) / total if total else 0.0


def test_repetition_matches_brute_force(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice("ab cde fg é".split()) for _ in range(r.randint(0, 60))).replace("cde fg", "cde\nfg") for _ in range(300)] + ["line one\nline one\nother", "\n\n", "w " * 500]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    got = {x.doc_id: x for x in quality.repetition(docs_of(spark, rows)).collect()}
    for i, t in enumerate(texts):
        for n in quality.NGRAM_LIMITS:
            assert got[i][f"dup_{n}"] == pytest.approx(_covered(t, n)), (t, n)
        lines, seen, again = [x for x in t.split("\n") if x], set(), []
        for x in lines:
            again += [x] if x in seen else []
            seen.add(x)
        share = sum(map(len, again)) / sum(map(len, lines)) if lines else 0
        assert got[i].dup_line_chars == pytest.approx(share) and got[i].dup_lines == pytest.approx(len(again) / len(lines) if lines else 0) and got[i].n_words == len(t.split())
        assert got[i].keep == (share <= quality.LINE_CHAR_LIMIT and all(_covered(t, n) <= most for n, most in quality.NGRAM_LIMITS.items()))


def test_repetition_odd_rows(spark):
    df = docs_of(spark, ODD, **CLASH)
    got = {x.doc_id: x.keep for x in quality.repetition(df).collect()}
    assert got[1] and got[2] and got[3] and got[None] and not got[5]
    kept = quality.keep_unrepetitive(df)
    assert kept.columns == df.columns and kept.count() == len(ODD) - 1
    assert quality.repetition(df.limit(0)).count() == 0


# --- 6


def test_rates_meet_targets(spark):
    r = random.Random(4)
    vocab = [["aa", "ab", "ac", "ad"], ["ba", "bb", "bc", "bd"], ["ca", "cb", "cc", "cd"]]
    rows, labels = [], []
    for i in range(300):
        d = r.choice([0, 0, 0, 1, 2])
        rows.append((i, " ".join(r.choice(vocab[d if r.random() < 0.8 else r.randrange(3)]) for _ in range(r.randint(5, 60))), "en"))
        if i % 2:
            labels.append((i, 0 if d == 1 else 1, int(d == 2)))
    labels += [(None, 1, 0), (9999, 1, 0), (5, None, None)]
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    targets = {"clean": 0.6, "low": 0.25, "toxic": 0.15}
    out = mixing.mix(docs_of(spark, rows, **CLASH), lab, targets, 0.5).collect()
    total = sum(x.tokens for x in out)
    assert all(x.rate >= 0 for x in out) and len(out) == 300
    for d, share in targets.items():
        assert sum(x.rate * x.tokens * x[f"p_{d}"] for x in out) == pytest.approx(share * 0.5 * total, rel=0.01)
    right = sum(max(mixing.DOMAINS, key=lambda d: x[f"p_{d}"]) == mixing.DOMAINS[2 if t == 1 else 1 if q == 0 else 0] for x in out for i, q, t in labels if i == x.doc_id and q is not None)
    assert right > 0.85 * 150


@pytest.mark.parametrize("shares, sharp", [((0.05, 0.9, 0.05), 3.0), ((0.02, 0.97, 0.01), 6.0), ((0.3, 0.6, 0.1), 1.0)])
def test_rates_meet_targets_of_skewed_sources(spark, shares, sharp):
    rng = np.random.default_rng(3)
    d = rng.choice(3, 2000, p=shares)
    z = rng.normal(size=(2000, 3)) + sharp * np.eye(3)[d] + np.log(shares)
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    n = rng.integers(5, 400, 2000)
    posts = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n bigint, p array<double>")
    targets = np.array([mixing.TARGETS[x] for x in mixing.DOMAINS])
    rates = mixing.solve(posts, targets)
    got = posts.select("n", "p", mixing.rate_column(F.col("p"), rates).alias("r")).collect()
    mixed = sum(x.r * x.n * np.array(x.p) for x in got)
    assert min(x.r for x in got) >= 0
    assert np.abs(mixed - targets * mixing.BUDGET * n.sum()).max() <= 1.01 * mixing.TOLERANCE * mixing.BUDGET * n.sum()


def test_rates_are_the_closest_to_one(spark):
    """No small move that keeps the domains' totals and the signs brings the rates closer to 1."""
    rng = np.random.default_rng(8)
    p = rng.dirichlet((0.5, 0.3, 0.2), 300)
    n = rng.integers(1, 90, 300).astype(float)
    posts = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n bigint, p array<double>")
    r = mixing.solve(posts, np.array([0.2, 0.5, 0.3]), 0.7).of(p)
    cost = lambda x: float(n @ (x - 1) ** 2)
    sums, free = (n[:, None] * p).T, r > 1e-6
    assert (~free).any()
    for _ in range(200):
        move = np.where(free, rng.normal(size=300), np.abs(rng.normal(size=300)) * (rng.random(300) < 0.05))
        # keep the totals by moving the free rates only
        part = sums[:, free]
        move[free] -= part.T @ np.linalg.solve(part @ part.T, sums @ move)
        step = 1e-4 * min(1.0, float(r[free].min()) / np.abs(move).max())
        assert cost(r + step * move) >= cost(r) - 1e-9 * cost(r)


def test_targets_out_of_reach_are_reported(spark):
    p = [(10, [0.5, 0.4, 0.1]), (30, [0.6, 0.35, 0.05]), (0, [0.0, 0.0, 1.0])]  # no tokens of a row with as much as 0.2 of the last
    posts = spark.createDataFrame(p, "n bigint, p array<double>")
    with pytest.warns(UserWarning, match="no rates meet"):
        rates = mixing.solve(posts, np.array([0.5, 0.3, 0.2]))
    assert rates.gap > 0.05
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    with pytest.warns(UserWarning, match="no rates meet"):
        out = mixing.mix(docs_of(spark, [(1, "a b c", "en"), (2, "d e", "en")]), none).collect()
    assert all(x.gap == pytest.approx(0.86 - 1 / 3, abs=1e-3) for x in out)


def test_budget_holds_when_domains_have_no_tokens(spark):
    rng = np.random.default_rng(5)
    p = np.zeros((400, 3))
    p[:, 0], p[:, 1] = 1 - 1e-6, 1e-6
    n = rng.integers(1, 90, 400)
    posts = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n bigint, p array<double>")
    with pytest.warns(UserWarning, match="2 of the domains"):
        rates = mixing.solve(posts, np.array([0.86, 0.08, 0.06]), 0.6)
    assert abs((n * rates.of(p)).sum() / (0.6 * n.sum()) - 1) < 1e-3 and 0.13 < rates.gap < 0.15


def test_mixing_ids_of_any_type(spark):
    docs = docs_of(spark, [(i, f"word{i % 7} other text {i}", "en") for i in range(60)]).withColumn("doc_id", F.concat(F.lit("urn:uuid:"), F.col("doc_id").cast("string")))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("text").contains("word3")).cast("int").alias("toxic"), F.lit("z").alias("text"))
    with pytest.warns(UserWarning):
        assert mixing.mix(docs, labels).count() == 60
        kept = mixing.apply_mix(docs, labels)
    assert kept.columns == docs.columns and kept.join(docs, "doc_id", "left_anti").count() == 0


def test_mixing_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    df = docs_of(spark, ODD, **CLASH)
    out = mixing.mix(df, none).collect()
    assert len(out) == len(ODD) and all(x.p_clean == pytest.approx(1 / 3) for x in out) and {x.tokens for x in out if x.doc_id in (1, 2, 3)} == {0}
    kept = mixing.apply_mix(df, none)
    assert kept.columns == df.columns and kept.where("doc_id in (1, 2, 3)").count() == 0
    assert mixing.mix(df.limit(0), none).count() == 0 and mixing.apply_mix(df.limit(0), none).count() == 0


# --- 7


def _brute_score(text, corpus, smoothing=1.0):
    counts, total, vocabulary = Counter(), 0, set()
    for d in corpus:
        w = (d or "").split()
        total += len(w)
        vocabulary.update(w)
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                counts[tuple(w[i:j])] += 1
    w, log_p, context = text.split(), 0.0, 0
    for i in range(len(w)):
        n = 0
        while n < i and counts[tuple(w[i - n - 1 : i])]:
            n += 1
        p = (counts[(w[i],)] + smoothing) / (total + smoothing * (len(vocabulary) + 1))
        for k in range(1, n + 1):
            p = (counts[tuple(w[i - k : i + 1])] + smoothing * p) / (counts[tuple(w[i - k : i])] + smoothing)
        log_p += math.log(p)
        context += n
    return len(w), log_p, context / len(w) if w else None


@pytest.mark.parametrize("shard_words", [40, 10_000])
def test_lm_scores_match_brute_force(spark, shard_words):
    r = random.Random(6)
    corpus = [" ".join(r.choice("abcde") for _ in range(r.randint(0, 40))) for _ in range(40)] + [None, "", "a b c d e f g h i j k l m n o p"] * 2
    texts = [(i, " ".join(r.choice("abcdz") for _ in range(r.randint(0, 15)))) for i in range(25)] + [(90, corpus[3]), (91, "a b c d e f g h i j k l m n o p q"), (92, None), (None, "a b"), (90, "e e e")]
    df = spark.createDataFrame(texts, "item_id bigint, text string").withColumn("k", F.lit(0))
    got = sorted(((-1 if x.item_id is None else x.item_id, x.n_words, round(x.log_prob, 9), x.mean_context) for x in lm.score(df, docs_of(spark, [(i, t, "en") for i, t in enumerate(corpus)], **CLASH), shard_words=shard_words, pass_bytes=200).collect()), key=str)
    want = []
    for i, t in texts:
        n, p, c = _brute_score(t or "", corpus)
        want.append((-1 if i is None else i, n, round(p, 9), c))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("shard_words", [40, 10_000])
def test_every_document_is_scored_against_all_others(spark, shard_words):
    r = random.Random(16)
    corpus = [" ".join(r.choice("abcde") for _ in range(r.randint(0, 30))) for _ in range(25)] + [None, "", "q r s q r s"] + ["a b c d e f g h i j k l m n o p " * 6] * 2 + ["a b c d e f g h i j k l m n o p " * 3 + "z"]
    got = {x.doc_id: x for x in lm.score(docs_of(spark, [(i, t, "en") for i, t in enumerate(corpus)], **CLASH), id_column="doc_id", shard_words=shard_words, pass_bytes=200).collect()}
    for i, t in enumerate(corpus):
        n, p, c = _brute_score(t or "", corpus[:i] + corpus[i + 1 :])
        assert (got[i].n_words, got[i].mean_context) == (n, c) and got[i].log_prob == pytest.approx(p, abs=1e-8)


def test_a_long_context_with_another_end_has_a_finite_score(spark):
    text = " ".join(f"w{k}" for k in range(1500))
    got = lm.score(docs_of(spark, [(1, text + " x", "en"), (2, text + " y", "en")]), id_column="doc_id").first()
    assert got.mean_context == pytest.approx(1500 / 1501 * 1501 / 2, rel=1e-9) and -1500 < got.log_prob < -1500 * math.log(2)


def test_op7_scores_the_documents(spark):
    from plumbline.llm import queries

    sf = "/root/testdata/sf0.001"
    assert queries.op7_lm_scoring(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_lm_heavy_contexts_match_brute_force(spark):
    r = random.Random(26)
    corpus = [" ".join(r.choice("aaab") for _ in range(r.randint(0, 30))) for _ in range(12)] + ["z " * 20, "a a a", "b", None]
    got = {x.doc_id: x for x in lm.score(docs_of(spark, [(i, t, "en") for i, t in enumerate(corpus)]), id_column="doc_id", shard_words=12, pass_bytes=200).collect()}
    for i, t in enumerate(corpus):
        n, p, c = _brute_score(t or "", corpus[:i] + corpus[i + 1 :])
        assert (got[i].n_words, got[i].mean_context) == (n, c) and got[i].log_prob == pytest.approx(p, abs=1e-8)


def test_lm_sends_each_place_to_one_bucket(spark, monkeypatch):
    # the work grows as the words: with many buckets, each word is looked at in one
    dealt = []
    sums = lm._sums
    monkeypatch.setattr(lm, "_sums", lambda df, *more: dealt.append(df.agg(F.sum("n")).first()[0]) or sums(df, *more))
    lm.score(docs_of(spark, [(i, f"w{i % 7} x y w{i}", "en") for i in range(50)]), id_column="doc_id", shard_words=10).collect()
    assert dealt == [200]


def _walked(texts):
    """Lengths of contexts and scores at the end of every text, and how many places and words the walk reads for that."""
    ids = np.concatenate([np.concatenate(([0], t)) for t in texts] + [np.zeros(1)]).astype(np.uint32)
    last, looks, words = np.cumsum([len(t) + 1 for t in texts]) - 1, 0, 0

    def fetch(e, d, n):
        nonlocal looks, words
        looks, words = looks + len(e), words + len(e) * n
        return lm._windows(ids, last[e] - d, n)

    log_p = np.full(len(texts), -1.0)
    length = lm._walk(fetch, np.zeros(len(texts), np.int64), 0, np.arange(len(texts)), np.zeros(len(texts), np.int64), None, log_p, 1.0)
    return length, log_p, looks, words


@pytest.mark.parametrize("step", [1, -1])
def test_lm_looks_at_a_copy_a_few_times_however_many_others_leave_it(step):
    base = np.arange(1, 1001)
    lengths = np.arange(3, 903, 3)[::step]
    length, log_p, looks, words = _walked([np.append(2000 + n, base[-n:]) for n in lengths])
    assert (length == np.minimum(lengths, 897)).all()
    # all go on alike, so every context is followed by the one word each time
    for k in (0, 100):
        p = math.exp(-1)
        for d in range(1, lengths[k] + 1):
            others = int((lengths >= d).sum()) - 1
            p = (others + p) / (others + 1)
        assert log_p[k] == pytest.approx(math.log(p), abs=1e-12)
    assert looks < 30 * len(lengths) and words < 3 * lengths.sum()


def test_lm_reads_no_further_where_only_own_text_is_left():
    # places of one text that repeats a word, and the end of a short other text
    n = 3000
    ids = np.concatenate(([0], np.ones(n), [0], np.ones(5), [0])).astype(np.uint32)
    last, words = np.append(np.arange(1, n + 1), n + 6), 0

    def fetch(e, d, k):
        nonlocal words
        words += len(e) * k
        return lm._windows(ids, last[e] - d, k)

    text = np.append(np.zeros(n, np.int64), 1)
    length = lm._walk(fetch, np.zeros(n + 1, np.int64), 0, text, np.zeros(n + 1, np.int64), None, np.full(n + 1, -1.0), 1.0)
    assert (length == np.append(np.minimum(np.arange(1, n + 1), 5), 5)).all() and words < 100 * n


@pytest.mark.parametrize("shard_words", [60, 10_000])
def test_lm_scores_of_changed_copies_match_brute_force(spark, shard_words):
    r = random.Random(36)
    base = [r.choice("abcdefghijklmnopqrstuvw") for _ in range(50)]
    corpus = ["a " * 30, "a a"]
    for _ in range(10):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(50)] = r.choice("abcxyz")
        corpus.append(" ".join(w[r.choice([0, 0, 5, 20]) :] + (w[:30] if r.random() < 0.3 else [])))
    df = docs_of(spark, [(i, t, "en") for i, t in enumerate(corpus)])
    apart = {x.doc_id: x for x in lm.score(df, id_column="doc_id", shard_words=shard_words, pass_bytes=400).collect()}
    whole = {x.doc_id: x for x in lm.score(df.where("doc_id % 3 = 0"), df, id_column="doc_id", shard_words=shard_words, pass_bytes=400).collect()}
    assert len(apart) == len(corpus) and set(whole) == {i for i in apart if i % 3 == 0}
    for got, others in ((apart, lambda i: corpus[:i] + corpus[i + 1 :]), (whole, lambda i: corpus)):
        for i, x in got.items():
            n, p, c = _brute_score(corpus[i], others(i))
            assert (x.n_words, x.mean_context) == (n, c) and x.log_prob == pytest.approx(p, abs=1e-8)


def test_lm_empty(spark):
    texts = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    none = docs_of(spark, [])
    assert lm.score(texts, none).first().log_prob == pytest.approx(0.0)
    assert lm.score(texts.limit(0), none).count() == 0


def test_suffix_array_order():
    r = np.random.default_rng(1)
    per = np.array([0, 30, 1, 50, 30])
    words = r.integers(0, 3, per.sum()).astype(np.uint64)
    s = lm.Shard(words, per, 200)
    suffix = [tuple(s.text[i:]) for i in s.order]
    assert suffix == sorted(suffix)


# --- 8


def _copies(r, n_groups=30):
    vocab = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    rows, group = [], {}
    for g in range(n_groups):
        base = [r.choice(vocab) for _ in range(r.randint(40, 300))]
        for _ in range(r.choice([1, 2, 3, 40])):
            w = list(base)
            for _ in range(len(w) // 50):
                w[r.randrange(len(w))] = r.choice(vocab)
            group[len(rows)] = g
            rows.append((len(rows), " ".join(w), "en"))
    return rows, group


def test_near_duplicates_against_brute_force(spark):
    rows, group = _copies(random.Random(8))
    r = random.Random(9)
    shared = " ".join("p%d" % k for k in range(60))  # a passage of clean, different documents
    for _ in range(30):
        rows.append((len(rows), shared + " " + " ".join("w%d" % r.randrange(10**6) for _ in range(120)), "en"))
    got = {x.doc_id: x.duplicate_of for x in neardup.duplicates(docs_of(spark, rows, **CLASH)).collect()}
    sig, _ = neardup.signatures(kernel.as_strings(pa.array([t for _, t, _ in rows])))
    n = len(rows)
    near = [(i, j) for i in range(n) for j in range(i) if int(np.bitwise_count(sig[i] ^ sig[j]).sum()) <= neardup.RADIUS]
    root = lambda i: got.get(i, i)
    found = sum(root(i) == root(j) for i, j in near)
    assert found >= 0.9 * len(near)
    for i, d in got.items():
        assert d < i and group.get(i) == group.get(d) and i in group
    first = {}
    for i, g in group.items():
        first.setdefault(g, i)
    assert sum(i in got for i, g in group.items() if first[g] != i) >= 0.9 * sum(first[g] != i for i, g in group.items())


def test_forest_recall_at_many_documents():
    """Pairs at the radius among random signatures: the forest's recall meets its target."""
    rng = np.random.default_rng(2)
    depth, tries = neardup.plan(200_000)
    perms = neardup.permutations(tries)
    hits, n = 0, 2000
    for _ in range(n):
        flip = rng.choice(neardup.BITS, neardup.RADIUS, replace=False)
        hits += any(not np.isin(p[:depth], flip).any() for p in perms)
    assert hits / n >= neardup.RECALL - 3 * math.sqrt(0.09 / n)


@pytest.mark.parametrize("n", [1000, 200_000, 2_000_000, 8_000_000, 50_000_000])
def test_plan_meets_its_recall(n):
    """The exact chance that a pair at the radius shares a node of any trie."""
    depth, tries = neardup.plan(n)
    p = math.comb(neardup.BITS - neardup.RADIUS, depth) / math.comb(neardup.BITS, depth)
    assert 1 - (1 - p) ** tries >= neardup.RECALL


def test_near_duplicates_odd_rows(spark):
    df = docs_of(spark, ODD + [(20, "the same words twice", "en"), (21, "ONE", "en")], **CLASH)
    got = {x.doc_id: x.duplicate_of for x in neardup.duplicates(df).collect()}
    assert got == {20: 6, 21: 4}
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(-1 if x.doc_id is None else x.doc_id for x in kept.collect()) == [-1, 1, 2, 3, 4, 5, 6, 7, 8]
    assert neardup.duplicates(df.limit(0)).count() == 0 and neardup.keep_one(df.limit(0)).count() == 0


def test_crowded_nodes_are_cut_without_losing_links(spark):
    rng = np.random.default_rng(4)

    def near(base, n, flips):
        out = np.repeat(base[None], n, 0)
        for x in out:
            x[rng.choice(neardup.BITS, rng.integers(0, flips), replace=False)] ^= 1
        return out

    base = rng.integers(0, 2, neardup.BITS).astype(np.uint8)
    bits = np.concatenate([near(base, 120, 12), near(near(base, 1, 100)[0], 60, 40), near(base, 60, 110), rng.integers(0, 2, (160, neardup.BITS)).astype(np.uint8)])
    bits = np.unique(bits, axis=0)
    rows = [(i, bytes(np.packbits(b, bitorder="little"))) for i, b in enumerate(bits)]
    sigs = cluster.written(spark.createDataFrame(rows, "i bigint, s binary"))
    classes = lambda dense: {x.x: x.root for x in neardup.components_of(neardup.edges(sigs, dense=dense)).collect()}
    whole = classes(10**6)
    assert whole and classes(24) == whole


def test_near_duplicates_of_string_and_repeated_ids(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [("urn:b", text(1)), ("urn:a", text(1)), ("urn:c", text(2)), ("urn:c", text(3)), ("urn:c", text(1)), ("urn:d", text(3) + " end"), ("urn:d", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted(tuple(x) for x in neardup.duplicates(df).collect()) == [("urn:b", "urn:a"), ("urn:c", "urn:a"), ("urn:d", "urn:c")]
    assert sorted((x.doc_id, x.text or "") for x in neardup.keep_one(df).collect()) == sorted([("urn:a", text(1)), ("urn:c", text(2)), ("urn:c", text(3)), ("urn:d", "")])


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1100)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {x.node: x.root for x in cluster.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


# --- 9


def _languages(r):
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["ße", "scho", "ung", "ter"], "cc": ["éau", "oi", "que", "ment"]}
    return [(i, " ".join("".join(r.choice(syllables[lg]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 80))), lg) for i, lg in enumerate(r.choices(list(syllables), k=300))]


def test_language_accuracy_and_rejects(spark):
    rows = _languages(random.Random(7))
    strange = [(1000, "1234 5678 !!! ###", "aa"), (1001, "привет как дела хорошо спасибо", "bb"), (1002, "kalomi tulomi ßescho", None)]
    got = {x.doc_id: x for x in langid.identify(docs_of(spark, rows + strange + [(2000 + i, t, None) for i, t, _ in ODD], **CLASH), per_language=60).collect()}
    assert sum(got[i].lang_id == lg for i, _, lg in rows) >= 0.97 * len(rows)
    assert not got[1000].keep and not got[1001].keep and got[1002].lang_id == "aa" and got[2001].lang_id is None
    assert got[1000].lang_id is None
    assert langid.identify(docs_of(spark, [])).count() == 0
    unlabelled = docs_of(spark, [(1, "kalo", None)])
    assert langid.identify(unlabelled).first().keep is False and langid.keep_identified(unlabelled).count() == 0


def test_shares_match_sets_of_n_grams():
    """The filters' corrected shares against membership in exact sets."""
    r = random.Random(17)
    sample = [(lg, t) for _, t, lg in _languages(r)]
    filters = langid.fit(sample)
    counts = {lg: Counter() for lg in filters.languages}
    for lg, t in sample:
        counts[lg].update(langid.grams(kernel.as_strings(pa.array([t])))[0].tolist())
    rate = {lg: {k: c / sum(own.values()) for k, c in own.items()} for lg, own in counts.items()}
    own = {lg: {k for k, c in counts[lg].items() if c >= 3 and rate[lg][k] >= 0.25 * max(x.get(k, 0) for x in rate.values())} for lg in counts}
    texts = [t + " " + u for (_, t), (_, u) in zip(sample, r.sample(sample, len(sample)), strict=True)]
    total, shares = langid.shares(kernel.as_strings(pa.array(texts)), filters)
    for k, t in enumerate(texts):
        keys = langid.grams(kernel.as_strings(pa.array([t])))[0].tolist()
        assert total[k] == len(keys)
        for j, lg in enumerate(filters.languages):
            assert abs(shares[k, j] - sum(x in own[lg] for x in keys) / len(keys)) < 0.01


def test_letters_beyond_the_first_plane_are_told_apart():
    gothic, bmp = "𐌰𐌱𐌲 𐌳𐌴𐌵", "".join(chr(ord(c) & 0xFFFF) for c in "𐌰𐌱𐌲") + " x"
    keys = langid.grams(kernel.as_strings(pa.array([gothic])))[0].tolist()
    assert len(set(keys)) == len(keys) > 3 and not set(keys) & set(langid.grams(kernel.as_strings(pa.array([bmp])))[0].tolist())


def test_more_languages_than_a_word_has_bits(spark):
    r = random.Random(12)
    syllables = {f"l{k:03d}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(5)] for k in range(140)}
    rows = [(i, " ".join("".join(r.choice(syllables[lg]) for _ in range(r.randint(1, 3))) for _ in range(40)), lg) for i, lg in enumerate(list(syllables) * 4)]
    df = docs_of(spark, rows)
    got = {x.doc_id: x.lang_id for x in langid.identify(df).collect()}
    assert sum(got[i] == lg for i, _, lg in rows) >= 0.97 * len(rows)
    assert langid.keep_identified(df).count() == sum(x is not None for x in got.values())


def test_filters_hold_what_was_put_in():
    sample = [(lg, t) for _, t, lg in _languages(random.Random(1))]
    f = langid.fit(sample, bits=14, least=1, ratio=0.0)
    for b, lg in enumerate(f.languages):
        keys = np.concatenate([langid.grams(s)[0] for _, _, s in kernel.sub_batches(pa.array([t for x, t in sample if x == lg]))])
        mask = None
        for at in langid._cells(keys, len(f.cells), f.hashes):
            mask = f.cells[at] if mask is None else mask & f.cells[at]
        assert (mask >> b & 1).all()
    rng = np.random.default_rng(3)
    mask = None
    for at in langid._cells(rng.integers(0, 2**62, 200_000).astype(np.uint64), len(f.cells), f.hashes):
        mask = f.cells[at] if mask is None else mask & f.cells[at]
    for b in range(len(f.languages)):
        assert (mask >> b & 1).mean() == pytest.approx(f.false_positive[b], abs=0.005)


def test_grams_match_python():
    texts = ["Ab, c", "", "x9y zz", "É"]
    keys, rows = langid.grams(kernel.as_strings(pa.array(texts)))
    want = []
    for i, t in enumerate(texts):
        s = "".join(c if c != " " or j == 0 or d[j - 1] != " " else "" for d in [" " + "".join(x.lower() if x.isalpha() else " " for x in t) + " "] for j, c in enumerate(d))
        want += [(i, s[k : k + n]) for n in langid.SIZES for k in range(len(s) - n + 1) if s[k + 1] != " "]
    assert Counter(rows.tolist()) == Counter(i for i, _ in want) and len(set(keys.tolist())) == len({g for _, g in want})


# --- 10


def test_bpe_matches_reference_tokenizer_and_round_trips(spark):
    import tiktoken

    file = bpe.read_ranks(bpe.VOCABULARY)
    enc = bpe.encoder(file)
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    ref = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=enc.ranks, special_tokens={})
    r = random.Random(5)
    signs = "aZ é1٣ \n\t 　'’srtmdvel.,!?$日本😀\x1c\x85"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(2000)] + ["", "'s", "a'll b", "x" * 5000, "!" * 3000, " " * 500, "ab " * 20_000, "'''s", " 's", "<|endoftext|>", "Hello's we're they'll I'd"]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(5000, None, "en"), (5001, texts[3], "en")]
    df = docs_of(spark, rows, **CLASH)
    out = bpe.encode(df)
    got = {x.doc_id: x for x in out.collect()}
    for i, t in enumerate(texts):
        assert got[i].tokens == ref.encode_ordinary(t), t
        assert got[i].round_trip and got[i].n_tokens == len(got[i].tokens)
        data = t.encode()
        for k, (tok, at) in enumerate(zip(got[i].tokens, got[i].offsets, strict=True)):
            assert k > 300 or data.startswith(enc.token_bytes[tok], at)
    assert got[5000].tokens is None and got[5000].n_tokens is None and got[5001].tokens == got[3].tokens
    back = {x.doc_id: x.text for x in bpe.decode(out).collect()}
    assert all(back[i] == t for i, t in enumerate(texts)) and back[5000] is None
    assert bpe.encode(df.limit(0)).count() == 0


def test_scan_matches_sequential_automaton():
    symbols, compose, apply = bpe.monoid()
    width = int(len(compose) ** 0.5)
    rng = np.random.default_rng(0)
    e = symbols[rng.integers(0, 16, 5000)]
    state, want = bpe.DONE, []
    for x in e:
        want.append(state)
        state = int(apply[int(x) * 8 + state])
    assert bpe.scan(e, 16).tolist() == want
    for a, b, c in rng.integers(0, width, (200, 3)):
        assert compose[int(compose[a * width + b]) * width + c] == compose[a * width + int(compose[b * width + c])]
