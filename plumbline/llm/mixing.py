"""Operator 6, mixing sources to target weights with soft membership.

A softmax regression on hashed words, fitted to labelled documents, gives each document its
posterior over the domains. Document rates r >= 0 are then sought for which the expected
tokens of domain k, the sum of r * tokens * posterior, match that domain's target, and of these
the rates closest to 1, squares weighed by tokens. They are max(0, 1 - posterior . price) for one price a domain,
found by Newton's method on the dual problem: a step needs from the cluster only sums by
domain and pair of domains, for several step lengths at once, and rates are never stored or joined.

Steps go on until every domain is within TOLERANCE. Targets that no rates can meet are
told by a certificate (prices that no document is paid for, though the targets would be); the rates then minimise
the squared errors, each scaled by its domain's size, to within 1 %, the column `gap` holds the largest error left as a share
of the mixed tokens, and a warning says so. Where neither is reached, an error is raised.

A domain that has less than LEAST_MASS of all expected tokens, as one without labels, can't be mixed in: its target is
dropped with a warning and the others keep their proportions and share the whole budget; `gap` is held against the targets as given.

Training takes at most `per_domain` labelled rows of each domain. Totals and rates cover all rows.

Defined cases: a null or empty text has 0 tokens and gets the posterior of the regression's intercepts; it doesn't
count towards totals. Rows with labels that are null, or of no document, are not trained on. With no labelled rows
the posterior is uniform. An empty table gives an empty result. Repeated rows count
each. Ids may be of any type. The fraction of a rate is decided by a hash of doc_id and text, so rows equal in both
are kept or left out together. Only doc_id, text, quality and toxic are read; columns with other names are passed through.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import cluster, kernel

DOMAINS = ("clean", "low", "toxic")
#: Shares of the mixed tokens.
TARGETS = {"clean": 0.86, "low": 0.08, "toxic": 0.06}
#: Mixed tokens as a share of all.
BUDGET = 0.6
BUCKETS = 4096
#: Largest error of a domain, as a share of the mixed tokens.
TOLERANCE = 1e-4
#: Share of all expected tokens below which a domain takes no part.
LEAST_MASS = 1e-4


@dataclass
class Classifier:
    weights: np.ndarray  # BUCKETS x domains
    bias: np.ndarray


def _words(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and row of every word of a sub-batch, and words by row."""
    cp, starts = kernel.codepoints(arr)
    a, b, row = kernel.words(cp, starts)
    h = kernel.slice_hashes(kernel.char_hashes()[cp], a, b)
    per = np.bincount(row, minlength=len(arr)) if len(row) else np.zeros(len(arr), np.int64)
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64), row, per


def fit(sample: list[tuple[int, str]], shares: np.ndarray | None = None, n_domains: int = len(DOMAINS), steps: int = 250, decay: float = 1e-4) -> Classifier:
    """Softmax regression by Adam on mean word indicators, square-rooted, of (domain, text) rows, each domain weighing the same; the intercepts are then moved to the domains' shares, if given."""
    model = Classifier(np.zeros((BUCKETS, n_domains)), np.zeros(n_domains))
    if not sample:
        return model
    y = np.array([d for d, _ in sample])
    x = np.zeros((len(sample), BUCKETS), np.float32)
    at = 0
    for _, _, sub in kernel.sub_batches(pa.array([t for _, t in sample], pa.large_string())):
        bucket, row, _ = _words(sub)
        np.add.at(x, (row + at, bucket), 1)
        at += len(sub)
    x = np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1))
    share = np.bincount(y, minlength=n_domains)
    row_weight = (1 / (share[y] * np.count_nonzero(share))).astype(np.float32)[:, None]
    target = np.eye(n_domains, dtype=np.float32)[y]
    w = [np.zeros((BUCKETS, n_domains), np.float32), np.zeros(n_domains, np.float32)]
    first, second = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
    for step in range(1, steps + 1):
        z = x @ w[0] + w[1]
        p = np.exp(z - z.max(1, keepdims=True))
        e = (p / p.sum(1, keepdims=True) - target) * row_weight
        for k, g in enumerate((x.T @ e + decay * w[0], e.sum(0))):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            w[k] = w[k] - 0.1 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    bias = w[1].astype(np.float64)
    if shares is not None and shares.sum():
        bias = bias + np.log(np.maximum(shares / shares.sum(), 1e-6))
    return Classifier(w[0].astype(np.float64), bias)


def posteriors(arr: pa.Array, model: Classifier) -> tuple[np.ndarray, np.ndarray]:
    """Words and domain posteriors of the rows of a sub-batch."""
    n, m = len(arr), len(model.bias)
    bucket, row, per = _words(arr)
    z = np.tile(model.bias, (n, 1))
    if len(row):
        # each distinct (row, bucket) adds the root of its share of the row's words
        key, count = np.unique(row * BUCKETS + bucket, return_counts=True)
        r, b = key // BUCKETS, key % BUCKETS
        value = np.sqrt(count / per[r])
        for k in range(m):
            z[:, k] += np.bincount(r, weights=value * model.weights[b, k], minlength=n)
    p = np.exp(z - z.max(1, keepdims=True))
    return per, p / p.sum(1, keepdims=True)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_domain: int = 600) -> tuple[list[tuple[int, str]], np.ndarray]:
    """Rows (domain, text), of each domain the `per_domain` with the smallest hash of doc_id, and the number of all labelled rows of each domain."""
    domain = F.when(F.col("toxic").cast("int") == 1, 2).when(F.col("quality").cast("int") == 0, 1).when(F.col("quality").cast("int") == 1, 0)
    own = labels.select(F.col("doc_id").alias("i"), domain.alias("d")).where("i is not null and d is not null").distinct()
    order = Window.partitionBy("d").orderBy(F.xxhash64("i"), "i")
    chosen = cluster.few(own.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_domain).drop("k"))
    rows = docs.select(F.col("doc_id").alias("i"), F.col("text").cast("string").alias("t")).where("t is not null").join(chosen, "i").select("d", "i", "t").collect()
    shares = np.zeros(len(DOMAINS))
    for d, c in own.groupBy("d").count().collect():
        shares[d] = c
    return [(r[0], r[2]) for r in sorted(rows)], shares


@dataclass
class Rates:
    prices: np.ndarray
    #: Largest error of a domain, as a share of the mixed tokens.
    gap: float
    #: Passes over the posteriors.
    passes: int

    def of(self, p: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, 1.0 - p @ self.prices)


def _sums(posts: DataFrame, prices: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """At each of the prices: half the sum of tokens * rate ** 2; expected tokens by domain; those of rows with a rate above 0 by pair of domains; the least posterior . (price - centre) of a row with tokens."""
    c, m = prices.shape
    width = 2 + m + m * m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, least = np.zeros((c, width)), np.full(c, np.inf)
        for b in batches:
            p, n = b["p"].flatten().to_numpy().reshape(-1, m), b["n"].to_numpy()
            p, n = p[n > 0], n[n > 0].astype(np.float64)
            if not len(n):
                continue
            for j in range(c):
                r = np.maximum(0.0, 1.0 - p @ prices[j])
                total[j, 0] += (n * r) @ r / 2
                total[j, 2 : 2 + m] += (n * r) @ p
                total[j, 2 + m :] += (p.T @ (p * (n * (r > 0))[:, None])).ravel()
                least[j] = min(least[j], (p @ (prices[j] - centre)).min())
        total[:, 1] = least
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(c * width)), pa.array(total.ravel())], ["k", "v"])

    out = np.zeros(c * width)
    for k, v, least in posts.mapInArrow(run, "k bigint, v double").groupBy("k").agg(F.sum("v"), F.min("v")).collect():
        out[k] = least if k % width == 1 else v
    out = out.reshape(c, width)
    return out[:, 0], out[:, 2 : 2 + m], out[:, 2 + m :].reshape(c, m, m), out[:, 1]


def solve(posts: DataFrame, targets: np.ndarray, budget: float = BUDGET, most_steps: int = 300) -> Rates:
    """Prices of the domains; posts: tokens n and posteriors p of every document."""
    m = len(targets)
    prices, centre, ease = np.zeros(m), np.zeros(m), 1e-6
    _, tokens, pairs, least = (x[0] for x in _sums(posts, prices[None], centre))
    mass = tokens
    if not mass.sum():
        return Rates(prices, 0.0, 1)
    given = targets / targets.sum() * mass.sum() * budget
    live = mass >= LEAST_MASS * mass.sum()
    if not (live & (targets > 0)).any():
        raise ValueError("mixing: no domain with a target has any tokens")
    goal = np.where(live, given, 0.0)
    goal *= given.sum() / goal.sum()
    if (given[~live] > 0).any():
        warnings.warn(f"mixing: no tokens in {int((given[~live] > 0).sum())} of the domains; their share goes to the others", stacklevel=3)
    scale = np.maximum(mass, 1e-12 * mass.sum())

    def found(passes: int) -> Rates:
        return Rates(prices, float(np.abs(every - given).max() / given.sum()), passes)

    for passes in range(1, most_steps + 1):
        # domains that take no part have no price and no error
        every, tokens = tokens, np.where(live, tokens, 0.0)
        if np.abs(tokens - goal).max() <= TOLERANCE * goal.sum():
            return found(passes)
        # the dual of: squared errors / scale + ease * tokens * (rate - 1) ** 2, the former shifted by the prices at the centre
        slope = goal - tokens + ease * scale * (prices - centre)
        if np.abs(slope).max() <= 1e-3 * TOLERANCE * goal.sum():
            # no rates get closer than `bound` if no row has a negative product with `way`
            way = prices - centre + max(0.0, -least)
            bound = -(goal @ way) / np.sqrt((scale * way * way).sum())
            if bound >= 0.99 * np.sqrt(((tokens - goal) ** 2 / scale).sum()):
                rates = found(passes)
                warnings.warn(f"mixing: no rates meet the targets; the largest error is {rates.gap:.2g} of the mixed tokens", stacklevel=3)
                return rates
            centre, ease = prices, max(1e-9, ease / 10)
            slope = goal - tokens
        step = np.zeros(m)
        step[live] = np.linalg.solve((pairs + ease * np.diag(scale))[np.ix_(live, live)], -slope[live])
        tried = prices + 4.0 ** -np.arange(16)[:, None] * step
        sums = _sums(posts, tried, centre)
        best = int(np.argmin(sums[0] + tried @ goal + ease / 2 * ((tried - centre) ** 2) @ scale))
        prices = tried[best]
        _, tokens, pairs, least = (x[best] for x in sums)
    raise RuntimeError(f"mixing rates did not settle in {most_steps} passes; the largest error is {found(most_steps).gap:.2g} of the mixed tokens")


def posterior_udf(model: Classifier):
    """Column function: text -> struct of n, the words, and p, the posteriors."""

    def run(texts: pa.Array) -> pa.Array:
        parts = [posteriors(sub, model) for _, _, sub in kernel.sub_batches(texts)]
        m = len(model.bias)
        n = np.concatenate([x[0] for x in parts]) if parts else np.zeros(0, np.int64)
        p = np.concatenate([x[1] for x in parts]) if parts else np.zeros((0, m))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * m, pa.int32()), pa.array(p.ravel()))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), lists], ["n", "p"])

    return cluster.arrow_column(run, "struct<n:bigint,p:array<double>>")


def rate_column(p: Column, rates: Rates) -> Column:
    """Posteriors -> rate."""
    paid = F.lit(1.0)
    for k, price in enumerate(rates.prices):
        paid = paid - p[k] * F.lit(float(price))
    return F.greatest(F.lit(0.0), paid)


def _fitted(docs: DataFrame, labels: DataFrame, targets: dict[str, float], budget: float, keep: list[Column], **sample) -> tuple[DataFrame, Rates]:
    """The columns to keep with tokens n and posteriors p of every row, written; rates."""
    cluster.bounded_batches(docs.sparkSession)
    docs = cluster.spread(docs)
    model = fit(*labelled_sample(docs, labels, **sample))
    posts = docs.select(*keep, posterior_udf(model)(docs["text"].cast("string")).alias("__post"))
    posts = cluster.written(posts.select(*[c for c in posts.columns if c != "__post"], F.col("__post.n").alias("n"), F.col("__post.p").alias("p")))
    return posts, solve(posts.select("n", "p"), np.array([targets[d] for d in DOMAINS]), budget)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = BUDGET, **sample) -> DataFrame:
    """doc_id, tokens, the posterior of each domain, rate and gap, the largest error left in any domain, a row for each row of docs."""
    posts, rates = _fitted(docs, labels, targets, budget, [docs["doc_id"]], **sample)
    return posts.select("doc_id", F.col("n").alias("tokens"), *(F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)), rate_column(F.col("p"), rates).alias("rate"), F.lit(rates.gap).alias("gap"))


def apply_mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = BUDGET, **sample) -> DataFrame:
    """Rows of docs, each as many times as its rate, the fraction decided by a hash of doc_id and text, with the columns of docs. An empty text stays out."""
    chance = F.pmod(F.xxhash64(docs["doc_id"].cast("string"), docs["text"].cast("string"), F.lit(41)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    keep = [F.struct(*[docs[c] for c in docs.columns]).alias("__row"), chance.alias("__u")]
    posts, rates = _fitted(docs, labels, targets, budget, keep, **sample)
    kept = posts.select("__row", "__u", F.when(F.col("n") > 0, rate_column(F.col("p"), rates)).otherwise(0.0).alias("__rate"))
    copies = (F.floor("__rate") + (F.col("__u") < F.col("__rate") - F.floor("__rate")).cast("int")).cast("int")
    return kept.where(copies > 0).select("__row", F.explode(F.sequence(F.lit(1), copies)).alias("__copy")).select("__row.*")
