"""The pipeline's stages, each on its own input, and what they do to planted cases."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from plumbline.llm import bpe

SF = "/root/testdata/sf0.001"


def test_stages_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF).cache()
        if k < 4:
            assert out.columns == docs.columns, name
        if k < 3:
            assert out.join(docs, "doc_id", "left_anti").count() == 0 and out.count() <= before, name
        docs, before = out, out.count()
    assert before > 0 and docs.where("not round_trip").count() == 0


def test_planted_cases(spark, tmp_path):
    r = random.Random(11)
    word = lambda: "".join(r.choice(["ka", "lo", "mi", "tu", "ren", "sel"]) for _ in range(r.randint(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    clean = [(i, text(120)) for i in range(200)]
    copies = [(300 + i, clean[i][1]) for i in range(20)] + [(400 + i, clean[i][1] + " " + word()) for i in range(20)]
    junk = [(500, "spam eggs now buy this here " * 60), (501, "??? 123 ###"), (502, None), (503, "")]
    rows = [(i, t, "aa", "s", None) for i, t in clean + copies + junk]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, str(tmp_path))
    assert sorted(x.doc_id for x in kept.select("doc_id").collect()) == [i for i, _ in clean]


def test_run_matches_stages(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    back = {x.doc_id: x.text for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    enc = bpe.encoder(bpe.read_ranks(bpe.VOCABULARY))
    assert out and all(b"".join(enc.token_bytes[t] for t in x.tokens).decode() == back[x.doc_id] for x in out)


def test_run_against_brute_force(spark, tmp_path):
    """run() on planted documents with nulls, repeats and columns of clashing names: what stays after three stages is known, rates come from an independent pass over posteriors, tokens from a public tokenizer."""
    import tiktoken
    from plumbline.llm import mixing
    from pyspark.sql import functions as F

    r = random.Random(21)
    word = lambda: "".join(r.choice(["ka", "lo", "mi", "tu", "ren", "sel"]) for _ in range(r.randint(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    clean = [(i, text(100)) for i in range(150)]
    low = [(200 + i, "click here " + text(60)) for i in range(60)]
    gone = [(300 + i, clean[i][1]) for i in range(30)] + [(400 + i, clean[i][1] + " " + word()) for i in range(15)] + [(500, "buy now " * 80), (501, None), (502, ""), (503, "?!")]
    rows = clean + low + gone + [(None, text(90)), (7, clean[7][1])]
    docs = spark.createDataFrame([(i, t, "aa", "s", None) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for c in ("__row", "p", "n", "s", "keep", "__u"):
        docs = docs.withColumn(c, F.lit(1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i, _ in clean[::2] + low[::2]] + [(None, 1, 0), (2, None, None)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs.where("doc_id < 300 or doc_id is null").dropDuplicates(["doc_id", "text"])
    with pytest.warns(UserWarning):
        out = corpus_pipeline.run(spark, str(tmp_path)).collect()
        mixed = {x.doc_id: x for x in mixing.mix(kept, labels).collect()}
    chance = kept.select("doc_id", "text", (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(41)), F.lit(1 << 30)) / float(1 << 30)).alias("u")).collect()
    enc = bpe.encoder(bpe.read_ranks(bpe.VOCABULARY))
    ref = tiktoken.Encoding("own", pat_str=r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=enc.ranks, special_tokens={})
    want = []
    for x in chance:
        rate = mixed[x.doc_id].rate
        want += [(x.doc_id, ref.encode_ordinary(x.text))] * (int(rate) + (x.u < rate - int(rate)))
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(((x.doc_id, x.tokens) for x in out), key=key) == sorted(want, key=key) and all(x.round_trip for x in out)
    total = sum(len(t.split()) for _, t in clean + low) + 90
    assert abs(sum(x.rate * x.tokens * x.p_clean for x in mixed.values()) / (0.6 * 0.86 / 0.94 * total) - 1) < 0.01


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op1_exact_top_k", "op2_sharding", "op3_warc_revisits"])
def test_sql(spark, name):
    import duckdb
    from plumbline.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(repr(tuple(x)) for x in got.select(*columns).collect()) == sorted(repr(x) for x in want.fetchall())
