"""The pipeline stage by stage, and against brute force where the stage has one."""

import hashlib
import math
import random
import re

from pyspark.sql import functions as F
from test_operators import brute_near

import corpus_pipeline
from stackwright.llm import quality, queries


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, sf), name)
        if name != "encode":
            assert docs.columns == columns
        assert docs.count() <= before
        before = docs.count()
    assert docs.count() > 100
    assert docs.select("doc_id").distinct().count() == docs.count()


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, sf), name)
    assert docs.count() == 0


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 13))


def test_every_stage_against_plain_python(spark, sf, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    table, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    plain = {r["doc_id"]: r["text"] for r in table.collect() if len(r["text"] or "") < 4000}
    prose = [t for i, t in sorted(plain.items()) if t and len(t.split()) > 60]
    vocabulary = sorted({w.lower() for t in prose for w in t.split() if w.isalpha()})
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([30, 9])]
    planted = [None, "", *prose[:4], *[t.upper() for t in prose[4:6]], *[t + " tail" for t in prose[6:9]]]
    planted += [f"{a[: len(a) // 2]} {rng.choice(items)[1]} {b[len(b) // 2 :]}" for a, b in zip(prose, prose[1:])]
    planted += [prose[9] + " " + " ".join(items[0][1].split()[:9])]
    plain |= {10**6 + i: t for i, t in enumerate(planted)}
    spark.createDataFrame(list(plain.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels.where(F.col("doc_id").isin(list(plain))).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clash = {n: F.lit(1) for n in ("_keep", "_leak", "_s_n_words", "_y", "score", "key", "item_id", "n_tokens")}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumns(clash)
    columns = docs.columns
    rules = quality.learn(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), F.lit(True))

    def good(t):
        x = quality.text_stats((t or "").encode())
        total = rules.base + sum(w for r, w in rules.rules if all(x[s] <= c if most else x[s] > c for s, most, c in r))
        return 1 / (1 + math.exp(-total)) >= quality.CUT

    def lower(t):
        return (t or "").translate({i: i + 32 for i in range(65, 91)})

    def leaks(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        for _, item in items:
            x = item.split()
            bag = {tuple(x[k : k + 5]) for k in range(len(x) - 4)}
            for k in range(max(1, len(w) - len(x) + 1)):
                own = {tuple(w[k : k + len(x)][j : j + 5]) for j in range(min(len(w), len(x)) - 4)}
                if len(own & bag) >= 0.8 * len(own | bag):
                    return True
        return False

    left, expected = plain, {}
    left = expected["quality"] = {i: t for i, t in left.items() if good(t)}
    last = {lower(t): i for i, t in sorted(left.items())}
    left = expected["exact_dedup"] = {i: t for i, t in left.items() if last[lower(t)] == i}
    near = brute_near(left, corpus_pipeline.NEAR_SIZE)
    left = expected["near_dedup"] = {i: t for i, t in left.items() if near[i][2]}
    left = expected["decontaminate"] = expected["encode"] = {i: t for i, t in left.items() if not leaks(t)}
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs.count(), corpus_pipeline.stage(step(spark, docs, str(tmp_path)), name)
        assert {r[0] for r in docs.select("doc_id").collect()} == set(expected[name]), name
        assert docs.count() < before or name == "encode", name
        assert docs.columns == columns or name == "encode"
    tok = Tokenizer.from_file(queries.tokenizer_path())
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        text = left.pop(r["doc_id"]) or ""
        ids = tok.encode(text, add_special_tokens=False).ids
        assert (r["ids"], r["n_tokens"], r["decoded_sha256"]) == (ids, len(ids), hashlib.sha256(text.encode()).hexdigest())
    assert not left
