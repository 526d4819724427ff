"""What the first round's review found missing."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import quality
from tests.llm.test_corpus_operators import SF, shingles


def kept_at(rows, percent):
    """doc_ids that are the least of their component, by comparing every pair; rows: (doc_id, text)."""
    sets = [(i, shingles(x)) for i, x in rows]
    top = {i: i for i, _ in rows}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                p, q = root(i), root(j)
                top[max(p, q)] = min(p, q)
    return {i for i in top if root(i) == i}


def test_the_pipeline_links_from_four_fifths(spark, documents):
    """Pairs on either side of 0.8 and of 0.85: 104 words have 100 shingles, a changed word at the end of a text costs one for each word."""
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    rnd = random.Random(3)
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    for k in range(150):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(104)]
        cut = 7 + k % 6  # similarity (100 - cut) / (100 + cut): 0.87 to 0.79
        rows += [(10000 + 2 * k, " ".join(base)), (10001 + 2 * k, " ".join(base[:-cut] + [f"x{rnd.randrange(10**6)}" for _ in range(cut)]))]
    want = kept_at(rows, 80)
    assert want != kept_at(rows, 85)
    got = stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert {r["doc_id"] for r in got.collect()} == want


def test_copies_do_not_become_the_centre(spark):
    """Nine tenths of a source are copies of one text; another source holds hardly anything but copies."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = docs.where("lang = 'en'").join(labels.where("quality = 1"), "doc_id", "left_semi").withColumn("source", F.lit("a"))
    good = good.dropDuplicates(["text"]).localCheckpoint()
    n = good.count()
    one = good.orderBy(F.length("text").desc()).limit(1)
    copies = one.crossJoin(spark.range(9 * n)).withColumn("doc_id", F.col("id") + 10**6).drop("id")
    odd = spark.createDataFrame([(-1, "#$% " * 40 + "&&& " * 60, "en", "b")], good.schema)
    starved = copies.limit(200).withColumn("doc_id", F.col("doc_id") + 10**6).withColumn("source", F.lit("b")).unionByName(odd)
    df = good.unionByName(copies).unionByName(starved)
    out = {r["doc_id"]: r for r in quality.judged(df).collect()}
    assert len(out) == df.count()
    mine = [r["kept"] for i, r in out.items() if 0 <= i < 10**6 and not r["base_failed"]]
    assert len(mine) >= 60 and np.mean(mine) > 0.97
    assert all(r["kept"] for i, r in out.items() if i >= 10**6)
    assert out[-1]["distance"] > 50
