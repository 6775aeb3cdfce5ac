"""The pipeline's stages, each against a plain computation on its own input."""

import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import mixing, toxicity


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(7)
    pool = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    base = [" ".join(rng.choice(pool, 40)) for _ in range(60)]
    texts = base + [t + " vilex " + t for t in base[:12]] + base[20:25] + [t.replace(" ", "  ", 1) for t in base[25:28]]
    texts += [" ".join([*base[30].split()[:-1], "other"]), None, ""]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(60 <= i < 72)) for i in range(72)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    here, now = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5

    out = corpus_pipeline.drop_toxic(spark, now, here)
    scored = toxicity.severity(now, spark.read.parquet(f"{here}/labels.parquet"))
    want = {r.doc_id for r in scored.collect() if r.kept}
    assert {r.doc_id for r in out.collect()} == want and not want & set(range(60, 72)) and want >= set(range(60))

    out = spark.createDataFrame(out.collect(), docs.schema)
    kept = corpus_pipeline.drop_copies(spark, out, here)
    seen, first = set(), set()
    for r in sorted(out.collect(), key=lambda r: r.doc_id):
        t = re.sub(r"[ \t-\r]+", " ", r.text or "")
        if t not in seen:
            first.add(r.doc_id)
        seen.add(t)
    assert {r.doc_id for r in kept.collect()} == first

    kept = spark.createDataFrame(kept.collect(), docs.schema)
    apart = corpus_pipeline.drop_near_copies(spark, kept, here)
    near = max(i for i, t in enumerate(texts) if t and t.endswith("other"))
    assert {r.doc_id for r in kept.collect()} - {r.doc_id for r in apart.collect()} == {near}

    apart = spark.createDataFrame(apart.collect(), docs.schema)
    mixed = corpus_pipeline.mix(spark, apart, here)
    taken = {r.doc_id: r for r in mixing.mix_sources(apart).collect()}
    times = {i: int(np.floor(r.taken / r.size + 0.5)) if r.size else 1 for i, r in taken.items()}
    have = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert have == {i: n for i, n in times.items() if n} and mixed.columns == docs.columns

    twice = {i for i, n in times.items() if n > 1}
    mixed = spark.createDataFrame(sorted(mixed.collect(), key=lambda r: r.doc_id), docs.schema).coalesce(1)
    samples = corpus_pipeline.encode(spark, mixed, here).groupBy("doc_id").agg(F.count_distinct("pieces").alias("n")).collect()
    assert twice and all(r.n > 2 for r in samples if r.doc_id in twice and apart.where(F.col("doc_id") == r.doc_id).first().n_chars > 20)

    last = corpus_pipeline.run(spark, here).collect()
    assert {r.doc_id for r in last} == set(have) and all(r.exact for r in last)


def test_odd_rows(spark, tmp_path):
    """Null ids, texts and sources, repeated rows, an id with two texts, a very long text and columns of other names."""
    rng = np.random.default_rng(9)
    pool = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(pool, n))
    rows = [(i, make(30), f"s{i % 2}") for i in range(20)] + [(3, make(25), None), (None, make(30), None), (None, None, "s1"), (50, "", "s0"), (51, None, None), (60, make(60_000), "s0")]
    rows += [rows[4], (None, rows[5][1], "s0"), (70, rows[6][1] + " end", "s0")]
    docs = spark.createDataFrame([(*r, "en", 1, "id", 2, "part") for r in rows], "doc_id long, text string, source string, lang string, n_chars long, id string, size int, part string")
    here = str(tmp_path)
    docs.write.parquet(f"{here}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{here}/labels.parquet")
    now = spark.read.parquet(f"{here}/documents.parquet")
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        now = spark.createDataFrame(stage(spark, now, here).collect(), docs.schema)
        sizes.append(now.count())
    have = {(r.doc_id, r.text) for r in now.collect()}
    assert sizes == [29, 25, 24] and len(have) == 24  # a repeated row, two copies and two of three empty texts; then a near copy
    assert (3, rows[3][1]) in have and (3, rows[20][1]) in have and rows[21][:2] in have and (70, rows[28][1]) not in have and (60, rows[25][1]) in have
    mixed = corpus_pipeline.mix(spark, now, here)
    assert mixed.columns == docs.columns and {(r.doc_id, r.text) for r in mixed.collect()} <= have
    last = corpus_pipeline.run(spark, here)
    assert all(r.exact for r in last.collect())


def test_empty_tables(spark, tmp_path):
    here = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{here}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{here}/labels.parquet")
    assert corpus_pipeline.run(spark, here).count() == 0
