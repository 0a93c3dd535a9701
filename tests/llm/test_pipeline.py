"""The pipeline against a brute-force version of its stages."""

import os

import corpus_pipeline
from geoloom.llm import bpe
from geoloom.llm.queries import TOKENIZERS

from .test_dedup_mix import hashed, poisson
from .test_shingle_join import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_and_result(spark, sf_dir, tmp_path):
    source = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS).collect()]
    seen, docs = {}, spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        seen[name] = docs
    assert all(seen[name].columns == COLUMNS for name, _ in corpus_pipeline.STAGES[:-1])
    rows = lambda name: [tuple(r) for r in seen[name].select(*COLUMNS).collect()]
    kept = rows("quality")
    assert set(kept) <= set(source) and len(kept) > 0.6 * len(source)

    last = {}
    for r in kept:
        last[r[1]] = max(last.get(r[1], r), r)
    assert sorted(rows("exact_dedup")) == sorted(last.values())

    single = rows("exact_dedup")
    least = brute(single)
    near = [r for r, c in zip(single, least, strict=True) if r[0] == c]
    assert sorted(rows("near_dedup")) == sorted(near)

    size = {}
    for r in near:
        size[r[3]] = size.get(r[3], 0) + len(r[1])
    weight = sum(n**0.5 for n in size.values())
    copies = []
    for r in near:
        rate = size[r[3]] ** 0.5 / weight * sum(size.values()) / size[r[3]]
        copies += [r] * poisson(hashed(f"42:draw:{r[0]}") / 2**52, rate)
    assert sorted(rows("mixing")) == sorted(copies)

    encoder = bpe.PairIndexBpe(os.path.join(TOKENIZERS, "word_bpe_49k.json"))
    want = sorted((r[0], encoder.encode([r[1]])[0]) for r in copies)
    assert sorted((r.doc_id, bytes(r.ids)) for r in seen["bpe"].collect()) == want
    assert sorted((r.doc_id, bytes(r.ids)) for r in corpus_pipeline.run(spark, sf_dir).collect()) == want
