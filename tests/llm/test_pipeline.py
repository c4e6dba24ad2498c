"""The stages, one after the other, each judged on its own input."""

import os

import corpus_pipeline
import pytest
from chainspan.llm import registry
from chainspan.session import checkpoint_root


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        if name != "tokens":
            assert docs.columns == columns
        if name in ("toxicity", "jaccard_join", "decontamination"):
            assert docs.exceptAll(before).count() == 0 and 0.5 * counts[-2] < counts[-1] <= counts[-2]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "decontamination", "mixing", "tokens"]
    assert counts[-1] == counts[-2] and docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(registry.ORACLES) == {"op4_url_filter", "op11_prefix_trie", "op12_structure_repair", "op13_warc"}


@pytest.mark.parametrize("which", ["messy", "empty"])
def test_run_over_odd_tables(spark, messy, empty, tmp_path, which):
    """Null ids and texts, repeated rows, clashing columns, no rows at all; nothing is left behind but the result."""
    sf = "/root/testdata/sf0.001"
    docs = {"messy": messy, "empty": empty}[which]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        os.symlink(f"{sf}/{name}.parquet", f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    rows = got.collect()
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    if which == "empty":
        assert rows == []
        return
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    # Three rows hold the same words and two the long text: one of each class is left, as often as the mix takes it.
    kept = {r.doc_id for r in rows}
    assert kept <= {r.doc_id for r in docs.collect()} and len(kept & {5, 6}) >= 1
    left = checkpoint_root(spark).removeprefix("file:")
    stages = [d for d in os.listdir(left) if d.startswith("pipeline-")]
    assert all(os.listdir(f"{left}/{d}") in ([], ["tokens"]) for d in stages)
