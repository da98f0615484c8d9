"""The pipeline's stages against the operators they call, each on its predecessor's rows."""

import pytest

from strandline.llm import langid, quality
from tests.llm.test_models import classes
from tests.llm.test_native import mix_in_python
from tests.oracle import DATA

pipeline = pytest.importorskip("corpus_pipeline")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def test_stages(spark, tmp_path):
    sf = str(DATA / "sf0.001")
    docs, before = spark.read.parquet(f"{sf}/documents.parquet"), None
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(path := f"file://{tmp_path}/{name.split()[0]}")
        before, docs = docs, spark.read.parquet(path)
        a, b = before.collect(), docs.collect()
        if name != "SentencePiece encoding":
            assert docs.columns == before.columns
            assert {r["doc_id"] for r in b} <= {r["doc_id"] for r in a}
        if name == "language ID":
            assert {r["doc_id"] for r in a} - {r["doc_id"] for r in b} == {r["doc_id"] for r in a if not r["text"] or not any(c.isalpha() for c in r["text"])}
        if name == "quality classifier":
            kept = {r["doc_id"] for r in b}
            good = [r["doc_id"] for r in a if labels.get(r["doc_id"]) == 1]
            bad = [r["doc_id"] for r in a if labels.get(r["doc_id"]) == 0]
            assert sum(i in kept for i in good) > 0.97 * len(good) and sum(i in kept for i in bad) < 0.3 * len(bad) + 1
        if name == "MinHash near-dedup":
            groups = classes([r["doc_id"] for r in a], [r["text"] for r in a])
            assert sorted(r["doc_id"] for r in b) == sorted(i for i, (_, c) in groups.items() if i == c)
        if name == "mixing to target weights":
            *_, taken = mix_in_python([(r["doc_id"], r["text"], r["source"]) for r in a])
            played = {d[0]: n // d[1] for d, n in taken.items()}
            got = {}
            for r in b:
                got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
            assert got == played
    assert docs.count() == before.count() and docs.filter("NOT round_trip").count() == 0


def test_run_equals_its_stages(spark):
    out = pipeline.run(spark, str(DATA / "sf0.001"))
    assert out.columns == ["doc_id", "lang", "source", "n_pieces", "ids", "round_trip"] and out.count() > 0
    assert pipeline.ORACLE_SQL is None and [f for _, f in pipeline.STAGES][0] is pipeline.language
    assert langid.UNKNOWN == "und" and quality.THRESHOLD == 0.3
