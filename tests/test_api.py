"""The public calls, and datasets with checksums."""

import pytest

from loamgraph.api import Knowledge
from loamgraph.sources import datasets


def test_calls(spark, data):
    k = Knowledge(spark, data)
    first, second = k.entities(limit=2).collect(), k.entities(limit=1, offset=1).collect()
    assert first[1] == second[0]
    assert {r.entity_type for r in k.entities(entity_type="FILE", limit=None).select("entity_type").collect()} == {"FILE"}
    key = k.table("entities").filter("entity_type = 'FILE' and path is not null and name is not null").first()
    assert k.entity(key.entity_key).count() == 1 and k.symbol(key.name).first().score == 0.98
    assert k.explain(key.entity_key).count() == 1 and k.projects().count() == 40 and k.runs(limit=3).count() == 3
    hits = k.search("retry is safe and the second insert is ignored", 5).collect()
    assert len(hits) == 5 and hits[0].fused >= hits[-1].fused and hits[0].intent == "UNKNOWN"
    edge = k.edges().filter("predicate = 'CONTAINS'").first()
    assert k.references(edge.dst).filter(f"src = '{edge.src}'").count() == 1
    assert (edge.src, 1, "DIRECT") in {(r.id, r.hop, r.level) for r in k.impact([edge.dst], 1).collect()}
    assert edge.dst in {r.id for r in k.dependencies(edge.src, 1).collect()}
    change = k.table("entity_changes").filter("file_rel_path is not null").first()
    assert 1 <= k.history(change.file_rel_path).count() <= 10
    s = k.table("snapshot_entities").first().snapshot_id
    assert k.snapshot(s).count() > 0


def test_datasets(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "source", "text")
    split = datasets.split_by_time(docs, "source", ["doc_id"])
    datasets.save(split, str(tmp_path / "d"))
    parts = {s: datasets.load(spark, str(tmp_path / "d"), s).count() for s in ("TRAIN", "VALIDATION", "TEST")}
    assert sum(parts.values()) == docs.count() and parts["TRAIN"] > parts["TEST"] > 0
    docs.limit(1).write.mode("append").parquet(str(tmp_path / "d/data/split=TEST"))
    with pytest.raises(ValueError):
        datasets.load(spark, str(tmp_path / "d"), "TEST")
