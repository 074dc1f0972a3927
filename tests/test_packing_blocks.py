from ledgerleaf.operators import retrieval
from ledgerleaf.plans import registry


def test_context_packing_multiplies_blocks(spark, monkeypatch):
    monkeypatch.delattr(retrieval, "scored_pairs")
    assert registry.QUERIES["c1_context_packing"](spark, "/root/testdata/sf0.001").count() > 0
