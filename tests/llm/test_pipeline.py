import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerleaf.llm import decontam, langid, queries

from .helpers import DE, EN, docs, rows
from .test_mixing import slow_mix
from .test_simhash import slow_components, slow_fingerprint

ITEMS = [(1, DE), (2, "nothing like it in any of the documents of this small test table at all"), (3, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    more = [(100 + i, f"{EN} number {i} " + " ".join(f"word{(i * 7 + j * j) % 97}" for j in range(40)), "en", f"src{i % 5}", 1, "", 0, "", "") for i in range(30)]
    docs(spark, rows() + more).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_run_matches_brute_force(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    left = [tuple(r) for r in table.collect()]
    model = langid.train(table)
    known = [p[0] != "und" and p[1] >= corpus_pipeline.LEAST_SCORE for p in model.predict([r[1] for r in left])]
    left = sorted((r for r, k in zip(left, known, strict=True) if k), key=lambda r: (r[0] is None, r[0] or 0))
    label = slow_components([(i, slow_fingerprint(r[1])) for i, r in enumerate(left)])
    left = [r for i, r in enumerate(left) if label[i] == i]
    assert 1 in {r[0] for r in left} and not {2, 3} & {r[0] for r in left}
    left = [r for r in left if decontam.brute_force(r[1], ITEMS)[1] == 0]
    assert not {4, 10, 13} & {r[0] for r in left}
    weights = {(d,): w for d, w in queries.MIX_DOMAIN.items()} | {(d, x): w for d in queries.MIX_DOMAIN for x, w in queries.MIX_LANG.items()}
    taken = {i for i, _ in slow_mix(left, weights, corpus_pipeline.MIX_SHARE, 1, 1, lambda lang, source: ("small" if len(source or "") <= 4 else "large", lang, source))}
    left = sorted((r for r in left if r[0] in taken), key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(left) > 20
    library, want, start = Tokenizer.from_file(queries.tokenizer_path()), [], 0
    for r in left:
        ids = [*library.encode(r[1], add_special_tokens=False).ids, 2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=lambda r: r[1]) == want


def test_stages_keep_the_columns_and_take_nothing(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, folder).columns == table.columns, name
        assert stage(spark, table.limit(0), folder).count() == 0, name


def test_near_copies_are_dropped_by_row(spark):
    """Rows without an id, and different texts under one id."""
    mixed = lambda k: f"{EN} number {k} " + " ".join(f"word{(k * 7 + j * j) % 97}" for j in range(40))
    data = [(None, mixed(1)), (None, mixed(2)), (None, mixed(2)), (1, mixed(3)), (5, mixed(3)), (5, mixed(4)), (6, mixed(5)), (6, mixed(5)), (None, mixed(5)), (7, mixed(6)), (7, mixed(7))]
    table = docs(spark, [(i, t, "en", "s", 1, "", 0, "", "") for i, t in data])
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, table.repartition(5), "").collect()), key=str)
    assert got == sorted([(None, mixed(1)), (None, mixed(2)), (1, mixed(3)), (5, mixed(4)), (6, mixed(5)), (7, mixed(6)), (7, mixed(7))], key=str)


def test_a_row_without_id_reaches_the_end(spark, folder):
    assert [r[0] for r in corpus_pipeline.run(spark, folder).collect()].count(None) == 1
