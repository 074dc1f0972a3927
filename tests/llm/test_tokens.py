import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerleaf.llm import tokens
from ledgerleaf.llm.common import new_dir
from ledgerleaf.llm.queries import tokenizer_path

from .helpers import docs


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def test_query_matches_the_library(spark, library):
    table = docs(spark)
    rows = sorted(table.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    want, start = [], 0
    for r in rows:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in tokens.token_table(table, tokenizer_path()).collect()), key=lambda r: r[1]) == want


def test_small_chunks(spark, monkeypatch):
    table, path = docs(spark), new_dir(spark, "test-ids")
    want = sorted(map(tuple, tokens.token_table(table, tokenizer_path()).collect()), key=str)
    tokens.write_ids(table.repartition(3), tokenizer_path(), path)
    assert sorted(map(tuple, tokens.read_ids(spark.read.parquet(path)).collect()), key=str) == want


def test_words_add_up_to_the_whole(library):
    encoder, rng = tokens.Encoder(tokenizer_path()), random.Random(5)
    alphabet = ["a", "the", "Été", "don't", "x²", " ", " ", " ", "\n", "\t", "\u00a0", "\u3000", ".", ",", "12", "你", "😀", "<|endoftext|>", "'s", "_", "\x1c", "\r"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + ["", " ", "a ", " a", "a\n b", "a \nb"]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == want


def test_planes_round_trip():
    for ids in ([], [0], [50256, 2**32 - 1, 7], list(range(200_000))):
        assert tokens.unpack(tokens.pack(np.array(ids, "<u4"))).tolist() == ids


def test_empty_table(spark):
    assert tokens.token_table(docs(spark, []), tokenizer_path()).count() == 0


def test_a_small_memory_gives_the_same(library, monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 3000)
    encoder, rng = tokens.Encoder(tokenizer_path()), random.Random(6)
    texts = [" ".join(rng.choice(["the", "Été,", "don't", "word.", "x²", "12", "end"]) + str(rng.randint(0, 40)) * rng.randint(0, 1) for _ in range(60)) for _ in range(40)]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == want and len(encoder.young) + len(encoder.old) < 60


def test_other_vocabularies_go_through_the_library():
    import public_tokenizers

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    encoder, texts = tokens.Encoder(path), ["Hello the world, and all of it.", "a  b"]
    assert not encoder.byte_level
    assert encoder.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
