"""Token ids in bit-plane files: fixed-size id blocks transposed into byte planes, each compressed, with a chunk index.

A file is one range of doc_ids: a Parquet part written and committed by Spark, whose rows are chunks of up to
``CHUNK`` ids (a longer document has a chunk of its own). ``planes`` holds a chunk's blocks; the other columns are the
index: where the chunk lies in its file, which documents it has and how many ids each.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import byte_slices, new_dir

#: Ids in a block; a block is transposed at once.
BLOCK = 1 << 16
#: Ids in a chunk, about; a chunk is what is read at once.
CHUNK = 1 << 19
END = 2
#: Bytes of words and their ids that a Python worker remembers, about; the least recently used half goes when it is full.
MEMORY = 112 << 20
#: Bytes of text encoded at once.
SLICE = 6 << 20
FILE_SCHEMA = "file int, chunk int, first_doc long, n_docs int, n_ids long, doc_ids array<long>, lengths array<long>, planes binary"
_FILE_TYPES = pa.schema([("file", pa.int32()), ("chunk", pa.int32()), ("first_doc", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("planes", pa.binary())])
#: The pre-tokenizer's pattern, a fixed value of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself, or the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Whole texts to ids by the tokenizers library, with each distinct word encoded once.

    A byte-level pre-tokenizer always cuts before a blank that has no white space on either side, so a text without
    longer runs of white space is the sum of its blank-separated words. Other texts, and all texts of a vocabulary that
    isn't a plain byte-level one, go through the library whole.
    """

    _odd = re.compile(r"[^\S \n]")

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.byte_level = plain_byte_level(json.loads(Path(path).read_text()))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.find = regex.compile(PATTERN).findall
        self.letters = _byte_letters()
        self.tokenize = self.tokenizer.model.tokenize
        self.young: dict[str, bytes] = {}  # ids of pieces
        self.old = self.young
        self.room = MEMORY // 2

    def piece(self, text: str) -> bytes:
        """The ids of what the pre-tokenizer takes as one piece, as little-endian 32-bit."""
        ids = self.young.get(text)
        if ids is None:
            ids = self.old.get(text)
            if ids is None:
                found = self.tokenize(text.encode().decode("latin-1").translate(self.letters))
                ids = array("I", [t.id for t in found]).tobytes()
            self.room -= 170 + len(text) + len(ids)
            if self.room < 0:  # what wasn't used since the last time goes
                self.young, self.old, self.room = {}, self.young, MEMORY // 2
            self.young[text] = ids
        return ids

    def words(self, texts: pa.Array) -> list[bytes]:
        """The ids of a blank and each word after it: letters, maybe before one stop or comma, are one piece or two."""
        stems = pc.utf8_rtrim(texts, ".,")
        cut = pc.subtract(pc.utf8_length(texts), pc.utf8_length(stems))
        plain = pc.and_(pc.less_equal(cut, 1), pc.utf8_is_alpha(stems))
        own = pc.if_else(plain, stems, None).dictionary_encode()
        known = [self.young.get(x) or self.piece(x) for x in [f" {x}" for x in own.dictionary.to_pylist()]]
        tail = np.where(cut.to_numpy() > 0, pc.ends_with(texts, ".").to_numpy(zero_copy_only=False) + 1, 0)
        tails = (b"", self.piece(","), self.piece("."))
        at = pc.fill_null(own.indices, -1).to_numpy()
        out = [known[i] + tails[t] if t else known[i] for i, t in zip(at.tolist(), tail.tolist(), strict=True)] if known else [b""] * len(texts)
        for i in np.flatnonzero(at < 0).tolist():
            out[i] = b"".join(map(self.piece, self.find(f" {texts[i].as_py()}")))
        return out

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def simple(self, text: str) -> bool:
        """Whether the text is the sum of its words."""
        return self.byte_level and not ("  " in text or "\n " in text or " \n" in text or text.endswith(" ") or self._odd.search(text) or any(s in text for s in self.special))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; a null text has none."""
        texts = [t or "" for t in texts]
        simple = [bool(t) and self.simple(t) for t in texts]
        split = pc.split_pattern(pa.array([t for t, s in zip(texts, simple, strict=True) if s], pa.large_string()), " ")
        coded = split.values.dictionary_encode()
        known = self.words(coded.dictionary)
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat = np.frombuffer(b"".join(known), "<u4")
        del known
        begins = np.cumsum(lengths) - lengths
        which, offsets = coded.indices.to_numpy(), split.offsets.to_numpy()
        out, at = [], 0
        for text, plain in zip(texts, simple, strict=True):
            if not plain:
                out.append(self.whole(text) if text else b"")
                continue
            first, *_ = text.split(" ", 1)
            own = which[offsets[at] + 1 : offsets[at + 1]]  # the first word has no blank before it
            at += 1
            n = lengths[own]
            stop = np.cumsum(n)
            total = int(stop[-1]) if len(stop) else 0
            places = np.repeat(begins[own] - (stop - n), n) + np.arange(total)
            out.append(b"".join(map(self.piece, self.find(first))) + flat[places].tobytes())
        return out


def plain_byte_level(config: dict) -> bool:
    """Whether a tokenizer file's settings are those that ``PATTERN`` and byte letters stand for."""
    model, before = config.get("model") or {}, config.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    odd = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "unk_token"))
    return bool(plain and model.get("type") == "BPE" and not odd and not config.get("normalizer") and not config.get("truncation"))


def pack(ids: np.ndarray) -> bytes:
    """Ids to blocks of compressed byte planes: per block its length, then each plane's size and zstandard bytes."""
    squeeze, out = zstandard.ZstdCompressor(level=1).compress, [struct.pack("<Q", len(ids))]
    for i in range(0, len(ids), BLOCK):
        block = np.ascontiguousarray(ids[i : i + BLOCK], "<u4")
        planes = np.ascontiguousarray(block.view(np.uint8).reshape(-1, 4).T)
        for plane in planes:
            data = squeeze(plane.tobytes()) if plane.any() else b""  # an empty plane is all zero
            out += [struct.pack("<I", len(data)), data]
    return b"".join(out)


def unpack(data: bytes) -> np.ndarray:
    """The ids that ``pack`` was given."""
    (n,), at, out = struct.unpack_from("<Q", data), 8, []
    expand = zstandard.ZstdDecompressor().decompress
    for i in range(0, n, BLOCK):
        rows = min(BLOCK, n - i)
        planes = np.zeros((4, rows), np.uint8)
        for plane in planes:
            (size,) = struct.unpack_from("<I", data, at)
            at += 4
            if size:
                plane[:] = np.frombuffer(expand(data[at : at + size]), np.uint8)
            at += size
        out.append(np.ascontiguousarray(planes.T).view("<u4").ravel())
    return np.concatenate(out) if out else np.zeros(0, "<u4")


_encoders: dict[str, Encoder] = {}


def write_ids(docs: DataFrame, tokenizer: str, path: str, end: int = END) -> None:
    """Encode every whole text, end each document with ``end``, and write the ids in ascending order of doc_id.

    Takes doc_id and text; other columns are ignored. A null or empty text has the end id alone. Rows that share a
    doc_id stay, ordered by text; null ids come first. Spark's own commit makes each file appear once and whole,
    whatever is run again. Work is split by ranges of doc_id; the longest document bounds a task's memory.
    """
    width = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(width, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered = ordered.select(F.spark_partition_id().alias("file"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders.clear()
            _encoders[tokenizer] = Encoder(tokenizer)
        encoder, last = _encoders[tokenizer], struct.pack("<I", end)
        file, chunk, ids, held, size = None, 0, [], [], 0

        def out() -> pa.RecordBatch:
            found = np.frombuffer(b"".join(held), "<u4")
            row = [[file], [chunk], [ids[0]], [len(ids)], [len(found)], [ids], [[len(h) // 4 for h in held]], [pack(found)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, _FILE_TYPES.types, strict=True)], schema=_FILE_TYPES)

        for batch in batches:
            for part in byte_slices(batch, 2, SLICE):
                file = part.column(0)[0].as_py()
                for doc_id, found in zip(part.column(1).to_pylist(), encoder.encode(part.column(2).to_pylist()), strict=True):
                    if held and size + len(found) // 4 >= CHUNK:
                        yield out()
                        chunk, ids, held, size = chunk + 1, [], [], 0
                    ids.append(doc_id)
                    held.append(found + last)
                    size += len(found) // 4 + 1
        if held:
            yield out()

    ordered.mapInArrow(run, FILE_SCHEMA).write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)


def read_ids(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from files that ``write_ids`` wrote.

    ``start`` counts the ids of all documents before it. The driver never sees the index: the files' totals (a row for
    each file) are summed in order, then the chunks within each file.
    """
    totals = files.groupBy("file").agg(F.sum("n_ids").alias("own"))
    before = totals.select(F.col("file").alias("of"), F.expr("coalesce(sum(own) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("before"))
    index = files.select("file", "chunk", F.expr("coalesce(sum(n_ids) OVER (PARTITION BY file ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("ahead"))
    index = index.join(before, F.col("file") == F.col("of")).select(F.col("file").alias("f"), F.col("chunk").alias("c"), (F.col("before") + F.col("ahead")).alias("start"))
    chunks = files.join(index, (F.col("file") == F.col("f")) & (F.col("chunk") == F.col("c"))).select("start", "doc_ids", "lengths", "planes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, doc_ids, lengths, planes = (batch.column(c)[i].as_py() for c in range(4))
                data, stops = unpack(planes).tobytes(), np.cumsum(lengths)
                starts = stops - lengths
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts + start), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return chunks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Write ``docs`` to a new folder among the shared ones, and return what its files say."""
    spark = docs.sparkSession
    path = new_dir(spark, "token-ids")
    write_ids(docs, tokenizer, path, end)
    return read_ids(spark.read.schema(FILE_SCHEMA).parquet(path))


