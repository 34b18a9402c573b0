"""Word-level BPE over a table of distinct words: encode each word once, join ids back by position, decode by piece.

A block is a run of documents of bounded size. Splitting makes, for each block, its distinct words dealt into word
buckets and its documents' positions as word numbers of the block. All copies of a word meet in one bucket and are
encoded there once; the ids return to the blocks, where positions become ids. So a word crosses the network once per
block and never once per occurrence, and a word in a third of all positions weighs no more than a rare one.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import saved, words_of

#: Characters of text in a block, beyond which a new one begins (a longer document is a block of its own).
BLOCK_CHARS = 12 << 20
#: Distinct words a task remembers before it starts afresh.
MEMORY_WORDS = 1 << 18
#: Compression of what travels between tasks.
LEVEL = 9


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, on the task's own core; Spark sees to parallel work."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


@lru_cache(maxsize=4)
def pieces(path: str) -> np.ndarray | None:
    """The id-to-piece table, as large as the vocabulary file; None if the file has its own way of joining pieces."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec.get("decoder"):
        return None
    vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    table = np.full(max(vocab.values(), default=0) + 1, "", dtype=object)
    for piece, i in vocab.items():
        table[i] = piece
    return table


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte planes apart, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=LEVEL).compress(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def gather(starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """flat's runs (starts, sizes) laid end to end in the order of codes."""
    n = sizes[codes].astype(np.int64)
    if not len(n) or not (total := int(n.sum())):
        return flat[:0]
    ends = np.cumsum(n)
    return flat[np.arange(total) - np.repeat(ends - n - starts[codes], n)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, list[bytes]]]:
    """(key, ids, words per document, positions, distinct words) of each block; frequent words have small numbers.

    The key is a hash of the block's texts in order and of where it lies, so that the two readings of the same rows
    can only meet over the same block.
    """
    place = TaskContext.get().partitionId()
    for batch in batches:
        ids, texts, at = batch.column(0), batch.column(1), 0
        while at < batch.num_rows:
            table: defaultdict = defaultdict()
            table.default_factory = table.__len__
            key, first, size, codes = xxhash.xxh3_64(f"{place} {at}"), at, 0, []
            while at < batch.num_rows and size < BLOCK_CHARS:
                text = texts[at].as_py()
                words = words_of(text)
                codes.append(np.fromiter(map(table.__getitem__, words), np.uint32, len(words)))
                key.update(codes[-1])
                size += len(text or "")
                at += 1
            counts, flat = np.array([len(c) for c in codes], np.uint32), np.concatenate(codes)
            order = np.argsort(-np.bincount(flat, minlength=len(table)), kind="stable")
            rank = np.empty(len(table), np.uint32)
            rank[order] = np.arange(len(table))
            words = list(table)
            key.update(b" ".join(words))
            place += 1 << 20  # blocks of equal texts in one task
            yield key.intdigest() - (1 << 63), ids.slice(first, at - first), counts, rank[flat], [words[i] for i in order]


def _positions(id_type: pa.DataType):
    schema = pa.schema(
        [("block", pa.int64()), ("ids", pa.list_(id_type)), ("counts", pa.binary()), ("codes", pa.binary()), ("words", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, counts, codes, words in _blocks(batches):
            yield pa.record_batch([[key], [ids.to_pylist()], [pack(counts)], [pack(codes)], [len(words)]], schema=schema)

    return run


def _words(buckets: int):
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("codes", pa.binary()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        for key, _, _, _, words in _blocks(batches):
            rows: list[list[tuple[bytes, int]]] = [[] for _ in range(buckets)]
            for pair in sorted(zip(words, range(len(words)), strict=True)):
                rows[zlib.crc32(pair[0]) % buckets].append(pair)
            for bucket, own in enumerate(rows):
                if own:
                    codes = pack(np.array([c for _, c in own], np.uint32))
                    yield pa.record_batch([[key], [bucket], [codes], [squeeze(b" ".join(w for w, _ in own))]], schema=schema)

    return run


def _encode_words(vocab: str):
    schema = pa.schema([("block", pa.int64()), ("codes", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocab).encode_batch_fast
        seen: dict[bytes, tuple[int, ...]] = {}
        for batch in batches:
            for block, codes, blob in zip(*batch.select(["block", "codes", "words"]).to_pydict().values(), strict=True):
                words = zstandard.ZstdDecompressor().decompress(blob).split()
                if len(seen) > MEMORY_WORDS:
                    seen = {}
                new = [w for w in words if w not in seen]
                made = encode([w.decode("utf-8", "surrogatepass") for w in new], add_special_tokens=False)
                seen.update(zip(new, [tuple(e.ids) for e in made], strict=True))
                got = [seen[w] for w in words]
                sizes = np.fromiter(map(len, got), np.uint32, len(got))
                flat = np.fromiter((i for g in got for i in g), np.uint32, int(sizes.sum()))
                yield pa.record_batch([[block], [codes], [pack(sizes)], [pack(flat)]], schema=schema)

    return run


def _join_back(id_col: str, id_type: pa.DataType):
    schema = pa.schema([(id_col, id_type), ("ids", pa.list_(pa.int32()))])

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        code, size, flat = (
            np.concatenate([np.empty(0, np.uint32), *(unpack(b.as_py()) for b in words.column(c))])
            for c in ("codes", "sizes", "ids")
        )
        if docs.num_rows != 1 or len(code) != docs.column("words")[0].as_py():
            raise ValueError("the input's rows changed between two readings; pass stable=False")
        by_code, starts = np.zeros(len(code), np.uint32), np.zeros(len(code), np.uint32)
        by_code[code], starts[code] = size, np.cumsum(size) - size
        out = []
        for row in range(docs.num_rows):
            cuts = np.append(0, np.cumsum(unpack(docs.column("counts")[row].as_py()), dtype=np.int64))
            positions, keys = unpack(docs.column("codes")[row].as_py()), docs.column("ids")[row].values
            for a in range(0, len(keys), 200):  # so many documents at a time, to keep what is laid out small
                b = min(a + 200, len(keys))
                mine = positions[cuts[a] : cuts[b]]
                ends = np.append(0, np.cumsum(by_code[mine], dtype=np.int64))
                offsets = ends[cuts[a : b + 1] - cuts[a]]
                values = gather(starts, by_code, flat, mine).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
                out.append(pa.record_batch([keys.slice(a, b - a), lists], schema=schema))
        return pa.Table.from_batches(out, schema=schema)

    return run


def encode(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", stable: bool = False) -> DataFrame:
    """(id_col, ids array<int>): the tokenizer file's ids of every whole text, one row per input row.

    Words are cut at the blanks of ``[\\x20\\x09-\\x0D]``, which the tokenizer drops in any case, so a word's ids do
    not depend on its neighbours. Null and empty texts give an empty list, a null id stays null, repeated rows stay
    repeated, an empty table gives an empty one; further columns are ignored.

    The rows are read twice, for words and for positions, which spares writing and moving them once more. ``stable``
    says that both readings yield the same rows in the same order, as a scan of files does; otherwise a copy of id
    and text is saved first. A reading that differs after all fails, it never mixes blocks up.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType
    arrow = pa.string() if isinstance(kind, T.StringType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.int64()
    if isinstance(kind, T.NullType):
        rows, kind = rows.withColumn("id", F.col("id").cast("bigint")), T.LongType()
    if not stable:
        rows = saved(rows, "texts")
    words = (
        rows.mapInArrow(_words(n), "block bigint, bucket int, codes binary, words binary")
        .repartition(n, "bucket")
        .mapInArrow(_encode_words(vocab), "block bigint, codes binary, sizes binary, ids binary")
    )
    at = rows.mapInArrow(
        _positions(arrow), f"block bigint, ids array<{kind.simpleString()}>, counts binary, codes binary, words bigint"
    )
    made = T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return at.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(_join_back(id_col, arrow), made)


def _decode(vocab: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(vocab)  # without a decoder, pieces are joined by a blank
        for big in batches:
            for at in range(0, big.num_rows, 200):
                batch = big.slice(at, 200)
                out = []
                for got in batch.column("ids"):
                    if not got.is_valid:
                        out.append(None)
                        continue
                    ids = got.values.to_numpy(zero_copy_only=False)
                    if table is not None:
                        out.append(" ".join(table[ids].tolist()))
                    else:
                        out.append(tokenizer(vocab).decode(ids.tolist(), skip_special_tokens=False))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*names, "decoded"])

    return run


def decode(encoded: DataFrame, vocab: str) -> DataFrame:
    """The rows with a column ``decoded``: their ids looked up in the vocabulary's id-to-piece table and joined.

    The table is as large as the vocabulary file, whatever the input, so every task holds it: no shuffle. Null ids
    give null, an empty list an empty text.
    """
    rows = encoded.drop("decoded")
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(_decode(vocab, rows.columns), schema)
