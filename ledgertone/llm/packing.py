"""Packing by power-of-two lengths: no sequence holds two documents, and none needs padding."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import gather, tokenizer

#: A run of blanks and the word after it; what the byte-level tokenizer makes of it doesn't depend on its neighbours.
RUN = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+$")
BLANKS = frozenset(" \t\n\r")
#: Blanks other than those four can join a run across pieces, so such a text is encoded as a whole.
OTHER_BLANK = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Those below 128, which C code looks for in a text of such characters alone.
OTHER_ASCII = "\x0b\x0c\x1c\x1d\x1e\x1f"
#: Without any of these a text's runs begin at each blank, and no pattern is needed to cut them.
UNEVEN = ("\0", "\t", "\r", "  ", "\n\n", " \n", "\n ")
#: Runs that are encoded as one text, whose ids are then dealt back by the bytes they stand for.
JOINED = 256
#: Distinct runs a task remembers before it forgets all but those met most often.
MEMORY_RUNS = 1 << 19
#: Characters of text encoded together.
CHUNK_CHARS = 1 << 20


def has_other_blank(text: str) -> bool:
    return any(b in text for b in OTHER_ASCII) if text.isascii() else OTHER_BLANK.search(text) is not None


def runs_of(text: str) -> list[str]:
    """A text's runs in order; one that begins with a blank may have an empty run before it."""
    if any(u in text for u in UNEVEN):
        return RUN.findall(text)
    return text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")


class _Runs:
    """Ids of runs, each encoded once while it is remembered."""

    def __init__(self, vocab: str):
        self.tokens = tokenizer(vocab)
        # a byte-level piece has one character for each byte
        names = map(self.tokens.id_to_token, range(self.tokens.get_vocab_size()))
        self.bytes = np.fromiter((len(n or "") for n in names), np.int64)
        self.remember([], np.empty(0, np.int64))
        self.flat, self.starts, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def remember(self, runs: list[str], met: np.ndarray):
        # a counter, not the table's own length: a table that refers to itself would outlive its task
        self.number: defaultdict[str, int] = defaultdict(count(len(runs)).__next__, zip(runs, range(len(runs)), strict=True))
        self.met = met

    def forget(self):
        """Keep the runs met more than once, at most half as many as are remembered, those met most often."""
        kept = np.argsort(-self.met, kind="stable")[: MEMORY_RUNS // 2]
        kept = kept[self.met[kept] > 1]
        names = list(self.number)
        self.flat = gather(self.starts, self.sizes, self.flat, kept)
        self.sizes = self.sizes[kept]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.remember([names[i] for i in kept.tolist()], np.ones(len(kept), np.int64))

    def encode(self, runs: list[str]):
        """Encode new runs, many as one text where each begins at a blank and ends without one."""
        joint, alone = [], []
        for i, r in enumerate(runs):
            (joint if r and r[0] in BLANKS and r[-1] not in BLANKS else alone).append(i)
        starts, sizes, made, at = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64), [self.flat], len(self.flat)
        groups = [joint[k : k + JOINED] for k in range(0, len(joint), JOINED)]
        texts = ["".join([runs[i] for i in g]) for g in groups]
        for own, e in zip(groups, self.tokens.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            reach = np.cumsum(self.bytes[ids])
            ends = np.cumsum([len(runs[i]) if runs[i].isascii() else len(runs[i].encode()) for i in own])
            cuts = np.searchsorted(reach, ends)
            if not len(ids) or cuts[-1] != len(ids) - 1 or (reach[cuts] != ends).any():
                alone += own  # pieces that don't stand for their bytes
                continue
            sizes[own] = np.diff(cuts, prepend=-1)
            starts[own] = at + cuts + 1 - sizes[own]
            made.append(ids)
            at += len(ids)
        for i, e in zip(alone, self.tokens.encode_batch_fast([runs[i] for i in alone], add_special_tokens=False), strict=True):
            made.append(np.array(e.ids, np.uint32))
            starts[i], sizes[i] = at, len(made[-1])
            at += len(made[-1])
        self.flat = np.concatenate(made)
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])
        self.met = np.concatenate([self.met, np.zeros(len(runs), np.int64)])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > MEMORY_RUNS:
            self.forget()
        known, codes = self.number, []
        first = len(known)
        for text in texts:
            if has_other_blank(text):
                codes.append(None)
                continue
            runs = runs_of(text)
            codes.append(np.fromiter(map(known.__getitem__, runs), np.int64, len(runs)))
        self.encode(list(islice(known, first, None)))
        # the runs' ids of all texts at once, then each text's share
        every = np.concatenate([c for c in codes if c is not None] or [np.empty(0, np.int64)])
        self.met += np.bincount(every, minlength=len(self.met))
        flat, ends = gather(self.starts, self.sizes, self.flat, every), np.append(0, np.cumsum(self.sizes[every]))
        out, at = [], 0
        for text, c in zip(texts, codes, strict=True):
            if c is None:
                out.append(np.array(self.tokens.encode(text, add_special_tokens=False).ids, np.uint32))
            else:
                out.append(flat[ends[at] : ends[at + len(c)]])
                at += len(c)
        return out


def cut(length: int, most: int) -> list[int]:
    """Binary lengths of a document: as many of the largest as fit, then one for each set bit of the rest."""
    whole, rest = divmod(length, most)
    return [most] * whole + [1 << b for b in range(most.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pack(vocab: str, most: int, end_id: int, id_type: pa.DataType, with_ids: bool):
    longs = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    fields = [("id", id_type), *[(n, pa.int64()) for n in longs], ("bucket", pa.int32())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, number = _Runs(vocab), TaskContext.get().partitionId() << 40
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            at = 0
            while at < batch.num_rows:
                first, size, group = at, 0, []
                while at < batch.num_rows and size < CHUNK_CHARS:
                    group.append(texts[at].as_py() or "")
                    size += len(group[-1])
                    at += 1
                rows, of, flat = [], [], []
                for i, got in enumerate(runs.ids(group), first):
                    got = np.append(got, np.uint32(end_id)).astype("<u4")
                    start, total, flat_bytes = 0, len(got), memoryview(got).cast("B")
                    for length in cut(total, most):
                        crc = zlib.crc32(flat_bytes[4 * start : 4 * (start + length)])
                        rows.append((start, length, crc, total, number, 0))
                        of.append(i)
                        start += length
                        number += 1
                    flat.append(got)
                table = np.array(rows, np.int64).reshape(-1, 6)
                columns = [keys.take(pa.array(of, pa.int64())), *[pa.array(table[:, k]) for k in range(6)]]
                columns.append(pa.array(table[:, 1].astype(np.int32)))
                if with_ids:
                    cuts = np.zeros(len(table) + 1, np.int32)
                    np.cumsum(table[:, 1], out=cuts[1:])
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(flat).astype(np.int32))))
                yield pa.record_batch(columns, schema=schema)

    return run


def pack_documents(
    docs: DataFrame, vocab: str, most: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket and its ids.

    A document's ids and ``end_id`` are cut into pieces of power-of-two lengths, the largest first, at most ``most``
    (a power of two). Each piece is a sequence of its own, at offset 0: no sequence crosses documents and none needs
    padding. ``bucket`` is the length; a batch is filled from one bucket (``write_buckets``). Documents are
    independent, so nothing is shuffled. sequence_id is unique; it is made of the task and its running number.
    Null and empty texts give the end id alone; null and repeated ids are kept; an empty table gives no pieces.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("most must be a power of two")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType
    if isinstance(kind, T.NullType):
        rows, kind = rows.withColumn("id", F.col("id").cast("bigint")), T.LongType()
    arrow = pa.string() if isinstance(kind, T.StringType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.int64()
    schema = (
        f"id {kind.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
        "offset bigint, bucket int" + ", ids array<int>" * with_ids
    )
    return rows.mapInArrow(_pack(vocab, most, end_id, arrow, with_ids), schema).withColumnRenamed("id", id_col)


def write_buckets(packed: DataFrame, path: str) -> None:
    """Parquet with one folder per bucket, so that a reader fills each batch with sequences of one length."""
    packed.write.partitionBy("bucket").parquet(path)
