"""Shared pieces: lineage cuts, vectorised word splitting, hashing, block packing.

A *block* is a run of documents held by one task, packed as one row. Operators that must look
something up for every position of every text first reduce a block to its distinct keys, deal those
keys out over hash buckets, and send one answer per (block, bucket) back. What is shuffled is thus
the distinct keys of a block, never positions, and no key meets more than one entry per block.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word split: space and the bytes 9 to 13.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

U64 = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for what all executors must see.

    Where none is named, a local session gets a temporary one; a cluster, whose machines don't share such a folder, an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tidemill-")
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared folder, so that a lost executor costs a read."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, of which later reads take the columns that they need."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tidemill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def columns(docs: DataFrame, but: Iterable[str] = ()) -> list[str]:
    """Names of the columns of ``docs`` but those named, in whatever case."""
    skip = {c.lower() for c in but}
    return [c for c in docs.columns if c.lower() not in skip]


def as_row(docs: DataFrame, name: str = "row") -> Column:
    """All columns of ``docs`` as one, so that names that an operator uses can't clash with theirs."""
    return F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias(name)


#: Bytes of text whose keys one hash bucket may have to answer for.
BUCKET = 64 << 20


def width(docs: DataFrame, text: str) -> int:
    """How many hash buckets keys are dealt over: the session's shuffle partitions, or more where a bucket would answer for
    more than BUCKET bytes of text. One pass over the lengths of the texts."""
    size = docs.agg(F.sum(F.octet_length(docs[text]))).first()[0] or 0
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; null counts as empty, a lone surrogate as a question mark."""
    return (text or "").encode("utf-8", "replace")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (splitmix finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Words:
    """The words of a run of texts: ``ids`` indexes ``vocab``; text k owns ``ids[starts[k]:starts[k + 1]]``.

    ``between`` says which bytes part words (a newline must); word w is at ``begins[w]`` to ``ends[w]`` of the texts
    joined by one byte, text k begins at ``edges[k]``.
    """

    def __init__(self, texts: Iterable[bytes], between: np.ndarray = _IS_SPACE):
        texts = list(texts)
        joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        space = between[joined]
        solid = ~space
        begins = np.flatnonzero(solid & np.concatenate(([True], space[:-1])))
        ends = np.flatnonzero(space & np.concatenate(([False], solid[:-1])))
        sizes = ends - begins
        offsets = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=offsets[1:])
        data = pa.py_buffer(joined[solid].tobytes())
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), data])
        coded = words.dictionary_encode()
        self.ids = coded.indices.to_numpy(zero_copy_only=False)
        self.vocab: list[bytes] = coded.dictionary.to_pylist()
        edges = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=edges[1:])
        self.starts = np.searchsorted(begins, edges)
        self.begins, self.ends, self.edges = begins, ends, edges
        self._digests: np.ndarray | None = None

    def words(self) -> list[bytes]:
        return [self.vocab[k] for k in self.ids.tolist()]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of every distinct word."""
        if self._digests is None:
            raw = b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in self.vocab)
            self._digests = np.frombuffer(raw, "<u8").reshape(-1, 2)
        return self._digests[:, 0], self._digests[:, 1]


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Polynomial hashes, modulo 2**64, of windows over a sequence of 64-bit word hashes.

    The word hashes are cryptographic digests, so windows of different words collide as random
    64-bit numbers do; positions are independent of the document that holds the window.
    """

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, values: np.ndarray, base: int = BASE):
        n = len(values)
        up = powers(base, n)
        self.down = powers(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values * up, out=self.sums[1:])

    def at(self, first: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the windows of ``length`` values that start at the positions ``first``."""
        return mix64((self.sums[first + length] - self.sums[first]) * self.down[first])


def each_run(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.Table]:
    """Regroups Arrow batches into tables with about ``limit`` bytes of text, at least one row each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
        start = 0
        for k, n in enumerate(lengths.tolist()):
            size += n + 1
            if size >= limit:
                held.append(batch.slice(start, k + 1 - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, k + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def deal(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts scrambled 64-bit keys into hash buckets: the order to apply and the edges of each bucket.

    The bucket is the high part of the key, so sorted keys are already in bucket order.
    """
    order = np.argsort(keys, kind="stable")
    edges = np.searchsorted(bucket_of(keys[order], buckets), np.arange(buckets + 1))
    return order, edges


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


#: Rows of a packed table: documents of a block (slot -1), or what a block asks a bucket (slot 0 and up).
PACKED = "block long, slot int, head binary, body binary"
_NO_ID = -(1 << 63)


class Block:
    """Documents of one block: ids (NO_ID for null), texts, and what an operator adds about them."""

    NO_ID = _NO_ID

    def __init__(self, ids: np.ndarray, texts: list[bytes], extra: bytes = b""):
        self.ids, self.texts, self.extra = ids, texts, extra

    @classmethod
    def of(cls, table: pa.Table) -> Block:
        ids = np.array([_NO_ID if x is None else x for x in table.column("id").to_pylist()], np.int64)
        return cls(ids, [utf8(x.as_py()) for x in table.column("text")])

    def pack(self) -> tuple[bytes, bytes]:
        lengths = np.array([len(t) for t in self.texts], np.int64)
        head = len(self.texts).to_bytes(8, "little") + self.ids.tobytes() + lengths.tobytes() + self.extra
        return head, zstandard.ZstdCompressor(level=3).compress(b"".join(self.texts))

    @classmethod
    def unpack(cls, head: bytes, body: bytes) -> Block:
        n = int.from_bytes(head[:8], "little")
        ids, lengths = np.frombuffer(head, np.int64, 2 * n, 8).reshape(2, n)
        joined, edges = zstandard.ZstdDecompressor().decompress(body), np.concatenate(([0], np.cumsum(lengths))).tolist()
        return cls(ids, [joined[i:j] for i, j in zip(edges, edges[1:])], head[8 + 16 * n :])


def packed(rows: list[tuple[int, int, bytes, bytes]]) -> dict[str, pa.Array]:
    kinds = {"block": pa.int64(), "slot": pa.int32(), "head": pa.binary(), "body": pa.binary()}
    return {name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds.items())}


def pack(docs: DataFrame, key: str, text: str, limit: int, ask: Callable[[Block], list[bytes]], carry: Sequence[str] = ()) -> DataFrame:
    """Packs documents into blocks of about ``limit`` bytes of text, without a shuffle, and materialises them.

    ``ask`` gives what the block asks each bucket (b'' for nothing). The columns ``carry`` stay with the block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, t in enumerate(each_run(batches, "text", limit)):
            number, block = (part << 32) + k, Block.of(t)
            questions = ask(block)
            block.extra = _to_ipc(t.drop_columns(["id", "text"])) if carry else b""
            rows = [(number, -1, *block.pack())] + [(number, s, b"", q) for s, q in enumerate(questions) if q]
            yield pa.RecordBatch.from_pydict(packed(rows))

    carried = [docs[c].alias(f"carried_{k}") for k, c in enumerate(carry)]
    return cut(docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text"), *carried).mapInArrow(run, PACKED))


def _to_ipc(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def carried(block: Block) -> pa.Table:
    """The columns that ``pack`` was told to carry."""
    return pa.ipc.open_stream(block.extra).read_all()


def answers(table: DataFrame, reply: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """What each bucket replies to each block that asked it: (block, slot, body)."""

    def run(t: pa.Table) -> pa.Table:
        bodies = reply([x.as_py() for x in t.column("body")])
        return pa.table({"block": t.column("block"), "slot": t.column("slot"), "body": pa.array(bodies, pa.binary())})

    asked = table.filter("slot >= 0").select("block", "slot", "body")
    return asked.groupBy("slot").applyInArrow(run, "block long, slot int, body binary")


def with_answers(table: DataFrame, replies: DataFrame, use: Callable[[int, Block, dict[int, bytes]], pa.Table], schema: str) -> DataFrame:
    """``use(number, block, replies in order of slot)`` for every block."""

    def run(own: pa.Table, got: pa.Table) -> pa.Table:
        block = Block.unpack(own.column("head")[0].as_py(), own.column("body")[0].as_py())
        replies = dict(sorted(zip(got.column("slot").to_pylist(), got.column("body").to_pylist())))
        return use(own.column("block")[0].as_py(), block, replies)

    blocks = table.filter("slot < 0").select("block", "head", "body")
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)
