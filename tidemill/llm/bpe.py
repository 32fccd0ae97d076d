"""Byte-level BPE: encoding with a heap of merge ranks over a doubly linked symbol list, and decoding."""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemill.llm.common import each_run

#: Fixed value: how the byte-level vocabulary splits text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Codec:
    """One vocabulary. Words met before are kept, up to ``remember`` of them; then the store starts anew."""

    def __init__(self, path: str, remember: int = 200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        self.first = [vocab[c] for c in letters]
        self.bytes: dict[int, bytes] = {i: bytes(value[c] for c in s) for s, i in vocab.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: s.encode() for s, i in self.added.items()}
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.split = regex.compile(SPLIT)
        self.remember, self.known = remember, {}

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one piece: always the lowest rank next, leftmost first among equals.

        Heap entries name the pair they were made for; one whose symbols have changed since is skipped.
        """
        ids = [self.first[b] for b in piece]
        n, merges = len(ids), self.merges
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(*found, k, ids[k], ids[k + 1]) for k in range(n - 1) if (found := merges.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, new, k, left, right = heapq.heappop(heap)
            j = after[k]
            if ids[k] != left or j >= n or ids[j] != right:
                continue
            ids[k], ids[j] = new, -1
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
                if found := merges.get((new, ids[after[j]])):
                    heapq.heappush(heap, (*found, k, new, ids[after[j]]))
            if before[k] >= 0 and (found := merges.get((ids[before[k]], new))):
                heapq.heappush(heap, (*found, before[k], ids[before[k]], new))
        return [i for i in ids if i >= 0]

    def ordinary(self, text: str, out: list[int]) -> None:
        known = self.known
        for piece in self.split.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8", "replace"))
                if len(piece) <= 64:
                    if len(known) >= self.remember:
                        known.clear()
                    known[piece] = ids
            out += ids

    def forget(self) -> None:
        """Gives back what was remembered: a worker outlives its task, and other stages need the memory."""
        self.known.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; strings of added tokens become their ids."""
        text, out, at = text or "", [], 0
        if self.cut:
            for m in self.cut.finditer(text):
                self.ordinary(text[at : m.start()], out)
                out.append(self.added[m.group()])
                at = m.end()
        self.ordinary(text[at:] if at else text, out)
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings one after another; bytes that aren't UTF-8 become U+FFFD, unknown ids nothing."""
        return b"".join([self.bytes.get(i, b"") for i in ids]).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(name: str) -> Codec:
    """The codec of a vocabulary file, kept for the life of the worker process: a path, or the name of a public
    tokenizer's file, which is looked up on the machine that uses it."""
    if name not in _CODECS:
        if "/" not in name:
            import public_tokenizers

            _CODECS[name] = Codec(str(public_tokenizers.path(name)))
        else:
            _CODECS[name] = Codec(name)
    return _CODECS[name]


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids): token ids of every whole text. Null and empty texts have no ids; rows stay one to one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for t in each_run(batches, "text", 2 << 20):
            ids = [c.encode(x.as_py()) for x in t.column("text")]
            yield pa.RecordBatch.from_arrays(
                [t.column("key").combine_chunks(), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32()))],
                ["key", "n_tokens", "ids"],
            )
        c.forget()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, n_tokens long, ids array<int>").withColumnRenamed("key", key)


def decode(tokens: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of a column of id arrays; a null array decodes to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for t in batches:
            texts = [c.decode(x.as_py() or []) for x in t.column("ids")]
            yield pa.RecordBatch.from_arrays([t.column("key"), pa.array(texts, pa.string())], ["key", "text"])

    kind = tokens.schema[key].dataType.simpleString()
    return tokens.select(tokens[key].alias("key"), tokens[ids].alias("ids")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def digests(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encodes and decodes each text, keeping digests only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        names = {i: str(i) for i in c.bytes}
        for t in each_run(batches, "text", 2 << 20):
            counts, coded, decoded = [], [], []
            for x in t.column("text"):
                ids = c.encode(x.as_py())
                counts.append(len(ids))
                coded.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                decoded.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [t.column("key").combine_chunks(), pa.array(counts, pa.int64()), pa.array(coded), pa.array(decoded)],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
