"""Exact substring deduplication with difference-cover anchors.

Only windows at positions whose place modulo PERIOD lies in a difference cover are hashed first. For any two
places of one long passage some shift below PERIOD puts both on the cover, so a repeated passage always shows as a
repeated anchor. Anchors found in one document only end the search; around the others every full window within
reach is compared, which extends each anchor to the whole passage.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import PACKED, U64, Block, Rolling, Words, answers, bucket_of, carried, columns, cut, pack, packed, width, with_answers

WINDOW = 50
#: A perfect difference set: every residue modulo 31 is a difference of two of the six.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
BLOCK = 8 << 20
_SECOND = 0xD1342543DE82EF95 | 1
_ENTRY = np.dtype([("h", "<u8"), ("g", "<u4"), ("id", "<i8")])


class _Text:
    """Words of a block with their rolling hashes."""

    def __init__(self, block: Block):
        self.words = Words(block.texts)
        self.starts = self.words.starts
        self.sizes = np.where(block.ids == Block.NO_ID, 0, np.diff(self.starts))
        n = self.starts[-1]
        self.doc = np.repeat(np.arange(len(block.texts)), np.diff(self.starts)) if n else np.zeros(0, np.int64)

    def rolling(self, which: int = 0) -> Rolling:
        return Rolling(self.words.hashes()[which][self.words.ids], Rolling.BASE if which == 0 else _SECOND)

    def anchors(self) -> np.ndarray:
        """Positions of all anchors: on the cover, counted from the document's first word, and inside it."""
        place = np.arange(self.starts[-1]) - self.starts[self.doc]
        covered = np.zeros(PERIOD, bool)
        covered[list(COVER)] = True
        return np.flatnonzero(covered[place % PERIOD] & (place + ANCHOR <= self.sizes[self.doc]) & (self.sizes[self.doc] >= WINDOW))

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of the full windows that hold a repeated anchor."""
        if not len(repeated):
            return repeated
        doc = self.doc[repeated]
        low = np.maximum(repeated - (PERIOD - 1), self.starts[doc])
        high = np.minimum(repeated, self.starts[doc] + self.sizes[doc] - WINDOW)
        fits = low <= high
        return np.flatnonzero(_covered(low[fits], high[fits] + 1, self.starts[-1]))


def _covered(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Which of 0 .. n-1 lie in some half-open range."""
    steps = np.bincount(low, minlength=n + 1) - np.bincount(high, minlength=n + 1)
    return np.cumsum(steps)[:n] > 0


def _groups(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin in sorted columns."""
    n = len(sorted_columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _split(entries: np.ndarray, keys: np.ndarray, buckets: int) -> list[bytes]:
    edges = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    return [entries[i:j].tobytes() for i, j in zip(edges, edges[1:])]


def _distinct_anchors(text: _Text) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions in order of hash, where each distinct hash begins among them, the hashes, which have two documents."""
    at = text.anchors()
    hashes = text.rolling().at(at, ANCHOR)
    order = np.argsort(hashes, kind="stable")
    at, hashes = at[order], hashes[order]
    first = _groups(hashes)
    last = np.append(first[1:], len(at)) - 1
    return at, first, hashes[first], text.doc[at[first]] != text.doc[at[last]] if len(at) else np.zeros(0, bool)


def _ask_anchors(buckets: int):
    def ask(block: Block) -> list[bytes]:
        _, _, hashes, twice = _distinct_anchors(_Text(block))
        entries = (hashes & U64(0xFFFFFFFE)).astype("<u4") | twice.astype("<u4")
        return _split(entries, hashes, buckets)

    return ask


def _anchor_replies(bodies: list[bytes]) -> list[bytes]:
    """One bit for each anchor asked about: two documents have it. Hashes cut to 31 bits within the bucket may
    call an anchor repeated that isn't, which only adds windows to compare."""
    parts = [np.frombuffer(b, "<u4") for b in bodies]
    entries = np.concatenate(parts)
    keys, inverse, counts = np.unique(entries >> 1, return_inverse=True, return_counts=True)
    repeated = counts > 1
    repeated[inverse[(entries & 1) == 1]] = True
    hits = np.split(repeated[inverse], np.cumsum([len(p) for p in parts])[:-1])
    return [len(h).to_bytes(8, "little") + np.packbits(h).tobytes() for h in hits]


def _bits(bodies: list[bytes]) -> np.ndarray:
    found = [np.unpackbits(np.frombuffer(b, np.uint8, offset=8), count=int.from_bytes(b[:8], "little")) for b in bodies]
    return np.concatenate([np.zeros(0, np.uint8), *found]).astype(bool)


def _distinct_windows(text: _Text, block: Block, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts in order of hash, where each distinct window begins among them, and (hashes, least id) of each."""
    h, g = text.rolling(0).at(at, WINDOW), (text.rolling(1).at(at, WINDOW) >> U64(32)).astype("<u4")
    order = np.lexsort((g, h))
    at, h, g = at[order], h[order], g[order]
    first = _groups(h, g)
    entries = np.zeros(len(first), _ENTRY)
    if len(first):
        entries["h"], entries["g"] = h[first], g[first]
        entries["id"] = np.minimum.reduceat(block.ids[text.doc[at]], first)
    return at, first, entries


def _window_starts(text: _Text, replies: list[bytes]) -> np.ndarray:
    at, first, _, _ = _distinct_anchors(text)
    hit = np.repeat(_bits(replies), np.diff(np.append(first, len(at))))
    return text.candidates(np.sort(at[hit]))


def _ask_windows(buckets: int):
    def use(number: int, block: Block, replies: dict[int, bytes]) -> pa.Table:
        text = _Text(block)
        _, _, entries = _distinct_windows(text, block, _window_starts(text, list(replies.values())))
        return pa.table(packed([(number, s, b"", q) for s, q in enumerate(_split(entries, entries["h"], buckets)) if q]))

    return use


def _window_replies(bodies: list[bytes]) -> list[bytes]:
    """One bit for each window asked about: it starts in a document with a smaller id than the block's own least."""
    parts = [np.frombuffer(b, _ENTRY) for b in bodies]
    entries = np.concatenate(parts)
    order = np.lexsort((entries["g"], entries["h"]))
    e = entries[order]
    first = _groups(e["h"], e["g"])
    least = np.repeat(np.minimum.reduceat(e["id"], first), np.diff(np.append(first, len(e))))
    less = np.zeros(len(e), bool)
    less[order] = least < e["id"]
    hits = np.split(less, np.cumsum([len(p) for p in parts])[:-1])
    return [len(h).to_bytes(8, "little") + np.packbits(h).tobytes() for h in hits]


def _removed(text: _Text, block: Block, anchors: list[bytes], windows: list[bytes]) -> np.ndarray:
    """Which words of the block go."""
    n = text.starts[-1]
    starts = _window_starts(text, anchors)
    if not len(starts):
        return np.zeros(n, bool)
    at, first, entries = _distinct_windows(text, block, starts)
    sizes = np.diff(np.append(first, len(at)))
    go = np.repeat(_bits(windows), sizes) | (block.ids[text.doc[at]] > np.repeat(entries["id"], sizes))
    return _covered(at[go], at[go] + WINDOW, n)


_PIECE = re.compile(rb"[^ \t-\r]+[ \t-\r]*")


def _finish(block: Block, anchors: list[bytes], windows: list[bytes], digest: bool) -> pa.Table:
    text = _Text(block)
    gone = _removed(text, block, anchors, windows)
    counts, removed, kept = np.diff(text.starts).tolist(), [], []
    for k, raw in enumerate(block.texts):
        out = gone[text.starts[k] : text.starts[k + 1]]
        removed.append(int(out.sum()))
        if digest:
            words = raw.split()
            if removed[-1]:
                words = [w for w, x in zip(words, out.tolist()) if not x]
            kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
        elif removed[-1]:
            kept.append(b"".join([w for w, x in zip(_PIECE.findall(raw), out.tolist()) if not x]).rstrip().decode("utf-8", "replace"))
        else:
            kept.append(raw.decode("utf-8", "replace"))
    ids = pa.array([None if i == Block.NO_ID else i for i in block.ids.tolist()], pa.int64())
    found = pa.table({"id": ids, "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())})
    if block.extra:
        for name, column in zip(carried(block).column_names, carried(block).columns):
            found = found.append_column(name, column)
    return found


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False, carry: Sequence[str] = (), block_bytes: int = BLOCK
) -> DataFrame:
    """(key, n_words, n_removed, kept, *carry) of every row; the key is an integer.

    A word goes if a run of 50 words of its document that covers it also starts in a document with a smaller key.
    ``kept`` is the text without such words and the white space after them, or, as ``digest``, the SHA-256 in hex of
    the words left, joined by one space. ``carry`` names columns to return besides. Null, empty and blank texts
    have no words and come back as empty or as they are. Rows with equal keys don't remove each other's words; a
    row with a null key keeps all and removes none. An empty table gives an empty result.
    """
    return _repeats(docs, key, text, digest, carry, block_bytes).toDF(key, "n_words", "n_removed", "kept", *carry)


def _repeats(docs: DataFrame, key: str, text: str, digest: bool, carry: Sequence[str], block_bytes: int) -> DataFrame:
    """(id, n_words, n_removed, kept, carried_0, carried_1, ...) of every row."""
    buckets = width(docs, text)
    blocks = pack(docs, key, text, block_bytes, _ask_anchors(buckets), carry)
    anchors = cut(answers(blocks, _anchor_replies))
    windows = answers(with_answers(blocks, anchors, _ask_windows(buckets), PACKED), _window_replies)
    both = anchors.union(windows.select("block", F.col("slot") + buckets, "body"))

    def use(number: int, block: Block, replies: dict[int, bytes]) -> pa.Table:
        return _finish(block, [b for s, b in replies.items() if s < buckets], [b for s, b in replies.items() if s >= buckets], digest)

    more = "".join(f", carried_{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry))
    return with_answers(blocks, both, use, f"id long, n_words long, n_removed long, kept string{more}")


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs``, same columns, with repeated passages cut out of ``text``; ``length``, where there is such a column,
    becomes the new number of code points. A null text comes back empty; otherwise as ``remove_repeats``, which says
    what happens to null and repeated keys. Other columns may have any name."""
    rest = columns(docs, (key, text))
    found = _repeats(docs, key, text, False, rest, BLOCK)
    new = {key.lower(): F.col("id").cast(docs.schema[key].dataType), text.lower(): F.col("kept")}
    new |= {c.lower(): F.length("kept").cast(docs.schema[c].dataType) if c.lower() == length.lower() else F.col(f"carried_{k}") for k, c in enumerate(rest)}
    return found.select(*(new[c.lower()].alias(c) for c in docs.columns))
