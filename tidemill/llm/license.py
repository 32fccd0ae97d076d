"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemill.llm.common import LOWER, Rolling, Words, each_run, utf8
from tidemill.llm.license_texts import TEMPLATES

GRAM, WINNOW = 3, 3
COVERAGE = 0.8
_RUN = 4 << 20

#: Bytes between tokens: everything but letters, digits and the bytes of longer UTF-8 sequences.
_BETWEEN = np.array([not (chr(b).isascii() and chr(b).isalnum() or b >= 128) for b in range(256)])


def tokens(text: str) -> list[bytes]:
    return Words([utf8(text).translate(LOWER)], _BETWEEN).words()


def winnow(hashes: np.ndarray, window: int = WINNOW) -> np.ndarray:
    """Which hashes are the least of some ``window`` neighbours. Two sequences that share window + GRAM - 1 tokens
    in a row share a selected hash. Sequences shorter than a window select their least."""
    n = len(hashes)
    if n <= window:
        return hashes == hashes.min(initial=np.iinfo(np.uint64).max)
    least = np.lib.stride_tricks.sliding_window_view(hashes, window).min(axis=1)
    chosen = np.zeros(n, bool)
    for k in range(window):
        chosen[k : k + len(least)] |= hashes[k : k + len(least)] == least
    return chosen


@dataclass(frozen=True)
class Match:
    license: str
    first: int  # token of the text
    last: int
    matched: int
    length: int  # tokens of the template


class Index:
    """Fingerprints of templates: hash -> (template, place). Its size is that of the templates."""

    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.templates = {k: tokens(v) for k, v in templates.items()}
        found: dict[int, list[tuple[str, int]]] = {}
        for name, words in self.templates.items():
            if len(words) < GRAM:
                raise ValueError(f"template {name}: fewer than {GRAM} tokens")
            w = Words([b" ".join(words)], _BETWEEN)
            hashes = Rolling(w.hashes()[0][w.ids]).at(np.arange(len(words) - GRAM + 1), GRAM)
            for k in np.flatnonzero(winnow(hashes)).tolist():
                found.setdefault(int(hashes[k]), []).append((name, k))
        self.places = found
        self.number = {w: n for n, w in enumerate(sorted({w for words in self.templates.values() for w in words}))}
        self.coded = {k: np.array([self.number[w] for w in words], np.int64) for k, words in self.templates.items()}
        self.keys = np.array(sorted(found), np.uint64)

    def match(self, words: list[bytes], hits: list[tuple[int, int]]) -> list[Match]:
        """Matches of one text, given the (token, fingerprint hash) pairs found in it, in order of tokens.

        Where matches overlap, the one with more matched tokens stays, of equal ones that with the higher coverage, then the first.
        """
        diagonals: dict[str, set[int]] = {}
        for at, h in hits:
            for name, place in self.places[h]:
                diagonals.setdefault(name, set()).add(at - place)
        coded = np.array([self.number.get(w, -1) for w in words], np.int64)
        found: list[Match] = []
        for name, starts in diagonals.items():
            size, band, order = len(self.templates[name]), self.band(name), sorted(starts)
            low = order[0]
            for d, after in zip(order, [*order[1:], None]):
                if after is None or after - d > band:
                    found += self._within(name, coded, low - band, d + band, max(0, low - band), min(len(words), d + band + size))
                    low = after
        taken: list[Match] = []  # in order of place, none overlaps another
        for m in sorted(found, key=lambda m: (-m.matched, m.length, m.first, m.license)):
            k = bisect_left(taken, m.first, key=lambda t: t.first)
            if (k == 0 or taken[k - 1].last < m.first) and (k == len(taken) or m.last < taken[k].first):
                taken.insert(k, m)
        return taken

    def band(self, name: str) -> int:
        return 2 + len(self.templates[name]) // 8

    def _within(self, name: str, words: np.ndarray, low: int, high: int, begin: int, end: int) -> list[Match]:
        """The best match among tokens begin .. end - 1, and those beside it."""
        found, todo = [], [(begin, end)]
        while todo:
            i, j = todo.pop()
            best = align(self.coded[name], words, low, high, i, j) if (j - i) >= COVERAGE * len(self.templates[name]) else None
            if best and best[2] >= COVERAGE * len(self.templates[name]):
                found.append(Match(name, *best, len(self.templates[name])))
                todo += [(i, best[0]), (best[1] + 1, j)]
        return found


_FIRST, _SCORE = 21, 42


def align(template: np.ndarray, words: np.ndarray, low: int, high: int, begin: int, end: int) -> tuple[int, int, int] | None:
    """(first, last, matched) of the best local alignment of tokens begin .. end - 1 with text token - template token
    between ``low`` and ``high``.

    A match counts 2, a difference or gap -1; of equal scores more matches win, then the earlier start, then the earlier end.
    A cell holds score, matches and start as one number, so that a row is a few array operations: a gap along the row
    costs its length, and the best of all earlier cells less their distance is a running maximum.
    """
    if end <= begin:
        return None
    one, match = 1 << _SCORE, (2 << _SCORE) + (1 << _FIRST)
    fresh = (1 << _FIRST) - 1 - np.arange(end - begin)  # of equal cells, that with the earliest start is the largest
    above = np.zeros(end - begin + 1, np.int64)
    best, last = 0, -1
    for i, t in enumerate(template.tolist()):
        a, b = max(begin, low + i) - begin, min(end, high + i + 1) - begin
        row = np.zeros(end - begin + 1, np.int64)
        if a < b:
            before = above[a:b]
            same = words[begin + a : begin + b] == t
            step = np.where(same, np.where(before >= one, before, fresh[a:b]) + match, before - one)
            cells = np.maximum(step, above[a + 1 : b + 1] - one)
            cells[cells < one] = 0
            along = np.arange(b - a, dtype=np.int64) << _SCORE
            cells = np.maximum.accumulate(cells + along) - along
            cells[cells < one] = 0
            row[a + 1 : b + 1] = cells
            k = int(cells.argmax())
            if cells[k] > best:
                best, last = int(cells[k]), begin + a + k
        above = row
    if not best:
        return None
    return begin + (1 << _FIRST) - 1 - (best & ((1 << _FIRST) - 1)), last, best >> _FIRST & ((1 << _FIRST) - 1)


_SCHEMA = "license string, start long, end long, matched long, length long, coverage double"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """(key, license, start, end, matched, length, coverage), one row for each notice found.

    ``start`` and ``end`` are code points of the text; coverage is the share of the template's tokens that match
    in order, COVERAGE at least. A text may give several rows or none, which don't overlap; null and empty texts give none,
    an empty table an empty result. Rows with equal keys, and null keys, are scanned each; other columns are not read.
    """
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for t in each_run(batches, "text", _RUN):
            raw = [utf8(x.as_py()) for x in t.column("text")]
            words = Words([x.translate(LOWER) for x in raw], _BETWEEN)
            owner, rows = [], []
            for k, hits in _hits(words, index).items():
                i, j = words.starts[k], words.starts[k + 1]
                own = [words.vocab[w] for w in words.ids[i:j].tolist()]
                for m in index.match(own, hits):
                    a, b = words.begins[i + m.first] - words.edges[k], words.ends[i + m.last] - words.edges[k]
                    a, b = (len(raw[k][:x].decode("utf-8", "replace")) for x in (a, b))
                    owner.append(k)
                    rows.append((m.license, a, b, m.matched, m.length, m.matched / m.length))
            keys = t.column("key").combine_chunks().take(pa.array(owner, pa.int64()))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([keys, *columns], ["key", *(c.split()[0] for c in _SCHEMA.split(", "))])

    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return slim.mapInArrow(run, f"key {kind}, {_SCHEMA}").withColumnRenamed("key", key)


def _hits(words: Words, index: Index) -> dict[int, list[tuple[int, int]]]:
    """Selected hashes of each text that the index knows: text -> (token of the text, hash)."""
    sizes = np.diff(words.starts)
    counts = np.maximum(sizes - GRAM + 1, 0)
    if not counts.sum():
        return {}
    first = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - words.starts[:-1], counts)
    doc = np.repeat(np.arange(len(sizes)), counts)
    hashes = Rolling(words.hashes()[0][words.ids]).at(first, GRAM)
    known = np.isin(hashes, index.keys)
    out: dict[int, list[tuple[int, int]]] = {}
    for k in np.unique(doc[known]).tolist():
        i, j = np.searchsorted(doc, (k, k + 1))
        own = hashes[i:j]
        for p in np.flatnonzero(winnow(own) & known[i:j]).tolist():
            out.setdefault(k, []).append((p, int(own[p])))
    return out
