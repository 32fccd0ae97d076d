"""Unicode normal forms, which Spark has no function for, as Arrow-batched UDFs."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: A character that NFKC may change, alone or behind another one. The others are ASCII, Latin letters with their marks, Hangul
#: syllables, kana, most Chinese characters, and quotation marks and dashes.
UNSTABLE = "[^\\x00-\\x7F\\u00C0-\\u00FF\\uAC00-\\uD7A3\\u3041-\\u3096\\u30A1-\\u30FA\\u4E00-\\u9FEF\\u2013\\u2014\\u2018\\u2019\\u201C\\u201D]"
#: Texts that are made Python strings at a time.
_AT_ONCE = 64


def in_parts(texts: pa.Array, function: Callable[[list[str]], list[str]]) -> pa.Array:
    """Texts by a function of a few of them, which alone are Python strings at a time, whatever a batch holds; null stays null."""
    parts = [pa.array([], pa.string())]
    for k in range(0, len(texts), _AT_ONCE):
        some = texts[k : k + _AT_ONCE].to_pylist()
        done = iter(function([x for x in some if x is not None]))
        parts.append(pa.array([None if x is None else next(done) for x in some], pa.string()))
    return pa.concat_arrays(parts)


def _each(texts: pa.Array, form: str) -> pa.Array:
    """Texts in a normal form."""
    return in_parts(texts, lambda some: [unicodedata.normalize(form, x) for x in some])


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return _each(texts, "NFKC")


@F.arrow_udf(T.StringType())
def _nfd(texts: pa.Array) -> pa.Array:
    return _each(texts, "NFD")


def unsettled(text: Column) -> Column:
    """A text that NFKC may change, else null."""
    return F.when(F.rlike(text, F.lit(UNSTABLE)), text)


def nfkc(text: Column) -> Column:
    """Compatibility forms united: full-width digits become digits. Null stays null. What can't change is not sent to Python."""
    return F.coalesce(_nfkc(unsettled(text)), text)


def nfd(text: Column) -> Column:
    """Syllables as their letters, so that edit distance counts letters."""
    return _nfd(text)
