"""Quality rules by weak supervision, with DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Expectation-maximisation over the counts of
vote patterns estimates how often each rule casts each vote on good and on bad documents; the posterior
probability of good then decides, so that no single rule rejects a document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import SPACE, as_row, cut

#: Fixed value: frequent short words of English, French, German and Spanish.
STOP = (
    "the and of to in a is that for it as with was on are be this by an or from at not "
    "le la les de des du et un une en que qui pour dans sur par au avec est pas ne se "
    "der die das und ist ein eine nicht mit von zu den auf für im dem sich auch "
    "el los las y del una por con para es no lo su al como más se"
).split()

SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
LEAST_WORDS = 50


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeats(words: str) -> str:
    """SQL: words of an array that lie in 3-word windows found twice or more.

    Each window becomes one number, the high bits of its hash over the bits of its position, so that sorting
    plain numbers brings equal windows together; neighbours with equal high bits are compared word by word.
    Then each repeated window adds the words up to the next one, three at most. Memory is linear in the text.
    """
    windows = f"transform(slice({words}, 3, size({words}) - 2), (c, i) -> (xxhash64({words}[i], {words}[i + 1], c) & mask) | i)"
    same = " AND ".join(f"{words}[int(x & ~mask) + {k}] = {words}[int(y & ~mask) + {k}]" for k in range(3))
    twin = _let("get(s, i + {0})", "y", "y IS NOT NULL AND (x & mask) = (y & mask) AND " + same)
    found = f"filter(transform(s, (x, i) -> if({twin.replace('{0}', '1')} OR {twin.replace('{0}', '-1')}, int(x & ~mask), -1)), p -> p >= 0)"
    covered = _let(f"sort_array({found})", "q", "aggregate(transform(q, (p, i) -> least(3, coalesce(get(q, i + 1) - p, 3))), 0, (t, x) -> t + x)")
    repeated = _let(f"shiftleft(-1L, int(ceil(log2(size({words})))) + 1)", "mask", _let(f"sort_array({windows})", "s", covered))
    return f"if(size({words}) < 3, 0, {repeated})"


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of each text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop, n_upper
    (A to Z), n_marks (exclamation and question marks). A null text counts as empty; rows stay one to one."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP))
    words = _let(
        f"filter(split(body, '[{SPACE}]+'), w -> w <> '')".replace("\\x", "\\\\x"),
        "w",
        f"struct(size(w) AS n_words, length(array_join(w, '')) AS word_chars, {_repeats('w')} AS n_repeat_words, size(filter(w, x -> lower(x) IN ({stop}))) AS n_stop)",
    )
    lines = _let(
        "filter(split(body, '\\n', -1), l -> translate(l, ' \\t\\u000B\\f\\r', '') <> '')",
        "l",
        "struct(size(l) AS n_lines, size(l) - size(array_distinct(l)) AS n_dup_lines)",
    )
    marks = _let(
        "regexp_replace(body, '[^A-Z!?#*$%&|<>]+', '')",
        "m",
        "struct(length(regexp_replace(m, '[^A-Z]+', '')) AS n_upper, length(regexp_replace(m, '[^!?]+', '')) AS n_marks, length(m) AS n_all)",
    )
    counted = docs.select(docs[key].alias("id"), F.coalesce(docs[text], F.lit("")).alias("body")).select(
        "id", F.expr(words).alias("w"), F.expr(lines).alias("l"), F.expr(marks).alias("m")
    )
    nested = [F.col(f"w.{c}").cast("long").alias(c) for c in ("n_words", "word_chars", "n_repeat_words", "n_stop")]
    nested += [F.col(f"l.{c}").cast("long").alias(c) for c in ("n_lines", "n_dup_lines")]
    nested += [F.col(f"m.{c}").cast("long").alias(c) for c in ("n_upper", "n_marks")]
    return counted.select(F.col("id").alias(key), *nested, F.expr("m.n_all - m.n_upper - m.n_marks").cast("long").alias("n_symbols"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes by name, over the columns of ``features``; a document without words gets no votes."""
    n, chars = F.col("n_words"), F.col("word_chars")
    some, never = n > 0, F.lit(False)
    per_word = lambda c, k: F.col(c) * 100 >= n * k  # noqa: E731  at least k of 100 words
    return {
        "stop_words": _vote(some & per_word("n_stop", 8), some & ~per_word("n_stop", 4)),
        "symbols": _vote(some & ~per_word("n_symbols", 3), some & per_word("n_symbols", 15)),
        "upper_case": _vote(some & (F.col("n_upper") * 10 <= chars), some & (F.col("n_upper") * 2 > chars)),
        "marks": _vote(never, some & per_word("n_marks", 20)),
        "word_length": _vote(never, some & ((chars < 2 * n) | (chars > 14 * n))),
        "repeated_lines": _vote(never, F.col("n_dup_lines") * 10 > 3 * F.col("n_lines")),
        "repeated_words": _vote(never, some & per_word("n_repeat_words", 40)),
    }


#: What a vote says, in the order of a rule's chances.
VOTES = (-1, 0, 1)
#: Chances of VOTES on good and on bad documents before any is seen, and how many imagined documents of each class back them.
PRIOR, BACKED = ((0.05, 0.35, 0.6), (0.6, 0.35, 0.05)), 2.0
GOOD = 0.8


@dataclass(frozen=True)
class Model:
    """Share of good documents, and for each rule the chances of VOTES on good and on bad documents."""

    good: float
    chances: dict[str, tuple[tuple[float, ...], tuple[float, ...]]]

    def weights(self, name: str) -> tuple[float, ...]:
        """What each vote of a rule adds to the log odds of good: abstaining counts as it was seen to. A rule whose votes
        speak for the other side (more bad votes on good documents, or the reverse) has no say."""
        bad, none, good = (math.log(g / b) for g, b in zip(*self.chances[name]))
        return (bad, none, good) if bad <= 0 <= good else (0.0, 0.0, 0.0)

    def posterior(self, votes: dict[str, Column]) -> Column:
        """Probability of good given the votes."""
        log_odds = F.lit(math.log(self.good / (1 - self.good)))
        for name in self.chances:
            bad, none, good = self.weights(name)
            log_odds = log_odds + F.when(votes[name] > 0, good).when(votes[name] < 0, bad).otherwise(none)
        return F.lit(1.0) / (1 + F.exp(-log_odds))


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = 500, slack: float = 1e-7) -> Model:
    """Fits the model to counts of vote patterns (3 to the number of rules of them at most, whatever the corpus).

    Every rule has chances of its own for a good vote, a bad vote and none, on good and on bad documents, so that a
    rule that only ever votes bad is judged by how much more often it does so on bad documents. PRIOR, as imagined
    documents, says which class is which, and keeps chances of votes that nobody cast above zero.
    """
    k = len(names)
    good, chances = GOOD, [PRIOR] * k
    patterns = sorted((tuple(VOTES.index(v) for v in votes), count) for votes, count in patterns)
    for _ in range(rounds):
        logs = [[math.log(g / b) for g, b in zip(*c)] for c in chances]
        start = math.log(good / (1 - good))
        tally = [([BACKED * p for p in PRIOR[0]], [BACKED * p for p in PRIOR[1]]) for _ in range(k)]
        total, mass = BACKED, BACKED * GOOD
        for votes, count in patterns:
            odds = start + sum(w[v] for w, v in zip(logs, votes))
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            total, mass = total + count, mass + count * p
            for v, (on_good, on_bad) in zip(votes, tally):
                on_good[v] += count * p
                on_bad[v] += count * (1 - p)
        new = [tuple(tuple(x / sum(side) for x in side) for side in t) for t in tally]
        share = mass / total
        moved = max([abs(share - good), *(abs(x - y) for n, o in zip(new, chances) for p, q in zip(n, o) for x, y in zip(p, q))])
        good, chances = share, new
        if moved < slack:
            break
    return Model(good, dict(zip(names, chances)))


def fit(counted: DataFrame) -> Model:
    """Counts the vote patterns of all rows of ``features`` that the base rules leave, and fits the model to them."""
    votes = rules()
    names = list(votes)
    rows = counted.filter(~base_failed()).select(*(v.alias(k) for k, v in votes.items())).groupBy(*names).count().collect()
    return expectation_maximisation([(tuple(r[n] for n in names), r["count"]) for r in rows], names)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def judge(counted: DataFrame, model: Model | None = None) -> DataFrame:
    """``counted`` with base_failed, posterior and kept after its columns. An empty table gives an empty result."""
    if model is None:
        counted = cut(counted)
        model = fit(counted)
    failed = counted.withColumn("base_failed", base_failed()).withColumn("posterior", model.posterior(rules()))
    return failed.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


#: Rejected documents (16 bytes each) up to which their list is broadcast; a longer one is joined by key.
BROADCAST_MOST = 1_000_000


def keep(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are kept, columns and repeated rows unchanged, whatever the columns' names.

    The model is fitted to all of them first; texts are counted once, and what waits for the verdict is a row of counts
    for each document, told by its key and a 64-bit hash of its text, as equal texts have equal counts. A null text counts
    as empty and goes; null keys are keys like others. An empty table gives an empty result.
    """
    told = docs.select(as_row(docs), docs[key].alias("of"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("hash"), docs[text].alias("body"))
    counted = features(told.select(F.struct("of", "hash").alias("told"), "body"), "told", "body")
    gone = cut(judge(counted).filter("NOT kept").select(F.col("told.of").alias("gone"), F.col("told.hash").alias("gone_hash")).distinct())
    if gone.count() <= BROADCAST_MOST:
        gone = F.broadcast(gone)
    return told.join(gone, F.col("of").eqNullSafe(F.col("gone")) & (F.col("hash") == F.col("gone_hash")), "left_anti").select("row.*")
