"""Claims of a finished action that no earlier result of the conversation shows.

Replies are taken apart into clauses, results into the kinds of action that they show, and the two meet in a join by
conversation and kind: what is compared are one row for each claimed kind and one for the first result of each kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of action, how a sentence names them and how a result shows them.
KINDS = {
    "cancel": (r"취소", r'"status": "cancelled"'),
    "return": (r"반품", r'"request_id": "RT-|"kind": "return"'),
    "exchange": (r"교환", r'"request_id": "EX-|"kind": "exchange"'),
    "address": (r"배송지|(?<!이메일 )(?<!이메일)주소", r"\Achange_shipping_address\n"),
    "coupon": (r"쿠폰", r'"coupon_id": "'),
    "ticket": (r"티켓", r'"ticket_id": "'),
    "handoff": (r"상담원", r'"handoff_id": "'),
    "refund": (r"환불", r'"refund_won": [1-9]|"status": "(cancelled|refund_pending|refunded)"'),
}
DONE = (
    r"(?:(?:완료|접수|처리|변경|발급|제출|등록|신청|연결|생성|진행|취소|반품|교환|환불)\s?(?:[가이를은는도]\s?)?"
    r"(?:되었|됐|했|하였|해\s?드렸|드렸|마쳤)|남겼|남겨\s?드렸|이루어졌)(?:습니다|어요|으며|고(?![가-힣]))"
)
RECEIVED = r"(접수|신청|등록)\s?(?:[가이를은는도]\s?)?(?:되었|됐|했|하였|해\s?드렸|드렸|마쳤)"
QUEUED, QUEUED_KINDS = r"\A(cancel_order|request_return)\nError: \[approval_required\]", {"cancel", "return", "refund"}
REFUSED, PREVIEW = r"\A[^\n]*\nError: \[", r"\A[^\n]*\nCONFIRM_REQUIRED"
SENTENCE_END, CLAUSE_END, DELIVERY = r"(?<=[.!?])\s+|\n+", r"(?<=[고며만데]),?\s+", r"배송[이은도]?\s*$"

#: Stands for a queued request among the kinds, and behind a word of completion.
_WAITING, _END = "queued", "\ue000"
_UNICODE = "(?U)"


def _named(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that occur in a text."""
    hits = [F.when(F.coalesce(text.rlike(_UNICODE + p), F.lit(False)), F.lit(name)) for name, p in patterns.items()]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def claimed(clause: Column) -> Column:
    """Kinds of action that a clause says are done: those named up to its first word of completion that has any before
    it. A delivery that is done is no action."""
    parts = F.split(F.regexp_replace(clause, f"({DONE})", f"$1{_END}"), _END)
    heads = F.transform(F.slice(F.sequence(F.lit(1), F.size(parts)), 1, F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), ""))
    acted = F.filter(heads, lambda h: ~h.rlike(rf"{DELIVERY.removesuffix('$')}(?:{DONE})\z"))
    kinds = F.transform(acted, lambda h: _named(h, {name: said for name, (said, _) in KINDS.items()}))
    return F.coalesce(F.get(F.filter(kinds, lambda x: F.size(x) > 0), F.lit(0)), F.array().cast("array<string>"))


def clauses(replies: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(*keys, at, part, sentence, kinds, received): the clauses of each text that claim something, in order. Questions
    claim nothing; ``received`` says that the clause speaks of a request that was taken in."""
    ends = F.split(F.coalesce(replies[text], F.lit("")), _UNICODE + SENTENCE_END)
    sentences = replies.select(*keys, F.posexplode(F.transform(ends, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))).alias("at", "sentence"))
    told = sentences.filter((F.col("sentence") != "") & ~F.col("sentence").endswith("?"))
    parts = told.select(*keys, "at", "sentence", F.posexplode(F.split("sentence", _UNICODE + CLAUSE_END)).alias("part", "clause"))
    found = parts.select(*keys, "at", "part", "sentence", claimed(F.col("clause")).alias("kinds"), F.col("clause").rlike(_UNICODE + RECEIVED).alias("received"))
    return found.filter(F.size("kinds") > 0)


def shown(results: DataFrame, conv: str, turn: str, result: str) -> DataFrame:
    """(conv, kind, since): the first turn whose result shows each kind, among them that a request was queued. A result
    is a tool's name, a line end and what it gave. Refused calls show nothing but that, and previews only what would be."""
    patterns = {name: proof for name, (_, proof) in KINDS.items()} | {_WAITING: QUEUED}
    nothing = F.col(result).rlike(PREVIEW) | (F.col(result).rlike(REFUSED) & ~F.col(result).rlike(QUEUED))
    each = results.filter(~nothing).select(F.col(conv), F.col(turn), F.explode(_named(F.col(result), patterns)).alias("kind"))
    return each.groupBy(conv, "kind").agg(F.min(turn).alias("since"))


def unbacked(replies: DataFrame, results: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", result: str = "text") -> DataFrame:
    """(conv, turn, sentence, kinds): the first sentence of each reply that claims something which no result of an earlier
    turn shows. One of the claimed kinds is enough; a queued request backs that one of QUEUED_KINDS was received."""
    said = clauses(replies, [conv, turn], text)
    waits = F.col("received") & F.arrays_overlap("kinds", F.array(*map(F.lit, sorted(QUEUED_KINDS))))
    asked = said.withColumn("kind", F.explode(F.when(waits, F.concat("kinds", F.array(F.lit(_WAITING)))).otherwise(F.col("kinds"))))
    met = asked.join(shown(results, conv, turn, result), [conv, "kind"], "left")
    by = met.groupBy(conv, turn, "at", "part", "sentence", "kinds").agg(F.coalesce(F.bool_or(F.col("since") < F.col(turn)), F.lit(False)).alias("backed"))
    first = by.filter("NOT backed").groupBy(conv, turn).agg(F.min(F.struct("at", "part", "sentence", "kinds")).alias("claim"))
    return first.select(conv, turn, "claim.sentence", "claim.kinds")
