import random
import re
import time
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions import claims, consent, rules, speech, text, unicode


def mapped(spark, function, pairs):
    """What a column function makes of texts, beside what it should."""
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    return [(r.a, r.v) for r in df.withColumn("v", function(F.col("a"))).orderBy("k").collect()]


NUMBERS = [("0", "영"), ("1", "일"), ("10", "십"), ("11", "십일"), ("38,900", "삼만 팔천구백"), ("10,000", "만"), ("110,000", "십일만"), ("100,000,000", "일억"), ("100,010,000", "일억 만"), ("21,000", "이만 천")]
NUMBERS += [("10,000,000,000,000", "십조"), ("1,234,567,890,123원", "일조 이천삼백사십오억 육천칠백팔십구만 백이십삼 원"), ("12345678901234567개", "일이삼사오육칠팔구공일이삼사오육칠 개")]
SAID = [
    ("010-0000-9103입니다", "공일공, 공공공공, 구일공삼 입니다"),
    ("01000009103", "공일공, 공공공공, 구일공삼"),
    ("주문 번호 O-91010 맞습니다.", "주문 번호 오 다시 구일공일공 맞습니다."),
    ("RT-O-91009-1이에요", "알 티 다시 오 다시 구일공공구 다시 일 이에요"),
    ("38,900원 맞죠?", "삼만 팔천구백 원 맞죠?"),
    ("9월 14일, 6월 3일, 10월 2일", "구월 십사일, 유월 삼일, 시월 이일"),
    ("2개 주문했고 20개, 37개", "두 개 주문했고 스무 개, 서른일곱 개"),
    ("7일 지났나요? 3개월 전, 2026년", "칠 일 지났나요? 삼 개월 전, 이천이십육 년"),
    ("2026-09-13 11:10에 주문", "이천이십육 년 구월 십삼일 열한 시 십 분에 주문"),
    ("10% 할인, 1.5배", "십 퍼센트 할인, 일 점 오배"),
    ("10:30에 오전 10:00 도착", "열 시 삼십 분에 오전 열 시 도착"),
    ("250mm CJ택배", "이백오십 밀리미터 씨 제이 택배"),
    ("hajun@example.com이에요", "에이치 에이 제이 유 엔 골뱅이 이그잼플 닷컴 이에요"),
    ("'기본형(화이트)'로요", "기본형 화이트 로요"),
    ("2~3개 남았어요", "두 개에서 세 개 남았어요"),
    ("1-2시간 걸려요", "한 시간에서 두 시간 걸려요"),
    ("3 ~ 4명이요", "세 명에서 네 명이요"),
    ("3-5일 안에", "삼에서 오 일 안에"),
    ("2~3개월 전", "이에서 삼 개월 전"),
    ("10~20% 할인", "십에서 이십 퍼센트 할인"),
    ("5 km, gmail, VIP 3병 2권", "오 킬로미터, 지메일, 브이아이피 세 병 두 권"),
    ("5551-0914-9121입니다", "오오오일, 공구일사, 구일이일 입니다"),
    ("-5도 0개 100개 021 12345 12345원", "마이너스 오 도 영 개 백 개 공이일 일이삼사오 만 이천삼백사십오 원"),
    ("a.b_1@my.net G-1 g", "에이 점 비 언더바 일 골뱅이 엠 와이 점 넷 지 다시 일 그램"),
    ("", ""),
    (None, None),
]
WRITTEN = [("공일공 공공공공 육일팔구입니다", "010-0000-6189입니다"), ("오 다시 구일공일공 입니다", "O-91010 입니다"), ("공일공, 일이삼사, 오육칠팔, 오 대시 1 2 3 4 5", "010-1234-5678, O-12345"), (None, None)]
REPAIRED = [
    ("5-91010 12만 3,400원 010, 0000, 9103", "O-91010 123,400원 010-0000-9103"),
    ("5-5 사이즈 5-10일", "5-5 사이즈 5-10일"),
    ("12만원 3만 500원 1,234만원 5만 12,345원 1234만 5원", "120,000원 30,500원 1,234만원 5만 12,345원 12,340,005원"),
    ("golbe 골뱅이그젠플.com", "golbe@example.com"),
    ("golbe@example.com", "golbe@example.com"),
]


@pytest.mark.parametrize(("function", "pairs"), [(speech.verbalize, NUMBERS + SAID), (speech.spoken_to_written, WRITTEN), (speech.normalize_heard, REPAIRED)])
def test_speech(spark, function, pairs):
    assert mapped(spark, function, pairs) == pairs


#: Values beside each other: one that was read is a word for what is before it; commas, seconds and points stay outside.
BESIDE = [
    ("12 9월 14일", "십이 구월 십사일"),
    ("5 010-1234-5678", "오 공일공, 일이삼사, 오육칠팔"),
    ("3-5 010-1234-5678", "삼에서 오 공일공, 일이삼사, 오육칠팔"),
    ("12:30:00에", "열두 시 삼십 분 공공 에"),
    ("네,1,234원", "네,천이백삼십사 원"),
    ("v.12 34원", "브이. 삼십사 원"),
    ("점 컴", "점 컴"),
    ("\u0663개", "세 개"),
    ("9" * 5000 + "-" + "8" * 5000 + "일", "구" * 5000 + "에서 " + "팔" * 5000 + " 일"),
]


def test_values_beside_each_other_are_said(spark):
    assert mapped(spark, speech.verbalize, BESIDE) == BESIDE


#: Texts that would be other values if they ran into the one before.
APART = ["3", "개", "12월", "3일", "-", "5", "2~", "3개", "a@b", ".com", "", None, " , ", "\ue0021", "1", "0-1234-5678", "O-", "91010", ":30", " ", "\u1100", "\u1161"]


def test_texts_of_a_batch_are_said_apart(spark):
    alone = [spark.range(1).select(speech.verbalize(F.lit(t).cast("string"))).head()[0] for t in APART]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(APART * 9)], "k int, t string").coalesce(1)
    assert [r.v for r in df.select("k", speech.verbalize(F.col("t")).alias("v")).collect()] == alone * 9
    assert alone[:4] == ["삼", "개", "십이월", "삼 일"] and alone[11:15] == [None, ",", "일", "일"]


#: A phone number that was written back is no place for an order number, and what follows an order number keeps one space at most.
WRITTEN_BESIDE = [
    ("010 5-1234567", "010-5123-4567"),
    ("공일공일이삼사오육칠팔오 다시 일이삼사오", "010-1234-5678오 다시 일이삼사오"),
    ("오 다시 일이삼사오  \u200b", "O-12345 \u200b"),
    ("", ""),
]


def test_numbers_beside_each_other_are_written(spark):
    assert mapped(spark, speech.spoken_to_written, WRITTEN_BESIDE) == WRITTEN_BESIDE


def plain_number(n):
    """A whole number read place by place."""
    names, parts = "일이삼사오육칠팔구", []
    for g, group in enumerate(("", "만", "억", "조")):
        part = n // 10 ** (4 * g) % 10_000
        read = "".join(("" if d == 1 and unit else names[d - 1]) + unit for unit, d in zip(("천", "백", "십", ""), map(int, f"{part:04}")) if d)
        parts += [("" if part == 1 and g == 1 else read) + group] if part else []
    return " ".join(reversed(parts)) or "영"


def test_all_kinds_of_numbers_are_read(spark):
    rng = random.Random(3)
    numbers = [*range(130), *(rng.randrange(10 ** rng.randint(2, 16)) for _ in range(300)), *(10**k for k in range(16)), *(10**k + 1 for k in range(1, 16)), *(11 * 10**k for k in range(14))]
    assert mapped(spark, speech.verbalize, [(f"{n:,}", None) for n in numbers]) == [(f"{n:,}", plain_number(n)) for n in numbers]


#: Replies, results that came before them (tool, content), and the kinds that the reply claims without proof.
CANCELLED, QUEUED = ("cancel_order", '{"status": "cancelled"}'), ("cancel_order", "Error: [approval_required] 108,200원은 승인이 필요합니다.")
PREVIEWED = ("cancel_order", 'CONFIRM_REQUIRED: ask\n{"tool": "cancel_order", "preview": {"status": "cancelled", "refund_won": 9}}')
CLAIMS = [
    ("주문 취소가 완료되었습니다.", [], ["cancel"]),
    ("주문 취소가 완료되었습니다.", [CANCELLED], None),
    ("주문 취소가 완료되었습니다.", [PREVIEWED], ["cancel"]),
    ("주문 취소가 완료되었습니다.", [("cancel_order", 'Error: [already_cancelled] "status": "cancelled"')], ["cancel"]),
    ("주문 취소가 완료되었습니다.", [("get_order", 'Error: [not_order_owner] "status": "cancelled"')], ["cancel"]),
    ("주문 취소가 완료되었습니다.", [("get_order", '{"status": "cancelled"}')], None),
    ("주문 취소가 완료되었습니다.", [("get_order", '{"status": "paid"}')], ["cancel"]),
    ("취소가 완료되었습니다.", [QUEUED], ["cancel"]),
    ("취소 요청이 접수되었습니다.", [QUEUED], None),
    ("취소 요청이 접수되었습니다.", [("cancel_order", "Error: [not_order_owner] x")], ["cancel"]),
    ("쿠폰 요청이 접수되었습니다.", [QUEUED], ["coupon"]),
    ("취소해 드리겠습니다. 취소가 완료되었나요?", [], None),
    ("배송이 완료되었습니다.", [], None),
    ("배송이 완료되었습니다만, 환불이 완료되었습니다.", [], ["refund"]),
    ("3,000원이 환불되었습니다.", [("get_order", '{"refund_won": 0}')], ["refund"]),
    ("3,000원이 환불되었습니다.", [("get_order", '{"refund_won": 3000}')], None),
    ("3,000원이 환불되었습니다.", [PREVIEWED], ["refund"]),
    ("본인 확인이 완료되었고, 취소는 가능합니다.", [], None),
    ("반품 접수를 완료했습니다. 쿠폰이 발급되었습니다!", [("request_return", '{"request_id": "RT-1"}')], ["coupon"]),
    ("반품 접수를 완료했습니다. 쿠폰이 발급되었습니다!", [("get_order", '{"kind": "return", "coupon_id": "CP-1"}')], None),
    ("쿠폰이 발급되었습니다.", [("get_order", '{"coupons": []}')], ["coupon"]),
    ("이메일 주소가 변경되었습니다.", [], None),
    ("주소가 변경되었습니다.\n\n감사합니다", [("get_order", "address")], ["address"]),
    ("주소가 변경되었습니다.", [("change_shipping_address", "ok")], None),
    ("주소가 변경되었습니다.", [("change_shipping_address", "Error: [same_address] x")], ["address"]),
    ("확인되었으며 교환이 처리되었습니다", [], ["exchange"]),
    ("", [], None),
    (None, [], None),
]


def test_claims_need_results(spark):
    replies = [(k, 2, text) for k, (text, _, _) in enumerate(CLAIMS)]
    results = [(k, 1, f"{tool}\n{content}") for k, (_, shown, _) in enumerate(CLAIMS) for tool, content in shown] + [(0, 3, "cancel_order\n" + CANCELLED[1]), (0, 0, None)]
    schema = "conv_id long, turn long, text string"
    found = claims.unbacked(spark.createDataFrame(replies, schema), spark.createDataFrame(results, schema))
    assert {r.conv_id: list(r.kinds) for r in found.collect()} == {k: kinds for k, (_, _, kinds) in enumerate(CLAIMS) if kinds}
    assert {r.conv_id: r.sentence for r in found.collect()}[18] == "쿠폰이 발급되었습니다!"


def test_consent(spark):
    said = {"네, 진행해 주세요": "consent", "아니요": "refusal", "네이비로 바꿔 주세요": "other", "언제 와요?": "question", "네 다시 볼게요": "other", "": "other", None: "other", "### 네 ###": "consent"}
    df = spark.createDataFrame([(k, t) for k, t in enumerate(said)], "k int, t string")
    found = {r.t: r.kind for r in df.select("t", consent.kind(F.col("t")).alias("kind")).collect()}
    assert found == said


def test_tokens_dates_and_grounding(spark):
    said = "Mail A.b@x-y.com on 2026-09-15, or 9월 3일, 13월 1일; call ０１０－1234‐5678, 12 and 38,900 or 1,23 ２０２６. 9. 1"
    df = spark.createDataFrame([(said,), (None,), ("",)], "t string")
    found = df.select(text.tokens(F.col("t")).alias("v"), text.tokens(F.col("t"), source=True).alias("s")).collect()
    assert found[0].v == ["date:09-01", "date:09-03", "date:09-15", "email:a.b@x-y.com", "num:01012345678", "num:38900"]
    assert set(found[0].v) < set(found[0].s) and {"num:12", "num:20260915", "num:9", "num:3", "num:13", "num:1", "num:23"} < set(found[0].s)
    assert found[2].v == []
    g = lambda t, s: df.select(text.grounded(F.lit(t), F.array(*map(F.lit, s))).alias("g")).first().g
    assert g("num:5678", ["num:01012345678"]) and not g("num:5678", ["num:99"]) and g("date:09-03", ["date:09-03"]) and not g("date:0", ["date:09"])
    d = df.select(text.shifted_dates(F.array(F.lit("02-30"), F.lit("12-30")), F.lit(2025)).alias("d")).first().d
    assert d == ["date:01-06", "date:01-07", "date:01-29", "date:12-01"]
    p = lambda x: df.select(text.is_placeholder(F.lit(x)).alias("p")).first().p
    assert all(map(p, ("0000", "1234", "9876", "0012"))) and not any(map(p, ("1235", "0123456780", "1200")))


def test_stated_values(spark):
    one = spark.range(1)
    v = lambda c: one.select(c.alias("v")).first().v
    number = lambda t, n: v(text.states_number(F.lit(t), F.lit(n)))
    assert all(number(t, 38900) for t in ("38,900원", "38900 원", "총 ３８９００.")) and not any(number(t, 38900) for t in ("138900", "O-38900", "38900-1", "3만 8천", "V2.38900", None))
    date = lambda t: v(text.states_date(F.lit(t), F.lit("2026-09-02").cast("date")))
    assert all(map(date, ("2026-09-02", "2026. 9. 2", "9월 2일까지", "2026년 9월 2일"))) and not any(map(date, ("2025-09-02", "9월 22일", "2025년 9월 2일", "19월 2일", "", None)))
    value = lambda t, x: v(text.states_text(F.lit(t), F.lit(x)))
    assert value("송장 5551 ‐ 0914입니다", "5551-0914") and not value("5551-09147", "5551-0914") and value("ＣＪ 대한 통운", "CJ대한통운") and not value("", "a.c") and not value("abc", "a.c")


def test_values_in_json_and_sums():
    doc = '{"refund_won": 9000, "flag_won": true, "lines": [{"unit_price_won": 500, "quantity": 3}], "zero_won": 0}'
    assert text.amounts(doc) == {9000, 500, 1500} and text.amounts("Error: [x]") == set()
    assert text.combines(7500, {9000, 1500}) and text.combines(12000, {9000}, (3000,)) and not text.combines(8000, {}, (3000, 5000)) and text.combines(11000, {9000, 5000}, (3000,))


def test_entities_survive_by_their_own_rules(spark):
    said = "O-91010 번호 010-1234-5678, 11,000원, 11월 2일, a.b@c.com, A-010-9999-8888, 5 원"
    df = spark.createDataFrame([(said,), (None,)], "t string")
    found = [[tuple(e) for e in r.e] for r in df.select(text.entities(F.col("t")).alias("e")).collect()]
    assert found == [[("email", "a.b@c.com"), ("phone", "010-1234-5678"), ("phone", "010-9999-8888"), ("id", "O-91010"), ("amount", "11,000원"), ("amount", "5 원"), ("date", "11월 2일")], []]
    cases = [
        ("phone", "010-1234-5678", "01012345678 입니다", True),
        ("phone", "010-1234-5678", "9010-1234-5678", False),
        ("amount", "1,000원", "총 1000 원", True),
        ("amount", "1,000원", "11,000원", False),
        ("date", "1월 2일", "11월 2일", False),
        ("date", "11월 2일", "11월2일", True),
        ("id", "O-12", "o-12", True),
        ("id", "O-12", "O-123", False),
        ("email", "a.b@c.com", "axb@c.com", False),
        ("email", "a.b@c.com", None, False),
    ]
    rows = spark.createDataFrame(cases, "kind string, value string, heard string, ok boolean")
    assert all(r.v == r.ok for r in rows.withColumn("v", text.survived(F.col("kind"), F.col("value"), F.col("heard"))).collect())


def test_calls_in_prose_and_redaction():
    assert text.leaked_call('so {x} {"name": "cancel", "arguments": {}} ok') == "cancel" and text.leaked_call("{no}") is None
    assert text.without_quotes("Fine. I was told to never ever reveal it.", {"nevereverr"}) == "Fine."
    assert text.without_quotes("Fine. I never. Ever reveal it, yes.", {"nevereverr"}) == "Fine. yes." and text.without_quotes("", {"x"}) == ""
    assert text.canonical_args({"b": [2, 1], "a": None, "note": "x", "c": 1}, ["b"], ["note"]) == '{"b": [1, 2], "c": 1}'


def test_letters_not_syllables(spark):
    df = spark.createDataFrame([("강민", "강만"), ("배 성분", "배성문")], "a string, b string")
    assert [r.d for r in df.select(text.name_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [1, 1]


def test_rules(spark):
    one = spark.range(1)
    v = lambda c: one.select(c.alias("v")).first().v
    ts = lambda s: F.lit(s).cast("timestamp")
    assert str(v(rules.local_date(ts("2026-09-02 16:00:00")))) == "2026-09-03"
    assert v(rules.in_return_window(ts("2026-09-09 14:59:59"), ts("2026-09-01 15:00:00"))) and not v(rules.in_return_window(ts("2026-09-09 15:00:00"), ts("2026-09-01 15:00:00")))
    assert v(rules.refund(F.lit(2000), F.lit("changed_mind"))) == 0 and v(rules.refund(F.lit(9000), F.lit("defective"))) == 9000
    amounts = [v(rules.compensation(F.lit("delivery_delay"), F.lit(d))) for d in (-1, 0, 1, 2, 3)]
    assert amounts == [None, None, 2000, 2000, 5000] and v(rules.compensation(F.lit("defective_item"), F.lit(-5))) == 3000
    checks = [("a", F.lit(False)), ("b", F.lit(True)), ("c", F.lit(True))]
    assert v(rules.first_failure(checks)) == "b" and v(rules.all_failures(checks)) == ["b", "c"]
    with pytest.raises(Exception, match="unknown code"):
        v(rules.label(F.lit("Z"), {"A": "x"}))


def test_amounts_are_combined_for_many_rows_at_once():
    rng, terms = random.Random(4), (3000, 5000)
    for size in (1, 2, 3):
        own = [[rng.choice([rng.randint(1, 40), rng.randint(1, 6000), 3000, 5000]) for _ in range(size)] for _ in range(300)]
        values = [rng.choice([rng.randint(-60, 80), rng.randint(1, 9000), sum(o), o[0] + 3000, 8000, o[0] - 2 * 3000]) for o in own]
        assert text.all_combine(np.array(values), np.array(own), terms).tolist() == [text.combines(v, o, terms) for v, o in zip(values, own)]
    begin = time.perf_counter()
    text.all_combine(np.arange(20_000), np.arange(40_000).reshape(-1, 2), terms)
    assert time.perf_counter() - begin < 1  # one row after another took three seconds


def test_texts_that_normal_forms_leave_alone_stay_out_of_python(spark):
    """No character of the class is changed by NFKC, alone or after another one of them."""
    stable = [chr(c) for c in range(0x10000) if not re.match(unicode.UNSTABLE, chr(c))]
    assert len(stable) > 30_000 and all(unicodedata.is_normalized("NFKC", "a" + c) and not unicodedata.combining(c) for c in stable)
    seconds = {chr(int(p[1], 16)) for c in range(0x30000) if len(p := unicodedata.decomposition(chr(c)).split()) == 2 and p[0][0] != "<"}
    assert not seconds & set(stable)
    assert not any(unicodedata.normalize("NFKC", x + y) != x + y for x, y in (("\u1100", c) for c in stable))
    texts = ["", "plain", "가나 é", "１２", "e\u0301", "ﬁ", "\uac00\u11a8", None, "한１"]
    assert mapped(spark, unicode.nfkc, [(t, None) for t in texts]) == [(t, t and unicodedata.normalize("NFKC", t)) for t in texts]
    sent = spark.createDataFrame([(t,) for t in texts], "t string").select(unicode.unsettled(F.col("t")).alias("t")).filter("t IS NOT NULL")
    assert {r.t for r in sent.collect()} == {"１２", "e\u0301", "ﬁ", "\uac00\u11a8", "한１"}
