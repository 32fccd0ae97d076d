"""How a customer answers a preview: consent, refusal, question, other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions.unicode import nfkc

# Patterns of assent, refusal and doubt.
ASSENT_FIRST = r"^[\s\"'“”‘’(]*(?:(?:네|예|넵|넹|응)+(?![가-힣])|좋아요|좋습니다|그래요|그럼요|그렇게|맞아요|맞습니다|동의|알겠습니다|알겠어요)"
ASSENT = r"(?:진행|처리)(?:해|하여)?\s*(?:주세요|주십시오)|그렇게\s*(?:해|하)|부탁(?:해요|합니다|드려요|드립니다)|동의(?:합니다|해요)"
REFUSAL = r"아니|아뇨|아녜|(?<![가-힣])안\s*(?:돼|되|할|해|하)|하지\s*(?:않|마)|말고|마세요|싫|괜찮|필요\s*없|됐어|됐습|그만|보류"
DOUBT = r"않|말아|잠깐|잠시만|틀렸|틀려|다시|모르|몰라|\?"


def kind(text: Column) -> Column:
    """Any refusal or doubt rules consent out; then a word of assent at the start or a phrase of assent makes it.

    A null or blank text is 'other'.
    """
    said = F.trim(F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), "#+", " "))
    refused, doubted = said.rlike(REFUSAL), said.rlike(DOUBT)
    assented = (said != "") & (said.rlike(ASSENT_FIRST) | said.rlike(ASSENT))
    return F.when(assented & ~refused & ~doubted, "consent").when(refused, "refusal").when(said.contains("?"), "question").otherwise("other")
