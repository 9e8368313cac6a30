"""Hangul functions: initial consonants ("chosung"), jamo composition, query class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITESPACE, col_of, let, strip, windows_of

# ---------------------------------------------------------------- fixed values
# Unicode order of Hangul jamo: a syllable is 0xAC00 + (initial*21 + vowel)*28 + final.
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FINALS = "ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
VOWEL_PAIRS = {
    "ㅗㅏ": "ㅘ", "ㅗㅐ": "ㅙ", "ㅗㅣ": "ㅚ",
    "ㅜㅓ": "ㅝ", "ㅜㅔ": "ㅞ", "ㅜㅣ": "ㅟ",
    "ㅡㅣ": "ㅢ",
}
FINAL_PAIRS = {
    "ㄱㅅ": "ㄳ", "ㄴㅈ": "ㄵ", "ㄴㅎ": "ㄶ",
    "ㄹㄱ": "ㄺ", "ㄹㅁ": "ㄻ", "ㄹㅂ": "ㄼ", "ㄹㅅ": "ㄽ", "ㄹㅌ": "ㄾ", "ㄹㅍ": "ㄿ", "ㄹㅎ": "ㅀ",
    "ㅂㅅ": "ㅄ",
}
DOMAIN_HINTS = (
    "사업", "계획", "지침", "보안", "검색", "개발", "솔루션", "연구",
    "데이터", "문서", "운영", "공고", "보고", "규정", "가이드",
)
JAMO_QUERY = "^[ㄱ-ㅎㅏ-ㅣ| ]+$"
CHOSUNG_QUERY = "^[ㄱ-ㅎ| ]+$"
# ------------------------------------------------------------------------------

_SYLLABLES = "".join(chr(c) for c in range(0xAC00, 0xD7A4))
_SYLLABLE_INITIALS = "".join(INITIALS[i // 588] for i in range(len(_SYLLABLES)))


def to_chosung(col: Column | str) -> Column:
    """Every Hangul syllable becomes its initial consonant, all else stays. One
    translate pass, skipped for texts without Hangul. Length is preserved."""
    text = F.coalesce(col_of(col), F.lit(""))
    return F.when(
        text.rlike("[가-힣]"), F.translate(text, _SYLLABLES, _SYLLABLE_INITIALS)
    ).otherwise(text)


def chosung_ngrams(col: Column | str, lo: int = 2, hi: int = 20) -> Column:
    """Distinct lo..hi-grams of the space-free, lower-case chosung form."""
    body = F.lower(F.replace(to_chosung(col), F.lit(" "), F.lit("")))
    grams = F.array(*[windows_of(body, n) for n in range(lo, hi + 1)])
    return F.array_distinct(F.flatten(grams))


def _alternatives(words) -> str:
    return "|".join(words)


_V = f"(?:{_alternatives(VOWEL_PAIRS)}|[{VOWELS}])"
_T = f"(?:{_alternatives(FINAL_PAIRS)}|[{INITIALS}])(?![{VOWELS}])"
# A syllable: optional initial, vowel (pairs first), optional final that is not the
# next syllable's initial. The regex engine's backtracking gives the look-ahead rule
# "a final moves on before a vowel". Runs without jamo stay whole, lone initials alone.
_CHUNK = f"(?s)[{INITIALS}]?{_V}(?:{_T})?|[^{INITIALS}{VOWELS}]+|."


def _lookup(table: dict[str, int], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _syllable(chunk: Column) -> Column:
    initial = F.regexp_extract(chunk, f"^([{INITIALS}]?)", 1)
    vowel = F.regexp_extract(chunk, f"({_V})", 1)
    final = F.regexp_extract(chunk, f"^[{INITIALS}]?{_V}(.*)$", 1)
    vowel_no = _lookup(
        {**{v: i for i, v in enumerate(VOWELS)},
         **{pair: VOWELS.index(v) for pair, v in VOWEL_PAIRS.items()}}, vowel)
    final_no = _lookup(
        {"": 0, **{f: i + 1 for i, f in enumerate(FINALS)},
         **{pair: FINALS.index(f) + 1 for pair, f in FINAL_PAIRS.items()}}, final)
    initial_no = F.when(initial == "", F.lit(INITIALS.index("ㅇ"))).otherwise(
        _lookup({c: i for i, c in enumerate(INITIALS)}, initial))
    # a consonant that can never be a final (such as ㄸ) is swallowed
    code = F.lit(0xAC00) + (initial_no * 21 + vowel_no) * 28 + F.coalesce(final_no, F.lit(0))
    return F.decode(F.unhex(F.hex(code)), "UTF-16BE")


def compose_jamo(col: Column | str) -> Column:
    """Compose typed jamo into syllables; spaces and bars are dropped, a leading
    vowel gets the silent initial."""
    body = F.regexp_replace(F.coalesce(col_of(col), F.lit("")), "[ |]", "")
    chunks = F.regexp_extract_all(body, F.lit(_CHUNK), F.lit(0))
    return F.array_join(
        F.transform(chunks, lambda c: F.when(c.rlike(f"[{VOWELS}]"), _syllable(c)).otherwise(c)), "")


def is_jamo_query(col: Column | str) -> Column:
    return col_of(col).rlike(JAMO_QUERY)


def is_chosung_query(col: Column | str) -> Column:
    return col_of(col).rlike(CHOSUNG_QUERY)


def is_name_like(col: Column | str) -> Column:
    """One all-Hangul word without any of the domain words."""
    return let(
        strip(F.coalesce(col_of(col), F.lit(""))),
        lambda q: q.rlike("^[가-힣]+$") & ~q.rlike(_alternatives(DOMAIN_HINTS)))


def classify_query(col: Column | str) -> Column:
    """Struct(is_jamo, is_chosung, is_name_like)."""
    return F.struct(
        is_jamo_query(col).alias("is_jamo"),
        is_chosung_query(col).alias("is_chosung"),
        is_name_like(col).alias("is_name_like"),
    )


def restore_jamo(col: Column | str) -> Column:
    """Composed form of a jamo-only query when that yields a syllable, else the query."""
    def restored(q: Column) -> Column:
        return let(F.when(is_jamo_query(q), compose_jamo(q)), lambda c: F.when(c.rlike("[가-힣]"), c).otherwise(q))

    return let(col_of(col), restored)
