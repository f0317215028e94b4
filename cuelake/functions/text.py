"""Column helpers for timed text: characters, sentence ends, times, lengths. All of them are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks, words and ranges that decide results.
CJK = r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{AC00}-\x{D7AF}\x{20000}-\x{2FA1F}\x{FF66}-\x{FF9D}]"
KEPT = r"[\p{L}\p{N}']"
STRONG = "。！？!?…‼⁉؟۔।॥;"
PERIODS = ".．"
CLOSERS = "」』”’\")】》〉"
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "sr", "sra", "jr", "st", "mt", "vs", "etc", "e.g", "i.e", "cf", "no", "vol", "fig", "inc", "ltd", "co", "corp", "dept", "approx", "u.s", "u.k", "a.m", "p.m", "hr", "fr", "hrn")
NEGATIONS = ("not", "no", "never", "n't", "dont", "don't", "cannot", "can't", "won't", "isn't", "aren't", "wasn't", "weren't", "didn't", "doesn't", "nothing", "nobody", "none", "nor", "ne", "pas", "nicht", "kein", "nunca", "nada")
CJK_NEGATIONS = "不沒没無无別别非未莫勿"
NEGATIVE_ENDINGS = ("ない", "ません", "なかった", "안", "못", "않", "없")
CJK_NUMERALS = "零〇一二三四五六七八九十百千萬万億亿兩两"
SCRIPTS = {"Japanese": "[぀-ヿ]", "Korean": "[가-힯]", "Thai": "[฀-๿]", "Arabic": "[؀-ۿ]", "Persian": "[؀-ۿ]", "Russian": "[Ѐ-ӿ]", "Hindi": "[ऀ-ॿ]", "Greek": "[Ͱ-Ͽ]"}
OTHER_SCRIPTS = ("Chinese", "Cantonese", *SCRIPTS)


def kept(text: Column) -> Column:
    """The letters, numbers and apostrophes of a text."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}']", "")


def kept_length(text: Column) -> Column:
    return F.length(kept(text))


def has_kept(text: Column) -> Column:
    return text.rlike(KEPT)


def alnum(text: Column) -> Column:
    """Lower-case letters and numbers alone: the form in which texts are compared."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def _held(text: Column, others: str) -> Column:
    """How many characters are left when runs of others go: far fewer matches than counting what stays, one by one."""
    return F.length(F.regexp_replace(text, others, ""))


def display_width(text: Column) -> Column:
    """CJK characters count 2, other kept ones and ? ! . , count 1, spaces 0.6, the rest nothing. Texts without CJK take no count of it."""
    mixed = 2 * F.regexp_count(text, F.lit(CJK)) + F.regexp_count(text, F.lit(rf"(?!{CJK})[\p{{L}}\p{{N}}'?!.,]"))
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(text.rlike(CJK), mixed).otherwise(_held(text, r"[^\p{L}\p{N}'?!.,]+")) + 0.6 * spaces


def without_closers(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s+$", ""), r"[」』”’\")】》〉]+$", "")


def ends_sentence(text: Column) -> Column:
    """A strong mark, or a period that closes no abbreviation and no single letter; two periods always count. Texts without such a mark are not looked into."""
    body = without_closers(text)
    tail = F.right(body, F.lit(1))
    word = F.lower(F.regexp_extract(body, r"([\p{L}.']+)\.$", 1))
    initial = (F.length(word) == 1) & word.rlike(r"\p{L}")
    period = tail.isin(*PERIODS) & (body.rlike(r"(\.\.|．．)$") | ~(word.isin(*ABBREVIATIONS) | initial))
    return F.when(~text.rlike(f"[{STRONG}{PERIODS}]"), F.lit(False)).otherwise((F.length(body) > 0) & (tail.isin(*STRONG) | period))


def estimated_tokens(text: Column) -> Column:
    """Characters from U+2E80 on count one, others a quarter, and one more."""
    far = _held(text, r"[^\x{2E80}-\x{10FFFF}]+")
    return far + F.floor((F.length(text) - far) / 4) + 1


def visible_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\s", ""))


def reading_limit(lang: Column) -> Column:
    """Characters a second from which a text is fast: 9 in Chinese, Cantonese, Japanese and Korean, 21 otherwise."""
    return F.when(lang.isin("Chinese", "Cantonese", "Japanese", "Korean", "zh", "yue", "ja", "ko"), 9.0).otherwise(21.0)


def reading_speed(text: Column, start: Column, end: Column) -> Column:
    return visible_length(text) / F.greatest(F.lit(0.1), end - start)


def negations(text: Column) -> Column:
    """How many words, characters and endings of a text negate. CJK is looked for only where one of its negating characters is."""
    word = "|".join(NEGATIONS)
    latin = F.regexp_count(F.lower(text), F.lit(rf"(?<![a-z'])(?:(?:{word})(?![a-z'])|[a-z']*n't(?![a-z']))"))
    firsts = "".join(dict.fromkeys(CJK_NEGATIONS + "".join(x[0] for x in NEGATIVE_ENDINGS)))
    endings = sum((F.regexp_count(text, F.lit(x)) for x in NEGATIVE_ENDINGS), F.lit(0))
    return latin + F.when(text.rlike(f"[{firsts}]"), F.regexp_count(text, F.lit(f"[{CJK_NEGATIONS}]")) + endings).otherwise(0)


def numbers(text: Column) -> Column:
    """The runs of digits, and each CJK numeral, as they come."""
    digits = F.regexp_extract_all(text, F.lit(r"[0-9]+"), F.lit(0))
    return F.when(text.rlike(f"[{CJK_NUMERALS}]"), F.concat(digits, F.regexp_extract_all(text, F.lit(f"[{CJK_NUMERALS}]"), F.lit(0)))).otherwise(digits)


def looks_like(text: Column, lang: Column) -> Column:
    found = F.lit(False)
    for name, script in SCRIPTS.items():
        found = F.when(lang == name, text.rlike(script)).otherwise(found)
    return F.coalesce(found, F.lit(False))


def letters(text: Column) -> Column:
    return _held(text, r"\P{L}+")


def latin_share(text: Column) -> Column:
    """ASCII letters among letters, null without letters."""
    return _held(text, "[^A-Za-z]+") / F.nullif(letters(text), F.lit(0))


def clearly_other_script(text: Column, lang: Column) -> Column:
    return lang.isin(*OTHER_SCRIPTS) & (letters(text) >= 8) & (latin_share(text) >= 0.85)


def right_to_left(text: Column) -> Column:
    """Whether the first character with a direction of its own is right-to-left."""
    rtl = r"\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}"
    return F.regexp_extract(text, rf"([{rtl}]|\p{{L}})", 1).rlike(f"[{rtl}]")


def clean_markup(text: Column, entities: bool = True) -> Column:
    """Formatting tags, inline times and {\\..} overrides go; of entities &amp; is read last."""
    out = F.regexp_replace(text, r"(?i)</?(i|b|u|s|font|c|v|lang|ruby|rt|span)([.\s][^>]*)?>|<\d+:[\d:.]+>", "")
    out = F.regexp_replace(out, r"\{\\[^}]*\}", "")
    if entities:
        for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"'), ("&apos;", "'"), ("&lrm;", ""), ("&rlm;", ""), ("&amp;", "&")):
            out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(out)


def join_lines(lines: Column) -> Column:
    """Lines in one, with no blank between two CJK edges."""
    glue = lambda a, b: F.when(F.right(a, F.lit(1)).rlike(CJK) & F.left(b, F.lit(1)).rlike(CJK), F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))
    return F.aggregate(lines, F.lit(""), lambda acc, x: F.when(acc == "", x).otherwise(glue(acc, x)))


def parse_time(text: Column) -> Column:
    """[H:]MM:SS[,.]fraction in seconds; null where it is none."""
    part = lambda i: F.regexp_extract(text, r"^\s*(?:(\d+):)?(\d{1,2}):(\d{1,2})(?:[.,](\d{1,3}))?", i)
    fraction = F.rpad(part(4), 3, "0").cast("int") / 1000
    value = F.coalesce(part(1).try_cast("int"), F.lit(0)) * 3600 + part(2).try_cast("int") * 60 + part(3).try_cast("int") + F.when(part(4) == "", 0.0).otherwise(fraction)
    return value.cast("double")


def parse_edit_time(text: Column) -> Column:
    """a, a:b or a:b:c to base 60, in seconds; null where a part is no number."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda x: F.trim(x).try_cast("double"))
    return F.when(F.size(parts) <= 3, F.aggregate(parts, F.lit(0.0), lambda acc, x: acc * 60 + x))


def format_time(seconds: Column, mark: str = ",") -> Column:
    ms = F.greatest(F.lit(0), F.round(seconds * 1000)).cast("long")
    pad = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
    return F.concat(pad(F.floor(ms / 3600000), 2), F.lit(":"), pad(F.floor(ms / 60000) % 60, 2), F.lit(":"), pad(F.floor(ms / 1000) % 60, 2), F.lit(mark), pad(ms % 1000, 3))


def expected_length(text: Column) -> Column:
    """Seconds that a text takes to say: 0.19 a CJK character, 0.075 another kept one, and 0.25."""
    wide = F.regexp_count(text, F.lit(CJK))
    return 0.19 * wide + 0.075 * (kept_length(text) - wide) + 0.25
