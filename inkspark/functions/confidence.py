"""Translation confidence as one expression: an array of tags with reasons for each (source, translation) pair, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkspark.functions import text as X

# fixed values
FUNCTION_WORDS = """
a about after all am an and are as at be been but by can could did do does for from had has have he her hers him his i if in into is
it its me my not of on or our ours she should that the their theirs them they this those to under up us was we were with would you
your yours
""".split()
SINGLE_LEAK_WORDS = [w for w in FUNCTION_WORDS if w not in ("a", "i")]
CHATTER = (
    r"(?i)^\s*(?:translation|translated text|target text)\s*[:：]",
    r"^\s*(?:译文|翻译|翻译结果|目标文本)\s*[:：]",
    r"(?i)^\s*(?:here is|here's)\b.{0,40}\btranslation\b",
    r"^\s*(?:以下是|下面是).{0,16}(?:译文|翻译)",
    r"(?i)^\s*(?:as an ai|i(?:'|’)m sorry|sorry,?\s+i)\b",
    r"```",
)
CHINESE = ("zh", "zh-Hant")
LATIN_SOURCES = ("en", "de", "fr", "pl", "es", "it", "pt", "hu", "tr", "id", "vi")
KOREAN_WORDS = r"[\uac00-\ud7af\uffa0-\uffdc]"
JAMO = r"[\u1100-\u11ff\u3130-\u318f\ua960-\ua97f\ud7b0-\ud7ff]"
EMOTICON_JAMO = r"[\u314b\u314e\u3160\u315c]"
KANA_LETTERS = r"[\u3040-\u309a\u309d-\u309f\u30a0-\u30fa\u30fd-\u30ff\u31f0-\u31ff\uff66-\uff9f]"
LATIN_LETTERS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u1e00-\u1eff"
CYRILLIC_LETTERS = r"\u0400-\u052f\u1c80-\u1c8f\u2de0-\u2dff\ua640-\ua69f"
ARABIC_LETTERS = r"\u0620-\u063f\u0641-\u064a\u066e-\u066f\u0671-\u06d3\u06d5\u06e5-\u06e6\u06ee-\u06ef\u06fa-\u06fc\u06ff\u0750-\u077f\u0870-\u0887\u08a0-\u08c9\ufb50-\ufdff\ufe70-\ufefc"
#: by source language: letters, words and characters of a run that source and translation share
POLICIES = {**{x: (LATIN_LETTERS, 4, 20) for x in LATIN_SOURCES}, "ru": (CYRILLIC_LETTERS, 3, 18), "ar": (ARABIC_LETTERS, 3, 18)}
IDENTIFIER = r"(?i)\b(?:ISBN(?:-1[03])?|ISSN|DOI|EAN|ASIN)\b"


def length_ratio(src: Column, dst: Column) -> Column:
    return F.char_length(dst).cast("double") / F.greatest(F.char_length(src), F.lit(1)).cast("double")


def punctuation_delta(src: Column, dst: Column) -> Column:
    return F.abs(X.count_of(dst, X.PUNCTUATION) - X.count_of(src, X.PUNCTUATION))


def punctuation_limit(src: Column, limit: int, source: str | None, target: str | None) -> Column:
    if source in LATIN_SOURCES and target in CHINESE:
        return F.greatest(F.lit(limit), F.bround(X.count_of(src, X.PUNCTUATION) * 0.75)).cast("long")
    return F.lit(limit).cast("long")


def _unquoted(text: Column) -> Column:
    return F.regexp_replace(X.stripped(text), rf"(?:{X.CLOSING}|\s)+$", "")


def dangling_end(src: Column, dst: Column) -> Column:
    """The source ends a sentence, the translation in the middle of a word."""
    s, t = _unquoted(src), _unquoted(dst)
    return s.rlike(f"{X.SENTENCE_END}$") & (F.char_length(s) >= 6) & (F.char_length(t) >= 6) & t.rlike(r"[\p{L}\p{N}]$")


def lost_sentences(src: Column, dst: Column) -> Column:
    """Three or more sentence marks in the source, fewer than half of them in the translation."""
    n = X.count_of(src, X.SENTENCE_END)
    return (F.char_length(_unquoted(src)) >= 30) & (n >= 3) & (X.count_of(dst, X.SENTENCE_END) < n * 0.5)


def share(text: Column, pattern: str) -> Column:
    return X.count_of(text, pattern) / F.greatest(F.char_length(text), F.lit(1))


# fixed values: runs of Korean sounds, up to two syllables before each jamo
PHONETIC = r"[\uac00-\ud7a3]{0,2}[\u1100-\u11ff\u3130-\u318f\ua960-\ua97f\ud7b0-\ud7ff](?:[\uac00-\ud7a3]{0,2}[\u1100-\u11ff\u3130-\u318f\ua960-\ua97f\ud7b0-\ud7ff])*"


def without_kept_sounds(src: Column, dst: Column) -> Column:
    """A Chinese translation without the fragments of two to four characters that its source holds too, each taken as often as the source has it."""
    own = F.filter(F.regexp_extract_all(src, F.lit(PHONETIC), F.lit(0)), lambda f: F.char_length(f).between(2, 4))
    parts = F.regexp_extract_all(dst, F.lit(f"(?s){PHONETIC}|(?:(?!{PHONETIC}).)+"), F.lit(0))
    held = lambda of, f: F.size(F.filter(of, lambda x: x == f))
    kept = F.filter(F.transform(parts, lambda p, i: F.when(held(F.slice(parts, 1, i + 1), p) > held(own, p), p)), lambda p: p.isNotNull())
    return F.when(dst.rlike(X.CJK) & (F.size(own) > 0), F.array_join(kept, "")).otherwise(dst)


def residue(src: Column, dst: Column, source: str | None, target: str | None, keep_sounds: bool = False) -> Column:
    """Source language left in the translation: Korean words and jamo, kana, or, into Chinese, unbroken source script or a run of words that both share.

    keep_sounds: sounds that a Chinese translation keeps from its Korean source as they stand are not residue."""
    if source == "ko" and keep_sounds and target in CHINESE:
        dst = without_kept_sounds(src, dst)
    if source == "ko":
        has_cjk, jamo = dst.rlike(X.CJK), X.count_of(dst, JAMO)
        emoticons = (jamo == X.count_of(dst, EMOTICON_JAMO)) | (jamo == 1)
        return dst.rlike(KOREAN_WORDS) | ((jamo > 0) & ((~has_cjk & (share(dst, JAMO) > 0.1)) | (has_cjk & ~emoticons)))
    if source == "ja":
        return dst.rlike(KANA_LETTERS)
    if target in CHINESE and source in POLICIES:
        letters, words, chars = POLICIES[source]
        text = X.stripped(dst)
        n = X.count_of(text, f"[{letters}]")
        pure = (F.char_length(text) >= 12) & (n >= 8) & (n >= 0.35 * F.char_length(text)) & (share(text, X.CJK) < 0.1)
        a, b = (F.transform(F.regexp_extract_all(c, F.lit(f"([{letters}]+(?:['’-][{letters}]+)*)"), 1), F.lower) for c in (src, text))
        runs = lambda w: F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - words + 1, F.lit(1))), lambda i: F.slice(w, i, F.lit(words))), lambda x: (F.size(x) == words) & (F.char_length(F.array_join(x, "")) >= chars))
        return pure | F.arrays_overlap(runs(a), runs(b))
    return F.lit(False)


def preserved_title(src: Column, dst: Column, source: str | None, target: str | None) -> Column:
    """Short lines that may keep their Latin names and numbers: identifiers, titles most of whose tokens are the source's."""
    s, t = X.stripped(src), X.stripped(dst)
    if source in LATIN_SOURCES and target in CHINESE:
        return s.rlike(IDENTIFIER)
    short = (F.char_length(s) <= 120) & (F.char_length(t) <= 160)
    own = {"ko": X.HANGUL, "ja": KANA_LETTERS}.get(source)
    own = f"[{POLICIES[source][0]}]" if own is None and source in POLICIES else own
    a, b = (F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit("([A-Za-z0-9]+)"), 1), F.lower)) for x in (s, t))
    shared = F.size(F.array_intersect(a, b))
    title = short & (shared > 0) & (shared >= 0.6 * F.size(b)) & (t.rlike(X.CJK) | ((F.size(a) <= 6) & (F.size(b) <= 6) & s.rlike("[A-Z0-9]")))
    if own:
        title = title & (share(s, own) <= 0.25)
    return (s != "") & (t != "") & ~residue(src, dst, source, target) & (s.rlike(IDENTIFIER) | t.rlike(IDENTIFIER) | title)


def introduced_words(src: Column, dst: Column) -> Column:
    """ASCII words of the translation beyond those of the source, each as often as it is added."""
    pattern = F.lit(r"[A-Za-z]+(?:['’][A-Za-z]+)?")
    a, b = (F.transform(F.regexp_extract_all(x, pattern, 0), F.lower) for x in (src, dst))
    extra = lambda w: F.greatest(F.size(F.filter(b, lambda x: x == w)) - F.size(F.filter(a, lambda x: x == w)), F.lit(0))
    return F.flatten(F.transform(F.array_distinct(b), lambda w: F.array_repeat(w, extra(w))))


def function_word_leak(src: Column, dst: Column, source: str | None, target: str | None) -> Column:
    if source == "en" or target not in CHINESE:
        return F.lit(False)
    words = introduced_words(src, dst)
    of = lambda known: F.size(F.filter(words, lambda w: w.isin(*known)))
    some = of(FUNCTION_WORDS)
    return (dst.rlike(X.CJK) & (of(SINGLE_LEAK_WORDS) > 0)) | ((F.size(words) >= 3) & (some >= 2) & (some >= 0.4 * F.size(words)))


def weak_target(src: Column, dst: Column, target: str | None) -> Column:
    t = X.stripped(dst)
    expected = {"zh": share(t, X.CJK), "zh-Hant": share(t, X.CJK), "ko": share(t, X.HANGUL), "ja": share(t, KANA_LETTERS) + share(t, X.CJK)}.get(target)
    if expected is None:
        return F.lit(False)
    return (F.char_length(t) >= 20) & ~same_identifier(src, dst) & (share(t, "[A-Za-z]") >= 0.4) & (expected < 0.1)


def chatter(dst: Column) -> Column:
    found = F.lit(False)
    for pattern in CHATTER:
        found = found | dst.rlike(pattern)
    return found


def same_identifier(src: Column, dst: Column) -> Column:
    a, b = (F.lower(F.regexp_replace(x, r"[-\s:：|｜]", "")) for x in (src, dst))
    return X.is_identifier(src) & (a == b)


def echo(src: Column, dst: Column) -> Column:
    """Equal without white space and case, or nearly the same set of characters."""
    a, b = (X.small(F.regexp_replace(x, r"\s+", "")) for x in (src, dst))
    x, y = (F.array_distinct(F.split(v, "")) for v in (a, b))
    alike = F.size(F.array_intersect(x, y)) >= 0.92 * F.size(F.array_union(x, y))
    return (F.char_length(a) >= 8) & (F.char_length(b) >= 8) & ((a == b) | alike)


def verdict(src: Column, dst: Column, *, source: str | None = None, target: str | None = None, min_ratio: float = 0.25, max_ratio: float = 4.0, max_punctuation: int = 12) -> Column:
    """struct(low, reasons, tags): every rule that a pair breaks, in a fixed order. Null counts as empty."""
    src, dst = F.coalesce(src, F.lit("")), F.coalesce(dst, F.lit(""))
    ratio, delta, limit = length_ratio(src, dst), punctuation_delta(src, dst), punctuation_limit(src, max_punctuation, source, target)
    rule = lambda when, tag, reason: F.when(when, F.struct(F.lit(tag).alias("tag"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason")))
    rules = F.array(
        rule(ratio < min_ratio, "length_ratio_anomaly", F.format_string(f"length ratio %.2f < min {min_ratio:.2f}", ratio)),
        rule(ratio > max_ratio, "length_ratio_anomaly", F.format_string(f"length ratio %.2f > max {max_ratio:.2f}", ratio)),
        rule(delta > limit, "punctuation_anomaly", F.format_string("punctuation delta %d > max %d", delta, limit)),
        rule(dangling_end(src, dst), "truncated", "source ends a sentence, the translation in mid-text"),
        rule(~dangling_end(src, dst) & lost_sentences(src, dst), "truncated", "fewer than half of the sentence marks"),
        rule(residue(src, dst, source, target), "source_residue", "source language remains in the translation"),
        rule(function_word_leak(src, dst, source, target), "function_word_residue", "English function words in a Chinese translation"),
        rule(weak_target(src, dst, target), "target_language_weak", "target script is weak"),
        rule(chatter(dst), "model_chatter", "wrapper text remains in the translation"),
        rule(echo(src, dst), "verbatim_echo", "source and translation are too similar"),
    )
    broken = F.filter(rules, lambda x: x.isNotNull())
    none = F.array().cast("array<struct<tag:string,reason:string>>")
    empty = F.array(F.struct(F.lit("target_language_weak").alias("tag"), F.lit("empty translation").alias("reason")))
    # chatter is a fault even in a preserved title
    kept = F.when(preserved_title(src, dst, source, target), F.filter(broken, lambda x: x["tag"] == "model_chatter")).otherwise(broken) if source and target else broken
    found = F.when(X.stripped(src) == "", none).when(X.stripped(dst) == "", empty).when(same_identifier(src, dst), none).otherwise(kept)
    return F.struct((F.size(found) > 0).alias("low"), F.transform(found, lambda x: x["reason"]).alias("reasons"), F.array_distinct(F.transform(found, lambda x: x["tag"])).alias("tags"))
