"""Which legacy encoding a file is in: byte-pair models of the candidates, weighed on the whole file.

A model says how the characters of its scripts fall into byte ranges: the syllables of everyday Korean, kana and the first level of kanji, the
first level of Chinese characters, small letters of an alphabet. A candidate must decode every byte and encode back to the same ones; of those
the likeliest wins, and its share of all likelihoods is the confidence. Ties go to the candidate that stands first.

Each different word counts once, as a word that a text repeats says nothing new. Latin letters beyond ASCII are as often capitals as those of ASCII
around them, and are few among these; the letters of other scripts are most of a text's.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from math import exp, lgamma, log

#: what no range names has this mass
REST = 0.004


@dataclass(frozen=True)
class Range:
    """Characters of (first, last) lead and, for pairs, trail bytes, their share of a text's characters beyond ASCII."""

    share: float
    lead: tuple[int, int]
    trail: tuple[int, int] | None = None

    def holds(self, code: bytes) -> bool:
        if len(code) != (1 if self.trail is None else 2) or not self.lead[0] <= code[0] <= self.lead[1]:
            return False
        return self.trail is None or self.trail[0] <= code[1] <= self.trail[1]

    @property
    def size(self) -> int:
        return (self.lead[1] - self.lead[0] + 1) * (1 if self.trail is None else self.trail[1] - self.trail[0] + 1)


HIGH = (0xA1, 0xFE)
# fixed values: where the standards put their scripts; the shares are our own estimates of ordinary prose
PAIRS = {
    "cp949": (Range(0.93, (0xB0, 0xC8), HIGH), Range(0.03, (0xA1, 0xAC), HIGH), Range(0.02, (0xCA, 0xFD), HIGH), Range(0.01, (0x81, 0xC6), (0x41, 0xA0))),
    "cp932": (Range(0.50, (0x82, 0x82), (0x9F, 0xF1)), Range(0.12, (0x83, 0x83), (0x40, 0x96)), Range(0.26, (0x88, 0x97), (0x40, 0xFC)), Range(0.07, (0x81, 0x81), (0x40, 0xFC)), Range(0.03, (0x98, 0x9F), (0x40, 0xFC)), Range(0.01, (0xE0, 0xEA), (0x40, 0xFC))),
    "euc_jp": (Range(0.50, (0xA4, 0xA4), HIGH), Range(0.12, (0xA5, 0xA5), HIGH), Range(0.28, (0xB0, 0xCF), HIGH), Range(0.07, (0xA1, 0xA1), HIGH), Range(0.02, (0xD0, 0xF4), HIGH)),
    "gb18030": (Range(0.88, (0xB0, 0xD7), HIGH), Range(0.07, (0xA1, 0xA3), HIGH), Range(0.03, (0xD8, 0xF7), HIGH), Range(0.01, (0x81, 0xFE), (0x40, 0xA0))),
    "big5": (Range(0.45, (0xA4, 0xC6), (0x40, 0x7E)), Range(0.45, (0xA4, 0xC6), HIGH), Range(0.07, (0xA1, 0xA3), (0x40, 0xFE)), Range(0.01, (0xC9, 0xF9), (0x40, 0x7E)), Range(0.01, (0xC9, 0xF9), HIGH)),
}
#: single-byte candidates: first and last code point of their letters, how many are in use, and whether these have two cases
ALPHABETS = {
    "koi8-r": (0x400, 0x4FF, 32, True), "cp1251": (0x400, 0x4FF, 32, True), "cp874": (0xE00, 0xE7F, 60, False), "cp1256": (0x600, 0x6FF, 36, False),
    "cp1252": (0xC0, 0x17F, 32, True), "cp1250": (0xC0, 0x17F, 32, True), "cp1254": (0xC0, 0x17F, 32, True),
}
#: how often a letter beyond ASCII stands next to one of ASCII, and next to another beyond it, in Latin texts, in those of alphabets whose words have spaces around them, and in others
BESIDE = {"latin": (0.9, 0.15), "spaced": (0.0001, 0.95), "other": (0.002, 0.95)}
SPACED = ("koi8-r", "cp1251", "cp1256")
#: letters beyond ASCII and of ASCII before any is seen, in Latin texts and in others: a text's own shares weigh by the beta-binomial law, so that many letters can't outweigh everything else
SHARES = {True: (1.0, 8.0), False: (4.0, 0.3)}
#: the share of capitals before a letter of ASCII is seen, and for how many letters it counts
CAPITALS, SEEN = 0.06, 10
#: letters that point to one of the Latin candidates
OWN_LETTERS = {"cp1254": "ğĞışŞİ", "cp1250": "ąćęłńśźżĄĆĘŁŃŚŹŻőűŐŰčďěňřšťůžČĎĚŇŘŠŤŮŽ", "cp1252": "àâæçèêëîïñòôœùûÿãõåøÀÂÈÊÑÃÕ"}
#: those that Latin texts in any of them have most of
SHARED = "áäéíóöüß"
#: how often the letters of Russian stand in prose; those of other languages are rarer than all of them
CYRILLIC = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (
    0.110, 0.085, 0.080, 0.074, 0.067, 0.063, 0.055, 0.047, 0.045, 0.044, 0.035, 0.032, 0.030, 0.028, 0.026, 0.020, 0.019, 0.017, 0.017, 0.016, 0.016, 0.014, 0.012, 0.010, 0.009, 0.007, 0.006, 0.005, 0.004, 0.003, 0.003, 0.002, 0.002,
), strict=True))
CANDIDATES = (*PAIRS, *ALPHABETS)
BEYOND = r"[^\x00-\xbf\u2000-\u206f\u3000-\u303f\uff00-\uff20]"  # letters and marks, not punctuation
WORD = re.compile(r"[^ \t\n\v\f\r]+")
ASCII = re.compile("[A-Za-z]")
LETTER = re.compile(BEYOND)
MIXED = re.compile(rf"[A-Za-z](?={BEYOND})|(?<={BEYOND})[A-Za-z]")
STRAY = re.compile("(?<![\u0e01-\u0e2e\u0e31-\u0e3a\u0e47-\u0e4e])[\u0e31\u0e34-\u0e3a\u0e47-\u0e4e]")  # Thai marks above and below without a consonant
ALIKE = re.compile(rf"{BEYOND}(?={BEYOND})")


def _of_pair(name: str, char: str) -> float:
    code = char.encode(name)
    for r in PAIRS[name]:
        if r.holds(code):
            return log(r.share / r.size)
    return log(REST) - 5.5 * len(code)


def _of_letter(name: str, char: str, capitals: float) -> float:
    low, high, size, cased = ALPHABETS[name]
    if not (low <= ord(char) <= high and char.isalpha()) and not 0xE30 <= ord(char) <= 0xE4E:
        return log(REST / 40 if char.isprintable() else REST / 400)
    share = 0.9 if not cased or char.islower() else 0.06
    if name in OWN_LETTERS:
        share = 0.96 * (1 - capitals if char.islower() else capitals)
        share *= 0.75 if char in OWN_LETTERS[name] else 0.2 * size / len(SHARED) if char.lower() in SHARED else 0.2
    elif low == 0x400:
        share *= size * CYRILLIC.get(char.lower(), 0.002)
    return log(share / size)


def _of_shares(beyond: int, plain: int, a: float, b: float) -> float:
    """Log probability of letters in their order, so many beyond ASCII and so many of it."""
    beta = lambda x, y: lgamma(x) + lgamma(y) - lgamma(x + y)
    return beta(beyond + a, plain + b) - beta(a, b)


def likelihood(raw: bytes, name: str) -> tuple[float, str] | None:
    """(log likelihood of the characters beyond ASCII, the text), None where the encoding doesn't give the bytes back."""
    try:
        text = raw.decode(name)
        if text.encode(name) != raw:
            return None
    except UnicodeError:
        return None
    latin, words = name in OWN_LETTERS, "\n".join(dict.fromkeys(WORD.findall(text)))
    plain = ASCII.findall(words)
    capitals = (sum(c.isupper() for c in plain) + CAPITALS * SEEN) / (len(plain) + SEEN)
    of = (lambda c: _of_pair(name, c)) if name in PAIRS else (lambda c: _of_letter(name, c, capitals))
    beside = [len(x.findall(words)) for x in (MIXED, ALIKE)]
    chars = sum(n * of(c) for c, n in Counter(words).items() if c > "\x7f") + len(STRAY.findall(words)) * log(REST)
    return chars + sum(n * log(p) for n, p in zip(beside, BESIDE["latin" if latin else "spaced" if name in SPACED else "other"], strict=True)) + _of_shares(len(LETTER.findall(words)), len(plain), *SHARES[latin]), text


def detected(raw: bytes) -> tuple[str, str, float]:
    """(text, encoding, confidence). UTF-8 with or without a mark, UTF-16 with one, else the likeliest candidate; bytes that none decodes become replacement characters of UTF-8, with confidence 0."""
    try:
        return raw.decode("utf-8-sig"), "utf-8", 1.0
    except UnicodeDecodeError:
        pass
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        try:
            return raw.decode("utf-16"), "utf-16", 1.0
        except UnicodeDecodeError:
            pass
    weighed = [(found[0], -i, name, found[1]) for i, name in enumerate(CANDIDATES) if (found := likelihood(raw, name))]
    if not weighed:
        return raw.decode("utf-8", "replace"), "utf-8", 0.0
    best = max(weighed)
    return best[3], best[2], round(1 / sum(exp(max(-700.0, w[0] - best[0])) for w in weighed), 4)
