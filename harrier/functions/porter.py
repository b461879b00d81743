"""The Porter stemmer (M. F. Porter, 1980), from the published description."""

from __future__ import annotations

_VOWELS = frozenset("aeiou")

#: The suffixes of steps 2 to 4, longest match first within a step.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """``v`` or ``c`` for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in _VOWELS or ch == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    """How often a consonant follows a vowel."""
    return _shape(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replace(word: str, pairs: list[tuple[str, str]]) -> str:
    fits = max((p for p in pairs if word.endswith(p[0])), key=lambda p: len(p[0]), default=None)
    if fits and _measure(word[: -len(fits[0])]) > 0:
        return word[: -len(fits[0])] + fits[1]
    return word


class Stemmer(dict):
    """Maps words to stems and remembers them, up to ``limit``."""

    limit = 200_000

    def __call__(self, word: str) -> str:
        if len(self) > self.limit:
            self.clear()
        return self[word]

    def __missing__(self, word: str) -> str:
        self[word] = stem = self.stem(word)
        return stem

    @staticmethod
    def stem(word: str) -> str:
        if len(word) <= 2:
            return word
        if word.endswith("sses") or word.endswith("ies"):
            word = word[:-2]
        elif word.endswith("s") and not word.endswith("ss"):
            word = word[:-1]
        if word.endswith("eed"):
            if _measure(word[:-3]) > 0:
                word = word[:-1]
        else:
            cut = next((n for end, n in (("ed", 2), ("ing", 3)) if word.endswith(end) and _has_vowel(word[:-n])), 0)
            if cut:
                word = word[:-cut]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short(word):
                    word += "e"
        if word.endswith("y") and _has_vowel(word[:-1]):
            word = word[:-1] + "i"
        word = _replace(_replace(word, STEP2), STEP3)
        end = max((s for s in STEP4 if word.endswith(s)), key=len, default="")
        if end:
            rest = word[: -len(end)]
            if _measure(rest) > 1 and (end != "ion" or rest[-1:] in ("s", "t")):
                word = rest
        if word.endswith("e"):
            m = _measure(word[:-1])
            if m > 1 or m == 1 and not _short(word[:-1]):
                word = word[:-1]
        if word.endswith("ll") and _measure(word) > 1:
            word = word[:-1]
        return word
