"""Porter stems of single words in plain Python: what the column expressions are tested against."""

from __future__ import annotations

from functools import lru_cache

# Irregular words and the suffix rules of each step.
_IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
_PLURAL = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
_DERIVED = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"),
]
_ADJECTIVAL = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
    ("ness", ""),
]
_RESIDUAL = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
]


def _shape(word: str) -> str:
    """The word as a string of ``c`` and ``v``."""
    shape = ""
    for letter in word:
        vowel = letter in "aeiou" or (letter == "y" and shape.endswith("c"))
        shape += "v" if vowel else "c"
    return shape


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _short_end(word: str) -> bool:
    shape = _shape(word)
    return (shape.endswith("cvc") and word[-1] not in "wxy") or shape == "vc"


def _swap(word: str, rules, accept) -> str:
    """Apply the first rule whose suffix fits, if what remains is acceptable."""
    for suffix, new in rules:
        if word.endswith(suffix):
            left = word[: len(word) - len(suffix)]
            return left + new if accept(left) else word
    return word


def _past_and_progressive(word: str) -> str:
    if word.endswith("ied"):
        return word[:-3] + ("ie" if len(word) == 4 else "i")
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        left = word[: -len(suffix)]
        if word.endswith(suffix) and "v" in _shape(left):
            break
    else:
        return word
    if left.endswith(("at", "bl", "iz")):
        return left + "e"
    if len(left) > 1 and left[-1] == left[-2] and _shape(left)[-1] == "c":
        return left if left[-1] in "lsz" else left[:-1]
    return left + "e" if _measure(left) == 1 and _short_end(left) else left


def _derived(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _derived(word[:-2])
    if word.endswith("logi") and not any(word.endswith(suffix) for suffix, _ in _DERIVED):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return _swap(word, _DERIVED, lambda left: _measure(left) > 0)


def _residual(word: str) -> str:
    for suffix in _RESIDUAL:
        if word.endswith(suffix):
            left = word[: -len(suffix)]
            fits = suffix != "ion" or left[-1:] in ("s", "t")
            return left if fits and _measure(left) > 1 else word
    return word


@lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    if len(word) <= 2:
        return word
    if len(word) == 4 and word.endswith("ies"):
        word = word[:-1]
    else:
        word = _swap(word, _PLURAL, lambda left: True)
    word = _past_and_progressive(word)
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    word = _derived(word)
    word = _swap(word, _ADJECTIVAL, lambda left: _measure(left) > 0)
    word = _residual(word)
    if word.endswith("e"):
        size = _measure(word[:-1])
        if size > 1 or (size == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word
