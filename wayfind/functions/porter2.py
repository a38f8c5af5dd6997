"""The English (Porter2) stemmer, from its published description."""

from __future__ import annotations

from functools import lru_cache

VOWELS = frozenset("aeiouy")
DOUBLES = frozenset(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"))
LI_BEFORE = frozenset("cdeghkmnrt")

# fixed values of the algorithm
WHOLE = {
    "skis": "ski",
    "skies": "sky",
    "dying": "die",
    "lying": "lie",
    "tying": "tie",
    "idly": "idl",
    "gently": "gentl",
    "ugly": "ugli",
    "early": "earli",
    "only": "onli",
    "singly": "singl",
    "sky": "sky",
    "news": "news",
    "howe": "howe",
    "atlas": "atlas",
    "cosmos": "cosmos",
    "bias": "bias",
    "andes": "andes",
}
AFTER_1A = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
STEP_2 = {
    "tional": "tion",
    "enci": "ence",
    "anci": "ance",
    "abli": "able",
    "entli": "ent",
    "izer": "ize",
    "ization": "ize",
    "ational": "ate",
    "ation": "ate",
    "ator": "ate",
    "alism": "al",
    "aliti": "al",
    "alli": "al",
    "fulness": "ful",
    "ousli": "ous",
    "ousness": "ous",
    "iveness": "ive",
    "iviti": "ive",
    "biliti": "ble",
    "bli": "ble",
    "fulli": "ful",
    "lessli": "less",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _region(word: str, start: int = 0) -> int:
    """Where what follows the first non-vowel after a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS and word[-1] not in "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = word.removeprefix("'")
    chars = list(w)
    for i, c in enumerate(chars):
        if c == "y" and (i == 0 or chars[i - 1] in VOWELS):
            chars[i] = "Y"
    w = "".join(chars)
    head = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(head) if head else _region(w)
    r2 = _region(w, r1)

    for e in ("'s'", "'s", "'"):  # 0
        if w.endswith(e):
            w = w[: -len(e)]
            break

    if w.endswith("sses"):  # 1a
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w

    e = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))  # 1b
    if e in ("eed", "eedly"):
        if len(w) - len(e) >= r1:
            w = w[: -len(e)] + "ee"
    elif e and any(c in VOWELS for c in w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:] in DOUBLES:
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"

    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:  # 1c
        w = w[:-1] + "i"

    e = _longest(w, (*STEP_2, "ogi", "li"))  # 2
    if e and len(w) - len(e) >= r1:
        if e == "ogi":
            w = w[:-1] if w.endswith("logi") else w
        elif e == "li":
            w = w[:-2] if len(w) > 2 and w[-3] in LI_BEFORE else w
        else:
            w = w[: -len(e)] + STEP_2[e]

    e = _longest(w, (*STEP_3, "ative"))  # 3
    if e and len(w) - len(e) >= r1:
        if e == "ative":
            w = w[:-5] if len(w) - 5 >= r2 else w
        else:
            w = w[: -len(e)] + STEP_3[e]

    e = _longest(w, (*STEP_4, "ion"))  # 4
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(e)]

    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):  # 5
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
