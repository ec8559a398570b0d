"""Snowball stemmers for English (Porter2) and Russian, from the published algorithm
descriptions. stem() leaves words of other languages as they are."""

from __future__ import annotations

import re
from functools import lru_cache

# --- English ---------------------------------------------------------------------------

# Fixed values of the published algorithm: exceptional forms and suffix tables.
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    **{w: w for w in "sky news howe atlas cosmos bias andes".split()},
}
_KEPT_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP1B = frozenset("eed eedly ed edly ing ingly".split())
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_STEP4 = frozenset("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split())

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_PREFIX = re.compile(r"gener|commun|arsen")
_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_VOWEL = re.compile(r"[aeiouy]")
_DOUBLE = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _ending(word: str, suffixes) -> str | None:
    """The same for sets of suffixes of up to seven letters, by one lookup a length."""
    for n in range(min(len(word), 7), 0, -1):
        if word[-n:] in suffixes:
            return word[-n:]
    return None


def _after_region(word: str, begin: int) -> int:
    m = _REGION.search(word, begin)
    return m.end() if m else len(word)


@lru_cache(maxsize=100_000)
def porter2(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", word.removeprefix("'"))
    m = _PREFIX.match(w)
    r1 = m.end() if m else _after_region(w, 0)
    r2 = _after_region(w, r1)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break

    # 1a: plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in _KEPT_AFTER_1A:
        return w

    # 1b: past and progressive forms
    s = _ending(w, _STEP1B)
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and _VOWEL.search(w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _DOUBLE.search(w):
            w = w[:-1]
        elif r1 >= len(w) and _SHORT_END.search(w):
            w += "e"

    # 1c: a final y
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"

    # 2 and 3: derivations in R1
    s = _ending(w, _STEP2)
    if s and len(w) - len(s) >= r1:
        before = w[: -len(s)]
        if s == "li":
            w = before if before[-1:] and before[-1] in "cdeghkmnrt" else w
        elif s != "ogi" or before.endswith("l"):
            w = before + _STEP2[s]
    s = _ending(w, _STEP3)
    if s and len(w) - len(s) >= r1 and (s != "ative" or len(w) - len(s) >= r2):
        w = w[: -len(s)] + _STEP3[s]

    # 4: endings in R2
    s = _ending(w, _STEP4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]

    # 5: a final e or l
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT_END.search(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


# --- Russian ---------------------------------------------------------------------------

_RU_VOWEL = re.compile("[аеиоуыэюя]")
_RU_REGION = re.compile("[аеиоуыэюя][^аеиоуыэюя]")
# Fixed values of the published algorithm: each group's endings; those of the first kind follow а or я.
_GERUND = ("в вши вшись".split(), "ив ивши ившись ыв ывши ывшись".split())
_ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
_PARTICIPLE = ("ем нн вш ющ щ".split(), "ивш ывш ующ".split())
_REFLEXIVE = "ся сь".split()
_VERB = (
    "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(),
    "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split(),
)
_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()


def _cut(part: str, second, first=()) -> str | None:
    """part without the longest ending; endings of `first` only count after а or я."""
    found = _longest(part, [*second, *(e for e in first if part.endswith(("а" + e, "я" + e)))])
    return None if found is None else part[: -len(found)]


@lru_cache(maxsize=100_000)
def russian(word: str) -> str:
    word = word.replace("ё", "е")
    m = _RU_VOWEL.search(word)
    if not m:
        return word
    head, rv = word[: m.end()], word[m.end() :]
    m = _RU_REGION.search(word)
    m = _RU_REGION.search(word, m.end()) if m else None
    r2 = m.end() if m else len(word)

    done = _cut(rv, _GERUND[1], _GERUND[0])
    if done is None:
        rv = rv if (x := _cut(rv, _REFLEXIVE)) is None else x
        if (x := _cut(rv, _ADJECTIVE)) is not None:
            done = x if (y := _cut(x, _PARTICIPLE[1], _PARTICIPLE[0])) is None else y
        elif (x := _cut(rv, _VERB[1], _VERB[0])) is not None:
            done = x
        else:
            done = _cut(rv, _NOUN)
    rv = rv if done is None else done
    rv = rv.removesuffix("и")
    w = head + rv
    for s in ("ость", "ост"):
        if rv.endswith(s) and len(w) - len(s) >= r2:
            rv = rv[: -len(s)]
            break
    if rv.endswith(("ейше", "ейш")):
        rv = rv[: -4 if rv.endswith("ейше") else -3]
        rv = rv[:-1] if rv.endswith("нн") else rv
    elif rv.endswith("нн"):
        rv = rv[:-1]
    else:
        rv = rv.removesuffix("ь")
    return head + rv


def stem(word: str, lang: str) -> str:
    """The stem, or the word itself where the language has no stemmer or nothing is left."""
    if lang == "english":
        return porter2(word) or word
    if lang == "russian":
        return russian(word) or word
    return word
