"""Porter stems of the distinct vocabulary: folded and stemmed once per word, then joined to postings.

``add_stems`` writes the rules as SQL over a relation of words; ``stem`` is the same for words that the
driver knows (parsed queries). As in the index that is matched, a word of fewer than 3 or more than 64
characters has no other stem than itself, and Latin letters lose their marks first.
"""

from __future__ import annotations

import re
import unicodedata

from evidentia.functions.dialect import Pipe

VOWEL = re.compile(r"[aeiou]")
# The published rules of steps 2, 3 and 4.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(w: str) -> str:
    """Consonants and vowels of a word as c and v."""
    out = ""
    for i, x in enumerate(w):
        out += "v" if x in "aeiou" or (x == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _short(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _latin() -> dict[str, str]:
    """Marked lower-case Latin letters and the plain letters under their marks."""
    found = {}
    for c in map(chr, (*range(0xE0, 0x250), *range(0x1E00, 0x1F00))):
        plain = unicodedata.normalize("NFD", c)[0]
        if plain != c and plain.isascii() and plain.islower() and c.islower():
            found[c] = plain
    return found


LATIN = _latin()
MARKS = "".join(map(chr, range(0x300, 0x332)))


def fold(w: str) -> str:
    return "".join(LATIN.get(c, c) for c in w.lower() if c not in MARKS)


def stem(w: str) -> str:
    if not 3 <= len(w) <= 64:
        return w
    if len(w) > 3 and w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if len(w) > 3 and w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif (m := re.fullmatch(r"(.*)(?:ed|ing)", w)) and "v" in _shape(m[1]):
        w = m[1]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP2, STEP3):
        end = next((e for e in sorted(rules, key=len, reverse=True) if w.endswith(e)), None)
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + rules[end]
    end = next((e for e in sorted(STEP4, key=len, reverse=True) if w.endswith(e)), None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


# The same rules as patterns over a word whose first y, if it is the first letter, is a Y (a consonant).
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_ANY, _SHORT = f"^(?:{_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"
_SOME, _ONE, _MANY = f"^(?:{_C})?{_V}{_C}", f"^(?:{_C})?{_V}{_C}(?:{_V})?$", f"^(?:{_C})?{_V}{_C}{_V}{_C}"


def add_stems(p: Pipe, name: str, source: str) -> str:
    """Relation ``name`` (word, folded, stem) of the words of ``source`` (word: distinct, lower-case)."""
    d = p.d
    less = lambda n: f"left(w, length(w) - {n})"
    ends = lambda s: d.ends("w", d.lit(s))

    def longest(rules: dict[str, str], where: str) -> str:
        """The longest ending that a word has is replaced where what stands before it matches."""
        cases = (f"when {ends(s)} then case when {d.matches(less(len(s)), where)} then {less(len(s))} || {d.lit(rules[s])} else w end" for s in sorted(rules, key=lambda s: (-len(s), s)))
        return f"case {' '.join(cases)} else w end"

    step = lambda n, w, **new: p.columns(f"{name}_{n}", f"{name}_{n - 1}", keep="word, folded", w=w, **new)
    folded = f"translate(word, {d.lit(''.join(LATIN) + MARKS)}, {d.lit(''.join(LATIN.values()))})"
    p.columns(f"{name}_f", source, keep="word", folded=f"case when {d.matches('word', '[^a-z0-9]')} then {folded} else word end")
    p.columns(f"{name}_0", f"{name}_f", keep="word, folded", w="case when left(folded, 1) = 'y' then 'Y' || substring(folded, 2) else folded end")
    step(1, f"case when length(w) > 3 and ({ends('sses')} or {ends('ies')}) then {less(2)} when {ends('s')} and not {ends('ss')} then {less(1)} else w end")
    cut = "w = '' or cut = w"
    p.columns(f"{name}_2", f"{name}_1", keep="word, folded, w", cut=f"case when {ends('eed')} and length(w) > 3 then w when {ends('ed')} and {d.matches(less(2), _ANY)} then {less(2)} when {ends('ing')} and {d.matches(less(3), _ANY)} then {less(3)} else w end")
    eed = f"case when {ends('eed')} and length(w) > 3 and {d.matches(less(3), _SOME)} then {less(1)} else w end"
    double = "left(right(cut, 2), 1) = right(cut, 1) and length(cut) > 1 and right(cut, 1) not in ('a', 'e', 'i', 'o', 'u', 'l', 's', 'z')"
    again = f"case when right(cut, 2) in ('at', 'bl', 'iz') then cut || 'e' when {double} then left(cut, length(cut) - 1) when {d.matches('cut', _SHORT)} then cut || 'e' else cut end"
    step(3, f"case when {cut} then {eed} else {again} end")
    step(4, f"case when {ends('y')} and {d.matches(less(1), _ANY)} then {less(1)} || 'i' else w end")
    step(5, longest(STEP2, _SOME))
    step(6, longest(STEP3, _SOME))
    plain = longest({s: "" for s in STEP4}, _MANY)
    step(7, plain.replace(f"when {ends('ion')} then case when ", f"when {ends('ion')} then case when substring(w, length(w) - 3, 1) in ('s', 't') and "))
    step(8, f"case when {ends('e')} and ({d.matches(less(1), _MANY)} or ({d.matches(less(1), _ONE)} and not {d.matches(less(1), _SHORT)})) then {less(1)} else w end")
    step(9, f"case when {ends('ll')} and {d.matches(less(1), _MANY)} then {less(1)} else w end")
    return p.columns(name, f"{name}_9", keep="word, folded", stem="case when length(folded) < 3 or length(folded) > 64 then folded else replace(w, 'Y', 'y') end")
