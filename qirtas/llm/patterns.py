"""Classes of words and phrases in one multi-pattern automaton, shared by problems 5 and 6."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import ahocorasick
import regex

from qirtas.llm.words import same

#: Small words, which are no content (fixed values); words of one or two letters are small too.
SMALL = frozenset(same(w) for w in """
the this that these those your you our for with and are was were has have had been will would can may any all its his her their from into not but who which what there here out off over than then also
les des une est sont dans sur pour par avec que qui vous votre vos nos notre cette ces aux pas plus elle ils leur ont été être mais comme êtes es
der die das den dem des ein eine einen einem einer und ist sind war nicht mit auf für von zum zur sie ihr ihre ihren wir uns diese dieser dieses wird werden wurde haben hat auch aber oder als wie bei nach
los las una unos unas del por para con que esta este estos estas está están son fue ser sus nuestra nuestro usted pero como más sin sobre entre
من في علي الي عن هذا هذه التي الذي ان انك انه انها قد كان كانت هو هي ما او ثم بعد قبل عند مع كل اي لك لكم اليكم حتي سوف كما بين ذلك تلك لست
از در به با كه اين ان را براي تا است شما بود هاي خود ما
كا كي كے كو ميں سے پر هے هيں اور اس يه آپ اپنے اپني كه نے تها گيا گئی گئے هوا هوئی رها رهی
""".split())
_ARABIC_HEAD = regex.compile(r"^(?:[وف]?(?:[بك]?ال|لل)|[وف](?=\p{L}{4}))(?=\p{L}{3})")
_ARABIC_JOINED = regex.compile(r"^(?:ب(?=\p{L}{4})|ل(?=\p{L}{3}))")


def stem(word: str) -> str:
    """A folded word; Arabic words without article and joined particles, numbers as 0 or, if they may be a status, 4xx."""
    f = same(word)
    if f.isdigit():
        return "4xx" if len(f) == 3 and f[0] in "45" else "0"
    return f if f.isascii() else _ARABIC_JOINED.sub("", _ARABIC_HEAD.sub("", f))


def automaton(classes: dict[str, str]) -> ahocorasick.Automaton:
    """From entries of one or several words, by class: ``(classes, number of words, whether any end fits)`` for each."""
    found: dict[str, tuple[set[str], int, bool]] = {}
    for kind, lines in classes.items():
        for entry in lines.replace("\n", ",").split(","):
            words = [stem(w) for w in entry.replace("*", "").split()]
            if words:
                open_ = entry.strip().endswith("*")
                found.setdefault(" " + " ".join(words) + ("" if open_ else " "), (set(), len(words), open_))[0].add(kind)
    out = ahocorasick.Automaton()
    for text, (kinds, n, open_) in found.items():
        out.add_word(text, (frozenset(kinds), n, open_))
    out.make_automaton()
    return out


def last_words(words: list[str], hits: list) -> list[int]:
    """The number of the last word of each hit in ``f" {' '.join(words)} "``."""
    begin = list(accumulate((len(w) + 1 for w in words), initial=1))
    return [bisect_right(begin, end if open_ else end - 1) - 1 for end, (_, _, open_) in hits]


def classes(words: list[str], hits: list) -> list[set[str]]:
    """The classes of each word."""
    of: list[set[str]] = [set() for _ in words]
    for last, (_, (kinds, size, _)) in zip(last_words(words, hits), hits):
        for k in range(last - size + 1, last + 1):
            of[k] |= kinds
    return of
