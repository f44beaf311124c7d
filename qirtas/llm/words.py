"""Words of a text, and batches of texts as flat arrays of word numbers."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

import numpy as np
import regex
import xxhash

#: Letters, digits and what is written on or inside them (marks, invisible format characters, stretching).
RAW_WORD = regex.compile(r"[\p{L}\p{N}\p{Mn}\p{Mc}\p{Cf}ـ]+")
INSIDE = regex.compile(r"[\p{Mn}\p{Mc}\p{Cf}ـ]+")
TAG = regex.compile(r"<[^<>]{0,2000}>")
ENTITY = regex.compile(r"&(?:[a-zA-Z]{2,8}|#\d{1,7}|#x[0-9a-fA-F]{1,6});")
#: Letter variants that leave a word the same (fixed values).
SAME_LETTER = str.maketrans({"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ی": "ي", "ې": "ي", "ک": "ك", "ة": "ه", "ہ": "ه", "ھ": "ه", "ۀ": "ه", "ؤ": "و", "ئ": "ي"})
#: Words a worker remembers; beyond this the memory is emptied. A speed setting only.
MEMORY = 400_000


def bare(word: str) -> str:
    """Lower case, without marks, invisible characters and stretching."""
    return INSIDE.sub("", word).lower()


def same(word: str) -> str:
    """``bare`` with one shape for letter and digit variants."""
    w = INSIDE.sub("", unicodedata.normalize("NFKC", word)).lower().translate(SAME_LETTER).replace(" ", "")
    return w if w.isascii() else "".join(str(unicodedata.digit(c, c)) if c.isdigit() else c for c in w)


def no_markup(text: str) -> str:
    """Tags become blanks (none where a tag stands inside a word would be wrong as often), entities blanks."""
    if "<" in text:
        text = TAG.sub(" ", text)
    return ENTITY.sub(" ", text) if "&" in text else text


class WordHashes:
    """64-bit hashes of folded words, remembered by raw word; a word that folds to nothing has hash 0 and is dropped."""

    def __init__(self, fold: Callable[[str], str]) -> None:
        self.fold = fold
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> list[int]:
        known = self.known
        try:
            return [known[w] for w in words]
        except KeyError:
            if len(known) > MEMORY:
                known.clear()
        for w in words:
            if w not in known:
                f = self.fold(w)
                known[w] = (xxhash.xxh64_intdigest(f.encode("utf-8", "surrogatepass")) | 1) if f else 0
        return [known[w] for w in words]

    def flat(self, texts: Iterable[str | None], clean: Callable[[str], str] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All texts' hashes in one array, and the offsets of the texts in it."""
        out: list[int] = []
        ends = [0]
        for t in texts:
            if t:
                out += self(RAW_WORD.findall(clean(t) if clean else t))
            ends.append(len(out))
        a, e = np.array(out, np.uint64), np.array(ends, np.int64)
        if len(a) and not a.all():
            keep = a != 0
            e = np.concatenate([[0], np.cumsum(keep)])[e]
            a = a[keep]
        return a, e
