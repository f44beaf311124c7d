"""How texts end: features of the closing characters, words and line, shared by problems 6 and 10."""

from __future__ import annotations

import numpy as np
import regex
import xxhash

#: Hashed features.
SPACE = 1 << 18
#: Characters of the end that are looked at; what comes before changes no closing feature.
TAIL = 400

#: Marks that close a sentence, and what may follow them (fixed values).
STOPS = ".!?؟۔"
_CLOSERS = regex.compile(r"(?:[\p{Cf}\s\"'”’»)\]}*_]|\[\d{1,3}\]|</?\w{1,10}\s*/?>|(?!�)[\p{So}\p{Sk}‍️])+$")
_BROKEN = regex.compile(r"(?:…|\.\.\.+|\[(?:…|\.\.\.+)\]|�|<[\w/ =\"']{0,20}|&#?\w{0,6}|\\u?[0-9a-fA-F]{0,4}|%[0-9A-F]{1,2})+\s*$")
_LINE = regex.compile(r"[\n\r]+")
_SHAPE = ((regex.compile(r"\p{Arabic}+"), "ع"), (regex.compile(r"\p{Latin}+"), "a"), (regex.compile(r"\p{N}+"), "0"), (regex.compile(r"\s+"), " "), (regex.compile(r"(?:(?!�)[\p{So}\p{Sk}‍️])+"), "☺"))
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def shape(s: str) -> str:
    for p, c in _SHAPE:
        s = p.sub(c, s)
    return s


def kind(c: str) -> str:
    if c in STOPS:
        return "stop"
    return shape(c) if c else "none"


def finished(text: str) -> bool:
    """Whether the text ends with the mark of a sentence's end (closers aside)."""
    t = _CLOSERS.sub("", text[-TAIL:])
    return t[-1:] in STOPS and t[-1:] != "" and t[-3:] != "..."


def features(text: str) -> list[str]:
    """Names of the features that hold; ``text`` is not blank."""
    tail = text[-TAIL:]
    t = tail.rstrip()
    closers = m.group() if (m := _CLOSERS.search(t)) else ""
    core = t[: len(t) - len(closers)]
    c = kind(core[-1:])
    end = shape(closers) if closers else ""
    out = [f"c={c}", f"end={end}", f"c,end={c}|{end}", f"blank={shape(tail[len(t):])!r}", f"c,blank={c}|{shape(tail[len(t):])!r}"]
    broken = m.group() if (m := _BROKEN.search(t)) else ""
    if broken:
        out += ["broken", f"broken={shape(broken)}", f"broken,c={kind(t[: len(t) - len(broken)].rstrip()[-1:])}"]
    out += [f"s{k}={shape(t)[-k:]}" for k in (2, 3, 5)]
    out += [f"x{k}={t[-k:]}" for k in (1, 2, 3)]
    words = _WORD.findall(core[-120:])
    last = words[-1] if words else ""
    out += [f"w2={' '.join(words[-2:])}", f"w3={' '.join(words[-3:])}"]
    out += [f"e{k}={last[-k:]}" for k in (1, 2, 3)]
    out.append(f"len={min(len(last), 8)}|{c}")
    lines = [x for x in _LINE.split(t) if x.strip()]
    line = lines[-1].strip() if lines else ""
    before = lines[-2].rstrip() if len(lines) > 1 else ""
    tokens = line.split()
    first = shape(tokens[0]) if tokens and not tokens[0][:1].isalpha() else (tokens[0] if tokens else "")
    n = min(len(tokens), 12)
    alone = f"{bool(before) and finished(before)}|{n if n < 5 else 5 if n < 9 else 9}"
    # a word that closes many lists and tags is no sign of an end where it stands in running text
    out += [f"w1={last}|{n < 5}", f"w1,c={last}|{c}|{n < 5}"]
    out += [f"first={first}", f"first,c={first}|{c}", f"alone={alone}", f"alone,c={alone}|{c}", f"line={shape(line[:24])}", f"colon={':' in line[:20]}|{c}|{n < 6}"]
    return out


def hashed(names: list[str]) -> list[int]:
    return [xxhash.xxh32_intdigest(n.encode("utf-8", "surrogatepass")) & (SPACE - 1) for n in names]


class Rows:
    """Sparse binary rows."""

    def __init__(self, rows: list[list[int]]) -> None:
        self.at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        self.index = np.fromiter((i for r in rows for i in r), np.int64, int(self.at[-1]))
        self.row = np.repeat(np.arange(len(rows)), np.diff(self.at))

    def keep(self, mask: np.ndarray) -> None:
        self.index, self.row = self.index[mask], self.row[mask]

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.index], minlength=len(self.at) - 1)


def logistic(rows: list[list[int]], y: np.ndarray, epochs: int = 60, rate: float = 0.5, l2: float = 1e-5, least: int = 10) -> np.ndarray:
    """Weights of a logistic regression on binary features, by full-batch AdaGrad (deterministic). Features of fewer
    than ``least`` rows get no weight, so that single rows, some of them with a wrong label, aren't learned by heart."""
    x = Rows(rows)
    x.keep(np.bincount(x.index, minlength=SPACE)[x.index] >= least)
    w, g2 = np.zeros(SPACE), np.full(SPACE, 1e-8)
    balance = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(x.sums(w), -30, 30)))
        d = (p - y) * balance
        g = np.bincount(x.index, d[x.row], minlength=SPACE) + l2 * w
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
    return w


def likelihood_ratio(rows: list[list[int]], y: np.ndarray, alpha: float = 0.5) -> np.ndarray:
    """Weights whose sum over a text's features is the log ratio of their likelihoods in the two classes (naive Bayes)."""
    x = Rows(rows)
    one = np.bincount(x.index, (y > 0)[x.row].astype(float), minlength=SPACE)
    zero = np.bincount(x.index, (y <= 0)[x.row].astype(float), minlength=SPACE)
    n1, n0 = max(1, (y > 0).sum()), max(1, (y <= 0).sum())
    return np.log((one + alpha) / (n1 + 2 * alpha)) - np.log((zero + alpha) / (n0 + 2 * alpha))
