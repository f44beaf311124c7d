"""Missing or wrong language labels, and mixed texts (problem 2).

The n-grams of a word (its trigrams with edges, and the word itself) are looked up in one bit-sliced Bloom filter whose
rows are language bitmasks: the conjunction of an n-gram's rows has a bit for every language that holds the n-gram. A
word's popcount for each language, corrected for the filter's false positives, is its evidence; sums of evidence decide
a text, and a Viterbi path over the words cuts a mixed text into stretches of at least ``stretch`` words. A switch of
language costs less at the end of a sentence or line than inside it.

The filter is trained on at most ``SAMPLE`` labelled texts of each language, by hash order of their keys (the bound is
that parameter; everything else covers all rows). Labels are noisy, so the sample is classified by a first filter and
only texts whose label it confirms train the second.

Scale: one pass over the records for counts of labels, one for the sample, one to label; no shuffle of texts.

Defined results: null and wordless texts have one row without language, of 0 words and confidence 0; texts under ``least_words`` words (``wrong_labels``), or with too
little evidence for any language (lang null), are no case; numbers, links and tags count as words without evidence;
stretches shorter than ``stretch`` belong to their surroundings; a tie goes to the language that comes first in
``LANGUAGES``; repeated rows are judged alike.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qirtas.llm import samples
from qirtas.llm.words import INSIDE, no_markup

LANGUAGES = ("ar", "en", "fr", "de", "es", "fa", "ur")
#: Spellings of the languages' names (fixed values); a region or script after the first part is passed over.
NAMES = {
    "ar": "ar ara arb arabic العربية", "en": "en eng english", "fr": "fr fra fre french français", "de": "de deu ger german deutsch",
    "es": "es spa spanish español castellano", "fa": "fa fas per pes prs persian farsi فارسی", "ur": "ur urd urdu اردو",
}
#: Labelled texts of each language that train the filter, about.
SAMPLE = 800
STRETCH = 8
LEAST_WORDS = 5
#: Rows of the filter (a byte each), and hashes of each n-gram.
ROWS, HASHES = 1 << 20, 3
#: Copies of the whole word among a word's n-grams.
WHOLE = 3
#: A text is in a language if its words have this evidence on average, or some and lead the second language by a share.
LEAST_EVIDENCE, SOME_EVIDENCE, LEAST_LEAD = 0.6, 0.2, 0.33
#: What a switch of language costs, in words of evidence, at the end of a sentence and inside.
SWITCH_END, SWITCH_INSIDE = 0.6, 2.0

_LINK = regex.compile(r"(?:https?://|www\.)\S+|\S+@\S+|\S+\.example\S*")
_TOKEN = regex.compile(r"[\p{L}\p{N}\p{M}\p{Cf}ـ'’]+|[.!?؟۔\n]")
_LETTERS = regex.compile(r"\p{L}")


def label_language(label: Column) -> Column:
    """The language that a label names, or null."""
    l = F.lower(F.trim(label))
    names = F.create_map(*(F.lit(x) for lang, spelled in NAMES.items() for name in spelled.split() for x in (name, lang)))
    return F.coalesce(names[l], names[F.regexp_extract(l, r"^([^-_\s]+)[-_\s]", 1)])


def grams(word: str) -> list[str]:
    w = f"_{word}_"
    return [w[i : i + 3] for i in range(len(w) - 2)] + [f"{k}={word}" for k in range(WHOLE)]


def rows_of(gram: str) -> tuple[int, ...]:
    h = xxhash.xxh64_intdigest(gram.encode("utf-8", "surrogatepass"))
    return tuple((h >> (21 * k)) & (ROWS - 1) for k in range(HASHES))


def tokens(text: str) -> tuple[list[str], list[bool]]:
    """Words in lower case without marks ('' for what has no letters), and whether a sentence or line ends before each."""
    text = no_markup(text)
    if "://" in text or "@" in text or ".example" in text or "www." in text:
        text = _LINK.sub(" 0 ", text)
    words, ends, end = [], [], True
    for t in _TOKEN.findall(text):
        if len(t) == 1 and t in ".!?؟۔\n":
            end = True
            continue
        words.append(t)
        ends.append(end)
        end = False
    return words, ends


def clean(token: str) -> str:
    w = INSIDE.sub("", token if token.isascii() else unicodedata.normalize("NFKC", token)).lower().strip("'’ ")
    return w if _LETTERS.search(w) else ""


class Filter:
    """The bit-sliced Bloom filter."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows
        bits = (rows[:, None] >> np.arange(len(LANGUAGES))) & 1
        self.false = bits.mean(axis=0) ** HASHES
        self.number: dict[str, int] = {}
        self.scores = [np.zeros(len(LANGUAGES), np.float32)]

    @classmethod
    def build(cls, members: dict[str, int]) -> Filter:
        rows = np.zeros(ROWS, np.uint8)
        for gram, mask in members.items():
            for r in rows_of(gram):
                rows[r] |= mask
        return cls(rows)

    def evidence(self, word: str) -> np.ndarray:
        """Share of the word's n-grams that each language holds, corrected for false positives."""
        if not word:
            return self.scores[0]
        masks = []
        for g in grams(word):
            m = 255
            for r in rows_of(g):
                m &= int(self.rows[r])
            masks.append(m)
        m = np.array(masks)
        hits = ((m[:, None] >> np.arange(len(LANGUAGES))) & 1).mean(axis=0)
        return np.clip((hits - self.false) / (1 - self.false), 0, 1).astype(np.float32)

    def numbers(self, raw: list[str]) -> list[int]:
        known = self.number
        try:
            return [known[t] for t in raw]
        except KeyError:
            pass
        if len(known) > 300_000:
            known.clear()
            del self.scores[1:]
        seen: dict[str, int] = {}
        for t in raw:
            if t not in known:
                w = clean(t)
                if w not in seen:
                    if w:
                        self.scores.append(self.evidence(w))
                    seen[w] = len(self.scores) - 1 if w else 0
                known[t] = seen[w]
        return [known[t] for t in raw]


def members(texts: list[tuple[int, set[str]]], ratio: float) -> dict[str, int]:
    """Languages of each n-gram: those whose texts hold it at least ``ratio`` times as often as those that hold it most."""
    size = Counter(lang for lang, _ in texts)
    seen: list[Counter] = [Counter() for _ in LANGUAGES]
    for lang, gs in texts:
        seen[lang].update(gs)
    least = [max(3, 0.005 * size[k]) for k in range(len(LANGUAGES))]
    out: dict[str, int] = {}
    for g in set().union(*seen):
        p = [seen[k][g] / max(1, size[k]) if seen[k][g] >= least[k] else 0.0 for k in range(len(LANGUAGES))]
        top = max(p)
        if top:
            out[g] = sum(1 << k for k, x in enumerate(p) if x >= ratio * top and x)
    return out


def train(texts: list[tuple[str, str]]) -> Filter:
    """A filter from ``(language, text)``."""
    rows = []
    for lang, text in sorted(texts):
        words = [w for t in tokens(text)[0] if (w := clean(t))]
        rows.append((LANGUAGES.index(lang), words, {g for w in set(words) for g in grams(w)}))
    first = Filter.build(members([(lang, gs) for lang, _, gs in rows], 0.6))
    kept = []
    for lang, words, gs in rows:
        if words and int(np.sum([first.scores[k] for k in first.numbers(words)], axis=0).argmax()) == lang:
            kept.append((lang, gs))
    return Filter.build(members(kept, 0.15))


def path(e: np.ndarray, ends: list[bool], states: list[int]) -> list[int]:
    """The best language for each word: Viterbi over the ``states``."""
    e = e[:, states].tolist()
    k = len(states)
    best, back = e[0][:], []
    for row, end in zip(e[1:], ends[1:]):
        top = max(range(k), key=best.__getitem__)
        switch = best[top] - (SWITCH_END if end else SWITCH_INSIDE)
        from_ = [top if switch > best[s] else s for s in range(k)]
        best = [max(switch, best[s]) + row[s] for s in range(k)]
        back.append(from_)
    at = max(range(k), key=best.__getitem__)
    out = [at]
    for from_ in reversed(back):
        at = from_[at]
        out.append(at)
    return [states[s] for s in reversed(out)]


def runs(langs: list[int]) -> list[list[int]]:
    """``[language, start, stop]`` of equal neighbours."""
    out: list[list[int]] = []
    for i, s in enumerate(langs):
        if out and out[-1][0] == s:
            out[-1][2] = i + 1
        else:
            out.append([s, i, i + 1])
    return out


def stretches(e: np.ndarray, ends: list[bool], states: list[int], least: int) -> list[list[int]]:
    """Stretches of at least ``least`` words; a shorter one goes to the neighbour that fits it better."""
    parts = runs(path(e, ends, states))
    while len(parts) > 1:
        short = min(range(len(parts)), key=lambda i: (parts[i][2] - parts[i][1], i))
        _, a, b = parts[short]
        if b - a >= least:
            break
        near = [parts[i][0] for i in (short - 1, short + 1) if 0 <= i < len(parts)]
        parts[short][0] = max(near, key=lambda s: float(e[a:b, s].sum()))
        langs = [s for s, x, y in parts for _ in range(y - x)]
        parts = runs(langs)
    return parts


def label_batch(f: Filter, texts: list[str | None], stretch: int) -> list[list[tuple[int, int, int, float]]]:
    """For each text its stretches ``(language or -1, start, stop, confidence)``."""
    ids: list[int] = []
    offsets = [0]
    all_ends: list[list[bool]] = []
    for t in texts:
        words, ends = tokens(t) if t else ([], [])
        ids += f.numbers(words)
        offsets.append(len(ids))
        all_ends.append(ends)
    scores = np.stack(f.scores)
    e = scores[np.array(ids, np.int64)] if ids else np.zeros((0, len(LANGUAGES)), np.float32)
    sums = np.concatenate([np.zeros((1, len(LANGUAGES)), np.float64), np.cumsum(e, axis=0, dtype=np.float64)])
    o = np.array(offsets)
    total = sums[o[1:]] - sums[o[:-1]]
    main = total.argmax(axis=1)
    # windows in which another language beats the main one: only these texts can be mixed
    mixed: dict[int, set[int]] = {}
    if len(ids) >= stretch:
        window = sums[stretch:] - sums[:-stretch]
        doc = np.repeat(np.arange(len(texts)), np.diff(o))[: len(window)]
        inside = np.arange(len(window)) + stretch <= o[1:][doc]
        over = window - window[np.arange(len(window)), main[doc]][:, None] >= SWITCH_END
        over &= inside[:, None]
        for i, s in zip(*np.nonzero(over)):
            mixed.setdefault(int(doc[i]), set()).add(int(s))
    out = []
    for k in range(len(texts)):
        a, b = offsets[k], offsets[k + 1]
        if a == b:
            out.append([])
            continue
        own = e[a:b]
        parts = stretches(own, all_ends[k], sorted({int(main[k])} | mixed[k]), stretch) if k in mixed else [[int(main[k]), 0, b - a]]
        rows = []
        for s, x, y in parts:
            part = own[x:y]
            n = max(1, int((part.max(axis=1) > 0).sum()), int((y - x) // 2))
            mass = part.sum(axis=0, dtype=np.float64)
            best = float(mass[s])
            other = float(np.delete(mass, s).max())
            rows.append((s if best / n >= LEAST_EVIDENCE or (best / n >= SOME_EVIDENCE and best - other >= LEAST_LEAD * best) else -1, x, y, round(max(0.0, best - other) / max(best, 1e-9) * min(1.0, best / n), 6)))
        out.append(rows)
    return out


def sampled(records: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """``l, text``: about ``per_language`` labelled texts of each language, by hash of the key."""
    d = records.select("rec_id", "text", label_language(F.col("lang")).alias("l")).where("l is not null and text is not null")
    n = {r.l: r["count"] for r in records.select(label_language(F.col("lang")).alias("l")).groupBy("l").count().collect() if r.l}
    if not n:
        return d.select("l", "text").limit(0)
    below = F.create_map(*(F.lit(x) for l, c in n.items() for x in (l, samples.bound(c, per_language))))
    return samples.first(d, "rec_id", ["l", "text"], below[F.col("l")], 2 * per_language * len(LANGUAGES), "sample").select("l", "text")


def trained(records: DataFrame, per_language: int = SAMPLE) -> Filter:
    """The filter of the sample, trained in one task; its rows (``ROWS`` bytes) come to the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = train([x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())])
        yield pa.RecordBatch.from_arrays([pa.array([f.rows.tobytes()], pa.binary())], names=["rows"])

    got = sampled(records, per_language).repartition(1).mapInArrow(run, "rows binary").collect()
    return Filter(np.frombuffer(got[0].rows, np.uint8) if got else np.zeros(ROWS, np.uint8))


def label_languages(records: DataFrame, filter_: Filter, stretch: int = STRETCH) -> DataFrame:
    """``tbl, rec_id, label, seg, lang, confidence, n_words, n_segs`` for ``records(tbl, rec_id, text, lang)``."""
    sent = records.sparkSession.sparkContext.broadcast(filter_.rows)  # a fixed size: one byte for each of ROWS
    d = records.select("tbl", F.col("rec_id").cast("string"), label_language(F.col("lang")).alias("label"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Filter(sent.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                found = label_batch(f, batch.column(3).to_pylist(), stretch)
                row = [k for k, parts in enumerate(found) for _ in parts or [None]]
                cols = [(i, None if p[0] < 0 else LANGUAGES[p[0]], p[3], p[2] - p[1], len(parts)) for parts in found for i, p in enumerate(parts or [(-1, 0, 0, 0.0)])]
                seg, lang, conf, n, of = (list(c) for c in zip(*cols)) if cols else ([], [], [], [], [])
                head = [batch.column(i).take(pa.array(row, pa.int64())) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*head, pa.array(seg, pa.int32()), pa.array(lang, pa.string()), pa.array(conf, pa.float64()), pa.array(n, pa.int32()), pa.array(of, pa.int32())], names=["tbl", "rec_id", "label", "seg", "lang", "confidence", "n_words", "n_segs"])

    return d.mapInArrow(run, "tbl string, rec_id string, label string, seg int, lang string, confidence double, n_words int, n_segs int")


def wrong_labels(labelled: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``tbl, rec_id, seg, lang`` of the records whose label is missing or wrong, or whose text is mixed."""
    case = (F.col("n_segs") > 1) | F.col("label").isNull() | (F.col("label") != F.col("lang"))
    enough = (F.col("n_words") >= least_words) & F.col("lang").isNotNull()
    return labelled.where(case & enough).select("tbl", "rec_id", "seg", "lang").distinct()
