"""Broken prompt and response pairs (problem 6).

Each answer gets at most one defect, the first of: ``empty`` (null, or no letter or digit), ``copy`` (nothing but the
question), ``refusal``, ``other_language``, ``truncated``.

Languages come from a naive Bayes over character n-grams: the posterior of every sentence assigns its words to a
language, and a text uses the languages that hold a share of its words. An answer is in another language if it uses none
that its prompt uses and its own posterior is sure. Truncation comes from the likelihood of the end-of-text n-grams: the
log ratio of their probabilities at the ends of artificially cut answers and of answers as they are, learned on a
bounded sample (``SAMPLE`` answers by hash order) and refined once without the answers that the first round takes for
cut. Refusals are recognised by the words they are made of, in seven languages: the speaker's inability and what was asked for
near each other, and such words over most of the answer; a story that quotes one is none.

Scale: answers and prompts are reduced to a few numbers each where they lie; only these, and a 64-bit hash of each folded
word, are joined by passage id. A passage that answers a third of all prompts is one build row of that join.

Defined results: a null or blank prompt has no language and cannot be copied, so its answer is only judged by itself;
short complete answers are sound; prompts whose passage does not exist have no row; repeated keys give one row; where a
passage id arrives with different texts, the text of the least hash is the answer.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qirtas.llm import languages, patterns, samples, tails
from qirtas.llm.words import RAW_WORD, no_markup, same

SAMPLE = 6000
#: Share of an answer's content words that are words of refusals, and how far what was asked for may stand.
REFUSAL_COVERAGE, REACH = 0.7, 7
#: Share of a text's words that make a language one of its languages, the posterior that is sure, and the least words.
LANGUAGE_SHARE, SURE, LEAST_WORDS = 0.25, 0.99, 4
#: Log odds from which an answer counts as cut, and words below which it never does.
CUT, CUT_WORDS = 0.0, 5
# Each entry of a class is one or several words; * stands for any end of the last one; Arabic words stand without
# article and joined particles. (fixed values)
#: The speaker cannot, must not or will not.
UNABLE = """
cannot, can t, can not, could not, couldn t, unable, not able, won t, will not, not allowed, not permitted, not authorized, not comfortable, not in a position, must decline, have to decline, decline to, refuse to, prefer not, rather not, don t have, do not have, don t have access, do not have access, don t have the ability, beyond my, outside my, not possible for me, don t know, do not know, no information, not qualified, against my
ne peux pas, ne pourrai pas, ne suis pas, n ai pas, ne veux pas, ne souhaite pas, refuse de, refuse, préfère ne pas, pas en mesure, impossible, ne sais pas, pas le droit
kann ich, darf ich, darf dazu, dazu keine, kann nicht, kann ich nicht, kann diese, kann dir, kann ihnen, darf nicht, darf ich nicht, möchte nicht, werde nicht, lehne, ablehnen, weigere, nicht in der lage, nicht möglich, nicht beantworten, nicht helfen, weiß nicht, nicht berechtigt
no estoy autorizad*, no puedo, no podré, no me es posible, no estoy, no tengo, no debo, no quiero, prefiero no, me niego, rechazo, imposible, no sé, incapaz
لا استطيع, لا يمكنني, لا اقدر, لا اتمكن, لم اتمكن, لن اتمكن, لن استطيع, لست قادر*, لست موهل*, غير موهل*, اذن, اجيز لنفسي, غير قادر*, يتعذر علي, تعذر علي, ليس بوسعي, ليس في وسعي, ليس بامكاني, لا اود, لا ارغب, افضل الا, افضل عدم, ارفض, اعتذر عن, ان اعتذر, لست مخول*, لست مصرح*, غير مخول*, غير مصرح لي, لا يحق لي, لا يسمح لي, غير مسموح لي, ما عندي, ليس لدي, لا املك, لا اعرف, لا ادري, لا اعلم, خارج نطاق*, لا تشمل, لا تغطي, يخالف, مخالف, ممنوع علي, اتحفظ, امتنع
اجازه ندارم, نمي توانم, نميتوانم, قادر نيستم, نمي خواهم, اجازه ندارم, مجاز نيستم, معذورم, نمي دانم, ندارم, خارج از, امكان پذير نيست, خودداري
سكتا, سكتي, نهيں كر سكتا, نهيں كر سكتي, نهيں دے سكتا, نهيں دے سكتي, نهيں سكتا, قاصر, معذرت خواه, اجازت نهيں, معلوم نهيں, انكار, سے باهر
"""
#: What was asked for.
ASKED = """
answer*, help*, assist*, respond*, reply, replying, provide*, discuss*, comment*, question*, request*, topic*, subject, information, advice, opinion, content, task, complete*, fulfil*, comply, engage*, explain*, talk*, do that, do this, with that, with this, this matter, that matter
répond*, réponse*, aid*, assist*, fournir, discut*, comment*, question*, demande*, sujet*, information*, avis, conseil*, explique*, parler
beantwort*, antwort*, helf*, hilfe, unterstütz*, auskunft, kommentier*, frage*, anfrage*, thema, information*, rat, meinung, erklär*, sprechen
respond*, respuesta*, contest*, ayud*, asist*, proporcion*, coment*, pregunta*, solicitud*, petición, tema*, información, consejo*, opinión, explic*, hablar
اجاب*, جواب*, اجيب, رد, ارد, مساعد*, اساعد*, رايي?, راي, معلوم*, سوال*, طلب*, موضوع*, مسال*, حديث, اتحدث, كلام, تعليق, تقديم, اقدم*, خدم*, شرح, اشرح, توضيح, مجال*, امر, ذلك, نصيح*, استشار*, تلبي*, تنفيذ
پاسخ*, جواب*, كمك*, ياري, اطلاعات, پرسش*, سوال*, درخواست*, موضوع*, نظر, توضيح, صحبت, راهنمايي
جواب*, مدد*, معلومات, سوال*, معامله, معاملے, بارے, درخواست*, موضوع*, راۓ, راي, وضاحت
"""
#: What stands around a refusal.
AROUND = """
sorry, apologi*, unfortunately, regret*, thank*, however, but, as an ai, ai, language model, assistant, model, policy, policies, guidelines, consult*, professional, expert, specialist, anything else, something else, other, another, please, happy, today, moment, currently, due to, because, safety, i m, i am
désolé*, regrett*, malheureusement, merci, cependant, mais, modèle, langage, assistant, politique, consult*, spécialiste, autre*, actuellement, tant que, en tant
tut mir leid, leider, entschuldig*, bedaure*, danke, aber, sprachmodell, assistent, richtlinien, fachmann, experten, ander*, derzeit, moment, als ki
lo siento, lament*, disculp*, gracias, pero, modelo, lenguaje, asistente, política*, consult*, especialista, otra, otro, actualmente, como
عذرا, اسف, اسفه, للاسف, اسف جدا, اعتذر, يوسفني, معذره, شكرا, لكن, غير ان, الا ان, بصفتي, بصفه, كنموذج, نموذج*, لغوي*, ابداء, الي, اليا, مساعد*, ذكاء اصطناعي, سياس*, استخدام, يرجي, رجاء, استشار*, مختص*, متخصص*, خبير, اخر, احترام*, مع احترامي, احترامي, تقدير*, حالي, حاليا, وقت, يوم, لان*, بسبب, فمعلوماتي, جدا, هنا, هل من
متاسفم, متاسفانه, ببخشيد, پوزش, ممنون, تشكر, اما, مدل زباني, دستيار, هوش مصنوعي, متخصص, ديگر*, فعلا, لطفا
معذرت, افسوس, شكريه, ليكن, مگر, ماڈل, معاون, ماهر, براه كرم, اس وقت, كوئي اور
"""
#: Labels before an answer (fixed values).
LABELS = frozenset(same(w) for w in "الجواب جواب الإجابة السؤال سؤال س ج answer question q a antwort frage réponse question respuesta pregunta".split())


@lru_cache(maxsize=200_000)
def hashed(word: str) -> int:
    """A signed 64-bit hash of a folded word."""
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)


LABEL_HASHES = frozenset(map(hashed, LABELS))


def folded(text: str) -> list[str]:
    return [f for w in RAW_WORD.findall(no_markup(text)) if (f := same(w))]


class Refusals:
    """The words that refusals are made of, in one automaton."""

    def __init__(self) -> None:
        self.auto = patterns.automaton({"unable": UNABLE, "asked": ASKED, "around": AROUND})
        self.known: dict[str, str] = {}

    def stems(self, words: list[str]) -> list[str]:
        if len(self.known) > 400_000:
            self.known.clear()
        return [self.known[w] if w in self.known else self.known.setdefault(w, patterns.stem(w)) for w in words]

    def __call__(self, words: list[str]) -> bool:
        """Whether an answer says that it cannot be given and little else: the speaker's inability, then what was asked
        for within ``REACH`` words, and the words of a refusal over most of the answer."""
        stems = self.stems(words)
        hits = list(self.auto.iter(f" {' '.join(stems)} "))
        if not any("unable" in kinds for _, (kinds, _, _) in hits):
            return False
        of = patterns.classes(stems, hits)
        unable = [k for k, c in enumerate(of) if "unable" in c]
        if not any("asked" in of[j] for k in unable for j in range(max(0, k - 2), min(len(of), k + REACH))):
            return False
        content = [k for k in range(len(of)) if of[k] or stems[k] not in patterns.SMALL and len(stems[k]) > 2]
        # what comes before the refusal is a story's, where it isn't courtesy
        lead = [k for k in content if k < unable[0] - 1]
        return sum(bool(of[k]) for k in content) >= REFUSAL_COVERAGE * len(content) and sum(bool(of[k]) for k in lead) >= 0.5 * len(lead)


def copies(answer: list[int], prompt: list[int]) -> bool:
    """Whether the hashed words are the prompt's, once or several times, or nearly so; labels before them aside."""
    at = 0
    while at < len(answer) and answer[at] in LABEL_HASHES and answer[at : at + len(prompt)] != prompt:
        at += 1
    a = answer[at:]
    if not a or not prompt:
        return False
    if len(a) % len(prompt) == 0 and a == prompt * (len(a) // len(prompt)):
        return True
    if len(prompt) < 4 or min(len(a), len(prompt)) < 0.9 * max(len(a), len(prompt)):
        return False
    common = sum((Counter(a) & Counter(prompt)).values())
    return common >= 0.9 * max(len(a), len(prompt))


class Posterior:
    """Naive Bayes over the n-grams of words."""

    def __init__(self, logs: dict[str, np.ndarray], unseen: np.ndarray) -> None:
        self.logs, self.unseen = logs, unseen
        self.known: dict[str, np.ndarray] = {"": np.zeros(len(languages.LANGUAGES))}

    @classmethod
    def train(cls, texts: list[tuple[str, str]]) -> Posterior:
        """From ``(language, text)`` with noisy labels: once, and again on the texts whose label the first confirms."""
        rows = []
        for lang, text in sorted(texts):
            words = {w for t in languages.tokens(text)[0] if (w := languages.clean(t))}
            rows.append((languages.LANGUAGES.index(lang), words, {g for w in words for g in languages.grams(w)[: -languages.WHOLE + 1]}))
        model = cls._fit(rows)
        kept = [r for r in rows if r[1] and int(sum((model.word(w) for w in r[1]), np.zeros(len(languages.LANGUAGES))).argmax()) == r[0]]
        return cls._fit(kept)

    @classmethod
    def _fit(cls, rows: list) -> Posterior:
        k = len(languages.LANGUAGES)
        n = np.bincount([r[0] for r in rows], minlength=k)
        seen: list[Counter] = [Counter() for _ in range(k)]
        for lang, _, gs in rows:
            seen[lang].update(gs)
        total = Counter()
        for c in seen:
            total.update(c)
        # one probability for what a language has not seen, so that a small sample is no evidence for rare words
        low = 0.5 / (n.max(initial=0) + 1)
        logs = {g: np.log([max(low, (seen[i][g] - 0.5) / (n[i] + 1)) if n[i] else low for i in range(k)]) for g, c in total.items() if c >= 3}
        return cls(logs, np.full(k, np.log(low)))

    def word(self, word: str) -> np.ndarray:
        """Log evidence of a word, the best language at 0."""
        v = self.known.get(word)
        if v is None:
            if len(self.known) > 300_000:
                self.known = {"": self.known[""]}
            gs = languages.grams(word)[: -languages.WHOLE + 1]
            v = sum((self.logs.get(g, self.unseen) for g in gs), np.zeros(len(self.unseen))) / np.sqrt(len(gs))
            v = self.known[word] = v - v.max()
        return v

    def used(self, text: str) -> tuple[int, int, int]:
        """Bitmask of the languages a text uses, the bit of the one it is surely in (or 0), and its number of words."""
        words, ends = languages.tokens(text)
        if not words:
            return 0, 0, 0
        e = np.array([self.word(languages.clean(w)) for w in words])
        starts = np.flatnonzero(ends)
        sums = np.add.reduceat(e, starts, axis=0)
        sizes = np.diff(np.append(starts, len(words)))
        held = np.bincount(sums.argmax(axis=1), sizes * sums.any(axis=1), minlength=e.shape[1])
        mask = sum(1 << i for i, h in enumerate(held) if h and h >= LANGUAGE_SHARE * held.sum())
        all_ = e.sum(axis=0)
        p = np.exp(all_ - all_.max())
        return mask, 1 << int(all_.argmax()) if p.max() / p.sum() >= SURE and all_.any() else 0, len(words)


def end_features(text: str) -> list[int]:
    n = len(text.split())
    return tails.hashed([*tails.features(text), f"words={min(n, 8)}"])


def end_examples(text: str, seed: int = 11) -> Iterator[tuple[list[int], int]]:
    """Features and label (1: cut) of an answer as it is and of its artificial cuts."""
    if not text.strip():
        return
    yield end_features(text), 0
    if tails.finished(text) and len(text.split()) >= 8:
        rng = np.random.default_rng(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed))
        for _ in range(2):
            cut = text[: int(rng.integers(len(text) // 4, len(text) - 1))]
            if cut.strip() and not tails.finished(cut):
                yield end_features(cut), 1


def fit_ends(rows: list[list[int]], labels: np.ndarray) -> np.ndarray:
    """Weights whose sum over an answer's end is the log odds that it was cut; all 0 where there is nothing to tell."""
    if not labels.any() or labels.all():
        return np.zeros(tails.SPACE)
    w = tails.likelihood_ratio(rows, labels)
    keep = (labels > 0) | (tails.Rows(rows).sums(w) < CUT)
    return tails.likelihood_ratio([r for r, k in zip(rows, keep) if k], labels[keep])


def train_ends(texts: list[str]) -> np.ndarray:
    both = [x for t in texts for x in end_examples(t)]
    return fit_ends([f for f, _ in both], np.array([y for _, y in both], float))


@dataclass
class Facts:
    """What is known of an answer without its prompt."""

    empty: bool
    refusal: bool
    cut: bool
    used: int
    sure: int
    n_words: int
    words: list[int] | None


class Judge:
    def __init__(self, posterior: Posterior, ends: np.ndarray) -> None:
        self.posterior, self.ends, self.refuses = posterior, ends, Refusals()

    def answer(self, text: str | None) -> Facts:
        if not text or not regex.search(r"[\p{L}\p{N}]", text):
            return Facts(True, False, False, 0, 0, 0, None)
        words = folded(text)
        if words in (["n", "a"], ["na"], ["null"], ["none"], ["nil"], ["nan"], ["undefined"], ["لا", "يوجد"], ["لا", "شيء"]):
            return Facts(True, False, False, 0, 0, 0, None)
        used, sure, n = self.posterior.used(text)
        cut = n >= CUT_WORDS and not tails.finished(text) and float(self.ends[end_features(text)].sum()) > CUT
        return Facts(False, self.refuses(words), cut, used, sure, n, list(map(hashed, words)))

    def prompt(self, text: str | None) -> tuple[int, list[int]]:
        return (self.posterior.used(text)[0], list(map(hashed, folded(text)))) if text else (0, [])


def defect(a: Facts, used: int, prompt: list[int]) -> str | None:
    if a.empty:
        return "empty"
    if a.words is not None and copies(a.words, prompt):
        return "copy"
    if a.refusal:
        return "refusal"
    if used and a.sure and a.n_words >= LEAST_WORDS and not a.used & used and not a.sure & used:
        return "other_language"
    return "truncated" if a.cut else None


FACTS = "empty boolean, refusal boolean, cut boolean, used int, sure int, n_words int, words array<bigint>"


def train(answers: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> tuple[Posterior, np.ndarray]:
    """Both models: ends from ``answers(rec_id, text)``, languages from ``labelled(rec_id, text, lang)``. Each is fitted in
    one task from its bounded sample; the driver gets the models, whose size the samples bound."""
    d = answers.select("rec_id", "text").where("text is not null")
    few = samples.first(d, "rec_id", ["text"], F.lit(samples.bound(d.count(), sample)), 2 * sample, "ends")

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [x for t in batch.column(0).to_pylist() for x in end_examples(t)]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in both], pa.list_(pa.int32())), pa.array([y for _, y in both], pa.int8())], names=["f", "y"])

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((y, f) for b in batches for f, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        w = fit_ends([f for _, f in rows], np.array([y for y, _ in rows], float))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w[at])], names=["i", "w"])

    cores = answers.sparkSession.sparkContext.defaultParallelism
    got = few.select("text").repartition(cores).mapInArrow(look, "f array<int>, y tinyint").repartition(1).mapInArrow(learn, "i int, w double").toPandas()
    ends = np.zeros(tails.SPACE)
    ends[got["i"].to_numpy()] = got["w"].to_numpy()

    def languages_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Posterior.train([x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())])
        grams = ["", *sorted(p.logs)]  # no n-gram is empty: this row holds what an unseen one gets
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array([p.unseen.tolist(), *(p.logs[g].tolist() for g in grams[1:])], pa.list_(pa.float64()))], names=["g", "v"])

    logs = {r.g: np.array(r.v) for r in languages.sampled(labelled).repartition(1).mapInArrow(languages_of, "g string, v array<double>").collect()}
    unseen = logs.pop("", np.full(len(languages.LANGUAGES), np.log(0.5)))
    return Posterior(logs, unseen), ends


def sent_judge(spark, posterior: Posterior, ends: np.ndarray):
    """The models as a broadcast, with a name of their own: their size is bounded by the samples and ``tails.SPACE``."""
    at = np.flatnonzero(ends)
    return spark.sparkContext.broadcast((uuid.uuid4().hex, posterior.logs, posterior.unseen, at, ends[at].astype(np.float32)))


_judges: dict[str, Judge] = {}


def judge_of(sent) -> Judge:
    """The judge of a broadcast, built once in each worker; by the models' own name, as workers serve many tables."""
    name, logs, unseen, at, w = sent.value
    if (j := _judges.get(name)) is None:
        ends = np.zeros(tails.SPACE, np.float32)
        ends[at] = w
        _judges.clear()
        j = _judges[name] = Judge(Posterior(logs, unseen), ends)
    return j


def defects_of_pairs(pairs: DataFrame, sent) -> DataFrame:
    """``rec_id, defect`` for ``pairs(rec_id, query, passage)``: one pass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = judge_of(sent)
        for batch in batches:
            found = [defect(judge.answer(a), *judge.prompt(q)) for q, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["rec_id", "defect"])
            yield out.filter(pa.array([f is not None for f in found], pa.bool_()))

    return pairs.select(F.col("rec_id").cast("string"), "query", "passage").where("rec_id is not null").mapInArrow(run, "rec_id string, defect string")


def defects_of_queries(queries: DataFrame, passages: DataFrame, sent) -> DataFrame:
    """``rec_id, pid, defect`` for ``queries(qid, query, pos_pids)`` and ``passages(pid, text)``."""

    def facts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = judge_of(sent)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [judge.answer(t) for t in texts]
            kinds = {"used": pa.int32(), "sure": pa.int32(), "n_words": pa.int32(), "words": pa.list_(pa.int64())}
            cols = {k: pa.array([getattr(r, k) for r in rows], kinds.get(k, pa.bool_())) for k in Facts.__dataclass_fields__}
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashed(t or "") for t in texts]), *cols.values()], names=["pid", "hash", *cols])

    def prompts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = judge_of(sent)
        for batch in batches:
            rows = [judge.prompt(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["qid", "pids", "q_used", "q_words"])

    def judge_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in (*Facts.__dataclass_fields__, "q_used", "q_words")]
            found = [defect(Facts(*r[:7]), r[7], r[8]) for r in zip(*cols)]
            out = pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("pid"), pa.array(found, pa.string())], names=["rec_id", "pid", "defect"])
            yield out.filter(pa.array([f is not None for f in found], pa.bool_()))

    a = passages.select("pid", "text").where("pid is not null").mapInArrow(facts, f"pid string, hash bigint, {FACTS}")
    a = a.groupBy("pid").agg(F.min_by(F.struct(*Facts.__dataclass_fields__), "hash").alias("f")).select("pid", "f.*")
    q = queries.select("qid", "query", F.array_distinct("pos_pids").alias("pids")).where("qid is not null and size(pids) > 0").mapInArrow(prompts, "qid string, pids array<string>, q_used int, q_words array<bigint>")
    q = q.select("qid", F.explode("pids").alias("pid"), "q_used", "q_words")
    return q.join(a, "pid").mapInArrow(judge_rows, "rec_id string, pid string, defect string").distinct()
