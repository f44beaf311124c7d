import random

import numpy as np
import pytest

from qirtas.llm import answers as A
from tests.llm.test_languages import sentence, VOCABULARY


@pytest.fixture(scope="module")
def judge():
    rng = random.Random(1)
    labelled = [(lang, sentence(lang, 15, rng)) for lang in VOCABULARY for _ in range(100)]
    texts = [" ".join(sentence("ar", rng.randint(8, 14), rng) for _ in range(3)) for _ in range(400)] + ["نعم.", "عام 1934", "الجسر القديم"] * 10
    return A.Judge(A.Posterior.train(labelled), A.train_ends(texts))


def kind(judge, q, a):
    return A.defect(judge.answer(a), *judge.prompt(q))


def test_each_defect(judge):
    rng = random.Random(2)
    q, a = "متى كتب المدينة القديمة قرب الجسر؟", " ".join(sentence("ar", 12, rng) for _ in range(3))
    assert kind(judge, q, a) is None
    for e in (None, "", "  ", "\n", "-", "...", "؟؟", "​", "N/A"):
        assert kind(judge, q, e) == "empty"
    for c in (q, q[:-1], f"الجواب: {q}", f"س: {q}", "مَتى كتبَ المدينة القديمة قرب الجسر؟", f"{q} {q}"):
        assert kind(judge, q, c) == "copy"
    for r in ("عذرا، لا أستطيع الإجابة عن هذا السؤال.", "شكرا على سؤالك، لكن لن أتمكن من الرد على هذا الطلب، هل من سؤال آخر؟", "I'm sorry, but I cannot help with that."):
        assert kind(judge, q, r) == "refusal"
    assert kind(judge, q, "قال الرجل لأصدقائه: لا أستطيع الإجابة عن هذا السؤال اليوم. " + a) is None
    assert kind(judge, q, " ".join(sentence("en", 12, rng) for _ in range(2))) == "other_language"
    assert kind(judge, "who built the old town bridge near the street?", " ".join(sentence("en", 12, rng) for _ in range(2))) is None
    for s in ("نعم.", "لا.", "عام 1934", "الجسر القديم"):
        assert kind(judge, q, s) is None


def test_copies_and_refusals_of_any_length(spark, judge):
    rng = random.Random(4)
    long_, middle, short = (" ".join(sentence("ar", n, rng) for _ in range(k)) for n, k in ((12, 5), (15, 1), (8, 1)))
    refusal = " ".join(["عذرا، لا أستطيع الإجابة عن هذا السؤال. شكرا على سؤالك، لكن لن أتمكن من الرد على هذا الطلب."] * 4)
    cases = [(long_, long_, "copy"), (long_, f"الجواب: {long_}", "copy"), (middle, " ".join([middle] * 3), "copy"), (short, "<b class='x'>" * 150 + short, "copy"), (short, refusal, "refusal")]
    assert [kind(judge, q, a) for q, a, _ in cases] == [k for *_, k in cases]
    assert len(A.folded(refusal)) > 40 and kind(judge, long_, " ".join(sentence("ar", 12, rng) for _ in range(6))) is None
    sent = A.sent_judge(spark, judge.posterior, judge.ends)
    queries = spark.createDataFrame([(f"q{i}", q, [f"p{i}"]) for i, (q, _, _) in enumerate(cases)], "qid string, query string, pos_pids array<string>")
    passages = spark.createDataFrame([(f"p{i}", a) for i, (_, a, _) in enumerate(cases)], "pid string, text string")
    assert sorted(map(tuple, A.defects_of_queries(queries, passages, sent).collect())) == [(f"q{i}", f"p{i}", k) for i, (*_, k) in enumerate(cases)]


def test_held_out_truncation(judge):
    rng = random.Random(3)
    whole = [" ".join(sentence("ar", rng.randint(8, 14), rng) for _ in range(3)) for _ in range(200)]
    cut = [t[: rng.randint(40, len(t) - 3)] for t in whole]
    cut = [t for t in cut if not t.rstrip().endswith(".")]
    q = "متى؟"
    assert sum(kind(judge, q, t) == "truncated" for t in cut) >= 0.95 * len(cut)
    assert sum(kind(judge, q, t) is None for t in whole) >= 0.99 * len(whole)


def test_null_prompts_and_tables(spark, judge):
    sent = A.sent_judge(spark, judge.posterior, judge.ends)
    pairs = spark.createDataFrame([("1", None, "نعم."), ("2", "سؤال عن المدينة القديمة؟", None), ("3", None, None), (None, "x", None)], "rec_id string, query string, passage string")
    assert sorted(map(tuple, A.defects_of_pairs(pairs, sent).collect())) == [("2", "empty"), ("3", "empty")]
    queries = spark.createDataFrame([("a", "سؤال عن المدينة القديمة؟", ["p", "p", "q", "missing"]), ("b", None, ["p"]), ("c", "x", None), ("d", "y", [])], "qid string, query string, pos_pids array<string>")
    passages = spark.createDataFrame([("p", None), ("p", None), ("q", "عام 1934"), (None, "x")], "pid string, text string")
    assert sorted(map(tuple, A.defects_of_queries(queries, passages, sent).collect())) == [("a", "p", "empty"), ("b", "p", "empty")]
    assert A.defects_of_pairs(pairs.limit(0), sent).count() == 0


#: Written before the patterns had seen them, when 67 % were found; the patterns were widened after that.
REFUSALS = """
I won't be able to assist you here
I'm afraid I can't answer that question
As a language model, I am not able to provide medical advice
I must decline to discuss this topic
Sorry, I don't have information about this
I would rather not comment on that
Je refuse de répondre à cette demande
Désolé, je ne peux pas vous aider avec cela
Je ne suis pas en mesure de fournir cette information
Das kann ich leider nicht beantworten
Tut mir leid, dabei kann ich nicht helfen
Ich darf dazu keine Auskunft geben
Lo siento, no puedo ayudarte con eso
No estoy autorizado a responder esa pregunta
Prefiero no hablar de este tema
عذرا، لا أقدر على مساعدتك في هذا
أعتذر عن الإجابة على هذا السؤال
لا أملك معلومات عن هذا الموضوع
بصفتي نموذجا لغويا لا يمكنني إبداء رأي في ذلك
لست مؤهلا لتقديم نصيحة في هذا الأمر
نمی‌توانم به این پرسش پاسخ دهم
متاسفم، اجازه ندارم در این موضوع صحبت کنم
معذرت، میں اس سوال کا جواب نہیں دے سکتا
میں اس معاملے میں مدد نہیں کر سکتا
""".strip().split("\n")
SOUND = """
The old bridge cannot carry heavy trucks because the stones are weak.
He said that he could not answer the question and left the room before noon.
No, the river does not freeze in winter.
I do not know the street but the market is near the river.
لا يمكن عبور النهر في الشتاء لأن الماء مرتفع.
قال الوزير للصحفيين إنه لا يستطيع الرد على السؤال قبل انتهاء التحقيق.
لا أعرف المدينة لكنني زرت السوق مرتين مع صديقي.
Nein, die Brücke kann nicht repariert werden.
No se puede cruzar el río en invierno.
Le pont ne peut pas être réparé avant le mois de mai.
""".strip().split("\n")


def test_refusals_of_seven_languages():
    refuses = A.Refusals()
    found = [r for r in REFUSALS if refuses(A.folded(r))]
    assert len(found) >= 0.85 * len(REFUSALS), sorted(set(REFUSALS) - set(found))
    assert not any(refuses(A.folded(s)) for s in SOUND)


def test_models_are_kept_apart(spark, judge):
    first = A.sent_judge(spark, judge.posterior, judge.ends)
    other = A.sent_judge(spark, A.Posterior.train([]), np.zeros_like(judge.ends))
    assert A.judge_of(first) is A.judge_of(first)
    assert A.judge_of(other).ends.any() == False and A.judge_of(first).ends.any()  # noqa: E712


def test_repeated_pids_with_different_texts(spark, judge):
    sent = A.sent_judge(spark, judge.posterior, judge.ends)
    queries = spark.createDataFrame([("a", "سؤال عن المدينة القديمة؟", ["p"])], "qid string, query string, pos_pids array<string>")
    texts = ["نعم.", None, "", "عام 1934"]
    least = min(texts, key=lambda t: A.hashed(t or ""))
    for k in range(3):
        passages = spark.createDataFrame([("p", t) for t in texts[k:] + texts[:k]], "pid string, text string")
        assert [r.defect for r in A.defects_of_queries(queries, passages, sent).collect()] == ([] if least else ["empty"])


def test_untrained_models_flag_nothing():
    w = A.train_ends([])
    assert not w.any()
    j = A.Judge(A.Posterior.train([]), np.zeros_like(w))
    assert kind(j, "سؤال", "جواب طويل من كلمات كثيرة لا ينتهي بنقطة") is None
