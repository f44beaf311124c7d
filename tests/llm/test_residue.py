import pytest
from pyspark.sql import functions as F

from qirtas.llm import residue as R
from tests.llm import residue_phrases as P

TEXT = "نشر الباحث تقريرا عن أثر الأمطار في المحاصيل الغربية وعرض فيه إنارة المصنع."
BAD = [
    "{{ city.name }}", "{%author%}", "<%= count %>", "#{item.price}", "$(title)", "${user}", "{date}", "{0}", "{الاسم}", "[[product]]", "[INSERT first_name]", "@@item.price@@", "__city__", "%(count)s", "%s", "____", "<!--date-->", "<title/>",
    "[اسم المدينة]", "(اكتب العنوان هنا)", "«ضع الرقم هنا»", "[...اسم الجهة...]", "<اسم الكاتب>", "[object Object]", "undefined", "NULL",
]
PAGES = [
    "خطأ 403: الصفحة غير متوفرة", "Error 404: the requested page could not be loaded", "<p class='msg'>Internal server error</p>", "⚠ You need to enable JavaScript to run this app.", "404 Not Found", "يرجى تفعيل جافا سكريبت في متصفحك لمتابعة القراءة\nالرمز 9903",
    "x.example | تحقق من أنك لست روبوتا ثم أعد المحاولة", "ACCESS DENIED. Reference #1.2", "Warning: undefined index id", "محتوى حتى المساحة شكل وهمي نص مؤقت نص هذا قبل الصفحة الأصلي تجريبي كلمة يستبدل هنا", "Umbrati lanterit quentar lanterit melitus volabis tollecta.",
]
FINE = [
    TEXT, "المجموعة {1, 2, 3} جزء من المجموعة {1, 2, 3, 4} كما بين الباحث.", "يشرح الدرس معنى الخطأ 404 ولماذا تظهر رسالة الصفحة غير موجودة عند الزائر.", "تعلم الطلاب لغة جافا سكريبت وطريقة تفعيلها في المتصفح مع المدرب.", "ما معنى الخطأ 404 في المدينة؟",
    "كيف أفعل جافا سكريبت في بيتي؟", "ورد في الهامش [12] أن الزائر جاء عام 404 قبل البناء.", "نسبة النجاح 50% وبلغ السعر 3$ للكيلو.", "كتب الكاتب قالبا للرسائل يضع فيه اسم المستلم في أول السطر.", "أعلنت اللجنة أن موقعها كان تحت الصيانة ثم عاد إلى العمل.",
    "في <span>المدينة</span> &quot;القديمة&quot; <br/> جسر <h1>كبير</h1>.", "", "   ", "في النص هذا شكل قبل هنا.", "it's 'ok' we'll",
]


@pytest.fixture(scope="module")
def finder():
    return R.Finder()


@pytest.mark.parametrize("bad", BAD)
def test_placeholders(finder, bad):
    assert finder.residue(TEXT.replace("المحاصيل", bad))[0] > 0
    assert finder.residue(bad)[0] > 0


@pytest.mark.parametrize("page", PAGES)
def test_pages(finder, page):
    assert finder.residue(page)[0] > 0
    assert finder.residue(f"{TEXT} {page}\n{TEXT}")[0] > 0


@pytest.mark.parametrize("fine", FINE)
def test_texts_about_such_things(finder, fine):
    assert finder.residue(fine)[0] == 0


def test_coverage_decides_exclusion(spark):
    rows = [(1, TEXT, TEXT * 3 + " {date}"), (2, "404 Not Found", TEXT), (3, None, None), (4, "", TEXT), (2, "404 Not Found", TEXT)]
    df = spark.createDataFrame(rows, "pair_id long, query string, passage string").withColumn("field", F.lit("clash"))
    found = R.find_residue(df)
    got = {(r.pair_id, r.field): r for r in found.collect()}
    assert set(got) == {(1, "passage"), (2, "query")} and not got[1, "passage"].excluded and got[2, "query"].excluded
    assert sorted(r.pair_id for r in R.without_residue(df, found).collect()) == [3, 4]
    assert R.find_residue(df.limit(0)).count() == 0


@pytest.mark.parametrize("phrases", [P.FIRST, P.SECOND, P.THIRD, P.FOURTH])
def test_phrases_of_seven_languages(finder, phrases):
    found = [p for p in phrases if finder.residue(p)[0]]
    assert len(found) >= 0.85 * len(phrases), sorted(set(phrases) - set(found))
    assert all(finder.residue(f"{TEXT}\n{p}\n{TEXT}")[0] for p in found)


@pytest.mark.parametrize("talk", P.TALK)
def test_talk_in_seven_languages(finder, talk):
    assert finder.residue(talk)[0] == 0


def test_long_placeholders(finder):
    for bad in ("{{ " + "x" * 300 + " }}", "[" + "اكتب " * 40 + "]", "<" + "اسم الكاتب " * 20 + ">", "${" + "a.b" * 200 + "}"):
        assert finder.residue(f"{TEXT} {bad} {TEXT}")[0] > 0


def test_very_long_text(finder):
    assert finder.residue("كلمة " * 200_000 + "{{ x }}")[0] == 1
