"""Template residue and error-page text (problem 5).

A multi-pattern automaton goes once over the folded words of each field. Its patterns are not sentences but what such
pages say, in seven languages: the things of the web (pages, servers, browsers), failures, requests to the reader,
scripts and robot checks, and the words of filler text. A stretch (a sentence, a line or a run of one script) is residue
when the matched words cover a high share of its content words and the classes that a notice needs come together, such
as a failure and a thing of the web, or a script and a request. Text that talks about errors, scripts or forms has words
of its own around such ones, so its coverage is low; a question is no notice.

Filler in made-up Latin is told by the endings of its words and by the absence of the small words that every sentence
of a living language has. Placeholders are found by their opening signs, which are patterns of a second automaton over
the characters, and confirmed by their whole form.

A field is excluded when ``coverage`` of its words is residue; ``found`` fields hold residue at all.

Scale: one pass over the records, no shuffle; the patterns are fixed.

Defined results: null and blank fields hold no residue; both fields are judged on their own; repeated rows give one
result; whole texts are searched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qirtas.llm.patterns import SMALL, automaton, classes, last_words, stem
from qirtas.llm.words import no_markup, same

# Each entry of a class is one or several words; * stands for any end of the last one. Arabic words stand without
# article and joined particles, in the folded spelling of ``same``. (fixed values)
#: Things of the web that ordinary text has too.
THING = """
site*, request*, connection*, session*, link, links, address, account, content, app, service*, network, resource*, file*, user*, access, owner, id, reference, code, home, results, line, index, variable, array, offset, memory, key, login, data, object, host, team, support, looking for
demande*, connexion, lien, adresse, compte, contenu, service*, réseau, ressource*, fichier*, accès, accueil, recherch*, données
anfrage*, verbindung, sitzung, link, adresse, konto, inhalt*, dienst, netzwerk, datei, zugriff, gesucht*, daten
sitio*, solicitud*, conexión, sesión, enlace, dirección, cuenta, contenido, servicio, red, recurso, archivo, acceso, inicio, busca*, datos
موقع*, طلب*, اتصال*, جلسه*, جلستك, عنوان*, حساب*, محتوي*, تطبيق*, خدمه, شبكه, ملف, ملفات, مدير موقع, رييسيه, معرف, رمز, مرجع, دخول, وصول, صلاحيه, نتايج, تبحث عن*, اتبعت*, بيانات, طويل*, لغه برمج*
درخواست*, اتصال, نشست, ادرس, حساب*, محتوا*, برنامه, شبكه, دسترسي, جستجو, مورد نظر
درخواست, رابطه, پته, اكاونٹ, مواد, رسايي, تلاش, مطلوبه
"""
#: Things that only the web has.
WEB = """
page, pages, website*, webpage*, server*, browser*, url, urls, http*, nginx, apache, cloudflare, database*, gateway*, webmaster*, homepage, host name, app crash*
serveur*, navigateur*, page, site web, base de données, passerelle
seite, seiten, webseite*, internetseite, startseite, server*, browser*, datenbank*
página*, sitio web, servidor*, navegador*, base de datos, página web
صفحه, صفحات, صفحتك, خادم*, سيرفر*, متصفح*, رابط, روابط, قاعده بيانات, موقع الكتروني
صفحه, وب سايت, سايت, سرور*, مرورگر*, پايگاه داده, لينك
صفحه, ويب سايٹ, سايٹ, سرور*, براوزر*, لنك, سيشن
"""
#: Failures that few other texts state in these words.
FAILURE = """
error, errors, not found, could not find, looks like something went wrong, whoops, no results, out of date, no longer valid, not valid, try again later, not respond*, could not connect, something went wrong, an error occurred, can t be reached, cannot be reached, can t be found, cannot be found, be found, unavailable, not available, no longer available, no longer exist*, does not exist, doesn t exist, forbidden, denied, unauthorized, not authorized, not allowed, bad gateway, bad request, internal server, timeout, timed out, time out, expired, failed, failure, exception, fatal, undefined, too many, rate limit*, under maintenance, maintenance mode, went wrong, not support*, doesn t support, unsupported, traceback, keyerror, typeerror, valueerror, sqlstate, stack trace, nullpointer*, syntax error, connection refused, connection reset, could not load, couldn t load, cannot load, unable to load, failed to load, could not be loaded, temporarily, suspended, service unavailable, oops, is disabled, are disabled, blocked, not responding, too long, out of memory
erreur, erreurs, plus disponible*, bloqué*, échec*, suspendu*, s est produit*, n êtes pas autorisé*, pas autorisé*, ne répond*, hors ligne, plus valide, aucun résultat*, une erreur est survenue, quelque chose s est mal passé, temporairement, n est pas pris en charge, introuvable*, indisponible*, non trouvé*, pas trouvé*, n existe pas, n existe plus, pas disponible, interdit*, refusé*, expiré*, a échoué, échec*, trop de, en maintenance, désactivé*, oups, délai dépassé, ne répond pas, pas autorisé, ne prend pas en charge
fehler, fehlgeschlagen, muss aktiviert, müssen aktiviert, keine ergebnisse, keine berechtigung, nicht mehr gültig, nicht möglich, etwas ist schiefgelaufen, ein fehler ist aufgetreten, vorübergehend, nicht gefunden, nicht verfügbar, nicht erreichbar, existiert nicht, nicht mehr, verboten, verweigert, abgelaufen, fehlgeschlagen, zu viele, gesperrt, wartungsarbeiten, wartungsmodus, deaktiviert, ungültig*, nicht unterstützt, unterstützt kein*, zeitüberschreitung, antwortet nicht, hoppla
error, bloquead*, fallo, falló, no responde*, no tiene permiso*, sin resultados, ha ocurrido, no válid*, no es posible, algo salió mal, se ha producido un error, temporalmente, no encontrad*, no se encontró, no se encuentra, no se ha encontrado, no encontramos, no se pudo, no disponible, no está disponible, no existe, ya no existe, prohibid*, denegad*, caducad*, ha expirado, expiró, demasiad*, en mantenimiento, desactivad*, deshabilitad*, no es compatible, no admite, tiempo de espera, ha fallado, ups
خطا, اخطاء, لا يمكن وصول, لم يعد متاح*, لم تعد متاح*, لا توجد نتايج, غير ممكن, منتهي صلاحيه, منتهيه صلاحيه, تعذر وصول, حدث خطا ما, ولا يدعم, ولا تدعم, غير موجود*, غير متوفر*, غير متاح*, لم يتم عثور, لم نعثر, لم نجد, لم يعثر, تعذر, فشل, حظر, حظرك, محظور, مرفوض, تم رفض, ليس لديك, لا تملك, غير مصرح, غير مسموح, مهله, انتهت صلاحيه, انتهت جلس*, تحت صيانه, قيد صيانه, لا يدعم, لا تدعم, غير مدعوم, غير مفعل, معطل, معطله, غير صالح*, كثره طلب*, لم تعد, عذرا, حدث خطا, خلل, لا يستجيب, استغرق*
خطا, خطاي, غيرمجاز, قطع شد, پاسخ نمي*, ممكن نيست, يافت نشد, پيدا نشد, وجود ندارد, دسترس نيست, مسدود*, غيرفعال, غير فعال, منقضي, ناموفق, متاسفانه, رد شد, پشتيباني نمي*, غير مجاز
خرابي, غلطي, جواب نهيں, اجازت نهيں, ممكن نهيں, ايرر, نهيں ملا, نهيں ملي, نهيں مل, موجود نهيں, دستياب نهيں, معذرت, ناكام, ختم هو*, مسترد, بلاك
"""
#: Failures in words that many texts have.
WEAK_FAILURE = """
moved, deleted, removed, down, bad, lost, was lost, header information, closed, interrupted, isn t, working, not working, don t have, permission, scheduled, unexpected, unknown, modify, reset, gone, limit, exceeded, reached, wrong, notice, warning, missing, sorry, internal, offline, broken, invalid, problem, null, maintenance, unable, could not, cannot, can t, not, modify, header*
déplacé*, supprimé*, perdu*, interrompu*, inattendu*, autorisation, problème, désolé*, impossible, maintenance, limite, pas, plus, avertissement
verschoben, gelöscht, unterbrochen, verloren, unerwartet*, berechtigung, leider, problem, wartung, nicht, warnung, kein, keine
movid*, eliminad*, perdid*, interrumpid*, inesperad*, permiso*, problema, lo sentimos, mantenimiento, límite, error, no, aviso, falló
نقل*, حذف*, ازال*, قديم, مشكله, حدث, كثره, صيانه, انتهت, انتهي, بسبب, لا, لم, غير, تم, تمت, تحذير, مشغول, كثير, منتهي, منتهيه, فقد, انقطع, انقطاع, صلاحيه, داخلي, غير متوقع
حذف, منتقل, مشكل, قطع, زياد, زيادي, نشد, نيست, نشده, شده, شد
حذف, منتقل, مسيله, نهيں, بند
"""
#: What the reader is asked to do, or is needed.
REQUEST = """
please, enable*, activat*, turn on, turned on, switch on, switched on, allow*, accept*, disable, turn off, refresh*, reload*, retry, try, again, check*, verify*, verif*, confirm*, prove, go back, return, back, contact, report, sign in, log in, wait, complete, solve, continue, proceed, need*, require*, must, update, upgrade, use, used, used here, install, run, click*, view*, display*, show*, load*, see, correct, back, browse, update it, before, moment*, later, soon, shortly, will return, be back, few minutes, work*, properly, correctly, access*
veuillez, activ*, autoris*, accept*, rafraîch*, actualis*, recharg*, réessay*, vérifi*, confirm*, retour*, contact*, connect*, patient*, continuer, poursuivre, nécess*, requi*, mettre à jour, affich*, cliqu*, plus tard, bientôt, utilis*, fonction*, nouveau, revenez, revenir, accéder
bitte, aktivier*, erlaub*, akzeptier*, zulassen, neu laden, laden, aktualisier*, versuch*, erneut, später, prüf*, überprüf*, bestätig*, zurück*, kontaktier*, anmeld*, melden, muss, müssen, aktiv*, wart*, fort*, benötig*, erforder*, anzuzeigen, anzeigen, verwend*, wiederhol*, noch einmal, bald, wieder, erreichbar, diese
por favor, activ*, habilit*, permit*, acept*, actualiz*, recarg*, intent*, inténtel*, vuelv*, volver, nuevo, más tarde, carg*, verifi*, comprueb*, comprob*, confirm*, contact*, inici*, esper*, continuar, requier*, necesit*, mostrar, ver, pronto, volvemos, debe, utiliz*, usar
يرجي, رجاء, سماح*, بسماح, فعل, فعلوا, تفعيل*, تشغيل*, شغل, سماح, اسمح, قبول, اقبل, تحديث*, حدث, اعد, اعاده, عد, حاول, حاولوا, محاوله, مره اخري, مجددا, تحقق, تاكد*, اثبت, اثبات, عوده, ارجع, ابلاغ, ابلغ, تواصل, سجل, تسجيل, انتظر*, انتظار, متابعه*, تابع, استمرار, يتطلب, تتطلب, مطلوب*, تحتاج, يحتاج, يجب, عرض*, استخدم*, استخدام, اضغط, انقر, تحميل*, نعود, قريبا, سنعود, تصفح, لاحقا, نفحص, فحص, قليل, اعدادات, لحظه, لحظات, بقيه, موقتا, حاليا, اكمل, يعمل, تعمل
لطفا, فعال*, كنيد, دوباره, مجددا, امتحان, تلاش, بررسي*, تاييد*, بازگشت, تماس, وارد, صبر, نياز*, ارسال, نمايش, ادامه, بعدا, روشن, لازم, چند لحظه
براه كرم, مهرباني, فعال, كريں, دوباره, كوشش, تصديق, رسايي, اجازت, واپس, انتظار, ضرورت, ضروري, جاري, ديكهنے, بعد ميں, آن
"""
#: Scripts, cookies and robot checks.
SCRIPT = """
javascript, java script, js, cookie*, script, scripts, captcha*, recaptcha*, robot, robots, bot, a human, are human, you re human, adblock*, ad blocker*, popup*, noscript
javascript, robot, humain, cookies, témoins de connexion, bloqueur
skript*, javascript*, roboter, mensch sind, werbeblocker, cookies
robot, humano, scripts, cookies, bloqueador de anuncios
جافا, جافاسكر*, ملفات ارتباط, سكربت*, سكريبت*, كوكيز, تعريف ارتباط, روبوت*, برامج نصيه, نصوص برمجيه, كابتشا, مانع اعلانات, حاجب اعلانات, جافا سكر*
جاوا, جاوااسكريپت, جاوا اسكريپت, اسكريپت*, كوكي*, ربات, كپچا
جاوا, جاوا اسكرپٹ, اسكرپٹ*, كوكيز, كوكي, روبوٹ, كيپچا
"""
#: What programs print when they fail.
TECHNICAL = """
traceback, keyerror, typeerror, valueerror, nameerror, indexerror, attributeerror, nullpointer*, sqlstate, stack trace, fatal error, uncaught, undefined index, undefined variable, undefined offset, array key, array offset, offset on null, memory limit, out of memory, segmentation fault, core dumped, syntax error, parse error, exception in, internal server error, bad gateway, object object, php warning, mysql*, stack overflow, division by zero, permission denied, server gone
"""
#: Words for a text that stands in for another one.
STAND_IN = """
placeholder*, dummy, sample, filler, lorem, ipsum, example, temporary, replace*, goes here, to be added, coming soon, tbd, todo, stand in
exemple, factice*, remplissage, fictif, fictive, remplac*, provisoire, faux texte, bouche trou
blindtext*, platzhalter*, beispiel*, mustertext*, ersetz*, fülltext*
ejemplo, relleno, ficticio, provisional, reemplaz*, sustitu*, de prueba
تجريبي*, موقت*, وهمي*, بديل*, نموذج*, يستبدل*, استبدال*, ملء, يوضع, افتراضي*, مثال, لاحقا, حشو
نمونه, ازمايشي, ساختگي, موقت, جايگزين*, آزمايشي
نمونه, عارضي, متبادل, فرضي
"""
#: What such a text calls itself or its place.
TEXT = """
text, content, paragraph*, line, word, title, name, heading, description, here, your, caption, subtitle, body, article, only, write, put, insert, fill, enter
texte, contenu, paragraphe, titre, ici, votre, ligne, mot
text, inhalt, absatz, titel, hier, steht, ihr, zeile, wort, überschrift
texto, contenido, párrafo, título, aquí, su, línea, palabra
نص, نصوص, نصك, محتوي, محتواك, فقره, سطر, كلمه, عنوان, شكل, مساحه, صفحه, هنا, يكتب, اكتب, ضع, ادخل, املا, فرعي, اصلي, نشر, فقط, عرض, مكان
متن, محتوا, پاراگراف, عنوان, اينجا, سطر
متن, مواد, پيراگراف, عنوان, يهاں
"""
#: Words that ask for a text to be put in (fixed values).
INSERT = frozenset(same(w) for w in "insert put write enter einfügen eingeben insérer saisir insertar escriba ضع اكتب أدخل املأ".split())
#: Words that ask (fixed values).
ASKING = frozenset(same(w) for w in "ما ماذا كيف هل لماذا متي who what how why when where which comment pourquoi quand quel quelle wie warum wann wer was cómo qué por cuándo quién چرا چگونه چطور کیا کیسے کیوں چه".split())
#: Words of the usual filler passage (fixed values).
LOREM = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident culpa officia deserunt mollit anim laborum ut et do ex ea in".split())
#: Endings of Latin words (fixed values).
LATIN_END = ("us", "um", "is", "it", "at", "et", "ur", "or", "ar", "am", "em", "nt", "que", "ibus", "es", "ae", "ta", "ti", "te", "to", "ri", "ga", "de", "mo", "ia", "ro", "ra", "na", "ni", "no", "do", "as", "os", "on", "re")
#: A stretch is residue where this share of its content words is matched.
STRETCH_COVERAGE = 0.7
#: Words a stretch of filler has at least.
FILLER_WORDS = 4
#: A field is excluded where this share of its words is residue.
FIELD_COVERAGE = 0.3

_WORD = regex.compile(r"[\p{L}\p{N}\p{Mn}\p{Cf}ـ]+")
_STOP = regex.compile(r"[\n\r.!?؟|:;•,،؛]|\s[-–—]\s")
_END = regex.compile(r"[\n\r.!?؟|;•]|\s[-–—]\s")
_ASKS = regex.compile(r"[?؟]")
_DOMAIN = regex.compile(r"(?:https?://)?[\w-]+(?:\.[\w-]+)*\.(?:example|com|org|net|info|edu|gov|io)\b\S*")
_FILL = regex.compile(r"\b(?:ال)?(?:اسم|تاريخ|أدخل|ادخل|اكتب|ضع|املأ|ملء|رقم|عنوان|مدينة|جهة|كاتب|حقل)\b|(?i:\b(?:insert|your|enter|fill in|type|write|placeholder|insérer|votre|saisir|einfügen|eingeben|ihr|insertar|introduzca|escriba|su)\b)")
_TAGS = "a|abbr|b|big|blockquote|body|br|center|code|div|em|font|form|h[1-6]|head|header|hr|html|i|iframe|img|input|label|li|link|main|meta|nav|ol|option|p|pre|q|s|script|section|select|small|span|strong|style|sub|sup|svg|table|tbody|td|th|thead|tr|u|ul|video"
PLACEHOLDER = regex.compile(
    r"\{\{[^{}\n]+\}\}|\{%[^{}%\n]+%\}|<%[^<>%\n]+%>|[#$%]\{[^{}\n]+\}|\$\([\p{L}_][^()\n]*\)|%\([^()\n]+\)[sdf]"
    r"|\{(?:[\p{L}_][^{}\n,]*|\d{1,3})\}|\[\[[\p{L}_][^\[\]\n]*\]\]|@@[\w.]+@@|__[a-zA-Z](?:[\w.]*?[a-zA-Z0-9])?__|(?<![\w])_{3,}(?![\w])|(?<![\p{N}\w%])%[sd](?!\w)|<!--\s*[\w.]+\s*-->"
    r"|(?i:\[object \w+\])"
    rf"|<(?!(?i:{_TAGS})\s*/?>)[a-zA-Z_][\w.]*\s*/>"
    r"|(?<![A-Za-z][\s]{0,3})(?<![\w'‘’])(?:undefined|NULL|null|NaN|None|nil)(?![\w'‘’])(?!\s{0,3}[A-Za-z])"
)
#: Brackets whose content asks to be filled in; round ones and guillemets only around "write ... here".
_BRACKET = regex.compile(r"\[([^\[\]\n]*)\]|\{([^{}\n]*)\}|<([^<>\n]*)>")
_ROUND = regex.compile(r"[(«](?:أدخل|ادخل|اكتب|ضع|املأ)\b[^()«»\n]+\bهنا\b[^()«»\n]*[)»]")
#: Signs that open a placeholder.
SIGNS = ("{", "<%", "${", "#{", "%{", "$(", "%(", "[", "@@", "__", "%s", "%d", "<", "(أدخل", "(ادخل", "(اكتب", "(ضع", "(املأ", "«أدخل", "«ادخل", "«اكتب", "«ضع", "«املأ", "undefined", "NULL", "null", "NaN", "None", "nil")
#: A match makes these classes of words strong evidence; without one of them a text is not looked at closely.
CLASSES = {"thing": THING, "web": WEB, "failure": FAILURE, "weak": WEAK_FAILURE, "request": REQUEST, "script": SCRIPT, "technical": TECHNICAL, "stand-in": STAND_IN, "text": TEXT}
ANCHORS = frozenset(("failure", "script", "technical", "stand-in", "web"))
#: So many words of texts about themselves are looked at without an anchor, too.
TEXT_WORDS = 6


class Finder:
    def __init__(self) -> None:
        self.known: dict[str, str] = {}
        self.auto = automaton(CLASSES)
        self.signs = ahocorasick.Automaton()
        for s in SIGNS:
            self.signs.add_word(s, s)
        self.signs.make_automaton()

    def words(self, raw: list[str]) -> list[str]:
        known = self.known
        try:
            return [known[w] for w in raw]
        except KeyError:
            if len(known) > 400_000:
                known.clear()
            for w in raw:
                if w not in known:
                    known[w] = stem(w)
            return [known[w] for w in raw]

    def placeholders(self, text: str) -> int:
        if next(self.signs.iter(text), None) is None:
            return 0
        n = len(PLACEHOLDER.findall(text)) + len(_ROUND.findall(text))
        if not n:
            n = sum(1 for m in _BRACKET.finditer(text) if (x := m.group(m.lastindex)) and _FILL.search(x) and not regex.search(r"\d|=", x))
        return n

    def residue(self, text: str) -> tuple[int, int]:
        """Words of residue, and all words; a placeholder counts as one word."""
        placeholders = self.placeholders(text)
        text = no_markup(text)
        raw = _WORD.findall(text)
        words = self.words(raw)
        n = len(self.stretches(text, raw, words))
        return placeholders + n, max(placeholders, len(words))

    def stretches(self, text: str, raw: list[str], words: list[str]) -> set[int]:
        """The words of the stretches that are residue."""
        hits = list(self.auto.iter(f" {' '.join(words)} "))
        near = [h for h in hits if not h[1][0].isdisjoint(ANCHORS)]
        if sum("text" in kinds for _, (kinds, _, _) in hits) >= TEXT_WORDS:
            near = hits
        latin = latin_runs(raw)
        if not near and not latin:
            return set()
        of = classes(words, hits)
        at = set(latin) | set(last_words(words, near))
        for k, w in enumerate(words):
            if w == "4xx":
                of[k].add("status")
        spans = [m.span() for m in _WORD.finditer(text)]
        names = [m.span() for m in _DOMAIN.finditer(text)] if "." in text else []
        in_name = {k for k, (x, y) in enumerate(spans) if any(a <= x and y <= b for a, b in names)} if names else set()
        script = [None if w.isdigit() or w == "4xx" else w[:1].isascii() for w in words]
        found: set[int] = set()
        for stop in (_END, _STOP):  # sentences and lines, then clauses that are notices by themselves
            done = -1
            for k in sorted(at):
                if k < done:
                    continue
                first, last = k, k + 1
                while first > 0 and not self.cut(text, spans, script, first, stop):
                    first -= 1
                while last < len(words) and not self.cut(text, spans, script, last, stop):
                    last += 1
                done = last
                part = [i for i in range(first, last) if words[i] and i not in in_name]
                asked = _ASKS.search(text, spans[last - 1][1], spans[last][0] if last < len(words) else len(text))
                if part and not asked:
                    whole = notice(part, words, of) or filler([raw[i] for i in part])
                    found.update(part if whole else appended(part, words, of))
        return found

    @staticmethod
    def cut(text: str, spans: list[tuple[int, int]], script: list[bool | None], i: int, stop: regex.Pattern) -> bool:
        """Whether a stretch ends before word ``i``."""
        return script[i] is not None and script[i - 1] is not None and script[i] != script[i - 1] or stop.search(text, spans[i - 1][1], spans[i][0]) is not None


def content_of(part: list[int], words: list[str], of: list[set[str]]) -> list[int]:
    return [k for k in part if not (words[k] == "0" or words[k] in SMALL and not of[k] - {"weak", "text", "request"} or len(words[k]) < 3 and not of[k])]


def notice(part: list[int], words: list[str], of: list[set[str]]) -> bool:
    """Whether the words ``part`` are a notice or filler that calls itself so, by what covers them."""
    if words[part[0]] in ASKING or len(part) < 2:
        return False
    content = content_of(part, words, of)
    n = lambda *kinds: sum(not of[k].isdisjoint(kinds) for k in content)
    page = n("thing", "web", "failure", "weak", "request", "script", "status", "technical")
    if n("technical") and page >= 0.5 * len(content):
        return True
    if page >= STRETCH_COVERAGE * len(content):
        strong, scripts, weak, web = n("failure"), n("script"), n("weak"), n("web")
        asks = sum("request" in of[k] and of[k].isdisjoint({"script", "failure"}) for k in content)
        about = sum(not of[k].isdisjoint({"thing", "web", "status"}) and "failure" not in of[k] for k in content) + sum(words[k] == "0" for k in part)
        if scripts and (strong or asks or weak) or strong and (about or asks or strong > 2) or web and weak and (weak + asks > 1 or page == len(content) > 2) or web and asks > 1 and page == len(content):
            return True
    stand_in = [k for k in content if "stand-in" in of[k]]
    own = {words[k] for k in content if "text" in of[k] and "stand-in" not in of[k]}
    both = n("stand-in", "text")
    if both >= STRETCH_COVERAGE * len(content) and own and len({words[k] for k in stand_in}) >= (1 if len(content) < 4 or len(content) > 4 and both >= 0.85 * len(content) else 2):
        return True
    asks = any(words[k] in INSERT for k in part)
    return both == len(content) and (len(content) > 5 and len(own) > 3 or asks and len(own) > 1 and len(content) < 5)


def appended(part: list[int], words: list[str], of: list[set[str]]) -> list[int]:
    """A notice that follows or precedes other words without a stop: nothing but matched words, five of content or more,
    up to an end of the stretch."""
    kinds = frozenset(CLASSES) | {"status"}
    content = set(content_of(part, words, of))
    for turn in (part[::-1], part):
        run = []
        for k in turn:
            if k in content and of[k].isdisjoint(kinds):
                break
            run.append(k)
        while run and run[-1] not in content:
            run.pop()
        run.sort()
        if sum(k in content for k in run) > 4 and len(run) < len(part) and notice(run, words, of):
            return run
    return []


def latin_runs(raw: list[str]) -> list[int]:
    """The first word of each run of ``FILLER_WORDS`` or more Latin words without small ones: only these are looked at."""
    out, run = [], 0
    for k, w in enumerate(raw):
        run = run + 1 if w.isascii() and w.isalpha() and w.lower() not in SMALL else 0
        if run == FILLER_WORDS:
            out.append(k)
    return out


def filler(words: list[str]) -> bool:
    """Whether a stretch is made-up Latin: no small word of a living language, and nearly all words end as Latin ones."""
    words = [w for w in words if w.isalpha()]
    if len(words) < FILLER_WORDS or not all(w.isascii() for w in words):
        return False
    low = [w.lower() for w in words]
    if sum(w in LOREM for w in low) >= max(FILLER_WORDS, STRETCH_COVERAGE * len(low)):
        return True
    long_ = [w for w in low[1:] if len(w) > 3]
    if len(long_) < FILLER_WORDS - 1 or any(w in SMALL for w in low) or any(w[:1].isupper() for w in words[1:]):
        return False
    return sum(w.endswith(LATIN_END) for w in low if len(w) > 3) >= 0.8 * len([w for w in low if len(w) > 3])


_finder: list[Finder] = []


def find_residue(pairs: DataFrame, key: str = "pair_id", fields: tuple[str, ...] = ("query", "passage"), coverage: float = FIELD_COVERAGE) -> DataFrame:
    """``key, field, n_residue, n_words, share, excluded`` for each field of each record that holds residue."""
    d = pairs.select(F.col(key), *(F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields))).where(F.col(key).isNotNull())
    kind = d.schema[0].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _finder:
            _finder.append(Finder())
        residue = _finder[0].residue
        for batch in batches:
            at, field, n, of = [], [], [], []
            for i, f in enumerate(fields):
                for k, t in enumerate(batch.column(i + 1).to_pylist()):
                    if t:
                        x, y = residue(t)
                        if x:
                            at.append(k)
                            field.append(f)
                            n.append(x)
                            of.append(y)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(field, pa.string()), pa.array(n, pa.int32()), pa.array(of, pa.int32())], names=[key, "field", "n_residue", "n_words"])

    out = d.mapInArrow(run, f"`{key}` {kind}, field string, n_residue int, n_words int")
    share = F.col("n_residue") / F.greatest(F.col("n_words"), F.lit(1))
    return out.withColumn("share", F.round(F.least(share, F.lit(1.0)), 6)).withColumn("excluded", share >= coverage)


def without_residue(pairs: DataFrame, found: DataFrame, key: str = "pair_id") -> DataFrame:
    """The records none of whose fields holds residue."""
    return pairs.join(found.select(key).distinct(), key, "left_anti")


def kept_report(pairs: DataFrame, found: DataFrame, key: str = "pair_id", by: str = "kind") -> DataFrame:
    """``by, n_rows, n_residue, n_excluded, n_kept``."""
    flags = found.groupBy(key).agg(F.max("excluded").alias("excluded"))
    d = pairs.select(key, by).join(flags, key, "left")
    has = F.col("excluded").isNotNull()
    return d.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(has).alias("n_residue"), F.count_if(F.coalesce("excluded", F.lit(False))).alias("n_excluded"), F.count_if(~has).alias("n_kept"))
