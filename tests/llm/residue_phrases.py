"""Texts of error pages, notices and filler in four sets. Each was written before the patterns had seen it, when 87, 71,
65 and 75 % of it were found; the patterns were widened after each."""

FIRST = """
Oops! Something went wrong
HTTP ERROR 502
JavaScript is disabled in your browser
This site can't be reached
Sorry, the page you requested was not found
Your session has timed out. Please log in again
Error 503: Service Temporarily Unavailable
We use cookies. Please accept cookies to continue
Please complete the captcha to prove you are human
Your IP address has been blocked
The server encountered an internal error
Uncaught TypeError: undefined is not a function
Access to this resource is forbidden
Our website is currently under maintenance, please check back soon
Request timed out. Try again later
This browser is not supported
Please turn off your ad blocker to view this page
Database error: connection refused
Enable JavaScript and cookies to continue
404 - File or directory not found
Lorem ipsum dolor sit amet, sed do eiusmod tempor
This is placeholder text, replace it with your content
Your text goes here
Dieser Text ist ein Blindtext
Seite nicht gefunden
Fehler 404 - Die Seite existiert nicht
Bitte aktivieren Sie JavaScript in Ihrem Browser
Die angeforderte Seite ist leider nicht verfügbar
Interner Serverfehler, bitte versuchen Sie es später erneut
Ihre Sitzung ist abgelaufen
Zugriff verweigert
Bitte bestätigen Sie, dass Sie kein Roboter sind
Der Server antwortet nicht
Page introuvable
Erreur 404 : la page demandée n'existe pas
Veuillez activer JavaScript pour afficher cette page
Accès refusé
Le serveur est temporairement indisponible
Votre session a expiré, veuillez vous reconnecter
Ce site nécessite l'activation des cookies
Une erreur est survenue, veuillez réessayer plus tard
Ce navigateur n'est pas pris en charge
Página no encontrada
Error 500: error interno del servidor
Lo sentimos, la página que busca no existe
Por favor, active JavaScript en su navegador
Acceso denegado
Su sesión ha expirado, vuelva a iniciar sesión
El servicio no está disponible, inténtelo más tarde
Confirme que no es un robot
Este sitio requiere cookies
الصفحة المطلوبة غير متاحة حاليا
عذرا، لم يتم العثور على الصفحة
خطأ داخلي في الخادم
يجب تفعيل جافاسكربت لاستخدام هذا الموقع
متصفحك قديم ولا يدعم هذه الخدمة
انتهت صلاحية الجلسة، يرجى تسجيل الدخول مجددا
تم رفض الوصول إلى هذا المورد
حدث خطأ غير متوقع، حاول مرة أخرى لاحقا
يرجى قبول ملفات تعريف الارتباط للمتابعة
أثبت أنك لست روبوتا
الخدمة غير متوفرة مؤقتا
هذا نص تجريبي مؤقت يستبدل لاحقا
صفحه مورد نظر یافت نشد
خطای ۵۰۰: خطای داخلی سرور
لطفا جاوا اسکریپت را در مرورگر خود فعال کنید
دسترسی شما مسدود شده است
سرور در دسترس نیست، لطفا دوباره تلاش کنید
لطفا تایید کنید که ربات نیستید
این صفحه وجود ندارد
صفحہ موجود نہیں ہے
براہ کرم اپنے براؤزر میں جاوا اسکرپٹ فعال کریں
سرور میں خرابی، دوبارہ کوشش کریں
رسائی مسترد کر دی گئی
آپ کا سیشن ختم ہو گیا ہے
""".strip().split("\n")

SECOND = """
Bad Request: your browser sent an invalid request
You don't have permission to access this page
The connection to the server was lost
This page isn't working
Too many failed login attempts
Cookies are required to use this site
Verify you are not a bot
The link has expired
Scheduled maintenance, the service will return shortly
Warning: Cannot modify header information
Sample content goes here
Die Verbindung zum Server wurde unterbrochen
Cookies sind in Ihrem Browser deaktiviert
Zu viele Anfragen, bitte später erneut versuchen
Hier steht Ihr Text
Trop de requêtes, réessayez plus tard
La connexion au serveur a échoué
Les cookies sont désactivés dans votre navigateur
Ceci est un texte de remplissage provisoire
El enlace ha caducado
Demasiadas solicitudes, espere un momento
JavaScript está deshabilitado en su navegador
Este es un texto de ejemplo
لا تملك صلاحية الدخول إلى هذه الصفحة
الموقع قيد الصيانة، سنعود قريبا
فشل الاتصال بالخادم
تم حظر الوصول من عنوانك
الرجاء تفعيل الكوكيز في المتصفح
الرابط منتهي الصلاحية
ضع النص هنا، محتوى مؤقت
ارتباط با سرور قطع شد
کوکی‌ها را در مرورگر فعال کنید
درخواست‌های زیادی ارسال شده، بعدا تلاش کنید
یہ صفحہ نہیں ملا
کوکیز فعال کریں
""".strip().split("\n")

THIRD = """
We're sorry, but something went wrong. Please refresh the page
500 Internal Server Error
You must enable cookies to log in
The requested URL was not found on this server
Security check: complete the captcha
Account suspended
Unable to connect to the database
Your browser is out of date, please update it
No results found for your request
Insert your title here
Ein Fehler ist aufgetreten, bitte laden Sie die Seite neu
Sie haben keine Berechtigung für diese Seite
Ihr Browser unterstützt kein JavaScript
Wartungsarbeiten: unsere Webseite ist bald wieder erreichbar
Une erreur interne du serveur s'est produite
Vous n'êtes pas autorisé à accéder à cette page
Confirmez que vous n'êtes pas un robot
Site en maintenance, revenez bientôt
Ha ocurrido un error inesperado
El servidor no responde
Debe aceptar las cookies para continuar
Sitio en mantenimiento, volvemos pronto
لا يمكن الوصول إلى هذا الموقع
الخادم لا يستجيب، أعد التحميل
هذا الرابط لم يعد متاحا
يجب السماح بملفات الارتباط لمتابعة التصفح
خطأ في الاتصال بالشبكة
هنا يكتب نص بديل لاحقا
خطای اتصال به پایگاه داده
مرورگر شما پشتیبانی نمی‌شود
کنید فعال را جاوااسکریپت
سرور جواب نہیں دے رہا، بعد میں کوشش کریں
آپ کو اس صفحہ تک رسائی کی اجازت نہیں
تصدیق کریں کہ آپ روبوٹ نہیں
""".strip().split("\n")

FOURTH = """
The website is temporarily down for maintenance
Error establishing a database connection
Whoops, looks like something went wrong
Please reload the page and try again
Your request has been blocked by our security service
400 Bad Request
This page requires JavaScript
Session expired
We could not find the page you were looking for
Text goes here
Die Webseite ist derzeit nicht erreichbar
Anfrage fehlgeschlagen
Zugriff auf diese Ressource ist verboten
Cookies müssen aktiviert sein
Cette page n'est plus disponible
Échec de la connexion à la base de données
Votre adresse IP a été bloquée
JavaScript est désactivé
La página solicitada no está disponible
Error al cargar el contenido
Tiempo de espera agotado
Habilite las cookies
تعذر تحميل الصفحة
الرجاء تفعيل الجافاسكربت
انتهت مهلة الجلسة
غير مصرح لك بالدخول
خطأ 500
صفحه درخواستی پیدا نشد
دسترسی غیرمجاز
لطفا کوکی را فعال کنید
سرور دستیاب نہیں ہے
جاوا اسکرپٹ فعال نہیں ہے
""".strip().split("\n")

#: Texts that talk about such things.
TALK = """
The engineer explained why a page was not found and how the team repaired the server in two days.
In 2019 the city opened a website for visitors of the old bridge.
Students learn JavaScript in the first year and write small games for their friends.
How do I enable JavaScript in my browser?
The library was under maintenance for three months while workers replaced the roof.
A robot carried the boxes from the ship to the market.
Sorry for the delay, the train arrived at noon with all passengers.
Der Fehler des Fahrers führte gestern zu einem Stau in der Stadt.
Die Seite des Buches war zerrissen, aber der Text blieb lesbar.
Der Server einer Schule wurde am Montag durch ein neues Gerät ersetzt.
La page du journal parlait du marché et des prix du blé.
Le robot de cuisine coûte moins cher depuis le mois de mars.
L'accès au pont est interdit aux camions pendant l'hiver.
El error del árbitro cambió el resultado del partido de ayer.
La página web del museo recibe miles de visitas cada mes.
Los trabajadores pidieron acceso al agua y a la escuela.
أغلقت البلدية الموقع الأثري أمام الزوار بسبب أعمال الترميم.
قدم المعلم نصا قديما للطلاب وطلب منهم قراءة الفقرة الأولى.
تعطل القطار ساعتين ثم وصل الركاب إلى المحطة.
شرح المهندس سبب الخطأ في الخادم وطريقة إصلاحه أمام الحاضرين.
كتب الصحفي عن صفحة من تاريخ المدينة وعن سوقها القديم.
اشترت الشركة متصفحا جديدا لموظفيها ودربتهم على استخدامه أسبوعا.
معلم پرسید چرا صفحه کتاب پاره شده است.
ربات جدید در کارخانه کار کارگران را آسان کرد.
شہر میں نئی ویب سائٹ سے لوگوں کو فائدہ ہوا۔
""".strip().split("\n")
