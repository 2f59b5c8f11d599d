"""Word lists of ``engram.llm.mentions``. Fixed values, all of them; plain language, from no corpus."""

from __future__ import annotations


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


# Ends of domains, words before an address or number, and words before what only looks like one.
TLDS = _words("com org net edu gov mil int info biz io dev app ai co me eu uk us de fr es it nl be at ch se no dk fi pl cz pt gr ru ua jp cn kr in br mx ar au nz ca test example invalid local")
NOT_MAIL = _words("a an the this that these those it is are was were be been look looks break breaks meet start starts stop stops only now here there at by in on of or and")
MAIL_WORDS = _words("mail email e-mail mailto write contact kontakt écrire reply-to from to cc bcc address at me log invite send forward correo à")
PHONE_WORDS = _words(
    "tel phone telephone call ring llame al mobile cell fax number callback callback_number on-call is sms text whatsapp dial telefon anrufen rufnummer "
    "teléfono appeler тел телефон 電話 电话 전화 handy portable móvil celular telefone cellulare ligue"
)
NOT_PHONE = _words("build ticket no lines line offset host id uuid trace ratio step version v row rows rate port page p item code order commit hash ref release bytes entries room flight invoice isbn serial batch")
ADDRESS_WORDS = _words("to at addr address lives live moved an au à in from near on ship deliver office adresse dirección anschrift adres")

# Street words.
STREET_EN = "Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Crescent|Cres|Drive|Dr|Court|Ct|Way|Close|Square|Sq|Terrace|Place|Pl|Gardens|Boulevard|Blvd|Row|Mews|Parade|Highway|Hwy"
STREET_FR = "rue|avenue|boulevard|bd|place|chemin|allée|impasse|quai|cours|route|passage|square"
STREET_ES = "Calle|C/|Avenida|Avda\\.?|Plaza|Paseo|Camino|Carrera|Ronda|Via|Viale|Piazza|Corso|Rua|Travessa|ulica|ul\\.|улица|ул\\.|проспект|пр\\."

# Words before an identity number.
ID_WORDS = (
    r"ssn|s\.s\.n\.|social security(?: (?:number|no\.?))?|soc\.? sec\.?(?: (?:number|no\.?))?|national insurance(?: (?:number|no\.?))?|ni (?:number|no\.?)|nino|"
    r"insurance (?:number|no\.?)|passport(?: (?:number|no\.?))?|passnummer|reisepass(?:nummer)?|pasaporte|passeport|personalausweis|ausweis(?:nummer)?|"
    r"dni(?: n\.?º)?|nie|nif|documento(?: n\.?º)?|tax id|steuer-?id|id (?:number|no\.?|card)|identity (?:number|no\.?|card)|national id|driver'?s licen[cs]e|"
    r"licen[cs]e (?:number|no\.)|паспорт|снилс|инн|cpf|rg n\.?º|pesel|bsn|nhs (?:number|no\.?)|codice fiscale|curp|aadhaar|personnummer|身份证号?|護照號?|护照号?|"
    r"マイナンバー|旅券番号|주민등록번호|여권번호"
)

# Words that are no names: function words, days, months and words for groups and things.
NOT_NAME = _words(
    "a an the this that these those it its is are was were be been has have had do does did will would can could may might must should "
    "of in on at by for from to with about and or but nor not no yes if as so because while when who why how what where which whose our "
    "we you he she they them us his her their your my me i il la le les un une des du de el los las una uno al del se su lo y o en por "
    "para con der die das dem den des ein eine einer und oder nicht wer warum im am zu zur zum auf mit von für platform team project "
    "branch service note release codename dashboard each every old new any all some there here once now then still only ask call ring "
    "mail see set run use host build row value tel phone owner signed cc assigned according please thank met laut gracias "
    "er sie wir ihr ich él ella ellos elle elles nous vous on он она оно они мы вы ты я это "
    "monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december "
    "montag dienstag mittwoch donnerstag freitag samstag sonntag lunes martes miércoles jueves viernes sábado domingo lundi mardi mercredi jeudi vendredi samedi dimanche "
    "hi hello hey dear hallo hola bonjour ciao thanks merci danke yes please welcome sorry yesterday today tomorrow gestern heute ayer hier "
    "siehe nr bzw usw etc vgl ggf voir véase cf nobody everyone someone everybody both support customer client manager director office company department"
)
DETERMINERS = _words("a an the this that these those our your their its every each another der die das dem den des ein eine einem einen einer unser el la los las un una unos lo le les une ce cette il lo gli i o os as um uma het een")
PREPOSITIONS = _words(
    "to with from by for of about via versus vs than like through von mit für an bei durch nach de por para con a à avec pour par chez d' di da per от для с у к о van voor met na com"
)
COORDINATORS = _words("and & y e et und или и o or oder ou och en sowie plus")
BEING = _words("is was are were am be being named called bin ist war heiße heißt hieß es soy eres era llama llamo est suis était appelle è sono sou são é это зовут nama became remains")
ROLES = _words(
    "customer client patient colleague neighbour neighbor friend cousin uncle aunt brother sister wife husband daughter son nephew niece teacher nurse doctor lawyer engineer "
    "manager director author editor chair president minister senator judge captain coach singer actor writer poet painter professor student tenant witness guest candidate "
    "employee contractor intern founder ceo cto cfo owner driver pilot kollege kollegin nachbar freund freundin onkel tante lehrer lehrerin chef chefin kunde kundin autor "
    "amigo amiga vecino vecina hermano hermana jefe jefa cliente autora profesor profesora collègue voisin voisine ami amie frère sœur auteur directeur directrice "
    "amico amica zio zia medico коллега друг подруга брат сестра автор врач учитель директор"
)
THINGS = _words(
    "project release codename version team group company street road avenue lake river mount mountain island valley city town village county province region university college school "
    "hospital hotel station airport bridge tower palace castle church museum theatre park square bank club league cup trophy award prize festival conference summit law act treaty "
    "dashboard module service server cluster library package engine protocol format plan programme program model series edition ship vessel brand product line memo column table branch "
    "building room floor hall campus port house mill farm forest bay cape mission operation case account fund index topic channel folder repository framework app tool job task queue "
    "projekt stadt fluss firma straße verein schule klinik proyecto empresa ciudad río calle equipo projet société ville rivière équipe проект город улица река компания"
)
ENDING_THINGS = _words("inc ltd llc gmbh ag corp co plc sa srl bv nv oy ab foundation institute association union committee agency ministry department group holdings partners systems labs studio studios press records motors airlines")

# Titles, parts of names and forms of address.
TITLE = r"(?:Dr|Prof|Mr|Mrs|Ms|Miss|Mx|Sir|Herr|Frau|Sr|Sra|Srta|Don|Doña|Mme|Mlle|Dott|Ing|Rev|Hon|г-н|г-жа|д-р)\.?"
PARTICLE = "van|von|der|den|de|da|di|du|del|della|la|le|ten|ter|zu|zur|al|el|bin|ibn|ben|ní|nic|mac|af|dos|das|do|y|e|ter"
HONORIFIC = "さん|さま|様|氏|くん|君|ちゃん|先生|殿|씨|님|女士"

# What comes before a name, and what comes before one now and then.
CUES = tuple(
    "assigned to|according to|thank|thanks to|thank you|met with|meet with|met|talk to|talked to|spoke with|spoke to|speak to|signed|signed,|regards|regards,|sincerely,|yours,|owner|author|"
    "assignee|reviewer|reviewed by|approved by|written by|reported by|filed by|fixed by|signed-off-by|signed off by|contact|attn|attn.|cc|bcc|dear|hola|gracias a|según|laut|danke an|gemäß|"
    "selon|merci à|d'après|gesprochen mit|escribe a|спасибо|согласно|по словам|name|nombre|nom|name is|i am|i'm|née|born|married|named|called|lunch with|dinner with|call with|meeting with|"
    "interview with|letter from|letter to|email from|message from|note from|forward this to|forward it to|hand it to|sent to|sent by|given to|belongs to|written to|replied to|asked by|"
    "led by|headed by|chaired by|founded by|painted by|composed by|directed by|treated by|hired by|care of|c/o|on behalf of|heiße|heißt|mein name ist|grüße,|llamo|me llamo|firmado|firmado,|"
    "saludos,|señor|señora|atentamente,|je m'appelle|m'appelle|cordialement,|mi chiamo|cordiali saluti,|me chamo|зовут|с уважением,|автор|от имени|patient|tenant|attendee|attendees|participants|"
    "sender|recipient|from|to|by|manager|kontakt|ansprechpartner|autor|paziente".split("|")
)
# Those after which small letters are hardly ever a name.
WEAK_CUES = frozenset(
    "ask|asked|hi|hello|invited|ping|pinged|from|to|by|met|called|named|born|patient|tenant|manager|name is|i am|i'm|married|lunch with|dinner with|call with|meeting with|interview with|letter from|letter to|email from|"
    "message from|note from|sent to|sent by|given to|belongs to|written to|replied to|asked by|care of|kontakt|sender|recipient|heißt|thank you|forward it to|hand it to|autor".split("|")
)
VERBS = _words(
    "reviewed approved wrote said says asked merged fixed reported confirmed noticed signed filed left joined lives called told thinks works attended arrived agreed explained replied "
    "answered visited invited phoned emailed sent moved married died studied teaches taught met suggested announced resigned won lost paid bought sold booked cancelled visits wants "
    "hat hatte läuft schrieb sagt sagte fragte meint arbeitet wohnt kam ging rief kaufte dijo escribió vive trabaja llamó llegó preguntó compró firmó a dit habite travaille appelle arrive demanda "
    "scrisse disse lavora vive chiamò falou disse mora trabalha написал написала сказал сказала живёт работает позвонил позвонила спросил спросила пришёл пришла купил купила"
)

# Common given names of many languages.
GIVEN = _words(
    "james john robert michael william david richard joseph thomas charles daniel matthew anthony mark paul steven andrew george edward brian kevin jason peter henry jack simon martin oliver "
    "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa margaret sandra ashley emily emma olivia sophia grace alice jane helen laura julia rachel hannah claire "
    "bob bill tom jim joe mike dave dan sam ben alex max leo kate anne ann amy lucy ruth maria anna eva nina ida ella clara marta elena irina olga "
    "hans karl klaus jürgen wolfgang stefan andreas jan lars sven ingrid ursula heike petra sabine greta jose josé juan carlos luis miguel pedro pablo diego carmen ana lucía sofía isabel "
    "pierre jean jacques michel marie camille luc giovanni marco luca paolo giulia francesca joão paulo rita ahmed mohammed fatima omar ali aisha priya raj amit anita ravi wei li ming hiroshi "
    "yuki kenji kim"
)
GIVEN_OTHER = _words("анна борис вера иван мария сергей елена олег павел наталья дмитрий ольга андрей михаил татьяна алексей γιώργος μαρία νίκος ελένη γιάννης")

# Common family names written without spaces.
CHINESE = "王李张陈刘杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟"
JAPANESE = _words("佐藤 鈴木 高橋 田中 伊藤 渡辺 山本 中村 小林 加藤 吉田 山田 佐々木 山口 松本 井上 木村 斎藤 清水 山崎 池田 橋本 阿部 石川 前田 藤田 小川 岡田 後藤 長谷川 村上 近藤 石井 坂本 遠藤 青木 藤井 西村 福田 太田 三浦 藤原 岡本 松田 中川 中野 原田 小野 田村 竹内")
KOREAN = "김이박최정강조윤장임한오서신권황안송류홍"
# Words in Chinese around a name.
CHINESE_BEFORE = "联系|感谢|谢谢|由|与|跟|找|请|叫|给|告诉|通知|同事|客户|作者|我是|负责人|医生|老师|和"
CHINESE_AFTER = "写了|说|修复|提交|负责|住在|来自|问|告诉|认为|表示|已经|审核|批准|打电话|的电话|的邮箱|的地址|离开|加入|参加|发现"
