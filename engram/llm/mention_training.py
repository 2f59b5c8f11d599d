"""Trains the weights of ``engram.llm.mentions`` on sentences made up here.

``python -m engram.llm.mention_training`` writes mention_weights.json beside this module. The sample is bounded by
EXAMPLES; it is drawn from a seed, so the weights can be made again.
"""

from __future__ import annotations

import json
import math
import random
import re
from bisect import bisect_right
from collections import defaultdict
from pathlib import Path

from engram.llm.mention_words import CHINESE, GIVEN, JAPANESE, KOREAN
from engram.llm.mentions import candidates, decode, plain

EXAMPLES = 16_000
EPOCHS = 12
RATE = 0.2
L2 = 1e-4
SEED = 7

ONSETS = "b br c ch d dr f fl g gr h j k kl l m n p pr r s sk st t th tr v w z".split()
VOWELS = "a e i o u ai ea io ou ei".split()
CODAS = ["", "n", "r", "l", "s", "m", "th", "nd", "rk", "ld", "x"]
CYR = "Анна Борис Вера Глеб Дарья Егор Зоя Игорь Кира Лев Мира Нина Олег Павел Рита Тимур Ульяна Фёдор".split()
CYR_SUR = "Берёзкин Волгина Громов Дубова Ершов Жилина Зорин Калинин Лугова Морев Носова Орлов Полева Рыбин Соснова".split()
KANJI = ["森川 陽太", "白石 美咲", "高橋 蓮", "小野寺 楓", "三浦 湊", "長谷川 結衣", "青木 陸", "藤原 葵", "김 서연", "이 도현"]
TAILS = [
    "", "", "", "\n", " Lunch is at noon.", " We ran out of paper.", " Is the lift working again?", " Nothing else happened.", " Morgen regnet es wohl.", " Der Zug kam zu spät.",
    " La tienda cierra pronto.", " El jardín está seco.", " Le musée ferme lundi.", " Погода хорошая.", " Поезд опоздал на час.", " 明日は雨です。", " 超市九点开门。",
    " Το τρένο άργησε.", " السوق مغلق اليوم.", " ร้านปิดแล้วครับ", " दुकान बंद है।", " 가게가 문을 닫았다.", " He stayed until ten.", " \"Why so late?\" she said.",
    " Our garden needs water.", " Two chairs are missing.", " Will the bus stop here?", " That recipe never works.", " May we open a window?", " Das Brot ist frisch.", " Chaque soir il pleut.", " Then the lights went out.", " A plate fell.", " I left early.", " L’hiver fut long.", " L'eau est froide.", " Y nadie vino.", " I am tired.",
]
HEADS = ["", "", "", "", "The soup was cold. ", "They met on Sun. evening. ", "Der Garten blüht. ", "La puerta está abierta. ", "今日は休みです。 ", "- ", "Well! ", "Agenda:\n", "Дом продан. ", "Are we late? ", "Bring 12 plates. "]

# Sentences with a name: first with a cue, then without any.
NAME_CONTEXTS = [
    "The case was assigned to {}.", "According to {}, prices will rise.", "A big thank you to {} and the kitchen.", "We want to thank {} warmly.", "Thanks to {} nobody got hurt.", "Kind regards, {}", "Yours sincerely, {}", "Signed, {}",
    "Author: {}", "owner: {}", "assignee: {}", "reviewer: {}", "Contact: {}", "cc: {}", "cc {} please", "Attn: {}", "Dear {},", "Hello {},", "We met with {} on the terrace.", "I spoke with {} last night.", "You should talk to {} first.",
    "The report was written by {}.", "Reviewed by {}.", "Approved by {} and the board.", "The form was filed by {}", "Según {}, el tren no sale.", "Gracias a {} llegamos bien.", "Laut {} bleibt es trocken.", "Laut {} kam niemand.", "Laut {} sagte er nichts.", "Según {} vive cerca.", "Selon {} habite ici.", "Danke an {} im dritten Stock.", "Selon {}, la route est barrée.",
    "Merci à {} et bonne soirée.", "Спасибо {} и всем остальным.", "По словам {}, магазин закрыт.", "Nombre: {}", "name: {}", "{}", "From: {}", "To: {}", "On behalf of {}, I accept.", "I am {} from the bakery.", "My name is {}.", "Mein Name ist {}.", "Me llamo {} y vivo aquí.",
    "Je m'appelle {}.", "Mi chiamo {}.", "Меня зовут {}.",
]
PLAIN_NAME_CONTEXTS = [
    "{} and {} arrived together.", "{} attended the wedding.", "{} lives in Oslo now.", "I had dinner with {} on Friday.", "Our dentist is {}, born 1961.", "{} called about the roof.", "{} phoned twice.", "Please pass this to {} in the pharmacy.", "Please forward the keys to {}.",
    "Contact {} at the reception.", "The winner was {}.", "A letter from {} came today.", "The house belongs to {} and her sons.", "{} was late again.", "{} is on holiday until May.", "{}'s bicycle is gone.", "Yesterday {} sold the boat.", "The neighbours {} and {} are away.",
    "Ask {} for the recipe.", "{}, who sings in the choir, has moved.", "Invite {}, {} and {} as well.", "They hired {} as a cook.", "The nurse {} came in.", "My uncle {} repairs clocks.", "He married {} in 1998.", "\"No,\" said {} and left.", "I saw {} at the market.", "{} wrote three novels.",
    "{} said nothing at all.", "{} reviewed the menu", "{} approved the budget.", "{} fixed the fence", "Mit {} war ich im Kino.", "{} wohnt in Graz.", "{} hat gewartet.", "{} hat das Fenster geschlossen.", "Frau Doktor sah {} gestern.", "{} vive en Sevilla.", "Ayer vi a {} en la plaza.", "La carta de {} llegó tarde.",
    "{} habite à Lyon.", "J'ai vu {} au marché.", "Le voisin {} est parti.", "{} lavora a Torino.", "{} mora em Braga.", "Вчера {} купил лодку.", "{} живёт в Твери.", "Письмо от {} пришло.", "Minutes taken by {}", "Present: {}, {}, {}", "{} (chair) opened the meeting.", "The pilot, {}, was unhurt.",
    "Interview with {}", "Tell {} I said hello.", "Happy birthday, {}!", "{} has two cats.", "{} will cook tonight.", "Was {} there?", "He works for {} in the harbour.", "Dinner: {}, {}", "That was {}.", "{} died in 1932.",
]
NAME_LOOKALIKES = [
    "Project {} {} starts in May.", "The {} {} festival is open.", "Lake {} dried up.", "We crossed the {} {} bridge.", "{} {} Ltd. sells tea.", "A {} {} washing machine broke.", "The city of {} is large.", "They drove from {} to {}.", "{} Street is closed.", "{} University opened a lab.",
    "The {} River rose.", "Flights to {} are late.", "Version {} {} 2 is out.", "The {} team won.", "Ask the {} team, please.", "owner: {} company", "owner: none", "owner: kitchen staff", "assigned to nobody", "According to the weather report, it rains.", "Please thank the {} club for it.", "Thank you for the tea.",
    "Signed and sealed.", "cc everyone on this", "We met with the {} board.", "The cook reviewed the menu", "Nobody approved the budget.", "Every guest said yes.", "Laut Wetterbericht regnet es.", "Laut Fahrplan fährt er.", "Gracias a la lluvia crece todo.", "Selon la météo, il pleut.",
    "a letter from last month", "the note from next door", "a message from the board", "an email from last night", "a call with two guests", "sent to every guest", "from house to house", "from the top", "by train", "by hand", "to be continued", "Run from noon to dusk.", "Sorted by size.", "El Sr. alcalde habló.", "La Sra. doctora llegó.", "The Dr. on duty slept.", "Herr im Haus ist der Hund.", "M. le maire est parti.", "Compare it with fig. 3.", "We saw it in the {} catalogue.",
    "It is run by the {} bank.", "Waiting for {} to dry.", "He wrote it down.", "She said no.", "They merged it.", "Er schrieb viel.", "Ella dijo que sí.", "Он написал письмо.", "Plan C. She said no.", "Model T. It sold well.", "Ask for the green one.", "Hi all, dinner is ready.", "Hello everyone,", "Dear customer,",
    "Das Neue {} Werk ist fertig.", "Die Alte Mühle steht noch.", "El Nuevo {} abre hoy.", "Le Grand {} ferme.", "The Old Town Hall is shut.", "White House officials met.", "Golden Gate Park is green.", "Monday Morning News", "Terms And Conditions", "Table Of Contents", "High Blood Pressure", "GREEN TEA SALE", "NO ENTRY",
    "Christmas Eve dinner", "South {} wins again", "North {} Railway", "In {} it snows.", "{} beats {} 3:1.", "A {} {} costs nine euros.", "Read the {} Times.", "{} {} Award goes to a cook.", "Operation {} {} began.", "{} Airport is shut.", "The {} column is empty.", "The codename is {} {}.",
    "The ship {} {} sank.", "{} {} Foundation pays.", "Der {} {} Verein lädt ein.", "La empresa {} {} cerró.", "La société {} {} recrute.", "{} {} GmbH liefert.", "Wait for {} {} support.", "Restart {} {} before noon.", "Open {} {} and press start.", "name: {}_{}", "author: unknown", "author: the editors",
    "from: noreply", "to: all staff", "contact: front desk", "We use {} {} as our scheduler.", "The {} {} dashboard broke.", "The {} {} plugin is old.", "{} {} 3 replaces it.", "release {} {} is delayed",
]
HEADING_LOOKALIKES = ["# Green Salad\n", "## {} {}\n", "## {} {}\n\n", "## {} {}", "## Winter {}\n", "### Summer {} Plans\n", "# {} {}\n", "* {} {}: nine euros", "| {} {} | 12 |", "{}, {}, {} usw.", "Brot, Käse usw.", "Suppe, Salat etc.", "Hüte, Schuhe und so weiter"]
EAST_NAMES = [
    "{ja}さんに電話した。", "{ja}様、お世話になります。", "{ja}氏は欠席です。", "{ja}先生が来た。", "昨日{ja}さんと会った。", "担当は{ja}さんです。", "{ja_pair}は欠席です。", "{zh}写了一封信。", "{zh}说今天下雨。", "请联系{zh}。", "感谢{zh}的帮助。", "{zh}负责厨房。", "同事{zh}请假了。", "{zh}住在南京。", "{zh}已经回家。", "{ko} 씨가 왔다.", "{ko}님께 전화했다.", "Thanks to {ja}さん we won.", "According to {ja}さん, it rains.",
]
EAST_LOOKALIKES = [
    "皆さん、お待ちください。", "お客さんが来た。", "お父さんは留守です。", "店員さんに聞いた。", "高速公路已经开通。", "王国的历史很长。", "马上出发。", "方法很简单。", "金色的花开了。", "石头很重。", "白天很热。", "程序已经停止。", "毛衣很贵。", "请安静。", "请马上回来。", "感谢大家。", "与方法有关。", "何时开门？", "何处可以停车？", "任何人都可以来。", "黄金价格上涨。",
    "江水很冷。", "叶子落了。", "史书写了这件事。", "高山雪很多。", "손님이 왔다.", "선생님께 물었다.", "和平很重要。", "由于下雨，比赛取消。", "夏天到了。", "周末休息。", "严重的问题。", "陈旧的记录已删除。", "高效的方法。", "余下的部分。", "孔径很小。", "万一失败。", "许多人来了。", "方案已经通过。", "程度不同。", "金额已经核对。",
]
MAIL_CONTEXTS = ["Drop a line to {} by Friday.", "Invoices go to {}, thanks.", "Please cc {} on all bills.", "email={}", "from: {}", "reply-to: {}", "Kontakt: {}", "Correo: {}", "Écrivez à {} svp.", "Write to {}.", "{}", "<{}>", "See <mailto:{}> for tickets."]
MAIL_LOOKALIKES = ["@everyone dinner is ready.", "We bought 4@2.{} each.", "Turn left at the dot before the river.", "Look at the dot on the map.", "ssh root@cellar:22 is closed.", "See you at noon dot sharp.", "Stop at the dot after page {}.", "cook@home is a slogan", "Rate a@b and b@c.", "They meet at two dot five."]
PHONE_CONTEXTS = ["Dial {} for a table.", "Ring {} in the evening.", "tel {}", "phone: {}", "Her number is {}.", "callback=\"{}\"", "Telefonee al {} mañana.", "Text {} on arrival.", "fax {}", "mobile: {}", "Tel.: {}", "Telefon {}", "Call us: {}.", "Rufen Sie {} an.", "Appelez le {}."]
PHONE_LOOKALIKES = [
    "Batch 20{:02d}0612{} was sold.", "Receipt No. 20-{}-{} was paid.", "Locker 555-{} is empty.", "Seats 1204-12{} are taken.", "ISBN 978-3-16-{}-0", "Server 10.0.3.{} is down.", "Serial 7b2a{}f0c-81{}-4d2b-8e11-11bb3256.", "Part 4c9d-20{}-bb12-8a.",
    "Odds 30 {} on day 7{}.", "The phone column had {} gaps.", "Model 12.{}.{}", "2021-0{}-1{} 07:45", "dial(\"y\", {})", "It scored 14.62:1, not 81{}.", "| 11 | {} | 12.70 | 5{} |", "Parcel 200{}300{} arrived.", "Card 66{}4321{} expired.", "Room 204-{} is free.", "Flight 20-{}-{} left.", "Page 12 {} to 45 {}.", "Invoice 2020-{}-{}.",
    "Offset 77{} to 88{}.", "Line 1200 {} 14.", "Account 12345{}678{}.",
]
ID_CONTEXTS = ["The file shows {}.", "On the form stands {}.", "It had {} in clear.", "field: {}", "{}", "A copy of {} is enclosed.", "The clerk noted {}."]
ID_LOOKALIKES = ["The passport office closes at {}.", "SSN fields are hidden.", "passport photos cost {} euros.", "The insurance no. is missing {} times.", "NINO letters take 14{} days.", "DNI offices open at {}.", "ID 7{} is free.", "Gate CD 14 was shut.", "id number {} of 80", "Der Ausweis kostet {} Euro."]
ADDRESS_CONTEXTS = ["Send the parcel to {}.", "He lives at {} now.", "The shop moved to {}.", "address: {}", "Paket an {}.", "Livrez au {} ce soir.", "We met at {} (side door)", "addr: {}", "She lived in {}.", "Mi casa está en {}.", "{}"]
ADDRESS_LOOKALIKES = ["Stop at point {}, the road view is bad.", "Lane {} and track 5 are shut.", "She got {} old chairs.", "Add {}, stir it later.", "Der Weg {} war steil.", "Der 11. Stock ist leer!", "Am 6. Juni war es heiß.", "Tisch {} ist belegt.", "La Calle está sucia {}.", "5 Star Way of cooking", "Der Ring {} fehlt."]


LISTED = re.compile(r"\{\} (?:reviewed|approved|fixed|wrote|merged|reported|confirmed|noticed|schrieb|dijo|написал)\b")
#: Lists with an order, so that a seed gives the same sample in every process.
LATIN_GIVEN, LISTED_JAPANESE = sorted(GIVEN), sorted(JAPANESE)


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self, parts: int) -> str:
        return "".join(self.r.choice(ONSETS) + self.r.choice(VOWELS) + self.r.choice(CODAS) for _ in range(parts)).capitalize()

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def name(self, known: float = 0.4, odd: bool = True) -> tuple[str, str, str]:
        """What stands before the name, the name, what stands behind it."""
        r = self.r
        kind = r.random()
        if kind < 0.07:
            return "", f"{r.choice(CYR)} {r.choice(CYR_SUR)}", ""
        if kind < 0.13:
            return "", r.choice(KANJI), r.choice(["さん", "さん", "様", "氏"])
        first = r.choice(LATIN_GIVEN).capitalize() if r.random() < known else self.word(2)
        last = self.word(2)
        if r.random() < 0.12:
            first = r.choice("ÉÅØŁÖ") + first[1:].lower()
        if r.random() < 0.1:
            last += r.choice(["-" + self.word(1), "ü" + "n"])
        if r.random() < 0.1:
            last = r.choice(["D'", "O'", "O’"]) + last
        if r.random() < 0.1:
            last = r.choice(["de ", "van der ", "von ", "Ní ", "van ", "di "]) + last
        form = r.random()
        if form < 0.16:
            text = f"{first[0]}. {last}" if r.random() < 0.75 else f"{first[0]}. {r.choice('ABCDEHJMR')}. {last}"
        elif form < 0.26:
            text = f"{first} {r.choice('ABCDEHJM')}. {last}"
        elif form < 0.38 and odd:
            text = f"{last}, {first}"
        else:
            text = f"{first} {last}"
        if odd and r.random() < 0.25:
            text = text.lower()
        elif r.random() < 0.06:
            text = text.upper()
        if r.random() < 0.08:
            return r.choice(["Dr. ", "Mr. ", "Ms ", "Mrs. ", "Mr ", "Herr ", "Frau ", "Prof. "]), last.title() if " " not in last else last, ""
        title = r.choice(["Dr. ", "Prof. ", "Mr. ", "Ms ", "Mrs. ", "Herr ", "Frau "]) if r.random() < 0.2 and not text.islower() else ""
        return title, text, ""

    def east(self) -> list[tuple[str, str | None]]:
        """A sentence in Chinese, Japanese or Korean with a name."""
        r = self.r
        a, rest = r.choice(EAST_NAMES).split("{")
        what, b = rest.split("}")
        given = lambda n: "".join(chr(r.randrange(0x5000, 0x8FFF)) for _ in range(n))
        family = r.choice(LISTED_JAPANESE)
        if what == "zh":
            name = r.choice(CHINESE) + given(r.choice([1, 2, 2]))
        elif what == "ko":
            name = r.choice(KOREAN) + "".join(chr(r.randrange(0xAC00, 0xD7A0)) for _ in range(2))
        else:
            if r.random() < 0.3:
                family = given(2)
                what = "ja" if what == "ja" else ""
            name = f"{family} {given(2)}" if what != "ja" or r.random() < 0.5 else family
            if not what:
                return [(f"{name}", "name"), ("さんです。", None)]
        return [(a, None), (name, "name"), (b, None)]

    def plain_names(self) -> list[tuple[str, str | None]]:
        """A sentence with names and no cue."""
        out, template = [], self.r.choice(PLAIN_NAME_CONTEXTS)
        listed = LISTED.match(template) is not None  # as in a list of changes, where names come in any form
        for i, text in enumerate(template.split("{}")):
            if i:
                before, name, after = self.name(0.6, listed)
                out += [(before, None), (name, "name"), (after, None)]
            out.append((text, None))
        return out

    def email(self) -> str:
        r = self.r
        a, b = self.word(1).lower(), self.word(2).lower()
        local = r.choice([f"{a}.{b}", f"{a}_{b}{self.digits(2)}", f"{a}-{b}", f"{a}{self.digits(2)}", f"{a}{b}", f"{a}+{b}", f"{a[0]}{b}"])
        domain = [r.choice(["mail", "inbox", "team", "people", "post", "staff", self.word(1).lower()]), *r.choice([["example", "org"], ["test"], ["example"], ["com"], ["example", "com"], ["net"]])]
        form = r.random()
        if form < 0.5:
            out = f"{local}@{'.'.join(domain)}"
            return out.upper() if r.random() < 0.1 else out.title() if r.random() < 0.05 else out
        if form < 0.75:
            return f"{local} at {' dot '.join(domain)}"
        at = r.choice(["[at]", "(at)", " [at] ", " (at) "])
        dot = r.choice(["[dot]", "(dot)", " [dot] ", " (dot) ", "."])
        return f"{local}{at}{dot.join(domain)}"

    def phone(self) -> str:
        r, d = self.r, self.digits
        area = f"{r.randint(2, 9)}{d(2)}"
        out = r.choice(
            [f"{area}-{d(3)}-{d(4)}", f"({area}) {d(3)}-{d(4)}", f"{area}.{d(3)}.{d(4)}", f"{area} {d(3)} {d(4)}", f"+1-{area}-{d(3)}-{d(4)}", f"+1{area}{d(7)}", f"020 {d(4)} {d(4)}", f"+44 20 {d(4)} {d(4)}", f"+33 1 {d(2)} {d(2)} {d(2)} {d(2)}", f"+49 ({d(2)}) {d(5)}-{d(3)}", f"+7 {area} {d(3)}-{d(2)}-{d(2)}", f"0{d(2)}-{d(4)}-{d(4)}", f"+34 {d(3)} {d(3)} {d(3)}"]
        )
        return out.translate({48 + i: 0xFF10 + i for i in range(10)}) if r.random() < 0.08 else out

    def id_number(self) -> tuple[str, str]:
        r, d = self.r, self.digits
        kind = r.randrange(5)
        if kind == 0:
            s = r.choice("- ")
            return r.choice(["SSN ", "social security number ", "soc. sec. no. ", "SSN: "]), f"{d(3)}{s}{d(2)}{s}{d(4)}"
        if kind == 1:
            end = r.choice("ABCD")
            text = r.choice([f"QQ{d(6)}{end}", f"QQ {d(2)} {d(2)} {d(2)} {end}", f"AB {d(2)} {d(2)} {d(2)} {end}"])
            return r.choice(["NI number ", "NINO: ", "insurance no. ", "National Insurance number "]), text
        if kind == 2:
            return r.choice(["passport ", "passport no. ", "Reisepass ", "Passport number: "]), r.choice([f"ZX {d(7)}", f"C{d(8)}", f"XK{d(7)}"])
        if kind == 3:
            return r.choice(["DNI ", "documento ", "DNI: "]), f"{d(8)}{r.choice('ABCDEFGHJKLMNP')}"
        if r.random() < 0.3:
            return r.choice(["CPF ", "CPF: "]), f"{d(3)}.{d(3)}.{d(3)}-{d(2)}"
        if r.random() < 0.2:
            return r.choice(["PESEL ", "BSN ", "NHS number ", "身份证", "マイナンバー "]), r.choice([d(11), f"{d(3)} {d(3)} {d(4)}", d(9)])
        return r.choice(["tax id ", "ID number ", "Ausweis "]), f"{d(4)}{r.choice(['', ' '])}{d(5)}"

    def address(self) -> tuple[str, str]:
        r = self.r
        street, n = r.choice([self.word(2), self.word(2), f"{self.word(1)}-{self.word(1)}", f"{self.word(1)}{self.word(1)}"]), str(r.randint(1, 240))
        text = r.choice(
            [f"{n} {street} {r.choice(['Street', 'Road', 'Lane', 'Avenue', 'Ave', 'Rd', 'St'])}", f"{n}{r.choice('ab')} {street} Crescent", f"{n}, rue {street}", f"{street}{r.choice(['straße', 'weg', 'gasse'])} {n}", f"Calle {street} {n}", f"{n} rue de {street}", f"Avenida {street}, {n}"]
        )
        if r.random() < 0.12:
            a, b = (chr(r.randrange(0x5000, 0x8FFF)) for _ in range(2))
            return r.choice([(f"{a}{b}{r.randint(1, 9)}丁目{r.randint(1, 30)}番{r.randint(1, 20)}号", "です。"), (f"{a}{b}路{n}号", "。")])
        tail = r.choice(["", "", f", {self.digits(5)} {self.word(2)}", f", Apt {r.randint(1, 30)}", f", {self.word(2)}", f", {self.word(1)}-{self.word(1)}"])
        if text.endswith(("Ave", "Rd", "St")) and r.random() < 0.5:
            tail = "." + tail
        return text, tail

    def fill(self, template: str) -> str:
        """A look-alike with words and numbers in its places."""
        out = template
        while "{" in out:
            start = out.index("{")
            end = out.index("}", start)
            wordy = out[max(0, start - 2) : start] in ("m ", "e ", "} ", "") and not template.startswith(("Batch", "Receipt", "Seats", "Serial")) or template in NAME_LOOKALIKES + HEADING_LOOKALIKES
            out = out[:start] + ((self.r.choice(LATIN_GIVEN).capitalize() if self.r.random() < 0.1 else self.word(2)) if wordy else self.digits(self.r.randint(1, 4)).lstrip("0") or "3") + out[end + 1 :]
        return out

    def piece(self) -> list[tuple[str, str | None]]:
        """A sentence in parts, each with its kind or None."""
        r = self.r
        kind = r.randrange(14)
        if kind in (0, 1, 13):
            before, name, after = self.name()
            if kind == 13 and name[0].isascii():
                before, name = "", name.lower()
            a, b = r.choice(NAME_CONTEXTS).split("{}")
            return [(a + before, None), (name, "name"), (after + b, None)]
        if kind in (2, 10):
            return self.plain_names()
        if kind == 11:
            return self.east() if r.random() < 0.7 else [(r.choice(EAST_LOOKALIKES), None)]
        if kind == 12:
            return [(self.fill(r.choice(NAME_LOOKALIKES)), None)]
        if kind == 3:
            a, b = r.choice(MAIL_CONTEXTS).split("{}")
            return [(a, None), (self.email(), "email"), (b, None)]
        if kind == 4:
            a, b = r.choice(PHONE_CONTEXTS).split("{}")
            return [(a, None), (self.phone(), "phone"), (b, None)]
        if kind == 5:
            a, b = r.choice(ID_CONTEXTS).split("{}")
            cue, number = self.id_number()
            return [(a + cue, None), (number, "id_number"), (b, None)]
        if kind == 6:
            a, b = r.choice(ADDRESS_CONTEXTS).split("{}")
            street, tail = self.address()
            if street.endswith("号"):
                return [(r.choice(["住所は大阪市北区", "送り先: 千葉市"]) if "丁目" in street else r.choice(["地址：", "我住在"]), None), (street, "address"), (tail, None)]
            return [(a, None), (street, "address"), (tail + b, None)]
        if kind == 7:
            return [(self.fill(r.choice(NAME_LOOKALIKES)), None)]
        return [(self.fill(r.choice(r.choice([HEADING_LOOKALIKES, NAME_LOOKALIKES, MAIL_LOOKALIKES, PHONE_LOOKALIKES, ID_LOOKALIKES, ADDRESS_LOOKALIKES]))), None)]

    def example(self) -> tuple[str, list[tuple[int, int, str]]]:
        text, gold = self.r.choice(HEADS), []
        for _ in range(self.r.randint(1, 3)):
            for part, kind in [*self.piece(), (self.r.choice(TAILS) + " ", None)]:
                if kind:
                    gold.append((len(text), len(text) + len(part), kind))
                text += part
        return text.rstrip(" "), gold


def _log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def marginals(found, scores: list[float]) -> list[float]:
    """Probability of each candidate under the model: forward and backward sums over sets that do not overlap."""
    n = len(found)
    ends = [c[1] for c in found]
    before = [bisect_right(ends, c[0], 0, i) for i, c in enumerate(found)]
    forward = [0.0] * (n + 1)
    for i in range(n):
        forward[i + 1] = _log_add(forward[i], forward[before[i]] + scores[i])
    into = [-math.inf] * (n + 1)
    into[n] = 0.0
    for i in range(n - 1, -1, -1):
        out = into[i + 1]
        into[i] = _log_add(into[i], out) if into[i] > -math.inf else out
        b = before[i]
        into[b] = _log_add(into[b], out + scores[i]) if into[b] > -math.inf else out + scores[i]
    return [math.exp(forward[before[i]] + scores[i] + into[i + 1] - forward[n]) for i in range(n)]


def train(examples: int = EXAMPLES, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, float]:
    maker = Maker(seed)
    data = []
    for _ in range(examples):
        text, gold = maker.example()
        found = candidates(plain(text))
        gold = set(gold)
        data.append((found, [c[:3] in gold for c in found]))
    weights: dict[str, float] = defaultdict(float)
    speed: dict[str, float] = defaultdict(lambda: 1e-6)
    order = random.Random(seed)
    total: dict[str, float] = defaultdict(float)
    for epoch in range(epochs):
        order.shuffle(data)
        for found, right in data:
            if not found:
                continue
            p = marginals(found, [sum(weights[f] for f in c[3]) for c in found])
            step: dict[str, float] = defaultdict(float)
            for c, y, q in zip(found, right, p):
                for f in c[3]:
                    step[f] += y - q
            for f, g in step.items():
                g -= L2 * weights[f]
                speed[f] += g * g
                weights[f] += RATE * g / math.sqrt(speed[f])
        if epoch >= epochs // 2:  # the mean over the later epochs depends less on the order of the last examples
            for f, w in weights.items():
                total[f] += w / (epochs - epochs // 2)
    return {f: round(w, 4) for f, w in sorted(total.items())}


def accuracy(weights: dict[str, float], examples: int = 1_000, seed: int = 99) -> tuple[float, float]:
    """Precision and recall on made-up sentences of another seed."""
    maker = Maker(seed)
    hit = said = true = 0
    for _ in range(examples):
        text, gold = maker.example()
        found = set(decode(candidates(plain(text)), weights))
        hit += len(found & set(gold))
        said += len(found)
        true += len(gold)
    return hit / max(said, 1), hit / max(true, 1)


if __name__ == "__main__":
    trained = train()
    (Path(__file__).parent / "mention_weights.json").write_text(json.dumps(trained, indent=0, ensure_ascii=False) + "\n")
    print(len(trained), accuracy(trained))
