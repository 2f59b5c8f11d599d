"""Personal information inside free text: email addresses, phone numbers, identity numbers, street addresses, names.

Method: a semi-Markov conditional random field. Every span of up to MAX_NAME words that could be a name is a candidate,
and so is every stretch that has the form of an address, number or identity number, with overlaps; each, taken as a whole,
is scored by features of its kind, shape and surroundings; dynamic programming over the candidates (whose lengths are
bounded) then chooses the best set of segments that do not overlap, deciding boundaries and kinds together. Text outside
all segments scores zero. The weights are trained by likelihood on sentences that ``engram.llm.mention_training`` makes up,
and stored beside this module.

Two kinds of spans are no candidates, as nothing in them tells a name: a single word that is no common given name and has
neither cue, title nor honorific beside it, and words in small letters without any of these and not before a verb of speech.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.mention_words import (
    ADDRESS_WORDS, BEING, CHINESE, CHINESE_AFTER, CHINESE_BEFORE, COORDINATORS, CUES, DETERMINERS, ENDING_THINGS, GIVEN, GIVEN_OTHER, HONORIFIC, ID_WORDS,
    JAPANESE, KOREAN, MAIL_WORDS, NOT_MAIL, NOT_NAME, NOT_PHONE, PARTICLE, PHONE_WORDS, PREPOSITIONS, ROLES, STREET_EN, STREET_ES, STREET_FR, THINGS, TITLE, TLDS,
    VERBS, WEAK_CUES,
)

KINDS = ("email", "phone", "id_number", "address", "name")
#: Longest segment in code points, and most words of a name: the bounds of the dynamic programming.
MAX_SEGMENT = 128
MAX_NAME = 6
#: Longest local part and domain of an email address (RFC 5321).
MAX_LOCAL, MAX_DOMAIN = 64, 255

# Full-width ASCII to ASCII and odd spaces and hyphens to plain ones, one to one, so that offsets hold.
PLAIN = {0xFF01 + i: 0x21 + i for i in range(94)} | {0x3000: 0x20, 0xA0: 0x20, 0x202F: 0x20, 0x2009: 0x20}
PLAIN |= dict.fromkeys((0x2010, 0x2011, 0x2012, 0x2013, 0x2212), 0x2D)
NOT_PLAIN = re.compile("[" + "".join(map(chr, PLAIN)) + "]")

# Capital letters of the scripts that have them.
UPPER = "".join(chr(c) for c in range(0x41, 0x530) if chr(c).isupper())
LOCAL = re.compile(r"[^\W_][\w.+%'-]*\Z")
DOMAIN = re.compile(r"[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+")
AT = r"(?:[ ]?[\[({<][ ]?(?:at|@)[ ]?[\])}>][ ]?|[ ]at[ ]|@)"
DOT = r"(?:[ ]?[\[({<][ ]?(?:dot|\.)[ ]?[\])}>][ ]?|[ ]dot[ ]|\.)"
HIDDEN_AT = re.compile(rf"(?i){AT}")
HIDDEN_LOCAL = re.compile(r"[^\W_][\w.+%-]*\Z")
HIDDEN_DOMAIN = re.compile(rf"(?i)[^\W_][\w-]{{0,62}}(?:{DOT}[^\W_][\w-]{{0,62}}){{1,3}}")
HIDDEN_DOT = re.compile(rf"(?i){DOT}")
PHONE = re.compile(r"(?<![\w.+@/#-])(?:\+ ?\d{1,3}|\(\d{2,5}\)|\d{2,12})(?:(?:[ ./-]| - )?(?:\(\d{1,5}\)|\d{1,12})){0,7}(?![\w@])")
ID_AFTER = re.compile(rf"(?i)(?<![\w])(?:{ID_WORDS})[ ]{{0,2}}[:#=：]?[ ]{{0,2}}((?=[a-z0-9 .-]{{0,40}}\d)[a-z0-9]{{1,18}}(?:[ .-][a-z0-9]{{1,9}}){{0,5}})")
ID_SHAPE = re.compile(r"(?<![\w-])(?:\d{3}([ -])\d{2}\1\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{8}[A-Z]|[XYZ]-?\d{7}-?[A-Z]|\d{3}\.\d{3}\.\d{3}-\d{2})(?![\w-])")
_CAP = r"[^\W\d_a-zà-öø-ÿ][\w'’]*(?:-[^\W\d_][\w'’]*)*"
_HAN = "一-鿿々ヶケノ"
ADDRESS = (
    ("number_first", re.compile(rf"(?<![\w.:/-])\d{{1,5}}[a-zA-Z]?,? (?:{_CAP} ){{1,3}}(?:{STREET_EN})(?![\w-])")),
    ("french", re.compile(rf"(?<![\w.:/-])\d{{1,5}}(?: ?(?:bis|ter|[a-zA-Z]))?,? (?:{STREET_FR}) (?:(?:de la|de l'|du|des|de|d'|la|le|les) ?)?{_CAP}(?: (?:{_CAP})){{0,2}}")),
    ("german", re.compile(rf"(?<![\w-])(?:{_CAP}[ -])?{_CAP}(?:(?<=straße)|(?<=strasse)|(?<=weg)|(?<=gasse)|(?<=platz)|(?<=allee)|(?<=ring)|(?<=damm)|(?<=ufer)|(?<=steig)|(?<=straat)) \d{{1,4}}[a-zA-Z]?(?![\w-])")),
    ("spanish", re.compile(rf"(?<![\w])(?:{STREET_ES}) ?(?:(?:de la|del|de los|de) )?{_CAP}(?: (?:{_CAP})){{0,2}},? \d{{1,5}}[a-zA-Z]?(?![\w-])")),
    ("east", re.compile(rf"(?<=[市区町村郡縣県])(?:(?![市区郡縣県])[{_HAN}ぁ-んァ-ヺー]){{1,10}}?\d{{1,3}}(?:丁目\d{{1,4}}番?地?(?:の?\d{{1,4}}号?)?|-\d{{1,4}}-\d{{1,4}}|番地?\d{{0,4}}号?)|[一-鿿]{{2,5}}(?:路|街|道|巷)\d{{1,5}}号|[가-힣]{{1,8}}(?:로|길) \d{{1,4}}(?:-\d{{1,4}})?")),
)
#: What every match of a pattern has in it, in lower case: a pattern is run only over texts with one of its parts.
HINTS = {
    "id": (
        "ssn", "s.s.n.", "social security", "soc. sec", "soc sec", "national insurance", "ni n", "nino", "insurance n", "passport", "passnummer", "reisepass", "pasaporte", "passeport", "ausweis", "dni", "nie", "nif",
        "documento", "tax id", "steuer", "id n", "id c", "identity n", "identity c", "national id", "licen", "паспорт", "снилс", "инн", "cpf", "rg n", "pesel", "bsn", "nhs n", "codice", "curp",
        "aadhaar", "personnummer", "身份证", "護照", "护照", "マイナンバー", "旅券番号", "주민등록번호", "여권번호",
    ),
    "honorific": tuple(HONORIFIC.split("|")),
    "lower_right": tuple(" reviewed| approved| wrote| said| merged| fixed| reported| confirmed| noticed| schrieb| dijo| escribió| написал".split("|")),
    "number_first": tuple(w.lower() for w in STREET_EN.split("|")),
    "french": tuple(STREET_FR.split("|")),
    "german": ("straße ", "strasse ", "weg ", "gasse ", "platz ", "allee ", "ring ", "damm ", "ufer ", "steig ", "straat "),
    "spanish": tuple(w.lower().replace("\\", "").rstrip("?.") for w in STREET_ES.split("|")),
    "east": ("号", "番", "市", "区", "町", "村", "郡", "縣", "県", "로 ", "길 "),
}
TOKEN = re.compile(r"[^\W\d_](?:[\w]|['’-](?=\w))*\.?")
_NAME_WORD = rf"[{UPPER}](?:\w|['’-](?=\w))*\.?"
NAME_RUN = re.compile(rf"(?<![\w@/.'’-])(?:(?:{PARTICLE}) ){{0,2}}{_NAME_WORD}(?:,? (?:(?:{PARTICLE}) ){{0,2}}{_NAME_WORD})*")
NAME_HONORIFIC = re.compile(rf"([㐀-鿿々぀-ヿ가-힯]{{1,6}}(?:[ ・][㐀-鿿々぀-ヿ가-힯]{{1,6}})?) ?(?:{HONORIFIC})")
HAN_RUN = re.compile(r"[一-鿿々]{2,}")
HAN_BEFORE = re.compile(CHINESE_BEFORE)
HAN_AFTER = re.compile(CHINESE_AFTER)
HANGUL_NAME = re.compile(rf"(?<![가-힣])[{KOREAN}][가-힣]{{2}}(?=(?:이|가|은|는|을|를|에게|와|과|의)(?![가-힣]))")
TITLE_AT = re.compile(rf"{TITLE}[ ]+")
TITLE_BEFORE = re.compile(rf"(?<![\w]){TITLE}[ ]+\Z")
TITLE_ONLY = re.compile(rf"{TITLE}$")
NAME_TITLE = re.compile(rf"(?<![\w]){TITLE}[ ]+(?=[^\W\d_])")
PARTICLE_ONLY = re.compile(rf"(?i)(?:{PARTICLE})$")
INITIAL = re.compile(r"[^\W\d_]\.$")
DIGITS = re.compile(r"\d[\d ()./-]{3,}\d")
LOWER_RIGHT = re.compile(r"(?<=[\w.])[ ](?=(?:reviewed|approved|wrote|said|merged|fixed|reported|confirmed|noticed|schrieb|dijo|escribió|написал|написала)\b)")
HAS_DIGIT = re.compile(r"\d")


@lru_cache(maxsize=1)
def _automaton():
    """All cues and hints in one automaton, so that a text is looked through once."""
    import ahocorasick

    kinds: dict[str, set[str]] = {}
    for what, parts in HINTS.items():
        for part in parts:
            kinds.setdefault(part, set()).add(what)
    for cue in {*CUES, *WEAK_CUES}:
        kinds.setdefault(cue, set()).add("weak" if cue in WEAK_CUES else "cue")
    automaton = ahocorasick.Automaton()
    for part, whats in kinds.items():
        automaton.add_word(part, (len(part), frozenset(whats)))
    automaton.make_automaton()
    return automaton


def _looked_through(low: str) -> tuple[set[str], dict[int, str]]:
    """The hints that are in a text, and where a name may start behind a cue (spaces and punctuation of labels skipped) with
    the strongest cue there."""
    hints: set[str] = set()
    out: dict[int, str] = {}
    n = len(low)
    for last, (length, whats) in _automaton().iter(low):
        hints |= whats
        if "cue" not in whats and "weak" not in whats:
            continue
        end = last + 1
        start = end - length
        if start and (low[start - 1].isalnum() or low[start - 1] == "_") or end < n and (low[end].isalnum() or low[end] in "_-"):
            continue
        kind = "weak" if "weak" in whats else "cue"
        at, label, breaks = end, False, 0
        while at < n and at - end < 4:
            c = low[at]
            if c in ":=" and not label:
                label, kind = True, "cue"
            elif c == "\n" and not breaks:
                breaks = 1
            elif c == "," and at == end:
                pass
            elif c not in " \"'“„«(":
                break
            at += 1
        if at > end and (out.get(at) != "cue"):
            out[at] = kind
    return hints, out


def plain(text: str) -> str:
    return text if text.isascii() or not NOT_PLAIN.search(text) else text.translate(PLAIN)


def _word_before(text: str, at: int) -> str:
    end = at
    while end > 0 and text[end - 1] in " :=\"'<(#,":
        end -= 1
    start = end
    while start > 0 and (text[start - 1].isalnum() or text[start - 1] in "_-") and end - start < 24:
        start -= 1
    return text[start:end].lower()


def _email_candidates(text: str, low: str, hints: set[str], cues: dict[int, str]):
    at = text.find("@")
    while at >= 0:
        local = LOCAL.search(text, max(0, at - MAX_LOCAL), at)
        domain = DOMAIN.match(text, at + 1, at + 1 + MAX_DOMAIN) if local else None
        if domain:
            yield local.start(), domain.end(), "email", _email_features(text, local.start(), domain.end(), local[0], domain[0].split("."), "plain")
        at = text.find("@", at + 1)
    if not ("dot" in low and (" at " in low or "@" in low) or "at]" in low or "at)" in low or "at}" in low or "at>" in low or "@" in low or "at " in low):
        return
    for m in HIDDEN_AT.finditer(text):
        if m[0] == " at " and "dot" not in low:
            continue
        domain = HIDDEN_DOMAIN.match(text, m.end())
        local = HIDDEN_LOCAL.search(text, max(0, m.start() - MAX_LOCAL), m.start()) if domain else None
        if not local or m[0] == "@" and "dot" not in domain[0].lower():
            continue
        seps = list(HIDDEN_DOT.finditer(text, domain.start(), domain.end()))
        form = "bracket" if m[0].strip()[:1] in "[({<" else "word"
        for end in [domain.end(), *(x.start() for x in seps[:0:-1])]:  # the domain may be shorter than what matches
            parts = HIDDEN_DOT.split(text[domain.start() : end])
            yield local.start(), end, "email", _email_features(text, local.start(), end, local[0], parts, form)


def _email_features(text, start, end, local, parts, form):
    out = ["email", f"email:{form}"]
    out.append("email:tld" if parts[-1].lower() in TLDS else "email:no_tld")
    if form == "word":
        if local.lower() in NOT_MAIL or parts[0].lower() in NOT_MAIL:
            out.append("email:plain_words")
        if local.isalpha():
            out.append("email:bare_local")
        if text[start:end].lower().count(" dot ") or "dot" in text[start:end].lower():
            out.append("email:dot_word")
    if any(p[:1].isdigit() for p in parts):
        out.append("email:digit_domain")
    if end < len(text) and text[end] in "/@":
        out.append("email:goes_on")
    if _word_before(text, start) in MAIL_WORDS:
        out.append("email:cue")
    following = HIDDEN_DOT.match(text, end)
    if following and form != "plain" and text[following.end() : following.end() + 1].isalnum():
        out.append("email:cut_short")
    if start and text[start - 1] in "/@":
        out.append("email:in_path")
    return out


def _phone_candidates(text: str, low: str, hints: set[str], cues: dict[int, str]):
    if not DIGITS.search(text):
        return
    for m in PHONE.finditer(text):
        digits = sum(c.isdigit() for c in m[0])
        if not 6 <= digits <= 15 or m.end() - m.start() > MAX_SEGMENT:  # E.164: at most 15; local numbers have 6 and more
            continue
        start, end = m.span()
        out = ["phone", f"phone:digits={digits}"]
        s = m[0]
        groups = re.findall(r"\d+", s)
        plus = s[0] == "+"
        out.append("phone:plus" if plus else "phone:no_plus")
        if "(" in s:
            out.append("phone:brackets")
        if len(groups) == 1:
            out.append("phone:one_group")
        lens = tuple(map(len, groups))
        if not plus:
            if lens == (3, 3, 4) or lens == (1, 3, 3, 4):
                out.append("phone:nanp")
            elif groups[0][0] == "0" and len(groups) >= 2 and digits in (9, 10, 11) and lens != (3, 2, 4):
                out.append("phone:trunk")
            elif lens == (3, 2, 4):
                out.append("phone:ssn_shape")
            else:
                out.append("phone:odd_groups")
        if len(groups) == 4 and s.count(".") == 3 and all(int(g) < 256 for g in groups):
            out.append("phone:ip")
        if re.match(r"(?:19|20)\d\d[-./ ](?:0\d|1[0-2])", s):
            out.append("phone:date")
        word = _word_before(text, start)
        if word in PHONE_WORDS:
            out.append("phone:cue")
        elif word in NOT_PHONE:
            out.append("phone:not_cue")
        elif word:
            out.append("phone:other_word")
        if start and text[start - 1] in "-/:.,":
            out.append("phone:inside")
        if end < len(text) and text[end] in "-/:%$€" or text[end : end + 2].strip()[:1].isdigit() and end < len(text) and text[end] in ".,":
            out.append("phone:goes_on")
        yield start, end, "phone", out


def _id_class(s: str) -> str:
    s = re.sub(r"[ .-]", "", s).upper()
    if re.fullmatch(r"\d{9}", s):
        return "nine_digits"
    if re.fullmatch(r"[A-Z]{2}\d{6}[A-D]", s):
        return "two_six_letter"
    if re.fullmatch(r"[A-Z]{1,2}\d{6,8}", s):
        return "letters_digits"
    if re.fullmatch(r"(?:\d{8}|[XYZ]\d{7})[A-Z]", s):
        return "digits_letter"
    if re.fullmatch(r"[A-Z]{1,3}\d{6,9}[A-Z]", s):
        return "letters_digits_letter"
    if re.fullmatch(r"[A-Z0-9]{8,14}", s) and sum(c.isdigit() for c in s) >= 6:
        return "mixed"
    return "other"


def _id_candidates(text: str, low: str, hints: set[str], cues: dict[int, str]):
    if not HAS_DIGIT.search(text):
        return
    seen = set()
    for m in ID_AFTER.finditer(text) if "id" in hints else ():
        s = m[1]
        cuts = [len(s)] + [x.start() for x in re.finditer(r"[ .-]", s)]
        for cut in cuts:
            part = s[:cut]
            if sum(c.isdigit() for c in part) < 5:
                continue
            span = (m.start(1), m.start(1) + cut)
            seen.add(span)
            yield *span, "id_number", _id_features(text, *span, True)
    for m in ID_SHAPE.finditer(text):
        if m.span() not in seen:
            yield m.start(), m.end(), "id_number", _id_features(text, m.start(), m.end(), False)


def _id_features(text, start, end, cue):
    s = text[start:end]
    out = ["id", f"id:{_id_class(s)}", "id:cue" if cue else "id:no_cue"]
    if re.search(r"[a-z]", s):
        out.append("id:lower")
    if end < len(text) and text[end] in "-/." and end + 1 < len(text) and text[end + 1].isalnum():
        out.append("id:goes_on")
    if end - start >= 2 and not any(c.isdigit() for c in re.split(r"[ -]", s)[-1]) and len(re.split(r"[ -]", s)[-1]) > 1:
        out.append("id:word_at_end")
    if start and text[start - 1] in "-/.":
        out.append("id:inside")
    if re.search(r"[ -][A-Za-z]\Z", s):
        out.append("id:letter_apart" if not re.match(r" [a-z]|['’]", text[end : end + 2]) else "id:letter_before_word")
    return out


def _address_candidates(text: str, low: str, hints: set[str], cues: dict[int, str]):
    if not HAS_DIGIT.search(text):
        return
    for form, pattern in ADDRESS:
        if form not in hints:
            continue
        for m in pattern.finditer(text):
            start, end = m.span()
            if end - start > MAX_SEGMENT:
                continue
            spans = [(start, end)]
            if form == "number_first" or form == "french":  # the street may end earlier than the words do
                words = [x.start() for x in re.finditer(" ", m[0])]
                if form == "french" and len(words) > 2:
                    spans += [(start, start + w) for w in words[2:]]
            for a, b in spans:
                out = ["address", f"address:{form}"]
                if _word_before(text, a) in ADDRESS_WORDS:
                    out.append("address:cue")
                n = len(text[a:b].split())
                out.append(f"address:{form}:tokens={min(n, 6)}")
                if re.match(r",? (?:Apt|Flat|Unit|Suite|\d{4,6}\b)|, [^\W\d_]|\.|$| now| avant| \(|\n", text[b : b + 12]):
                    out.append("address:tail")
                if form == "french" and b < end:
                    out.append("address:cut_short")
                if b < end and (m2 := TOKEN.match(text, b + 1)) and m2[0].lower() in DETERMINERS:
                    out.append("address:before_article")
                if b == end and n > 3 and _word_class(text[a:b].split()[-1]) == "det":
                    out.append("address:article_at_end")
                yield a, b, "address", out


def _word_class(word: str) -> str:
    """What a word beside a span is."""
    w = word.lower()
    for name, words in (("be", BEING), ("coord", COORDINATORS), ("prep", PREPOSITIONS), ("det", DETERMINERS), ("role", ROLES), ("thing", THINGS), ("verb", VERBS), ("common", NOT_NAME)):
        if w in words:
            return name
    return "cap" if word[:1].isupper() else "lower" if word[:1].islower() else "digit" if word[:1].isdigit() else "other"


def _left_of(text: str, at: int) -> tuple[str, str]:
    """The kind of what stands before ``at``, and the word there if it is one."""
    end = at
    while end > 0 and text[end - 1] == " ":
        end -= 1
    if end == 0 or text[end - 1] == "\n":
        return "start", ""
    c = text[end - 1]
    if c in ".!?…。！？؟।":
        return "start", ""
    if c in ",;，、":
        return "comma", ""
    if c in "([\"'“„«「‘":
        return "open", ""
    if c in "#*|":
        return "heading", ""
    if c in ":=-–—>：":
        return "mark", ""
    start = end
    while start > 0 and end - start < 24 and (text[start - 1].isalnum() or text[start - 1] in "_'’"):
        start -= 1
    word = text[start:end]
    return (_word_class(word), word.lower()) if word else ("other", "")


def _right_of(text: str, end: int) -> str:
    rest = text[end : end + 24]
    if not rest.strip() or rest[0] in ".;:!?)\n\"'”»。、，" and not rest.startswith(("'s", "'S")):
        return "end"
    if rest.startswith(("'s", "’s")):
        return "possessive"
    if rest[0] == ",":
        return "comma"
    if rest[0] != " ":
        return "other"
    m = TOKEN.match(rest.lstrip(" "))
    if not m:
        return "digit" if rest.lstrip(" ")[:1].isdigit() else "mark"
    w = m[0].rstrip(".").lower()
    return "thing" if w in ENDING_THINGS else _word_class(m[0].rstrip("."))


def _name_features(text: str, tokens: list[tuple[int, int]], cue: str, title: bool, form: str = "plain"):
    """Features of a span of words. cue: "cue", "weak" or "" as found before it (and before its title)."""
    start, end = tokens[0][0], tokens[-1][1]
    words = [text[a:b] for a, b in tokens]
    n = len(words)
    core = [w for w in words if not INITIAL.match(w) and not PARTICLE_ONLY.match(w)]
    initials = [bool(INITIAL.match(w)) for w in words]
    particles = [bool(PARTICLE_ONLY.match(w)) for w in words]
    cased = [w for w in core if w[0].isupper() or w[0].islower()]
    if not cased:
        shape = "uncased"
    elif all(w.isupper() and len(w) > 1 for w in cased):
        shape = "upper"
    elif all(w[0].isupper() and not w.isupper() for w in cased):
        shape = "title"
    elif all(w.islower() for w in cased):
        shape = "lower"
    else:
        shape = "mixed"
    before = start
    if title:
        before = TITLE_BEFORE.search(text, max(0, start - 12), start).start() if TITLE_BEFORE.search(text, max(0, start - 12), start) else start
    left, left_word = _left_of(text, before)
    right = _right_of(text, end)
    given = sum(w.lower().split("-")[0] in GIVEN or w.lower() in GIVEN_OTHER for w in core)
    known = "given" if core and (core[0].lower().split("-")[0] in GIVEN or core[0].lower() in GIVEN_OTHER) else "given_later" if given else "unknown"
    strong = "title" if title else form if form != "plain" else cue or "none"
    size = "1" if len(core) == 1 and not any(initials) else "2" if len(core) < 3 else "3"
    out = [
        "name", f"name:tokens={n}", f"name:core={len(core)}", f"name:size={size}", f"name:shape={shape}", f"name:{shape}:size={size}", f"name:strong={strong}",
        f"name:{strong}:{shape}", f"name:{strong}:size={size}", f"name:known={known}", f"name:{strong}:{known}", f"name:{known}:size={size}", f"name:right={right}", f"name:{strong}:right={right}",
    ]
    if strong in ("none", "weak"):
        out += (f"name:left={left}", f"name:{known}:left={left}", f"name:{known}:right={right}", f"name:left={left}:right={right}", f"name:{size}:{known}:{strong}")
    elif left in ("det", "thing"):
        out.append(f"name:cue:left={left}")
    if left_word in ("and", "or", "&", "y", "und", "et", "и", "e"):
        out.append("name:joined")
    if any(initials):
        out += ("name:initial", f"name:{strong}:initial")
        if initials[-1]:
            out.append("name:initial_last")
    if any(particles):
        out.append("name:particle")
        if particles[-1]:
            out.append("name:particle_last")
        if particles[0]:
            out.append("name:particle_first")
    if any(w.lower().rstrip(".") in NOT_NAME and not p and not (i and w[0].isupper()) for w, p, i in zip(words, particles, initials)):
        out.append("name:common_word")
    if any(w.lower() in THINGS or w.lower() in ENDING_THINGS for w in core):
        out.append("name:thing_inside")
    if any(w.lower() in VERBS or w.lower() in ROLES for w in core):
        out.append("name:verb_inside")
    if TITLE_ONLY.match(words[0]) or n > 1 and any(TITLE_ONLY.match(x) for x in words):
        out.append("name:title_inside")
    scripts = {"latin" if c < "ɐ" or "Ḁ" <= c < "ἀ" else "greek" if c < "Ѐ" else "cyrillic" if c < "԰" else "other" for w in core for c in w[:1]}
    if len(scripts) > 1:
        out.append("name:scripts")
    between = text[start:end]
    if "," in between:
        out.append("name:comma")
        if between.count(",") == 1 and len(core) == 2 and between.split(",")[0].endswith(core[0]):
            out += ("name:reversed", f"name:{strong}:reversed", f"name:{strong}:reversed:right={right}")
    dotted = [w.endswith(".") and not i for w, i in zip(words, initials)]
    if any(dotted):
        out.append("name:dot_inside" if any(dotted[:-1]) else "name:dot_at_end")
    if shape == "mixed" and any(w.isupper() and len(w) > 2 for w in core):
        out.append("name:acronym")
    if any(len(w) == 1 for w in core):
        out.append("name:one_letter")
    if any(c.isdigit() or c == "_" for c in between):
        out.append("name:digit")
    if right == "digit" or text[end : end + 1].isdigit():
        out.append("name:number_after")
    return out


def _trim(m: re.Match) -> tuple[int, int]:
    """A word without the full stop that ends a sentence; initials keep theirs."""
    return m.start(), m.end() - (m[0].endswith(".") and not INITIAL.match(m[0]))


def _name_tokens(text: str, at: int) -> list[tuple[int, int]]:
    """Up to MAX_NAME words from ``at`` on, one space or comma and space apart."""
    out = []
    while len(out) < MAX_NAME:
        m = TOKEN.match(text, at)
        if not m:
            break
        out.append(_trim(m))
        end = out[-1][1]
        if text.startswith(", ", end) and all(PARTICLE_ONLY.match(text[a:b]) for a, b in out[:-1]) and not PARTICLE_ONLY.match(m[0]):
            at = end + 2
        elif end < len(text) and text[end] == " ":
            at = end + 1
        else:
            break
    return out


def _name_candidates(text: str, low: str, hints: set[str], cues: dict[int, str]):
    titles = {m.end(): m.start() for m in NAME_TITLE.finditer(text)}
    seen = set()

    def cue_at(start: int) -> tuple[str, bool]:
        titled = start in titles
        return cues.get(titles[start] if titled else start, ""), titled

    def span(tokens, form="plain", *more):
        key = (tokens[0][0], tokens[-1][1], form)
        if key not in seen and key[1] - key[0] <= MAX_SEGMENT:
            seen.add(key)
            yield *key[:2], "name", _name_features(text, tokens, *cue_at(key[0]), form) + list(more)

    # words with capital letters, wherever they stand
    for run in NAME_RUN.finditer(text):
        found = [_trim(m) for m in TOKEN.finditer(text, run.start(), run.end())]
        for i, (first, end) in enumerate(found):
            if i and not text[first - 1].isspace():  # inside an abbreviation
                continue
            known = low[first:end].split("-")[0] in GIVEN or low[first:end] in GIVEN_OTHER
            single = known or first in titles or first in cues
            commas = 0
            for j in range(i, min(i + MAX_NAME, len(found))):
                if j > i:
                    gap = text[found[j - 1][1] : found[j][0]]
                    if gap == ", " and not commas and j - i <= 3 and all(PARTICLE_ONLY.match(low[a:b]) for a, b in found[i : j - 1]):
                        commas += 1
                    elif gap != " ":
                        break
                if j > i or single:
                    yield from span(found[i : j + 1])
    # small letters and other scripts: behind a cue or a title
    for at in {at for at, kind in cues.items() if kind == "cue"} | set(titles):
        if at < len(text) and at not in titles and at + 1 < len(text):
            title = TITLE_AT.match(text, at)
            at = title.end() if title else at
        tokens = _name_tokens(text, at)
        for n in range(1, len(tokens) + 1):
            yield from span(tokens[:n])
    # small letters before what only people do, at the start of a sentence
    for m in LOWER_RIGHT.finditer(low) if "lower_right" in hints else ():
        line = max(low.rfind("\n", 0, m.start()) + 1, m.start() - MAX_SEGMENT)
        found = [_trim(x) for x in TOKEN.finditer(low, line, m.start())][-MAX_NAME:]
        for n in range(len(found)):
            tokens = found[n:]
            if tokens[-1][1] != m.start() or any(low[a[1] : b[0]] not in (" ", ", ") for a, b in zip(tokens, tokens[1:])):
                continue
            if text[tokens[0][0] : m.start()].islower() and _left_of(text, tokens[0][0])[0] == "start":
                yield from span(tokens)
    for m in NAME_HONORIFIC.finditer(text) if "honorific" in hints else ():
        parts = [x.span() for x in re.compile(r"[^ ・]+").finditer(text, m.start(1), m.end(1))]
        for tokens in (parts, parts[-1:]):
            family = text[tokens[0][0] : tokens[0][1]]
            lexicon = "family" if any(family.startswith(f) for f in JAPANESE) or family[0] in KOREAN + CHINESE else "no_family"
            yield from span(tokens, "honorific", f"name:honorific_{'whole' if len(tokens) == len(parts) else 'part'}", f"name:honorific_{lexicon}", f"name:honorific_length={min(len(family), 4)}:{len(parts)}", f"name:honorific_kana={any('ぁ' <= c <= 'ヿ' for c in family)}")
    for run in HAN_RUN.finditer(text):
        a, b = run.span()
        behind = {m.end() for m in HAN_BEFORE.finditer(text, a, b)}
        for i in sorted(behind | {a}):
            two = text[i : i + 2] in JAPANESE
            if not two and text[i : i + 1] not in CHINESE:
                continue
            cue = i in behind
            place = "cue" if cue else "start"
            for length in (2, 3, 4):
                if i + length > b:
                    break
                right = "verb" if HAN_AFTER.match(text, i + length) else "end" if i + length == b else "inside"
                yield from span([(i, i + length)], "han", f"name:han:{place}:{right}", f"name:han:length={length}:{two}", f"name:han:{right}:{length}")
        if b + 3 <= len(text) and text[b] in " 　" and text[max(a, b - 3) : b].endswith(tuple(JAPANESE)) and (given := HAN_RUN.match(text, b + 1)):
            start = b - (3 if text[max(a, b - 3) : b] in JAPANESE else 2)
            if start == a and given.end() - given.start() <= 3:
                yield from span([(start, b), given.span()], "han_pair")


def candidates(text: str) -> list[tuple[int, int, str, list[str]]]:
    """All candidate segments of ``plain`` text: start, end, kind, features; by end."""
    low = text.lower()
    if len(low) != len(text):  # offsets must hold
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    out = []
    hints, cues = _looked_through(low)
    for source in (_email_candidates, _phone_candidates, _id_candidates, _address_candidates, _name_candidates):
        out += source(text, low, hints, cues)
    return sorted(out, key=lambda c: (c[1], c[0], c[2]))


def decode(found: list[tuple[int, int, str, list[str]]], weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """The best set of segments that do not overlap."""
    if not found:
        return []
    ends = [c[1] for c in found]
    best, choice = [0.0], []
    for i, (start, _, _, features) in enumerate(found):
        j = bisect_right(ends, start, 0, i)  # segments that end where this one starts or before
        score = best[j] + sum(weights.get(f, 0.0) for f in features)
        choice.append((j, True) if score > best[i] else (i, False))
        best.append(max(score, best[i]))
    out, i = [], len(found)
    while i > 0:
        j, taken = choice[i - 1]
        if taken:
            out.append(found[i - 1][:3])
            i = j
        else:
            i -= 1
    return out[::-1]


@lru_cache(maxsize=1)
def trained_weights() -> dict[str, float]:
    return json.loads((Path(__file__).parent / "mention_weights.json").read_text())


def find_mentions(text: str, weights: dict[str, float] | None = None) -> list[tuple[int, int, str]]:
    """start, end (code points) and kind of each mention, in order, without overlaps."""
    p = plain(text)
    return decode(candidates(p), trained_weights() if weights is None else weights)


def normal_form(kind: str, written: str) -> str:
    """What a mention stands for, so that different spellings are equal."""
    s = plain(written)
    if kind == "email":
        s = re.sub(rf"(?i){AT}", "@", s, count=1) if "@" not in s or re.search(r"[\[({<]", s) else s
        local, _, domain = s.partition("@")
        return f"{local}@{'.'.join(HIDDEN_DOT.split(domain))}".lower()
    if kind == "phone":
        return "".join(c for c in s if c.isdigit())
    if kind == "id_number":
        return "".join(c for c in s if c.isalnum()).upper()
    if kind == "address":
        return "".join(c for c in s if c.isalnum()).lower()
    return re.sub(r"\s+", " ", written).lower()


def redact(text: str, weights: dict[str, float] | None = None) -> str:
    """The text with [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] and [NAME] in place of the mentions."""
    out, at = [], 0
    for start, end, kind in find_mentions(text, weights):
        out += (text[at:start], f"[{kind.upper()}]")
        at = end
    return "".join(out) + text[at:]


def mentions(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """One row per mention: keys, kind, found (normal form), start_pos, end_pos. Null and empty texts have none."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    weights = trained_weights()
    source = texts.where(F.col(text_col) != "").select(*keys, F.col(text_col).alias("_text"))
    extra = texts.sparkSession.createDataFrame([], "kind string, found string, start_pos long, end_pos long").schema
    fields = StructType([*[source.schema[k] for k in keys], *extra])
    schema = to_arrow_schema(fields)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = [], []
            for i, text in enumerate(b.column("_text").to_pylist()):
                for start, end, kind in find_mentions(text, weights):
                    rows.append(i)
                    out.append((kind, normal_form(kind, text[start:end]), start, end))
            take = pa.array(rows, pa.int32())
            cols = list(zip(*out)) or [[]] * 4
            arrays = [b.column(k).take(take) for k in keys] + [pa.array(c, schema.field(len(keys) + n).type) for n, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return source.mapInArrow(step, fields)


def redacted(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys and the text with typed placeholders; null stays null, texts without mentions stay as they are."""
    weights = trained_weights()
    source = texts.select(*keys, text_col)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [t if not t else redact(t, weights) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keys] + [pa.array(new, pa.string())], names=[*keys, text_col])

    return source.mapInArrow(step, source.schema)
