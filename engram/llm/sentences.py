"""Sentence boundaries across languages and scripts.

Method: boundary rules compiled into a finite transducer. A lexer turns a text into symbols: stops with the class of the word
before them and the class of what follows, opening and closing marks with what follows them, ends of blocks. The rules say
for every pair of classes whether a stop ends a sentence; they are compiled, once, into the transducer's tables, which say
for every symbol and state the next state and whether a unit ends. States are: at the start of a unit, inside one, and
inside each kind of quotation or bracket opened at the start or in the middle of one. The symbols of all texts of a task
form one stream, cut into chunks that are read side by side: a first pass gives each chunk's function from state to state,
a parallel prefix scan composes them, and a second pass emits the boundaries from the states now known. A long document is
thus read like many short ones. The lexer looks at no more than a few words around a stop; runs of marks and white space
are measured once, so its time is in proportion to the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions.text import JS_SPACE

#: Symbols in a chunk of the stream.
CHUNK = 64

# Abbreviations, in lower case and without their last point.
# Those that never end a sentence.
OPEN_ABBREVIATIONS = frozenset(
    "dr mr mrs ms mx prof hon rev gen col capt lt st mt vs cf viz e.g i.e approx ca resp incl excl "
    "bzgl bzw evtl ggf z d vgl inkl sog zzgl hr fr dipl u.a z.b d.h u.u "
    "sra srta dra dña ej p.ej aprox vid mme mlle mgr ex p.ex "
    "напр см т т.е им тов гр "
    "π.χ δηλ βλ κ κα "
    "डॉ श्री श्रीमती प्रो".split()
)
# Those that come before a number and otherwise are words of their own.
NUMBER_ABBREVIATIONS = frozenset(
    "no nos nr p pp pg fig figs sec secs app ch chap vol art arts eq abs kap bd abb s pág págs núm "
    "рис стр гл табл п пп ст № σελ κεφ αρ".split()
)
# Those that may end a sentence; what follows decides.
CLOSED_ABBREVIATIONS = frozenset(
    "etc al inc ltd co corp jr sr bros dept est ff a.m p.m am pm u.s e.u u.k u.n u.s.a "
    "mon tue wed thu fri sat sun jan feb mar apr jun jul aug sep sept oct nov dec "
    "usw u.s.w usf std min sek mio mrd env hab ud uds "
    "д п г гг в вв сек мин ч руб тыс млн млрд др проч т.д т.п κ.λπ κ.τ.λ κλπ".split()
)
# Words before an ordinal number in German.
ORDINAL_BEFORE = frozenset("der die das dem den des am im vom zum zur beim ab bis seit jeder jede jedes ein eine einer einem und".split())
# Words with which a sentence goes on after a question or exclamation mark.
GOING_ON = frozenset("or and but nor und oder aber o u y e pero ou et mais или и а но ή και".split())
# Abbreviations of time and lists that end a sentence before any word but these.
BEFORE_ANY = frozenset("a.m p.m etc".split())
SMALL_WORDS = frozenset(
    "and or but to on in at for of with by from until till when while as is are was were be been has have had will would can could "
    "may might must should do does did the a an this that these those which who each every sharp local daily today tomorrow".split()
)
# Thai particles that end a sentence.
THAI_END = "ครับ|ค่ะ|คะ|จ้ะ|จ๊ะ|จ้า"

CJK = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f"
OPENERS = {"“": 0, "„": 1, "«": 2, "「": 3, "『": 4, "(": 5, "（": 6, '"': 7}
CLOSERS = {"”": (0, 1), "“": (1,), "»": (2,), "」": (3,), "』": (4,), ")": (5,), "）": (6,), '"': (7,)}
CLOSED_BY = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", '"': '"'}
STOPS = ".!?。！？．｡؟۔।॥…"
TRAILING = "”\"'’»」』）)]"

UPPER = "A-Z\u00c0-\u00de\u0386-\u03ab\u0400-\u042f"
JOINED_WORD = re.compile(rf"[^\W\d_{UPPER}]+\.[{UPPER}]")
# A word that begins a sentence without a space before it.
JOINED = re.compile(rf"[{UPPER}][^\W\d_]*(?:[ \t\r\n\xa0’'-]|\.\.\.|[,:] |\.[a-z]{{1,3}} )")
EVENT = re.compile(
    rf"(?<!\.)\.++(?=[\s{re.escape(TRAILING)}]|$|[{CJK}{UPPER}])|[!?؟۔।॥…]+|[。！？．｡]+|;(?=\s|$)|(?:{THAI_END})(?=\s|$)|[“”„«»「」『』()（）\"]"
)
LINE_END = re.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
HEADING = re.compile(r"#{1,6}(?:[ \t\xa0\u3000]|$)")
FENCE = re.compile(r"(`{3,}|~{3,})")
ITEM = re.compile(r"(?:[-*+•‣·]|(\d{1,3})[.)])[ \t\xa0\u3000]+")
CHAT = re.compile(r"\[?\d{1,2}:\d{2}(?::\d{2})?\]?[ \t]+[^\s:]{1,32}:[ \t]*")
GREEK = re.compile("[\u0370-\u03ff\u1f00-\u1fff]")
TAG_CJK = re.compile("(?:と|って|という|などと|(?:他|她|它|我|你|他们|她们|我们|老师|对方)[^。！？]{0,3}?(?:问|問|说|說|道|答|喊|叫|写|寫|想)(?![道着著]?[：:]))")
SPACE = frozenset(JS_SPACE + "\x85\x1c\x1d\x1e\x1f")

# --- the transducer -------------------------------------------------------------------------------------------------
AT_START, INSIDE = 0, 1
N_STATES = 2 + 2 * len(OPENERS)
PAD, TEXT, STOP, END = range(4)
MARKS = list(dict.fromkeys([*OPENERS, *CLOSERS]))
CAN_OPEN, ENDS_START, ENDS_MIDDLE = 1, 2, 4


# Classes of what stands before a full stop, and of what follows a stop.
(NO_WORD, OPEN, NUMBER, CLOSED, CLOSED_DOTTED, CLOSED_ANY, CLOSED_SR, INITIAL, SMALL_LETTER, ORDINAL, WORD, ELLIPSIS, EXCLAIMED, TRAILED_OFF, OTHER_MARK) = LEFTS = range(15)
(AT_END, GLUED, GLUED_CJK, GLUED_JOINED, GLUED_OTHER, LOWER, LOWER_TECHNICAL, LOWER_SMALL, LOWER_ASCII, LOWER_GOING_ON, DIGIT, CAPITAL, LETTER, PAUSE, ELSE) = RIGHTS = range(15)
ANY_GLUED = (GLUED, GLUED_CJK, GLUED_JOINED, GLUED_OTHER)
ANY_LOWER = (LOWER, LOWER_TECHNICAL, LOWER_SMALL, LOWER_ASCII, LOWER_GOING_ON)


def ends_sentence(left: int, right: int) -> bool:
    """The rules: whether a stop with ``left`` before it and ``right`` behind it ends a sentence."""
    if right == AT_END:
        return True
    if left == ELLIPSIS:
        return right not in ANY_GLUED and right not in ANY_LOWER and right != DIGIT
    if left == TRAILED_OFF:  # a sign for an ellipsis
        return right == CAPITAL
    if left == EXCLAIMED and right in ANY_GLUED:
        return right != GLUED
    if left in (EXCLAIMED, OTHER_MARK):
        return right not in (PAUSE, LOWER_GOING_ON)
    if right in ANY_GLUED:  # no space: before a script that has none, or where one was forgotten
        return right in (GLUED_CJK, GLUED_JOINED)
    if left == NO_WORD:
        return True
    if left == OPEN:
        return False
    if left == NUMBER:
        return right not in ANY_LOWER and right != DIGIT
    if left in (CLOSED, CLOSED_DOTTED, CLOSED_ANY, CLOSED_SR):
        if right in ANY_LOWER:
            return right == LOWER_TECHNICAL or left == CLOSED_ANY and right == LOWER_ASCII
        if right == DIGIT:
            return left in (CLOSED_DOTTED, CLOSED_ANY)
        return right != PAUSE and not (left == CLOSED_SR and right == CAPITAL)
    if left == INITIAL:
        return right not in ANY_LOWER and right not in (CAPITAL, LETTER)
    if left == SMALL_LETTER:  # a part such as in d. h.
        return right not in ANY_LOWER
    if left == ORDINAL and (right in ANY_LOWER or right in (CAPITAL, LETTER)):
        return False
    return right != PAUSE


def mark_symbol(mark: str, bits: int) -> int:
    return 4 + 8 * MARKS.index(mark) + bits


FIRST_STOP = 4 + 8 * len(MARKS)


def stop_symbol(left: int, right: int) -> int:
    return FIRST_STOP + left * len(RIGHTS) + right


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output (1: a unit ends behind the symbol) by symbol and state."""
    n = FIRST_STOP + len(LEFTS) * len(RIGHTS)
    move = np.tile(np.arange(N_STATES, dtype=np.int8), (n, 1))
    emit = np.zeros((n, N_STATES), dtype=bool)
    stops = [STOP] + [stop_symbol(x, y) for x in LEFTS for y in RIGHTS if ends_sentence(x, y)]
    texts = [TEXT] + [stop_symbol(x, y) for x in LEFTS for y in RIGHTS if not ends_sentence(x, y)]
    move[texts, AT_START] = INSIDE
    move[stops, INSIDE], emit[stops, INSIDE] = AT_START, True
    move[END, :], emit[END, 1:] = AT_START, True
    for mark in MARKS:
        for bits in range(8):
            symbol = mark_symbol(mark, bits)
            if mark in OPENERS and bits & CAN_OPEN:
                move[symbol, AT_START] = 2 + 2 * OPENERS[mark]
                move[symbol, INSIDE] = 3 + 2 * OPENERS[mark]
            elif mark in OPENERS:
                move[symbol, AT_START] = INSIDE
            for kind in CLOSERS.get(mark, ()):
                for state, flag in ((2 + 2 * kind, ENDS_START), (3 + 2 * kind, ENDS_MIDDLE)):
                    move[symbol, state] = AT_START if bits & flag else INSIDE
                    emit[symbol, state] = bool(bits & flag)
    return move, emit


MOVE, EMIT = _compile()


def transduce(symbols: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Which symbols end a unit, read from AT_START: chunk functions, their prefix composition, then the outputs."""
    n = len(symbols)
    rows = max(1, -(-n // chunk))
    stream = np.zeros(rows * chunk, dtype=np.int16)  # PAD changes nothing
    stream[:n] = symbols
    stream = stream.reshape(rows, chunk)
    function = np.tile(np.arange(N_STATES, dtype=np.int8), (rows, 1))
    for j in range(chunk):
        function = np.take_along_axis(MOVE[stream[:, j]], function.astype(np.int64), 1)
    prefix, step = function, 1
    while step < rows:  # prefix[i] becomes the composition of the functions of chunks 0 to i
        later = np.take_along_axis(prefix[step:], prefix[:-step].astype(np.int64), 1)
        prefix = np.concatenate([prefix[:step], later])
        step *= 2
    state = np.concatenate([[AT_START], prefix[:-1, AT_START]]).astype(np.int64)
    out = np.zeros(stream.shape, dtype=bool)
    for j in range(chunk):
        out[:, j] = EMIT[stream[:, j], state]
        state = MOVE[stream[:, j], state].astype(np.int64)
    return out.reshape(-1)[:n]


# --- the lexer ------------------------------------------------------------------------------------------------------
def blocks(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(start, where sentences start, end, whether the block is one unit): paragraphs, headings, fenced blocks, list
    items and chat lines; blank lines lie between blocks."""
    bounds = [(m.start(), m.end()) for m in LINE_END.finditer(text)] + [(len(text), len(text))]
    start, fence, opened = 0, None, None
    para = None  # start and end of the paragraph being read
    in_list = False
    for end, following in bounds:
        line_start, start = start, following
        body = line_start
        while body < end and text[body] in SPACE:
            body += 1
        if fence:
            mark = FENCE.match(text, body, end)
            if mark and mark[1].startswith(fence):
                yield opened, opened, end, True
                fence = None
            continue
        if body == end:  # blank
            if para:
                yield para[0], para[0], para[1], False
                para = None
            in_list = False
            continue
        c = text[body]
        if c in "`~" and (mark := FENCE.match(text, body, end)):
            if para:
                yield para[0], para[0], para[1], False
                para = None
            fence, opened = mark[1], line_start
            continue
        marker, whole = None, False
        if c == "#":
            whole = HEADING.match(text, body, end) is not None
        elif c == "[" or c.isdigit():
            marker = CHAT.match(text, body, end)
            if not marker and c != "[" and (item := ITEM.match(text, body, end)):
                goes_on = para and text[max(para[0], para[1] - 10) : para[1]].split()[-1:]
                ordinal = goes_on and goes_on[0].lower() in ORDINAL_BEFORE
                marker = item if in_list or not para or item[1] == "1" and not ordinal else None
        elif c in "-*+•‣·":
            marker = ITEM.match(text, body, end)
        if whole or marker:
            if para:
                yield para[0], para[0], para[1], False
                para = None
            yield line_start, marker.end() if marker else line_start, end, whole
            in_list = marker is not None
        elif para:
            para = (para[0], end)
        else:
            para, in_list = (line_start, end), False
    if fence:
        yield opened, opened, len(text), True
    if para:
        yield para[0], para[0], para[1], False


class _Runs:
    """Ends of the runs of closing marks and of white space in a block; each run is measured once."""

    def __init__(self, text: str, begin: int, end: int):
        self.text, self.begin, self.end = text, begin, end
        self.ahead = {TRAILING: (0, 0), SPACE: (0, 0)}
        self.behind = {TRAILING: (0, 0), SPACE: (0, 0)}
        self.last: dict[str, int] = {}

    def after(self, at: int, kind) -> int:
        """The first position from ``at`` on that is not in a run of this kind."""
        low, high = self.ahead[kind]
        if low <= at < high:
            return high
        look = at
        while look < self.end and self.text[look] in kind:
            look += 1
        self.ahead[kind] = (at, look)
        return look

    def before(self, at: int, kind) -> int:
        """The last position before ``at`` that is not in a run of this kind."""
        low, high = self.behind[kind]
        back = at - 1
        while back >= self.begin and self.text[back] in kind:
            back = low - 1 if low <= back < high else back - 1
        self.behind[kind] = (back + 1, at)
        return back

    def follow(self, at: int) -> tuple[int, str]:
        """The next position that is not white space, and its character ('' at the end)."""
        at = self.after(at, SPACE)
        return at, self.text[at] if at < self.end else ""

    def comes(self, marks: str, at: int) -> bool:
        """Whether one of the marks comes at ``at`` or later."""
        for c in marks:
            if c not in self.last:
                self.last[c] = self.text.rfind(c, self.begin, self.end)
        return any(self.last[c] >= at for c in marks)


def _is_cjk(c: str) -> bool:
    return "\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff" or "\uf900" <= c <= "\ufaff" or "\uff66" <= c <= "\uff9f"


def _word(text: str, at: int, end: int) -> str:
    stop = at
    while stop < end and (text[stop].isalnum() or text[stop] in "_./-") and stop - at < 40:
        stop += 1
    return text[at:stop]


def _technical(word: str) -> bool:
    """A name such as a file or a version, which may begin a sentence in lower case."""
    if JOINED_WORD.match(word):  # a plain word and, with no space between, the next sentence
        return False
    word = word.rstrip(".-/")
    return any(c in "_/." or c.isdigit() or c.isupper() for c in word[1:])


#: Code points before a stop in which an abbreviation can begin: more than the longest has.
BACK = 16


def _before_point(text: str, begin: int, at: int) -> int:
    """The class of the word before a single full stop at ``at``."""
    start = at
    while start > begin and at - start < BACK and (text[start - 1].isalnum() or text[start - 1] == "." or "\u0900" <= text[start - 1] <= "\u097f"):
        start -= 1
    word = text[start:at].lower()
    if not word:
        return NO_WORD
    if len(word) == BACK:
        return WORD
    if word in OPEN_ABBREVIATIONS:
        return OPEN
    if word in NUMBER_ABBREVIATIONS:
        return NUMBER
    if word in CLOSED_ABBREVIATIONS:
        if word == "sr" and text[start].isupper():
            return CLOSED_SR
        return CLOSED_ANY if word in BEFORE_ANY else CLOSED_DOTTED if "." in word or word in ("usw", "inc", "ltd") else CLOSED
    if len(word) == 1 and word.isalpha() and not _is_cjk(word):
        return INITIAL if text[start].isupper() else SMALL_LETTER
    if word.isdigit() and len(word) <= 2 and 0 < int(word):
        before = text[max(begin, start - 12) : start].split()
        if before and before[-1].lower() in ORDINAL_BEFORE:
            return ORDINAL
    return WORD


def _behind(text: str, c: str, nxt: int, end: int, left: int) -> int:
    """The class of what follows a stop after white space: the character ``c`` at ``nxt`` and, where it matters, its word."""
    if c.islower():
        if left in (CLOSED, CLOSED_DOTTED, CLOSED_ANY, CLOSED_SR):
            word = _word(text, nxt, end)
            if _technical(word):
                return LOWER_TECHNICAL
            return LOWER if not word.isascii() else LOWER_SMALL if word in SMALL_WORDS else LOWER_ASCII
        if left in (EXCLAIMED, OTHER_MARK) and _word(text, nxt, end) in GOING_ON:
            return LOWER_GOING_ON
        return LOWER
    if c.isdigit():
        return DIGIT
    if c.isalpha():
        return CAPITAL if c.isupper() else LETTER
    return PAUSE if c in ",;:" or c in "，、；：" and left in (EXCLAIMED, OTHER_MARK) else ELSE


def _stop(text: str, at: int, after: int, runs: _Runs) -> int:
    """The symbol of the points, or marks such as ! and ?, at [at, after)."""
    begin, end, stopped = runs.begin, runs.end, text[at:after]
    if text[at] == ".":
        left = ELLIPSIS if after - at > 1 else None
    elif "…" in stopped and "!" not in stopped and "?" not in stopped:
        left = TRAILED_OFF
    else:
        left = EXCLAIMED if stopped[-1] in "!?" else OTHER_MARK
    look = runs.after(after, TRAILING)
    nxt, c = runs.follow(look)
    if not c:
        return stop_symbol(WORD if left is None else left, AT_END)
    if nxt == look and (left is None or left in (ELLIPSIS, TRAILED_OFF, EXCLAIMED)):
        if _is_cjk(c):
            right = GLUED_CJK
        elif left == EXCLAIMED and not (c.isascii() or c.isalpha()) or left == EXCLAIMED and "\u0e00" <= c <= "\u0e7f":
            right = GLUED_OTHER
        else:
            right = GLUED_JOINED if left in (None, EXCLAIMED) and _joined(text, begin, at, nxt) else GLUED
        return stop_symbol(WORD if left is None else left, right)
    if left is None:
        left = _before_point(text, begin, at)
    return stop_symbol(left, _behind(text, c, nxt, end, left))


def _joined(text: str, begin: int, at: int, nxt: int) -> bool:
    """Whether a plain word, its stop at ``at``, is followed at once by a word that begins a sentence."""
    ended = text[at - 1].islower() or text[at - 1].isdigit() or text[at - 1] in TRAILING or (text[at - 2 : at].isupper() and text[at - 2].isalpha())
    if not ended or not JOINED.match(text, nxt):
        return False
    start = at
    while start > begin and text[start - 1] not in SPACE and at - start < 60:
        start -= 1
    token = text[start:at]
    return "@" not in token and "=" not in token and "://" not in token and token.lower() not in OPEN_ABBREVIATIONS


def _close_bits(text: str, at: int, runs: _Runs) -> int:
    """What a closing mark at ``at`` ends: a unit that its opening mark began, one in whose middle it was opened."""
    begin, end = runs.begin, runs.end
    back = runs.before(at, SPACE)
    if back < begin or (text[back] not in STOPS and text[back] not in "”’」』»\"'"):
        return 0
    stop = text[back]
    if stop not in STOPS:
        back = runs.before(back + 1, TRAILING)
        if back < begin or text[back] not in STOPS:
            return 0
        stop = text[back]
    look = runs.after(at + 1, TRAILING)
    nxt, c = runs.follow(look)
    if not c:
        return ENDS_START | ENDS_MIDDLE
    if c in ",;:，、；：—–-。！？．｡.!?؟।":
        return 0 if not (c == "-" and nxt > look) else ENDS_START
    if _is_cjk(c):
        return 0 if text[at] not in ")）" and TAG_CJK.match(text, nxt) else ENDS_START
    if c.islower():
        return ENDS_START if stop in ".。।" or _technical(_word(text, nxt, end)) else 0
    if c.isupper() or c.isdigit() or c in "¿¡" or c in OPENERS:
        return ENDS_START | (ENDS_MIDDLE if nxt > look else 0)
    if c.isalpha():  # a script without cases
        return ENDS_START if nxt > look else 0
    return ENDS_START


def lex(text: str, symbols: list[int], ends: list[int]) -> None:
    """Appends the symbols of a text and, for each, where a unit would end if it ended there."""
    for start, body, end, whole in blocks(text):
        stop = end
        while stop > start and text[stop - 1] in SPACE:
            stop -= 1
        if whole or body >= stop:
            symbols += (TEXT, END)
            ends += (stop, stop)
            continue
        at, greek, runs = body, None, _Runs(text, body, stop)
        for m in EVENT.finditer(text, body, stop):
            s, e = m.span()
            if at < s and not text[at:s].isspace():
                symbols.append(TEXT)
                ends.append(s)
            at = e
            c = text[s]
            if c in CLOSED_BY or c in CLOSERS:
                bits = 0
                if c in OPENERS:
                    before, after = text[s - 1] if s > body else " ", text[e] if e < stop else " "
                    fits = c != '"' or (not (before.isalnum() and before.isascii()) and before not in ".!?" and not after.isspace())
                    if fits and runs.comes(CLOSED_BY[c], e):
                        bits |= CAN_OPEN
                if c in CLOSERS:
                    bits |= _close_bits(text, s, runs)
                symbols.append(mark_symbol(c, bits))
            elif c == ";":
                if greek is None:
                    greek = GREEK.search(text, body, stop) is not None
                hit = greek and not runs.follow(e)[1].islower() and GREEK.search(text, max(body, s - 60), s) is not None
                symbols.append(STOP if hit else TEXT)
            elif c in "。！？｡" or "\u0e00" <= c <= "\u0e7f":
                symbols.append(STOP)
            elif c == "．":
                symbols.append(TEXT if e < stop and text[e].isdigit() else STOP)
            else:
                symbols.append(_stop(text, s, e, runs))
            ends.append(e)
        if at < stop and not text[at:stop].isspace():
            symbols.append(TEXT)
            ends.append(stop)
        symbols.append(END)
        ends.append(stop)


def sentence_ends(texts: list[str | None], chunk: int = CHUNK) -> list[list[int]]:
    """Where the units of each text end, in code points."""
    symbols: list[int] = []
    ends: list[int] = []
    bounds = [0]
    for text in texts:
        if text:
            lex(text, symbols, ends)
        bounds.append(len(symbols))
    found = transduce(np.array(symbols, dtype=np.int16), chunk)
    out = []
    for text, a, b in zip(texts, bounds, bounds[1:]):
        mine: list[int] = []
        for i in np.flatnonzero(found[a:b]).tolist():
            e = ends[a + i]
            if mine and e <= mine[-1]:
                continue
            while e < len(text) and text[e] in TRAILING:  # closing marks that nothing opened
                e += 1
            if not mine or e > mine[-1]:
                mine.append(e)
        out.append(mine)
    return out


UNITS = "unit_no int, start_pos long, end_pos long"


def sentences(documents: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """One row per sentence unit: key, unit_no (from 0), start_pos and end_pos (code points of the text as it is).

    Null, empty and blank texts have no units. White space lies between units, closing marks within them. Every
    character that is not white space lies in exactly one unit. Repeated rows give repeated units; a null key is kept.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    source = documents.select(key, F.col(text_col).alias("_text"))
    fields = StructType([source.schema[key], *documents.sparkSession.createDataFrame([], UNITS).schema])
    schema = to_arrow_schema(fields)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("_text").to_pylist()
            rows, number, starts, ends = [], [], [], []
            for i, (text, found) in enumerate(zip(texts, sentence_ends(texts))):
                at = 0
                for n, e in enumerate(found):
                    while text[at] in SPACE:
                        at += 1
                    rows.append(i)
                    number.append(n)
                    starts.append(at)
                    ends.append(e)
                    at = e
            arrays = [b.column(key).take(pa.array(rows, pa.int32())), pa.array(number, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return source.mapInArrow(step, fields)
