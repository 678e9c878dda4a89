"""Defective question-answer pairs, each with one type of defect.

The types are tried in this order: ``empty`` (nothing but placeholders or headings), ``refusal`` (every sentence is
produced by a refusal grammar), ``copies_question`` (greedy string tiling: tiles of the question cover the answer),
``other_language`` (scripts and function words), ``truncated`` (a pushdown parser of fences, brackets, quotations, lists
and markup ends inside something, or the text ends without an end mark).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut_lineage

# What stands for a missing answer, in lower case and without white space.
PLACEHOLDERS = {
    "无", "暂无", "略", "空", "待补充", "待定", "未知", "无答案", "暂无答案", "没有答案", "答案", "答", "解", "解答", "答案生成失败", "生成失败", "请求失败", "n/a", "na", "nan", "null", "none", "nil",
    "todo", "tbd", "undefined", "empty", "noanswer", "answer", "solution", "error", "failed", "generationfailed", "answergenerationfailed", "answer:generationfailed", "respuesta", "réponse", "antwort",
}

HEADING = re.compile(r"^\s*(?:#{1,6}\s*\S.*|[^\s。！？!?.]{1,12}[:：])\s*$")
#: What is a heading if other answers have text below it, and a list item or a highlighted answer otherwise.
TITLE = re.compile(r"^\s*(?:(?:\d+[.、)]|[一二三四五六七八九十]+、)\s*([^。！？!?]{0,40})|\*\*([^*]+)\*\*\s*[:：]?)\s*$")
FENCE = re.compile(r"^\s*(`{3,}|~{3,})")

# The words of the refusal grammar. A refusal has a sentence that withholds the answer, and no other sentences
# than such and courtesies. To say that something is impossible is no refusal: someone who answers must decline to answer.
DECLINES = r"(?:can(?:no|['’])t|cannot|(?:am|are|is|was|be) (?:unable|not able|not allowed|not permitted|not comfortable|not in a position)(?: to)?|unable to|not able to|won['’]t|will not|(?:['’]d|would) rather not|(?:must |have to )?(?:decline|refuse)(?: to)?|(?:do not|don['’]t|does not|doesn['’]t) allow (?:me|us) to)"
ANSWERS = r"(?:help|assist|answer|respond|comply|comment|advise)(?:ing)?"
DELIVERS = r"(?:provid|giv|offer|shar|writ|complet|solv|do|produc|suppl|discuss|work out|work on|explain|finish|handl|address)(?:e|y|ing)?"
DELIVERED = r"(?:answers?|solutions?|help|proofs?|code|this|that|it|these|questions?|exercises?|problems?|tasks?|requests?|homework|assignments?|explanations?|information|guidance)"
REFUSES = re.compile(
    rf"\b(?:i|as an (?:ai|assistant)|(?:my|our) \w+)\b[^.]{{0,40}}?{DECLINES}(?: be)?(?:\W+\w+){{0,2}}?\W+(?:{ANSWERS}|{DELIVERS}(?:\W+\w+){{0,4}}?\W+{DELIVERED})\b"
    rf"|\bwe {DECLINES}(?: be)?(?:\W+\w+){{0,2}}?\W+(?:{ANSWERS})\b"
    rf"|^\W*(?:(?:sorry|unfortunately|regrettably|apologies|i apologi[sz]e|regarding [^:.]{{0,80}}:)[,:]?\s++(?:but\s++)?)*+{DECLINES}(?: be)?\W+(?:{ANSWERS}|{DELIVERS}(?:\W+\w+){{0,4}}?\W+{DELIVERED})\b"
    r"|\bno (?:solution|answer|help|explanation) (?:can|could|will) be (?:given|provided|offered|shared)|\b(?:solution|answer)s? (?:can(?:no|['’])t|cannot|will not) be (?:given|provided|offered|shared)"
    r"|\b(?:this|that|the|your) (?:\w+ )?(?:request|question|exercise|problem|task|topic)s? (?:is|are|falls?|lies?|goes) (?:outside|beyond) (?:of )?(?:what (?:i|we)|my|our)\b"
    r"|我(?!们)[^。，,；;]{0,8}?(?:不能|无法|不便|不会|不可以|拒绝|不予|难以|不愿)[^。；;]{0,10}?(?:回答|解答|作答|帮|协助|提供|给出|完成|代写|代做|解决|讨论)"
    r"|我们[^。，,；;]{0,8}?(?:不能|无法|不便|不会|不可以|拒绝|不予|难以|不愿)[^。；;]{0,6}?(?:回答|解答|作答|协助)"
    r"|恕[^。；;]{0,6}?(?:不|难|无法)[^。；;]{0,6}?(?:回答|解答|作答|奉告|提供|从命|协助)|帮不了[你您]|帮不上忙|超出[^。；;]{0,4}(?:我|助手)[^。；;]{0,8}(?:范围|能力)"
    r"|^\W*(?:[^。；;，,：:]{0,12}[，,：:]\s*+)*+(?:不能|无法|不便|拒绝|难以|不予)(?:就此|对此|[为向给][你您])?(?:回答|解答|作答|协助|帮助|帮忙)"
    r"|\b(?:no puedo|no me es posible|no podemos|ne peux pas|ne puis|kann (?:ich )?(?:\w+ ){0,3}?nicht|kann ich)\W+(?:\w+\W+){0,4}?(?:ayudar\w*|responder\w*|resolver\w*|aider|répondre|résoudre|helfen|beantworten|lösen)",
    re.IGNORECASE,
)
COURTESY = re.compile(
    r"希望你?能?理解|如有其他|欢迎|你可以先|感谢|谢谢|关于这道题|关于本题|请换一个|建议|请咨询|请查阅|抱歉|对不起|很遗憾|遗憾"
    r"|\b(?:i hope you|feel free|you may want|you might|thank(?:s| you)|regarding|please|sorry|apologi[sz]e|unfortunately|consult|try it)\b",
    re.IGNORECASE,
)
SENTENCE = re.compile(r"[。！？!?；;\n]+|(?<=[a-z\d])\.(?=\s|$)")

# Phrases that frame a repeated question, and the function words of the Latin-script languages.
FRAMES = re.compile(
    r"^\s*(?:本题要求回答|本题要求|题目(?:如下|要求|是)?|问题(?:如下|是)?|原题|请回答|the (?:task|question|problem|exercise) is(?: as follows)?|we are asked(?: the following)?|question|problem|exercise)\s*[:：,，]?"
    r"|(?:请给出(?:完整)?(?:的)?(?:解答|答案|过程)|请(?:作答|解答|回答)|please (?:give|provide) (?:the|a) (?:full |complete )?(?:solution|answer)|please answer)\s*[.。!！]?\s*$",
    re.IGNORECASE,
)
FUNCTION_WORDS = {
    "en": set("the of and is are to in that with for by on as it this we be has from which at an because then after every all not only".split()),
    "de": set("der die das und ist nicht mit wird werden wir dem den ein eine einen von zu für auf sich dass als nach wenn nur jede bei im obwohl aus folgt".split()),
    "fr": set("le la les des est et une un dans pour avec que du au aux ce cette on nous par qui sur même si car chaque seule de en se pas".split()),
    "es": set("el la los las una un es en que con para por del al se y cada solo como esta este si porque más no su de sigue aunque comparamos".split()),
}

OPENERS = {"(": ")", "（": "）", "[": "]", "【": "】", "{": "}", "「": "」", "『": "』", "《": "》", "“": "”"}
CLOSERS = {v: k for k, v in OPENERS.items()}
# The elements of HTML whose end must be written.
ELEMENTS = set("a b i u em strong code pre div span ul ol table sup sub details summary blockquote h1 h2 h3 h4 h5 h6".split())
INLINE = re.compile(r"\\(begin|end)\{([^}\n]*)\}|\\.|\$\$|\$|`+|\*\*|<(/?)([a-zA-Z][a-zA-Z0-9]*)(?:\s+\w+=[^<>\n]*)?\s*/?>|[()（）\[\]【】{}「」『』《》“”\"]")
ITEM = re.compile(r"\s*(?:(\d+)[.)、]|[(（](\d+)[)）]|([-*+•]))(?:\s+|(?<=、)|(?<=）)|$)(.*)")
PHRASE_WORDS, PHRASE_HAN = 6, 12
END_MARKS = set(".。!！?？…∎□■◻◼▪✓√")
CITATION = re.compile(r"(?:\s*(?:\[\d+(?:\s*[,，、-]\s*\d+)*\]|【\d+】|\(\s*q\.?e\.?d\.?\s*\)|（证毕）|\(证毕\)|证毕|q\.?e\.?d\.?))+\s*$", re.IGNORECASE)
FORMULA = re.compile(r"^[^一-鿿]*(?:=|≤|≥|<|>|≈|∈|⊆|→)[^一-鿿]*$")
WORD = re.compile(r"[^\W\d_]{4,}")
HAN = re.compile("[一-鿿]+")
SIGN = re.compile(r"[^\W_]")
ANY_FUNCTION_WORD = frozenset().union(*FUNCTION_WORDS.values())
CODE = re.compile(r"(`{3,}|~{3,}).*?(?:\1|\Z)|`[^`\n]*`|\$\$.*?\$\$|\$[^$\n]*\$", re.DOTALL)


def bare(text: str) -> str:
    """Letters and digits in lower case."""
    return re.sub(r"[\W_]+", "", text.lower())


def han_count(text: str) -> int:
    """How many Chinese characters the text has."""
    return sum(map(len, HAN.findall(text)))


def written_lines(answer: str) -> list[str]:
    """The lines that are neither blank nor fences."""
    return [line.strip() for line in answer.splitlines() if line.strip() and not FENCE.match(line)]


def title_of(line: str) -> str | None:
    """The letters of a line that is numbered or highlighted as a whole; None for other lines."""
    m = TITLE.match(line)
    return bare(m[1] if m[1] is not None else m[2]) if m else None


def is_empty(answer: str | None) -> bool | list[str]:
    """Whether the answer is null, blank, a placeholder, or made of headings and empty fences only.

    An answer of nothing but lines that may be headings is one if all of them are: the titles in question are returned.
    """
    if answer is None or not SIGN.search(answer):
        return True
    lines = written_lines(answer)
    if "".join("".join(lines).lower().split()).strip("*_#：:。.!！-—()（）[]【】<>\"'“”") in PLACEHOLDERS:
        return True
    if "".join(lines).lower().strip("。.!！：: ") in PLACEHOLDERS:
        return True
    titles: list[str] = []
    for line in lines:
        if not HEADING.match(line):
            title = title_of(line)
            if title is None:
                return False
            titles.append(title)
    return titles or True


def titles_in(answer: str) -> Iterator[tuple[str, bool]]:
    """The numbered and highlighted lines of an answer, and whether other text comes directly below them."""
    lines = written_lines(answer)
    titles = [title_of(line) for line in lines]
    for k, title in enumerate(titles):
        if title:
            yield title, k + 1 < len(lines) and titles[k + 1] is None and not HEADING.match(lines[k + 1])


def is_refusal(answer: str) -> bool:
    """Whether the refusal grammar produces the whole answer, whatever its length, digits or code."""
    if not REFUSES.search(answer):
        return False
    sentences = [s for s in SENTENCE.split(answer) if bare(s)]
    refuses = [bool(REFUSES.search(s)) for s in sentences]
    return any(refuses) and all(r or COURTESY.search(s) for r, s in zip(refuses, sentences, strict=True))


def coverable(answer: str, question: str, least: int, needed: float) -> bool:
    """Whether ``needed`` characters of ``answer`` lie in substrings of ``least`` characters that ``question`` has, too: no
    tiles of at least ``least`` characters can cover more."""
    grams = {question[i : i + least] for i in range(len(question) - least + 1)}
    spare, end = len(answer) - needed, 0
    for i in range(len(answer) - least + 1):
        if answer[i : i + least] in grams:
            end = i + least
        elif i >= end:
            spare -= 1
            if spare < 0:
                return False
    return spare >= len(answer) - max(end, len(answer) - least + 1)


def longest_common(a: list[tuple[int, str]], q: list[tuple[int, str]], least: int) -> tuple[int, int, int] | None:
    """Length and places of the longest string in both lists of segments (offset, text), the leftmost in ``a``, then in
    ``q``, by bisection over the length; None if it is shorter than ``least``."""

    def common(n: int) -> tuple[int, int] | None:
        seen: dict[str, int] = {}
        for at, t in q:
            for j in range(len(t) - n + 1):
                seen.setdefault(t[j : j + n], at + j)
        for at, t in a:
            for i in range(len(t) - n + 1):
                if (j := seen.get(t[i : i + n])) is not None:
                    return at + i, j
        return None

    low, high = least - 1, max((len(t) for _, t in a), default=0)
    found = None
    while low < high:
        n = (low + high + 1) // 2
        if got := common(n):
            low, found = n, (n, *got)
        else:
            high = n - 1
    return found


def segments(text: str, marked: bytearray) -> list[tuple[int, str]]:
    """The stretches of ``text`` that aren't marked, with their offsets."""
    return [(m.start(), text[m.start() : m.end()]) for m in re.finditer(rb"\0+", marked)]


def diagonals(answer: str, question: str, least: int, most: int) -> list[tuple[int, int, int]] | None:
    """The maximal matches of at least ``least`` characters: length, place in ``answer``, place in ``question``; None if
    there are more than ``most`` matches of ``least`` characters."""
    places: dict[str, list[int]] = {}
    for j in range(len(question) - least + 1):
        places.setdefault(question[j : j + least], []).append(j)
    runs: dict[int, list[int]] = {}  # the open run of each diagonal: its first and last place in the answer
    out: list[tuple[int, int, int]] = []
    for i in range(len(answer) - least + 1):
        for j in places.get(answer[i : i + least], ()):
            most -= 1
            run = runs.get(i - j)
            if run and run[1] == i - 1:
                run[1] = i
            else:
                if run:
                    out.append((run[1] - run[0] + least, run[0], run[0] - i + j))
                runs[i - j] = [i, i]
        if most < 0:
            return None
    return out + [(run[1] - run[0] + least, run[0], run[0] - d) for d, run in runs.items()]


def tiled(answer: str, question: str, least: int, most: int = 1_000_000) -> tuple[int, bytearray]:
    """Greedy string tiling: how many characters of ``answer`` are covered by tiles, and which.

    A tile is the longest common string of what is not yet marked on either side, the leftmost in the answer, then in the
    question; it is marked on both sides. Tiles have at least ``least`` characters. Strings with more than ``most``
    matches of that length, as only long repetitions have, are searched tile by tile instead of keeping all matches;
    the tiles are the same.
    """
    a, q = bytearray(len(answer)), bytearray(len(question))
    matches = diagonals(answer, question, least, most)
    if matches is None:
        while tile := longest_common(segments(answer, a), segments(question, q), least):
            n, i, j = tile
            a[i : i + n] = q[j : j + n] = b"\1" * n
        return sum(a), a
    heap = [(-n, i, j) for n, i, j in matches]
    heapify(heap)
    while heap:
        n, i, j = heappop(heap)
        n = -n
        taken = bytes(x | y for x, y in zip(a[i : i + n], q[j : j + n], strict=True))
        if 1 not in taken:
            a[i : i + n] = q[j : j + n] = b"\1" * n
            continue
        for m in re.finditer(rb"\0+", taken):  # what earlier tiles have left of the match
            if m.end() - m.start() >= least:
                heappush(heap, (m.start() - m.end(), i + m.start(), j + m.start()))
    return sum(a), a


def copied(answer: str, question: str, least: int) -> int:
    """How many characters of ``answer`` are tiles of ``question``; where they are most of the question, it may be
    repeated in what is left of the answer."""
    covered, marked = tiled(answer, question, least)
    total = covered
    while covered >= 0.6 * len(question) and (rest := segments(answer, marked)):
        answer = "\n".join(t for _, t in rest)  # a line end keeps apart what wasn't together
        covered, marked = tiled(answer, question, least)
        total += covered
    return total


def copies_question(answer: str, question: str) -> bool:
    """Whether the question makes up the answer but for stock phrases and slips."""
    a, q = bare(FRAMES.sub("", FRAMES.sub("", answer.strip()))), bare(question)
    if not a or not q:
        return False
    least = 5 if han_count(a) * 3 > len(a) else 10
    if min(len(a), len(q)) < 2 * least:
        return a == q

    needed = min(0.75 * len(a), max(0.6 * len(a), len(a) - 40))
    return coverable(a, q, least, needed) and copied(a, q, least) >= needed


def language(text: str) -> str | None:
    """``zh``, ``en``, ``de``, ``fr`` or ``es`` without code and formulas; None where there is too little to tell."""
    text = CODE.sub(" ", text)
    han = han_count(text)
    words = re.findall(r"[^\W\d_]+", text.lower())
    latin = sum(map(len, words)) - han
    if han >= 8 and han * 4 >= latin:
        return "zh"
    if han * 4 >= latin or len(words) < 5:
        return None
    told = [w for w in words if w in ANY_FUNCTION_WORD]
    votes = {k: sum(w in own for w in told) for k, own in FUNCTION_WORDS.items()}
    best = max(votes, key=lambda k: (votes[k], k))
    second = max(v for k, v in votes.items() if k != best)
    return best if votes[best] >= 3 and votes[best] > 1.3 * second else None


class Pushdown:
    """A pushdown parser of an answer: what is open at its end.

    Fences, displayed formulas, environments and elements of markup reach over lines and paragraphs (``outer``);
    brackets, quotations and emphasis over the lines of a paragraph, a heading or a list item (``inner``); a line break
    after an end mark ends a paragraph, too. Code spans and
    inline formulas are skipped if they are closed, and are plain characters otherwise. ``items`` holds the open list:
    its last number (None for bullets) and whether all of its items so far are fragments without an end mark.
    """

    def __init__(self, text: str) -> None:
        self.fence = ""
        self.outer: list[str] = []
        self.inner: list[str] = []
        self.number: int | None = None
        self.bullet = False
        self.fragments = 0
        block: list[str] = []
        lines = text.splitlines()
        for k, line in enumerate(lines):
            if m := FENCE.match(line):
                if not self.fence:
                    self.fence = m[1]
                elif m[1][0] == self.fence[0] and len(m[1]) >= len(self.fence):
                    self.fence = ""
                self.inline(block)
                block, self.inner = [], []
            elif self.fence:
                continue
            else:
                item = ITEM.match(line)
                if not line.strip() or item or line.lstrip().startswith(("#", "|", ">", "**")) or (block and ends_marked(block[-1])):
                    self.inline(block)
                    block, self.inner = [], []
                if k < len(lines) - 1 and line.strip():
                    self.listed(line, item)
                block.append(line)
        self.inline(block)

    def listed(self, line: str, item: re.Match[str] | None) -> None:
        """Goes on with the open list or leaves it; text below an item belongs to it."""
        if item:
            self.number = int(n) if (n := item[1] or item[2]) else None
            self.bullet = bool(item[3])
            self.fragments = self.fragments + 1 if self.fragments >= 0 and not ends_marked(line) else -1
        else:
            self.fragments = 0

    def inline(self, block: list[str]) -> None:
        text = "\n".join(block)
        skip = 0
        for m in INLINE.finditer(text):
            if m.start() < skip:
                continue
            c = m[0]
            if c[0] == "`" or c == "$":
                end = text.find(c, m.end())
                if end >= 0:
                    skip = end + len(c)
            elif c == "$$" or m[1]:
                self.toggle(self.outer, c if c == "$$" else m[2], m[1] != "end", c == "$$")
            elif m[4]:
                if m[4].lower() in ELEMENTS and not c.endswith("/>"):
                    self.toggle(self.outer, f"<{m[4].lower()}>", not m[3])
            elif c in ("\\(", "\\[", "\\)", "\\]"):
                self.toggle(self.outer, "\\(" if c[1] in "()" else "\\[", c[1] in "([")
            elif c == "**":
                self.toggle(self.inner, c, both=True)
            elif c == '"':
                before = text[m.start() - 1 : m.start()]
                after = text[m.end() : m.end() + 1]
                opens = c not in self.inner and (not before or before.isspace() or before in OPENERS or before in "：:，,—-") and bool(after.strip())
                if opens or c in self.inner:
                    self.toggle(self.inner, c, both=True)
            elif c in OPENERS:
                self.inner.append(c)
            elif c in CLOSERS:
                # half-open intervals close one kind of bracket with the other
                if c in ")]" and self.inner and self.inner[-1] in "([":
                    self.inner.pop()
                else:
                    self.toggle(self.inner, CLOSERS[c], False)

    @staticmethod
    def toggle(stack: list[str], what: str, opens: bool = True, both: bool = False) -> None:
        """Pushes what opens; what closes takes along what was left open inside, and is plain text if nothing opened it."""
        if what in stack and (both or not opens):
            del stack[len(stack) - 1 - stack[::-1].index(what) :]
        elif opens:
            stack.append(what)

    def breaks_off(self) -> bool:
        """Whether anything is open at the end."""
        return bool(self.fence or self.outer or self.inner)

    def goes_on(self, last: str, before: str) -> bool:
        """Whether the line ``last`` is the bare mark of the next item of the open list, or of a list just announced."""
        item = ITEM.fullmatch(last)
        if not item or item[4].strip():
            return False
        announced = before.rstrip().endswith((":", "："))
        if n := item[1] or item[2]:
            return int(n) == (self.number or 0) + 1 and (self.number is not None or announced)
        return self.bullet or announced

    def fragment(self, last: str) -> bool:
        """Whether the line ``last`` is an item of a list of which no item has an end mark."""
        return self.fragments > 0 and bool(ITEM.match(last))


def ends_marked(line: str) -> bool:
    """Whether the line ends with an end mark, perhaps within closing brackets and quotations or before a citation."""
    line = line.strip()
    marked = CITATION.sub("", line)
    if marked != line and (not marked or marked[-1] in END_MARKS or marked[-1] in CLOSERS):
        return True
    core = marked.rstrip("”’\"'」』）)】]》*_`~ ")
    return bool(core) and core[-1] in END_MARKS


def is_phrase(text: str) -> bool:
    """Whether the text is a single line of a few words that isn't built as a sentence: no end mark is due."""
    han = han_count(text)
    return "\n" not in text and han <= PHRASE_HAN and len(re.findall(r"[^\W_]+", text)) - bool(han) <= PHRASE_WORDS and text[-1] not in ",，、:：;；-—=+(（"


def is_truncated(answer: str) -> bool:
    """Whether the answer breaks off: something is open at its end, or its last line has neither an end mark nor is it
    a closed fence, a display, a whole formula, a row of a table, or an item of a list without end marks."""
    text = answer.rstrip()
    state = Pushdown(text)
    if state.breaks_off():
        return True
    lines = text.splitlines()
    last = lines[-1].strip()
    if state.goes_on(last, next((x for x in reversed(lines[:-1]) if x.strip()), "")):
        return True
    if FENCE.match(last) or last.endswith(("$$", "\\]", "\\)")) or re.search(r"\\end\{[^}]*\}$", last) or ends_marked(last):
        return False
    words = WORD.findall(last)
    if FORMULA.match(last) and len(words) <= 2 and last[-1] not in "=+-*/<>≤≥^_,，(（\\" and bool(re.search(r"[=≤≥<>≈∈⊆→]\s*\S", last)):
        # a formula; of one cut between words nothing is left to see but a trailing name without its bracket
        return False
    return not (last.startswith("|") and last.endswith("|")) and not state.fragment(last) and not is_phrase(text.strip())


def judged(question: str | None, answer: str | None) -> tuple[str | None, list[str] | None]:
    """The defect of one item, or None; items with a null or blank question have none.

    With titles, the item is ``empty`` instead if all of them are headings.
    """
    if question is None or not question.strip():
        return None, None
    empty = is_empty(answer)
    if empty is True:
        return "empty", None
    titles = empty or None
    if is_refusal(answer):
        return "refusal", titles
    if copies_question(answer, question):
        return "copies_question", titles
    asked, given = language(question), language(answer)
    if asked and given and asked != given:
        return "other_language", titles
    return "truncated" if is_truncated(answer) else None, titles


def defective_pairs(df: DataFrame, key: str = "qa_id", question: str = "question", answer: str = "answer", heading_share: float = 0.5) -> DataFrame:
    """``key, defect`` of every defective item, by one pass over the texts.

    Items with a null or blank question and null keys take no part. A row delivered again counts once; a key with
    several texts has each of their defects once. Columns other than the three are not read.

    Answers that consist of numbered or highlighted lines alone are ``empty`` if all these lines are headings: if at
    least ``heading_share`` of the lines with the same letters, in all answers, and two at least, have text below them.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            found = [judged(q, a) for q, a in pairs]
            counts: dict[str, list[int]] = {}
            for _, a in pairs:
                for title, text in titles_in(a or ""):
                    n = counts.setdefault(title, [0, 0])
                    n[text] += 1
            kinds = pa.array([k for k, _ in found], pa.string())
            titles = pa.array([t for _, t in found], pa.list_(pa.string()))
            keep = pc.or_(kinds.is_valid(), titles.is_valid())
            m = len(counts)
            keys = pa.concat_arrays([batch.column(0).filter(keep), pa.nulls(m, batch.column(0).type)])
            rows = len(keys) - m
            yield pa.RecordBatch.from_arrays(
                [
                    keys, pa.concat_arrays([kinds.filter(keep), pa.nulls(m, pa.string())]), pa.concat_arrays([titles.filter(keep), pa.nulls(m, titles.type)]),
                    pa.array([None] * rows + list(counts), pa.string()), pa.array([None] * rows + [n[0] for n in counts.values()], pa.int64()), pa.array([None] * rows + [n[1] for n in counts.values()], pa.int64()),
                ],
                names=[key, "defect", "titles", "title", "bare", "headed"],
            )

    rows = df.select(key, F.col(question), F.col(answer)).where(F.col(key).isNotNull())
    read = cut_lineage(rows.mapInArrow(run, f"`{key}` {kind}, defect string, titles array<string>, title string, bare bigint, headed bigint"))
    sure = read.where(F.col(key).isNotNull() & F.col("titles").isNull()).select(key, "defect")
    asked = read.where("titles is not null").select(key, "defect", "titles").distinct()
    counted = read.where("title is not null").groupBy("title").agg(F.sum("bare").alias("bare"), F.sum("headed").alias("headed"))
    heading = counted.where((F.col("headed") >= 2) & (F.col("headed") >= heading_share * (F.col("headed") + F.col("bare")))).select("title", F.lit(True).alias("is_heading"))
    each = asked.withColumn("title", F.explode(F.array_distinct("titles"))).join(heading, "title", "left")
    decided = each.groupBy(key, "defect", "titles").agg(F.every(F.coalesce("is_heading", F.lit(False))).alias("empty"))
    rest = decided.select(key, F.when(F.col("empty"), "empty").otherwise(F.col("defect")).alias("defect")).where("defect is not null")
    return sure.unionByName(rest).distinct()
