"""Line labels of scanned text by a hidden Markov model over layout features.

States: ``body``, ``header``, ``page`` (a break between pages: a lone page number) and ``data`` (sample input, code).
A line is observed through four discrete features: the shape of a page number, likeness to a title of the book, the
typography of running headers, and whether it interrupts a sentence. Start, transition and emission tables begin
with weak beliefs and are re-estimated on a bounded sample of chunks by Viterbi training.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from typing import NamedTuple

STATES = ("body", "header", "page", "data")
BODY, HEADER, PAGE, DATA = range(4)

ROMAN = r"(?=[ivxlc])(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
DRESSED = re.compile(
    rf"[-–—~·•*|]+\s*(?:\d{{1,5}}|{ROMAN})\s*[-–—~·•*|]+|[\[(（【〔<《]\s*(?:\d{{1,5}}|{ROMAN})\s*[\])）】〕>》]"
    rf"|(?:p\.?|pp\.?|page|seite|pág\.?|página)\s*(?:\d{{1,5}}|{ROMAN})(?:\s*(?:of|/|von|de)\s*\d{{1,5}})?|\d{{1,5}}\s*/\s*\d{{1,5}}"
    rf"|第\s*[\d一二三四五六七八九十百零〇]+\s*页(?:\s*[/,，]?\s*共\s*\d+\s*页)?|{ROMAN}",
    re.IGNORECASE,
)
BARE = re.compile(r"\d{1,5}")
CHAPTER = re.compile(r"^\s*(?:(?:chapter|section|part)\s+(?:\d+|[ivxlc]+\b)(?:\.\d+)*\s*[.:—-]?|第\s*[\d一二三四五六七八九十百]+\s*[章节部篇]\s*[:：.]?|§?\s*\d+(?:\.\d+)+\s)\s*", re.IGNORECASE)
NUMBER_ASIDE = re.compile(r"^\s*\d{1,5}(?:\s{2,}|\s*[|·•—]\s*)\S|\S(?:\s{2,}|\s*[|·•—]\s*)\d{1,5}\s*$")
SPACED = re.compile(r"^(?:\S\s+){4,}\S$")
END = tuple("。.!！?？:：;；…")
CJK = re.compile(r"[一-鿿]")
LATIN = r"A-Za-zÀ-ɏﬀ-ﬆ"
FIVE_CJK = re.compile(r"(?:[^一-鿿]*+[一-鿿]){5}", re.DOTALL)
THREE_WORDS = re.compile(rf"(?:(?:[^{LATIN}]|(?<![{LATIN}])[{LATIN}](?![{LATIN}]))*+[{LATIN}]{{2,}}+){{3}}", re.DOTALL)
NO_LETTER = re.compile(r"[\W\d_]+")
LETTER = re.compile(rf"[{LATIN}一-鿿]")
CAPITAL = re.compile(r"[A-Z]")
PART = re.compile(r"\s*[(（]\s*part\s*\d+\s*[)）]\s*$", re.IGNORECASE)


class Features(NamedTuple):
    """``page``: 0 no number, 1 a bare one, 2 a dressed one; the others 0 or 1 (``flow``: 0 to 2)."""

    page: int
    title: int
    typography: int
    flow: int


@lru_cache(1 << 14)
def letters(text: str) -> str:
    """Only the letters, in lower case."""
    out = NO_LETTER.sub("", text.lower())
    return out if not out or out.isalpha() else "".join(filter(str.isalpha, out))


@lru_cache(1 << 12)
def title_forms(name: str) -> tuple[str, ...]:
    """The letters of a title, with and without its chapter number."""
    return tuple(k for k in (letters(name), letters(CHAPTER.sub("", name))) if len(k) >= 2)


def known_titles(metadata: dict[str, str] | None, path: list[str] | None, title: str | None) -> set[str]:
    """Book title, chapter, section and chunk title, reduced to letters."""
    names = [(metadata or {}).get("title"), *(path or []), PART.sub("", title or "")]
    return {k for n in names if n for k in title_forms(n)}


def is_prose(line: str) -> bool:
    """Whether the line holds running text: some Chinese characters or some words, and no code."""
    text = line.strip()
    return not text.endswith((";", "{", "}")) and " = " not in text[:24] and bool(FIVE_CJK.match(text) or THREE_WORDS.match(text))


def lines_of(text: str) -> list[tuple[int, str]]:
    """Number and text of the lines that are neither blank nor fenced code."""
    out, fenced = [], False
    for i, line in enumerate(text.split("\n")):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        elif not fenced and line.strip():
            out.append((i, line))
    return out


def is_scanned(lines: list[tuple[int, str]]) -> bool:
    """Whether the text is wrapped at a width: at least half of its prose lines but the last end inside a sentence."""
    prose = [line.rstrip() for _, line in lines if is_prose(line)]
    if len(lines) < 2 or not prose:
        return False
    if lines[-1][1].rstrip() == prose[-1]:
        prose = prose[:-1]
    broken = sum(not p.endswith(END) for p in prose)
    return broken >= 1 and 2 * broken >= len(prose)


def observe(lines: list[tuple[int, str]], titles: set[str]) -> list[Features]:
    """The features of each line. ``flow`` is 2 where a short line without an end mark parts a sentence, 1 where it
    comes first or last or after a sentence's end, 0 for anything else."""
    widths = sorted(len(t.strip()) for _, t in lines)
    width = widths[len(widths) // 2]
    out = []
    for k, (_, line) in enumerate(lines):
        text = line.strip()
        page = 2 if DRESSED.fullmatch(text) else 1 if BARE.fullmatch(text) else 0
        rest = CHAPTER.sub("", text)
        title = int(bool({letters(text), letters(rest)} & titles))
        capital = text.upper() == text and len(CAPITAL.findall(text)) >= 4
        typography = int(bool(capital or SPACED.match(text) or NUMBER_ASIDE.search(text) or (rest != text and len(text) < 0.8 * width)))
        before = next((lines[j][1].rstrip() for j in range(k - 1, -1, -1) if is_prose(lines[j][1])), None)
        short = len(text) < 0.8 * width and not text.endswith(END[:6] + END[8:])
        parted = before is not None and not before.endswith(END)
        edge = k in (0, len(lines) - 1) or not parted
        flow = 0 if not short else 1 if edge else 2
        out.append(Features(page, title, typography, flow))
    return out


class Model(NamedTuple):
    """Log-probabilities: start[s], step[s][t], and emit[feature][s][value]."""

    start: list[float]
    step: list[list[float]]
    emit: list[list[list[float]]]


SIZES = (3, 2, 2, 3)

# Weak beliefs to start from, each worth ``BELIEF`` observations; training moves them to the corpus.
BELIEF = 50.0
START = [0.93, 0.03, 0.03, 0.01]
STEP = [[0.86, 0.06, 0.06, 0.02], [0.96, 0.01, 0.02, 0.01], [0.96, 0.02, 0.01, 0.01], [0.2, 0.01, 0.01, 0.78]]
EMIT = [
    [[0.998, 0.001, 0.001], [0.99, 0.005, 0.005], [0.02, 0.38, 0.6], [0.6, 0.395, 0.005]],
    [[0.999, 0.001], [0.15, 0.85], [0.998, 0.002], [0.99, 0.01]],
    [[0.995, 0.005], [0.4, 0.6], [0.9, 0.1], [0.95, 0.05]],
    [[0.97, 0.02, 0.01], [0.06, 0.24, 0.7], [0.02, 0.28, 0.7], [0.3, 0.5, 0.2]],
]


def as_model(start: list[float], step: list[list[float]], emit: list[list[list[float]]]) -> Model:
    def logs(row: list[float]) -> list[float]:
        return [math.log(x / sum(row)) for x in row]

    return Model(logs(start), [logs(r) for r in step], [[logs(r) for r in f] for f in emit])


FIRST = as_model(START, STEP, EMIT)


def label(lines: list[tuple[int, str]], seen: list[Features], model: Model) -> list[int]:
    """The most probable states (Viterbi). Lines of numbers below a line that announces them are data."""
    states = range(len(STATES))
    score: list[float] = []
    back: list[list[int]] = []
    announced = False
    for k, f in enumerate(seen):
        emit = [sum(model.emit[i][s][v] for i, v in enumerate(f)) for s in states]
        text = lines[k][1].strip()
        before = lines[k - 1][1].rstrip() if k else ""
        numeric = not LETTER.search(text)
        announced = numeric and (before.endswith((":", "：")) or announced)
        if announced:  # sample input and output, whatever they look like
            emit = [e if s == DATA else e - 20 for s, e in enumerate(emit)]
        if k == 0:
            score = [model.start[s] + emit[s] for s in states]
            continue
        best = [max(states, key=lambda r, t=t: score[r] + model.step[r][t]) for t in states]
        score = [score[best[t]] + model.step[best[t]][t] + emit[t] for t in states]
        back.append(best)
    path = [max(states, key=lambda s: score[s])]
    for best in reversed(back):
        path.append(best[path[-1]])
    return path[::-1]


def train(chunks: list[tuple[list[tuple[int, str]], list[Features]]], rounds: int = 3) -> Model:
    """Viterbi training: label, count with the starting beliefs as prior, and again."""
    model = FIRST
    for _ in range(rounds):
        start = [BELIEF * x for x in START]
        step = [[BELIEF * x for x in r] for r in STEP]
        emit = [[[BELIEF * x for x in r] for r in f] for f in EMIT]
        for lines, seen in chunks:
            path = label(lines, seen, model)
            start[path[0]] += 1
            for r, t in zip(path, path[1:], strict=False):
                step[r][t] += 1
            for s, f in zip(path, seen, strict=True):
                for i, v in enumerate(f):
                    emit[i][s][v] += 1
        model = as_model(start, step, emit)
    return model
