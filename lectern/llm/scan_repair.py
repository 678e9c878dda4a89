"""Repair of text from scanned pages: running headers, page numbers, broken words, misread characters.

One pass labels the lines of each chunk (``scan_lines``) and gathers counts of words and of character contexts from
all chunks; what may be wrong becomes questions to those counts, answered by joins. A broken word is joined or kept
with its hyphen by what the corpus has; a word or character that appears only in scans is misread if undoing one of
the known confusions gives what clean text has in its place.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut_lineage
from lectern.llm.scan_lines import BODY, CHAPTER, CJK, FIRST, HEADER, LATIN, PAGE, Model, is_scanned, known_titles, label, letters, lines_of, observe, train

# What optical recognition makes of letters (correct, misread) and of Chinese characters.
CONFUSED = [
    ("e", "c"), ("s", "5"), ("i", "j"), ("t", "f"), ("o", "0"), ("l", "I"), ("l", "1"), ("m", "rn"), ("u", "ii"), ("g", "q"), ("h", "b"), ("w", "vv"), ("B", "8"), ("S", "5"), ("O", "0"), ("I", "1"), ("I", "l"),
    ("E", "C"), ("T", "F"), ("G", "Q"), ("H", "B"), ("D", "Cl"), ("U", "Ii"), ("d", "cl"), ("cl", "d"), ("rn", "m"), ("nn", "im"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("ff", "ﬀ"), ("ffi", "ﬃ"), ("ffl", "ﬄ")]
CONFUSED_HAN = [
    ("入", "人"), ("元", "兀"), ("顶", "项"), ("点", "占"), ("价", "阶"), ("复", "夏"), ("队", "阠"), ("归", "旧"), ("已", "巳"), ("已", "己"), ("组", "纽"), ("阵", "陈"), ("度", "庋"), ("时", "吋"), ("比", "此"),
    ("数", "敎"), ("边", "辺"), ("查", "査"), ("算", "箅"), ("径", "经"), ("平", "乎"), ("序", "庌"), ("子", "孑"), ("运", "远"), ("果", "杲"), ("未", "末"), ("明", "朋"), ("合", "台"), ("权", "杈"), ("针", "钍"),
    ("人", "入"), ("项", "顶"), ("末", "未"), ("大", "太"), ("太", "大"), ("日", "曰"), ("目", "日"), ("间", "问"), ("问", "间"), ("土", "士"), ("千", "干"), ("干", "千"), ("天", "夭"), ("体", "休"), ("令", "今"), ("今", "令"), ("名", "各"), ("各", "名"),
]
LIGATURES = {bad: good for good, bad in CONFUSED if "ﬀ" <= bad <= "ﬆ"}
HYPHENS = "-‐­¬"

TOKEN = re.compile(rf"[{LATIN}0-9]+(?:[-'’][{LATIN}0-9]+)*")
SEGMENT = re.compile(rf"[{LATIN}0-9]+")
LEFT = re.compile(rf"([{LATIN}0-9]+(?:[-'’][{LATIN}0-9]+)*)[{HYPHENS}]\s*$")
RIGHT = re.compile(rf"\s*([{LATIN}0-9]+(?:[-'’][{LATIN}0-9]+)*)")
WRONG_HAN: dict[str, list[str]] = {}
for _good, _bad in CONFUSED_HAN:
    WRONG_HAN.setdefault(_bad, []).append(_good)
SEEN = re.compile("[" + "".join(sorted({c for pair in CONFUSED_HAN for c in pair})) + "]")
WRONG = re.compile("[" + "".join(WRONG_HAN) + "]")
LETTERED = re.compile(rf"[0-9]*[{LATIN}][{LATIN}0-9]*")
LATIN_LETTER = re.compile(rf"[{LATIN}]")
DIGIT = re.compile(r"\d")
ODD = re.compile("[0-9ﬀ-ﬆ]")


def capitals(word: str) -> int:
    """How many letters after the first are upper case."""
    return sum(map(str.isupper, word[1:]))


def undone(word: str, learned: Iterable[tuple[str, str]] = (), places: int = 1) -> list[str]:
    """The word with one confusion undone at one place, in every way; or at up to ``places`` places."""
    out: dict[str, None] = {}
    last = [word]
    for _ in range(places):
        found: dict[str, None] = {}
        for w in last:
            for good, bad in (*CONFUSED, *learned):
                at = w.find(bad)
                while at >= 0:
                    found[w[:at] + good + w[at + len(bad) :]] = None
                    at = w.find(bad, at + 1)
        # capitals inside a word must have been there
        last = [w for w in found if w not in out and w != word and (w.isupper() or capitals(w) <= capitals(word))]
        out |= dict.fromkeys(last)
    whole = "".join(LIGATURES.get(c, c) for c in word)
    if whole != word:
        return [whole, *(v for v in out if v != whole)]
    return list(out)


class Shapes:
    """What is around the characters of a text: two before one, one on each side, two behind; digits count as one another."""

    def __init__(self, text: str) -> None:
        self.text = f"^^{DIGIT.sub('0', text)}$$"

    def around(self, i: int) -> tuple[str, str, str]:
        t = self.text
        return "l" + t[i : i + 2], "m" + t[i + 1] + t[i + 3], "r" + t[i + 3 : i + 5]


class ScanReader:
    """Counts and questions of one batch of chunks."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.words: dict[bool, Counter[str]] = {False: Counter(), True: Counter()}
        self.clean: Counter[str] = Counter()
        self.rows: list[tuple[int, int, int, str, str, str, str]] = []

    def counts(self) -> Iterator[tuple[str, str, int]]:
        """``sort, item, number``."""
        for scanned, words in self.words.items():
            yield from (("scan" if scanned else "clean", "w" + w, n) for w, n in words.items())
        yield from (("clean", item, n) for item, n in self.clean.items())

    def count(self, text: str, scanned: bool) -> None:
        self.words[scanned].update(map(str.lower, LETTERED.findall(text)))
        if not scanned and (some := SEEN.search(text)):
            shapes = Shapes(text)
            for m in SEEN.finditer(text, some.start()):
                self.clean.update(("u" + m[0], *(k + m[0] for k in shapes.around(m.start()))))

    def chunk(self, key: int, content: str, metadata: dict[str, str] | None, path: list[str] | None, title: str | None) -> None:
        lines = lines_of(content)
        self.clean.update("t" + name for name in known_titles(metadata, path, None))
        if not is_scanned(lines):
            self.count(content, False)
            return
        titles = known_titles(metadata, path, title)
        seen = observe(lines, titles)
        body: list[tuple[int, str]] = []
        for (i, line), f, state in zip(lines, seen, label(lines, seen, self.model), strict=True):
            if state == BODY:
                body.append((i, line))
                if f.flow and len(name := letters(CHAPTER.sub("", line.strip()))) >= 4:  # perhaps a title known elsewhere
                    self.rows.append((key, i, 0, "title", line.strip(), name, ""))
            elif state in (HEADER, PAGE):
                self.rows.append((key, i, 0, "header" if state == HEADER else "page_number", line.strip(), "", ""))
        cut = [line for _, line in body]
        for k in range(len(body) - 1):
            left, right = LEFT.search(cut[k]), RIGHT.match(body[k + 1][1])
            if left and right and LATIN_LETTER.search(left[1]) and LATIN_LETTER.search(right[1]):
                self.rows.append((key, body[k][0], 0, "hyphen", "", left[1], right[1]))
                # neither part is a word; blanks keep the columns
                cut[k] = cut[k][: left.start()]
                cut[k + 1] = " " * right.end() + body[k + 1][1][right.end() :]
        text, places = "", []
        for k, (i, _) in enumerate(body):
            line = cut[k].strip()
            indent = cut[k].find(line) if line else 0
            for m in TOKEN.finditer(line):
                token = m[0]
                for s in SEGMENT.findall(token) if "-" in token or "'" in token or "’" in token else (token,):
                    if len(s) >= 3 and not s.isdigit():
                        self.rows.append((key, i, indent + m.start(), "word", token, s, ""))
            self.count(line, True)
            places += [(i, indent + m.start(), len(text) + m.start()) for m in WRONG.finditer(line)]
            text += line
        if places:
            shapes = Shapes(text)
            for i, col, at in places:
                self.rows.append((key, i, col, "han", text[at], "\n".join(shapes.around(at)), ""))


READ = "id bigint, line int, col int, kind string, piece string, left string, right string, n bigint"


def read_chunks(chunks: DataFrame, model: Model) -> DataFrame:
    """Rows of three sorts: found lines (``header``, ``page_number``), questions (``hyphen``, ``word``, ``han``, ``title``) and
    counts (``clean``, ``scan``: the item is ``piece``, its number ``n``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in READ.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            reader = ScanReader(model)
            for key, content, metadata, path, title in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader.chunk(key, content, dict(metadata) if metadata else None, path, title)
            rows = [(*r, None) for r in reader.rows]
            rows += [(None, None, None, sort, item, None, None, n) for sort, item, n in reader.counts()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return chunks.select("id", "content", "metadata", "path", "title").mapInArrow(run, READ)


def fitted_model(chunks: DataFrame, sample_rows: int) -> Model:
    """The line model, trained on about ``sample_rows`` chunks picked by the hash of their key, at most twice as many."""
    several = chunks.where(F.instr("content", "\n") > 0)
    share = min(1.0, sample_rows / max(1, several.count()))
    # a share of the keys by hash and a limit: neither a task nor the driver gets more than the sample
    picked = several.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).limit(2 * sample_rows).collect()
    seen = []
    for r in picked:
        lines = lines_of(r["content"])
        if is_scanned(lines):
            seen.append((lines, observe(lines, known_titles(r["metadata"], r["path"], r["title"]))))
    return train(seen) if seen else FIRST


def learned_confusions(clean: DataFrame, scan: DataFrame, support: int = 5, surplus: int = 3) -> list[tuple[str, str]]:
    """``good, bad``: what recognition makes of a letter or two, learned from the words of the whole corpus.

    A word that only scans have is held against the words of clean text that differ from it in one place, by one letter
    there or one for two, and are 20 times as frequent. Of several such substitutions a word shows the one that most
    words have. It is a confusion if at least ``support`` different words of scans show it, and ``surplus`` times as many
    as rare words of clean text, which differ from frequent ones by chance. Only words of 4 to 40 letters teach. At most the pairs of letters come to the
    driver, not words.
    """
    clean = clean.where(F.col("item").startswith("w")).select(F.expr("substr(item, 2)").alias("w"), "n")
    scan = scan.where(F.col("item").startswith("w")).select(F.expr("substr(item, 2)").alias("w"), "n")
    only = scan.join(clean, "w", "left_anti").withColumn("scan", F.lit(True))
    rare = clean.where("n <= 2").join(scan, "w", "left_anti").withColumn("scan", F.lit(False))
    frequent = clean.where("n >= 20").withColumn("scan", F.lit(False))
    schema = "hole string, part string, w string, n bigint, scan boolean"

    def holes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = zip(*(f.split() for f in schema.split(", ")), strict=True)
        for batch in batches:
            words = batch.column(0).to_pylist()
            out = [(f"{w[:i]}_{w[i + k :]}", w[i : i + k], row) for row, w in enumerate(words) for k in (1, 2) for i in range(len(w) - k + 1)]
            hole, part, row = zip(*out, strict=True) if out else ((), (), ())
            own = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(hole, pa.string()), pa.array(part, pa.string()), *own.columns], names=list(names))

    def holed(words: DataFrame) -> DataFrame:
        return words.where(F.char_length("w").between(4, 40)).select("w", "n", "scan").mapInArrow(holes, schema)

    good = holed(frequent).select("hole", F.col("part").alias("good"), F.col("n").alias("often"))
    bad = holed(only.unionByName(rare)).withColumnRenamed("part", "bad")
    fits = (F.col("often") >= 20 * F.col("n")) & ~F.col("good").contains(F.col("bad")) & ~F.col("bad").contains(F.col("good")) & (F.char_length("good") + F.char_length("bad") <= 3)
    shown = cut_lineage(bad.join(good, "hole").where(fits).select("scan", "w", "good", "bad").distinct())
    common = shown.groupBy("good", "bad").agg(F.count(F.when(F.col("scan"), 1)).alias("words"))
    taken = shown.join(common, ["good", "bad"]).groupBy("scan", "w").agg(F.max(F.struct("words", "good", "bad")).alias("best")).select("scan", "best.good", "best.bad")
    counted = taken.groupBy("good", "bad").agg(F.count(F.when(F.col("scan"), 1)).alias("scans"), F.count(F.when(~F.col("scan"), 1)).alias("rare"))
    found = counted.where((F.col("scans") >= support) & (F.col("scans") >= surplus * F.col("rare"))).select("good", "bad").collect()
    return sorted((r["good"], r["bad"]) for r in found if (r["good"], r["bad"]) not in CONFUSED)


def answered_words(rows: DataFrame, clean: DataFrame, scan: DataFrame, learned: list[tuple[str, str]]) -> DataFrame:
    """``id, line, col, kind, old, piece`` of the misread words: only scans have the word, clean text has another.

    One confusion is undone in a word, two in one that shows by a digit or ligature that it is misread.
    """
    words = rows.where("kind = 'word'")
    distinct = words.select(F.col("left").alias("w")).distinct().withColumn("item", F.concat(F.lit("w"), F.lower("w")))
    most = clean.where(F.col("item").startswith("w")).agg(F.max("n").alias("most"))
    own = distinct.join(clean.withColumnRenamed("n", "bad"), "item", "left").join(scan.withColumnRenamed("n", "scans"), "item", "left").fillna(0, ["bad", "scans"])
    odd, ligature = F.col("w").rlike("[0-9ﬀ-ﬆ]"), F.col("w").rlike("[ﬀ-ﬆ]")
    # no word can be frequent enough to be right instead of those that are left out here
    own = own.crossJoin(F.broadcast(most)).where(ligature | ((F.col("most") >= 200 * F.col("bad")) & (odd | (F.col("most") >= 3 * F.col("scans"))))).select("w", "bad", "scans")

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(w, b, n, v) for w, b, n in zip(*(c.to_pylist() for c in batch.columns), strict=True) for v in undone(w, learned, 2 if ODD.search(w) else 1)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["w", "bad", "scans", "v"])

    asked = own.mapInArrow(variants, "w string, bad bigint, scans bigint, v string")
    known = asked.withColumn("item", F.concat(F.lit("w"), F.lower("v"))).join(clean, "item", "left").fillna(0, ["n"]).withColumnRenamed("n", "good").drop("item")
    likely = (F.col("good") >= F.when(odd, 1).otherwise(3)) & (F.col("good") >= 200 * F.col("bad")) & (F.col("good") >= F.when(odd, 0).otherwise(3 * F.col("scans")))
    # a ligature is never right; without better knowledge it is written out
    sure = likely | (ligature & ~F.col("v").rlike("[ﬀ-ﬆ]"))
    best = known.where(sure).groupBy("w").agg(F.max_by("v", F.struct("good", "v")).alias("v"))
    found = words.join(best, words["left"] == best["w"])
    return found.select("id", "line", "col", F.lit("misread").alias("kind"), F.col("piece").alias("old"), F.replace("piece", "w", "v").alias("piece"))


def answered_breaks(rows: DataFrame, clean: DataFrame, learned: list[tuple[str, str]]) -> DataFrame:
    """``id, line, col, kind, old, piece`` of the broken words: as they must read."""
    breaks = rows.where("kind = 'hyphen'").select("left", "right").distinct()

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str, str, str, str]] = []
            for left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = SEGMENT.findall(left)[-1], SEGMENT.findall(right)[0]
                head, tail = left[: len(left) - len(a)], right[len(b) :]
                out.append((left, right, "joined", (a + b).lower(), head + a + b + tail))
                out.append((left, right, "first", a.lower(), f"{left}-{right}"))
                out.append((left, right, "second", b.lower(), f"{left}-{right}"))
                out += [(left, right, "variant", v.lower(), head + v + tail) for v in undone(a + b, learned)]
                out += [(left, right, "first variant", v.lower(), f"{head}{v}-{right}") for v in undone(a, learned)]
                out += [(left, right, "second variant", v.lower(), f"{left}-{v}{tail}") for v in undone(b, learned)]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in range(5)], names=["left", "right", "role", "word", "form"])

    asked = breaks.mapInArrow(forms, "left string, right string, role string, word string, form string")
    known = asked.withColumn("item", F.concat(F.lit("w"), "word")).join(clean, "item", "left").fillna(0, ["n"])

    def most(role: str) -> Column:
        return F.max(F.when(F.col("role") == role, F.col("n")))

    def form(role: str) -> Column:
        return F.max_by(F.when(F.col("role") == role, F.col("form")), F.when(F.col("role") == role, F.struct("n", "form")))

    per = known.groupBy("left", "right").agg(
        most("joined").alias("j"), most("first").alias("a"), most("second").alias("b"), most("variant").alias("v"), most("first variant").alias("av"), most("second variant").alias("bv"),
        form("joined").alias("joined"), form("first").alias("apart"), form("variant").alias("better"), form("first variant").alias("a_better"), form("second variant").alias("b_better"),
    ).fillna(0, ["v", "av", "bv"])
    piece = (
        F.when(F.col("j") >= 1, F.col("joined"))
        .when((F.col("a") >= 3) & (F.col("b") >= 3), F.col("apart"))
        .when(F.col("v") >= 3, F.col("better"))
        .when((F.col("av") >= 3) & (F.col("b") >= 3), F.col("a_better"))
        .when((F.col("a") >= 3) & (F.col("bv") >= 3), F.col("b_better"))
        .when((F.col("a") >= 1) & (F.col("b") >= 1), F.col("apart"))
        .otherwise(F.col("joined"))
    )
    sure = per.select("left", "right", piece.alias("fixed"))
    return rows.where("kind = 'hyphen'").join(sure, ["left", "right"]).select("id", "line", "col", "kind", F.concat_ws("\n", "left", "right").alias("old"), F.col("fixed").alias("piece"))


def answered_han(rows: DataFrame, clean: DataFrame) -> DataFrame:
    """``id, line, col, kind, old, piece`` of the misread Chinese characters."""
    pairs = F.create_map(*[x for bad, goods in WRONG_HAN.items() for x in (F.lit(bad), F.array(*map(F.lit, goods)))])
    asked = rows.where("kind = 'han'").select("id", "line", "col", F.col("piece").alias("old"), F.split("left", "\n").alias("c"), F.explode(F.element_at(pairs, F.col("piece"))).alias("good"))
    shapes = asked.select(F.explode("c").alias("shape"), "old", "good").distinct()
    items = shapes.select("shape", "old", "good", F.concat("shape", "old").alias("bad_item"), F.concat("shape", "good").alias("item"))
    counted = items.join(clean, "item", "left").withColumnRenamed("n", "n_good").drop("item")
    counted = counted.withColumnRenamed("bad_item", "item").join(clean, "item", "left").withColumnRenamed("n", "n_bad").fillna(0, ["n_good", "n_bad"]).drop("item")
    each = asked.withColumn("shape", F.explode("c")).drop("c").join(counted, ["shape", "old", "good"])
    summed = each.groupBy("id", "line", "col", "old", "good").agg(F.sum("n_good").alias("g"), F.sum("n_bad").alias("b"), F.sum((F.col("n_good") > 10 * F.col("n_bad")).cast("int")).alias("windows"))
    alone = clean.where(F.col("item").startswith("u")).select(F.substring("item", 2, 2).alias("old"), F.col("n").alias("own"))
    summed = summed.join(F.broadcast(alone), "old", "left").fillna(0, ["own"])
    sure = ((F.col("g") >= 3) & (F.col("g") >= 10 * F.col("b"))) | ((F.col("own") == 0) & (F.col("b") == 0))
    best = summed.where(sure).groupBy("id", "line", "col", "old").agg(F.max_by("good", F.struct("g", "good")).alias("piece"))
    return best.select("id", "line", "col", F.lit("misread").alias("kind"), "old", "piece")


def chunks_of(df: DataFrame, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """The columns that the repair reads, under its own names."""
    title = F.col("title").cast("string") if "title" in df.columns else F.lit(None).cast("string")
    path = F.col("path_titles") if "path_titles" in df.columns else F.lit(None).cast("array<string>")
    metadata = F.col("metadata") if "metadata" in df.columns else F.lit(None).cast("map<string,string>")
    out = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("content"), metadata.alias("metadata"), path.alias("path"), title.alias("title"))
    return out.where(F.col("id").isNotNull() & F.col("content").isNotNull())


def scan_noise(df: DataFrame, key: str = "chunk_id", text: str = "content", sample_rows: int = 5_000) -> DataFrame:
    """``key, line, col, kind, old, piece``: every found piece of noise with its place.

    Null keys and null contents take no part; blank and one-line contents have no noise that could be told. A row
    delivered again counts once; with ``title``, ``path_titles`` and ``metadata`` null or absent, headers are known
    by their looks alone. The line model is trained on at most ``2 * sample_rows`` chunks; words, contexts and all
    decisions cover every chunk.
    """
    chunks = chunks_of(df, key, text)
    rows = cut_lineage(read_chunks(chunks, fitted_model(chunks, sample_rows)))
    counts = rows.where("kind in ('clean', 'scan')").groupBy("kind", F.col("piece").alias("item")).agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts)
    clean, scan = counts.where("kind = 'clean'").select("item", "n"), counts.where("kind = 'scan'").select("item", "n")
    found = rows.where("kind in ('header', 'page_number')").select("id", "line", "col", "kind", F.col("piece").alias("old"), "piece")
    titles = rows.where("kind = 'title'").join(clean.where(F.col("item").startswith("t")).select(F.expr("substr(item, 2)").alias("left")), "left")
    found = found.unionByName(titles.select("id", "line", "col", F.lit("header").alias("kind"), F.col("piece").alias("old"), "piece"))
    learned = learned_confusions(clean, scan)
    every = found.unionByName(answered_breaks(rows, clean, learned)).unionByName(answered_words(rows, clean, scan, learned)).unionByName(answered_han(rows, clean))
    return every.distinct().withColumnRenamed("id", key)


def noise_pieces(noise: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``key, kind, piece``, each once."""
    return noise.select(key, "kind", "piece").distinct()


def reassemble(content: str, fixes: list[dict]) -> str:
    """The running text: headers and page numbers gone, words mended, the lines of a paragraph joined."""
    at: dict[int, list[dict]] = {}
    for f in fixes:
        at.setdefault(f["line"], []).append(f)
    lines: list[str] = []
    held: tuple[str, str] | None = None  # the line before a broken word, and the whole word
    scanned = is_scanned(lines_of(content))
    for i, line in enumerate(content.split("\n")):
        own = at.get(i, [])
        if any(f["kind"] in ("header", "page_number") for f in own):
            continue
        for f in sorted((f for f in own if f["kind"] == "misread"), key=lambda f: -f["col"]):
            if line.startswith(f["old"], f["col"]):
                line = line[: f["col"]] + f["piece"] + line[f["col"] + len(f["old"]) :]
        if held and line.strip():
            rest = RIGHT.match(line)
            line = held[0] + held[1] + (line[rest.end() :] if rest else line)
            held = None
        broken = next((f for f in own if f["kind"] == "hyphen"), None)
        if broken and (m := LEFT.search(line)):
            held = line[: m.start()], broken["piece"]
        else:
            lines.append(line)
    if held:
        lines.append(held[0] + held[1])
    if not scanned:
        return "\n".join(lines)
    out = ""
    for line in lines:
        text = line.strip()
        if not text:
            out = out.rstrip() + "\n\n" if out else ""
        elif not out or out.endswith("\n"):
            out += text
        else:
            out += ("" if CJK.match(out[-1]) or CJK.match(text[0]) or out[-1] in "，。；：、（）" else " ") + text
    return out.strip()


def repaired(df: DataFrame, noise: DataFrame, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """``key, repaired``: the running text of every distinct row; a null content stays null."""
    fixes = noise.groupBy(F.col(key).alias("k")).agg(F.sort_array(F.collect_list(F.struct("line", "col", "kind", "old", "piece"))).alias("fixes"))
    rows = df.select(F.col(key).cast("bigint").alias(key), F.col(text).alias("t")).where(F.col(key).isNotNull()).distinct()
    joined = rows.join(fixes, rows[key] == fixes["k"], "left").select(key, "t", "fixes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else reassemble(t, fixes or []) for t, fixes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "repaired"])

    return joined.mapInArrow(run, f"`{key}` bigint, repaired string")
