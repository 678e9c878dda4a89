"""From textbook markdown to chunks, exercises and questions: headings, paths, packing, extraction, cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import is_blank, strip

#: Title of the text before the first heading, and titles that don't start a chunk of their own.
INTRO_TITLE = "文档起始/前言/版权信息"
IGNORED_TITLES = ["计算机", "算法设计与分析", "(第3版)", "普通高等教育“十一五”国家级规划教材", "高等学校规划教材", "目录"]
#: Signs of a question in a chunk's path, its title, and at the start of one of its lines.
PATH_WORDS = ["练习", "习题", "问题", "算法题", "编程题", "实验题"]
TITLE_WORDS = ["题", "练习", "习题"]
QUESTION_IDS = [r"(练习|习题|问题)\s*\d+", r"第\s*\d+\s*题", r"\d+\.\d+-\d+", r"\d+\.\d+\.\d+\s*[（(]"]
FAILED = "答案生成失败"


def lines(docs: DataFrame) -> DataFrame:
    """``id, line_no, line`` of ``docs`` (id, text); a carriage return before a line feed belongs to it."""
    return docs.select("id", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))


def headings(docs: DataFrame) -> DataFrame:
    """``id, line_no, numbering, title, level0`` of the heading lines. ``level0`` is the level that the heading itself
    tells (1 for a chapter, else dots of the numbering plus 1), null without a numbering."""
    text = strip(F.col("line"))
    head = lines(docs).withColumn("t", text).where(F.col("t").rlike(r"(?U)^#{1,6}\s*\S"))
    head = head.withColumn("number", F.regexp_extract("t", r"(?U)^#{1,6}\s*([0-9]+(?:\.[0-9]+)*)?", 1)).withColumn("body", F.regexp_extract("t", r"(?U)^#{1,6}\s*(?:[0-9]+(?:\.[0-9]+)*)?\s*(.*)$", 1))
    chapter = F.regexp_extract("body", r"第(\d+)章", 1)
    numbering = F.when(chapter != "", chapter).when(F.col("number") != "", F.col("number"))
    title = F.regexp_replace("body", r"(?U)^[\s.。，：:、\-—·]+", "")
    dots = F.char_length("number") - F.char_length(F.replace("number", F.lit("."), F.lit("")))
    level = F.when(chapter != "", 1).when(F.col("number") != "", dots + 1)
    return head.select("id", "line_no", numbering.alias("numbering"), title.alias("title"), level.cast("int").alias("level0")).where(~F.col("title").isin(IGNORED_TITLES))


def heading_levels(docs: DataFrame) -> DataFrame:
    """``id, line_no, level, numbering, title``: a heading without a numbering is one below the one before it; the
    exercise rule of ``heading_paths`` holds here, too."""
    return heading_paths(docs).select("id", "line_no", "level", "numbering", "title")


def heading_paths(docs: DataFrame) -> DataFrame:
    """``id, line_no, level, numbering, title, path``: titles of the open headings, as a stack that pops every level
    not above the new one. A document's headings are folded in order; they are few even in a long text.

    The exercise rule holds: an unnumbered heading with 题 is one below the heading before it, a numbered one is one
    below the nearest open heading with 习题, if there is one.
    """
    record = F.struct("line_no", "numbering", "title", "level0")
    per = headings(docs).groupBy("id").agg(F.array_sort(F.collect_list(record)).alias("h"))
    start = F.struct(F.lit(0).alias("prev"), F.expr("cast(array() as array<struct<level:int,title:string>>)").alias("stack"), F.expr("cast(array() as array<struct<line_no:int,level:int,numbering:string,title:string,path:string>>)").alias("out"))

    def step(state: Column, h: Column) -> Column:
        below = F.filter(state["stack"], lambda x: x["title"].contains("习题"))
        exercise = F.when(h["title"].contains("题") & h["numbering"].isNotNull() & (F.size(below) > 0), F.element_at(below, -1)["level"] + 1)
        level = F.coalesce(exercise, h["level0"], state["prev"] + 1).cast("int")
        kept = F.filter(state["stack"], lambda x: x["level"] < level)
        stack = F.concat(kept, F.array(F.struct(level.alias("level"), h["title"].alias("title"))))
        path = F.array_join(F.transform(stack, lambda x: x["title"]), " > ")
        row = F.struct(h["line_no"].alias("line_no"), level.alias("level"), h["numbering"].alias("numbering"), h["title"].alias("title"), path.alias("path"))
        return F.struct(level.alias("prev"), stack.alias("stack"), F.concat(state["out"], F.array(row)).alias("out"))

    folded = per.select("id", F.explode(F.aggregate("h", start, step)["out"]).alias("x"))
    return folded.select("id", "x.*")


def chunk_documents(docs: DataFrame) -> DataFrame:
    """``id, seq, title, numbering, level, path, content``: the text under each heading, and before the first one.

    A document without a heading is one chunk. Blank intro texts are left out.
    """
    heads = heading_paths(docs)
    every = lines(docs).join(heads, ["id", "line_no"], "left")
    seq = F.count("level").over(Window.partitionBy("id").orderBy("line_no"))
    placed = every.withColumn("seq", seq.cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    out = placed.groupBy("id", "seq").agg(F.max("title").alias("title"), F.max("numbering").alias("numbering"), F.max("level").alias("level"), F.max("path").alias("path"), strip(text).alias("content"))
    intro = out.where((F.col("seq") > 0) | (F.col("content") != ""))
    return intro.select("id", "seq", F.coalesce("title", F.lit(INTRO_TITLE)).alias("title"), F.coalesce("numbering", F.when(F.col("seq") == 0, "0").otherwise(F.col("title"))).alias("numbering"), F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("path", F.lit(INTRO_TITLE)).alias("path"), "content")


def sentences(text: Column) -> Column:
    """The pieces between the places behind 。！!？?; white space there is dropped."""
    return F.split(text, r"(?U)(?<=[。！!？?])\s*")


def packed(text: Column, most: int) -> Column:
    """Sentences put together greedily to parts of at most ``most`` characters; a longer sentence is a part by itself."""
    start = F.struct(F.lit("").alias("cur"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(state: Column, s: Column) -> Column:
        full = F.char_length(state["cur"]) + F.char_length(s) > most
        flushed = F.when(full & (strip(state["cur"]) != ""), F.concat(state["out"], F.array(strip(state["cur"])))).otherwise(state["out"])
        return F.struct(F.when(full, s).otherwise(F.concat(state["cur"], s)).alias("cur"), flushed.alias("out"))

    def finish(state: Column) -> Column:
        return F.when(strip(state["cur"]) != "", F.concat(state["out"], F.array(strip(state["cur"])))).otherwise(state["out"])

    return F.aggregate(sentences(text), start, step, finish)


def refine(chunks: DataFrame, most: int = 300, *carried: str) -> DataFrame:
    """``id, part, title, content`` and the columns ``carried``: chunks of at most ``most`` characters as they are (part 0),
    longer ones packed."""
    short = F.char_length("content") <= most
    parts = F.when(short, F.array("content")).otherwise(packed(F.col("content"), most))
    out = chunks.select("id", "title", *carried, short.alias("short"), F.posexplode(parts).alias("at", "content"))
    part = F.when(F.col("short"), 0).otherwise(F.col("at") + 1)
    title = F.when(F.col("short"), F.coalesce("title", F.lit(""))).otherwise(F.concat(F.coalesce("title", F.lit("")), F.lit(" (part "), part.cast("string"), F.lit(")")))
    return out.select("id", part.alias("part"), title.alias("title"), "content", *carried)


def numbered_metadata(metadata: Column, numbering: Column) -> Column:
    """The metadata with the last of a path's numbers as ``chapter_numbering``, unless there is none."""
    last = F.element_at(F.filter(numbering, lambda n: ~is_blank(n)), -1)
    own = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, _: k != "chapter_numbering")
    return F.when(F.size(F.filter(numbering, lambda n: ~is_blank(n))) > 0, F.map_concat(own, F.create_map(F.lit("chapter_numbering"), last))).otherwise(metadata)


def extracted_questions(chunks: DataFrame, rewrite: bool = True) -> DataFrame:
    """``id, question_id, class, title, description, source, rewritten``: the questions among ``chunks`` (id, title, content,
    path, book): detected, cleaned (at least 10 characters left), named, with their source; rewritten behind the
    source as context, or null."""
    asked = chunks.where(is_question(F.col("content"), F.coalesce("title", F.lit("")), F.col("path")))
    cleaned = asked.withColumn("description", clean_description(F.col("content"))).where(F.char_length("description") >= 10)
    named = cleaned.withColumns({"question_id": question_id(F.col("id"), F.col("title")), "source": question_source(F.col("path"), F.col("book"))})
    again = rewritten(F.col("description"), F.col("source"), F.col("question_id"))["text"] if rewrite else F.lit(None).cast("string")
    return named.select("id", "question_id", F.lit("single").alias("class"), "title", "description", "source", again.alias("rewritten"))


def extraction_statistics(chunks: DataFrame) -> DataFrame:
    """One row: all chunks, those detected as questions, those extracted, and those that a context rewrote."""
    found = is_question(F.col("content"), F.coalesce("title", F.lit("")), F.col("path"))
    long = found & (F.char_length(clean_description(F.col("content"))) >= 10)
    context = F.char_length(question_source(F.col("path"), F.col("book"))) > 50
    return chunks.agg(F.count("*").alias("total"), F.count_if(found).alias("detected"), F.count_if(long).alias("extracted"), F.count_if(long & context).alias("rewritten"))


def dense_ids(rows: DataFrame, key: str, *order: str, width: int = 10_000) -> DataFrame:
    """``rows`` with ``dense_id``: 1, 2, ... in the order of ``key`` and ``order``. Ranges of ``width`` keys are counted
    first, so that no task numbers all rows."""
    ranged = rows.withColumn("bucket", F.floor(F.col(key) / width))
    counts = ranged.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("upper", F.floor(F.col("bucket") / width))
    # the buckets are summed up within upper ones, and only those in one task: one row for width * width keys
    upper = counts.groupBy("upper").agg(F.sum("n").alias("n"))
    above = upper.select("upper", (F.sum("n").over(Window.orderBy("upper")) - F.col("n")).alias("above"))
    inside = counts.select("bucket", "upper", (F.sum("n").over(Window.partitionBy("upper").orderBy("bucket")) - F.col("n")).alias("inside"))
    before = inside.join(above, "upper").select("bucket", (F.col("above") + F.col("inside")).alias("before"))
    within = F.row_number().over(Window.partitionBy("bucket").orderBy(key, *order))
    return ranged.withColumn("w", within).join(before, "bucket").withColumn("dense_id", (F.col("before") + F.col("w")).cast("bigint")).drop("bucket", "w", "before")


def length_buckets(length: Column) -> Column:
    """The class of a length: below 100, 500, 1000, 2000, or more."""
    return F.when(length < 100, "<100").when(length < 500, "100-500").when(length < 1000, "500-1000").when(length < 2000, "1000-2000").otherwise(">=2000")


def exercises(docs: DataFrame) -> DataFrame:
    """``id, line_no, ex_id, chapter, question``: exercise lines with the chapter that was announced last."""
    text = strip(F.col("line"))
    every = lines(docs).withColumn("t", text)
    chapter = F.when(F.col("t").rlike("^#+ *第") & F.col("t").contains("章"), strip(F.regexp_replace("t", "^#+", "")))
    carried = F.last(chapter, ignorenulls=True).over(Window.partitionBy("id").orderBy("line_no"))
    pattern = r"^\*?(\d+\.\d+-\d+)\s+([^.\s].*)$"
    found = every.withColumn("chapter", F.coalesce(carried, F.lit(""))).where(F.col("t").rlike(pattern))
    return found.select("id", "line_no", F.regexp_extract("t", pattern, 1).alias("ex_id"), "chapter", F.regexp_extract("t", pattern, 2).alias("question"))


def problems(docs: DataFrame) -> DataFrame:
    """``id, prob_id, chapter, title, content, full_text, question``: problem headings with the lines up to the next."""
    every = lines(docs).withColumn("t", strip(F.col("line")))
    order = Window.partitionBy("id").orderBy("line_no")
    chapter = F.when(F.col("t").rlike("^#+ *第") & F.col("t").contains("章"), strip(F.regexp_replace("t", "^#+", "")))
    head = F.col("t").rlike(r"^#+\s*\d+-\d+")
    every = every.withColumn("chapter", F.coalesce(F.last(chapter, ignorenulls=True).over(order), F.lit(""))).withColumn("segment", F.sum(F.when(head, 1).otherwise(0)).over(order))
    body = F.when((F.col("t") != "") & ~F.col("t").startswith("#") & ~F.col("t").startswith("[") & ~F.col("t").startswith("Omitted"), F.struct("line_no", "t"))
    per = every.where("segment > 0").groupBy("id", "segment").agg(F.min_by("t", "line_no").alias("h"), F.min_by("chapter", "line_no").alias("chapter"), F.transform(F.array_sort(F.collect_list(body)), lambda x: x["t"]).alias("body"))
    title = strip(F.regexp_replace("h", r"^#+\s*\d+-\d+", ""))
    out = per.select("id", F.regexp_extract("h", r"(\d+-\d+)", 1).alias("prob_id"), "chapter", title.alias("title"), F.array_join("body", " ").alias("content"), F.array_join("body", "\n").alias("full_text"))
    return out.withColumn("question", F.concat("title", F.lit("\n"), "content"))


def is_question(content: Column, title: Column, path: Column) -> Column:
    """Whether a chunk is one question: long enough, a question's number at a line's start, and a sign in path or title."""
    number = content.rlike(r"(?:^|\n)\s*(?:" + "|".join(QUESTION_IDS) + ")")
    in_path = F.exists(path, lambda p: F.coalesce(p.rlike("|".join(PATH_WORDS)), F.lit(False)))
    return F.coalesce((F.char_length(content) >= 20) & number, F.lit(False)) & (F.coalesce(in_path, F.lit(False)) | F.coalesce(title.rlike("|".join(TITLE_WORDS)), F.lit(False)))


def clean_description(text: Column) -> Column:
    """White space squeezed, edge marks, markup characters and addresses removed, in this order."""
    text = F.regexp_replace(text, r"(?U)\s+", " ")
    text = F.regexp_replace(text, "^[。，！？；：\"《》]+|[。，！？；：\"《》]+$", "")
    text = F.regexp_replace(text, r"[#*`_\[\]]+", "")
    text = F.regexp_replace(text, r"!\[.*?\]\(.*?\)", "")
    return strip(F.regexp_replace(text, r"(?U)https?://\S+", ""))


def question_id(key: Column, title: Column) -> Column:
    """``q_{key}_{first eight hex digits of the title's MD5}``."""
    return F.concat(F.lit("q_"), key.cast("string"), F.lit("_"), F.substring(F.md5(F.coalesce(title, F.lit(""))), 1, 8))


def question_source(path: Column, book: Column) -> Column:
    """The last three path titles and the book, joined."""
    size = F.size(path)
    tail = F.array_join(F.slice(path, F.greatest(size - 2, F.lit(1)), 3), " -> ")
    return F.concat_ws(" | ", F.when(size > 0, tail), F.when(~is_blank(book), book))


def rewritten(description: Column, context: Column, key: Column) -> Column:
    """``id, text``: the description behind the first 100 characters of a context of more than 50."""
    text = F.when(F.char_length(context) > 50, F.concat(F.lit("背景："), F.substring(context, 1, 100), F.lit("...\n\n"), description)).otherwise(description)
    return F.struct(F.concat(key, F.lit("_rewritten")).alias("id"), text.alias("text"))


def is_good_question(title: Column, description: Column) -> Column:
    """The documented quality rule: 50 characters or more, no hints or answers in it, a title that isn't a number."""
    hint = description.rlike("答案|提示|参考")
    return F.coalesce((F.char_length(description) >= 50) & ~hint & ~F.coalesce(title, F.lit("")).rlike(r"^\s*[0-9.]+\s*$"), F.lit(False))


def delimited_titles(text: Column) -> Column:
    """The titles in ``###`title`###`` marks, in order."""
    return F.regexp_extract_all(text, F.lit("###`([^`]+)`###"), F.lit(1))


def merged_questions(exercise: DataFrame, problem: DataFrame) -> DataFrame:
    """Exercises and problems under one schema: ``type, id, chapter, question``."""
    a = exercise.select(F.lit("exercise").alias("type"), F.col("ex_id").alias("id"), "chapter", "question")
    return a.unionByName(problem.select(F.lit("problem").alias("type"), F.col("prob_id").alias("id"), "chapter", "question"))
