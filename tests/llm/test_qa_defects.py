import pytest

from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm.qa_defects import Pushdown, copied, coverable, defective_pairs, judged, language, tiled
from lectern.llm.queries import p4_found

ASK = "Let the parameter be 234; explain why the search tree answers in O(n) steps when all 50 keys are equal and the input fits in memory."
ZH = "考虑含有50个元素的搜索树，解释为什么当所有元素相等时，它可以在O(n)步内得到回答，并分析它的代价。"
FULL = "Because every edge of the tree is examined once, the search stops after n steps. The cost of the merge is therefore linear."


@pytest.mark.parametrize(
    ("question", "answer", "expected"),
    [
        (ASK, FULL, None), (ASK, FULL + "\n\nT(n) = O(n log n)", None), (ASK, FULL + " ∎", None), (ASK, FULL + "[3]", None), (ASK, FULL + "\n```\nfor i = 1 to n\n```", None), (ASK, FULL + " (QED)", None),
        (ASK, None, "empty"), (ASK, " \n", "empty"), (ASK, "N/A", "empty"), (ZH, "答案：", "empty"), (ZH, "答案生成失败", "empty"), (ASK, "```\n```", "empty"), 
        (ASK, "I'd rather not answer that; please consult your instructor.", "refusal"), (ZH, "感谢你的提问。对不起，作为助手我不能提供该题的解答。", "refusal"), (ZH, "我不能不强调边界情形。因为每条边只检查一次，搜索在n步之后结束。", None),
        (ASK, ASK, "copies_question"), (ASK, "The task is: " + ASK + " Please give the solution.", "copies_question"), (ZH, ZH.replace("，", ","), "copies_question"), (ZH, ZH + ZH, "copies_question"), (ZH, "题目：" + ZH + "\n\n因为树的每条边只检查一次，所以搜索在n步之后结束。由归纳法可知，旋转子树不会改变树的高度，总的代价因此是线性的。对于大规模输入，结论同样成立，证明到此完成，其余情形类似。", None),
        (ASK, "因为树的每条边只检查一次，所以搜索在n步之后结束。", "other_language"), (ZH, FULL, "other_language"), (ASK, "Weil jede Kante nur einmal geprüft wird, endet die Suche nach n Schritten und der Aufwand ist linear.", "other_language"),
        (ASK, FULL + " Therefore we", "truncated"), (ASK, FULL + "\n```\nfor i = 1 to", "truncated"), (ASK, FULL + "\n\n5. Summary", "truncated"), (ASK, FULL + "\n\nT(n) = O(n log", "truncated"), (ZH, "因为树的每条边只检查一次，所以搜索在n步之后结束。综上所述，", "truncated"),
        (None, FULL, None), (" ", None, None),
    ],
)
def test_defect(question, answer, expected):
    assert judged(question, answer)[0] == expected


def open_at_end(text):
    return Pushdown(text).breaks_off()


def test_parts():
    assert language("x = 5") is None and language("") is None
    assert open_at_end("a (b") and not open_at_end("a [0, n) b") and open_at_end("```\nx") and not open_at_end("")
    assert open_at_end('He said "the loop ends.') and not open_at_end('He said "the loop ends."') and open_at_end("a (b\nc.") and not open_at_end("a (b\n\nc.")
    assert open_at_end("<pre>x = 1.") and not open_at_end("<pre>x</pre> a<b and c>d") and open_at_end("\\begin{align}x=1.") and open_at_end("he says “ends.") and not open_at_end("costs $5 and `a.")


def test_tiles_are_marked_on_both_sides():
    assert tiled("abcdefghijabcdefghij", "abcdefghij", 5)[0] == 10
    # the longest match first: a shorter one further left must not break it up
    assert tiled("xxabcdeyyabcdefgh", "abcdefgh", 5)[0] == 8
    assert copied("abcdefghij" * 3, "abcdefghij", 5) == 30 and copied("abcdefghijabcde", "abcdefghijklmnopqrstuvwxyz", 5) == 10


@settings(max_examples=150, deadline=None)
@given(st.text("ab", max_size=40), st.text("ab", max_size=30), st.integers(2, 4))
def test_tiling_by_matches_and_tile_by_tile_is_the_same(answer, question, least):
    covered, marked = tiled(answer, question, least)
    assert (covered, marked) == tiled(answer, question, least, most=-1)
    assert coverable(answer, question, least, covered) and covered <= len(question)


def test_long_repetitions_are_tiled():
    assert tiled("a" * 20_000, "a" * 15_000, 10)[0] == 15_000


@pytest.mark.parametrize(
    "answer",
    ["A DAG cannot contain a cycle.", "We cannot decide this.", "Comparison sorting cannot beat n log n.", "We cannot give a bound below n, so the answer is linear.", "**Binary search**", "1. forty-two", "1. lexing\n2. parsing\n3. codegen", "Answer: (b) the second one", "Because:\n- it ends\n- it is linear\n- it is stable"],
)
def test_whole_answers(answer):
    assert judged(ASK, answer)[0] is None


@pytest.mark.parametrize(
    ("answer", "expected"),
    [
        ("I cannot help with this request. " * 16, "refusal"), ("I'm sorry, but I cannot help with exercise 3.", "refusal"), ('He said "the loop ends.', "truncated"), ("The passes are:\n1. lexing.\n2. parsing.\n3.", "truncated"),
        ("The passes are:\n- lexing.\n-", "truncated"), ("Unable to answer this question.", "refusal"), ("Lo siento, no puedo ayudar con este ejercicio. " * 3, "refusal"), ("The tree (as\nshown below is balanced.", "truncated"), ("1. It starts.\n2. It goes\n3. It sto", "truncated"),
    ],
)
def test_broken_answers(answer, expected):
    assert judged(ASK, answer)[0] == expected


def test_titles_are_headings_if_others_have_text_below(spark):
    headed = "1. 问题理解\n因为树的每条边只检查一次，所以搜索在n步之后结束。\n\n**小结**\n总的代价因此是线性的。"
    rows = [(1, ZH, "1. 问题理解\n2. 小结"), (2, ZH, headed), (3, ZH, headed), (4, ZH, "**树**"), (5, ZH, "1. 树\n2. 小结")]
    df = spark.createDataFrame(rows, "qa_id bigint, question string, answer string")
    assert [tuple(r) for r in defective_pairs(df).collect()] == [(1, "empty")]


def test_rows(spark):
    schema = "qa_id bigint, question string, answer string, defect string"
    rows = [(1, ASK, None, "x"), (1, ASK, None, "x"), (2, ASK, FULL, "x"), (3, None, None, None), (None, ASK, None, "x"), (4, ASK, "word " * 50_000, "x")]
    got = defective_pairs(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["qa_id"], r["defect"]) for r in got) == [(1, "empty"), (4, "truncated")]
    assert defective_pairs(spark.createDataFrame([], schema)).count() == 0


def test_query_runs(spark, tiny):
    kinds = {r["defect"] for r in p4_found(spark, tiny).collect()}
    assert kinds <= {"empty", "truncated", "refusal", "copies_question", "other_language"} and len(kinds) >= 3


@pytest.mark.parametrize(
    ("question", "answer", "expected"),
    [
        (ASK, "I cannot help with exercise 3.2-1.", "refusal"), (ASK, "I'm sorry, but I am unable to answer question 4. Please consult chapter 12.", "refusal"), (ZH, "抱歉，我无法回答第3题。", "refusal"),
        (ASK, "Unfortunately, I cannot help with `quicksort`.", "refusal"), (ASK, "I cannot provide a solution to this exercise; please consult your instructor. " * 8, "refusal"),
        (ZH, "3不能整除7。", None), (ASK, "The heap cannot hold 8 keys.", None), (ASK, "I cannot help but use code:\n```\nfor i in keys: visit(i)\n```", None),
        (ASK, ASK * 9, "copies_question"), (ASK, "; ".join([ASK] * 12), "copies_question"),
    ],
)
def test_every_sentence_and_place_is_judged(question, answer, expected):
    assert judged(question, answer)[0] == expected
