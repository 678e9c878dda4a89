from lectern.llm.queries import p2_found
from lectern.llm.scan_lines import is_scanned, lines_of
from lectern.llm.scan_repair import CONFUSED, Shapes, noise_pieces, repaired, scan_noise, undone

SCHEMA = "chunk_id bigint, content string, title string, metadata map<string,string>, path_titles array<string>, id string, line string, kind string"
CLEAN = "The recursive segment tree stores all records in sorted blocks, and the cache-friendly layout needs less space. 用压缩的距离矩阵存放记录，执行时间不变。"
SCAN = "Let the parameter be small; this means that scanning the recur-\n66 | Work Queue\n  sive segment tree costs less since collisions are re5olved by\n- 12 -\nchaining, and the cache-\nfriendly layout advance5 slowly in all other recorcls of the\nblocks 用压缩的距离矩陈存放"


def table(spark):
    rows = [(i, CLEAN + " resolved records advances", None, None, None, "x", "y", "z") for i in range(1, 8)]
    rows += [(100, SCAN, "Work Queue (part 1)", {"title": "A Book"}, ["Queues", "Work Queue"], "x", "y", "z")] * 2
    rows += [(101, SCAN, None, None, None, None, None, None), (102, None, "t", {}, [], "x", "y", "z"), (103, "", "t", {"title": None}, [None], "x", "y", "z"), (104, "样例输入：\n26\n32 1 67\n1", "t", {}, [], "x", "y", "z"), (None, SCAN, "t", {}, [], "x", "y", "z")]
    return spark.createDataFrame(rows, SCHEMA)


def test_found_pieces(spark):
    df = table(spark)
    noise = scan_noise(df).cache()
    got = {(r["kind"], r["piece"]) for r in noise_pieces(noise).where("chunk_id = 100").collect()}
    assert got == {("hyphen", "recursive"), ("hyphen", "cache-friendly"), ("header", "66 | Work Queue"), ("page_number", "- 12 -"), ("misread", "resolved"), ("misread", "advances"), ("misread", "records"), ("misread", "阵")}
    assert {r["chunk_id"] for r in noise.select("chunk_id").distinct().collect()} <= {100, 101}
    text = {r["chunk_id"]: r["repaired"] for r in repaired(df, noise).collect()}
    assert "recursive segment tree costs less since collisions are resolved by chaining, and the cache-friendly layout advances slowly" in text[100]
    assert "距离矩阵" in text[100] and "12" not in text[100] and "Queue" not in text[100]
    assert text[102] is None and text[103] == "" and text[104] == "样例输入：\n26\n32 1 67\n1" and text[1].startswith("The recursive")


def test_confusions_outside_the_lists_are_learned(spark):
    from random import Random

    rng = Random(1)
    words = sorted({"".join(rng.choice("abdhkmoprtuvyz") for _ in range(8)) for _ in range(60)})
    clean = [(k, " ".join(words) + ". This is clean prose which ends with a mark.") for k in range(25)]
    wrong = [w.replace("k", "lc", 1) for w in words if "k" in w][:12]
    scans = [(100 + k, f"the page begins with words that\nare {w} and go on\nuntil the page ends here") for k, w in enumerate(wrong)]
    df = spark.createDataFrame([(k, t, None, None, None) for k, t in clean + scans], "chunk_id bigint, content string, title string, metadata map<string,string>, path_titles array<string>")
    got = {(r["chunk_id"], r["piece"]) for r in scan_noise(df).where("kind = 'misread'").collect()}
    assert {(100 + k, w.replace("lc", "k", 1)) for k, w in enumerate(wrong)} <= got
    assert not any(("k", "lc") == c for c in CONFUSED)


def test_long_titles_are_compared_whole(spark):
    title = "A very long chapter title on " + "trees and queues and " * 60
    same, other = title + "heaps", title + "stacks"
    rows = [(1, "Prose of another chunk.", "t", {"title": same}, [None]), (2, f"the first line goes on without\n{same}\nan end until the second line\nends here", "t", {}, [None]), (3, f"the first line goes on without\n{other}\nan end until the second line\nends here", "t", {}, [None])]
    df = spark.createDataFrame(rows, "chunk_id bigint, content string, title string, metadata map<string,string>, path_titles array<string>")
    found = {r["chunk_id"] for r in scan_noise(df).where("kind = 'header'").collect()}
    assert 3 not in found


def test_empty_and_long(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert scan_noise(empty).count() == 0 and repaired(empty, scan_noise(empty)).count() == 0
    long = spark.createDataFrame([(1, "word " * 60_000 + "\n" + "中" * 50_000 + "\n12\nend", None, None, None, None, None, None)], SCHEMA)
    assert scan_noise(long).count() >= 0


def test_parts():
    assert "maximum" in undone("maxirnum") and undone("xyz") == []
    assert "resolves" not in undone("re5o1ves") and "resolves" in undone("re5o1ves", places=2) and "faIls" not in undone("fa1ls")
    assert "kept" in undone("lcept", [("k", "lc")])
    assert Shapes("ab中3").around(2) == ("lab", "mb0", "r0$")
    assert is_scanned(lines_of(SCAN)) and not is_scanned(lines_of(CLEAN)) and not is_scanned([])


def test_query_runs(spark, tiny):
    got = p2_found(spark, tiny)
    assert got.columns == ["chunk_id", "kind", "piece"] and got.count() == got.distinct().count() > 0
