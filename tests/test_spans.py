import itertools
import json

import pytest
from pyspark.sql import functions as F

from tidewell.functions import spans
from tidewell.operators import audit, packing
from tidewell.operators import compile as compiled


def test_paste_projection(spark):
    assert spans.project_pastes("abPASTEcd", 10, [{"start": 12, "text": "PASTE", "paste_id": "p"}]) == ([{"type": "authored_text", "content": "ab", "paste_id": None}, {"type": "paste", "content": "PASTE", "paste_id": "p"}, {"type": "authored_text", "content": "cd", "paste_id": None}], None)
    assert spans.project_pastes("abc", 0, [{"start": 1, "text": "zz", "paste_id": "p"}])[1] == "paste_span_not_preserved"
    assert spans.project_pastes("aaaa", 0, [{"start": 0, "text": "aaa", "paste_id": "p"}, {"start": 1, "text": "aaa", "paste_id": "q"}])[1] == "paste_spans_overlap"
    # an empty span, and a lost one after two that overlap, are not preserved
    assert spans.project_pastes("aaaa", 0, [{"start": 1, "text": "", "paste_id": "p"}])[1] == "paste_span_not_preserved"
    assert spans.project_pastes("aaaa", 0, [{"start": 0, "text": "aaa", "paste_id": "p"}, {"start": 1, "text": "aaa", "paste_id": "q"}, {"start": 3, "text": "zz", "paste_id": "r"}])[1] == "paste_span_not_preserved"
    assert [x["paste_id"] for x in spans.project_pastes("abab", 5, [{"start": 7, "text": "ab", "paste_id": "q"}, {"start": 5, "text": "ab", "paste_id": "p"}])[0]] == ["p", "q"]
    # a repeated payload is placed by its offset
    df = spark.sql("select 'xx' as i, 0 as o, array(named_struct('start', 1, 'text', 'x', 'paste_id', 'p')) as s")
    r = df.select(spans.paste_segments("i", "o", "s").alias("r")).select("r.*").withColumn("m", spans.merged_segments(F.concat("segments", "segments"))).first()
    assert [(s["type"], s["content"]) for s in r["segments"]] == [("authored_text", "x"), ("paste", "x")] and r["reason"] is None
    two = spark.sql("select array(named_struct('type','authored_text','content','a','paste_id',cast(null as string)), named_struct('type','authored_text','content','b','paste_id',cast(null as string))) as s")
    assert [s["content"] for s in two.select(spans.merged_segments(F.col("s")).alias("m")).first()["m"]] == ["ab"]


def by_hand(text, parts):
    """All ways to cover the text, one part after the other."""
    if not parts:
        return [[]] if not text else []
    known = parts[0]["content"] is not None
    sizes = [len(parts[0]["content"])] if known else range(1, len(text) + 1)
    return [[n, *rest] for n in sizes if not known or text.startswith(parts[0]["content"]) for rest in by_hand(text[n:], parts[1:])]


def test_unique_segmentation(spark):
    a = lambda x: {"type": "authored_text", "content": x}
    p = lambda x=None: {"type": "paste", "content": x}
    rows = [("a-b-a", [a("a"), p(), a("-a")]), ("XaY", [a("a")]), ("a-b-a", [a("a"), p("-"), a("b")]), ("aXaYa", [a("a"), p(), a("a"), p(), a("a")]), ("aaaaa", [p(), a("a"), p()]), ("ab", [p(), p()]), ("", [])]
    df = spark.createDataFrame(rows, "t string, p array<struct<type:string,content:string>>")
    got = [tuple(r["u"]) for r in df.select(spans.unique_segmentation("t", "p").alias("u")).collect()]
    bad = (None, "no_segmentation")
    assert got == [([0, 1, 3], None), bad, bad, ([0, 1, 2, 3, 4], None), (None, "ambiguous_segmentation"), bad, ([], None)]
    for text in map("".join, itertools.product("ab", repeat=5)):
        for parts in ([a("a"), p(), a("b")], [p(), a("ab"), p()], [p(), a("a"), p("b"), a("a")], [p("ab"), p(), a("")]):
            ways = by_hand(text, parts)
            got = spans.segmentations(text, parts, 99)
            assert sorted([e - s for s, e in x] for x in got) == sorted(ways)
            assert len(spans.segmentations(text, parts)) == min(2, len(ways))
    # no way, and no exponential search for one
    assert spans.segmentations("a" * 400 + "b", [x for _ in range(30) for x in (p(), a("a"))]) == []


def test_equivalent_edits_against_all_offsets(spark):
    for before in map("".join, itertools.product("ab", repeat=4)):
        for at in range(5):
            for new in ("a", "ab", "aa"):
                after = before[:at] + new + before[at:]
                want = [k for k in range(5) if before[:k] + after[k : k + len(new)] + before[k:] == after]
                assert spans.equivalent_edits(before, at, "", new) == want
    for before, at, old, new in (("xabab", 1, "ab", "ab"), ("aab", 0, "a", "ba"), ("abcabc", 3, "abc", "")):
        after = before[:at] + new + before[at + len(old) :]
        want = [k for k in range(len(before) - len(old) + 1) if before[:k] + after[k : k + len(new)] + before[k + len(old) :] == after]
        assert spans.equivalent_edits(before, at, old, new) == want
    assert len(spans.equivalent_edits("a" * 2000, 1000, "", "a")) == 2001 and spans.equivalent_edits("a" * 3000, 1500, "", "a") is None
    df = spark.createDataFrame([("aaa", 3, "", "a", 2.0), ("aaa", 3, "", "a", 1.5)], "b string, o int, r string, i string, c double")
    assert [r["x"] for r in df.select(spans.grounded_offset("b", "o", "r", "i", "c").alias("x")).collect()] == [1, None]


def test_tail_truncation(spark):
    event = json.dumps({"kind": "read", "content": "0123456789" * 5})
    rows = spark.createDataFrame([(event, n) for n in (10, 60, 70, 500)], "e string, n int")
    got = [r["x"] for r in rows.select(spans.truncated_tail(F.col("e"), F.col("n"), packing.byte_tokens).alias("x")).collect()]
    assert got[0] is None and all(len(packing.byte_tokens(x)) <= n for x, n in zip(got[1:], (60, 70, 500), strict=True))
    assert len(packing.byte_tokens(got[2])) == 70 and json.loads(got[3])["content"] == "0123456789" * 5
    seg = json.dumps({"segments": [{"type": "authored_text", "content": "old" * 9}, {"type": "paste", "content": "new"}]})
    cut = json.loads(spans.tail_of_event(seg, 90, packing.byte_tokens))
    assert cut["segments"][-1] == {"type": "paste", "content": "new"}


def test_ratio(spark):
    assert spark.createDataFrame([("abcd", "bcde")], "a string, b string").select(spans.matching_ratio("a", "b").alias("r")).first()["r"] == 0.75


def test_audits(spark):
    events = spark.createDataFrame([("s", f"e{k}", "write" if k % 2 else "read", k, k * 10, k * 10 - 5 if k % 2 else None, f"content {k}", "w") for k in range(6)], "session_id string, event_id string, kind string, line int, available_at long, began_at long, content string, window_title string")
    ex, exclusions, rejections = compiled.examples(events)
    good = audit.causal_dataset(events, ex, exclusions, rejections)
    assert {r["violations"] for r in good.collect()} == {0}
    audit.require(good)
    with pytest.raises(ValueError, match="writes not in"):
        audit.require(audit.causal_dataset(events, ex.limit(1), exclusions, rejections))
    sessions = spark.createDataFrame([("s", 0)], "session_id string, session_ordinal int")
    blocks = compiled.corpus_blocks(events, sessions, spark.createDataFrame([("e0",)], "event_id string"))
    audit.require(audit.corpus(blocks))
    assert {r["rule"]: r["violations"] for r in audit.corpus(blocks.where("position <> 2")).collect()}["positions with holes"] == 1
    groups = spark.createDataFrame([("g", ["e1", "e3"]), ("h", ["e3"])], "g string, m array<string>")
    bad = {r["rule"]: r["violations"] for r in audit.counted(audit.exact_partition(events.where("kind = 'write'").select("event_id"), groups, "event_id", "m")).collect()}
    assert bad == {"items in no group": 1, "items in two groups": 1, "members that are no items": 0}
    cand = spark.createDataFrame([("s", "a", 1, ["x", "y"]), ("s", "b", 0, ["y", "z"]), ("s", "c", 2, ["z"])], "k string, candidate_id string, began_at int, members array<string>")
    assert {r["candidate_id"] for r in audit.maximal_groups(cand, ["k"]).collect()} == {"b"}
    small, large = (spark.createDataFrame([("t", x)], "t string, ids array<string>") for x in (["b", "c"], ["a", "b", "c"]))
    assert audit.counted(audit.nested_suffixes(small, large, "t", "ids")).first()["violations"] == 0
    assert audit.counted(audit.nested_suffixes(large, small, "t", "ids")).first()["violations"] == 1
    assert audit.checked(events, {"positive": F.col("available_at") > 0}).first()["violations"] == 1
    was = spark.createDataFrame([("t", "1"), ("u", "2")], "table string, digest string")
    assert [r["table"] for r in audit.tampered(was, was.where("table = 't'")).collect()] == ["u"]
