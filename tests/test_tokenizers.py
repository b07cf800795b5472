import random
import re
from collections import Counter

from tidewell.operators import tokenizers
from tidewell.plans import contracts

PATTERNS = r"[a-c]+|\s|.", r"[a-b]+|[cé]+|\s+|.", r"(?s)."


def spans(pattern, text):
    return [(m.start(), m.end()) for m in re.finditer(pattern, text or "")]


def test_comparison_against_brute_force(spark):
    r = random.Random(4)
    texts = [None, "", "a", "abc"] + ["".join(r.choice("abcé 🙂.") for _ in range(r.randrange(80))) for _ in range(40)] + ["abc " * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for p, q in [(PATTERNS[0], PATTERNS[1]), (PATTERNS[1], PATTERNS[2]), (PATTERNS[0], PATTERNS[0])]:
        both = tokenizers.encoded(tokenizers.encoded(rows, "text", "a", contracts.by_pattern(p)), "text", "b", contracts.by_pattern(q))
        got = {x["doc_id"]: (x["n_a"], x["n_b"], x["n_cuts"], x["n_same"], x["first_difference"]) for x in tokenizers.agreement(both, "a", "b").collect()}
        pieces = Counter()
        for k, text in enumerate(texts):
            a, b = spans(p, text), spans(q, text)
            cuts = sorted({e for _, e in a} & {e for _, e in b})
            odd = [s for s in a if s not in set(b)]
            assert got[k] == (len(a), len(b), len(cuts), len(set(a) & set(b)), min((s for s, _ in odd), default=None))
            for lo, hi in zip([0, *cuts], cuts):
                x, y = (tuple(text[s:e] for s, e in side if lo <= s and e <= hi) for side in (a, b))
                if x != y:
                    pieces[text[lo:hi], x, y] += 1
        found = {(x["piece"], tuple(x["split_a"]), tuple(x["split_b"])): x["n"] for x in tokenizers.differing_pieces(both, "text", "a", "b").collect()}
        assert found == pieces
    used = Counter(i for t in texts if t for i, _ in contracts.by_pattern(PATTERNS[0])(t))
    assert {x["id"]: x["n"] for x in tokenizers.used_ids(both, "a").collect()} == used


def test_tokens_without_characters_count_alone(spark):
    rows = spark.createDataFrame([("ab",)], "text string")
    first = tokenizers.encoded(rows, "text", "a", lambda t: [(0, 0), (1, 1), (2, 2), (3, 2)])
    both = tokenizers.encoded(first, "text", "b", lambda t: [(9, 2)])
    x = tokenizers.agreement(both, "a", "b").first()
    assert (x["n_a"], x["n_b"], x["n_cuts"], x["n_same"], x["first_difference"]) == (4, 1, 1, 0, 0)
    assert [tuple(y) for y in tokenizers.differing_pieces(both, "text", "a", "b").collect()] == [("ab", ["a", "b"], ["ab"], 1)]


def test_vocabulary_differences(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (5, "z")], "id long, token string")
    b = spark.createDataFrame([(1, "x"), (2, "Y"), (4, "w"), (5, "z")], "id long, token string")
    assert {x["id"] for x in tokenizers.vocabulary_differences(a, b).collect()} == {2, 3, 4}
    used = spark.createDataFrame([(1,), (2,), (2,), (7,)], "id long")
    assert sorted(x["id"] for x in tokenizers.vocabulary_differences(a, b, used).collect()) == [2, 7]


def test_runs_are_the_patterns_and_a_pass_gives_what_tokens_give(spark):
    r = random.Random(9)
    texts = [None, "", " ", "7", "42", "a", "é", "🙂", "ab1 2c", "don't 12,5\n\n"] + ["".join(r.choice("abZé1 23🙂.\t\n'") for _ in range(r.randrange(60))) for _ in range(30)] + ["word1 é " * 300, ""]
    every = tokenizers.Runs([], single=[0])  # each character alone
    pairs = [(contracts.WORD_RUNS, contracts.WORDS), (contracts.LETTER_RUNS, contracts.LETTERS), (every, r"(?s).")]
    for runs, pattern in pairs:
        for text in texts:
            assert text is None or runs(text) == contracts.by_pattern(pattern)(text)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for (a, p), (b, q) in [(pairs[0], pairs[1]), (pairs[1], pairs[0]), (pairs[1], pairs[2]), (pairs[0], pairs[0])]:
        both = tokenizers.encoded(tokenizers.encoded(rows, "text", "a", contracts.by_pattern(p)), "text", "b", contracts.by_pattern(q))
        wanted = sorted(map(tuple, tokenizers.agreement(both, "a", "b").select("doc_id", "n_a", "n_b", "n_cuts", "n_same", "first_difference").collect()))
        assert sorted(map(tuple, tokenizers.compared(rows, "text", a, b).collect())) == wanted
        key = lambda x: (x["piece"], tuple(x["split_a"]), tuple(x["split_b"]), x["n"])
        assert sorted(map(key, tokenizers.pieces_apart(rows, "text", a, b).collect())) == sorted(map(key, tokenizers.differing_pieces(both, "text", "a", "b").collect()))
