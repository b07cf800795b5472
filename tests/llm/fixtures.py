"""A small documents table with nulls, empty, long, repeated and near-equal texts and clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, node long, key int, `size` int, g string"


def texts(seed=5, n=60):
    r = random.Random(seed)
    vocab = ["of", "the", "Ère", "naïve", "stone", "river", "light", "Über", "x", "walking", "🙂", "tree,", "end."]
    out = []
    for i in range(n):
        words = [r.choice(vocab) + r.choice(["", "", "s"]) for _ in range(r.randint(0, 120))]
        out.append(r.choice([" ", "\n", "\t "]).join(words))
    out[3], out[4], out[5], out[6] = None, "", "   \n ", "one"
    out[10] = out[11] = out[40]
    out[12] = out[41] + " extra"
    out[13] = (out[42] + " ") * 30
    out[50] = "prefix " + out[42] + "\n" + out[43]
    return out


def rows(seed=5, n=60):
    out = []
    for i, t in enumerate(texts(seed, n)):
        out.append((i * 3 + 1, t, None if i % 7 == 0 else ["en", "de"][i % 2], None if i % 11 == 0 else f"s{min(i % 5, 2)}", None if t is None else len(t), "x", 1, 2, 3, "y"))
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}
