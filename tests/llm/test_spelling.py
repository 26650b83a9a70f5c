import random
import re
from collections import Counter
from zlib import crc32

from pyspark.sql import functions as F

from sensorframe.llm import spelling


def brute(rows, least=5, ratio=5, slips=199):
    """All pairs of words by a table of edits."""
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % slips == 0 else run] += 1
    words = {w: n for w, n in total.items() if len(w) >= 6 and n >= least}

    def near(a, b):
        a, b = sorted((a, b), key=len)
        if len(b) - len(a) > 1 or a == b:
            return False
        k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
        return a[k:] == b[k + 1 :] or (len(a) == len(b) and a[k + 1 :] == b[k + 1 :])

    found = {w: sorted((-words[v], v) for v in words if near(w, v)) for w in words}
    form = {w: v[0][1] if v and -v[0][0] >= ratio * words[w] else None for w, v in found.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, n, len(found[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items())


def answer(df):
    columns = ["word", "n", "n_near", "form", "form_n", "root"]
    assert df.columns == columns
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def noisy(seed, texts=60):
    r = random.Random(seed)
    stems = ["".join(r.choice("aeinrstéß") for _ in range(r.randint(6, 9))) for _ in range(25)]

    def word():
        w = stems[min(int(r.expovariate(0.3)), 24)]
        if r.random() < 0.3:
            i = r.randrange(len(w))
            w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("aeÉx") + w[i + 1 :], w[:i] + r.choice("nt") + w[i:]])
        return w.upper() if r.random() < 0.1 else w

    return [(i, " ".join(word() for _ in range(300))) for i in range(texts)]


def test_equals_brute_force(spark, docs_of):
    rows = noisy(4)
    want = brute(rows)
    assert any(w[3] and w[3] != w[5] for w in want)  # a form that has a form
    for symbols in (None, 2, 9):
        assert answer(spelling.spelling_variants(docs_of(rows), symbols=symbols)) == want


def test_long_words(docs_of):
    """Around the length from which words are looked up by their ends."""
    r = random.Random(8)
    rows = []
    for size in (62, 63, 64, 65, 66, 300):
        w = "".join(r.choice("abcdefgh") for _ in range(size))
        for i in (0, 5, size // 2, size - 1):
            rows += [(len(rows), " ".join([w] * 40 + [w[:i] + w[i + 1 :]] * 6 + [w[:i] + "zz"[i % 2 :] + w[i + 1 :]] * 5))]
    want = brute(rows)
    assert answer(spelling.spelling_variants(docs_of(rows))) == want and len({len(w[0]) for w in want}) == 10


def test_odd_texts(spark, docs_of):
    rows = [(1, None), (2, ""), (None, "window " * 9), (3, "windoww\x00windoww " * 3), (3, "windoww\x00windoww " * 3), (4, "short " * 9), (5, "q" * 100_000), (6, "1234567 " * 9), (7, "中window中" * 60)]
    assert answer(spelling.spelling_variants(docs_of(rows))) == brute(rows)
    assert answer(spelling.spelling_variants(docs_of([]))) == []


def test_neighbourhood_is_full(spark):
    word = "0120"
    keys = spark.range(1).select(spelling.neighbourhood(F.lit(word), "012").alias("k")).first().k
    want = {word} | {word[:i] + word[i + 1 :] for i in range(4)} | {word[:i] + s + word[i + 1 :] for i in range(4) for s in "012"} | {word[:i] + s + word[i:] for i in range(5) for s in "012"}
    coded = spark.createDataFrame([(w,) for w in want], "w string").select(F.xxhash64("w")).collect()
    assert len(keys) == len(set(keys)) and set(keys) == {r[0] for r in coded}
