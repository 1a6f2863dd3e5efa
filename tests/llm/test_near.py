"""MinHash near-dedup against all pairs of shingle sets."""

import random

import pytest

from locusframe.llm import near, similar

RNG = random.Random(13)


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def expected(rows):
    """Per row: doc_id, set size, component (of rows, by its least id), kept; null ids are least."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                one, two = root(i), root(j)
                parent[max(one, two)] = min(one, two)
    low = lambda i: -1 if rows[i][0] is None else rows[i][0]
    least = {}
    for i in range(len(rows)):
        least[root(i)] = min(least.get(root(i), 1 << 62), low(i))
    out = [(d, len(s), None if least[root(i)] == -1 else least[root(i)], low(i) == least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]
    return sorted(out, key=repr)


def words(n):
    return [f"w{RNG.randrange(10**6)}" for _ in range(n)]


def changed(text, times):
    text = list(text)
    for _ in range(times):
        text[RNG.randrange(len(text))] = f"c{RNG.randrange(10**6)}"
    return text


def compared(spark, rows, **more):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, label string").repartition(3)
    got = near.near_components(docs, **more)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"] and dict(got.dtypes)["n_shingles"] == "bigint"
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows)
    return got


def test_awkward_rows(spark):
    base, long = words(60), words(20_000)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "one two"), (7, "ONE\x0bTWO"), (8, "one two three"), (9, "one two three four"), (None, "by itself without number"), (None, None)]
    rows += [(20, " ".join(base)), (21, "  ".join(base).upper()), (22, " ".join([*base[:30], "x", *base[30:]])), (20, " ".join(words(40))), (None, " ".join([*base, "end"])), (21, "\n".join(base))]
    rows += [(30, " ".join(long)), (31, " ".join(changed(long, 400))), (32, " ".join(changed(long, 1500))), (33, "é ü 漢字 é ü 漢字"), (34, "É ü 漢字 é ü 漢字")]
    compared(spark, rows)
    assert near.near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pairs_on_both_sides_of_the_threshold(spark):
    rows = []
    for k in range(150):
        base = words(90)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(changed(base, RNG.randint(1, 4))))]
    RNG.shuffle(rows)
    linked = sum(not r[3] for r in expected(rows))
    assert 30 < linked < 140
    compared(spark, rows)


@pytest.mark.parametrize("deals", [0, 2])
def test_large_families_in_blocks(spark, deals):
    base = words(120)
    star = [" ".join(changed(base, 1)) for _ in range(90)]  # nearly all linked with each other
    half = words(100)
    loose = [" ".join([*half, *words(24)]) for _ in range(60)]  # alike, yet below the threshold
    chain, walk = [], words(100)
    for _ in range(60):
        walk = [*walk[2:], *words(2)]
        chain.append(" ".join(walk))
    texts = [*star, *star[:30], *loose, *chain]
    rows = list(enumerate(texts))
    RNG.shuffle(rows)
    compared(spark, rows, block=8, deals=deals)


def test_recall_at_the_threshold():
    like = near.THREE_WORDS
    assert similar.expected_recall(like.lengths[-1], like.trees, like.threshold) >= like.recall
    assert like.deepest - like.lengths[-1] <= 4  # tails hold four values
