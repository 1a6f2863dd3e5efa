"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from locusframe.llm import spelling
from locusframe.llm.common import table

RNG = random.Random(11)


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def counted(rows):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}


def expected(words):
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if one_apart(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def changed(word):
    at, letter = RNG.randrange(len(word)), RNG.choice("abcdeéÿ")
    return RNG.choice([word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :]])


@pytest.mark.parametrize(("leaf", "most"), [(2048, 32_768), (3, 7)])
def test_all_pairs_of_made_up_words(spark, leaf, most):
    words = {"".join(RNG.choice("abcdeé") for _ in range(RNG.randint(6, 9))): RNG.choice([5, 20, 100, 600, 3000]) for _ in range(150)}
    for _ in range(3):
        words |= {v: RNG.choice([5, 5, 6, 30, 200]) for w in list(words) if len(v := changed(w)) >= 6 and v not in words}
    words |= {"abcabcabc" + "x" * 300: 5, "abcabcabc" + "x" * 301: 50, "abcabcabc" + "x" * 302: 250, **{"".join(RNG.sample("abcdefgh", 8)): 7 for _ in range(40)}}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = spelling.variants(df, leaf=leaf, most=most).collect()
    want = expected(words)
    assert sorted((tuple(r) for r in got), key=lambda r: r[0]) == want
    assert sum(r[2] not in (r[0], r[1]) for r in want) > 5  # forms of forms


def test_words_of_awkward_texts(spark):
    rows = [(None, None), (1, None), (2, ""), (3, "short"), (4, "ÀÉÎõü× Straße NAÏVEté naïveté " * 9), (None, "Without number " * 7), (4, "repeat repeat2repeat_repeat " * 3), (4, "repeat repeat2repeat_repeat " * 3), (5, "q" * 5000), (6, "漢字abcdef漢字 ĀabcdefŁ " * 6)]
    rows += [(10 + i, " ".join(RNG.choice(["Window", "windows", "Wíndów", "pattern", "patern", "patterns", "ab"]) for _ in range(300))) for i in range(60)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, n long, word string, node int").repartition(3)
    got = spelling.spelling_variants(docs)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[0]) == expected(counted(rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and dict(got.dtypes)["n_near"] == "bigint"
    assert spelling.spelling_variants(docs.where("false")).count() == 0


def test_the_query_on_a_whole_table(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in spelling.op11_spelling_variants(spark, sf).collect()), key=lambda r: r[0]) == expected(counted(rows))


def test_vectors_differ_within_the_budget():
    words = ["".join(RNG.choice("abcdefé") for _ in range(RNG.randint(6, 90))) for _ in range(200)]
    pairs = [(w, changed(w)) for w in words]
    a, b = (spelling.vectors([p[i] for p in pairs]) for i in (0, 1))
    assert np.maximum(b - a, 0).sum(axis=1).max() <= 1 and np.maximum(a - b, 0).sum(axis=1).max() <= 1
    both = [spelling.flat([p[i] for p in pairs]) for i in (0, 1)]
    at = np.arange(len(pairs))
    assert spelling.one_apart(*both, at, at).tolist() == [one_apart(*p) for p in pairs]
    assert not spelling.one_apart(both[0], both[0], at, at).any()
