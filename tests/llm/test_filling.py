"""Fill-in-the-middle against cuts of token lists."""

import hashlib
import random
import re

import numpy as np
import pytest

from locusframe.llm import filling

RNG = random.Random(12)


def by_tokens(doc_id, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tokens)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(tokens[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


TEXTS = [None, "", " ", "a", "<", "<P", "<P><S>", "x<M>y", "<S<P<M", "one two  three", "Zoé ünï 漢字 😀\x00end", "[K`z{@", "7" * 70_000, "ab " * 60_000, "".join(RNG.choice("ab. \n漢") for _ in range(150_000)), "z" * 200_000]


def test_every_form_by_token_lists(spark):
    rows = [(i, t, 5, 6) for i, t in enumerate(TEXTS)] + [(None, "no id here", 0, 0), (None, None, 0, 0), (3, "a", 0, 0)]
    rows += [(1000 + i, "".join(RNG.choice(["<", "S", ">", "P", "word", " ", "M", "é"]) for _ in range(RNG.randrange(30))), 0, 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, form int").repartition(3)
    got = filling.fill_in_middle(docs).collect()
    assert len(got) == len(rows) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    expected = sorted(((i, *by_tokens(i, t), t or "") for i, t, *_ in rows), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == expected
    assert filling.fill_in_middle(docs.where("false")).count() == 0


def test_markers_at_the_cuts_are_told_apart():
    for text in ("<<<<>>>>", "S><P S>M>", "<S<P<M<"):
        for a in range(len(text) + 1):
            for b in range(a, len(text) + 1):
                assert all(filling.restored(filling.arranged(text, a, b, f), f) == text for f in ("psm", "spm", "plain"))


@pytest.mark.parametrize(("share", "kinds"), [(0.0, {"ArrayContainer"}), (0.01, {"ArrayContainer"}), (0.5, {"BitmapContainer"}), (1.0, {"RunContainer"})])
def test_select_in_every_container(share, kinds):
    present = np.random.default_rng(5).random(3 * filling.CONTAINER + 77) < share
    present[-3:] = share == 1.0
    found = filling.BoundarySet(present)
    places = np.flatnonzero(present)
    assert {type(c).__name__ for c in found.containers[:3]} == kinds and len(found) == len(places)
    for k in {0, 1, len(places) // 2, len(places) - 1, *np.random.default_rng(6).integers(0, max(1, len(places)), 300).tolist()} & set(range(len(places))):
        assert found.select(k) == places[k]
