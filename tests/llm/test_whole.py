"""Text operators do the whole job: every text, turn and passage counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.llm import chat, markov, media, quality


def test_every_round_of_the_markov_model_sees_every_text(spark):
    random = np.random.default_rng(3)
    texts = [" ".join(random.choice(list("abcdef"), random.integers(0, 9))) for _ in range(3600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    lexicon = spark.sparkContext.broadcast(markov.lexicon(markov.written(markov.counts(docs), "counts")))
    unigram = lexicon.value.unigram
    got = markov.train(markov.written(markov.encoded(docs, lexicon), "texts"), unigram, states=2)
    _, index, offsets = lexicon.value.read([t.encode() for t in texts])
    packed, model = markov.Packed(lexicon.value.symbols_of(index), offsets), markov.first_model(unigram, 2)
    for _ in range(8):
        start, move, emit = packed.expected(model)
        start, move, emit = start + 0.1, move + 0.1, emit + 20.0 * unigram[:, None]
        model = markov.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    assert got.move == pytest.approx(model.move, rel=1e-8) and got.emit == pytest.approx(model.emit, rel=1e-8)


def test_runs_hold_every_text_once():
    sizes = np.array([5, 1, 40, 2, 2, 9])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.repeat(np.arange(6), sizes).astype("<i4")
    runs = list(markov.runs_of_texts(raw, offsets, 8))
    assert np.concatenate([s for s, _ in runs]).tolist() == np.repeat([1, 3, 4, 0, 5, 2], np.sort(sizes)).tolist()
    assert [np.diff(o).tolist() for _, o in runs] == [[1, 2, 2], [5], [9], [40]]


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<figure><figcaption>first</figcaption><img src=d></figure>after", ["d:first", "after"]),
        ("<figure><img src=d><figcaption>a <b>b</b></figcaption><img src=e></figure>", ["d:a b", "e:a b"]),
        ("<figure><figcaption>code</figcaption><pre>x = 1</pre></figure>", ["code", "x = 1"]),
        ("one<figcaption>alone</figcaption>two", ["one", "alone", "two"]),
        ("<figcaption>never closed<p>two<img src=d alt=x>three", ["never closed", "two", "d:x", "three"]),
        ("<figure><img src=d><figcaption>open</figure><p>two", ["d:open", "two"]),
        ("<div><figure><img src=d><figcaption>open</div>two", ["d:open", "two"]),
        ("<figure><figcaption>to the end<p>of it", ["to the end of it"]),
        ("<figure><figcaption>all</figcaption><figure><img src=d></figure><figure><img src=e><figcaption>own</figcaption></figure></figure>", ["d:all", "e:own"]),
        ("<figure><figcaption>group</figcaption><figure><img src=e><figcaption>own</figcaption></figure></figure>", ["group", "e:own"]),
        ("<html><head><title>no</title><meta charset=utf-8><style>p{}</style><body>text<p>more", ["text", "more"]),
        ("<head><title>no</title><link href=x><p>one</p>two", ["one", "two"]),
        ("<head><title>no</title> bare <b>text</b>", ["bare text"]),
        ("<head><title>no</title></head><body><header>h</header><head>x", ["h", "x"]),
        ("<head><script>no</script></script><title>no</title></head>yes<template>no</template>", ["yes"]),
    ],
)
def test_no_text_of_a_page_is_dropped(html, expected):
    got = [x["text"] if x["kind"] == "text" else f"{x['digest']}:{x['caption']}" for x in media.interleave(html)]
    assert got == expected and [x["position"] for x in media.interleave(html)] == list(range(len(got)))


def test_chat_gives_templates_the_full_prefix(spark):
    def last_hundred(turns):
        return "".join(f"<{r}>{t}</{r}>" for r, t in turns[-100:])

    def budgeted(turns):
        return "".join(f"<{r}>{t[: 1 if sum(len(x) for _, x in turns) > 600 and i < len(turns) - 1 else None]}</{r}>" for i, (r, t) in enumerate(turns))

    said = [(("user", "assistant")[t % 2], f"turn {t}") for t in range(150)]
    df = spark.createDataFrame([(c, t, r, x) for c, n in ((1, 150), (2, 80)) for t, (r, x) in enumerate(said[:n])], "conv_id long, turn long, role string, text string")
    for template in (last_hundred, budgeted):
        got = {r["conv_id"]: r for r in chat.format_conversations(df, template).collect()}
        assert {c: (r["formatted"], r["rewrites_history"]) for c, r in got.items()} == {1: (template(said), True), 2: (template(said[:80]), False)}
        kept = [got[1]["formatted"][t["start"] : t["end"]] for t in got[1]["turns"]]
        assert len(kept) == 150 and kept[-1] == "turn 149" and len(got[2]["turns"]) == 80
    assert chat.format_conversations(df).groupBy("conv_id").count().where("count > 1").count() == 2  # append-only: in segments


@pytest.mark.parametrize(
    ("texts", "expected"),
    [
        ({1: None, 4: "", 5: " \n"}, {i: (1, 1, 3, 0.0) for i in (1, 4, 5)}),  # 10 % of ids do not teach; these do
        ({1: "", 4: " ", 29: "held out"}, {1: (1, 1, 2, None), 4: (1, 1, 2, None), 29: (3, 1, 2, None)}),
        ({29: "a b a", 37: None}, {29: (4, 0, 0, 0.0), 37: (1, 0, 0, 0.0)}),
        ({}, {}),
    ],
)
def test_markov_scores_without_training_words(spark, tmp_path, texts, expected):
    import math
    import zlib

    taught = {i for i in texts if zlib.crc32(str(i).encode()) % 10}
    assert taught == {i for i in texts if i < 29}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in markov.op4_hmm_scores(spark, str(tmp_path)).collect()}
    assert got.keys() == expected.keys()
    tokens = len(taught)
    for i, (n, known, train, score) in expected.items():
        r = got[i]
        base = sum(math.log10(((tokens if k == 0 else 0) + 0.1) / (tokens + 0.1 * ((tokens > 0) + 1))) for k in range(n))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, train, i not in taught)
        assert r["base_score"] == pytest.approx(base, abs=1e-9) and math.isfinite(r["score"]) and r["score"] <= 1e-9
        if not tokens:
            assert r["score"] == r["base_score"] == score


def test_fitting_is_bounded_before_anything_is_collected(spark):
    rng = np.random.default_rng(1)
    say = lambda n: " ".join(rng.choice(["good", "bad", "word", "text", "other"], n))
    docs = spark.createDataFrame([(7, say(30) + f" {i}") for i in range(500)] + [(i, say(20)) for i in range(100, 130)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(7, 1), (7, 0), *((i, i % 2) for i in range(100, 130))], "doc_id long, quality int")
    assert quality.sampled(docs, labels, 10).count() == 10 and quality.sampled(docs, labels).count() == 31
    assert quality.sampled(docs.unionByName(docs).repartition(3), labels).where("doc_id = 7").first() == quality.sampled(docs, labels).where("doc_id = 7").first()
    trained = []
    real, quality.train = quality.train, lambda rows, *a, **k: (trained.append(rows), real(rows, *a, **k))[1]
    try:
        for bound in (1 << 25, 400, 3, 0):
            quality.fit(docs, labels, epochs=1, max_features=bound)
    finally:
        quality.train = real
    sizes = [sum(len(w) for w, *_ in rows) for rows in trained]
    assert len(trained[0]) == 31 and 0 < len(trained[1]) < 31 and sizes[1] <= 400 and trained[2:] == [[], []]
