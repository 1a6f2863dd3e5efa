"""Each text operator against a brute-force version on a small corpus with awkward rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from locusframe.llm import chat, exact_dedup, language, markov, media, mixing, pieces, quality, repeats, similar
from locusframe.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids int, node int, row_key int, copy_no int, digit int, bucket int, score int, word string"
RNG = random.Random(8)


def prose(n, syllables=("ba", "ro", "ti", "mu", "ken", "sol")):
    return " ".join("".join(RNG.choice(syllables) for _ in range(RNG.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    passage = prose(120)
    long = prose(900)
    near = long.split()
    near[450] = "changed"
    texts = [None, "", " \t\n ", "a", "Zoé  ünï\tcode 漢字 \x00 ▁ 😀", "12 34 !!", prose(40), prose(300), passage + " " + prose(50), prose(60) + "\n" + passage, long, long, long.replace(" ", "  ", 3), " ".join(near), "x" * 900, "ab" * 700, prose(20_000), "</s>[INST] ok", " " * 900]
    out = [(i, t, "aa" if i % 2 else None, ("s0" if i % 3 else None), 0) for i, t in enumerate(texts)]
    out += [(10, long, "aa", "s0", 0), (None, "no number here at all", "aa", "s1", 0), (None, None, None, None, 0)]
    out += [(100 + i, prose(30, ("xa", "zu", "qi")) if i % 2 else prose(30), "bb" if i % 2 else "aa", f"s{i % 4}", 0) for i in range(60)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *[1] * 7, "w") for r in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def raw(text):
    return (text or "").encode()


def test_quality(spark, sf, docs, empty):
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    classifier = quality.fit(d, labels, max_rows=60, epochs=3)
    bias = 1 / (1 + math.exp(-classifier.per_bucket()[1]))
    assert all(r["score"] == pytest.approx(bias) for r in quality.score(docs, classifier).where("doc_id in (0, 1)").collect())
    got = quality.score(docs, classifier).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(empty, classifier).count() == 0
    one = quality.fit(d, labels.where("quality = 1"), max_rows=20, epochs=1)
    assert all(r["score"] > 0.99 for r in quality.score(docs, one).collect())


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op1_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.93


def test_language(spark, docs, empty):
    training = docs.where("doc_id >= 100")
    filters = language.fit(training)
    got = {r["doc_id"]: r for r in language.predict(docs, filters).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2, 5))
    assert not language.has_letter("12 ½ _") and language.has_letter("½a")
    held = [r for r in docs.where("doc_id >= 100").collect()]
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) == len(held)
    assert language.predict(empty, filters).count() == 0
    assert {r["lang_pred"] for r in language.predict(docs, language.fit(empty)).collect()} == {"und"}


def test_language_masks_hold_every_learnt_gram(spark, docs):
    filters = language.fit(docs.where("doc_id >= 100"), max_docs=10**6)
    for r in docs.where("doc_id >= 100 and doc_id < 110").collect():
        grams, _ = language.gram_hashes([r["text"]])
        own = filters.masks_of(grams)[:, 0] >> np.uint64(filters.languages.index(r["lang"])) & np.uint64(1)
        assert own.all()


def brute_repeats(texts, size):
    count = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - size + 1):
            if count[t[i : i + size]] > 1:
                gone[i : i + size] = True
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return out


def test_repeats(docs, rows, empty):
    expected = Counter((r[0], *x) for r, x in zip(rows, brute_repeats([raw(r[1]) for r in rows], 400)))
    got = Counter((r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept_text"]), len(r["spans"]), bytes(r["kept_text"])) for r in repeats.remove_repeats(docs).collect())
    assert got == expected
    assert repeats.remove_repeats(empty).count() == 0


def test_repeats_in_cut_texts(spark, monkeypatch):
    body = [prose(300), prose(200)]
    text = body[0] + body[1] + body[0]
    r, o = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    monkeypatch.setattr(repeats, "PIECE", 700)
    starts = set()
    for part, offsets, _, places in repeats.pieces(r, o, 400):
        *_, first, last, _ = repeats.runs(part, offsets, 400, 128)
        starts |= {int(places[0]) + i for a, b in zip(first, last) for i in range(a, b + 1)}
    assert starts == set(range(len(text) - 399))


def test_markov(spark, docs, rows, empty):
    words = lambda t: [*raw(t).lower().split(), b" "]
    training = docs.where("doc_id >= 100")
    count = Counter(w for r in rows if r[0] is not None and r[0] >= 100 for w in words(r[1]))
    n, types = sum(count.values()), len(count)
    found = markov.written(markov.counts(training), "counts")
    lexicon = spark.sparkContext.broadcast(markov.lexicon(found, symbol_share=0.004, lookup_words=150))
    assert lexicon.value.symbols < len(lexicon.value.index) <= 150 < types
    texts = markov.written(markov.encoded(docs, lexicon, F.col("doc_id") >= 100), "texts")
    model = markov.train(texts.where("training"), lexicon.value.unigram, states=3, rounds=3)
    got = markov.score(texts, found, lexicon, model).collect()
    base = lambda t: sum(math.log10((count[w] + 0.1) / (n + 0.1 * (types + 1))) for w in words(t))
    expected = Counter((r[0], len(words(r[1])), sum(count[w] > 0 for w in words(r[1])), round(base(r[1]), 4)) for r in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == expected
    lex = lexicon.value
    for r in got[:12]:
        text = next(x[1] for x in rows if x[0] == r["doc_id"])
        alpha, total = None, 0.0
        for w in words(text)[:400] if r["n_tokens"] <= 400 else []:
            k = lex.end if w == b" " else lex.index.get(w, lex.symbols)
            k = lex.rare if w != b" " and k >= lex.symbols else k
            total += (math.log10(count[w] + 0.1) - lex.rest) if k == lex.rare else 0.0
            alpha = model.emit[k] * (model.start if alpha is None else alpha @ model.move)
            total += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
        if alpha is not None and Counter(x[0] for x in rows)[r["doc_id"]] == 1:
            assert r["score"] == pytest.approx(total, rel=1e-9)
    assert model.emit.sum(axis=0) == pytest.approx(1) and model.move.sum(axis=1) == pytest.approx(1)
    assert markov.score(markov.encoded(empty, lexicon), found, lexicon, model).count() == 0
    none = markov.lexicon(markov.written(markov.counts(empty), "counts"))
    assert none.tokens == 0 and none.base == pytest.approx(math.log10(0.1))


def test_baum_welch_raises_the_likelihood():
    rng = np.random.default_rng(0)
    symbols = rng.integers(0, 6, 400)
    packed = markov.Packed(symbols, np.array([0, 120, 121, 300, 400]))
    model = markov.first_model(np.full(6, 1 / 6), 3)
    last = -np.inf
    for _ in range(5):
        total = packed.logs(packed.forward(model)[1]).sum()
        assert total >= last - 1e-9
        last = total
        start, move, emit = packed.expected(model)
        assert start.sum() == pytest.approx(4) and emit.sum() == pytest.approx(400) and move.sum() == pytest.approx(396)
        model = markov.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces(docs, rows, empty):
    library = pieces.model(PATH).library
    got = Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in pieces.encode_decode(docs, PATH).collect())
    assert got == Counter((r[0], (*library.encode(r[1] or ""), 2), library.decode([*library.encode(r[1] or ""), 2])) for r in rows)
    assert pieces.encode_decode(empty, PATH).count() == 0


def test_pieces_on_random_strings():
    own, r = pieces.PieceModel(PATH), random.Random(4)
    alphabet = ["a", "the", "ing", " ", "  ", "\n", "é", "▁", "<s>", "漢", "😀", "\x00", "aa", " " * 17, "ﬁ", "　", "tion", "\t", " " * 40]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(800)]
    ids, ends = own.encode(texts, end=False)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == own.library.encode(texts)


def shingles(text):
    w = raw(text).lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def brute_classes(rows):
    sets = defaultdict(list)
    for doc_id, text in rows:
        sets[doc_id].append(shingles(text))
    nodes = sorted(sets)
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if any(x and y and 5 * len(x & y) >= 4 * len(x | y) for x in sets[a] for y in sets[b]):
                one, two = root(a), root(b)
                parent[max(one, two)] = min(one, two)
    return {n: root(n) for n in nodes}


def test_near_duplicates(docs, rows, empty):
    plain = [(r[0], r[1]) for r in rows if r[0] is not None]
    got = similar.near_duplicates(docs.where("doc_id is not null")).collect()
    assert len(got) == len(plain)
    classes = brute_classes(plain)
    assert {(r["doc_id"], r["class_id"]) for r in got} == set(classes.items())
    links = {r["doc_id"]: r["n_links"] for r in got}
    assert links[10] == links[11] == links[12] == links[13] == 1 and links[6] == 0
    assert {r["class_id"] for r in similar.near_duplicates(docs.where("doc_id is null")).collect()} == {-(1 << 63)}
    assert similar.near_duplicates(empty).count() == 0


def test_near_copies_of_one_text_in_blocks(spark):
    base = prose(200).split()
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(RNG.randint(1, 6)):
            words[RNG.randrange(len(words))] = f"w{RNG.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=16).collect()
    sets = [shingles(t) for _, t in rows]
    links = [sum(5 * len(a & b) >= 4 * len(a | b) for j, b in enumerate(sets) if j != i and b != a) for i, a in enumerate(sets)]
    assert {r["doc_id"]: r["n_links"] for r in got} == dict(enumerate(links))
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_classes(rows)


def test_exact_duplicates(docs, rows, empty):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[exact_dedup.normalised(raw(text))].append((doc_id is None, doc_id or 0))
    expected = Counter()
    for text, members in groups.items():
        least = min(members)
        for k, m in enumerate(sorted(members)):
            expected[(None if m[0] else m[1], None if least[0] else least[1], len(members), k == 0, hashlib.sha256(text).hexdigest())] += 1
    for memory in (exact_dedup.MEMORY, 3000):
        assert Counter(map(tuple, exact_dedup.exact_duplicates(docs, memory=memory).collect())) == expected
    assert exact_dedup.exact_duplicates(empty).count() == 0
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_spilled_tries_keep_every_owner():
    r = random.Random(2)
    texts = [bytes(r.choices(b"ab", k=r.randint(0, 30))) * r.randint(1, 40) for _ in range(400)]
    trie, expected = exact_dedup.PatriciaOwners(4000), defaultdict(list)
    for i, t in enumerate(texts):
        trie.insert(t, (False, 1000 - i), 1, [i])
        expected[t].append(i)
    assert trie.files
    got = sorted((o[0][1], o[1], sorted(o[2])) for o in trie.owners())
    assert got == sorted((1000 - max(m), len(m), m) for m in expected.values())


def test_chat(spark):
    said = [None, "", "</s>[INST] ok [/INST]", "a\\b <\\s> [", "<", "x", "[/ROLE][ROLE]", "line\n" * 3]
    roles = ["user", "assistant", "system", None, "tool [INST]", "assistant"]
    rows = [(c, t, RNG.choice(roles), RNG.choice(said)) for c in range(12) for t in range(RNG.randint(1, 9))] + [(99, t, roles[t % 2], f"{t} {said[2]}") for t in range(300)] + [(None, 0, "user", "x")]
    rows += [(50, 0, "user", "same"), (50, 0, "user", "same"), (50, 1, "assistant", "[INST] <s> \\ " * 40_000), (50, 1, "assistant", "ok")]  # repeated rows, a very long text, a tie
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    turns = defaultdict(list)
    for c, t, role, text in rows:
        turns[c].append((t, role or "", text or ""))
    assert set(got) == set(turns)
    for c, ts in turns.items():
        ts.sort()  # equal turns by role and text
        loss = "".join(x for _, role, x in ts if role == "assistant")
        r = got[c]
        assert r["n_turns"] == len(ts) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in ts).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == len(chat.render([(a, b) for _, a, b in ts])) and not r["rewrites_history"]
    assert chat.read_back(chat.format_conversations(df.where("false"))).count() == 0


def test_chat_finds_templates_that_rewrite_history(spark):
    def forgetful(turns):
        return "".join(f"<{r}>{t if i == len(turns) - 1 or r != 'assistant' else t.split('|')[-1]}</{r}>" for i, (r, t) in enumerate(turns))

    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "thought|answer"), (1, 2, "user", "r"), (2, 0, "user", "q"), (2, 1, "assistant", "t|a")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_conversations(df, forgetful).collect()}
    assert got[1]["rewrites_history"] and not got[2]["rewrites_history"]
    span = next(t for t in got[2]["turns"] if t["loss"])
    assert got[2]["formatted"][span["start"] : span["end"]] == "t|a"


def test_media(spark, docs, rows, tmp_path):
    stored = media.store(docs)
    got = {r["digest"]: r for r in media.features(stored).collect()}
    for _, text, *_ in rows:
        b = raw(text)
        payload = b + bytes(-len(b) % 64 or (0 if b else 64))
        r = got[hashlib.sha256(payload).hexdigest()]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert media.from_png(media.to_png(payload)).tobytes() == payload
    with pytest.raises(ValueError, match="damaged"):
        media.from_png(media.to_png(bytes(64))[:-20] + b"x" * 20)


def test_media_query(spark, sf):
    got = {r["doc_id"]: r for r in media.op9_media_columns(spark, sf).collect()}
    docs = table(spark, sf, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        r, b, lines = got[d["doc_id"]], raw(d["text"]), [" ".join(x.split()) for x in (d["text"] or "").split("\n")]
        payload = b + bytes(-len(b) % 64 or (0 if b else 64))
        assert (r["n_bytes"], r["payload_sha256"]) == (len(b), hashlib.sha256(payload).hexdigest())
        assert (r["position"], r["passages"], r["references"]) == (int(bool(lines[0])), sum(map(bool, lines)), 2)
        assert r["caption"] == " ".join((d["text"] or "").split("\n")[0][:60].split())


def test_articles_of_awkward_texts(spark, docs, rows, empty):
    digest = F.sha2(media.payload_column(F.col("text")), 256)
    page = lambda df: df.select(F.struct("doc_id", "score").alias("page"), media.article(F.col("text"), digest).alias("html"))
    got = Counter((r["page"]["doc_id"], tuple((i["kind"], i["text"]) for i in r["sequence"])) for r in media.sequences(page(docs), "page").collect())
    expected = Counter()
    for doc_id, text, *_ in rows:
        first, *rest = [" ".join(x.split()) for x in (text or "").split("\n")]
        passages = [("text", x) for x in rest if x]
        expected[(doc_id, tuple([("text", first)] * bool(first) + [("media", None)] + passages + [("media", None)]))] += 1
    assert got == expected
    assert media.references(media.sequences(page(empty), "page")).count() == 0 and media.features(media.store(empty)).count() == 0
    refs = media.references(media.sequences(page(docs), "page")).collect()
    assert len(refs) == 2 * len(rows) and Counter(r["caption"] for r in refs)["payload"] == len(rows)


def test_pages_lose_no_text(spark, sf):
    import html as entities
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    raw_html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in media.sequences(pages, "page_id").collect():
        body = re.sub(r"(?s)<head>.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->|<!DOCTYPE[^>]*>", "", raw_html[r["page_id"]])
        said = entities.unescape(re.sub(r"<[^>]*>", " ", body)).split()
        assert "".join(said) == "".join("".join(i["text"].split()) for i in r["sequence"] if i["kind"] == "text")
        assert [i["position"] for i in r["sequence"]] == list(range(len(r["sequence"])))


def test_interleaved_sequences(spark):
    html = '<head><title>no</title></head><p>one <b>two</b><script>x</script><figure><img src="sha256:d1"><figcaption>cap <i>tion</i></figcaption></figure>three<img src="d2" alt="alt"><p>four &amp; five'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>open <figure><img src=q>")], "page_id long, html string")
    got = {r["page_id"]: [(i["position"], i["kind"], i["text"], i["digest"], i["caption"]) for i in r["sequence"]] for r in media.sequences(pages, "page_id").collect()}
    assert got[1] == [(0, "text", "one two", None, None), (1, "media", None, "d1", "cap tion"), (2, "text", "three", None, None), (3, "media", None, "d2", "alt"), (4, "text", "four & five", None, None)]
    assert got[2] == [] and got[3][1][3] == "q"
    described = spark.createDataFrame([("d1", 7)], "digest string, payload_bytes long")
    back = {r["digest"]: (r["position"], r["caption"], r["payload_bytes"]) for r in media.resolve(media.references(media.sequences(pages, "page_id")), described).collect()}
    assert back == {"d1": (1, "cap tion", 7), "d2": (3, "alt", None), "q": (1, None, None)}


def test_mixing(docs, empty):
    got = mixing.mix(docs, weights={"s0": 3.0, "s1": 1.0}).select("source", "doc_id", "copy_no", "repetition_rate").collect()
    assert {r["source"] for r in got} <= {"s0", "s1"}
    salted = mixing.mix(docs, weights={"s0": 3.0, "s1": 1.0}, broadcast_sources=0).select("source", "doc_id", "copy_no", "repetition_rate").collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, salted))
    assert mixing.mix(empty).count() == 0 and mixing.mix(docs, weights={}).count() == 0


def test_mixing_counts_are_poisson(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") % 4 == 0, "b").otherwise("a").alias("source"))
    got = {(r["source"]): r for r in mixing.mix(docs, weights={"a": 1.0, "b": 1.0}).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("copy_no").alias("most")).collect()}
    assert abs(got["a"]["n"] - 10_000) < 400 and abs(got["b"]["n"] - 10_000) < 400 and got["b"]["most"] > 5
    keys = [r["shuffle_key"] for r in mixing.mix(docs.limit(500)).select("shuffle_key").collect()]
    assert len(set(keys)) == len(keys)
