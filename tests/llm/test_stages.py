"""The pipeline's stages on awkward tables: clashing names, nulls, ties, repeated rows, long texts, no rows."""

import hashlib
import importlib.util
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from locusframe.llm import exact_dedup, language, mixing, pieces, quality, similar

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not here")

#: Columns that operators use inside, or give to their results, and some that need quoting.
INNER = """score lang_pred lang_text held_out gram own_id own_sha256 own_text row_key local_key keep_id keep_row kept group_size text_sha256 copies body length content_hash
thresholds mix_source mix_salt copy_no repetition_rate shuffle_key node label class_id n_links copy_of n_copies root roots tail tails prefix blocks own other low high family links
a b u v m set_a set_b shingles sketch ids decoded piece_text row training symbols rare word c c0 c1 c2""".split() + ["a.b", "with space", "_metadata"]  # and a struct with field names to quote: ``odd``  # fmt: skip


def brute_stages(rows):
    """Which (doc_id, text) the filtering stages keep: by language, exact copies, near copies."""
    least = {}
    for doc_id, text in rows:
        key = exact_dedup.normalised((text or "").encode())
        rank = (doc_id is None, doc_id or 0)
        least[key] = min(least.get(key, rank), rank)
    exact = Counter((None if missing else doc_id, key) for key, (missing, doc_id) in least.items())
    sets = [frozenset(shingles(t)) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        groups[root(i)].append((-(1 << 63) if doc_id is None else doc_id, i))
    near = Counter(rows[min(group)[1]] for group in groups.values())
    return exact, near


def shingles(text):
    w = (text or "").encode().lower().split()
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    say = lambda n, of: " ".join("".join(rng.choice(of) for _ in range(rng.randint(1, 4))) for _ in range(n))
    one, two = ("ba", "ro", "ti", "mu", "ken"), ("xa", "zu", "qi", "wy")
    long = say(20_000, one)
    near = long.split()
    near[7_000:7_010] = say(10, one).split()
    made = [(i, say(rng.randint(30, 90), one if i % 2 else two)) for i in range(100, 150)]
    made += [(1, None), (2, ""), (3, " \n"), (4, "12 -- 34"), (5, long), (6, long), (7, " ".join(near)), (8, long.replace(" ", "\t")), (None, made[0][1]), (None, None), (5, long), (9, made[3][1]), (10, made[3][1]), (11, "ro ba"), (12, "ro  ba"), (13, "a" * 30_000)]
    return made


@pytest.fixture(scope="module")
def docs(spark, rows):
    plain = spark.createDataFrame([(i, t, ("aa" if k % 2 else "bb") if i and i >= 100 else None, f"s{k % 3}" if k % 5 else None, len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars int")
    odd = F.struct(F.col("doc_id").alias("a-b"), F.array(F.struct(F.lit(1).alias("x y"), F.lit("z").alias("c:d"))).alias("`q`"))
    return plain.withColumns({c: F.concat(F.lit(c + "-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in INNER} | {"odd": odd}).repartition(4).cache()


def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


def taken(df):
    """Rows by (doc_id, text), after a look at the columns that the stage only hands on."""
    got = df.collect()
    for r in got:
        assert all(r[c] == f"{c}-{'none' if r['doc_id'] is None else r['doc_id']}" for c in INNER)
        assert r["odd"]["a-b"] == r["doc_id"] and r["odd"]["`q`"][0]["x y"] == 1
    return Counter((r["doc_id"], r["text"]) for r in got)


def test_every_stage_keeps_the_columns_and_takes_empty_tables(spark, sf, docs):
    for name, stage in stages().items():
        none = stage(spark, docs.where("false"), sf)
        assert none.count() == 0
        assert none.columns == (docs.columns if name != "sentencepiece" else ["doc_id", "source", "ids", "decoded"])


def test_language_stage(spark, sf, docs, rows):
    got = taken(stages()["language_id"](spark, docs, sf))
    rejected = {1, 2, 3, 4}
    assert got == Counter((i, t) for i, t in rows if i not in rejected and t and (i != 13))


def test_exact_dedup_stage(spark, sf, docs, rows):
    got = taken(stages()["exact_dedup"](spark, docs, sf))
    assert Counter((i, exact_dedup.normalised((t or "").encode())) for i, t in got.elements()) == brute_stages(rows)[0]


def test_near_dedup_stage(spark, sf, docs, rows):
    assert taken(stages()["ngram_jaccard"](spark, docs, sf)) == brute_stages(rows)[1]


def test_mixing_stage(spark, sf, docs, rows):
    got = taken(stages()["mixing"](spark, docs, sf))
    counts = {(r["doc_id"], r["text"]): r["count"] for r in mixing.mix(docs.select("doc_id", "text", "source")).groupBy("doc_id", "text").count().collect()}
    assert got == Counter(counts)
    results = mixing.mix(docs)
    assert Counter(results.columns) == Counter(docs.columns) and all(r["copy_no"] >= 1 for r in results.select("copy_no").collect())


def test_sentencepiece_stage(spark, sf, docs, rows):
    import public_tokenizers

    library = pieces.model(public_tokenizers.path("piece_bpe_32k.model")).library
    got = Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in stages()["sentencepiece"](spark, docs, sf).collect())
    assert got == Counter((i, (*library.encode(t or ""), 2), library.decode([*library.encode(t or ""), 2])) for i, t in rows)


def brute_copies(kept):
    """How often each (doc_id, text, source) is repeated: the inverse Poisson distribution at an md5 draw."""
    size = Counter()
    for _, text, source in kept:
        size[source or ""] += len(text or "") + 1
    whole, weight = sum(size.values()), sum(math.sqrt(n) for n in size.values())
    copies = Counter()
    for doc_id, text, source in kept:
        n = size[source or ""]
        rate = math.sqrt(n) * whole / (weight * n)
        draw = int(hashlib.md5(f"mix-1|{'' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        mass, total, k = math.exp(-rate), 0.0, 0
        while total + mass <= draw:
            total, k = total + mass, k + 1
            mass *= rate / k
        copies[doc_id, text] += k
    return copies


def test_pipeline_by_brute_force(spark, tmp_path, docs):
    import corpus_pipeline
    import public_tokenizers

    source = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")))  # repeated rows are alike
    docs = docs.select("doc_id", "text", "lang", source.alias("source"), "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect() if r["doc_id"] not in (1, 2, 3, 4, 13) and r["text"]]
    exact, _ = brute_stages([r[:2] for r in kept])
    kept = list({(i, exact_dedup.normalised(t.encode())): (i, t, s) for i, t, s in kept if (i, exact_dedup.normalised(t.encode())) in exact}.values())
    _, near = brute_stages([r[:2] for r in kept])
    copies = brute_copies([r for r in kept if r[:2] in near])
    library = pieces.model(public_tokenizers.path("piece_bpe_32k.model")).library
    expected = Counter()
    for (doc_id, text), n in copies.items():
        expected[doc_id, (*library.encode(text), 2)] += n
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == +expected


def test_operators_that_name_results_after_input_columns(docs):
    filters = language.fit(docs.where("doc_id >= 100"))
    named = language.predict(docs, filters, keep=("doc_id", "score", "lang_text"))
    assert named.columns == ["doc_id", "lang_text", "lang_pred", "score"] and named.schema["score"].dataType.simpleString() == "double"
    import public_tokenizers

    coded = pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id", "ids", "decoded", "odd", "piece_text"))
    assert coded.first()["odd"]["`q`"][0]["c:d"] == "z"
    assert coded.columns == ["doc_id", "odd", "piece_text", "ids", "decoded"] and coded.schema["ids"].dataType.simpleString() == "array<int>"


# Brute force of the quality classifier's features and of the language filters

MASK = (1 << 64) - 1
K = 0x9E3779B97F4A7C15


def finish(h):
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & MASK
    return h ^ (h >> 31)


def rolled(values):
    return sum(v * pow(K, i, 1 << 64) for i, v in enumerate(values)) & MASK


def brute_features(text, buckets, repetition=False):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = low.split()
    made = [finish(rolled([finish(b + 1) for b in w])) for w in words]
    for i, w in enumerate(words if repetition else []):
        token = 0
        for period in range(1, quality.PERIODS + 1):
            if i >= period and words[i - period] == w:
                token = 2 * period + (i >= period + 1 and words[i - 1 - period] == words[i - 1])
                break
        made.append(finish((token + 0xABCD) & MASK))
    for n in quality.NGRAMS:
        made += [finish((rolled([b + 1 for b in low[i : i + n]]) + n) & MASK) for i in range(len(low) - n + 1)]
    return Counter(h >> (64 - (buckets - 1).bit_length()) for h in made)


def test_quality_features_and_scores_by_brute_force(spark, sf):
    texts = [None, "", "a", "Ab ab AB ab", "one two one two one two", "Zoé  ünï\tcode 漢字", "x" * 40, "the quick brown fox " * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    d, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    classifier = quality.fit(d, labels, max_rows=60, epochs=2)
    import numpy as np
    import pyarrow as pa

    buckets = len(classifier.embedding)
    found, row = quality.features(pa.array(texts, pa.string()), buckets)
    for i, t in enumerate(texts):
        assert Counter(found[row == i].tolist()) == brute_features(t, buckets), t
    found, row = quality.features(pa.array(texts, pa.string()), buckets, repetition=True)
    for i, t in enumerate(texts):
        assert Counter(found[row == i].tolist()) == brute_features(t, buckets, repetition=True), t
    for r in quality.score(docs, classifier).collect():
        counted = brute_features(texts[r["doc_id"]], buckets)
        total = sum(counted.values())
        mean = sum((classifier.embedding[b] * (n / total) for b, n in counted.items()), np.zeros(classifier.embedding.shape[1]))
        logits = np.exp(mean @ classifier.output + classifier.bias)
        assert r["score"] == pytest.approx(logits[1] / logits.sum(), rel=1e-9)


def test_one_step_of_training_follows_the_gradient():
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(np.array([1, 3]), np.array([0.25, 0.75]), 1), (np.array([0, 2]), np.array([0.5, 0.5]), 0)]
    before = quality.train(rows, 4, 3, 0, 1.0)

    def loss(embedding):
        total = 0.0
        for where, weights, label in rows:
            logits = (weights @ embedding[where]) @ before.output + before.bias
            total -= logits[label] - np.log(np.exp(logits).sum())
        return total

    after = quality.train(rows, 4, 3, 40, 0.05)
    assert loss(before.embedding) > sum(-np.log(np.exp((w @ after.embedding[i]) @ after.output + after.bias)[y] / np.exp((w @ after.embedding[i]) @ after.output + after.bias).sum()) for i, w, y in rows)
    assert rng is not None


def grams(text):
    low = b" " + text.lower().encode() + b" " * language.NGRAM
    clean = bytes((b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32) for b in low)
    return [clean[i : i + 5] for i in range(len(clean) - language.NGRAM) if clean[i : i + 2] != b"  "]


def test_language_filters_by_brute_force(spark, docs):
    training = docs.where("doc_id >= 100")
    learnt = language.fit(training, bits=12)
    seen, sizes = defaultdict(Counter), Counter()
    for r in training.collect():
        sizes[r["lang"]] += 1
        for g in set(grams(r["text"])):
            seen[g][r["lang"]] += 1
    slot = lambda g, k: finish(rolled([b + 1 for b in g])) >> (12 * k) & 4095
    masks = [0] * 4096
    for g, by in seen.items():
        for i, name in enumerate(learnt.languages):
            if by[name] >= max(1, sizes[name] * language.LEAST_SHARE):
                for k in range(language.HASHES):
                    masks[slot(g, k)] |= 1 << i
    assert learnt.languages == sorted(sizes) and learnt.masks[:, 0].tolist() == masks
    wrong = [(sum(m >> i & 1 for m in masks) / 4096) ** language.HASHES for i in range(len(sizes))]
    assert learnt.false_positive == pytest.approx(wrong)
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id >= 5").collect()}
    for r in language.predict(docs.where("doc_id >= 5"), learnt).collect():
        own = grams(texts[r["doc_id"]])
        shares = []
        for i in range(len(sizes)):
            hits = sum(all(masks[slot(g, k)] >> i & 1 for k in range(language.HASHES)) for g in own)
            shares.append(min(1, max(0, (hits / len(own) - wrong[i]) / (1 - wrong[i]))))
        assert r["score"] == pytest.approx(max(shares)) and r["lang_pred"] == learnt.languages[shares.index(max(shares))]


def test_more_languages_than_a_word_has_bits(spark):
    rng = random.Random(5)
    names = [f"l{i:03d}" for i in range(150)]
    say = {n: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for n in names}
    docs = spark.createDataFrame([(3 * i + k, " ".join(rng.choices(say[n], k=30)), n) for i, n in enumerate(names) for k in range(3)], "doc_id long, text string, lang string")
    learnt = language.fit(docs)
    assert learnt.masks.shape[1] == 3
    assert all(r["lang"] == r["lang_pred"] for r in language.predict(docs, learnt, ("lang",)).collect())
    assert {r["lang_pred"] for r in language.predict(docs, language.fit(docs, max_docs=0)).collect()} == {"l000"}


# Recall of the forest

def test_forest_finds_every_similar_pair_of_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    sets = {i: frozenset(shingles(t)) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    pairs = {(a, b) for own in holders.values() for k, b in enumerate(own) for a in own[:k] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    got = {r["doc_id"]: r for r in similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    met = sum(got[a]["class_id"] == got[b]["class_id"] for a, b in pairs)
    assert len(pairs) > 100 and met / len(pairs) == 1.0
    for i in sets:
        others = {sets[j] for p in pairs if i in p for j in p} - {sets[i]}
        assert got[i]["n_links"] == len(others)


def test_prefixes_are_shortened_until_the_recall_is_met():
    assert similar.prefix_lengths() == [10, 8, 6]
    assert similar.expected_recall(6) >= similar.RECALL > similar.expected_recall(8)
    assert similar.prefix_lengths(trees=400) == [10, 8] or similar.expected_recall(10, 400) >= similar.RECALL
    with pytest.raises(ValueError, match="more trees"):
        similar.prefix_lengths(trees=1)


def test_the_walk_of_the_sorted_forest_connects_and_open_regions_alone_are_compared(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(i, " ".join(base[:100] + [f"x{i}"] + base[101:])) for i in range(20)] + [(100 + i, " ".join(f"y{rng.randrange(10**6)}" for _ in range(50))) for i in range(20)]
    index = similar.indexed(spark.createDataFrame(rows, "doc_id long, text string"), similar.FIVE_WORDS, "doc_id", "text")
    number = {r["node"]: r["doc_id"] for r in index.texts.select("node", "key.doc_id").collect()}
    regions, live = similar.live_entries(index.texts)
    forest = similar.sorted_forest(index.texts, live)
    held = [tuple(r) for r in forest.select(F.spark_partition_id(), "root", "tail", "node").collect()]
    assert {number[h[3]] for h in held} == set(range(20)) and len(held) > 100 and held == sorted(held)
    assert [h[1:] for h in held] == sorted(h[1:] for h in held)  # each partition and all of them
    walked = similar.neighbour_stars(forest, 0.66, 12).collect()
    ends = {r["root"] for r in walked if r["root"] is not None}
    parts = {h[0]: [x[1] for x in held if x[0] == h[0]] for h in held}
    assert ends == {x for own in parts.values() for x in (own[0], own[-1])}
    for window in (1, 3, 30):
        found = similar.connected(similar.forest_stars(index.texts, similar.FIVE_WORDS, 512, window), "t").collect()
        assert {number[r["node"]] for r in found} == set(range(20)) and len({r["label"] for r in found}) == 1


def test_rows_with_one_id_are_told_apart(spark):
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    text, other = words(100), words(80)
    near = " ".join([*text[:60], "changed", *text[61:]])
    rows = [(1, " ".join(text)), (5, near), (5, " ".join(other)), (5, " ".join(text)), (7, None), (None, ""), (None, " "), (5, " ".join(other))]
    rows += [(None, " ".join(words(30))) for _ in range(300)] + [(None, near + " more")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    got = {r["n"] for r in similar.keep_one_of_each(docs).collect()}
    assert got - {2, 7} == set(range(len(rows))) - {0, 1, 2, 3, 7} and len(got & {2, 7}) == 1  # the null id is the least
    found = similar.near_duplicates(docs, block=16).collect()
    assert sum(r["n_links"] for r in found) == 8 and len(found) == len(rows)  # three texts, one of them twice: two links each
    assert Counter(r["class_id"] for r in found if r["doc_id"] == 5) == {-(1 << 63): 2, 5: 2}


def test_shingles_are_the_words_themselves():
    texts = [b"", b"a b", b"A b", b"a b c d e", b"a b c d e f a b c d e", b"c d e f a", b"x"]
    sets = similar.word_shingles(texts)
    own = [frozenset(shingles(t.decode())) for t in texts]
    for x, a in zip(sets, own):
        for y, b in zip(sets, own):
            assert len(np_common(x, y)) == len(a & b)


def np_common(x, y):
    return set(x.tolist()) & set(y.tolist())
