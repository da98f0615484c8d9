"""Near-duplicates, language, quality, pieces, neighbours and archives against brute force."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import common, components, langid, neardup, neighbours, pieces, quality, shingles, warc
from tests.llm.conftest import words


def shingle_sets(texts):
    out = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) if x]
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def classes(ids, texts):
    sets = shingle_sets(texts)
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = {}
    for k in range(len(ids)):
        groups.setdefault(find(k), []).append(ids[k])
    return {ids[k]: (len(sets[k]), min(groups[find(k)])) for k in range(len(ids))}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for g in range(25):
        base = words(rng, rng.choice([3, 6, 30, 120]))
        for _ in range(rng.choice([1, 2, 8])):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(["edit", "other", "Third"])
            rows.append((len(rows) * 7 % 1009, rng.choice([" ", "\n"]).join(w)))
    # A chain: each links with the next, the ends don't; and a group whose members differ more from its first.
    chain = words(rng, 80)
    for k in range(6):
        rows.append((2000 + k, " ".join(chain[4 * k : 4 * k + 60])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes([r[0] for r in rows], [r[1] for r in rows])


def test_loose_groups_lose_no_link(spark):
    rng = random.Random(8)
    base, rows = words(rng, 100), []
    for k in range(40):
        w = list(base)
        for p in rng.sample(range(100), rng.choice([0, 1, 3, 4, 5])):
            w[p] = f"w{k}x{p}"
        rows.append((k, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(*map(list, zip(*rows)))


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(odd_docs).collect()]
    assert len(got) == odd_docs.count()
    by = {g[0]: g[1:] for g in got}
    assert by[1][1:] == (0, False) and by[2][1:] == (0, False) and by[7] == (1, 6, False)
    assert by[3] == (0, 3, True) and by[4] == (0, 4, True) and by[5] == (0, 5, True) and by[None] == (1, None, True)
    assert neardup.near_duplicates(no_docs).count() == 0
    stay = neardup.deduplicated(odd_docs)
    assert stay.columns == odd_docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in stay.collect()) == sorted({(g[0] is None, g[0] or 0) for g in got if g[3]})


def test_null_and_repeated_ids_lose_no_text(spark):
    rng = random.Random(10)
    texts = [" ".join(words(rng, 60)) for _ in range(9)]
    near = lambda t: t + " end"
    rows = [(None, texts[0]), (None, texts[1]), (None, near(texts[1])), (None, texts[2]), (40, near(texts[2])), (5, texts[3]), (5, texts[4]), (6, near(texts[4])), (6, texts[5]), (3, near(texts[5]))]
    rows += [(7, texts[6]), (7, near(texts[6])), (8, texts[7]), (8, texts[7]), (None, ""), (None, None), (None, ""), (9, " "), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [(r["doc_id"], r["text"]) for r in neardup.deduplicated(docs).collect()]
    left = Counter(out)
    assert left[None, texts[0]] == 1 and left[None, texts[1]] + left[None, near(texts[1])] == 1
    assert left[None, texts[2]] == 0 and left[40, near(texts[2])] == 1
    assert left[5, texts[3]] == 1 and left[5, texts[4]] == 1 and left[6, near(texts[4])] == 0 and left[6, texts[5]] == 0 and left[3, near(texts[5])] == 1
    assert left[7, texts[6]] + left[7, near(texts[6])] == 1 and left[8, texts[7]] == 1
    assert left[None, ""] == 2 and left[None, None] == 1 and left[9, " "] == 1 and left[9, ""] == 1 and len(out) == 13


def test_superminhash_estimates_similarity_with_less_variance():
    rng = np.random.default_rng(9)
    errors = []
    for _ in range(60):
        pool = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = np.sort(pool[:200]), np.sort(pool[50:250])
        x, y = neardup.superminhash(a), neardup.superminhash(b)
        errors.append((x == y).mean() - 150 / 250)
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < np.sqrt(0.6 * 0.4 / neardup.SIGNATURE) * 1.1
    one = neardup.superminhash(np.array([5], np.uint64))
    assert sorted(int(v >> 56) for v in one) == list(range(neardup.SIGNATURE))  # a lone element takes every rank once


def test_shingles_merge_in_pieces():
    big = np.sort(np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64))
    merged = np.minimum(neardup.superminhash(big[:8192]), np.minimum(neardup.superminhash(big[8192:16384]), neardup.superminhash(big[16384:])))
    np.testing.assert_array_equal(neardup.superminhash(big), merged)
    assert len(shingles.shingle_set(b"a b c", shingles.WordHashes())) == 1 and not len(shingles.shingle_set(None, shingles.WordHashes()))


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def tongue(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_languages_and_mixtures(spark, odd_docs, no_docs):
    rng = random.Random(10)
    letters = {"aa": "abcdefg", "bb": "mnopqrs", "cc": "uvwxyzé"}
    rows = [(i, tongue(rng, letters[k], 40), k) for i, k in enumerate(rng.choice(sorted(letters)) for _ in range(90))]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted(letters)
    mixed = tongue(rng, letters["aa"], 30) + " " + tongue(rng, letters["bb"], 10)
    names, scores = langid.identify([tongue(rng, letters["cc"], 20), mixed, None, "", "12 !", "ABC gfe"], model)
    assert names[:2] == ["cc", "aa"] and names[2:5] == ["und"] * 3 and names[5] == "aa"
    assert scores[0] == pytest.approx(1) and scores[1] == pytest.approx(0.75, abs=0.05) and list(scores[2:5]) == [0, 0, 0]
    together = langid.identify([r[1] for r in rows], model)
    alone = [langid.identify([r[1]], model) for r in rows]
    assert together[0] == [a[0][0] for a in alone]
    assert langid.predict(odd_docs, model).count() == odd_docs.count() and langid.predict(no_docs, model).count() == 0
    nothing = langid.fit(no_docs)
    assert {r["lang_pred"] for r in langid.predict(odd_docs, nothing).collect()} == {"und"}
    assert langid.predicted(odd_docs, model).columns == [*odd_docs.columns, "__lang_pred", "__lang_score"]


def plain_em(likelihood, members, rounds):
    """(proportions, log-likelihood) of one document's mixture of the member languages, word by word."""
    theta = {k: 1 / len(members) for k in members}
    columns = likelihood.T.tolist()
    for _ in range(rounds):
        share = dict.fromkeys(members, 0.0)
        for w in columns:
            total = sum(theta[k] * w[k] for k in members)
            for k in members:
                share[k] += theta[k] * w[k] / total
        theta = {k: v / len(columns) for k, v in share.items()}
    return theta, sum(np.log(sum(theta[k] * w[k] for k in members)) for w in columns)


def test_mixtures_equal_plain_em_over_every_language_set(spark):
    rng = random.Random(20)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop", "dd": "xyzabxyz"}
    model = langid.fit(spark.createDataFrame([(tongue(rng, letters[k], 60), k) for k in letters for _ in range(20)], "text string, lang string"))
    texts = [" ".join(tongue(rng, letters[k], n) for k, n in rng.choice([[("aa", 12)], [("bb", 40)], [("aa", 30), ("cc", 25)], [("dd", 9), ("bb", 9)], [("aa", 30), ("bb", 30), ("cc", 30)]])) for _ in range(40)]
    names, scores = langid.identify(texts, model)
    same = 0
    for text, name, score in zip(texts, names, scores, strict=True):
        buckets, first, words_of = langid.trigrams([text])
        log_p = np.stack([np.add.reduceat(c[buckets], first) for c in model.log_p]).astype(float)
        likelihood = np.maximum(np.exp(log_p - log_p.max(axis=0)), 1e-30)
        price = langid.PENALTY * np.log(words_of[0] + 1) / 2
        every = [m for size in range(1, 5) for m in itertools.combinations(range(4), size)]
        fits = {m: plain_em(likelihood, m, langid.ROUNDS) for m in every}
        best = max(every, key=lambda m: (fits[m][1] - len(m) * price, -len(m)))
        theta = fits[best][0]
        top = min(theta, key=lambda k: (-theta[k], k))
        same += (model.languages[top], round(theta[top], 3)) == (name, round(float(score), 3))
    assert same >= 39  # nested sets may miss the best set, once


def test_trigram_counts_equal_plain_python():
    text = "  Ab éX-9z a\n"
    buckets, first, counts = langid.trigrams([text, "", "q"])
    tokens = re.findall(r"[^\W\d_]+", text.lower())
    assert len(buckets) == sum(map(len, tokens)) + 1 and counts.tolist() == [len(tokens), 0, 1] and len(first) == len(tokens) + 1


def test_quality_separates_and_calibrates(spark, odd_docs, no_docs):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        w = words(rng, rng.randint(5, 60))
        docs.append((i, " ".join(w if good else [x.upper() + "!!" for x in w])))
        labels.append((i, int(good)))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality.assess(d, y).collect()}
    held = [i for i in out if out[i]["held_out"]]
    assert len(held) > 40
    assert np.mean([out[i]["predicted"] == labels[i][1] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out.values())
    again = {r["doc_id"]: r["score"] for r in quality.assess(d.repartition(7), y.repartition(3)).collect()}
    assert again == {i: r["score"] for i, r in out.items()}
    lab = odd_docs.select("doc_id", F.lit(1).alias("quality"))
    assert quality.assess(odd_docs, lab).count() == odd_docs.count()
    assert quality.assess(no_docs, lab).count() == 0
    assert {r["score"] for r in quality.assess(odd_docs, lab.limit(0)).collect()} == {1.0}


def test_word_vectors_and_pooling_equal_plain_python(spark, odd_docs):
    import xxhash

    texts = [r["text"] for r in odd_docs.collect()]
    places, signs = quality._index_vectors()
    index = np.zeros((quality.ROWS, quality.DIMENSIONS))
    for row in range(quality.ROWS):
        for p, s in zip(places[row], signs[row], strict=True):
            index[row, p] = s

    def rows(text):
        words_of = (text or "").split()
        word = [xxhash.xxh3_64_intdigest(w.lower()) % quality.WORDS for w in words_of]
        shape = [1 + xxhash.xxh3_64_intdigest(quality.outline(w)) % (quality.SHAPES - 1) for w in words_of]
        return word, [quality.REPEATED if k and word[k] == word[k - 1] else s for k, s in enumerate(shape)]

    total = np.zeros((quality.ROWS, quality.DIMENSIONS))
    for text in texts:
        word, shape = rows(text)
        for k in range(len(word)):
            for j in (k - 1, k + 1):
                if 0 <= j < len(word):
                    total[word[k]] += index[word[j]]
                    total[quality.WORDS + shape[k]] += index[quality.WORDS + shape[j]]
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    expected = np.where(norm > 0, total / np.maximum(norm, 1e-9), 0)
    vectors = quality.word_vectors(odd_docs)
    np.testing.assert_allclose(vectors, expected, atol=1e-6)

    got = quality.pooled(texts, vectors, quality._Codes())
    for text, x in zip(texts, got, strict=True):
        word, shape = rows(text)
        if not word:
            assert not x.any()
            continue
        outlines = np.array([vectors[quality.WORDS + s] for s in shape], float)
        plain = [np.mean([vectors[w] for w in word], axis=0), outlines.mean(axis=0), (outlines**2).mean(axis=0), [np.log1p(len(word))]]
        np.testing.assert_allclose(x, np.concatenate(plain), atol=2e-4)


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(21)
    x, y = rng.normal(size=(30, 5)), rng.integers(0, 2, 30).astype(float)
    values = [rng.normal(size=(5, 4)), rng.normal(size=4), rng.normal(size=4), np.array(0.3)]

    def loss(w1, b1, w2, b2):
        z = np.tanh(x @ w1 + b1) @ w2 + b2
        return np.mean(np.logaddexp(0, z) - y * z) + quality.DECAY / 2 * ((w1**2).sum() + (w2**2).sum())

    for k, g in enumerate(quality.gradients(*values, x, y)):
        numeric = np.zeros_like(values[k])
        for at in np.ndindex(values[k].shape):
            up, down = ([v.copy() for v in values] for _ in range(2))
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            numeric[at] = (loss(*up) - loss(*down)) / 2e-6
        np.testing.assert_allclose(g, numeric, atol=1e-7)


CLASH = ["__text", "__score", "__lang_pred", "__lang_score", "__h", "__kept", "__k1", "__k2", "__alone", "__row", "k1", "row", "alone", "text_", "lang_pred"]


def test_clashing_columns_pass_through(spark, vocabulary):
    rng = random.Random(22)
    rows = [(i, " ".join(words(rng, 30)), "en", "a", *[f"{c} {i}" for c in CLASH]) for i in range(30)]
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASH))
    labels = docs.select("doc_id", F.lit(1).alias("quality")).distinct()
    every = Counter(map(tuple, docs.collect()))
    for out in (quality.accepted(docs, *quality.fit(docs, labels)), langid.identified(docs, langid.fit(docs))):
        assert out.columns == docs.columns and Counter(map(tuple, out.collect())) == every
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns and set(map(tuple, kept.collect())) == set(rows) and kept.count() == 30
    assert quality.scored(docs, *quality.fit(docs, labels)).columns == [*docs.columns, "___score"]
    out = pieces.encode(docs, vocabulary, keep=("doc_id", "__text"))
    assert {(r["doc_id"], r["__text"]) for r in out.collect()} == {(r[0], r[4]) for r in rows}


def test_slices_hold_every_row(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(common, "BATCH_BYTES", 10)
    texts = ["a" * 3, None, "b" * 50, "", "c" * 4, "d" * 4, "é" * 3, None]
    got = list(common.slices(iter([pa.RecordBatch.from_pydict({"i": list(range(8)), "t": texts}), pa.RecordBatch.from_pydict({"i": pa.array([], pa.int64()), "t": pa.array([], pa.string())})]), 1))
    assert [x for b in got for x in b.column(1).to_pylist()] == texts and len(got) > 3


def test_held_out_labels_are_not_used(spark):
    rng = random.Random(12)
    d = spark.createDataFrame([(i, " ".join(words(rng, 20))) for i in range(100)], "doc_id long, text string")
    y = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    flipped = y.withColumn("quality", F.when(quality.id_remainder("doc_id", 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.assess(d, x).collect())) for x in (y, flipped))
    assert a == b


@pytest.fixture(scope="module")
def vocabulary():
    pytest.importorskip("sentencepiece")
    return pieces.load()


def test_pieces_equal_the_library_and_come_back(vocabulary, odd_docs):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(pieces.DEFAULT_MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1  # the library's Viterbi over the same pieces
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    codec = pieces.Codec(vocabulary)
    rng = random.Random(13)
    for k in range(300):
        text = " ".join(words(rng, rng.randint(0, 9))) + rng.choice(["", " ", "  ", ". The end", "Ünïted"])
        ids = np.frombuffer(codec.encode(text), np.int32)
        assert ids.tolist() == library.encode(text) and codec.decode(ids) == text
    for r in odd_docs.collect():
        assert codec.decode(np.frombuffer(codec.encode(r["text"]), np.int32)) == (r["text"] or "")


def test_viterbi_equals_every_segmentation():
    v = pieces.Vocabulary(("<unk>", "a", "b", "ab", "ba", "aba", "▁", "▁a"), (0.0, -3.0, -2.0, -4.0, -4.5, -6.0, -1.0, -3.5), ("unknown", *["normal"] * 7))
    codec, score = pieces.Codec(v), {p.replace("▁", " "): s for p, s in zip(v.pieces[1:], v.scores[1:])}

    def best(text):
        return 0.0 if not text else max(score[text[:k]] + best(text[k:]) for k in range(1, len(text) + 1) if text[:k] in score)

    rng = random.Random(14)
    for _ in range(200):
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 9)))
        assert sum(v.scores[i] for i in codec.best_path(text)) == pytest.approx(best(text))


def test_encode_and_decode_tables(vocabulary, odd_docs, no_docs):
    out = pieces.encode(odd_docs, vocabulary, keep=("doc_id", "size"))
    rows = out.collect()
    assert len(rows) == odd_docs.count() and all(r["round_trip"] for r in rows) and {r["size"] for r in rows} == {7}
    back = {(r["doc_id"], r["text"]) for r in pieces.decode(out, vocabulary).collect()}
    assert back == {(r["doc_id"], r["text"] or "") for r in odd_docs.collect()}
    assert pieces.encode(no_docs, vocabulary).count() == 0


def nearest_in_numpy(x, ids, queries, k):
    out = {}
    for q in queries:
        s = (x * x[q]).sum(axis=1)
        order = sorted((i for i in range(len(ids)) if ids[i] != ids[q]), key=lambda i: (-s[i], ids[i]))[:k]
        out[ids[q]] = [(ids[i], s[i]) for i in order]
    return out


@pytest.mark.parametrize("cells", [None, 40])
def test_neighbours_reach_recall(spark, monkeypatch, cells):
    if cells:
        monkeypatch.setattr(neighbours, "VECTORS_PER_CELL", 3000 // cells)
        monkeypatch.setattr(neighbours, "BLOCK", 64)
        monkeypatch.setattr(neighbours, "QUERIES_PER_BLOCK", 16)
    rng = np.random.default_rng(15)
    x = rng.normal(size=(3000, 48)) + 2 * rng.normal(size=(12, 48))[rng.integers(0, 12, 3000)]
    x[1:300] = x[0]  # one common vector
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    exact = nearest_in_numpy(x.astype(float), list(range(3000)), range(0, 3000, 20), 20)
    assert set(got) == set(exact) and all(len(v) == 20 for v in got.values())
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in exact[q]}) for q in exact)
    assert hit / (20 * len(exact)) >= 0.97
    assert all(s == pytest.approx((x[q].astype(float) * x[i].astype(float)).sum(), abs=1e-12) for q in got for i, s in got[q])
    assert [i for i, _ in got[20]] == sorted(i for i in range(300) if i != 20)[:20]  # ties: smaller ids


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_beyond_the_sample(spark, monkeypatch, clustered):
    """The index, not the sample, decides: 8,000 vectors, of which 1,000 are in the sample."""
    monkeypatch.setattr(neighbours, "SAMPLE", 1000)
    monkeypatch.setattr(neighbours, "VECTORS_PER_CELL", 250)
    monkeypatch.setattr(neighbours, "BLOCK", 1000)
    rng = np.random.default_rng(17)
    x = rng.normal(size=(8000, 64)) + (2 * rng.normal(size=(30, 64))[rng.integers(0, 30, 8000)] if clustered else 0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    exact = nearest_in_numpy(x, list(range(8000)), range(0, 8000, 20), 20)
    recall = sum(len(got[q] & {i for i, _ in exact[q]}) for q in exact) / (20 * len(exact))
    print(f"recall beyond the sample, clustered {clustered}: {recall:.4f}")
    assert set(got) == set(exact) and recall >= 0.95


def test_counted_bits_estimate_as_a_product_would():
    rng = np.random.default_rng(18)
    x, q = rng.normal(size=(300, 100)), rng.normal(size=(20, 100))
    rotation = np.linalg.qr(rng.normal(size=(100, 100)))[0]
    codes = neighbours.Codes.of(x, np.zeros(100), rotation)
    signs = np.where(x @ rotation > 0, 1.0, -1.0)
    upper, error = codes.bounds(q, np.zeros(100), rotation)
    plain = (q @ rotation) @ signs.T * codes.factor
    assert codes.bits.shape == (300, 2) and np.abs(upper - error - plain).max() < 0.15 * np.abs(plain).max()


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [1.0, 0.0]), (9, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, cell string, query_id int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 8, 1.0), (0, 2, 9, 1.0), (0, 3, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 0, 0.5), (20, 3, 8, 0.5), (20, 4, 9, 0.5)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_error_bounds_hold():
    rng = np.random.default_rng(16)
    x, q = rng.normal(size=(500, 64)), rng.normal(size=(50, 64))
    rotation = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    upper, error = neighbours.Codes.of(x, x.mean(axis=0), rotation).bounds(q, x.mean(axis=0), rotation)
    assert (q @ x.T <= upper + 1e-3).mean() > 0.985
    assert abs((upper - error - q @ x.T).mean()) < 0.05 * np.abs(q @ x.T).mean()


PAGES = "page_id long, url string, html string, `offset` int, file string"


def test_archives_come_back(spark):
    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "http://c\r\nX: y", "é\r\n\r\nWARC/1.1\r\n" * 5), (6, "big", "z" * 300_000), (None, "n", "<p>x</p>"), (None, "n", "only null"), (2, "http://b", "<p>x</p>")]
    df = spark.createDataFrame([(*r, 1, "f") for r in rows], PAGES).repartition(3)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()), key=str)
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(i, largest.get(h or "", i))
    expected = []
    for i, _, h in rows:
        b, top = (h or "").encode(), largest.get(h or "")
        revisit = top is not None and i != top
        expected.append((i, len(b), warc.digest(b), "revisit" if revisit else "response", top if revisit else None))
    assert got == sorted(expected, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_selected_records_are_read_in_ranges(spark):
    from strandline.llm.common import new_folder

    df = spark.createDataFrame([(i, f"http://x/{i}", f"page {i} " * 20, 1, "f") for i in range(200)], PAGES)
    folder = new_folder(spark, "warc")
    index = warc.write(df, folder)
    got = {r["page_id"]: r["payload"].decode() for r in warc.read(index.filter("url LIKE '%7'"), folder).collect()}
    assert got == {i: f"page {i} " * 20 for i in range(7, 200, 10)}
    groups = list(warc._reads([("a", 0, 10), ("a", 10, 5), ("a", 10**6, 5), ("b", 0, warc.READ + 1), ("b", warc.READ + 1, 1)]))
    assert [len(g) for g in groups] == [2, 1, 1, 1]


def test_release_deletes_what_was_written(spark):
    from pathlib import Path

    from strandline.llm import common

    df = common.materialize(spark.range(10), "some")
    folder = Path(common._FOLDERS[-1].removeprefix("file://"))
    assert df.count() == 10 and folder.exists()
    common.release(spark)
    assert not folder.exists() and common._FOLDERS == []


def test_a_document_paired_with_a_large_group_fills_no_cell(spark):
    n = 40 * neardup.CHUNK
    pairs = {"last": [(0, k, n) for k in range(n)], "first": [(0, 0, k) for k in range(1, n + 1)]}
    for rows in pairs.values():
        cells = neardup._cells(spark.createDataFrame(rows, "g long, a long, b long"))
        assert {(r["a"], r["b"]) for r in cells.collect()} == {(a, b) for _, a, b in rows}
        assert cells.groupBy("cell").count().agg(F.max("count")).first()[0] < 2 * neardup.CHUNK


def test_records_of_one_id_and_urls_with_line_breaks(spark):
    from strandline.llm.common import new_folder

    rows = [(1, "http://a/\r\nX-Evil: 1", "one"), (1, "http://b", "two"), (2, None, "one"), (2, None, "one")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = new_folder(spark, "warc")
    out = warc.read(warc.write(df, folder), folder).collect()
    assert Counter((r["page_id"], r["url"]) for r in out) == Counter((i, u) for i, u, _ in rows)
    assert {r["refers_to"] for r in out if r["record_type"] == "revisit"} == {2}
    a = warc.record(1, None, b"one", warc.digest(b"one"), 2, True)
    b = warc.record(2, None, b"one", warc.digest(b"one"), 2, False)
    assert warc.parse(a)[0]["WARC-Refers-To"] == warc.parse(b)[0]["WARC-Record-ID"] != warc.parse(warc.record(2, None, b"x", warc.digest(b"x"), None, False))[0]["WARC-Record-ID"]


def test_remembered_keys_are_bounded_and_released():
    class Squares(common.Remembered):
        LIMIT, OPERATOR = 10, "squares"
        asked = 0

        def made(self, key):
            self.asked += 1
            return key * key

    s = Squares()
    for k in range(1000):
        assert s[k % 3] == (k % 3) ** 2 and s[k] == k * k
        assert len(s) + len(s.older) <= 20
    assert s.asked < 1100  # the three in use are hardly ever made again
    common.Remembered.begin("squares")
    assert s
    common.Remembered.begin("other")
    assert not s and not s.older
