"""License scan, sharding, mixing and fingerprints against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from strandline.llm import common, fingerprints, licenses, mixing, queries, sharding
from tests.llm.conftest import words
from tests.oracle import DATA, agree, connect

SIZE = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    agree(spark, connect("sf0.001"), queries.queries()[name], queries.oracle_sql()[name], "sf0.001")


def scan_in_python(text):
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = [x for x in re.split(licenses.NOT_A_WORD, lower) if x]
    at = lambda p: [i for i in range(len(w)) if w[i : i + len(p)] == p]
    base = {label: at(p.split()) for p, label in licenses.BASE.items()}
    places = sorted(i for v in base.values() for i in v)
    more, score = set(), 1.0 if places else 0.0
    for t in licenses.templates():
        for s in range(-len(t.words), len(w)):
            if all(s + a >= 0 and w[s + a : s + b] == list(t.words[a:b]) for a, b in t.phrases):
                share = sum(s + k >= 0 and w[s + k : s + k + 1] == [x] for k, x in enumerate(t.words)) / len(t.words)
                if share >= licenses.COVERAGE:
                    more.add(t.label)
                    score = max(score, share)
    own = {k for k, v in base.items() if v}
    return len(w), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(own)), ",".join(sorted(own | more)), score


def test_license_scan(spark, odd_docs, no_docs):
    rng = random.Random(2)
    made = []
    for i in range(80):
        w = words(rng, rng.randint(0, 40))
        for _ in range(rng.randint(0, 2)):
            w.insert(rng.randint(0, len(w)), rng.choice([*licenses.NOTICES.values(), *[x for t in licenses.TEXTS.values() for x in t], *[x[: len(x) // 2] for t in licenses.TEXTS.values() for x in t], "CC-BY", "All Rights Reserved", "general public"]).replace("[", "").replace("]", ""))
        made.append((i, " ".join(w)))
    for rows in (made, [(r["doc_id"], r["text"]) for r in odd_docs.collect()]):
        got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert Counter((r["doc_id"], *r[1:]) for r in got) == Counter((i, *scan_in_python(t)) for i, t in rows)
    assert licenses.scan(odd_docs).count() == odd_docs.count() and licenses.scan(no_docs).count() == 0


def test_a_notice_at_the_top_needs_no_lead_in(spark):
    tops = {"Apache License, Version 2.0": ("apache-2.0", 5 / 8), "GNU General Public License version 3": ("gpl,gpl-3.0", 1.0), "The MIT License": ("mit", 3 / 5), "Mozilla Public License v 2.0": ("mpl-2.0", 6 / 12), "under Apache License 2.0": ("", 0.0)}
    rows = [(i, lead + text) for i, text in enumerate(tops) for lead in ("", "x ", "one two three four five six seven ")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        label, score = list(tops.values())[r["doc_id"]]
        assert (r["labels"], r["score"]) == (label, pytest.approx(score))


def test_whole_texts_are_found_by_coverage(spark):
    def broken(t, share):
        """With every n-th word that isn't of a key phrase changed, so that about that share of the words stays."""
        keys = set(licenses._keys(t))
        change = round((1 - share) * len(t.words))
        for k in [k for k in range(len(t.words)) if k not in keys][:change]:
            yield k

    rows, expected = [], {}
    for n, t in enumerate(x for x in licenses.templates() if len(x.words) > 60):
        for j, share in enumerate((1.0, 0.7, 0.3)):
            gone = set(broken(t, share))
            kept = 1 - len(gone) / len(t.words)
            text = " ".join("zzz" if k in gone else w for k, w in enumerate(t.words))
            rows.append((100 * n + j, "intro words " + text))
            expected[100 * n + j] = (t.label in scan_in_python(text)[5].split(","), kept)
            assert expected[100 * n + j][0] or share < 0.5
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(tuple(got[i])[1:] == scan_in_python(text) for i, text in rows)
    assert sum(r["labels"] == "" for r in got.values()) >= 3  # too little of the text is left


def test_postings_prefer_rare_words():
    known = licenses.templates()
    idf = {w: (0.0 if w in ("the", "of", "license") else 5.0) for t in known for w in t.words}
    listed = licenses.postings(known, idf)
    assert {p[1] for p in listed} == set(range(len(known)))
    for n, t in enumerate(known):
        own = [p for p in listed if p[1] == n]
        assert all(t.words[k] == w for w, _, k, _ in own) and len({w for w, *_ in own}) == len(own) <= licenses.KEYS + licenses.OTHERS
        keys = {t.words[k] for k in licenses._keys(t)}
        assert len(keys) < 3 or not {"the", "of", "license"} & {w for w, _, k, _ in own if k in licenses._keys(t)} or len(keys - {"the", "of", "license"}) < 2


def best_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        c, n, at = (low + high) // 2, 1, 0
        for s in sizes:
            n, at = (n + 1, s) if at + s > c else (n, at + s)
        low, high = (low, c) if n <= shards else (c + 1, high)
    return low


@pytest.mark.parametrize(("hot", "digits"), [(0, 3), (400, 3), (0, 1), (400, 1)])
def test_sharding_is_minimax(spark, hot, digits, monkeypatch):
    monkeypatch.setattr(sharding, "ROOT_DIGITS", digits)  # with 1, parts of many groups are divided, some twice
    monkeypatch.setattr(sharding, "FINER_DIGITS", min(digits, 2))
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng, rng.choice([1, 5, 60])))) for i in range(600)] + [(1000 + i, "copies of one text") for i in range(hot)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = defaultdict(int)
    for _, t in rows:
        groups[hashlib.md5(t.encode()).hexdigest()] += len(t.encode()) + 1
    sizes = [groups[h] for h in sorted(groups)]
    held = Counter()
    for r in out:
        held[r["shard"]] += r["size"]
    assert max(held.values()) == best_capacity(sizes, 8) and set(held) <= set(range(8))
    text = dict(rows)
    of = defaultdict(set)
    slots = defaultdict(list)
    for r in out:
        of[text[r["doc_id"]]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        assert r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
    assert all(len(v) == 1 for v in of.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding_of_odd_rows(odd_docs, no_docs):
    out = sharding.shard(odd_docs).collect()
    assert len(out) == odd_docs.count() and all(r["law"] == "bytes" and r["grown_shard"] is None for r in out)
    null, empty = (next(r for r in out if r["doc_id"] == i) for i in (3, 4))
    assert (null["size"], null["text_crc32"], null["shard"]) == (1, 0, empty["shard"])
    assert sharding.shard(no_docs).count() == 0


def mix_in_python(rows):
    """rows: (doc_id, text, source). The queues served one by one."""
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    key = lambda i, t, s: md5("|".join(["" if i is None else str(i), "" if s is None else "s" + s, md5(t or "")]))
    docs = [(i, len(SIZE.findall(t or "")), s, key(i, t, s)) for i, t, s in rows]
    total = sum(d[1] for d in docs)
    sources = sorted({d[2] for d in docs}, key=lambda s: (s is None, s or ""))
    size = {s: sum(d[1] for d in docs if d[2] == s) for s in sources}
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    target, free = {}, set(sources)
    while True:
        left = total - sum(3 * size[s] for s in sources if s not in free)
        target = {s: left * weight[s] / sum(weight[x] for x in free) if s in free else 3.0 * size[s] for s in sources}
        over = {s for s in free if target[s] > 3 * size[s]}
        if not over:
            break
        free -= over
    entries = []
    for k, s in enumerate(sources):
        at = 0
        mine = sorted((d for d in docs if d[2] == s), key=lambda d: d[3])
        for d in mine:
            at += d[1]
            if d[1] and target[s]:
                entries += [((at + p * size[s]) / target[s], k, p, d) for p in range(3)]
    taken, served = Counter(), 0
    for _, _, _, d in sorted(entries, key=lambda e: e[:3]):
        served += d[1]
        if served > total:
            break
        taken[d] += d[1]
    return docs, size, target, taken


def test_mixing_serves_queues_fairly(spark, odd_docs, no_docs):
    rng = random.Random(4)
    made = [(i, " ".join(words(rng, rng.choice([0, 3, 40]))), rng.choice(["a", "b", "é", "", None, "a", "a"])) for i in range(300)]
    for rows in (made, [(r["doc_id"], r["text"], r["source"]) for r in odd_docs.collect() if r["doc_id"] != 14]):
        docs, size, target, taken = mix_in_python(rows)
        got = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
        for d in docs:
            r = got[d[0]]
            assert (r["size"], r["source_size"], r["taken"]) == (d[1], size[d[2]], taken[d]) and r["target"] == pytest.approx(target[d[2]])
    assert mixing.mix(odd_docs).count() == odd_docs.count() and mixing.mix(no_docs).count() == 0
    plan = mixing.mix(odd_docs).collect()
    played = mixing.mixed_documents(odd_docs)
    assert played.columns == odd_docs.columns and played.count() == sum(r["copies"] for r in plan)


def test_mixing_keeps_clashing_columns_and_spreads_one_id(spark):
    names = "h, nth, copies, size, __h, __size, __nth, __copies, __pass, pass, cell, rank".split(", ")
    rows = [(None if i % 2 else 7, f"text {i} of some words", "a" if i % 3 else "b", *[f"{c}{i}" for c in names]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in names))
    plan = {(r["h"], r["copies"]) for r in mixing.mix(df).collect()}
    assert len({h for h, _ in plan}) == 60  # rows of one id are told apart by their text
    played = mixing.mixed_documents(df)
    got = Counter(tuple(r) for r in played.collect())
    assert played.columns == df.columns and set(got) <= set(rows)
    copies = {tuple(r) for r in df.withColumn("key", mixing._shuffle_key("doc_id", "source", "text")).select("key", *names).collect()}
    of = dict(plan)
    assert all(got[(r[0], r[1], r[2], *r[3:])] == of[next(c[0] for c in copies if c[1] == r[3])] for r in rows)


def test_equal_ids_and_texts_of_two_sources_follow_their_own_source(spark):
    rows = [(1, "one two three", "a")] * 2 + [(1, "one two three", "c")] * 2 + [(i, "filler words here", "a") for i in range(2, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = Counter()
    for r in mixing.mix(df.filter("doc_id = 1").union(df.filter("doc_id > 1"))).collect():
        plan[r["source_size"]] += r["copies"]
    played = Counter(r["source"] for r in mixing.mixed_documents(df).collect())
    assert played == {"a": plan[3 * 40], "c": plan[6]}


def test_sums_before(spark, monkeypatch):
    monkeypatch.setattr(common, "PER_BLOCK", 5)
    rng = random.Random(9)
    rows = [(k, at, rng.randint(0, 9)) for k in ("x", "y") for at in rng.sample(range(200), 60)]
    got = common.sums_before(spark.createDataFrame(rows, "k string, at long, v long"), ["k"], "at", "v", "before").collect()
    assert {(r["k"], r["at"], r["before"]) for r in got} == {(k, at, sum(v for q, b, v in rows if q == k and b < at)) for k, at, _ in rows}


def winnow_in_python(text):
    """Every gram hashed by itself, and every window searched by itself."""
    tokens = [t for run in re.findall(r"[^\x20\x09-\x0D]+", text) for t in ([run] if len(run) <= fingerprints.WORD_CHARS else run)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = [signed(xxhash.xxh64_intdigest(t.encode(), seed=42)) % fingerprints.PRIME for t in tokens]
    n, wide = fingerprints.GRAM, fingerprints.WINDOW
    power = [pow(fingerprints.BASE, n - 1 - k, fingerprints.PRIME) for k in range(n)]
    g = [sum(x * p for x, p in zip(h[i : i + n], power)) % fingerprints.PRIME for i in range(max(len(h) - n + 1, 1))] if h else []
    kept = []
    for i in range(max(len(g) - wide + 1, 1) if g else 0):
        window = g[i : i + wide]
        at = i + max(k for k, v in enumerate(window) if v == min(window))
        if not kept or kept[-1][0] != at:  # places never go back
            kept.append((at, g[at]))
    return kept


def jaccard(a, b):
    x, y = {v for _, v in a}, {v for _, v in b}
    return 1.0 if not x | y else len(x & y) / len(x | y)


def test_fingerprints(spark, odd_docs, no_docs):
    rng = random.Random(5)
    made = [(3 * i, " ".join(words(rng, rng.choice([0, 1, 2, 8, 50])))) for i in range(60)] + [(7000, "again " * 30), (7001, "again " * 30)]
    for rows in (made, sorted([(r["doc_id"], r["text"]) for r in odd_docs.collect()], key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))):
        got = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        texts = [t or "" for _, t in rows]
        expected = Counter()
        for k, t in enumerate(texts):
            after, half = texts[(k + 1) % len(texts)], len(t) // 2
            edited = t[: len(t) - half] + after[:half]
            a, b, c = winnow_in_python(t), winnow_in_python(edited), winnow_in_python(after)
            text_of = lambda m: " ".join(f"{p}:{v:X}" for p, v in m)
            expected[rows[k][0], len(t), hashlib.sha256(edited.encode()).hexdigest(), text_of(a), text_of(b), jaccard(a, b), jaccard(a, c)] += 1
        assert Counter(map(tuple, got)) == expected
    assert fingerprints.fingerprints(odd_docs).count() == odd_docs.count() and fingerprints.fingerprints(no_docs).count() == 0


def test_next_over_clustered_and_far_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", 7)
    rng = random.Random(7)
    ids = sorted({rng.randrange(1000) for _ in range(300)} | {10**12 + rng.randrange(500) for _ in range(200)} | {-(1 << 63), (1 << 63) - 1, 5 * 10**17})
    df = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(None, "none a"), (None, "none b")], "doc_id long, text string").repartition(5)
    got = [(r["doc_id"], r["text"], r["next_doc_id"], r["next_text"]) for r in fingerprints.with_next(df).collect()]
    row = [(i, f"t{i}") for i in ids] + [(None, "none a"), (None, "none b")]
    assert sorted(got, key=str) == sorted([(*row[k], *row[(k + 1) % len(row)]) for k in range(len(row))], key=str)
    dealt = fingerprints._dealt(df, len(row), ids[0], ids[-1]).groupBy("__at").count().collect()
    assert max(r["count"] for r in dealt) <= 60 and len(dealt) > 20


def test_a_shared_passage_shares_a_fingerprint(spark):
    """Of the engine's own output, with and without spaces, wherever the passage stands."""
    rng = random.Random(6)
    n = fingerprints.GRAM + fingerprints.WINDOW - 1
    letters = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz漢字仮名交") for _ in range(k))
    pairs = []
    for _ in range(40):
        passage = words(rng, n)
        around = [" ".join([*words(rng, rng.randint(0, 30)), *passage, *words(rng, rng.randint(0, 30))]) for _ in range(2)]
        solid = letters(n)
        pairs += [tuple(around), tuple(letters(rng.randint(17, 60)) + solid + letters(rng.randint(17, 60)) for _ in range(2))]
    rows = [(i, *p) for i, p in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i long, a string, b string")
    marks = lambda c: F.transform(fingerprints.winnow(F.col(c)), lambda v: F.shiftright(v, 32))
    got = df.select("i", F.size(F.array_intersect(marks("a"), marks("b"))).alias("n")).collect()
    assert all(r["n"] >= 1 for r in got)


def test_one_character_before_a_long_run_changes_little(spark):
    rng = random.Random(8)
    run = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4000))
    got = fingerprints.fingerprints(spark.createDataFrame([(1, run), (2, "x" + run)], "doc_id long, text string"))
    assert got.filter("doc_id = 1").first()["near_next"] > 0.99
