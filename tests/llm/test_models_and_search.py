import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from galley.llm import langid, linear, minhash, quality, textvec, topk


def sets_of(texts, k):
    out = {}
    for i, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate({j: j + 32 for j in range(65, 91)}))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    return out


def components(sets, percent):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


def test_near_duplicates_against_brute_force(spark, doc_table):
    r = random.Random(5)
    base = [[f"w{r.randrange(300)}" for _ in range(r.randint(1, 60))] for _ in range(12)]
    texts = {}
    for i in range(150):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            w[r.randrange(len(w))] = f"w{r.randrange(300)}"
        texts[i] = " ".join(w)
    texts |= {200: None, 201: "", 202: " \n", 203: "One TWO", 204: "one two", 205: "one"}
    rows = [(i, t, "s") for i, t in texts.items()] + [(203, "One TWO", "s"), (None, "One TWO", "s")]
    for k, percent, tile in ((3, 85, 2), (5, 80, 64)):
        sets = sets_of(texts, k)
        want = components(sets, percent)
        got = minhash.near_duplicates(doc_table(rows), k, percent, tile=tile, wide_tile=tile).collect()
        assert len(got) == len(rows)
        for x in got:
            if x.doc_id is None:
                assert x.component_id is None and x.kept
            else:
                assert (x.n_shingles, x.component_id, x.kept) == (len(sets[x.doc_id]), want[x.doc_id], want[x.doc_id] == x.doc_id)
    assert minhash.first_of_group(doc_table(rows), 3, 85).select("doc_id").distinct().count() == len(set(components(sets_of(texts, 3), 85).values())) + 1
    assert minhash.near_duplicates(doc_table([])).count() == 0


def test_sketches_fill_and_agree():
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 63, 900, dtype=np.uint64)
    b = np.concatenate([a[:800], r.integers(0, 1 << 63, 100, dtype=np.uint64)])
    one = a[:1]
    keys = np.concatenate([np.sort(a), np.sort(b), one])
    s = minhash.sketch(np.repeat([0, 1, 2], [900, 900, 1]), keys, 4, 210)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    assert (s[:3] != top).all() and (s[3] == top).all()
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.1


@pytest.mark.parametrize("sizes", [{}, {"block": 30, "query_block": 4}])
def test_top_k_against_brute_force(spark, sizes):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 20)).round(1)
    x[50:60] = x[0]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 20), (403, [1.0, 2.0]), (404, []), (10, [float(v) for v in x[10]]), (None, [1.0] * 20)]
    df = spark.createDataFrame([(*row, "x") for row in rows], "vec_id bigint, embedding array<double>, block string")
    got = {}
    for w in topk.top_k(df, df.where("vec_id % 20 = 0"), k=7, **sizes).orderBy("query_id", "rank").collect():
        got.setdefault(w.query_id, []).append((w.vec_id, w.score))
    ints = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in rows if i is not None and v is not None and len(v) == 20 and None not in v and np.isfinite(v).all()]
    for q in range(0, 300, 20):
        mine = next(v for i, v in ints if i == q)
        want = sorted(((i, int(mine @ v)) for i, v in ints if i != q), key=lambda t: (-t[1], t[0]))[:7]
        assert got[q] == want
    assert set(got) == set(range(0, 300, 20))
    if sizes:  # the same ids in several partitions: a repeated candidate counts each time
        twice = topk.top_k(df.union(df), df.where("vec_id = 0"), k=6, **sizes).orderBy("rank").collect()
        want = sorted(((i, int(ints[0][1] @ v)) for i, v in ints * 2 if i != 0), key=lambda t: (-t[1], t[0]))[:6]
        assert [(w.vec_id, w.score) for w in twice] == want
    assert topk.top_k(df.where("false"), df.where("false")).count() == 0


def test_the_bound_compacts_clustered_vectors():
    r = np.random.default_rng(4)
    centres = r.normal(size=(20, 64)) * 40
    of = r.integers(0, 20, 3000)
    v = np.floor(centres[of] + r.normal(size=(3000, 64)) * 4).astype(np.int64).T
    ids, queries = np.arange(3000), np.arange(0, 3000, 20)
    floors = np.array([np.sort(np.delete(v[:, i] @ v[:, :600], i if i < 600 else []))[-10] for i in queries], float)
    for given in (None, floors):
        tally = []
        for j, got, score in topk.block_top(v[:, queries], v, queries, ids, 10, given, tally=tally):
            s = v[:, queries[j]] @ v
            want = sorted((i for i in ids if i != queries[j]), key=lambda i: (-s[i], i))[:10]
            assert got.tolist() == want and score.tolist() == s[want].tolist()
        assert np.mean(tally) < 0.5


def test_block_top_with_wide_integers():
    q, v = np.array([[1 << 40, 3], [5, -7]]), np.array([[1 << 30, 2, -9, 4], [1, 1, 1, 1]])
    out = {j: (ids.tolist(), [int(s) for s in score]) for j, ids, score in topk.block_top(q, v, np.array([100, 1]), np.array([0, 1, 2, 3]), 2)}
    assert out[0] == ([0, 3], [(1 << 70) + 5, (1 << 42) + 5]) and out[1][0] == [0, 3]


def test_ordinal_and_svm_learn():
    r = np.random.default_rng(3)
    n = 400
    dense = r.normal(size=(n, 6))
    x = linear.Rows(np.tile(np.arange(6), n), dense.ravel(), np.arange(0, 6 * n + 1, 6), 6)
    s = dense @ np.array([1, -2, 0.5, 0, 0, 1])
    w, t = linear.ordinal(x, np.digitize(s, [-1, 1]), 3)
    assert t[0] < t[1] and np.corrcoef(w, [1, -2, 0.5, 0, 0, 1])[0, 1] > 0.98
    w, b = linear.svm(x, np.where(s > 0, 1.0, -1.0))
    assert ((x.dot(w) + b > 0) == (s > 0)).mean() > 0.95


def test_quality_selects(spark, doc_table):
    r = random.Random(1)
    good = lambda: " ".join(r.choice(["tree", "river", "stone", "cloud", "quiet"]) for _ in range(40))
    bad = lambda: " ".join(r.choice(["win***", "$$$", "BUY!!", "now|"]) for _ in range(40))
    toxic = lambda: good() + " nasty vile " + good()
    makers = [bad, toxic, good]
    rows = [(i, makers[i % 3](), "s") for i in range(600)] + [(1000, None, "s"), (1001, "", "s"), (0, good(), "t")]
    docs = doc_table(rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None if i % 3 == 2 else int(i % 3 == 1)) for i in range(300)] + [(5, None, 1), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, labels)
    kept = {x.doc_id for x in quality.select(docs, model).collect()}
    late = range(300, 600)
    assert sum(i in kept for i in late if i % 3 == 2) >= 95 and sum(i in kept for i in late if i % 3 != 2) <= 5
    graded = quality.grade(docs, model)
    assert graded.count() == len(rows) and graded.columns[: len(docs.columns)] == docs.columns
    assert graded.where("expected_grade between 0 and 2 and tail_probability between 0 and 1").count() == len(rows)
    none = quality.train(docs, labels.where("false"))
    assert quality.select(docs, none).count() == len(rows) and quality.grade(docs.where("false"), none).count() == 0


def test_language_sample_is_the_least_hashes(spark, monkeypatch):
    """A language larger than four samples, one of two documents, and an id that holds a third of all rows."""
    df = spark.range(4000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "if(id < 2, 'bb', 'aa') AS lang").union(spark.range(2000).selectExpr("7L", "'text 7'", "'aa'"))
    monkeypatch.setattr(langid, "fit", lambda texts, langs: list(zip(texts, langs, strict=True)))
    picked = langid.train(df)
    ids = df.where(~langid.held_out(F.col("doc_id"))).distinct().withColumn("h", F.xxhash64("doc_id", F.lit("lang"))).collect()
    want = [x for lang in ("aa", "bb") for x in sorted((r.h, r.text, r.lang) for r in ids if r.lang == lang)[: langid.SAMPLE_DOCS]]
    assert sorted(picked) == sorted((t, lang) for _, t, lang in want) and len(picked) > langid.SAMPLE_DOCS


def test_language_id(spark):
    r = random.Random(2)
    parts = {"en": ["the", "ing", "and", "that"], "de": ["sch", "ein", "ung", "der"], "fr": ["eau", "oux", "les", "que"], "xx": ["kwa", "zul", "mbe", "ngo"]}
    text = lambda lang, n: " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))
    rows = [(i, text(lang, r.randint(2, 60)), lang) for i, lang in enumerate(r.choice(sorted(parts)) for _ in range(500))]
    rows += [(900, None, "en"), (901, "12 34 !?", "en"), (902, "é", None), (None, text("en", 5), "en"), (1, rows[1][1], rows[1][2])]
    df = spark.createDataFrame([(*x, "s") for x in rows], "doc_id bigint, text string, lang string, margins string")
    got = langid.predict(df, langid.train(df)).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    want = {i: lang for i, _, lang in rows}
    held = [x for x in got if x.held_out and x.doc_id < 500]
    assert len(held) > 60 and sum(x.lang_pred == want[x.doc_id] for x in held) / len(held) > 0.97
    by = {x.doc_id: x.lang_pred for x in got}
    assert by[900] == by[901] == "und" and by[902] != "und"
    assert langid.predict(df, langid.train(df.where("false"))).where("lang_pred != 'und'").count() == 0


def texts_of(texts):
    return next(textvec.slices(pa.array(texts, pa.string())))[1]


def test_grades_against_plain_loops():
    r = random.Random(4)
    bits = ["tree", "River", "AB", "ab", "ab", "é", "$", "|", "x1", "\n", "  "]
    texts = ["", *(" ".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(60))]
    model = quality.fit(texts, [r.randrange(3) for _ in texts])
    assert model.thresholds[0] < model.thresholds[1]
    tails = quality.Model(np.sin(np.arange(quality.WIDTH)), np.array([-0.5, 0.7]))
    got = tails.tails(texts_of(texts))
    for t, row in zip(texts, got):
        raw, columns, before = t.encode(), [], None
        for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw):
            w = m[0]
            low = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
            head = low[:4]
            full, first = (int(textvec.Texts(np.frombuffer(b, np.uint8), np.array([0, len(b)]), np.zeros(1, bool)).hashes(np.array([0]), np.array([len(b)]))[0]) for b in (low, head))
            columns += [full >> 46, int(textvec.mix(np.array([(first + 1) & (2**64 - 1)], np.uint64))[0]) >> 46]
            if len(w) >= 2 and all(65 <= c <= 90 for c in w):
                columns.append(1)
            if low == before:
                columns.append(2)
            before = low
        columns += [16 + c for c in raw if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 or c == 32 or 9 <= c <= 13)]
        s = sum(np.sin(c) for c in columns) / np.sqrt(max(1, len(columns)))
        assert row == pytest.approx([1 / (1 + np.exp(th - s)) for th in (-0.5, 0.7)])


def test_votes_against_plain_loops():
    r = np.random.default_rng(6)
    texts = ["", "ab", "The cat sat\non the mat", "der  hund", "le chat " * 20, "zz"]
    families = {"f": ["a", "b", "c"], "g": ["d"], "h": ["e", "i"]}
    pairs = [("family:f", "family:g"), ("family:f", "family:h"), ("family:g", "family:h"), ("a", "b"), ("a", "c"), ("b", "c"), ("e", "i")]
    model = langid.Model(families, pairs, r.normal(size=(7, langid.WIDTH)).astype(np.float32), r.normal(size=7))
    got, _ = model.predict(texts_of(texts))
    for t, lang in zip(texts, got):
        column, first = langid.trigrams(texts_of([t]))
        assert len(column) == max(0, len(t.encode()) - 2) == first[1]
        margin = {p: sum(float(w[c]) for c in column) * 16 / max(1, len(column)) + b for p, w, b in zip(pairs, model.weights, model.bias)}

        def winner(names):
            wins = {n: 0 for n in names}
            total = {n: 0.0 for n in names}
            for (a, b), m in margin.items():
                if a in wins and b in wins:
                    wins[a if m > 0 else b] += 1
                    total[a] += m
                    total[b] -= m
            return max(names, key=lambda n: (wins[n], total[n]))

        assert lang == winner(families[winner([f"family:{f}" for f in families])[7:]])
