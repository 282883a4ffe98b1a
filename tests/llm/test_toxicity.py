import numpy as np

from tessera.llm import toxicity as t


def brute(word, weights):
    """Sum over all index triples of a marked word within the span."""
    c, own = [31, *word, 31], {}
    for i in range(len(c)):
        for j in range(i + 1, len(c)):
            for k in range(j + 1, min(len(c), i + t.SPAN + 1)):
                key = (c[i] << 10) | (c[j] << 5) | c[k]
                own[key] = own.get(key, 0.0) + t.DECAY ** (k - i - 2)
    return sum(weights[key] * x for key, x in own.items()) / max(1.0, sum(x * x for x in own.values())) ** 0.5


def test_folded_kernel_is_the_sum_over_subsequences():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=32**3)
    codes, begin, owner, _ = t._stream(["An idiot!", "", "  ", "naïve aaaaaaa-b", "x"])
    got = t.word_margins(codes, begin, weights)
    ends = [*begin[1:], len(codes)]
    assert owner.tolist() == [0, 0, 3, 3, 4]
    want = [brute(codes[b + 1 : e - 1].tolist(), weights) for b, e in zip(begin, ends)]
    assert np.allclose(got, want)
    margins = t.Margins(weights)
    assert np.allclose(margins(codes, begin), want) and np.allclose(margins(codes, begin), want)


def test_kernel_of_a_word_with_itself_is_one():
    words = [bytes([31, *(ord(c) - 97 for c in w), 31]) for w in ("aaaaaaaa", "hahahahaha", "idiot", "moron")]
    phi = t._features(words)
    assert np.allclose((phi * phi).sum(axis=1), 1, atol=1e-5)


def plain_score(text, model):
    """The documented score from single words, without streams, chunks or caches."""
    runs, letters = [], []
    for w in [*text.split(), None]:
        if w is not None and len(w) == 1:
            letters.append(w)
            continue
        if letters:
            runs.append(("".join(letters), len(letters) > 1))
            letters = []
        if w is not None:
            runs.append((w, False))
    values = []
    for w, joined in runs:
        forms = [w, w[1:], w[:-1]] if joined else [w]
        values.append(max(brute([int(t.CODES[min(ord(c), 0x2FFF)]) for c in f], model["weights"]) for f in forms))
    x = [-1.0, 0.0, 0.0]
    if values:
        v = np.clip(np.array(values) + model["bias"], -1, 1)
        total = np.maximum(v, 0).sum()
        x = [v.max(), np.log1p(total), min(10 * total / len(v), 1)]
    z = np.array(x) @ model["combine"][:-1] + model["combine"][-1] - model["cut"] + np.log(t.CUT / (1 - t.CUT))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def test_score_matches_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000")
    rows = t.training_rows(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"), "toxic", ~t.held_out(1, 3), 100)
    model = t.fit([x for x, _ in rows], [y for _, y in rows])
    extra = spark.createDataFrame([(-1, "you are a m o r o n y"), (-2, ""), (-3, None)], "doc_id long, text string")
    some = docs.orderBy("doc_id").limit(40).select("doc_id", "text").unionByName(extra)
    got = {r.doc_id: r.score for r in t.scores(some, model).collect()}
    for r in some.collect():
        assert abs(got[r.doc_id] - plain_score(r.text or "", model)) < 1e-6


def test_spaced_letters_are_one_word():
    codes, begin, owner, _ = t._stream(["you i d i o t there"])
    words = [codes[b + 1 : e - 1].tolist() for b, e in zip(begin, [*begin[1:], len(codes)])]
    assert [ord(c) - 97 for c in "idiot"] in words and len(words) == 3


def test_learns_words_and_tolerates_gaps():
    rng = np.random.default_rng(4)
    clean = ["".join(rng.choice(list("aehinorst"), rng.integers(2, 9))) for _ in range(600)]
    bad = ["moron", "stupid", "clown", "worthless"]
    texts, labels = [], []
    for i in range(600):
        words = list(rng.choice(clean, 30))
        if i % 3 == 0:
            for w in rng.choice(bad, 2):
                words.insert(int(rng.integers(0, 30)), str(w))
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    model = t.fit(texts, labels)
    x = t.evidence(["a moron", "a moXron", "a m o r o n", "a theorist", "stuppid"], t.Margins(model["weights"]), model["bias"])[:, 0]
    assert x[0] > 0 and x[2] == x[0] and x[3] < 0 < x[0] and x[1] > x[3] and x[4] > x[3]
    z = t.evidence(texts, t.Margins(model["weights"]), model["bias"]) @ model["combine"][:-1] + model["combine"][-1]
    assert ((z >= model["cut"]) == np.array(labels)).mean() > 0.97


def test_held_out_accuracy(spark):
    got = t.op2_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    hit = ((got["predicted"] == 1) & (got["toxic"] == 1)).sum()
    assert hit / (got["toxic"] == 1).sum() > 0.85 and hit / (got["predicted"] == 1).sum() > 0.9


def test_edges(edge_docs):
    model = t.fit(["bad moron moron", "good words here"] * 20, [1, 0] * 20)
    got = t.scores(edge_docs, model).collect()
    assert len(got) == edge_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert t.scores(edge_docs.limit(0), model).count() == 0
    for texts, labels in (([], []), (["a"], [1]), (["", ""], [0, 1])):
        assert all(r.score < t.CUT for r in t.scores(edge_docs, t.fit(texts, labels)).collect())


def test_training_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(t, "TRAIN_CHARS", 50)
    monkeypatch.setattr(t, "TRAIN_TEXT", 40)
    docs = spark.createDataFrame([(1, "x" * 45)] + [(i, "w" * 9) for i in range(2, 20)] + [(3, "z" * 8)] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 20)] + [(4, 0)], "doc_id long, toxic int")
    got = t.training_rows(docs, labels, "toxic", t.F.lit(True), 7)
    assert {y for _, y in got} == {0, 1} and all(sum(len(x) for x, y in got if y == k) <= 50 for k in (0, 1)) and all(len(x) <= 9 for x, _ in got)
