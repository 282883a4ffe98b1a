import random

import corpus_pipeline
from tessera.llm import shingle_join, simhash

RNG = random.Random(5)


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(rows):
    sets, label = [grams(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def edited(text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[RNG.randrange(len(words))] = f"new{RNG.random()}"
    return " ".join(words)


def corpus():
    passage = " ".join(RNG.choices([f"p{i}" for i in range(500)], k=40))
    texts = []
    for _ in range(25):
        text = " ".join(RNG.choices([f"w{i}" for i in range(3000)], k=RNG.choice([6, 60, 300]))) + " " + passage
        texts += [text, *(edited(text, RNG.randint(1, 8)) for _ in range(4))]
    base = " ".join(RNG.choices([f"w{i}" for i in range(3000)], k=200))
    texts += [edited(base, RNG.randint(0, 6)) for _ in range(40)] + ["one two", "One  two", "one three", None, "", " \n"]
    RNG.shuffle(texts)
    return list(enumerate(texts))


def test_components_match_brute_force(spark):
    rows = corpus()
    label = groups(rows)
    got = {r["_row"]: r.component for r in shingle_join.near_duplicates(spark.createDataFrame(rows, "_row long, text string")).collect()}
    assert 30 < len(set(label)) < len(rows) - 20 and got == dict(enumerate(label))


def test_stage_finds_edited_copies_beyond_four_bits(spark, make_docs):
    text = " ".join(RNG.choices([f"w{i}" for i in range(3000)], k=150))
    copy = next(c for c in (edited(text, 2) for _ in range(1000)) if bin(simhash.fingerprint(text) ^ simhash.fingerprint(c)).count("1") > 4)
    a, b = grams(text), grams(copy)
    assert 5 * len(a & b) >= 4 * len(a | b)
    got = corpus_pipeline.near_duplicate_stage(spark, make_docs([(4, text), (9, copy), (7, "quite other words stand here now")]), "")
    assert sorted(r.doc_id for r in got.collect()) == [4, 7]


def test_stage_links_by_fingerprints_first_and_verifies_them(spark, make_docs, monkeypatch):
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(RNG.choices(words, k=60))
    tails = [" ".join(RNG.choices(words, k=40)) for _ in range(2)]
    same_print = [" ".join([passage] * 400 + [t]) for t in tails]  # alike by fingerprint only, as repeated shingles count there
    text = " ".join(RNG.choices(words, k=400))
    near = next(c for c in (edited(text, 1) for _ in range(1000)) if bin(simhash.fingerprint(text, 5) ^ simhash.fingerprint(c, 5)).count("1") <= 4)
    far = next(c for c in (edited(text, 4) for _ in range(1000)) if bin(simhash.fingerprint(text, 5) ^ simhash.fingerprint(c, 5)).count("1") > 4)
    assert bin(simhash.fingerprint(same_print[0], 5) ^ simhash.fingerprint(same_print[1], 5)).count("1") <= 4
    rows = spark.createDataFrame(list(enumerate([*same_print, text, near, far])), "_row long, text string")
    found, close = [], shingle_join.close

    def kept(*args):
        found.append({tuple(r) for r in close(*args).collect()})
        return close(*args)

    monkeypatch.setattr(shingle_join, "close", kept)
    got = {r["_row"]: r.component for r in shingle_join.near_duplicates(rows).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2, 4: 2}
    docs = make_docs([(r["_row"], r.text) for r in rows.collect()])
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == [0, 1, 2]
    assert len(found) == 2 and all((3, 2) in x and (1, 0) not in x for x in found)
