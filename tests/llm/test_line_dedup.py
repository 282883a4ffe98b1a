import random

import pytest

from tessera.llm import line_dedup as ld

RNG = random.Random(8)
VOCABULARY = [f"w{i}" for i in range(60)]


def brute(rows):
    seen, gone = [], set()
    for doc, text in sorted(rows, key=lambda r: r[0]):
        for n, line in enumerate((text or "").split("\n")):
            words = {w for w in line.lower().split(" ") if w}
            if words:
                if any(5 * len(words & s) >= 4 * len(words | s) for s in seen):
                    gone.add((doc, n))
                seen.append(words)
    return gone


def variant(line):
    words = line.split(" ")
    for _ in range(RNG.randint(0, max(1, len(words) // 6))):
        words[RNG.randrange(len(words))] = RNG.choice(VOCABULARY + ["new" + str(RNG.random())])
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    lines = [" ".join(RNG.choices(VOCABULARY, k=RNG.choice([1, 2, 5, 10, 40]))) for _ in range(60)]
    lines += [variant(RNG.choice(lines)) for _ in range(240)]
    base = " ".join(RNG.choices(VOCABULARY, k=30))
    lines += [variant(base) for _ in range(60)]  # a dense cluster
    RNG.shuffle(lines)
    return [(i, "\n".join(lines[4 * i : 4 * i + 4])) for i in range(90)]


def test_matches_brute_force(make_docs, rows):
    want = brute(rows)
    got = {(r.doc_id, r.line_no) for r in ld.duplicates(make_docs(rows)).collect()}
    assert len(want) > 100 and got == want


def test_same_result_by_shuffles_and_with_large_ids(make_docs, rows, monkeypatch):
    monkeypatch.setattr(ld, "BROADCAST_PAIRS", -1)
    shift = 1 << 61  # too large to be packed with a line number
    got = {(r.doc_id - shift, r.line_no) for r in ld.duplicates(make_docs([(i + shift, t) for i, t in rows])).collect()}
    assert got == brute(rows)


def test_text_without_the_lines_that_go(make_docs, rows):
    docs, want = make_docs(rows), brute(rows)
    got = {r.doc_id: r.text for r in ld.deduplicated(docs).collect()}
    assert got == {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in want) for i, t in rows}
    assert ld.deduplicated(docs).columns == docs.columns


def test_edges(make_docs, edge_docs):
    got = ld.deduplicated(edge_docs)
    assert got.columns == edge_docs.columns and got.count() == edge_docs.count()
    texts = {(r.doc_id, r.text) for r in got.collect()}
    assert {(1, None), (2, ""), (4, "one"), (None, "no id at all"), (7, "same line here")} <= texts
    assert ld.duplicates(edge_docs.limit(0)).count() == 0
    assert ld.duplicates(make_docs([(None, "a b c\nd"), (1, "a b c"), (2, "\n\n")])).collect() == [(1, 0)]


def test_no_python_in_the_plan(make_docs):
    plan = ld.duplicates(make_docs([(1, "a b c d\na b c d")]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_rows_that_share_an_id_or_have_none_keep_their_own_lines(make_docs):
    for doc_id in (None, 3):
        got = ld.deduplicated(make_docs([(doc_id, "x y z\nunique1"), (doc_id, "unique2\nx y z"), (5, "other")])).collect()
        texts = {r.text for r in got if r.doc_id == doc_id}
        assert texts in ({"x y z\nunique1", "unique2"}, {"unique1", "unique2\nx y z"}) and len(got) == 3
        got = ld.deduplicated(make_docs([(doc_id, "a b c\nd e"), (doc_id, "a b c\nf g"), (doc_id, "a b c\nd e")])).collect()
        lines = [line for r in got for line in r.text.split("\n") if line]
        assert sorted(lines) == ["a b c", "d e", "f g"]
        assert len(ld.duplicates(make_docs([(doc_id, "same line")] * 50)).collect()) == 49


def test_rows_of_one_id_are_not_multiplied(make_docs, rows):
    want = brute(rows)
    got = ld.deduplicated(make_docs(rows + [(None, t) for _, t in rows])).collect()
    assert len(got) == 2 * len(rows) and want
    assert all(not r.text.strip() for r in got if r.doc_id is not None)  # rows without an id come first


def test_names_of_helper_columns_do_not_clash(spark):
    df = spark.createDataFrame([(1, "a b c\na b c", 7, 8, 9), (1, "d e f\na b c", 7, 8, 9)], "doc_id long, text string, _row int, _gone int, _at int")
    got = sorted(ld.deduplicated(df).collect())
    assert [(r._row, r._gone, r._at) for r in got] == [(7, 8, 9)] * 2 and sorted("\n".join(r.text for r in got if r.text).split("\n")) == ["a b c", "d e f"]


def test_one_word_in_every_line(make_docs):
    rng = random.Random(12)
    rows = [(i, "\n".join("common " + " ".join(rng.choices(VOCABULARY[:8], k=rng.randint(0, 9))) for _ in range(4))) for i in range(150)]
    assert {(r.doc_id, r.line_no) for r in ld.duplicates(make_docs(rows)).collect()} == brute(rows)


def test_keys_are_primitive_and_words_are_split_without_a_regular_expression(make_docs, rows, monkeypatch):
    patterns, split = [], ld.F.split
    monkeypatch.setattr(ld.F, "split", lambda text, pattern, *rest: patterns.append(pattern) or split(text, pattern, *rest))
    docs = make_docs(rows).withColumnRenamed("doc_id", "_row")
    counts = ld.rarity(docs)
    assert set(patterns) == {"\n", " "}
    assert not ld.lines(docs, counts).schema["prefix"].dataType.containsNull
    words = [w for _, t in rows for line in t.lower().split("\n") for w in line.split(" ")]
    assert sum(q != "0" for q in counts.split(",")) >= 0.95 * len(set(words))


def test_word_counts_reach_the_driver_in_few_rows(make_docs, monkeypatch):
    docs = make_docs([(i, "\n".join(f"A{i} b{j} the" for j in range(100))) for i in range(60)] + [(99, None), (98, "")])
    got, of_frame = [], type(docs)
    collect, each = of_frame.collect, of_frame.toLocalIterator
    monkeypatch.setattr(of_frame, "collect", lambda self: got.extend(rows := collect(self)) or rows)
    monkeypatch.setattr(of_frame, "toLocalIterator", lambda self, *a: (got.append(r) or r for r in each(self, *a)))
    ranks = ld.rarity(docs).split(",")
    assert len(got) <= 128 and len(ranks) == ld.BUCKETS
    # "a1" to "a60" stand in 100 lines, "b1" to "b100" in 60, "the" in all
    assert max(map(int, ranks)) == 37 and {"17", "19"} <= set(ranks) and sum(q != "0" for q in ranks) >= 155


def test_lines_are_written_once_and_sorted_no_more_often_than_joined(make_docs, rows, monkeypatch):
    prefixes, plans, put = [], {}, ld.written

    def spy(df, name):
        out = put(df, name)
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        prefixes.extend([name] * ("prefix" in out.columns))
        return out

    monkeypatch.setattr(ld, "written", spy)
    want = brute(rows)
    assert {(r.doc_id, r.line_no) for r in ld.duplicates(make_docs(rows)).collect()} == want
    # no second table of the lines' prefixes beside that of the lines
    assert prefixes == ["line-dedup-lines"]
    # the leaders' window is over their own words; the join of all words reads one exchange twice, without a window
    first, second = plans["line-dedup-pairs"]
    assert "Window" in first and "Join" not in first.split("Window")[0] and "Window" not in second


def test_what_a_leader_matches_is_not_searched_again_and_what_fails_is(make_docs):
    base = [f"b{i}" for i in range(20)]
    # the second line is a copy of the first but for a word; the last shares the leader's words too, but matches only the third
    lines = [base, base[:19] + ["x"], [f"c{i}" for i in range(12)] + base[:6], [f"c{i}" for i in range(12)] + base[:5]]
    docs = make_docs([(i, " ".join(words)) for i, words in enumerate(lines)])
    assert {(r.doc_id, r.line_no) for r in ld.duplicates(docs).collect()} == brute([(i, " ".join(w)) for i, w in enumerate(lines)]) == {(1, 0), (3, 0)}
    rows = docs.withColumnRenamed("doc_id", "_row")
    found, _ = ld.packed(ld.lines(rows, ld.rarity(rows)))
    kinds = ld.classes(found, ld.repeats(found))
    assert kinds.count() == 4
    every = {(r.pos, r.other) for r in ld.candidates(kinds, kinds.select("pos").limit(0)).collect()}
    assert {(2, 0), (6, 4)} <= every and {r.pos for r in ld.leaders(kinds).collect()} >= {2}
    assert {(r.pos, r.other) for r in ld.candidates(kinds, kinds.select("pos").where("pos = 2")).collect()} == {p for p in every if p[0] != 2}


def test_ranks_are_packed_by_bucket():
    rng = random.Random(3)
    ranks = [rng.randrange(127) for _ in range(ld.BUCKETS)]
    longs, size = list(map(int, ld._packed_ranks(",".join(map(str, ranks))).split(","))), ld.BUCKETS // ld.PLACES
    assert len(longs) == size and all((longs[b % size] >> 8 * (b // size)) & 255 == ranks[b] for b in range(0, ld.BUCKETS, 97))


def test_words_are_hashed_once(make_docs, rows, monkeypatch):
    plans, put = {}, ld.written

    def spy(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString())
        return put(df, name)

    monkeypatch.setattr(ld, "written", spy)
    assert {(r.doc_id, r.line_no) for r in ld.duplicates(make_docs(rows)).collect()} == brute(rows)
    # counts and keys are made from one table of hashes, not from the texts
    assert len(plans["line-dedup-hashes"]) == 1 and "split(" in plans["line-dedup-hashes"][0]
    assert "split(" not in plans["line-dedup-lines"][0] and "lower(" not in plans["line-dedup-lines"][0]


def test_only_short_entries_are_joined_with_all(make_docs, rows):
    docs = make_docs(rows).withColumnRenamed("doc_id", "_row")
    found, bits = ld.packed(ld.lines(docs, ld.rarity(docs)))
    kinds = ld.classes(found, ld.repeats(found)).persist()
    entries = ld._entries(kinds.withColumn("done", ld.F.lit(False)).withColumn("bands", ld.F.array(ld._band(ld.F.col("n")))))
    assert entries.where("short").count() == entries.where("short AND i <= n - (8 * n + 8) div 9 + 1").count() < entries.count()
    # all pairs that match are found all the same, from one exchange, whichever of the two lines is the longer one
    sets = {(i << bits) + n: set(x.lower().split()) for i, t in rows for n, x in enumerate(t.split("\n"))}
    firsts = sorted(r.pos for r in kinds.select("pos").collect())
    want = {(b, a) for b in firsts for a in firsts if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    matched = firsts[::3]
    got = {(r.pos, r.other) for r in ld.candidates(kinds, kinds.select("pos").where(ld.F.col("pos").isin(matched)), True).collect()}
    assert {p for p in want if p[0] not in matched} <= got and not {p[0] for p in got} & set(matched)
    assert any(len(sets[a]) > len(sets[b]) for b, a in want) and any(len(sets[a]) < len(sets[b]) for b, a in want)
    kinds.unpersist()
