import random

import numpy as np
import pytest

from tessera.llm import decontamination as d

RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 5))) for _ in range(400)]


def text(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))



def holds(body, item):
    """The plain definition: 0.8 of both parts' runs of five words (or of the whole part, if shorter) and of each part's words stand in the text."""
    words = d.words_of(body)
    here, whole, shares = 0, 0, []
    for part in d.question_and_answer(item):
        n = min(5, len(part))
        mine = {" ".join(part[i : i + n]) for i in range(len(part) - n + 1)}
        have = {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}
        here, whole = here + len(mine & have), whole + len(mine)
        shares.append(len(set(part) & set(words)) / len(set(part)))
    return here >= 0.8 * whole and min(shares) >= 0.8


ITEMS = [(i, f"{text(RNG.randint(8, 30))}? {text(RNG.randint(6, 20))}.") for i in range(60)]


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.5, 0.8])
def test_search_finds_exactly_the_items_over_the_threshold(threshold):
    index = d.Index(ITEMS)
    p = index.all
    for n in (0, 3, 50, 300):
        words = np.array(sorted(RNG.sample(range(len(index.vocabulary)), min(n, len(index.vocabulary)))), dtype=int)
        share = np.zeros(len(ITEMS))
        for w in words:
            share[p.item[p.start[w] : p.start[w + 1]]] += p.share[p.start[w] : p.start[w + 1]]
        want = np.flatnonzero(share >= threshold - 1e-9).tolist()
        got = p.search(words, threshold)
        assert [i for i, _ in got] == want == p.reached(words, threshold).tolist()
        assert np.allclose([x for _, x in got], share[want])


def test_pivot_and_blocks_skip_items():
    index = d.Index(ITEMS)
    words, scored = np.array(sorted(index.vocabulary[w] for w in set(d.words_of(ITEMS[20][1])))), []
    assert [i for i, _ in index.all.search(words, 0.5, scored)] == [20]
    holding = {i for w in words for i in index.all.item[index.all.start[w] : index.all.start[w + 1]].tolist()}
    assert 20 in scored and len(scored) < len(holding) / 2


def test_every_passage_over_the_threshold_is_reached():
    index = d.Index(ITEMS)
    words = d.words_of(text(500) + " " + ITEMS[3][1] + " " + text(400) + " " + ITEMS[9][1] + " " + text(90))
    ids = np.array([index.vocabulary.get(w, -1) for w in words])
    got = {(s, e, i) for s, e, hits in index.passages(ids) for i, _ in hits}
    want = set()
    for window, (members, postings) in index.groups.items():
        for s in range(0, max(1, len(ids)), window // 2):
            part = np.unique(ids[s : s + window])
            want |= {(s, min(len(ids), s + window), members[i]) for i, _ in postings.search(part[part >= 0])}
            if s + window >= len(ids):
                break
    assert got == want and {3, 9} <= {i for *_, i in got}


def test_rows_and_scores_do_not_depend_on_the_number_of_indexes(spark, make_docs):
    rows = [(i, f"{text(RNG.randint(0, 200))} {t} {text(RNG.randint(0, 200))}") for i, t in ITEMS[:25]]
    docs, items = make_docs(rows), spark.createDataFrame(ITEMS, "item_id long, text string")
    first, *others = (sorted((r.doc_id, r.item_id, r.passages, r.first_word, round(r.score, 9), r.overlap) for r in d.leaks(docs, items, limit=n).collect()) for n in (1000, 60, 7))
    assert len(first) >= 25 and all(x == first for x in others)


def test_a_long_item_changes_nothing_for_others():
    short = [(1, "is it raining. yes."), (2, f"{text(12)}? {text(9)}.")]
    body = "yes " + text(160) + " is it raining"
    for items in (short, [*short, (3, text(500))]):
        assert [x[0] for x in d.Index(items).leaks(body)] == []
        assert [x[0] for x in d.Index(items).leaks("well " + short[1][1])] == [2]


def test_leaks_match_brute_force(spark, make_docs):
    rows = [(i, text(RNG.randint(1, 300))) for i in range(80)]
    rows += [(100 + i, f"{text(RNG.randint(0, 200))} {t.upper()} {text(RNG.randint(0, 200))}") for i, t in ITEMS[:30]]
    rows += [(200 + i, f"{text(50)} {t.split('?')[0]} {text(50)}") for i, t in ITEMS[:20]]  # the question alone is no leak
    want = {(doc, i) for doc, body in rows for i, t in ITEMS if holds(body, t)}
    docs, items = make_docs(rows), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {(100 + i, i) for i in range(30)} <= want
    assert {(r.doc_id, r.item_id) for r in d.leaks(docs, items).collect()} == want
    assert {(r.doc_id, r.item_id) for r in d.leaks(docs, items, limit=7).collect()} == want
    assert {r.doc_id for r in d.decontaminated(docs, items, limit=25).collect()} == {i for i, _ in rows} - {i for i, _ in want}


def test_edges(spark, edge_docs):
    items = spark.createDataFrame([(1, "same line here"), (2, None), (3, ""), (None, "no id at all"), (5, "...")], "item_id long, text string")
    got = sorted((r.doc_id or -1, r.item_id) for r in d.leaks(edge_docs, items).collect())
    assert got == [(-1, -1), (7, 1), (7, 1)]
    assert d.decontaminated(edge_docs, items).columns == edge_docs.columns
    assert d.leaks(edge_docs, items.limit(0)).count() == 0 and d.leaks(edge_docs.limit(0), items).count() == 0
    assert d.decontaminated(edge_docs, items.limit(0)).count() == edge_docs.count()


def test_short_answers_and_single_edits_are_found():
    items = [(0, f"{text(20)}? {text(1)}."), (1, f"{text(25)}. {text(8)}."), (2, f"{text(12)}? {text(3)}!"), (3, text(2))]
    index = d.Index(items)
    for i, t in items:
        assert i in {x[0] for x in index.leaks(f"{text(70)} {t} {text(30)}")}
    words = items[1][1].split(" ")
    words[-3] = "zzz"  # one changed word within the answer
    assert [x[0] for x in index.leaks(" ".join(words))] == [1]
    assert holds(" ".join(words), items[1][1]) and not index.leaks(text(40))
