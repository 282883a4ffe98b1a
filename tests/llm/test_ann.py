import numpy as np
import pytest

from tessera.llm import ann


def brute(ids, v, every=50):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = (v @ v[i]) / (np.linalg.norm(v, axis=1) * np.linalg.norm(v[i]))
        out[int(ids[i])] = sorted(((-round(float(x), 12), int(j)) for k, (x, j) in enumerate(zip(s, ids)) if k != i))[:5]
    return out


def result(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-round(r.score, 12), r.vec_id))
    return got


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.orderBy("vec_id").toPandas()
    want = brute(rows["vec_id"].to_numpy(), np.array(rows["embedding"].tolist(), dtype=np.float64))
    got = result(ann.nearest(df))
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    hits = sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)


def test_copies_ties_and_unusable_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 8)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 8)).astype(np.float32)
    rows = [(i, base[i % 60].tolist()) for i in range(100)] + [(i, base[0].tolist()) for i in range(200, 240)]
    bad = [(300, None), (350, [0.0] * 8), (400, [float("nan")] * 8), (450, [float("inf")] + [1.0] * 7), (500, [None] + [1.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + bad], "vec_id long, embedding array<float>, qid string, cid int")
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    want, got = brute(ids, v), result(ann.nearest(df))
    assert set(got) == set(want) == {0, 50, 200}
    assert got[0] == want[0] and got[200] == want[200]
    assert sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want) >= 14


def test_equal_directions_tie_exactly(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=16)
    rows = [(0, rng.normal(size=16).tolist())] + [(i, (v * 2.0 ** ((i * 7) % 19 - 9)).tolist()) for i in range(30, 0, -1)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=31).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5] and len({r.score for r in got}) == 1
    x = np.array(rows[0][1])
    assert got[0].score == (x * v).sum() / (np.sqrt((x * x).sum()) * np.sqrt((v * v).sum()))


def test_doubles_are_kept_and_other_lengths_searched(spark):
    tiny = 1e-12
    rows = [(0, [1.0, 0.0]), (1, [1.0, 3 * tiny]), (2, [1.0, 2 * tiny]), (3, [1.0, 1.0]), (50, [1.0, 2.0, 3.0]), (51, [1.0, 2.0, 3.5]), (52, [-1.0, 2.0, 3.0])]
    got = result(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert [j for _, j in got[50]] == [51, 52] and {j for _, j in got[0][:2]} == {1, 2} and got[0][2][1] == 3


def test_rows_that_share_an_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (7, [1.0, 0.1]), (8, [0.1, 1.0])]
    got = sorted((r.rank, r.vec_id) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 7), (1, 8), (2, 7), (2, 8), (3, 0), (3, 0)]


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in ann.nearest(df).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert ann.nearest(df.where("vec_id = 0")).count() == 0
    assert ann.nearest(df.limit(0)).count() == 0


def test_probes_come_in_order_of_success():
    place = np.array([0.1, 0.45, 0.8])
    moves = ann.probes(place, 10.0)
    cost = [sum((p if m < 0 else 1 - p) ** 2 for p, m in zip(place, row) if m) for row in moves]
    assert cost == sorted(cost) and len({tuple(m) for m in moves}) == 27
    assert len(ann.probes(place, 0.3)) == sum(c <= 0.3 for c in cost)


def test_larger_tables_have_more_hashes_and_smaller_buckets():
    rng = np.random.default_rng(8)
    sample, sizes = rng.normal(size=(500, 16)), []
    for rows in (1_000, 100_000, 10_000_000):
        h = ann.fitted(sample, sample[::-1], rows)
        sizes.append(len(np.unique(h.bucket(np.floor(h.places(ann._unit(sample), 0))))))
    assert sizes[0] < sizes[1] < sizes[2]

@pytest.mark.parametrize("lead", [0, 1, 3, 8])
def test_groups_and_their_buckets_are_all_that_full_probes_reach(lead):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(3000, 16))
    h = ann.Hasher(16, 1.5, 8)
    h.lead, h.most = lead, 0.6
    places = h.places(ann._unit(v), 1)
    cells = np.floor(places).astype(np.int32)
    grp = h.group(cells)
    for q in range(0, 3000, 300):
        own = np.floor(places[q]).astype(np.int64)
        want = set(np.flatnonzero(np.isin(h.bucket(cells), h.bucket(own + ann.probes(places[q] - own, h.most)))).tolist())
        got = set()
        for g in h.visits(places[q]):
            rows = np.flatnonzero(grp == g)
            if len(rows):
                group = ann._Group([rows], [cells[rows]], [v[rows]])
                got |= set(group.ids[np.repeat(group.visited(places[q : q + 1], h.most)[0], group.sizes)].tolist())
        assert got == want and q in got


def test_queries_are_sent_to_groups_not_to_buckets(spark, monkeypatch):
    sent, hashed = [], ann._hashed

    def counted(classes, hasher, queries):
        out = hashed(classes, hasher, queries)
        if queries:
            sent.append(out.count())
        return out

    monkeypatch.setattr(ann, "_hashed", counted)
    rng = np.random.default_rng(10)
    v = rng.normal(size=(8000, 24))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = result(ann.nearest(df))
    want = brute(np.arange(8000), v)
    assert sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want) >= 0.9 * 5 * len(want)
    assert len(sent) == 1 and 160 * ann.TABLES <= sent[0] <= 160 * ann.TABLES * 9
