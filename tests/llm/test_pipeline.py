import corpus_pipeline
from tessera.llm import line_dedup, quality, sentencepiece_fst, simhash
from tessera.llm.common import table

from .test_decontamination import holds

DIR = "/root/testdata/sf0.001"


def test_each_stage_on_what_the_one_before_kept(spark, tmp_path):
    docs = table(spark, DIR, "documents")
    columns, labels = docs.columns, table(spark, DIR, "labels")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        if name != "tokens":
            assert out.columns == columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        out.write.parquet(str(tmp_path / name))
        rows, out = {r.doc_id: r for r in docs.collect()}, spark.read.parquet(str(tmp_path / name))
        got = {r.doc_id: r for r in out.collect()}
        if name == "quality":
            model = quality.train(docs, labels, ~quality.held_out(2, 4))
            assert set(got) == {i for i, r in rows.items() if quality.strength(quality.features(r.text)[None], model)[0] >= 0}
        elif name == "line_dedup":
            seen, want = [], {}
            for i in sorted(rows):
                kept = []
                for line in rows[i].text.split("\n"):
                    words = {w for w in line.lower().split(" ") if w}
                    if not words or not any(5 * len(words & s) >= 4 * len(words | s) for s in seen):
                        kept.append(line)
                    if words:
                        seen.append(words)
                want[i] = "\n".join(kept)
            assert {i: r.text for i, r in got.items()} == {i: t for i, t in want.items() if t}
            assert all(r.n_chars == len(r.text) for r in got.values())
        elif name == "near_duplicates":
            prints = {i: simhash.fingerprint(r.text) for i, r in rows.items()}
            left, kept = set(prints), set()
            while left:
                group, todo = set(), [min(left)]
                while todo:
                    x = todo.pop()
                    if x in left:
                        left.discard(x)
                        group.add(x)
                        todo += [y for y in left if bin(prints[x] ^ prints[y]).count("1") <= 4]
                kept.add(min(group))
            assert set(got) == kept
        elif name == "decontamination":
            items = [r.text for r in table(spark, DIR, "benchmark").collect()]
            leaky = {i for i, r in rows.items() if any(holds(r.text, t) for t in items)}
            assert set(got) == set(rows) - leaky
        else:
            machine = sentencepiece_fst.Transducer(sentencepiece_fst.read_model())
            assert all(machine.decode(machine.encode(rows[i].text)) == rows[i].text and list(r.ids) == machine.encode(rows[i].text).tolist() for i, r in got.items())
            assert set(got) == set(rows)
        docs = out


def test_run(spark):
    got = corpus_pipeline.run(spark, DIR)
    assert got.columns == ["doc_id", "ids", "n_pieces", "round_trip"] and got.where("not round_trip").count() == 0 and got.count() > 50


def test_stages_take_empty_and_odd_rows(spark, make_docs, edge_docs):
    odd = edge_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), DIR).count() == 0, name
        assert stage(spark, odd, DIR).count() <= odd.count(), name
    assert line_dedup.deduplicated(odd).count() == odd.count()


def test_filter_stages_lose_no_rows_of_their_own(spark, make_docs):
    kept = ["some quite plain words stand here alone", "nothing of this is like the others at all", "", None]
    docs = make_docs([(None, kept[0]), (None, kept[1]), (4, kept[2]), (5, "same text of many rows here"), (5, "same text of many rows here"), (5, "not like any other text in here"), (None, "same text of many rows here"), (2, "x y"), (2, "X  y")])
    near = corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()
    want = [(-1, kept[1]), (-1, kept[0]), (2, None), (4, ""), (5, "not like any other text in here"), (5, "same text of many rows here")]
    assert sorted((r.doc_id or -1, r.text if r.doc_id != 2 else "") for r in near) == sorted((i, t or "") for i, t in want)
    docs = make_docs([(1, None), (2, ""), (3, "a b c"), (4, "a b c"), (None, "d e f"), (4, " \n")])
    lines = corpus_pipeline.line_dedup_stage(spark, docs, "").collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in lines) == [(-1, "d e f"), (1, ""), (2, ""), (3, "a b c"), (4, " \n")]
    assert [r.text for r in lines if r.doc_id == 1] == [None]
