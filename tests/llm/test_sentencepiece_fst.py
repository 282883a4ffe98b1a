import random

import numpy as np
import pytest
import sentencepiece

from tessera.llm import sentencepiece_fst as s


@pytest.fixture(scope="module")
def machine():
    return s.Transducer(s.read_model())


def texts():
    rng = random.Random(3)
    signs = "ab  thein▁\n\té漢字🙂ngüß<s>0x"
    out = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    out += ["".join(rng.choice("aeinrstohl ") for _ in range(80)) for _ in range(1000)]
    return out + [" " * 30, "a" * 500, " lead", "trail ", "Hello, World! def f(x):\n        return x", "\r\n\v", " x"]


def test_same_pieces_as_the_model_gives(machine):
    model = sentencepiece.SentencePieceProcessor(model_file=s.MODEL)
    for text in texts():
        ids = machine.encode(text)
        assert ids.tolist() == model.encode(text)
        assert machine.decode(ids) == model.decode(ids.tolist())


def test_round_trip(machine):
    assert all(machine.decode(machine.encode(t)) == t.replace("▁", " ") for t in texts())


def test_unigram_path_is_the_least(monkeypatch):
    pieces = ["<unk>", "▁", "a", "b", "ab", "▁a", "bb", "abb", "▁ab"]
    scores = [0.0, -2.0, -3.0, -3.5, -4.0, -3.9, -4.5, -9.0, -8.5]
    model = {"pieces": pieces, "scores": scores, "kinds": [2] + [1] * 8, "bpe": False, "prefix": True, "fallback": False}
    machine = s.Transducer(model)

    def best(text):
        if not text:
            return 0.0
        return max((scores[pieces.index(text[:n])] + best(text[n:]) for n in range(1, len(text) + 1) if text[:n] in pieces[1:]), default=float("-inf"))

    for text in ("abb", "aab", "b", "abab bb a"):
        ids = machine.encode(text)
        normal = "▁" + text.replace(" ", "▁")
        assert "".join(pieces[i] for i in ids) == normal
        assert sum(scores[i] for i in ids) == pytest.approx(best(normal))
    assert machine.encode("xyz").tolist() == [1, 0]  # neighbouring unknowns are one


def test_path_taken_is_the_least_of_all_accepted(machine):
    def accepted(unit, i=0, last=-1):
        if i == len(unit):
            yield [], 0.0
            return
        for j, token, weight in machine.arcs(unit, i):
            if machine.follows(last, token):
                for rest, more in accepted(unit, j, token):
                    yield [token, *rest], weight + more

    rng = random.Random(6)
    for _ in range(300):
        unit = " " + "".join(rng.choice("aeinrsthol漢é") for _ in range(rng.randint(1, 12)))
        found = sorted(accepted(unit), key=lambda x: x[1])
        path, weight = machine.least(unit)
        assert (path, weight) == (found[0][0], pytest.approx(found[0][1])) and len(found) == 1


def test_ids_outside_the_vocabulary_are_an_error(machine):
    for bad in (-1, len(machine.text)):
        with pytest.raises(IndexError):
            machine.decode(np.array([5, bad]))


def test_full_caches_change_nothing(machine, monkeypatch):
    monkeypatch.setattr(s, "CACHED_WORDS", 3)
    monkeypatch.setattr(s, "CACHED_PAIRS", 3)
    small = s.Transducer(s.read_model())
    assert all((small.encode(t) == machine.encode(t)).all() for t in texts()[:300])


def test_frames(edge_docs):
    got = s.encode(edge_docs).collect()
    assert len(got) == edge_docs.count() and all(len(r.ids) == r.n_pieces for r in got)
    assert {(r.doc_id, r.round_trip) for r in got if not r.round_trip} == {(8, False)}  # it holds the space mark
    assert {r.doc_id for r in got if r.n_pieces == 0} == {1, 2}
    back = {(r.doc_id, r.text) for r in s.decode(s.encode(edge_docs)).collect()}
    assert {(2, ""), (1, ""), (4, "one"), (7, "same line here\nsame line here"), (6, "x" * 100_000)} <= back
    assert s.encode(edge_docs.limit(0)).count() == 0
    assert np.array(got[0].ids).dtype.kind in "if"
