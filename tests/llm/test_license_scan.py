import re

import pytest

from tessera.llm import license_scan as s


def grams(text):
    w = re.sub(r"(?:[^\w.]|_|\.(?![0-9])|(?<![0-9])\.)+", " ", text.lower()).strip().split(" ")
    return set(zip(w, w[1:]))


def parts(text):
    for n, line in enumerate(text.split("\n")):
        yield "line", n, line
    paragraphs = re.split(r"\n[ \t\r]*\n", text)
    for n, p in enumerate(paragraphs):
        if "\n" in p.strip("\n\r\t "):
            yield "paragraph", n, p
    if len(paragraphs) > 1:
        yield "text", 0, text


def wrapped(text, width=60):
    out, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            out.append(line.strip())
            line = ""
        line += " " + w
    return "\n".join([*out, line.strip()])


def test_matches_brute_force(make_docs):
    mit = next(t for k, t in s.TEMPLATES if t.startswith("MIT License"))
    file = mit.replace("MIT License. ", "MIT License\n\nCopyright (c) 2020 Some One\n\n").replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")
    rows = [
        (1, "Some prose here.\nReleased under the MIT License!\nmore"), (2, "licensed under the apache license version 2.0"),
        (3, "this work is licensed under the GNU general public license, version 3. thanks"), (4, "For For For For For For"), (5, "MIT License"),
        (6, "A first paragraph.\n\n" + wrapped(next(t for k, t in s.TEMPLATES if k == "LGPL-3.0")) + "\n \nlast"), (7, "\n\n".join(wrapped(p) for p in file.split("\n\n"))),
        (8, "This work is licensed under the GNU General Public License, version 2."),
    ]
    want = set()
    for doc, text in rows:
        for unit, n, body in parts(text):
            a = grams(body)
            dice = [(-2 * len(a & grams(notice)) / max(1, len(a) + len(grams(notice))), k) for k, (_, notice) in enumerate(s.TEMPLATES)]
            if a and -min(dice)[0] >= s.THRESHOLD:
                want.add((doc, unit, n, min(dice)[1]))
    got = s.scan(make_docs(rows)).collect()
    assert {(r.doc_id, r.unit, r.place, r.template) for r in got} == want and len(got) == len(want)
    assert {d for d, *_ in want} == {1, 2, 3, 6, 7, 8} and {r.license for r in got if r.doc_id == 8} == {"GPL-2.0"}
    assert {r.license for r in got if r.doc_id == 3} == {"GPL-3.0"} and (7, "text") in {(r.doc_id, r.unit) for r in got}


def test_edges(make_docs, edge_docs):
    assert s.scan(edge_docs).count() == 0 and s.scan(edge_docs.limit(0)).count() == 0
    twice = make_docs([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "Released under the MIT License."), (2, "x " * 50_000 + "\nReleased under the MIT License.")])
    assert sorted((r.doc_id or -1, r.place, r.dice) for r in s.scan(twice).collect()) == [(-1, 0, 1.0), (1, 0, 1.0), (2, 1, 1.0)]
    for bad in ({"threshold": 0}, {"templates": []}):
        with pytest.raises(ValueError):
            s.scan(edge_docs, **bad)


def test_no_python_in_the_plan(make_docs):
    plan = s.scan(make_docs([(1, "a b")]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_rows_of_one_id_are_compared_by_themselves(make_docs):
    half, rest = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "and associated documentation files, to deal in the Software without restriction."
    assert s.scan(make_docs([(1, half), (1, rest)])).count() == 0
