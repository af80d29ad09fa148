import re

import duckdb
import pytest

from repurchase.llm import licenses, oracle

from .data import prose, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def plain(t):
    w, places, labels = words(t), [], set()
    for phrase, label in licenses.BASE_PHRASES:
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_places_and_labels(spark):
    rows = [
        (1, "Text.\nLicensed under CC BY-NC 4.0."),
        (2, "cc cc by cc by, all all rights reserved"),
        (3, prose(60, 1) + " This work is licensed under the GNU General Public License, version 3."),
        (4, "Released under the MIT License."),
        (5, "released under the very own MIT license " + prose(30, 2)),
        (6, prose(300, 3)),
        (7, None),
        (8, "GENERAL PUBLIC"),
        (9, "general-public_license general public license " * 50),
        (10, "Licensed under the Apache License, Version 2.0."),
        (11, "ALL RİGHTS reserved"),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(table(spark, rows)).collect()}
    for d, t in rows:
        r = got[d]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain(t), t
        assert 0 <= r["score"] <= 1
    assert got[1]["labels"] == "cc-by,cc-by-nc-4.0" and got[3]["labels"] == "gpl,gpl-3.0"
    assert got[4]["labels"] == "mit" and got[10]["labels"] == "apache-2.0" and got[6]["labels"] == ""
    assert got[5]["labels"] == "mit"  # two words put in: neighbouring diagonals


def text_of(label, least=40):
    return next(t for t, name in licenses.TEMPLATES if name == label and len(t.split()) >= least)


def test_spans_are_verified(spark):
    mit, two, three = text_of("mit"), text_of("bsd-2-clause"), text_of("bsd-3-clause")
    edited = mit.split()
    for at in range(10, len(edited), 25):
        edited[at : at + 1] = ["other", "words"]
    cases = [
        (1, "Licensed under the GNU General Public License.", "gpl"),
        (2, "licensed under the GNU General Public License version 2", "gpl,gpl-2.0"),
        (3, "Licensed under CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa-4.0"),
        (4, "Licensed under CC BY-SA 4.0; code is licensed under CC BY 4.0", "cc-by,cc-by-4.0,cc-by-sa-4.0"),
        (5, "licensed under the GNU Lesser General Public License version 3", "gpl,lgpl"),
        (6, "license mit the under released", ""),
        (7, prose(500, 4) + " " + mit.upper() + ". " + prose(500, 5), "mit"),
        (8, two, "bsd,bsd-2-clause"),
        (9, three, "bsd,bsd-3-clause"),
        (10, " ".join(edited), "mit"),
        (11, " ".join(three.split()[:90]), "bsd"),
        (12, text_of("gpl-3.0").replace("3", "three"), "gpl"),
        (13, f"{two}\n{mit}", "bsd,bsd-2-clause,mit"),
        (14, "licensed under cc by licensed under cc by 4 0 4 0 " * 40, "cc-by,cc-by-4.0"),
        (15, text_of("apache-2.0"), "apache-2.0"),
        (16, text_of("isc"), "isc"),
    ]
    docs = table(spark, [(d, t) for d, t, _ in cases])
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert {d: got[d]["labels"] for d, _, _ in cases} == {d: want for d, _, want in cases}
    with duckdb.connect() as con:
        con.register("documents", docs.toPandas())
        for row in con.execute(oracle.LICENSE_SCAN).fetchall():
            assert row == tuple(got[row[0]][c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"))


def test_templates_of_any_length(spark):
    long = [f"w{i}" for i in range(300)]
    cut = long[:150] + ["put", "in"] + long[150:]
    docs = table(spark, [(1, " ".join(cut)), (2, " ".join(long[:200])), (3, " ".join(long[150:] + long[:150]))])
    got = {r["doc_id"]: r for r in licenses.scan(docs, templates=((" ".join(long), "long"),)).collect()}
    assert (got[1]["labels"], got[2]["labels"], got[3]["labels"]) == ("long", "", "")
    assert got[1]["score"] == pytest.approx(294 / 297) and got[2]["score"] == pytest.approx(197 / 297)
    with pytest.raises(ValueError, match="two words"):
        licenses.scan(docs, templates=(("one", "short"),))
