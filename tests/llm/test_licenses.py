"""Notices planted in the table and in odd places, and calibration on examples held back."""

import random
import re
import textwrap

import numpy as np
import pytest

from tests.llm.util import documents, no_rows, odd_documents, table
from tianguis.llm import licenses
from tianguis.llm.queries import op2_license_scans
from tianguis.llm.ragged import Powers

LINES = {
    "This work is licensed under the GNU General Public License, version": "gpl",
    "Licensed under CC BY": "cc",
    "Released under the MIT License.": "mit",
    "Licensed under the Apache License, Version": "apache",
}


def planted(text):
    return ",".join(sorted({f for line in text.split("\n") for k, f in LINES.items() if k in line}))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op2_finds_what_the_table_holds(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    docs = {r.doc_id: r.text for r in table(spark, "documents", sf_dir).collect()}
    got = {r.doc_id: r for r in op2_license_scans(spark, sf_dir).collect()}
    assert len(got) == len(docs) and any(planted(t) for t in docs.values())
    assert {d: r.families for d, r in got.items()} == {d: planted(t) for d, t in docs.items()}
    for d, r in got.items():
        for place in filter(None, r.places.split(",")):
            family, a, b = place.split(":")
            assert planted(docs[d][int(a) : int(b)] + "") in (family, "") and re.search("(?i)licen", docs[d][int(a) : int(b)])


def test_every_template_is_found_and_plain_text_is_not(spark):
    r = random.Random(1)
    words = ["the", "license", "under", "version", "public", "general", "terms", "free", "software", "river", "é"]
    plain = [" ".join(r.choice(words) for _ in range(60)) for _ in range(150)]
    noted = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts]
    texts = plain + [f"{p}\n  {t.upper() if i % 2 else t}.\n{p}" for i, ((_, t), p) in enumerate(zip(noted, plain, strict=False))]
    got = {x.doc_id: x.families for x in licenses.summary(documents(spark, texts)).collect()}
    assert all(not got[i] for i in range(150))
    right = [got[150 + i] == f for i, (f, _) in enumerate(noted)]
    assert np.mean(right) >= 0.9


def test_probabilities_are_calibrated():
    r = random.Random(3)
    plain = [" ".join(r.choice("abcdefghijklmnop") * r.randrange(1, 4) for _ in range(30)).encode() for _ in range(500)]
    model = licenses.fit(plain)
    texts, labels = licenses._notices(plain, random.Random(99))
    windows = licenses.Windows([b" ".join(t.split()[:48]) for t in texts], Powers())
    p = model.probabilities(windows)
    assert len(p) == len(labels)
    right = p.argmax(axis=1) == labels
    assert right.mean() > 0.95 and abs(p.max(axis=1).mean() - right.mean()) < 0.1


def test_odd_and_no_documents(spark):
    df = odd_documents(spark)
    rows = licenses.summary(df).collect()
    assert len(rows) == 10 and all(x.n_notices == 0 and x.families == "" and x.places == "" for x in rows)
    assert licenses.summary(no_rows(df)).count() == 0


def test_a_notice_within_a_long_line(spark):
    text = " ".join(f"w{i}" for i in range(200)) + " Released under the MIT License. " + " ".join(f"v{i}" for i in range(200))
    (row,) = licenses.notices(documents(spark, [text])).collect()
    assert [n.family for n in row.notices] == ["mit"] and "Released under the MIT License" in text[row.notices[0].start : row.notices[0].end]


def test_far_notices_of_one_line(spark):
    """Each notice of a family counts, however long the line; one notice seen in several windows counts once."""
    some = lambda n: " ".join(f"w{i}" for i in range(n))
    mit, bsd = "Released under the MIT License.", "Licensed under the BSD 3-Clause License"
    texts = [f"{some(30)} {mit} {some(n)} {mit} {some(40)} {bsd} {some(300)}" for n in (10_000, 60, 40)]
    rows = licenses.notices(documents(spark, texts)).orderBy("doc_id").collect()
    for row, text in zip(rows, texts, strict=True):
        assert [n.family for n in row.notices] == ["mit", "mit", "bsd"]
        assert all((mit if n.family == "mit" else bsd).rstrip(".") in text[n.start : n.end] for n in row.notices)
    assert licenses.places(b"x of the " * 3 + b"Released under the MIT License and " * 2, "mit") != []


@pytest.mark.parametrize("width", [60, 70, 80])
def test_every_template_is_found_when_wrapped(spark, width):
    """Wrapped between other lines, plain and behind comment marks."""
    r = random.Random(width)
    noted = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts for _ in range(3)]
    texts = []
    for i, (_, t) in enumerate(noted):
        mark = ("", " * ", "# ")[i % 3]
        before = " ".join(f"word{r.randrange(900)}" for _ in range(r.randrange(12)))
        texts.append(f"int main\n{mark}Copyright\n" + "\n".join(mark + x for x in textwrap.wrap(f"{before} {t}.", width)) + f"\n{mark}\nreturn value of main\n")
    plain = [" ".join(f"word{r.randrange(900)}" for _ in range(40)) for _ in range(150)]
    got = {x.doc_id: x.families for x in licenses.summary(documents(spark, texts + plain)).collect()}
    assert not any(got[len(texts) + i] for i in range(len(plain)))
    missed = [(f, t) for i, (f, t) in enumerate(noted) if f not in got[i].split(",")]
    assert not missed
