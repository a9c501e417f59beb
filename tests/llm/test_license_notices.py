"""License notices: own labels only, wrapped over lines, and words scattered over a long line."""

import pytest
from pyspark.sql import functions as F

from sievekit.llm import licenses

NO_PHRASE = {"no such phrase": "none"}


@pytest.fixture(scope="module")
def labels(spark):
    def scan(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return [r["labels"] for r in licenses.license_scan(df, phrases=NO_PHRASE).orderBy("doc_id").collect()]
    return scan


def test_each_notice_gets_only_its_own_label(labels):
    assert labels(licenses.TEMPLATES.values()) == list(licenses.TEMPLATES)
    others = ["Licensed under the GNU General Public License.", "Released under the Apache License.",
              "Licensed under CC BY 4.0", "Licensed under a Creative Commons Attribution license",
              "Subject to the terms of the Eclipse Public License",
              "This work is licensed under the GNU Lesser General Public License version 3"]
    assert labels(others) == ["", "", "", "", "", "lgpl"]


def test_a_notice_may_be_wrapped_anywhere(labels):
    texts, want = [], []
    for label, notice in licenses.TEMPLATES.items():
        w = notice.split()
        for cut in range(1, len(w)):
            texts.append("Some file\n * " + " ".join(w[:cut]) + "\n * " + " ".join(w[cut:]) + ".\nEnd.")
            want.append(label)
    assert labels(texts) == want


def test_scattered_words_are_no_notice(labels):
    scattered = [" ".join(f"{w} one two three four" for w in n.split()) for n in licenses.TEMPLATES.values()]
    assert labels(scattered) == [""] * len(scattered)


def test_a_notice_among_scattered_words(labels):
    far = [" ".join(f"{w} one two three four" for w in n.split()) for n in licenses.TEMPLATES.values()]
    assert labels([f"{x} {n} {x}" for x, n in zip(far, licenses.TEMPLATES.values())]) == list(licenses.TEMPLATES)


def test_only_ascii_letters_are_lowered(spark):
    """The Kelvin sign is no k, and a dotted capital I no i; A-Z are lower-cased everywhere."""
    words = spark.createDataFrame([("CC BY K İ x",)], "t string").select(licenses.scan_words(F.col("t")).alias("w")).first()["w"]
    assert words == ["cc", "by", "K", "İ", "x"]


def test_every_block_by_hand(spark):
    """Labels and best share against all blocks of every template's length, for notices cut, doubled and mixed."""
    import random
    rng = random.Random(3)
    notices = [n.split() for n in licenses.TEMPLATES.values()]
    filler = ["lorem", "the", "license", "under", "a", "lesser", "gnu", "2", "0"]
    texts = []
    for _ in range(150):
        words = []
        for _ in range(rng.randint(1, 3)):
            n = list(rng.choice(notices))
            for _ in range(rng.randint(0, 3)):
                n[rng.randrange(len(n))] = rng.choice(filler)
            words += [rng.choice(filler) for _ in range(rng.randint(0, 6))] + n[rng.randint(0, 2):]
        texts.append(" ".join(words).upper() if rng.random() < 0.2 else "\n".join(words))
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), phrases={"zz zz": "zz"}).collect()}
    sets, (num, den) = licenses.template_sets(licenses.TEMPLATES), licenses.THRESHOLD
    for k, t in enumerate(texts):
        w = "".join(c if c.isalnum() else " " for c in t.lower()).split()
        labels, best = set(), 0.0
        for label, s in sets.items():
            size = -(-len("".join(c if c.isalnum() else " " for c in licenses.TEMPLATES[label]).split()) * den // num)
            for i in range(len(w)):
                b = set(w[i:i + size])
                if den * len(b & set(s)) >= num * len(s) and set(licenses.TELLING.get(label, [])) <= b \
                        and not b & set(licenses.FOREIGN.get(label, [])):
                    labels.add(label)
                    best = max(best, len(b & set(s)) / len(s))
        assert got[k]["labels"] == ",".join(sorted(labels)) and abs(got[k]["score"] - best) < 1e-9, t
