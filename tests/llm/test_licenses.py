"""Notices against the comparison of every template with every place, and planted changes of wording."""

import random
import re

import pytest
from pyspark.sql import types as T

from ledgertone.llm import licenses as L
from ledgertone.llm import queries
from ledgertone.llm.license_texts import LONG, SHORT

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("license", T.IntegerType()), T.StructField("start", T.StringType())])


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioust") for _ in range(5)) for _ in range(n))


def test_every_template_is_found_and_holds_a_cue():
    rng = random.Random(0)
    for name, text, _ in L.templates():
        assert re.search(L.CUE, text), text
        for shown in (text, text.upper(), text.replace(" ", "\n * ")):
            got = L.notices(prose(rng, 40) + "\n" + shown + "\n" + prose(rng, 40))
            assert [r["license"] for r in got] == [name], (text, got)
            if shown == text:
                assert got[0]["n_different"] == 0


def test_changed_wording():
    rng = random.Random(1)
    own = LONG["MIT"].split()
    own[10:12] = ["some", "extra", "thing"]
    got = L.notices(prose(rng, 10) + " " + " ".join(own) + " " + prose(rng, 10))
    assert [(r["license"], r["n_different"], r["other"]) for r in got] == [("MIT", 5, ["some", "extra", "thing"])]
    two = SHORT["Apache-2.0"][0] + "\n" + prose(rng, 300) + "\n" + SHORT["CC-BY-NC-4.0"][0]
    assert [r["license"] for r in L.notices(two)] == ["Apache-2.0", "CC-BY-NC-4.0"]
    assert [two[r["start"] : r["end"]] for r in L.notices(two)] == [SHORT["Apache-2.0"][0], SHORT["CC-BY-NC-4.0"][0]]
    # another version or licence is not a change of wording
    assert [r["license"] for r in L.notices("Licensed under the Apache License, Version 7.5.")] == []
    assert [r["license"] for r in L.notices("This work is licensed under the GNU General Public License, version 2.")] == ["GPL-2.0"]


def test_reworded_against_every_template():
    """Words dropped, replaced and put in, up to what is allowed: all that comparing every template with the whole text finds."""
    rng = random.Random(7)
    seen = 0
    for _ in range(250):
        own = list(rng.choice(L.templates())[2])
        most = int(len(own) - L.KEPT * len(own))
        for at in sorted(rng.sample([i for i, w in enumerate(own) if w not in L.TELLING], rng.randint(0, most)), reverse=True):
            own[at : at + 1] = rng.choice([[], [prose(rng, 1)], [own[at], prose(rng, 1)]])
        text = " ".join([prose(rng, rng.randint(1, 300)), *own, prose(rng, rng.randint(1, 300))])
        if not re.search(L.CUE, text):
            continue
        have, fits = [L.bare(w) for w in text.split()], []
        for k, (_, _, want) in enumerate(L.templates()):
            if (closest := L.differences(want, have)) is None:
                continue
            a, b, missing, other = closest
            if max(len(missing), len(other)) <= len(want) - L.KEPT * len(want):
                fits.append((L.saving(have[a:b], k), k, b - a, missing, other))
        got = L.notices(text)
        assert len(got) == 1 and (got[0]["bytes_saved"], got[0]["template"], got[0]["n_words"], got[0]["missing"], got[0]["other"]) in fits, (own, got, fits)
        assert got[0]["bytes_saved"] == max(fits)[0]
        seen += got[0]["n_different"] > 0
    assert seen > 80


def test_only_ranked_windows_are_compared(monkeypatch):
    """Words are compared where a template saves bytes, and nowhere if none does."""
    asked = []
    plain = L.differences
    monkeypatch.setattr(L, "differences", lambda want, have: asked.append(want) or plain(want, have))
    text = prose(random.Random(8), 50) + " " + SHORT["MIT"][0] + " " + prose(random.Random(9), 50)
    assert len(L.notices(text)) == 1 and 0 < len(asked) < len(L.templates()) / 2
    asked.clear()
    assert L.notices("a warranty " + prose(random.Random(8), 200)) == [] and not asked
    monkeypatch.setattr(L, "saving", lambda words, k: 0)
    assert L.notices(text) == [] and not asked


def test_notices_in_long_blocks():
    """Cues all along a long text join its windows to one block, which hides no notice."""
    rng = random.Random(2)
    parts, want = [], []
    for k in range(200):
        parts.append(prose(rng, 99) + " licence")
        if k % 10 == 5:
            name, text, _ = L.templates()[k // 10]
            want.append((name, sum(map(len, parts)) + len(parts), 0))
            parts.append(text)
    assert [(r["license"], r["start"], r["n_different"]) for r in L.notices(" ".join(parts))] == want
    # many equal notices side by side
    assert len(L.notices("\n".join([SHORT["MIT"][0], prose(rng, 3)] * 500))) == 500


def test_beside_a_rejected_stretch():
    rng = random.Random(4)
    for n in (0, 3, 50):
        between = " " + prose(rng, n) + " "
        for text in ("Released under the BSD License." + between + "Released under an MIT License.", "Released under an MIT License." + between + "Released under the BSD License."):
            got = L.notices(text)
            assert [(r["license"], text[r["start"] : r["end"]]) for r in got] == [("MIT", "Released under an MIT License.")]


@pytest.mark.parametrize("text", ["", None, " \n", "the licence of the driver was lost with a copyright", "permission", "warranty " * 500])
def test_no_notice(text):
    assert L.notices(text) == []


def test_operator(spark):
    line = SHORT["MIT"][0]
    rows = [(1, f"x y\n{line}\nz"), (1, f"x y\n{line}\nz"), (None, line), (2, None), (3, ""), (4, "plain words"), (5, "pad " * 30_000 + line)]
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], SCHEMA)
    got = L.find_notices(df).collect()
    assert sorted((str(r["doc_id"]), r["license"], r["start"]) for r in got) == sorted([("1", "MIT", 4), ("1", "MIT", 4), ("None", "MIT", 0), ("5", "MIT", 120_000)])
    assert L.find_notices(df.limit(0)).count() == 0


def test_query_against_every_template(spark):
    """Lines of the table that hold a template word for word, found by plain comparison."""
    want = set()
    shown = [(name, re.compile(r"(?<!\S)" + r"\s+".join(map(re.escape, t.split())) + r"(?!\S)")) for name, t, _ in L.templates()]
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for name, pattern in shown:
            want |= {(r["doc_id"], name, m.start()) for m in pattern.finditer(r["text"] or "")}
    got = {(r["doc_id"], r["license"], r["start"]) for r in queries.QUERIES["op6_licenses"](spark, SF).collect() if r["n_different"] == 0}
    assert want and got == want
