"""Operators on small hand-made data, against brute force where one exists."""

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgertone import schema as S
from ledgertone.operators import chunks, history, points
from ledgertone.operators.audit import audit, audit_duplicates, best_first
from ledgertone.operators.claims import settle_ids
from ledgertone.operators.fixes import apply_fixes
from ledgertone.sources.catalog import clean_catalog, read_catalog
from ledgertone.sources.change_docs import ingest_change_docs
from ledgertone.sources.curve_files import ingest_curves, scan_files
from ledgertone.streaming.jobs import stream_ingest_curves

ROW = T.StructType([T.StructField("row_id", T.LongType()), *S.CATALOG.fields])


def entry(row, **changes):
    base = dict(
        id="moondrop_chu", brand="Moondrop", model="Chu", variant="", year=2023, price_usd=20, driver_type="DD", driver_config="1DD",
        impedance=28, sensitivity=120, connector="2-pin", form_factor="IEM", tags=["Budget", "Warm", "Smooth", "Relaxed"],
        files=["data/MOONDROP/CHU.txt"],
    )
    return (row, *({**base, **changes}[f] for f in S.FIELDS))


def test_curve_files(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    files = {
        "dated.txt": "2023,05,01\n20\t50.5\n100\t52\n1000\t48\n",
        "alldates.txt": "2000 5 10\n2001 6 11\n",
        "unsorted.txt": "100 60\n20 50\n100 61\n1000 40\n",
        "index.csv": "1,20,50\n2,25,51\n3,30,52\n4,40,53\n",
        "khz.txt": "0.02 50\n1 51\n20 52\n",
        "comma.txt": chr(0xFEFF) + "20;50,5\n25;51,5\n",
        "empty.txt": "no data here\n",
    }
    for name, body in files.items():
        (data / name).write_text(body, encoding="utf-8")
    got, errors = ingest_curves(spark, str(data))
    by = {}
    for r in got.orderBy("freq").collect():
        by.setdefault(r.curve_id.rsplit("/", 1)[1], []).append((r.freq, r.spl))
    assert by["dated.txt"] == [(20, 50.5), (100, 52), (1000, 48)]
    assert by["alldates.txt"] == [(2000, 5), (2001, 6)]
    assert by["unsorted.txt"] == [(20, 50), (100, 60), (1000, 40)]
    assert by["index.csv"] == [(20, 50), (25, 51), (30, 52), (40, 53)]
    assert by["comma.txt"] == [(20, 50.5), (25, 51.5)]
    assert {r.path.rsplit("/", 1)[1] for r in errors.collect()} == {"khz.txt", "empty.txt"}
    assert {r.path for r in scan_files(spark, str(tmp_path)).collect()} == {f"data/{n}" for n in files if n.endswith(".txt")}


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(3):
        (src / f"c{i}.txt").write_text("".join(f"{20 + 10 * k}\t{50 + i + k}\n" for k in range(30)))
    query = stream_ingest_curves(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    batch, _ = ingest_curves(spark, str(src))
    stored = spark.read.parquet(str(tmp_path / "out" / "points")).select("curve_id", "freq", "spl")
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, batch.select("curve_id", "freq", "spl").collect()))


def test_interpolation_and_average(spark):
    curve = spark.createDataFrame([("a", 10.0, 1.0), ("a", 20.0, 2.0)], "curve_id string, freq double, spl double")
    grid = spark.createDataFrame([("a", float(f)) for f in (5, 10, 15, 20, 25)], "curve_id string, freq double")
    assert [r.spl for r in points.interpolate(curve, grid).orderBy("freq").collect()] == [1, 1, 1.5, 2, 2]
    a = spark.createDataFrame([("k", 20.0, 50.0), ("k", 100.0, 60.0), ("k", 1000.0, 40.0)], curve.schema)
    b = spark.createDataFrame([("k", 100.0, 62.0), ("k", 1000.0, 42.0)], curve.schema)
    assert [(r.freq, r.spl) for r in points.average_pair(a, b).orderBy("freq").collect()] == [(100, 61), (1000, 41)]


def test_flat_curve_is_a_fixed_point_of_smoothing(spark):
    flat = spark.createDataFrame([("a", 20.0 * 1.03**i, 5.0) for i in range(200)], "curve_id string, freq double, spl double")
    assert {r.spl for r in points.smooth_octaves(flat).collect()} == {5.0}


def test_smoothing_equals_the_mean_of_each_window(spark):
    """Ties, borders that points lie on, repeated rows, null levels and places, a short curve, a clashing column."""
    rng = random.Random(8)
    rows = [("a", 2.0 ** (5 + rng.randrange(100) / 25), rng.randrange(-9000, 9000) / 1000, "x") for _ in range(300)]
    rows += rows[:5] + [("a", 40.0, None, "x"), ("a", None, 1.0, "x"), ("a", -1.0, 1.0, "x"), ("a", 1e9, None, "far")]
    rows += [("b", 100.0 + i, float(i), "y") for i in range(4)]
    df = spark.createDataFrame(rows, "curve_id string, freq double, spl double, _n string")
    df = df.withColumnRenamed("_n", "note")
    got = sorted((tuple(r) for r in points.smooth_octaves(df, 1 / 12).collect()), key=str)
    want = []
    for c, f, v, note in rows:
        if c == "b":
            want.append((c, f, v, note))
        elif f is not None and f > 0:
            x = math.log(f) / math.log(2)
            near = [w for d, g, w, _ in rows if d == c and g and g > 0 and w is not None and x - 1 / 24 <= math.log(g) / math.log(2) <= x + 1 / 24]
            want.append((c, f, round(sum(map(Decimal, map(str, near))), 6).__float__() / len(near) if near else None, note))
    assert got == sorted(want, key=str)


def test_chunks_equal_greedy_fill(spark):
    rng = random.Random(4)
    rows = [(g, i, rng.choice([1, 5, 30, 90, 150, 900])) for g in ("a", "b") for i in range(400)] + [("c", 0, 7)]
    df = spark.createDataFrame(rows, "grp string, row_id long, t long").withColumn("row_id", F.col("row_id") + F.when(F.col("grp") == "b", 1000).otherwise(F.when(F.col("grp") == "c", 5000).otherwise(0)))
    for per_block in (1, 4, 256):
        out = chunks.chunk_by_tokens(df, F.col("t"), ["row_id"], group_cols=["grp"], max_tokens=200, budgets_per_block=per_block)
        got = {(r.grp, r.row_id): r.chunk for r in out.collect()}
        for g, base in (("a", 0), ("b", 1000), ("c", 5000)):
            cur, chunk = 0, 1
            for _, i, t in [r for r in rows if r[0] == g]:
                if cur and cur + t > 200:
                    cur, chunk = 0, chunk + 1
                cur += t
                assert got[g, i + base] == chunk, (per_block, g, i)


@pytest.mark.parametrize("by", ["set", "holders"])
def test_ids_settle_like_one_after_the_other(spark, by):
    rng = random.Random(5)
    for turn in range(4):
        owners = [f"i{k}" for k in range(12)] + ["i0", "i1", "i1"] * (turn % 2)
        rows = rng.sample(range(len(owners)), 10)
        claims = [(seq, owners[row], f"i{rng.randrange(16)}") for seq, row in enumerate(rows)]
        live, holds, want = set(owners), list(owners), {}
        for (seq, was, new), row in zip(claims, rows, strict=True):
            free = new not in live if by == "set" else new not in holds
            want[seq] = ok = new == was or free
            if ok and new != was:
                live.discard(was)
                live.add(new)
                holds[row] = new
        got = settle_ids(
            spark.createDataFrame(claims, "seq long, old_id string, new_id string"),
            spark.createDataFrame([(o,) for o in owners], "id string"),
            by,
        )
        assert {r.seq: r.accepted for r in got.collect()} == want


def test_a_refused_fix_leaves_the_others(spark):
    rows = [
        entry(0, model="Kato", id="moondrop_kato"),
        entry(1, model="Kato", id="x", price_usd=22, driver_type="BA"),
        # both hold one id; one of them leaves it, so the third may not have it
        entry(2, id="moondrop_m9", model="Aria"),
        entry(3, id="moondrop_m9", model="M9"),
        entry(4, id="y", model="M9", files=[" data\\x.txt"]),
    ]
    catalog = spark.createDataFrame(rows, ROW)
    after, _, rejected = apply_fixes(catalog, audit(catalog, pairs=False))
    fixed = {r.row_id: r for r in after.collect()}
    assert (fixed[1].id, fixed[1].price_usd, fixed[1].driver_type) == ("x", 20, "DD")
    assert (fixed[2].id, fixed[3].id, fixed[4].id) == ("moondrop_aria", "moondrop_m9", "y")
    assert fixed[4].files == ["data\\x.txt"]
    assert {(r.row_id, r.reason) for r in rejected.collect()} == {(1, "id is taken: moondrop_kato"), (4, "id is taken: moondrop_m9")}


def test_shared_files_and_names_stay_linear(spark):
    many = [entry(i, model="Chu", id="moondrop_chu", files=["data/a.txt"]) for i in range(60)]
    few = [entry(100 + i, brand="Sony", model=f"Quest {'a' * i}", id=f"s{i}", files=["data/b.txt"]) for i in range(5)]
    catalog = spark.createDataFrame(many + few, ROW)
    link, link_rows, name, name_rows = audit_duplicates(catalog)
    got = {r.subject: r.message for r in link.collect()}
    assert "1770 pairs" in got["dup|link|data/a.txt"] and "10 pairs" in got["dup|link|data/b.txt"]
    assert link_rows.count() == 59 + 4 and name_rows.count() == 59
    assert "1770 row pairs" in name.where("subject LIKE '%|chu|chu'").first().message
    ranked = [r.confidence for r in best_first(link.unionByName(link_rows).unionByName(name).unionByName(name_rows)).collect()]
    assert ranked == sorted(ranked, key=["high", "medium", "low"].index)


def test_fixes_leave_nothing_to_fix(spark):
    rows = [
        entry(0),
        entry(1, id="wrong", model="Aria", price_usd=22, driver_config="1BA + 1DD", driver_type="DD", tags=["Premium", "Warm", "Smooth", "Relaxed"], files=[" a\\b.txt", ""]),
        entry(2, id="moondrop_chu", model="Kato", impedance=-5),
    ]
    catalog = spark.createDataFrame(rows, ROW)
    after, log, rejected = apply_fixes(catalog, audit(catalog, pairs=False))
    fixed = {r.row_id: r for r in after.collect()}
    assert fixed[1].id == "moondrop_aria" and fixed[1].price_usd == 20 and fixed[1].driver_config == "1DD+1BA"
    assert fixed[1].tags[0] == "Budget" and fixed[2].impedance == 0 and fixed[2].id == "moondrop_kato"
    assert rejected.count() == 0 and {r.row_id for r in log.collect()} == {1, 2}
    assert {tuple(r) for r in history.undo(after, log, [1]).select("row_id", "id", "price_usd").collect()} == {
        tuple(r) for r in catalog.select("row_id", "id", "price_usd").collect()
    }


def test_clean_catalog_notes(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text('[{"brand": " Moondrop ", "impedence": 18, "price_usd": "$1,299", "year": "1_0", "tags": ["a", null, {"x": 1}, " "]}, 5]')
    catalog, notes = clean_catalog(read_catalog(spark, str(path)))
    row = catalog.first()
    assert (row.brand, row.price_usd, row.year, row.tags, row.files) == ("Moondrop", 1299, 0, ["a"], [])
    found = {(r.field, r.message) for r in notes.collect()}
    assert ("impedence", "unknown field dropped; did you mean impedance") in found
    assert {f for f, _ in found} == {"impedence", "price_usd", "year", "tags", ""}


def test_change_documents(spark):
    docs = [
        (1, '[{"id": "a"}, 3]'),
        (2, '// note\nSEARCH:\n{"id": "x"}\nREPLACE:\n{"id": "y", "price_usd": 5}'),
        (3, 'SEARCH: {"id": "x"} REPLACE: null'),
        (4, 'text {"id": "q", "model": "a { b"} more {"id": "cut'),
        (5, 'so {"id": "n", "x": {"y": {"z": [1, {"w": "}"}]}}} it is'),
    ]
    found, errors = ingest_change_docs(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {(r.doc_id, r.kind, (r.search or {}).get("id"), (r.replace or {}).get("id")) for r in found.collect()}
    assert got == {(1, "entry", None, "a"), (2, "pair", "x", "y"), (3, "pair", "x", None), (4, "entry", None, "q"), (5, "entry", None, "n")}
    assert {r.doc_id for r in errors.collect()} == {1, 4}
