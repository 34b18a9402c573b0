"""One JSON array read and written by many tasks, next to json.loads."""

import gzip
import json
import random

import pytest

from ledgertone.sources.catalog import read_catalog, write_catalog, written_size
from ledgertone.sources.json_array import read_elements, write_elements


def entries(seed, n):
    """Objects with everything that could mislead a reader that starts in the middle, and elements that are none."""
    r = random.Random(seed)
    text = lambda: "".join(r.choice(['}', '{', '"', "\\", ",", "[", "]", "a", "é", " ", "\n", '"},{"', '\\"'])  for _ in range(r.randint(0, 30)))
    out = []
    for i in range(n):
        kind = r.random()
        if kind < 0.1:
            out.append(r.choice([5, None, True, text(), [1, [2, {"x": text()}]], [], {}, 1.5]))
        elif kind < 0.2:
            out.append({"a": {"b": [{"c": text()}, {}], text(): text()}, "i": i})
        else:
            out.append({"id": i, text(): text(), "tags": [text(), text()]})
    return out


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def read(spark, path, parts=False):
    return [(r.row_id, r.item) for r in sorted(read_elements(spark, str(path), parts).collect(), key=lambda r: r.row_id)]


def check(got, made):
    assert [i for i, _ in got] == list(range(len(made)))
    for (_, item), x in zip(got, made, strict=True):
        assert item == x if isinstance(x, str) or x is None else json.loads(item) == x


@pytest.mark.parametrize("indent", [None, 2])
def test_ranges_cut_anywhere(spark, tmp_path, small_ranges, indent):
    made = entries(3 + (indent or 0), 400)
    path = tmp_path / "a.json"
    path.write_text("﻿" + json.dumps(made, indent=indent, ensure_ascii=False) + "\n", encoding="utf-8")
    assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 20
    check(read(spark, path), made)


def test_small_and_broken_arrays(spark, tmp_path):
    for k, (text, want) in enumerate([("[]", []), (" [ ] \n", []), ('[5, "x}", null]', [(0, "5"), (1, "x}"), (2, None)]), ("[{}]", [(0, "{}")]), ('[{},"}",{}]', [(0, "{}"), (1, "}"), (2, "{}")])]):
        path = tmp_path / f"{k}.json"
        path.write_text(text)
        assert read(spark, path) == want
    for k, text in enumerate(['{"a": 1}', '[{"a": 1}', '[{"a": "1]', "[{} {}]", '[{"a" 1}]', "x"]):
        path = tmp_path / f"bad{k}.json"
        path.write_text(text)
        with pytest.raises(Exception, match="JSON"):
            pytest.fail(f"{text} gave {read(spark, path)}")


def test_parts_are_one_array(spark, tmp_path, small_ranges):
    made = [x for x in entries(8, 300) if isinstance(x, dict)]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(made)], "k int, item string").repartition(9)
    for name, compression in (("plain", None), ("zipped", "gzip")):
        path = tmp_path / name
        write_elements(df, [df.k], str(path), compression=compression)
        files = sorted(path.glob("part-*"))
        raw = b"".join(f.read_bytes() for f in files)
        assert len(files) > 1 and json.loads(gzip.decompress(raw) if compression else raw) == made
        check(read(spark, path, parts=True), made)
        assert written_size(spark, str(path)).first().n_files == len(files)
        assert written_size(spark, str(path)).first().bytes == len(raw)
    write_elements(df.limit(0), [df.k], str(tmp_path / "none"))
    assert read(spark, tmp_path / "none", parts=True) == []


def test_gzip_file_and_catalog(spark, tmp_path):
    path = tmp_path / "c.json.gz"
    path.write_bytes(gzip.compress(b'[{"brand": "a}", "model": "m"}, 7, {"brand": "B"}]'))
    got = {r.row_id: (r.raw, r.note) for r in read_catalog(spark, str(path)).collect()}
    assert got[0][0] == {"brand": "a}", "model": "m"} and got[1] == (None, "entry is not an object and was skipped") and got[2][0] == {"brand": "B"}
