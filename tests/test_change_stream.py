"""Reply documents applied to a catalog batch by batch."""

import json

from ledgertone import schema as S
from ledgertone.streaming.jobs import stream_apply_changes
from test_operators import ROW, entry


def reply(**fields):
    return json.dumps({**dict(zip(S.FIELDS, entry(0, files=[])[1:], strict=True)), **fields})


def test_batches_follow_each_other(spark, tmp_path):
    path, src = str(tmp_path / "out"), tmp_path / "docs"
    src.mkdir()
    start = spark.createDataFrame([entry(0), entry(1, id="moondrop_kato", model="Kato", files=["data/k.txt"])], ROW)
    start.write.parquet(f"{path}/catalog/version=0")
    docs = spark.readStream.schema("doc_id string, text string").json(str(src))

    def run(name, rows):
        (src / name).write_text("".join(json.dumps({"doc_id": d, "text": t}) + "\n" for d, t in rows))
        stream_apply_changes(docs, path, str(tmp_path / "ck")).awaitTermination(200)

    def models(version):
        return {r["id"]: (r["row_id"], r["price_usd"]) for r in spark.read.parquet(f"{path}/catalog/version={version}").collect()}

    def problems(version):
        return {r["doc_id"]: r["error"] for r in spark.read.parquet(f"{path}/problems/version={version}").collect()}

    # ids of documents are text; a null text says nothing
    run("a.json", [("doc-b", reply(id="moondrop_chu", brand="Moondrop", model="Chu", price_usd="30")), ("doc-c", None),
                   ("doc-a", reply(id="moondrop_aria", brand="Moondrop", model="Aria", price_usd="80"))])
    first = models(1)
    assert set(first) == {"moondrop_chu", "moondrop_kato", "moondrop_aria"}, problems(1)
    assert len({r for r, _ in first.values()}) == 3
    assert (first["moondrop_chu"], first["moondrop_aria"][1], models(0)["moondrop_chu"]) == ((0, 30), 80, (0, 20))
    # the second batch starts from what the first one wrote
    run("b.json", [("doc-d", reply(id="moondrop_aria", brand="Moondrop", model="Aria", price_usd="85")), ("doc-e", "{ not a reply")])
    assert models(2) == {**first, "moondrop_aria": (first["moondrop_aria"][0], 85)}
    log = spark.read.parquet(f"{path}/log/version=1", f"{path}/log/version=2")
    assert sorted((r["op_id"], r["action"]) for r in log.collect()) == [(1, "add"), (1, "edit"), (2, "edit")]
    assert set(problems(2)) == {"doc-e"}
