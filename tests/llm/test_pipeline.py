"""The pipeline, stage by stage, against plain loops over lists."""

import public_tokenizers
import pytest
from test_jaccard import shingle_set
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as C
from ledgertone.llm import rules, toxicity
from ledgertone.llm.common import drop_saved, held_out, rows_where

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    folder = tmp_path_factory.mktemp("stages")
    out["documents"] = docs
    for name, fn in C.STAGES:
        fn(spark, docs, SF).write.parquet(str(folder / name))
        out[name] = docs = spark.read.parquet(str(folder / name))
    return out


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_names():
    assert [n for n, _ in C.STAGES] == ["toxicity", "quality rules", "n-gram jaccard join", "substring dedup", "packing"]
    assert entry.queries()["pipeline"] is C.run and "pipeline" not in entry.oracle_sql()


def test_toxicity(spark, stages):
    docs, labels = stages["documents"], spark.read.parquet(f"{SF}/labels.parquet")
    out = held_out("doc_id", 5, 0)
    lean = toxicity.fit_on(docs.where(~out), labels.where(~out)).flat()
    own = docs.collect()
    good = toxicity.score_texts([r["text"] for r in own], *lean) < 0.5
    assert rows(stages["toxicity"]) == sorted(tuple(r) for r, g in zip(own, good, strict=True) if g)
    assert stages["toxicity"].dtypes == docs.dtypes


def test_quality_rules(stages):
    kept = rules.judge(stages["toxicity"]).where("kept").select(*stages["documents"].columns)
    assert rows(stages["quality rules"]) == rows(kept)


def test_near_copies(stages):
    own = sorted(tuple(r) for r in stages["quality rules"].collect())
    sets, root = [shingle_set(r[1], 5) for r in own], list(range(len(own)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(own)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert rows(stages["n-gram jaccard join"]) == [r for i, r in enumerate(own) if find(i) == i]


def test_substrings(stages):
    before = {r["doc_id"]: r for r in stages["n-gram jaccard join"].collect()}
    after = {r["doc_id"]: r for r in stages["substring dedup"].collect()}
    assert set(after) <= set(before) and stages["substring dedup"].dtypes == stages["documents"].dtypes
    where: dict = {}
    for i in sorted(before):  # runs of 50 words that an earlier document holds
        words = before[i]["text"].lower().split()
        for k in range(len(words) - 49):
            where.setdefault(tuple(words[k : k + 50]), i)
    for i, r in before.items():
        words = r["text"].lower().split()
        shared = [k for k in range(len(words) - 49) if where[tuple(words[k : k + 50])] < i]
        left = after[i]["text"].lower().split() if i in after else []
        runs = {tuple(left[k : k + 50]) for k in range(len(left) - 49)}
        assert not any(tuple(words[k : k + 50]) in runs for k in shared)
        if i in after:
            assert after[i]["n_chars"] == (len(after[i]["text"]) if after[i]["text"] != r["text"] else r["n_chars"])


def test_packed(spark, stages):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got: dict = {}
    for r in sorted(stages["packing"].collect(), key=lambda r: (r["doc_id"], r["start"])):
        got.setdefault(r["doc_id"], []).extend(r["ids"])
    want = {r["doc_id"]: [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in stages["substring dedup"].collect()}
    assert got == want
    cols = ["doc_id", "start", "length", "ids_crc32"]
    assert rows(C.run(spark, SF).select(cols)) == rows(stages["packing"].select(cols))


def test_empty_and_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (7, "", "en", "s", 0), (7, "", "en", "s", 0)], docs.schema)
    text = docs.orderBy("doc_id").limit(1)
    copies = text.unionByName(text).unionByName(extra)
    left = C.drop_near_copies(spark, copies, SF).collect()
    assert len(left) == 4  # one of the copies; texts without words all stay
    for name, fn in C.STAGES:
        out = fn(spark, docs.limit(0), SF)
        assert out.count() == 0
        if name != "packing":
            assert out.dtypes == docs.dtypes
    drop_saved(spark)


def test_batches_are_small(spark):
    """What a stage's tasks hand to Python is bounded by bytes, not by rows alone, and holds a text once."""
    import pyarrow as pa

    docs = spark.range(6000).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 1000) AS text", "id AS `odd name`").coalesce(1)
    seen = []

    def judge(d, text):
        seen.append(d.schema)
        return rules.judge(d, text_col=text)

    left = rows_where(docs, "text", judge, "NOT kept")
    assert left.dtypes == docs.dtypes and left.count() == 6000 and rows(left.limit(3)) == rows(docs.limit(3))
    assert [f.name for f in seen[0]["_row"].dataType] == ["doc_id", "odd name"]
    assert rows_where(docs.select("text"), "text", judge, "NOT kept").dtypes == [("text", "string")]
    assert rows_where(docs.selectExpr("doc_id AS text"), "text", judge, "NOT kept").dtypes == [("text", "bigint")]

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], names=["n"])

    C.keep_good(spark, docs.limit(0), SF)
    assert docs.mapInArrow(sizes, "n bigint").selectExpr("max(n)").first()[0] < 2 * C.BATCH_BYTES
    drop_saved(spark)
