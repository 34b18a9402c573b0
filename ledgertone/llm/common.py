"""Helpers shared by the text operators: saved tables, linked components, word splitting."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgertone.session import shared_folder

#: Bytes between words, as in ``[\x20\x09-\x0D]``. ``bytes.split()`` without arguments cuts at exactly these.
BLANKS = b" \t\n\x0b\x0c\r"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and later steps see one version.

    A lost executor costs the tasks that read it again, never the work before it. ``drop_saved`` removes the files.
    """
    spark = df.sparkSession
    path = remember(f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SAVED: list[str] = []


def remember(path: str) -> str:
    """Have ``drop_saved`` remove this path too."""
    _SAVED.append(path)
    return path


#: Rows of a saved table up to which it is broadcast; rows of the tables concerned are under a kilobyte.
BROADCAST_ROWS = 20_000


def joined_small(
    rows: DataFrame, saved_table: DataFrame, on: str | list[str], how: str = "left", most: int = BROADCAST_ROWS
) -> DataFrame:
    """Join with a saved table that is mostly small: broadcast once counted as small, a shuffled join beyond that."""
    few = saved_table.count() <= most
    return rows.join(F.broadcast(saved_table) if few else saved_table, on, how)


def saved_paths() -> list[str]:
    """What ``saved`` and ``remember`` hold so far in this process."""
    return list(_SAVED)


def drop_saved(spark: SparkSession, paths: list[str] | None = None, still_read: DataFrame | None = None) -> None:
    """Remove what ``saved`` wrote so far in this process, or the given part of it; call it when results are written.

    What the table ``still_read`` reads stays.
    """
    used = still_read.inputFiles() if still_read is not None else []
    for path in saved_paths() if paths is None else paths:
        if path in _SAVED and not any(f"/{path.rpartition('/')[2]}/" in f for f in used):
            _SAVED.remove(path)
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a whole text as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def held_out(id_col: str, mod: int, rest: int) -> Column:
    """Rows whose ``crc32(id as text) mod`` leaves ``rest``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == rest, F.lit(False))


def crc_mod(value, mod: int) -> int:
    return zlib.crc32(str(value).encode()) % mod


#: Links up to which one task follows them, without a shuffle; two numbers each.
FEW_LINKS = 200_000


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of every node of the links (u, v) that one task is given."""
    up: dict = {}

    def top(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(u), top(v)
            up[max(a, b)] = min(a, b)
    if kind is not None:
        found = [pa.array(list(up), kind), pa.array([top(x) for x in list(up)], kind)]
        yield pa.RecordBatch.from_arrays(found, names=["node", "component"])


def components(nodes: DataFrame, links: DataFrame, node: str = "node", a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over the links, for every node.

    Large-star/small-star: each round hangs every larger neighbour, then every smaller one, under the smallest, until
    nothing moves. Rounds grow with the logarithm of the longest chain; only aggregates and joins by node are
    shuffled, and a node with very many links is never gathered in one task. Links must be between given nodes;
    self links and repeated links are allowed. Links counted as few are followed by one task.
    """
    spark, before = nodes.sparkSession, saved_paths()
    edges = saved(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links"
    )
    few = edges.count() <= FEW_LINKS
    if few:
        kind = edges.schema["u"].dataType.simpleString()
        roots = edges.coalesce(1).mapInArrow(_roots, f"node {kind}, component {kind}").withColumnRenamed("node", node)
    state = None
    while not few:
        # rounds end when the set of links stays the same, which its size and hashes tell
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(xxhash64(v, u) % 1000003)")).first()
        if now == state:
            break
        state = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above the node move to its smallest neighbour
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large.where("u <> v").distinct(), "links")
        # small star: neighbours at or below the node, and the node, move to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        moved = small.union(least.select("u", F.col("m").alias("v")))
        edges = saved(moved.distinct(), "links")
        drop_saved(spark, [p for p in saved_paths() if p not in before], still_read=edges)
    if not few:
        roots = edges.groupBy(F.col("u").alias(node)).agg(F.min("v").alias("component"))
    return nodes.select(node).distinct().join(roots, node, "left").select(
        node, F.coalesce("component", node).alias("component")
    )


#: Characters of text handed to a function at once, beyond which a new call begins.
CHUNK_CHARS = 2 << 20


def per_text(docs: DataFrame, text_col: str, fn, fields: str, keep: list[str] | None = None) -> DataFrame:
    """The rows with the columns ``fields`` (DDL) that ``fn(texts) -> [arrow array, ...]`` makes of their whole texts.

    Input columns of the same names are replaced. Rows travel as one struct, so no other name can clash. With ``keep``,
    one column or more, only these come along: a text that is not among them does not return from Python.
    """
    made = T._parse_datatype_string(fields)
    columns = docs.columns if keep is None else keep
    row = F.struct(*(["*"] if keep is None else [f"`{c.replace('`', '``')}`" for c in keep])).alias("row")
    if keep is None and dict(docs.dtypes).get(text_col) == "string":
        rows, place = docs.select(row), docs.columns.index(text_col)
    else:
        rows, place = docs.select(row, F.col(text_col).cast("string").alias("text")), -1

    def run(batches):
        for batch in batches:
            at, texts = 0, batch.column(1) if place < 0 else pa.compute.struct_field(batch.column(0), [place])
            while at < batch.num_rows:
                first, size, group = at, 0, []
                while at < batch.num_rows and size < CHUNK_CHARS:
                    group.append(texts[at].as_py())
                    size += len(group[-1] or "")
                    at += 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, at - first), *fn(group)], names=["row", *made.fieldNames()]
                )

    out = rows.mapInArrow(run, T.StructType([rows.schema["row"], *made.fields]))
    names = {n.lower() for n in made.fieldNames()}
    return out.select(*[F.col("row")[c].alias(c) for c in columns if c.lower() not in names], *made.fieldNames())


def rows_where(docs: DataFrame, text_col: str, judge, condition: str) -> DataFrame:
    """The rows, as they are, whose judgement fulfils the condition; ``judge(docs, text_col)`` adds columns to its input.

    It gets the rows as one struct beside the text, so its columns cannot clash with theirs. A text that is a string is
    not in the struct too: batches hold it once on their way to Python and back.
    """
    once = dict(docs.dtypes).get(text_col) == "string"
    beside = [c for c in docs.columns if not once or c != text_col]
    row = F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in beside]) if beside else F.lit(0)
    judged = judge(docs.select(row.alias("_row"), F.col(text_col).cast("string").alias("_text")), "_text")
    return judged.where(condition).select(*[(F.col("_row")[c] if c in beside else F.col("_text")).alias(c) for c in docs.columns])


def sample_labelled(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int, chars: int
) -> Iterator[tuple[str, int]]:
    """(text, label) of at most ``rows`` documents of each label and ``chars`` characters in all, by a hash of the id.

    Null ids, texts and labels teach nothing, nor does an id labelled both ways or a text of over ``chars / 100``
    characters; of rows with one id, one teaches. Spark makes the choice; the driver is given one text after the other.
    """
    marked = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
        .groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z")
        .select("id", "y", F.xxhash64(F.col("id").cast("string")).alias("k"))
    )
    chosen = marked.where("y = 1").orderBy("k", "id").limit(rows).union(marked.where("y = 0").orderBy("k", "id").limit(rows))
    # the sample has at most 2 * rows ids, so this side may be broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    small = texts.join(F.broadcast(chosen), "id").where(F.length("text") <= chars // 100)
    one = saved(small.groupBy("id", "y", "k").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text")), "labelled")
    # at most 2 * rows lengths in one window
    so_far = F.sum(F.length("text")).over(Window.orderBy("k", "id").rowsBetween(Window.unboundedPreceding, 0))
    within = one.select("id", so_far.alias("n")).where(F.col("n") <= chars).select("id")
    for r in one.join(F.broadcast(within), "id").orderBy("k", "id").select("text", "y").toLocalIterator():
        yield r["text"], r["y"]
