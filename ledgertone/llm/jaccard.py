"""Exact n-gram Jaccard links by a grouped prefix join.

All sets are ordered alike: elements of a fixed share of the hash space first, the rarest before the others by exact
counts, then the rest by hash. Two sets that link share an element among the first few of each (the prefix). Elements
that only one set holds come first, so a text that merely shares a passage with others has a prefix of its own and
drops out before any set is fetched. Texts with one set are one node; nodes with equal prefix and size are one group,
and only groups meet in the join.

What is asked for are the linked components, so pairs inside a known component need no comparing. Rounds compare every
node of an element with a leader or a few (where many meet: with the nearest by sketches) and join what links; what is
then left between different components of one element is verified pair by pair, without a cap; of a frequent element,
tasks find these pairs in blocks and return each once. Sets are compared whole, on exact counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, drop_saved, joined_small, saved, saved_paths

#: Share of the hash space whose elements are counted, for a similarity of 0 (it shrinks with the prefix).
COUNTED = 1.7
CHUNK_CHARS = 2 << 20
#: Bytes of each hash kept where sets are compared; two elements of a pair of texts differ in them but for 1 in 2 ** 48.
KEPT_BYTES = 6
#: Bits of the parity sketch: bit b tells whether a set has an odd number of elements in bucket b of the hash space. Two
#: sets differ in at least as many elements as their sketches differ in bits, so this never drops a linked pair.
SKETCH_BITS = 512
#: Meetings left, for each node, with which leaders give way to the full comparison; the rounds at most; and the leaders
#: of an element in each round after the first, which leaves little to compare.
LEFT, ROUNDS, LEADERS = 0.1, 4, 4
#: Nodes of an element beyond which a task compares them by sketches and returns only the pairs asked for; those that a
#: task holds at once; and the elements by which two nodes that meet at several are known to have met before.
CROWD, BLOCK, KNOWN = 64, 8192, 16
#: Rows of two numbers up to which a table is broadcast.
SMALL = 300_000

_A = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """Hashes of each text's word n-grams in order, repeats included; of fewer words, of the whole sequence."""
    table: dict[bytes, int] = {}
    codes = []
    for text in texts:
        words = text.lower().split() if text else []  # bytes.lower() knows A-Z only
        codes.append(np.fromiter((table.setdefault(w, len(table)) for w in words), np.int64, len(words)))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, table), np.uint64, len(table))
    flat = hashes[np.concatenate([*codes, np.empty(0, np.int64)])]
    sizes = np.array([len(c) for c in codes], np.int64)
    ends = np.cumsum(sizes)
    key = np.zeros(max(0, len(flat) - n + 1), np.uint64)
    for k in range(n):
        key = key * _A + flat[k : k + len(key)]
    key = _mix(key)
    out = []
    for a, b in zip(ends - sizes, ends, strict=True):
        if b - a >= n:
            out.append(key[a : b - n + 1])
        elif b > a:
            short = np.uint64(b - a)
            for x in flat[a:b]:
                short = np.uint64((int(short) * int(_A) + int(x)) & 0xFFFFFFFFFFFFFFFF)
            out.append(_mix(np.array([short ^ np.uint64(0x5555)])))
        else:
            out.append(flat[:0])
    return out


def prefix_size(n: int, percent: int) -> int:
    """Elements of a set of n of which a linked set of any size must share one."""
    return n - (percent * n + 99) // 100 + 1


def _chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list]]:
    texts, at = batch.column(column), 0
    while at < batch.num_rows:
        first, size, group = at, 0, []
        while at < batch.num_rows and size < CHUNK_CHARS:
            group.append(texts[at].as_py())
            size += len(group[-1] or b"")
            at += 1
        yield first, group


def counted_below(percent: int) -> int:
    """Hashes below this are counted; twice as many as a prefix takes, with room for chance."""
    return min(2**64 - 1, int(min(1.0, COUNTED * (100 - percent) / 100) * 2**64))


def _sign(n: int, percent: int):
    schema = pa.schema(
        [("n", pa.int64()), ("fp", pa.binary()), ("r", pa.int64()), ("sketch", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))]
    )
    below = np.uint64(counted_below(percent))

    def one(hashes: np.ndarray):
        own = np.unique(hashes)
        if not len(own):
            return 0, None, 0, None, None
        r = int(np.searchsorted(own, below))
        # the rest, by hash, only as far as the prefix reaches beyond the counted ones
        tokens = own[: max(r, prefix_size(len(own), percent))]
        odd = np.bincount((own % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
        sketch = np.packbits(odd.astype(np.uint8)).view(np.int64)
        return len(own), xxhash.xxh3_128_digest(own.tobytes()), r, sketch, tokens.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, group in _chunks(batch, "text"):
                cols = list(zip(*map(one, shingles(group, n)), strict=True))
                made = [pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)]
                kept = [batch.column(c).slice(first, len(group)) for c in ("id", "k")]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=["id", "k", *schema.names])

    return run


def _sets(n: int):
    schema = pa.schema([("k", pa.binary()), ("set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, group in _chunks(batch, "text"):
                made = [np.unique(h).view(np.uint8).reshape(-1, 8)[:, 8 - KEPT_BYTES :].tobytes() for h in shingles(group, n)]
                yield pa.record_batch([batch.column("k").slice(first, len(group)), pa.array(made, pa.binary())], schema=schema)

    return run


def unkept(raw) -> np.ndarray:
    """The numbers that a set's kept bytes make."""
    kept = np.frombuffer(raw, np.uint8).reshape(-1, KEPT_BYTES)
    return np.pad(kept, ((0, 0), (8 - KEPT_BYTES, 0))).view(np.uint64).ravel()


def _linked(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(batch.column(c) for c in ("a", "b", "sa", "sb")), strict=True):
                x, y = unkept(x.as_buffer()), unkept(y.as_buffer())
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out.append((a.as_py(), b.as_py()))
            yield pa.record_batch([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], schema=schema)

    return run


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets link. Sets travel to the pairs' side ``a``, of which there are fewer."""
    one = joined_small(sets.select(F.col("rid").alias("b"), F.col("set").alias("sb")), pairs, "b", "inner", SMALL)
    leaders = saved(pairs.select("a").distinct(), "leaders")
    other = joined_small(sets.select(F.col("rid").alias("a"), F.col("set").alias("sa")), leaders, "a", "inner", SMALL)
    return one.join(other, "a").select("a", "b", "sa", "sb").mapInArrow(_linked(percent), "a bigint, b bigint")


def _compare(percent: int, most: int | None):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def block(rows: pa.Table) -> pa.RecordBatch:
        rid, n, component, part = (rows.column(c).to_numpy() for c in ("rid", "n", "component", "part"))
        sketch = rows.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(rid), -1)
        token, split = rows.column("token")[0].as_py(), rows.column("x")[0].as_py() != rows.column("y")[0].as_py()
        prefixes = None if most else [frozenset(p) for p in rows.column("p").to_pylist()]
        _, code, size = np.unique(component, return_inverse=True, return_counts=True)
        large = code == size.argmax()
        # of a pair in two components, one side at least is outside the largest
        seek, step, out = np.flatnonzero(~large), max(1, (1 << 18) // len(rid)), []
        for start in range(0, len(seek), step):
            i = seek[start : start + step, None]
            differ = np.bitwise_count(sketch[i] ^ sketch[None]).sum(-1, dtype=np.int64)
            fits = (component[i] != component) & (100 * np.minimum(n[i], n) >= percent * np.maximum(n[i], n))
            fits &= differ * (100 + percent) <= (n[i] + n) * (100 - percent)
            if most:
                differ[~fits] = 1 << 40
                place = np.argpartition(differ, min(most, len(rid)) - 1, axis=1)[:, :most]
                x, k = np.nonzero(np.take_along_axis(fits, place, 1))
                x, y = i[x, 0], place[x, k]
            else:
                fits &= large | (rid[i] < rid)
                if split:
                    fits &= part[i] != part
                x, y = np.nonzero(fits)
                x = i[x, 0]
                # a pair belongs to the first element where it meets, so far as both sides' first ones tell
                own = [min(prefixes[u] & prefixes[v], default=token) >= token for u, v in zip(x.tolist(), y.tolist(), strict=True)]
                x, y = x[own], y[own]
            out.append((np.minimum(rid[x], rid[y]), np.maximum(rid[x], rid[y])))
        return pa.record_batch([np.concatenate([*(o[k] for o in out), rid[:0]]) for k in (0, 1)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("token", "x", "y")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start < end:
                    if held and (keys[start] != last).any():
                        yield block(pa.Table.from_batches(held))
                        held = []
                    held.append(batch.slice(start, end - start))
                    last = keys[start]
        if held:
            yield block(pa.Table.from_batches(held))

    return run


def _crowds(at: DataFrame, meeting: DataFrame, percent: int, turn: int, whole: bool) -> DataFrame:
    """Pairs (a, b) of nodes of frequent elements that may link: all of different components, or each node's nearest.

    The rows of an element are dealt into parts of about BLOCK; for the nearest a node looks in its own part, for all pairs
    every two parts meet.
    """
    parts, part = F.ceil(F.col("m") / BLOCK).cast("int"), F.pmod(F.xxhash64("rid", F.lit(turn)), F.col("parts")).cast("int")
    dealt = at.withColumn("parts", parts).withColumn("part", part)
    if whole:
        first = meeting.groupBy("gid").agg(F.slice(F.sort_array(F.collect_list("token")), 1, KNOWN).alias("p"))
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        wide = dealt.where("parts > 1").withColumn("other", other)
        dealt = dealt.where("parts = 1").withColumn("other", F.lit(0)).union(wide).join(first, "gid")
    else:
        dealt = dealt.withColumn("other", F.col("part")).withColumn("p", F.lit(None).cast("array<bigint>"))
    dealt = dealt.select("token", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "rid", "n", "component", "sketch", "p")
    dealt = dealt.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y")
    return dealt.mapInArrow(_compare(percent, None if whole else LEADERS), "a bigint, b bigint")


def _members(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Saved table (id, k, n_shingles, component) of all documents; k is a hash of the text, component null without a set."""
    others = saved_paths()
    text = F.col(text_col).cast("string").cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.md5(text)).alias("k"))
    fields = [rows.schema["id"], *T._parse_datatype_string("k binary, n bigint, fp binary, r bigint, sketch array<bigint>, tokens array<bigint>").fields]
    base = saved(
        rows.mapInArrow(_sign(words, percent), T.StructType(fields)).withColumn("row", F.monotonically_increasing_id()), "sets"
    )
    # one node per set
    nodes = saved(
        base.where("n > 0").groupBy("fp").agg(
            F.min("row").alias("rid"), F.min("n").alias("n"), F.min("r").alias("r"), F.min("k").alias("k"),
            F.first("sketch").alias("sketch"),
        ), "nodes",
    )
    copies = saved(base.select("row", "fp").join(nodes, "fp").where("row <> rid").select("row"), "copies")
    own = joined_small(base.where("n > 0"), copies, "row", "left_anti", SMALL)
    own = own.select(F.col("row").alias("rid"), F.explode("tokens").alias("token"))
    # one shuffle counts an element and keeps its rows; a window puts those of a frequent one on disk
    met = saved(own.withColumn("c", F.count("*").over(Window.partitionBy("token"))).where("c > 1"), "met")
    # the prefix: what no other set holds, then the rarest of the others, then the hashes beyond the counted ones
    counted = F.shiftrightunsigned("token", 1) < F.lit(counted_below(percent) >> 1)
    size = f"n - (({percent} * n + 99) div 100) + 1"
    per = met.groupBy("rid").agg(F.count(F.when(counted, 1)).alias("m"))
    room = per.join(nodes, "rid").select("rid", "n", (F.expr(f"LEAST({size}, r)") - F.col("r") + F.col("m")).alias("room"), (F.col("r") > F.col("m")).alias("alone"))
    place = F.row_number().over(Window.partitionBy("rid").orderBy(~F.col("counted"), "c", "token"))
    held = met.withColumn("counted", counted).withColumn("place", place).join(room, "rid")
    held = saved(held.where("NOT counted OR place <= room").select("rid", "n", "alone", "token"), "held")
    # one group per size and prefix; a set with an element of its own is a group by itself
    prefix = held.groupBy("rid").agg(F.min("n").alias("n"), F.max("alone").alias("alone"), F.sort_array(F.collect_list("token")).alias("p"))
    prefix = prefix.select("rid", "n", F.when(F.col("alone"), F.col("rid")).otherwise(-1).alias("one"), F.xxhash64("p").alias("p0"), F.xxhash64("p", F.lit(1)).alias("p1"))
    prefix, alike = saved(prefix, "prefix"), ["n", "one", "p0", "p1"]
    groups = prefix.groupBy(*alike).agg(F.min("rid").alias("gid"), F.count("*").alias("members"))
    groups = saved(prefix.join(groups, alike).select("rid", "gid", "members"), "groups")
    heads = groups.where("rid = gid").select("rid", "gid", "members")
    met = held.select("rid", "token").join(heads, "rid").select("gid", "members", "token")
    shared = met.groupBy("token").agg(F.sum("members").alias("c")).where("c > 1").select("token")
    met = saved(met.select("gid", "token").join(shared, "token", "left_semi"), "met")
    groups = groups.join(met.select("gid").distinct(), "gid", "left_semi").select("rid", "gid")
    whole, nodes = nodes, saved(nodes.join(groups, "rid").select("rid", "n", "k", "gid", "sketch"), "nodes")
    sets = _sets_of(rows, nodes.select("rid", "k"), words)

    spark = docs.sparkSession
    edges = verify(saved(nodes.where("rid <> gid").select(F.col("gid").alias("a"), F.col("rid").alias("b")), "pairs"), sets, percent)
    many = nodes.count()
    roots = saved(components(nodes.select(F.col("rid").alias("node")), edges), "roots")
    kept, fresh = [p for p in saved_paths() if "/pairs-" not in p and "/links-" not in p], True
    drop_saved(spark, [p for p in saved_paths() if p not in kept and p not in others])
    for turn in range(ROUNDS + 1):
        known = saved(nodes.join(roots.withColumnRenamed("node", "rid"), "rid").select("rid", "gid", "n", "component", "sketch"), "known")
        parts = known.groupBy("gid", "n", "component").agg(F.min(F.struct("rid", "sketch")).alias("head"), F.count("*").alias("c"))
        parts = parts.select("gid", "n", "component", "c", F.col("head.rid").alias("rid"), F.col("head.sketch").alias("sketch"))
        per = met.join(parts.select("gid", "component", "c"), "gid").groupBy("token", "component").agg(F.count("*").alias("c"), F.sum("c").alias("m"))
        open_ = per.groupBy("token").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"), F.sum("m").alias("m")).where("s * s > q")
        open_ = saved(open_, "open")
        left = open_.agg(F.sum(F.expr("CAST((s * s - q) / 2 AS DOUBLE)"))).first()[0] or 0.0
        if not left:
            break
        # rounds go on as long as they find links, so that what is left are mostly pairs that do not link
        last = turn > 0 and (turn == ROUNDS or left <= LEFT * many or not fresh)
        meeting = met.join(open_.select("token", "m"), "token")
        crowded = open_.where(F.col("m") > CROWD).limit(1).count() > 0
        # of a similarity of percent or more: sizes that fit, and no more elements that differ than it allows
        differ = " + ".join(f"bit_count(x.sketch[{i}] ^ y.sketch[{i}])" for i in range(SKETCH_BITS // 64))
        sizes = f"100 * LEAST(x.n, y.n) >= {percent} * GREATEST(x.n, y.n)"
        near = f"({differ}) * {100 + percent} <= (x.n + y.n) * {100 - percent}"
        # all members in the end, before that one of each group and component
        rows_at = meeting.join(known if last else parts, "gid").select("token", "m", "gid", "rid", "n", "component", "sketch")
        at = rows_at.where(F.col("m") <= CROWD) if turn else rows_at
        if last:
            fits = f"x.token = y.token AND x.component < y.component AND {sizes} AND {near}"
            meet = at.alias("x").join(at.alias("y"), F.expr(fits))
        else:
            orders = [
                F.min(F.struct(F.xxhash64("rid", F.lit(LEADERS * turn + i)).alias("h"), "rid", "n", "component", "sketch"))
                for i in range(LEADERS if turn else 1)
            ]
            leader = at.groupBy("token").agg(F.array(*orders).alias("l")).select("token", F.explode("l").alias("l")).select("token", "l.*")
            meet = at.alias("x").join(leader.alias("y"), F.expr(f"x.token = y.token AND x.component <> y.component AND {sizes} AND {near}"))
        pairs = meet.select(F.col("y.rid").alias("a"), F.col("x.rid").alias("b"))
        if turn and crowded:
            pairs = pairs.union(_crowds(rows_at.where(F.col("m") > CROWD), meeting.where(F.col("m") > CROWD), percent, turn, last))
        pairs = pairs.distinct()
        pairs = saved(pairs, "pairs")
        linked = saved(verify(pairs, sets, percent), "linked")
        found = linked.count()
        # the nearest ones are asked for as long as a fair share of them links
        fresh = found > (LEFT * pairs.count() if turn else 0)
        if found:
            # components only grow together: links between components, then their names
            for side in ("a", "b"):
                linked = joined_small(roots.withColumnRenamed("node", side), linked, side, "inner", SMALL).drop(side).withColumnRenamed("component", side)
            joint = components(linked.select(F.explode(F.array("a", "b")).alias("node")), linked).select(F.col("node").alias("component"), F.col("component").alias("to"))
            moved = joined_small(roots, saved(joint, "joint"), "component", "left", SMALL)
            roots = saved(moved.select("node", F.coalesce("to", "component").alias("component")), "roots")
        drop_saved(spark, [p for p in saved_paths() if p not in kept and p not in others], still_read=roots)
        if last:
            break
    named = base.select("id", "k", "n", "fp").join(whole.select("fp", F.col("rid").alias("node")), "fp", "left")
    found = F.coalesce("component", "node").alias("component")
    return saved(named.join(roots, "node", "left").select("id", "k", F.col("n").alias("n_shingles"), found), "members")


def linked_components(
    docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: its id, n_shingles (size of its set) and component_id (smallest id reachable by links).

    Documents link when 100 * intersection >= percent * union of their sets of ``words``-word shingles, A-Z folded to
    lower case. With fewer words the whole sequence is the one shingle; null, empty and blank texts have an empty set
    and link with nothing. Repeated rows and repeated ids are documents of their own; a null id names a component
    only if all ids in it are null. An empty table gives an empty one; other columns are ignored.
    """
    named = _members(docs, words, percent, id_col, text_col)
    lows = named.where("component is not null").groupBy("component").agg(F.min("id").alias("component_id"))
    return named.join(lows, "component", "left").select(
        F.col("id").alias(id_col), "n_shingles",
        F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_per_component(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents, one of each linked component: that with the smallest id (a null id is last, ties by the text).

    Of rows equal in id and text one stays. Documents without a word link with nothing and all stay.
    """
    named = _members(docs, words, percent, id_col, text_col).where("component is not null")
    key = F.struct(F.col("id").isNull().alias("none"), "id", "k")
    first = named.groupBy("component").agg(F.min(key).alias("first"))
    marked = named.join(first, "component").select("id", "k", F.col("first").eqNullSafe(key).alias("stays"))
    marked = saved(marked.groupBy("id", "k").agg(F.max("stays").alias("stays"), F.count("*").alias("c")), "marked")
    rows = docs.select(
        F.struct("*").alias("row"), F.col(id_col).isNull().alias("none"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.unhex(F.md5(F.col(text_col).cast("string").cast("binary"))).alias("k"),
    )
    key = [F.col("id").isNull().alias("none"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "k"]
    lost = saved(marked.where("not stays").select(*key), "lost")
    again = saved(marked.where("stays and c > 1").select(*key), "again")
    on = ["none", "id", "k"]
    out = joined_small(rows, lost, on, "left_anti", SMALL)
    if again.limit(1).count():
        repeated = joined_small(out, again, on, "left_semi", SMALL).dropDuplicates(on)
        out = joined_small(out, again, on, "left_anti", SMALL).unionByName(repeated)
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def _sets_of(rows: DataFrame, involved: DataFrame, words: int) -> DataFrame:
    """(rid, set) of the nodes that meet any other, made again from the texts, each text once."""
    keys = saved(involved.select("k", "rid"), "keys")
    texts = joined_small(rows.select("k", "text"), keys.select("k"), "k", "left_semi", SMALL)
    made = texts.mapInArrow(_sets(words), "k binary, set binary")
    # copies of a text make one set
    return saved(joined_small(made, keys, "k", "inner", SMALL).groupBy("rid").agg(F.first("set").alias("set")), "sets")
