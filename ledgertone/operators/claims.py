"""Who may take an id when many rows of one batch change theirs in order."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, written


def _next_claims(moves: DataFrame) -> DataFrame:
    """(seq, next): for each move the first later claim to the id it leaves, if there is one.

    Events are dealt by ranges of (id, seq) and looked at within a range; what lies in later ranges comes from their
    first claims, one row per id and range. An id that very many rows leave or claim spans several ranges.
    """
    events = moves.select("seq", F.col("new_id").alias("at"), F.col("seq").alias("claim")).unionByName(
        moves.where("old_id IS NOT NULL").select("seq", F.col("old_id").alias("at"), F.lit(None).cast("bigint").alias("claim"))
    )
    dealt = cut_lineage(events.repartitionByRange("at", "seq").withColumn("_slice", F.spark_partition_id()))
    # downwards, as running minima: the frame from the next row to the end would be made anew for every row
    later = Window.partitionBy("at", "_slice").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    here = F.min("claim").over(later)
    firsts = dealt.groupBy("at", "_slice").agg(F.min("claim").alias("first"))
    beyond = Window.partitionBy("at").orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select("at", "_slice", F.min("first").over(beyond).alias("beyond"))
    found = dealt.withColumn("here", here).where("claim IS NULL").join(firsts, ["at", "_slice"])
    return found.select("seq", F.coalesce("here", "beyond").alias("next")).where("next IS NOT NULL")


def _spread(state: DataFrame) -> DataFrame:
    """state(seq, ok, jump): ``ok`` passes along the jumps, to any distance, by doubling them."""
    while state.where("jump IS NOT NULL").limit(1).count():
        reached = state.where("ok AND jump IS NOT NULL").select(F.col("jump").alias("seq"), F.lit(True).alias("reached")).distinct()
        onward = state.select(F.col("seq").alias("jump"), F.col("jump").alias("onward"))
        state = written(
            state.join(reached, "seq", "left").join(onward, "jump", "left")
            .select("seq", (F.col("ok") | F.coalesce("reached", F.lit(False))).alias("ok"), F.col("onward").alias("jump"))
        )
    return state.select("seq", "ok")


def _judged(moves: DataFrame, shared: DataFrame) -> DataFrame:
    """moves(seq, old_id, new_id, ok): claims to the ids in shared(at, held) that are free once every holder has left."""
    events = moves.select("seq", F.col("new_id").alias("at"), F.lit(1).alias("claim"), F.lit(0).alias("left")).unionByName(
        moves.where("ok AND old_id IS NOT NULL").select("seq", F.col("old_id").alias("at"), F.lit(0).alias("claim"), F.lit(1).alias("left"))
    )
    upto = Window.partitionBy("at").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = events.join(shared, "at").select(
        "seq", "claim", "held", F.coalesce(F.sum("left").over(upto), F.lit(0)).alias("left"),
        F.max(F.when(F.col("left") == 1, F.col("seq"))).over(upto).alias("freed"),
        F.max(F.when(F.col("claim") == 1, F.col("seq"))).over(upto).alias("asked"),
    )
    # the first to ask since the id came free
    first = F.col("asked").isNull() | (F.col("asked") < F.col("freed"))
    return seen.where("claim = 1").where((F.col("left") >= F.col("held")) & F.coalesce(first, F.lit(False))).select("seq")


def settle_ids(claims: DataFrame, owners: DataFrame, by: str = "set") -> DataFrame:
    """claims(seq, old_id, new_id) against owners(id): adds ``accepted``.

    In order of ``seq`` a claim gets its id when it is free at that moment. ``by="set"``: an id in use is free once an
    accepted claim gave it up, as when a batch is staged against the set of ids in use. ``by="holders"``: an id is
    free when no row holds it, so every row that held it must have left.

    A move that is accepted makes way for the next claim to the id it leaves, and for no other. So moves form chains,
    and a claim is accepted just if its chain begins with one: the first claim to an id that nobody holds. That passes
    along the chains by pointer doubling, a chain of n moves in log2(n) rounds. Ids held by several rows, of
    which all have to leave (``holders``), are judged between such passes.
    """
    held = owners.groupBy(F.col("id").alias("at")).agg(F.count("*").alias("held"))
    stay = F.col("old_id").eqNullSafe(F.col("new_id"))
    moves = cut_lineage(claims.where(~stay & F.col("new_id").isNotNull()).select(F.col("seq").cast("bigint").alias("seq"), "old_id", "new_id"))
    firsts = moves.groupBy(F.col("new_id").alias("at")).agg(F.min("seq").alias("first"))
    asked = moves.select("seq", F.col("new_id").alias("at")).join(firsts, "at").join(held, "at", "left")
    shared = (F.col("held") > 1) if by == "holders" else F.lit(False)
    asked = asked.select("seq", F.coalesce(shared, F.lit(False)).alias("shared"), (F.col("held").isNull() & (F.col("seq") == F.col("first"))).alias("ok"))
    # a claim to an id with several holders doesn't follow from one departure
    jumps = _next_claims(moves).join(asked.where("not shared").select(F.col("seq").alias("next")), "next")
    state = written(asked.join(jumps, "seq", "left").select("seq", "ok", F.col("next").alias("jump"), "shared"))
    settled = _spread(state.drop("shared"))
    if by == "holders" and state.where("shared").limit(1).count():
        many = cut_lineage(held.where("held > 1"))
        known = -1
        while True:
            free = written(_judged(moves.join(settled, "seq"), many))
            if free.count() == known:
                break
            known = free.count()
            more = state.drop("ok", "shared").join(settled, "seq").join(free.withColumn("free", F.lit(True)), "seq", "left")
            settled = _spread(more.select("seq", (F.col("ok") | F.coalesce("free", F.lit(False))).alias("ok"), "jump"))
    seen = settled.select(F.col("seq").alias("_seq"), "ok")
    out = claims.join(seen, claims["seq"].cast("bigint") == F.col("_seq"), "left")
    return out.withColumn("accepted", stay | F.coalesce("ok", F.lit(False))).drop("ok", "_seq")
