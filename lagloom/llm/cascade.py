"""Quarantine and cascading release of turns, by JVM expressions alone.

Each turn waits for its parent, up to 6 turns earlier; a faulty turn is retried until it is repaired, or dead, and a dead
parent blocks all that hang on it. A conversation's sorted turn structs are collected and folded by a higher-order
``aggregate`` whose accumulator is the array of outcomes so far: a turn looks its parent up there by index.

A conversation may hold a third of all rows, so it is not collected whole. Turns are numbered by a two-level scan, and
collected in pieces of ``PIECE`` turns that begin with the ``BACK`` turns before them. A chain of parents ends at a turn without
one (a seventh of all), so nearly all chains lie within a piece; an outcome whose chain begins before its piece is
open, and conversations with open outcomes are folded again with eight times as many turns before, until none is open.
Releases are ranked and summed by the same two-level scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.operators import prefix
from lagloom.sources.shared import keep

PIECE, BACK = 4096, 512
ARRIVAL_S, REACH, TRIES, PAUSE_S = 7, 7, 4, 20
#: Outcomes while folding; an open one hangs on a turn before the piece.
DELIVERED, DEAD, BLOCKED, OPEN = 0, 1, 2, 3
_NAMES = ["delivered", "dead", "blocked"]
_OUTCOME = "status int, attempts int, first_at bigint, last_at bigint"


def _hash(k: int) -> Column:
    return F.crc32(F.concat_ws(":", F.lit(str(k)), F.col("conv_id").cast("string"), F.col("turn").cast("string")).cast("binary"))


def _placed(turns: DataFrame) -> DataFrame:
    """Turns with their number p from 0; texts are reduced to their checksums before anything is shuffled."""
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = turns.filter("conv_id is not null and turn is not null").select("conv_id", "turn", crc.alias("crc"), F.monotonically_increasing_id().alias("tie"))
    return prefix.numbered(rows, ["conv_id"], ["turn", "crc", "tie"], "n", "turns").drop(prefix.BLOCK)


def _fold() -> Column:
    """The outcomes of the sorted array ``turns``, in its order."""

    def step(done: Column, x: Column) -> Column:
        parent = F.get(done, x["at"] - 1)
        held = F.when(x["at"] < 0, OPEN).when(x["at"] == 0, DELIVERED).otherwise(parent["status"])
        begin = F.when(x["at"] > 0, F.greatest(x["arrives"], parent["last_at"])).otherwise(x["arrives"])

        def outcome(s: Column) -> Column:
            tries = [s["begin"] + PAUSE_S * (2 ** (a - 1) - 1) for a in range(1, TRIES + 1)]
            fails = [(t < x["repaired"]) | x["fails"][a] for a, t in enumerate(tries)]
            took = F.lit(0)
            for a in range(TRIES, 0, -1):
                took = F.when(~fails[a - 1], a).otherwise(took)
            own = F.transform(F.array(took), lambda n: F.struct(F.when(n == 0, DEAD).otherwise(DELIVERED), F.when(n == 0, TRIES).otherwise(n), tries[0], F.element_at(F.array(*tries), F.when(n == 0, TRIES).otherwise(n))))[0]
            kept = F.struct(F.when(s["held"] == OPEN, OPEN).otherwise(BLOCKED), F.lit(0), F.lit(None).cast("bigint"), F.lit(None).cast("bigint"))
            return F.when(s["held"] == DELIVERED, own.cast(f"struct<{_typed}>")).otherwise(kept.cast(f"struct<{_typed}>"))

        # An array of one element names what the outcome uses more than once.
        return F.concat(done, F.transform(F.array(F.struct(held.alias("held"), begin.alias("begin"))), outcome))

    return F.aggregate("turns", F.array().cast(f"array<struct<{_typed}>>"), step)


_typed = ",".join(c.strip().replace(" ", ":") for c in _OUTCOME.split(","))


def _folded(placed: DataFrame, size: int, back: int) -> DataFrame:
    """(conv_id, turn, crc, n, status, attempts, first_at, last_at) by pieces of ``size`` turns with ``back`` before."""
    arrives = ARRIVAL_S * (F.col("n") - 1)
    faulty = F.pmod(_hash(1), F.lit(101)) < 20
    distance = F.pmod(_hash(0), F.lit(REACH))
    rows = placed.select(
        "conv_id", "turn", "crc", "n", arrives.alias("arrives"),
        F.when((distance > 0) & (distance < F.col("n")), F.col("n") - distance).alias("parent"),
        F.when(faulty, arrives + F.pmod(_hash(2), F.lit(101))).otherwise(F.lit(0)).alias("repaired"),
        F.array(*[faulty & (F.pmod(_hash(a + 2), F.lit(3)) == 0) for a in range(1, TRIES + 1)]).alias("fails"),
    )
    first = F.greatest(F.col("piece") * size - back, F.lit(0))
    # The parent's place in the piece from 1; 0 for none, -1 for one before the piece.
    at = F.when(F.col("parent").isNull(), 0).when(F.col("parent") <= first, -1).otherwise(F.col("parent") - first).cast("int")
    dealt = prefix.pieces(rows, "n", size, back).withColumn("at", at)
    each = F.struct("n", "turn", "crc", "at", "arrives", "repaired", "fails")
    grouped = dealt.groupBy("conv_id", "piece").agg(F.array_sort(F.collect_list(each)).alias("turns"))
    out = grouped.select("conv_id", "piece", F.explode(F.arrays_zip("turns", _fold().alias("done"))).alias("x"))
    return out.filter(F.floor((F.col("x.turns.n") - 1) / size) == F.col("piece")).select("conv_id", "x.turns.turn", "x.turns.crc", "x.turns.n", "x.done.*")


def _outcomes(placed: DataFrame, size: int, back: int) -> DataFrame:
    whole = None
    while True:
        done = keep(_folded(placed, size, back), "outcomes")
        # At most a few conversations, and no row of any that is complete.
        again = keep(done.filter(F.col("status") == OPEN).select("conv_id").distinct(), "open")
        if again.isEmpty():
            return done if whole is None else whole.unionByName(done)
        ended = done.join(again, "conv_id", "left_anti")
        whole = ended if whole is None else whole.unionByName(ended)
        placed, back = placed.join(again, "conv_id", "left_semi"), 8 * back
        size = max(size, back)


def replay(turns: DataFrame, size: int = PIECE, back: int = BACK) -> DataFrame:
    """conv_id, turn, status, attempts, first_at, last_at, release_no, state (an exact decimal) for each row of ``turns``.

    Turns of a conversation arrive in the order of turn; rows that tie there follow their texts' checksums, each a turn of
    its own, so repeated rows stay and are numbered apart. A null text counts as empty. A row without conv_id or turn
    can't be placed: it stays, with nulls. An empty table gives no rows. Very long texts enter by a checksum; other
    columns of ``turns`` are not read.
    """
    done = _outcomes(keep(_placed(turns), "placed"), size, back)
    free = F.when(F.col("status") == DELIVERED, F.col("last_at"))
    rows = done.withColumn("free", free)
    order = [F.col("free").asc_nulls_last(), "turn", "n"]
    cut = prefix.cut(rows, ["conv_id"], order, "releases")
    one = F.when(F.col("free").isNotNull(), F.lit(1)).cast("bigint")
    ranked = prefix.running(cut, ["conv_id"], order, {"release_no": ("sum", one)})
    adds = F.when(F.col("free").isNotNull(), F.col("release_no").cast("decimal(20,0)") * F.col("crc").cast("decimal(10,0)"))
    summed = prefix.running(ranked, ["conv_id"], order, {"state": ("sum", adds)})
    out = lambda c, x: F.when(F.col("free").isNotNull(), x).alias(c)
    kinds = turns.select("conv_id", "turn")
    known = summed.select("conv_id", "turn", F.element_at(F.array(*map(F.lit, _NAMES)), F.col("status") + 1).alias("status"), "attempts", "first_at", "last_at", out("release_no", F.col("release_no")), out("state", F.col("state").cast("decimal(38,0)")))
    none = kinds.filter("conv_id is null or turn is null").select("conv_id", "turn", *[F.lit(None).cast(t).alias(c) for c, t in known.dtypes[2:]])
    return known.unionByName(none)


def op11_cascading_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``conversations``; state is a long, null where it passes 64 bits, and exact in state_exact (text)."""
    found = replay(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return found.withColumn("state_exact", F.col("state").cast("string")).withColumn("state", F.col("state").try_cast("bigint"))


def _crc_sql(text: str) -> str:
    """The checksum of a text by its bytes: the register starts with all bits set and is inverted at the end."""
    byte = f"CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode({text}))), lambda i: {byte})), lambda c, b: xor(c >> 8, tbl[xor(c, b) % 256 + 1])), 4294967295)"


_H = ", ".join(f"{_crc_sql(f"('{k}:' || conv_id || ':' || turn)")} AS h{k}" for k in range(7))

OP11_SQL = f"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl),
hashed AS (SELECT conv_id, turn, {_crc_sql("coalesce(text, '')")} AS crc, {_H} FROM conversations, crc),
t AS (SELECT conv_id, turn, crc, row_number() OVER (PARTITION BY conv_id ORDER BY turn, crc) - 1 AS p, h0 % 7 AS d, h1 % 101 < 20 AS faulty, h2 % 101 AS repair, [h3 % 3 = 0, h4 % 3 = 0, h5 % 3 = 0, h6 % 3 = 0] AS bad FROM hashed),
r AS (
  SELECT conv_id, 0::BIGINT AS p, []::STRUCT(status VARCHAR, attempts INTEGER, first_at BIGINT, last_at BIGINT)[] AS done FROM t WHERE p = 0
  UNION ALL
  SELECT conv_id, p + 1, list_append(done, CASE WHEN above.status IN ('dead', 'blocked') THEN {{'status': 'blocked', 'attempts': 0, 'first_at': NULL, 'last_at': NULL}}
    ELSE {{'status': CASE WHEN took = 0 THEN 'dead' ELSE 'delivered' END, 'attempts': CASE WHEN took = 0 THEN 4 ELSE took END, 'first_at': b, 'last_at': b + [0, 20, 60, 140][CASE WHEN took = 0 THEN 4 ELSE took END]}} END)
  FROM (SELECT *, CASE WHEN NOT faulty OR NOT (b < 7 * p + repair OR bad[1]) THEN 1 WHEN NOT (b + 20 < 7 * p + repair OR bad[2]) THEN 2 WHEN NOT (b + 60 < 7 * p + repair OR bad[3]) THEN 3 WHEN NOT (b + 140 < 7 * p + repair OR bad[4]) THEN 4 ELSE 0 END AS took
    FROM (SELECT conv_id, p, done, above, faulty, repair, bad, greatest(7 * p, coalesce(above.last_at, 0)) AS b
      FROM (SELECT r.conv_id, r.p, r.done, faulty, repair, bad, CASE WHEN d > 0 AND d <= r.p THEN r.done[r.p - d + 1] END AS above FROM r JOIN t USING (conv_id, p))))
), f AS (SELECT conv_id, max_by(done, p) AS done FROM r GROUP BY conv_id),
o AS (SELECT conv_id, turn, crc, p, done[p + 1].status AS status, done[p + 1].attempts AS attempts, done[p + 1].first_at AS first_at, done[p + 1].last_at AS last_at FROM t JOIN f USING (conv_id)),
n AS (SELECT *, CASE WHEN status = 'delivered' THEN row_number() OVER (PARTITION BY conv_id, status ORDER BY last_at, turn, p) END AS release_no FROM o),
s AS (SELECT *, CASE WHEN status = 'delivered' THEN CAST(sum(release_no * crc) OVER (PARTITION BY conv_id ORDER BY release_no NULLS LAST ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS state FROM n)
SELECT conv_id, turn, status, attempts, first_at, last_at, release_no, state, CAST(state AS VARCHAR) AS state_exact FROM s
UNION ALL SELECT conv_id, turn, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM conversations WHERE conv_id IS NULL OR turn IS NULL"""
