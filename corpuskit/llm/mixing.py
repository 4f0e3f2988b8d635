"""Mixing of sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source is a row of blocks of equal size. With weight w, its block k is released at floor(k / w)
and due at ceil((k + 1) / w), counted in blocks of the whole mix. Each place of the mix goes to the
released block that is due first. So after any number of blocks a source has had its weight's share,
give or take less than one block, for as long as every source still has blocks.

Weights are whole shares of a frame. All deadlines coincide at the end of a frame, so the order
within one frame, a table of ``frame`` rows, holds for every frame. Sources are counted by thousands, not by documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuskit.operators.ordered import running_totals

BLOCK_CHARS = 1 << 18
FRAME = 1_000


def whole_shares(sizes: dict[str, float], frame: int) -> dict[str, int]:
    """Shares of ``frame`` in proportion to ``sizes``, at least 1 each, by largest remainders."""
    total = sum(sizes.values())
    if not total:
        sizes, total = dict.fromkeys(sizes, 1.0), len(sizes)
    spare = frame - len(sizes)  # beyond the one that each source has at least
    exact = {k: spare * v / total for k, v in sizes.items()}
    out = {k: 1 + int(v) for k, v in exact.items()}
    rest = frame - sum(out.values())
    for k in sorted(exact, key=lambda k: (int(exact[k]) - exact[k], k))[:rest]:
        out[k] += 1
    return out


def frame_order(spark: SparkSession, shares: list[int]) -> DataFrame:
    """Earliest deadline first over one frame: rows (``_source_no``, ``_nth``, ``_place``), one per place."""
    frame = sum(shares)
    # The weights travel with the state, which is made once; an array in the formula would be made anew for each of its elements.
    weights = F.from_json(F.lit(str(list(shares))), "array<int>")
    start = F.struct(
        F.array_repeat(F.lit(0), len(shares)).alias("had"), F.array().cast("array<int>").alias("order"), weights.alias("weights"))

    def step(state, place):
        def due(had, i):
            weight = F.element_at(state["weights"], i + 1)
            released = F.floor(had * F.lit(frame) / weight) <= place
            return F.when(released & (had < weight), F.struct(
                F.ceil((had + 1) * F.lit(frame) / weight).alias("deadline"), i.cast("int").alias("i")))

        first = F.array_min(F.transform(state["had"], due))["i"]
        # Bound to a name by an array of one, or it would be worked out anew for every source.
        return F.get(F.transform(F.array(first), lambda chosen: F.struct(
            F.transform(state["had"], lambda had, i: had + (i == chosen).cast("int")).alias("had"),
            F.concat(state["order"], F.array(chosen)).alias("order"), state["weights"].alias("weights"))), 0)

    order = F.aggregate(F.sequence(F.lit(0), F.lit(frame - 1)), start, step, lambda state: state["order"])
    places = spark.range(1).select(F.posexplode(order).alias("_place", "_source_no"))
    # One frame, of a fixed number of rows.
    nth = F.row_number().over(Window.partitionBy("_source_no").orderBy("_place")) - 1
    return places.select("_source_no", nth.alias("_nth"), "_place")


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: dict[str | None, int] | None = None,
    temper: float = 1.0,
    block_chars: int = BLOCK_CHARS,
    frame: int = FRAME,
    carry: list[str] | None = None,
) -> DataFrame:
    """A row per row of ``df``: ``id``, ``source``, ``block``, ``release``, ``deadline``, ``slot``, ``exact``,
    ``before`` (characters of the source before the row), ``n_chars`` and ``row`` (the columns in ``carry``).

    ``slot`` is the place of the row's block in the mix; ordered by ``slot`` and ``before``, the rows are
    the mix. ``weights`` are whole shares by source, and every source needs one; without them a source's
    share of ``frame`` follows its size to the power of ``temper``. ``exact`` is true as long as no source has
    run out; later slots of a source that has are left free. No row is dropped.

    A document belongs to the block in which it begins, also if it fills several; a null text is an
    empty one, and null is a source of its own. Within a source rows go by id, null last. Repeated
    rows are rows like any other. An empty table gives an empty mix. With more than half as many sources as ``frame`` has places the frame is
    twice as long as there are sources; working out its order takes time in proportion to sources times places.
    """
    carried = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("int")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"),
        F.length(text).cast("bigint").alias("n_chars"), F.xxhash64(text).alias("_hash"), carried.alias("row"))
    order = [F.col("id").asc_nulls_last(), F.col("n_chars").asc(), F.col("_hash").asc()]
    totals = running_totals(rows, ["source"], order, {"_upto": F.col("n_chars")})
    placed = totals.withColumn("before", F.col("_upto") - F.col("n_chars")).withColumn(
        "block", F.expr(f"before div {block_chars}"))

    # One row per source; the frame grows with them, so that each has a place in it and room for its weight.
    found = {r.source: r.n for r in rows.groupBy("source").agg(F.sum("n_chars").alias("n")).collect()}
    frame = max(frame, 2 * len(found))
    if weights is None:
        key = {s: "" if s is None else f"={s}" for s in found}
        shares = whole_shares({key[s]: n**temper for s, n in found.items()}, frame)
        weights = {s: shares[key[s]] for s in found}
    elif missing := set(found) - set(weights):
        raise ValueError(f"no weight for {sorted(map(str, missing))}")
    names = sorted(found, key=lambda s: (s is None, s or ""))
    if not names:
        names, weights = [None], {None: 1}
    shares = [weights[s] for s in names]
    whole = sum(shares)
    # The first slot for which a source has no full block left.
    horizon = min((found.get(s, 0) // block_chars) * whole // weights[s] for s in names)

    spark = df.sparkSession
    pattern = frame_order(spark, shares)
    table = spark.createDataFrame([(i, s, weights[s]) for i, s in enumerate(names)], "_no int, _name string, _weight bigint")
    # As many rows as a frame has places.
    places = F.broadcast(pattern.join(F.broadcast(table), F.col("_source_no") == F.col("_no")))
    joined = placed.join(F.broadcast(table.select("_name", F.col("_weight").alias("_share"))), F.col("source").eqNullSafe(F.col("_name")))
    joined = joined.drop("_name").withColumn("_turn", F.col("block") % F.col("_share"))
    joined = joined.join(places, F.col("source").eqNullSafe(F.col("_name")) & (F.col("_turn") == F.col("_nth")))
    slot = F.expr(f"(block div _share) * {whole}") + F.col("_place")
    return joined.select(
        "id", "source", "block",
        F.floor(F.col("block") * whole / F.col("_share")).alias("release"),
        F.ceil((F.col("block") + 1) * whole / F.col("_share")).alias("deadline"),
        slot.alias("slot"), (slot < horizon).alias("exact"), "before", "n_chars", "row")


def in_mixed_order(df: DataFrame, **how) -> DataFrame:
    """The rows of ``df``, all of them, sorted into the order of the mix; the columns stay as they are."""
    mixed = mix_sources(df, carry=df.columns, **how)
    return mixed.orderBy("slot", "before", F.col("id").asc_nulls_last()).select("row.*")
