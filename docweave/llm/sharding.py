"""A uniform shuffle into shards of exact size.

Rows are dealt by a hash to partitions of bounded size. How many rows of each partition go to each shard is
drawn before any row moves: the communication matrix follows the multivariate hypergeometric law that a
uniform permutation of all rows would induce, with the shards' sizes as column sums. The partitions are
halved again and again; each half's counts are drawn given its parent's, so that a row of the matrix comes
from log2(partitions) draws. Every partition then orders its rows at random and deals them out by its matrix
row; after the exchange every shard orders its rows at random again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.llm.common import let, table

PARTITION_ROWS = 50_000
# Standard deviations around the mode within which a count is drawn; what lies beyond has less than 1e-30 of the mass.
REACH = 12


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(2**53)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` out of ``total`` are among ``marked``: inverse transform of ``u``.

    Outcomes are walked from the mode upwards, then downwards, by the ratio of neighbouring probabilities.
    """

    def with_case(c: Column) -> Column:
        n, k, m, v = c["n"], c["k"], c["m"], c["u"]

        def with_range(r: Column) -> Column:
            def up(x: Column) -> Column:  # p(x + 1) / p(x)
                return (k - x) * (m - x) / ((x + 1) * (n - k - m + x + 1))

            def down(x: Column) -> Column:  # p(x - 1) / p(x)
                return x * (n - k - m + x) / ((k - x + 1) * (m - x + 1))

            def mass(start: Column, steps: Column, ratio) -> Column:
                first = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
                walk = F.sequence(F.lit(0).cast("long"), F.greatest(steps - 1, F.lit(0)).cast("long"))
                sign = 1 if ratio is up else -1

                def step(s: Column, i: Column) -> Column:
                    w = F.when(i < steps, s["w"] * ratio(start + sign * i.cast("double"))).otherwise(F.lit(0.0))
                    return let(w, lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum")))

                return F.aggregate(walk, first, step, lambda s: s["sum"])

            def seek(start: Column, steps: Column, ratio, goal: Column) -> Column:
                """The outcome past ``start`` at which the running mass exceeds ``goal`` (the last one at most)."""
                first = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("at"))
                walk = F.sequence(F.lit(0).cast("long"), F.greatest(steps - 1, F.lit(0)).cast("long"))
                sign = 1 if ratio is up else -1

                def step(s: Column, i: Column) -> Column:
                    w = F.when(i < steps, s["w"] * ratio(start + sign * i.cast("double"))).otherwise(F.lit(0.0))
                    found = (s["sum"] > goal) | (i >= steps)
                    return F.when(found, s).otherwise(
                        let(w, lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum"), (i + 1).alias("at")))
                    )

                return start + sign * F.aggregate(walk, first, step, lambda s: s["at"]).cast("double")

            rising, falling = r["high"] - r["mode"], r["mode"] - r["low"]
            masses = F.struct(mass(r["mode"], rising, up).alias("up"), mass(r["mode"], falling, down).alias("down"))

            def pick(s: Column) -> Column:
                goal = v * (1.0 + s["up"] + s["down"])
                return (
                    F.when(goal < 1.0, r["mode"])
                    .when(goal < 1.0 + s["up"], seek(r["mode"], rising, up, goal - 1.0))
                    .otherwise(seek(r["mode"], falling, down, goal - 1.0 - s["up"]))
                )

            return let(masses, pick)

        share = k / n
        spread = F.ceil(REACH * F.sqrt(m * share * (1.0 - share) * (n - m) / F.greatest(n - 1.0, F.lit(1.0)))) + REACH
        lowest, highest = F.greatest(F.lit(0.0), m - (n - k)), F.least(m, k)
        mode = F.least(F.greatest(F.floor((m + 1.0) * (k + 1.0) / (n + 2.0)).cast("double"), lowest), highest)
        bounds = let(
            mode,
            lambda x: F.struct(
                x.alias("mode"), F.greatest(lowest, x - spread).alias("low"), F.least(highest, x + spread).alias("high")
            ),
        )
        return F.when((n <= 0) | (k <= 0) | (m <= 0), F.lit(0.0)).otherwise(let(bounds, with_range))

    case = F.struct(
        total.cast("double").alias("n"), marked.cast("double").alias("k"), drawn.cast("double").alias("m"), u.alias("u")
    )
    return let(case, with_case).cast("long")


def _split(capacities: Column, drawn: Column, seed: Column) -> Column:
    """How many of ``drawn`` rows go to each shard when the shards still take ``capacities``."""
    none = F.array().cast("array<long>")
    state = F.struct(
        F.aggregate(capacities, F.lit(0).cast("long"), lambda s, c: s + c).alias("left"),
        drawn.cast("long").alias("draws"),
        none.alias("out"),
    )

    def take(s: Column, c: Column) -> Column:
        u = _uniform(seed, F.size(s["out"]))
        return let(
            hypergeometric(s["left"], c, s["draws"], u),
            lambda x: F.struct(
                (s["left"] - c).alias("left"), (s["draws"] - x).alias("draws"), F.concat(s["out"], F.array(x)).alias("out")
            ),
        )

    return F.aggregate(capacities, state, take, lambda s: s["out"])


def communication_matrix(counts: DataFrame, partitions: int, sizes: list[int], seed: int = 0) -> DataFrame:
    """(part, to_shard): for every partition the rows that go to each shard, an array as long as ``sizes``.

    ``counts`` is (part, n) with parts below ``partitions``, a power of two; ``sizes`` sums to all n.
    """
    spark = counts.sparkSession
    every = spark.range(partitions).select(F.col("id").alias("part"))
    full = every.join(counts, "part", "left").select(F.struct("part", F.coalesce("n", F.lit(0)).cast("long").alias("n")).alias("c"))
    nodes = full.agg(F.sort_array(F.collect_list("c")).alias("cs")).select(  # one entry per partition
        F.lit(0).cast("long").alias("start"),
        F.transform("cs", lambda c: c["n"]).alias("ns"),
        F.array(*[F.lit(s).cast("long") for s in sizes]).alias("capacities"),
    )
    width, level = partitions, 0
    while width > 1:
        half = width // 2
        lower, upper = F.slice("ns", 1, half), F.slice("ns", half + 1, half)
        drawn = F.aggregate(lower, F.lit(0).cast("long"), lambda s, n: s + n)
        children = let(
            _split(F.col("capacities"), drawn, F.xxhash64(F.lit(seed), F.lit(level), F.col("start"))),
            lambda mine: F.array(
                F.struct(F.col("start").alias("start"), lower.alias("ns"), mine.alias("capacities")),
                F.struct(
                    (F.col("start") + half).alias("start"),
                    upper.alias("ns"),
                    F.zip_with(F.col("capacities"), mine, lambda c, m: c - m).alias("capacities"),
                ),
            ),
        )
        nodes = nodes.select(F.explode(children).alias("node")).select("node.*")
        width, level = half, level + 1
        if level == 7:
            nodes = nodes.repartition("start")
    return nodes.select(F.col("start").alias("part"), F.col("capacities").alias("to_shard"))


def shuffle_into_shards(rows: DataFrame, shards: int, key: list[str], seed: int = 0, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` in place of columns of these names: a uniform random permutation.

    Shards hold equal numbers of rows, the first ones one more where it does not divide. Slots count from 0
    without gaps. ``key`` are the columns that tell rows apart: rows equal in all of them should be equal in
    every column, as their order among each other is open. Nulls and repeated rows are ordinary rows; an
    empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    total = rows.count()
    sizes = [total // shards + (j < total % shards) for j in range(shards)]
    partitions = 1 << max(0, (-(-total // partition_rows) - 1).bit_length())
    blocks = 1 << max(0, (-(-max(sizes) // partition_rows) - 1).bit_length())
    block_bits = blocks.bit_length() - 1

    names = [c for c in rows.columns if c not in ("shard", "slot")]
    keys = [rows[k] for k in key]
    hashed = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), *keys)
    body = rows.select(
        F.struct(*[rows[c] for c in names]).alias("row"),
        F.pmod(hashed("part"), F.lit(partitions)).alias("part"),
        hashed("first").alias("first"),
        hashed("second").alias("second"),
    )
    matrix = communication_matrix(body.groupBy("part").agg(F.count("*").alias("n")), partitions, sizes, seed)
    ends = matrix.select(
        F.col("part").alias("matrix_part"),
        F.transform("to_shard", lambda _, i: F.aggregate(F.slice("to_shard", F.lit(1), i + 1), F.lit(0).cast("long"), lambda s, n: s + n)).alias("ends"),
    )

    def assigned(columns: list[str]) -> DataFrame:
        local = Window.partitionBy("part").orderBy("first", "second")
        ranked = body.select("part", "first", "second", *columns).withColumn("place", F.row_number().over(local) - 1)
        dealt = ranked.join(ends, ranked["part"] == ends["matrix_part"])
        shard = F.size(F.filter("ends", lambda e: e <= F.col("place")))
        block = F.shiftrightunsigned("second", 64 - block_bits).cast("int") if block_bits else F.lit(0)
        return dealt.select(shard.alias("shard"), block.alias("block"), "first", "second", *columns)

    within = Window.partitionBy("shard", "block").orderBy(F.expr("second < 0"), "second", "first")
    placed = assigned(["row"]).withColumn("slot", F.row_number().over(within).cast("long") - 1)
    if block_bits:
        counts = assigned([]).groupBy("shard", "block").agg(F.count("*").alias("n"))
        earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select("shard", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
        placed = placed.join(offsets, ["shard", "block"]).withColumn("slot", F.col("slot") + F.col("offset"))
    return placed.select("row.*", "shard", "slot")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by the law of rows, with digests of what each shard row holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return shuffle_into_shards(docs, 40, ["doc_id", "text"]).select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
