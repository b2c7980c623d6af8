"""Loosely named paths of any length in a graph whose nodes are known by name.

Two names match when one holds the other, over letters and digits alone. A name that holds another one has it as
one of its runs, so runs are the join keys. Only those runs are made that begin as some held name does and are as
long as one with that beginning, so that what is joined grows with the matches, not with the pairs of names that
share a common piece. Of names longer than ``LONGEST`` the beginning is the key, and containment is checked.

A path's first hop is looked for from the end that fewer edges touch, for each pair of names once. After it the path
is walked hop by hop: a frontier of (path, node) rows meets the edges that leave its nodes, and keeps the targets
whose type and name are as asked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators.joins import sorted_side
from docweave.session import stored

START = 2
LONGEST = 32


def held_names(inner: DataFrame, outer: DataFrame, q: int = START) -> DataFrame:
    """(inner, outer): all pairs in which ``outer`` holds ``inner``, of two columns of distinct normalised names; empty ones have no pairs.

    Names begin with their first ``q`` characters; there are at most 36 ** q such beginnings, and these are broadcast.
    """
    inner = inner.toDF("inner").where("inner != ''").withColumn("run", F.substring("inner", 1, LONGEST))
    outer = outer.toDF("outer").where("outer != ''")
    begins = inner.groupBy(F.substring("inner", 1, q).alias("start")).agg(F.collect_set(F.length("run")).alias("sizes"))
    shown = sorted(r[0] for r in begins.select(F.length("start")).distinct().collect())  # at most q of them
    at, size = F.col("at"), F.col("size")
    placed = outer.select("outer", F.explode(F.sequence(F.lit(1), F.length("outer"))).alias("at"))
    starts = [F.when(at + n - 1 <= F.length("outer"), F.substring("outer", at, F.lit(n))) for n in shown or [q]]
    begun = placed.select("outer", "at", F.explode(F.array(*starts)).alias("start")).join(F.broadcast(begins), "start")
    runs = begun.select("outer", "at", F.explode("sizes").alias("size")).where(at + size - 1 <= F.length("outer"))
    runs = runs.select("outer", "at", F.substring("outer", at, size).alias("run")).where(F.instr("outer", F.col("run")) == at)  # once each
    return runs.select("outer", "run").join(sorted_side(inner), "run").where(F.col("outer").contains(F.col("inner"))).select("inner", "outer")


def matched_names(wanted: DataFrame, actual: DataFrame, q: int = START) -> DataFrame:
    """(wanted, actual): the pairs of two columns of distinct normalised names of which either holds the other."""
    longer = held_names(wanted, actual, q).toDF("wanted", "actual")
    shorter = held_names(actual, wanted, q).toDF("actual", "wanted").where(F.length("actual") < F.length("wanted"))
    return longer.unionByName(shorter)


def loose_matches(wanted: DataFrame, actual: DataFrame, q: int = START) -> DataFrame:
    """(wanted, actual): the pairs of normalised names, a column each, of which either holds the other."""
    return matched_names(stored(wanted.distinct(), "wanted-names"), stored(actual.distinct(), "actual-names"), q)


def hops_of(expected: DataFrame) -> DataFrame:
    """(path_id, hop, want_source, rel, want_target): a row per hop of every path (node, type, node, type, ...)."""
    count = F.floor(F.size("path") / 2).cast("int")
    hop = F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")))
    node = lambda at: tx.alnum_name(F.get("path", at))
    placed = expected.select("path_id", "path", hop.alias("hop"))
    return placed.select(
        "path_id", "hop", node(F.col("hop") * 2).alias("want_source"), F.get("path", F.col("hop") * 2 + 1).alias("rel"),
        node(F.col("hop") * 2 + 2).alias("want_target"),
    )


def named_ends(nodes: DataFrame, triples: DataFrame) -> DataFrame:
    """(actual, is_node, leaving, entering): every name once, whether a node has it, and how many edges leave and enter it.

    Ends of edges may have names that the list of nodes lacks; those can be walked but are not found as nodes.
    """
    no, none, one = F.lit(False).alias("is_node"), F.lit(0), F.lit(1)
    ends = nodes.select(tx.alnum_name(F.col("name")).alias("actual"), F.lit(True).alias("is_node"), none.alias("leaving"), none.alias("entering"))
    ends = ends.unionByName(triples.select(F.col("source").alias("actual"), no, one.alias("leaving"), none.alias("entering")))
    ends = ends.unionByName(triples.select(F.col("target").alias("actual"), no, none.alias("leaving"), one.alias("entering")))
    return ends.groupBy("actual").agg(F.max("is_node").alias("is_node"), F.sum("leaving").alias("leaving"), F.sum("entering").alias("entering"))


def first_edges(asked: DataFrame, matches: DataFrame, reach: DataFrame, triples: DataFrame) -> DataFrame:
    """(want_source, want_target, type, target): the edges between two names, for every pair of ``asked`` once.

    ``matches`` holds (wanted, actual, leaving, entering), ``reach`` their sums by ``wanted``. A pair meets the edges
    that leave the matches of its source or those that enter the matches of its target, whichever are fewer.
    """
    sides = asked.distinct()
    for end, sums in (("want_source", "leaving"), ("want_target", "entering")):
        sides = sides.join(sorted_side(reach.where(F.col(sums) > 0).select(F.col("wanted").alias(end), sums)), end)
    sides = stored(sides.select("want_source", "want_target", (F.col("leaving") <= F.col("entering")).alias("forward")), "first-hops")

    def met(pairs, sums, near, far):
        known = matches.where(F.col(sums) > 0).select(F.col("wanted").alias(f"want_{near}"), F.col("actual").alias(near))
        found = pairs.join(sorted_side(known), f"want_{near}").join(sorted_side(triples), near)
        return found.where(tx.loosely_matches(F.col(f"want_{far}"), F.col(far))).select("want_source", "want_target", "type", "target")

    forward = met(sides.where("forward"), "leaving", "source", "target")
    return forward.unionByName(met(sides.where("NOT forward"), "entering", "target", "source")).distinct()


def walked(hops: DataFrame, triples: DataFrame, begun: DataFrame, longest: int) -> DataFrame:
    """(path_id, hops_ok): how many hops of each path can be walked on end; paths without a first step are left out.

    ``begun`` holds (path_id, type, target) of the edges whose ends match the first hop's names. Paths that ask the
    same of the same node take the step together.
    """
    first = hops.where("hop = 0").select("path_id", "rel")
    frontier = begun.join(sorted_side(first), "path_id").where(F.upper("type") == F.upper("rel")).select("path_id", F.col("target").alias("node")).distinct()
    reached = frontier.select("path_id", F.lit(1).alias("hops_ok"))
    step = ["node", "asked", "want_target"]
    for hop in range(1, longest):
        asked = hops.where(F.col("hop") == hop).select("path_id", F.upper("rel").alias("asked"), "want_target")
        at = stored(frontier.join(sorted_side(asked), "path_id").select("path_id", *step), "asked-steps")
        steps = at.select(*step).distinct().join(sorted_side(triples), (F.col("node") == F.col("source")) & (F.upper("type") == F.col("asked")))
        steps = steps.where(tx.loosely_matches(F.col("want_target"), F.col("target"))).select(*step, "target").distinct()
        frontier = at.join(sorted_side(steps), step).select("path_id", F.col("target").alias("node")).distinct()
        if hop + 1 < longest:
            frontier = stored(frontier, "frontier")
        reached = reached.unionByName(frontier.select("path_id", F.lit(hop + 1).alias("hops_ok")))
    return reached.groupBy("path_id").agg(F.max("hops_ok").alias("hops_ok"))


def check_paths(expected: DataFrame, nodes: DataFrame, edges: DataFrame, q: int = START) -> DataFrame:
    """Each expected (path_id, path) against node names (name) and edges (source, type, target).

    Returns path_id; ok and near_miss for the first hop alone (a one-element path asks for a node); hops, hops_ok,
    full_ok for the whole path: how many hops it has, how many can be walked on end, and whether all can. Names
    match loosely, types regardless of case. Nodes are told apart by their normalised names.
    """
    paths = stored(expected.select("path_id", "path"), "paths")
    hops = hops_of(paths)
    triples = stored(
        edges.select(tx.alnum_name(F.col("source")).alias("source"), "type", tx.alnum_name(F.col("target")).alias("target")).distinct(), "triples"
    )
    node = lambda at: tx.alnum_name(F.get("path", F.lit(at)))
    ends = paths.select(
        "path_id", node(0).alias("want_start"), F.get("path", F.lit(1)).alias("rel"), node(2).alias("want_end"),
        F.greatest(F.floor(F.size("path") / 2).cast("int"), F.lit(0)).alias("hops"),
    )
    wanted = ends.select(F.explode(F.array("want_start", "want_end")).alias("wanted"))
    names = stored(named_ends(nodes, triples), "names")
    met = matched_names(stored(wanted.distinct(), "wanted-names"), names.select("actual"), q).join(sorted_side(names), "actual")
    matches = stored(met, "matches")
    reach = matches.groupBy("wanted").agg(F.max("is_node").alias("found"), F.sum("leaving").alias("leaving"), F.sum("entering").alias("entering"))
    reach = stored(reach, "reach")
    met = reach.where("found").select("wanted")
    first = hops.where("hop = 0")
    linking = stored(first_edges(first.select("want_source", "want_target"), matches, reach, triples), "first-edges")
    begun = first.join(sorted_side(linking), ["want_source", "want_target"]).select("path_id", "type", "target")
    begun = stored(begun.distinct(), "begun")
    linked = begun.groupBy("path_id").agg(F.array_sort(F.collect_set("type")).alias("types"))
    longest = hops.agg(F.coalesce(F.max("hop") + 1, F.lit(0))).first()[0]
    known_types = stored(triples.select(F.upper("type").alias("known_type")).distinct(), "types")
    later = hops.where("hop > 0").select(F.upper("rel").alias("known_type")).join(known_types, "known_type", "left_semi").distinct()
    walkable = triples.where(F.upper("type").isin([r[0] for r in later.collect()]))  # types of edges, as few as the schema has
    steps = walked(hops, walkable, begun, longest)

    checked = (
        ends.join(sorted_side(met.select(F.col("wanted").alias("want_start"), F.lit(True).alias("start_found"))), "want_start", "left")
        .join(sorted_side(met.select(F.col("wanted").alias("want_end"), F.lit(True).alias("end_found"))), "want_end", "left")
        .join(sorted_side(linked), "path_id", "left")
        .join(sorted_side(steps), "path_id", "left")
        .join(known_types, F.upper("rel") == F.col("known_type"), "left")
    )
    start_ok, end_ok = (F.coalesce(F.col(c), F.lit(False)) for c in ("start_found", "end_found"))
    is_node = F.col("rel").isNull()
    typed = F.coalesce(F.exists("types", lambda t: F.upper(t) == F.upper("rel")), F.lit(False))
    ok = F.when(is_node, start_ok).otherwise(typed)
    near_miss = (
        F.when(ok, "")
        .when(is_node, "node missing")
        .when(~start_ok & ~end_ok, "both nodes missing")
        .when(F.col("types").isNotNull(), F.concat(F.lit("connected via "), F.array_join("types", ", ")))
        .when(F.col("known_type").isNull(), "type missing")
        .otherwise(F.concat(F.lit("no edge; start="), start_ok.cast("string"), F.lit(" end="), end_ok.cast("string")))
    )
    hops_ok = F.coalesce("hops_ok", F.lit(0))
    full = F.when(is_node, start_ok).otherwise(hops_ok == F.col("hops"))
    return checked.select("path_id", ok.alias("ok"), near_miss.alias("near_miss"), "hops", hops_ok.alias("hops_ok"), full.alias("full_ok"))
