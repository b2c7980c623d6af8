"""Near-duplicate classes by DartMinHash and banded joining.

A text is the weighted set of its five-word shingles, weighted by how often each occurs. One dart is thrown
into every unit cell of (shingle, weight unit, rank unit); its hash fixes its coordinate and its rank inside
the cell. The signature keeps the earliest dart of each coordinate among the cells that the text's weights
cover. Rank units are opened, one after the other, until every coordinate has a dart, so a text costs about as many darts
as it has shingles, but at least enough to fill the signature. Two texts agree in a coordinate with a
probability equal to their weighted Jaccard similarity.

Coordinates are grouped to bands. Texts that agree in a whole band meet in a bucket. A few long bands come first:
members of their buckets are compared with one hub each, which brings large groups of copies together. Then the
short bands do the same, in those of their buckets alone that still hold several components. What is left open is
finished exactly: all members of different components that share a bucket are set against each other by their
signatures, in blocks of bounded size, each pair in the first bucket that it shares, and those whose signatures
agree often enough are compared.

Comparisons are exact, on whole texts, and grouped, so that a text is read once for many partners.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import table, text_slices, written

WORDS = 5
SIMILARITY = 0.8
BANDS = 28
BAND_COORDINATES = 4
# Long bands, which bring close copies together before the others are looked at.
LONG_BANDS = 4
LONG_COORDINATES = 12
# Chance that a pair at the similarity is not compared although it shares a bucket.
MISSED = 1e-7
# Shingles of a block's texts together, about; two blocks are held against each other in one task.
BLOCK_UNITS = 250_000
# Members of a bucket that share one copy of their hub's text.
HUB_ROWS = 256
# About so many comparisons share their texts in one task.
GROUP_PAIRS = 400
# Up to so many node ids (8 bytes each) are sent to all tasks to find their texts; beyond it the texts are shuffled.
BROADCAST_NODES = 1_000_000

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX_1, _MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(32)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _MIX_1
    x = (x ^ (x >> _S)) * _MIX_2
    return x ^ (x >> _S)


_powers = np.ones(1, dtype=np.uint64)


def _powers_to(n: int) -> np.ndarray:
    """Powers of an odd factor modulo 2**64; longer texts extend them."""
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.full(max(n, 1 << 16), _FACTOR, dtype=np.uint64))
    return _powers[:n]


def word_hashes(text: str) -> np.ndarray:
    """A hash for every word (run of bytes above the blank) of the lower-cased text."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    inside = np.concatenate(([False], data > 32, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    # Differences of prefix sums, moved to one common power so that a word's hash does not depend on its place.
    powers = _powers_to(len(data))
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers)))
    return mixed((sums[ends] - sums[starts]) * _inverse_powers_to(len(data))[starts] ^ (ends - starts).astype(np.uint64))


_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_inverse_powers = np.ones(1, dtype=np.uint64)


def _inverse_powers_to(n: int) -> np.ndarray:
    global _inverse_powers
    if len(_inverse_powers) < n:
        _inverse_powers = np.cumprod(np.full(max(n, 1 << 16), _INVERSE, dtype=np.uint64))
    return _inverse_powers[:n]


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Hashes of the shingles in order; a text of fewer words is one shingle, one without words has none."""
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes
    size = min(words, len(hashes))
    total = np.zeros(len(hashes) - size + 1, dtype=np.uint64)
    for i in range(size):
        total = mixed(total + hashes[i : len(hashes) - size + 1 + i])
    return total


def weight_units(hashes: np.ndarray) -> np.ndarray:
    """One hash per unit of weight: the shingle's with the number of the occurrence."""
    ordered = np.sort(hashes)
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    first = np.maximum.accumulate(np.where(new, np.arange(len(ordered)), 0))
    return mixed(ordered + (np.arange(len(ordered)) - first).astype(np.uint64) * _FACTOR)


def dart_signature(units: np.ndarray, coordinates: int) -> np.ndarray:
    """The earliest dart of each coordinate among all rank units of ``units``."""
    signature = np.full(coordinates, EMPTY, dtype=np.uint64)
    rank = 0
    while (empty := signature == EMPTY).any():
        rank += 1
        darts = mixed(units + np.uint64(rank * int(_MIX_2) % 2**64))
        where = ((darts >> np.uint64(8)) % np.uint64(coordinates)).astype(np.int64)
        # The rank inside the unit is another hash of the dart.
        found = np.full(coordinates, EMPTY, dtype=np.uint64)
        np.minimum.at(found, where, mixed(darts))
        signature = np.where(empty, found, signature)
    return signature


def _few_units_signature(units: np.ndarray, coordinates: int) -> np.ndarray:
    """As ``dart_signature``, many rank units at a time: for texts far shorter than the signature."""
    signature = np.full(coordinates, EMPTY, dtype=np.uint64)
    at_once = max(1, 2 * coordinates // len(units))
    opened = 0
    while (signature == EMPTY).any():
        ranks = np.arange(opened + 1, opened + at_once + 1, dtype=np.uint64) * _MIX_2
        darts = mixed((units[None, :] + ranks[:, None]).ravel())
        where = ((darts >> np.uint64(8)) % np.uint64(coordinates)).astype(np.int64)
        level = np.repeat(np.arange(at_once, dtype=np.int64), len(units))
        # Earlier units first, then the rank inside the unit.
        order = np.lexsort((mixed(darts), level))[::-1]
        found = np.full(coordinates, EMPTY, dtype=np.uint64)
        found[where[order]] = mixed(darts)[order]
        signature = np.where(signature == EMPTY, found, signature)
        opened += at_once
    return signature


def signature(text: str, coordinates: int, words: int = WORDS) -> np.ndarray | None:
    """The text's darts, or None for a text without words."""
    units = weight_units(shingles(text, words)) if text else np.zeros(0, dtype=np.uint64)
    if not len(units):
        return None
    return (_few_units_signature if 4 * len(units) < coordinates else dart_signature)(units, coordinates)


def weighted_similarity(a: str, b: str, words: int = WORDS) -> float:
    """Weighted Jaccard similarity of two whole texts."""
    x, y = (weight_units(shingles(t, words)) for t in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) and len(y) else 0.0


def least_agreement(coordinates: int, similarity: float, missed: float = MISSED) -> int:
    """In so many coordinates a pair at the similarity agrees, but for a chance of ``missed``."""
    total, least = 0.0, 0
    while least < coordinates:
        total += math.comb(coordinates, least) * similarity**least * (1 - similarity) ** (coordinates - least)
        if total > missed:
            break
        least += 1
    return least


def _band_hashes(darts: np.ndarray, bands: int, size: int, seed: int) -> np.ndarray:
    key = mixed(np.arange(1, bands + 1, dtype=np.uint64) + np.uint64(seed))
    for column in darts[: bands * size].reshape(bands, size).T:
        key = mixed(key + column)
    return key.view(np.int64)


def band_keys(docs: DataFrame, words: int, bands: int, band_coordinates: int) -> DataFrame:
    """(id, digest, mark): the text's digest, and its signature's low bytes, hashes of short and long bands and total weight.

    Texts without words have a null mark.
    """
    coordinates = max(bands * band_coordinates, LONG_BANDS * LONG_COORDINATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                marks = []
                for text in part.column(2).to_pylist():
                    darts = signature(text or "", coordinates, words)
                    if darts is None:
                        marks.append(None)
                        continue
                    marks.append(
                        {
                            "units": len(shingles(text, words)),
                            "bytes": darts.astype(np.uint8).tobytes(),
                            "short": _band_hashes(darts, bands, band_coordinates, 0).tolist(),
                            "long": _band_hashes(darts, LONG_BANDS, LONG_COORDINATES, 1 << 20).tolist(),
                        }
                    )
                kind = pa.struct([("units", pa.int64()), ("bytes", pa.binary()), ("short", pa.list_(pa.int64())), ("long", pa.list_(pa.int64()))])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(marks, kind)], names=["id", "digest", "mark"])

    schema = "id long, digest string, mark struct<units: long, bytes: binary, short: array<long>, long: array<long>>"
    return docs.select("id", F.md5("text").alias("digest"), "text").mapInArrow(run, schema)


def _bytes(column) -> np.ndarray:
    """A row of a matrix for every value; all are of one length."""
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype=np.uint8)


def agreeing(pairs: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """The rows (a, b, part) of ``pairs`` whose signatures agree in at least ``least`` coordinates."""

    @F.pandas_udf("boolean")
    def agree(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series((_bytes(a) == _bytes(b)).sum(axis=1) >= least, dtype=bool)

    marks = nodes.select("node", F.col("mark.bytes").alias("bytes"))
    both = pairs.join(marks.toDF("a", "bytes_a"), "a").join(marks.toDF("b", "bytes_b"), "b")
    return both.filter(agree("bytes_a", "bytes_b")).select("a", "b", "part")


def node_texts(ids: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, text) of the nodes ``ids``, once each."""
    wanted = written(nodes.select(F.col("node").alias("id"), "digest").join(ids.distinct(), "id", "left_semi"), "wanted")
    if wanted.count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    found = docs.join(wanted, "id").filter(F.md5("text") == F.col("digest")).select("id", "text").dropDuplicates(["id"])
    return written(found, "texts", "zstd")


def similar(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) that join what the rows (a, b, part) of ``pairs`` whose whole texts are similar enough join.

    Pairs with the same ``part`` share texts and are compared in one task; a pair of texts that other links of
    the task join already is left out.
    """
    asked = written(pairs.select("a", "b", "part"), "asked")
    count = asked.count()
    if not count:
        return asked.select("a", "b")
    groups = -(-count // GROUP_PAIRS)
    asked = asked.withColumn("part", F.pmod("part", F.lit(groups)))
    needed = written(asked.select(F.explode(F.array("a", "b")).alias("id"), "part").distinct(), "needed")
    texts = node_texts(needed.select("id"), docs, nodes)

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        units = {i: np.sort(weight_units(shingles(t, words))) for i, t in zip(right.id.tolist(), right.text.tolist())}
        root: dict[int, int] = {}

        def find(i: int) -> int:
            while (above := root.get(i, i)) != i:
                root[i] = root.get(above, above)
                i = above
            return i

        links = []
        for a, b in zip(left.a.tolist(), left.b.tolist()):
            p, q = find(a), find(b)
            if p == q:
                continue
            if _resemble(units[a], units[b], similarity):
                links.append((a, b))
                root[p] = q
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    held = needed.join(texts, "id")
    return asked.groupBy("part").cogroup(held.groupBy("part")).applyInPandas(compare, "a long, b long")


def open_buckets(members: DataFrame) -> DataFrame:
    """The rows (key, node, units, component, ..) of buckets with several components, with each bucket's size and hub.

    The hub is a member of the component with most members in the bucket.
    """
    sizes = members.groupBy("key", "component").agg(
        F.count("*").alias("n"), F.sum("units").alias("weight"), F.min(F.struct("node", "units")).alias("first")
    )
    largest = F.max(F.struct("n", "component", "first", "weight")).alias("hub")
    buckets = sizes.groupBy("key").agg(
        largest, F.sum("n").alias("rows"), F.sum("weight").alias("weight"), F.count("*").alias("components")
    ).filter("components > 1")
    buckets = buckets.select(
        "key", "rows", F.col("hub.weight").alias("hub_weight"), (F.col("weight") - F.col("hub.weight")).alias("rest_weight"),
        F.col("hub.component").alias("hub_component"),
        F.col("hub.first.node").alias("hub"), F.col("hub.first.units").alias("hub_units"),
    )
    return members.join(buckets, "key")


def hub_pairs(opened: DataFrame, similarity: float) -> DataFrame:
    """(a, b, part): every member outside the hub's component against the hub, once, where total weights allow the similarity."""
    within = F.least("units", "hub_units") >= similarity * F.greatest("units", "hub_units")
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("rows") / HUB_ROWS))
    met = opened.filter(within & (F.col("component") != F.col("hub_component")))
    pairs = met.groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.min(salt).alias("salt"))
    return pairs.select("a", "b", F.xxhash64("a", "salt").alias("part"))


def dealt_blocks(opened: DataFrame) -> DataFrame:
    """(task, band, node, component, first, second): the members of open buckets, in all tasks that their blocks have a part in.

    A bucket's rows are its hub's component and the rest, each dealt to blocks of bounded weight. Blocks of the rest
    meet each other and the hub's blocks; the two sides of a task are ``first`` and ``second``.
    """
    blocks = lambda weight: F.greatest(F.ceil(F.col(weight) / BLOCK_UNITS), F.lit(1)).cast("int")
    own = (F.col("component") == F.col("hub_component")).alias("own")
    placed = opened.select("key", "band", "node", "component", own, blocks("hub_weight").alias("hubs"), blocks("rest_weight").alias("rests"))
    at = F.pmod(F.xxhash64("node"), F.when(F.col("own"), F.col("hubs")).otherwise(F.col("rests"))).cast("int")
    placed = placed.withColumn("at", at)
    over = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    task = lambda kind, x, y, first, second: F.struct(
        F.xxhash64("key", F.lit(kind), x, y).alias("task"), first.alias("first"), second.alias("second")
    )
    yes, no = F.lit(True), F.lit(False)
    with_rest = lambda y: task(0, F.col("at"), y, yes, no)
    with_hub = lambda x: task(0, x, F.col("at"), no, yes)
    inside = lambda y: task(1, F.least("at", y), F.greatest("at", y), F.col("at") <= y, F.col("at") >= y)
    tasks = F.when(F.col("own"), F.transform(over("rests"), with_rest)).otherwise(
        F.concat(F.transform(over("hubs"), with_hub), F.transform(over("rests"), inside))
    )
    return placed.select("band", "node", "component", F.explode(tasks).alias("t")).select("t.task", "band", "node", "component", "t.first", "t.second")


def _meetings(rows: pd.DataFrame, similarity: float, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (x, y) of a task's pairs that may be similar: of different components, often enough agreeing, met here first."""
    x, y = np.flatnonzero(rows["first"].to_numpy()), np.flatnonzero(rows["second"].to_numpy())
    signs, component, units = _bytes(rows.bytes), rows.component.to_numpy(), rows.units.to_numpy()
    short, band = np.stack(rows.short.to_numpy()), int(rows.band.iloc[0])
    for start in range(0, len(x), 64):
        part = x[start : start + 64]
        fits = component[part][:, None] != component[y]
        low, high = np.minimum(units[part][:, None], units[y]), np.maximum(units[part][:, None], units[y])
        fits &= low >= similarity * high
        for earlier in range(band):
            fits &= short[part, earlier][:, None] != short[y, earlier]
        i, j = np.nonzero(fits)
        for cut in range(0, len(i), 1 << 16):
            p, q = part[i[cut : cut + (1 << 16)]], y[j[cut : cut + (1 << 16)]]
            enough = (signs[p] == signs[q]).sum(axis=1) >= least
            yield p[enough], q[enough]


def _by_task(rows: DataFrame, use, schema: str) -> DataFrame:
    """``use(rows of a task)`` for every task; tasks are read one at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            last = frame.task.iloc[-1] if len(frame) else None
            if held and len(frame) and (held[0].task.iloc[0] != last or frame.task.iloc[0] != last):
                frame, held = pd.concat([*held, frame], ignore_index=True), []
            closed = frame[frame.task != last]
            for _, part in closed.groupby("task", sort=False):
                yield use(part.reset_index(drop=True))
            if len(frame):
                held.append(frame[frame.task == last])
        if held:
            yield use(pd.concat(held, ignore_index=True))

    return rows.repartition("task").sortWithinPartitions("task").mapInPandas(run, schema)


def block_links(opened: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, similarity: float, least: int) -> DataFrame:
    """Links (a, b) that join what similar members of different components in the open buckets join.

    Signatures come first; only members with a partner that agrees often enough are met again, with their texts.
    Nothing is listed by pairs but the links.
    """
    dealt = written(dealt_blocks(opened), "dealt")
    marks = nodes.select("node", F.col("mark.bytes").alias("bytes"), F.col("mark.short").alias("short"), F.col("mark.units").alias("units"))

    def partners(rows: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros(len(rows), dtype=bool)
        for p, q in _meetings(rows, similarity, least):
            found[p], found[q] = True, True
        return rows.loc[found, ["task", "node"]].drop_duplicates()

    met = written(_by_task(dealt.join(marks, "node"), partners, "task long, node long"), "met")
    if met.isEmpty():
        return met.select(F.col("task").alias("a"), F.col("node").alias("b"))
    texts = node_texts(met.select(F.col("node").alias("id")), docs, nodes).withColumnRenamed("id", "node")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        units: dict[int, np.ndarray] = {}
        root: dict[int, int] = {}

        def find(i: int) -> int:
            while (above := root.get(i, i)) != i:
                root[i] = root.get(above, above)
                i = above
            return i

        node, text, component = rows.node.to_numpy(), rows.text.to_numpy(), rows.component.to_numpy()
        links = []
        for p, q in _meetings(rows, similarity, least):
            for i, j in zip(p.tolist(), q.tolist()):
                a, b = find(component[i]), find(component[j])
                if a == b:
                    continue
                for k in (i, j):
                    if k not in units:
                        units[k] = np.sort(weight_units(shingles(text[k], words)))
                if _resemble(units[i], units[j], similarity):
                    links.append((node[i], node[j]))
                    root[a] = b
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    again = dealt.join(met, ["task", "node"], "left_semi").join(marks, "node").join(texts, "node")
    return _by_task(again, compare, "a long, b long")


def _resemble(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets of weight units are similar enough."""
    if not len(x) or not len(y):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return both / (len(x) + len(y) - both) >= similarity


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node that ``links`` (a, b) reach, for every node in them or in ``labels``.

    ``labels`` is an earlier result to which the links are added. Every round a node takes the smallest label
    among its neighbours, then its label's label, which shortens long chains by half.
    """
    if labels is not None:  # links of roots: what a root learns, its members learn as their label's label
        known = labels.toDF("node", "root")
        for end in ("a", "b"):
            joined = links.join(known, links[end] == known["node"], "left")
            links = joined.withColumn(end, F.coalesce("root", end)).select("a", "b")
    links = links.filter("a != b")
    both = written(links.union(links.select("b", "a")).toDF("u", "v"), "edges")
    if both.isEmpty():
        return labels if labels is not None else both.toDF("node", "component")
    first = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("component")).toDF("node", "component")
    if labels is not None:
        first = first.union(labels).groupBy("node").agg(F.min("component").alias("component"))
    labels, before = written(first, "labels"), None
    while True:
        passed = both.join(labels.toDF("v", "component"), "v").select(F.col("u").alias("node"), "component")
        lower = written(passed.union(labels).groupBy("node").agg(F.min("component").alias("component")), "lower")
        jumped = lower.join(lower.toDF("component", "root"), "component").select("node", F.col("root").alias("component"))
        labels = written(jumped, "labels")
        state = labels.agg(F.count("*"), F.sum(F.col("component").cast("decimal(38,0)"))).first()
        if state == before:
            return labels
        before = state


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = WORDS,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    band_coordinates: int = BAND_COORDINATES,
) -> DataFrame:
    """(id_column, class_id) for every row of ``docs``: class_id is the smallest id that links reach.

    Rows with equal texts are linked, also empty ones; texts whose weighted shingle similarity reaches
    ``similarity`` are linked; null texts are linked to nothing. A row has the class of
    its own text, also where its id is repeated; texts with the same smallest id count as one. The class of a
    null id is null. Other columns are not looked at. The chance that two
    texts just at 0.8 share no band is (1 - 0.8**4)**28, below one in a million.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    keyed = written(band_keys(rows, words, bands, band_coordinates), "bands")
    # Equal texts are one node, named by the smallest id; only nodes go on.
    known = keyed.filter("id IS NOT NULL AND digest IS NOT NULL")
    nodes = written(known.groupBy("digest").agg(F.min("id").alias("node"), F.first("mark").alias("mark")), "nodes")
    # Texts with the same smallest id count as one: the one with the smallest digest stands for them.
    marked = nodes.filter("mark IS NOT NULL").groupBy("node").agg(F.min("digest").alias("digest"), F.min_by("mark", "digest").alias("mark"))
    marked = written(marked, "marked")
    named = rows.filter("id IS NOT NULL AND text IS NOT NULL")
    least = least_agreement(max(bands * band_coordinates, LONG_BANDS * LONG_COORDINATES), similarity)

    def linked(pairs: DataFrame) -> DataFrame:
        return written(similar(agreeing(pairs, marked, least), named, marked, words, similarity), "links")

    def members(kind: str) -> DataFrame:
        return marked.select("node", F.col("mark.units").alias("units"), F.posexplode(F.col(f"mark.{kind}")).alias("band", "key"))

    def with_components(rows: DataFrame, classes: DataFrame) -> DataFrame:
        return rows.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))

    alone = members("long").withColumn("component", F.col("node"))
    classes = components(linked(hub_pairs(open_buckets(alone), similarity)))
    columns = ["key", "band", "node", "units"]
    opened = written(open_buckets(with_components(members("short"), classes)), "open")
    classes = components(linked(hub_pairs(opened, similarity)), classes)
    opened = written(open_buckets(with_components(opened.select(*columns), classes)), "open")
    if not opened.isEmpty():
        classes = components(written(block_links(opened, named, marked, words, similarity, least), "links"), classes)

    ids = keyed.select("id", "digest")
    labelled = nodes.select("digest", "node").join(classes, "node", "left").select("digest", F.coalesce("component", "node").alias("class"))
    classed = ids.join(labelled, "digest", "left")
    return classed.select(
        F.col("id").alias(id_column), F.when(F.col("id").isNotNull(), F.coalesce("class", "id")).alias("class_id")
    )


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the class of near copies that they belong to."""
    return near_duplicates(table(spark, sf_dir, "documents"))
