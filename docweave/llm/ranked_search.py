"""Ranked lexical search of many items over many documents by dual trees.

A document is a vector over the terms of the items: the share of a score that each term brings. A node of the
document tree holds the largest coordinates of the documents below it, a node of the item tree the terms of all
its items; the sum of the former over the latter bounds every score between the two. A pair of nodes is dropped
with all that lies below it when its bound is under the weakest k-th score of the node's items, so the result is exact.

Documents are counted once, gathered to leaves of documents with the same heaviest terms, and written, a row per
leaf. The leaves with the largest bounds are searched first, for all items; their k-th scores are what every task
starts from. Tasks rebuild the upper levels of the document tree over the leaves that they read. Items go to all tasks
in blocks of a bounded number of terms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.llm.common import small_batches, table, text_slices, written

TOP = 10
# Terms of all items of a block, with repeats in several items; a block goes to all tasks (about 50 bytes a term).
BLOCK_TERMS = 400_000
LEAF_DOCS = 64
BATCH_DOCS = 4_096
FAN = 4
SEED_LEAVES = 3

# What lies between terms, and the letters that are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LEAF = "leaf long, top_terms array<int>, top_values array<long>, ids array<long>, sizes array<int>, terms array<int>, shares array<long>"


def _byte_map() -> np.ndarray:
    """Bytes of terms to themselves, capitals to small letters, all others to a blank."""
    codes = np.full(256, 32, dtype=np.uint8)
    for low, high in ((48, 58), (65, 91), (97, 123), (128, 256)):
        codes[low:high] = np.arange(low, high)
    codes[65:91] += 32
    return codes


def term_counts(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each text, with repeats; text numbers, vocabulary numbers and counts of the terms in ``vocabulary``)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8)[bounds[0] : bounds[-1]] if held is not None else np.zeros(0, dtype=np.uint8)
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(bounds - bounds[0]), pa.py_buffer(_byte_map()[data]))
    words = pc.split_pattern(plain, " ")
    flat = words.flatten()
    row = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
    totals = np.bincount(row[pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0], minlength=len(texts))
    place = pc.fill_null(pc.index_in(flat, value_set=vocabulary), -1).to_numpy().astype(np.int64)
    known = place >= 0
    pairs, counts = np.unique(row[known] * len(vocabulary) + place[known], return_counts=True)
    return totals, pairs // max(1, len(vocabulary)), pairs % max(1, len(vocabulary)), counts


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, kind))


def counted_documents(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n, terms, counts) of every document with a term; terms are numbers in ``vocabulary``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(shared.value, pa.large_string())
        for batch in batches:
            for part in text_slices(batch, "text"):
                totals, row, term, count = term_counts(part.column(1), wanted)
                sizes = np.bincount(row, minlength=part.num_rows)
                found = pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(totals, pa.int64()), _lists(term, sizes, pa.int32()), _lists(count, sizes, pa.int32())],
                    names=["doc_id", "n", "terms", "counts"],
                )
                yield found.filter(pa.array(totals > 0))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


def _segments(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges ``starts[i], .. starts[i] + sizes[i] - 1``, on end."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of ``sizes`` along the last axis; empty runs sum to 0."""
    before = np.concatenate((np.zeros(values.shape[:-1] + (1,), dtype=np.int64), np.cumsum(values, axis=-1)), axis=-1)
    ends = np.cumsum(sizes)
    return before[..., ends] - before[..., ends - sizes]


@dataclass
class Level:
    """Nodes of the item tree: their terms on end, and where each one's children begin in the level below."""

    terms: np.ndarray
    sizes: np.ndarray
    first: np.ndarray
    starts: np.ndarray = field(init=False)

    def __post_init__(self):
        self.starts = np.cumsum(self.sizes) - self.sizes

    def bounds(self, dense: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        sizes = self.sizes[nodes]
        return _sums(dense[self.terms[_segments(self.starts[nodes], sizes)]], sizes)


@dataclass
class ItemTree:
    """Items in an order that keeps those with the same weighty terms together, under levels of ``FAN`` nodes each."""

    item_ids: list[int | None]
    weights: np.ndarray
    levels: list[Level]

    @classmethod
    def build(cls, items: list[tuple[int | None, list[int]]], weights: np.ndarray) -> "ItemTree":
        heaviest = lambda item: sorted(item[1], key=lambda t: (-weights[t], t))[:4]
        items = sorted(items, key=lambda item: (heaviest(item), item[0] is None, item[0] or 0))
        sets = [np.array(sorted(terms), dtype=np.int64) for _, terms in items]
        levels = []
        first = np.arange(len(sets))
        while True:
            levels.append(Level(np.concatenate(sets), np.array([len(s) for s in sets]), first))
            if len(sets) <= 1:
                return cls([i for i, _ in items], weights, levels)
            first = np.arange(0, len(sets), FAN)
            sets = [np.unique(np.concatenate(sets[i : i + FAN])) for i in first]


def _merged(nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parent of (terms, values, least id) nodes: largest values, smallest id."""
    terms, place = np.unique(np.concatenate([n[0] for n in nodes]), return_inverse=True)
    values = np.zeros(len(terms), dtype=np.int64)
    np.maximum.at(values, place, np.concatenate([n[1] for n in nodes]))
    return terms, values, min(n[2] for n in nodes)


class Search:
    """The best documents of all items of a tree among the leaves that ``add`` is given, a batch at a time."""

    def __init__(self, tree: ItemTree, top: int, floors: np.ndarray):
        self.tree, self.top, self.floors = tree, top, floors
        n = len(tree.item_ids)
        # The weakest entry that still counts: a score, and among equal scores the largest id.
        self.weak = np.maximum(floors, 1)
        self.weak_id = np.full(n, np.iinfo(np.int64).max)
        self.best: list[list[tuple[int, bool, int]]] = [[] for _ in range(n)]
        self.dense = np.zeros(len(tree.weights), dtype=np.int64)
        self.place = np.zeros(len(tree.weights), dtype=np.int64)
        self.pairs = 0

    def reached(self, terms: np.ndarray, values: np.ndarray, least_id: int, wanted: np.ndarray) -> np.ndarray:
        """The items of ``wanted`` that a document below the node could serve, found from the item tree's root down."""
        levels = self.tree.levels
        weakest, asked = [self.weak], [wanted]
        for level in levels[1:]:
            weakest.append(np.minimum.reduceat(np.where(asked[-1], weakest[-1], np.iinfo(np.int64).max), level.first))
            asked.append(np.logical_or.reduceat(asked[-1], level.first))
        self.dense[terms] = values
        nodes = np.zeros(1, dtype=np.int64)
        for height in range(len(levels) - 1, -1, -1):
            nodes = nodes[asked[height][nodes]]
            bound = levels[height].bounds(self.dense, nodes)
            if height:
                nodes = nodes[bound >= weakest[height][nodes]]
                last = len(levels[height - 1].sizes)
                nodes = (levels[height].first[nodes][:, None] + np.arange(FAN)).ravel()
                nodes = nodes[nodes < last]
            else:
                nodes = nodes[(bound > self.weak[nodes]) | ((bound == self.weak[nodes]) & (least_id <= self.weak_id[nodes]))]
        self.dense[terms] = 0
        return nodes

    def leaf(self, leaf: dict, items: np.ndarray) -> None:
        """Exact scores of all documents of a leaf for ``items``."""
        terms = leaf["top_terms"]
        self.place[terms] = np.arange(1, len(terms) + 1)
        rows = np.repeat(np.arange(len(leaf["sizes"])), leaf["sizes"])
        shares = np.zeros((len(leaf["sizes"]), len(terms) + 1), dtype=np.int64)
        shares[rows, self.place[leaf["terms"]]] = leaf["shares"]
        own = self.tree.levels[0]
        sizes = own.sizes[items]
        columns = self.place[own.terms[_segments(own.starts[items], sizes)]]
        scores = _sums(shares[:, columns], sizes)
        self.place[terms] = 0
        self.pairs += scores.size
        for column, item in enumerate(items.tolist()):
            for row in np.flatnonzero(scores[:, column] >= self.weak[item]).tolist():
                self.offer(item, int(scores[row, column]), leaf["ids"][row])

    def offer(self, item: int, score: int, doc_id: int | None) -> None:
        best = self.best[item]
        best.append((-score, doc_id is None, doc_id or 0))
        if len(best) >= self.top:
            best.sort()
            del best[self.top :]
            self.weak[item] = -best[-1][0]
            self.weak_id[item] = np.iinfo(np.int64).max if best[-1][1] else best[-1][2]

    def add(self, leaves: list[dict]) -> None:
        """Searches a document tree over ``leaves``, nodes with larger coordinates first."""
        level = [(leaf["top_terms"], leaf["top_values"], leaf["least_id"]) for leaf in leaves]
        levels = [level]
        while len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([_merged(below[i : i + FAN]) for i in range(0, len(below), FAN)])
        waiting = [(len(levels) - 1, 0, np.ones(len(self.tree.item_ids), dtype=bool))]
        while waiting:
            height, number, wanted = waiting.pop()
            items = self.reached(*levels[height][number], wanted)
            if not len(items):
                continue
            if height == 0:
                self.leaf(leaves[number], items)
                continue
            wanted = np.zeros(len(wanted), dtype=bool)
            wanted[items] = True
            children = range(number * FAN, min(len(levels[height - 1]), number * FAN + FAN))
            waiting += [(height - 1, c, wanted) for c in sorted(children, key=lambda c: levels[height - 1][c][1].sum())]

    def found(self) -> Iterator[tuple[int, int | None, int | None, int]]:
        for item, best in enumerate(self.best):
            for score, missing, doc_id in best:
                yield item, self.tree.item_ids[item], None if missing else doc_id, -score


def _rows(column: pa.Array) -> list[np.ndarray]:
    flat, bounds = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    bounds = bounds - bounds[0]
    return [flat[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]


def _leaves_of(batch: pa.RecordBatch) -> list[dict]:
    columns = {name: _rows(batch.column(name)) for name in ("top_terms", "top_values", "sizes", "terms", "shares")}
    leaves = [dict(zip(columns, values)) for values in zip(*columns.values())]
    for leaf, ids in zip(leaves, batch.column("ids").to_pylist()):
        given = [i for i in ids if i is not None]
        leaf.update(ids=ids, least_id=min(given) if given else np.iinfo(np.int64).max)
    return leaves


def leaf_table(counted: DataFrame, weights: np.ndarray, documents: int, total_terms: int) -> DataFrame:
    """Documents with their shares of a score, in leaves of those that have the same heaviest terms."""
    shared = counted.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, number = shared.value, TaskContext.get().partitionId() << 32
        for batch in batches:
            batch = batch.filter(pa.array(pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False) > 0))
            for start in range(0, batch.num_rows, BATCH_DOCS):
                part = batch.slice(start, BATCH_DOCS)
                sizes = pc.list_value_length(part.column("terms")).to_numpy().astype(np.int64)
                terms = part.column("terms").flatten().to_numpy().astype(np.int64)
                tf = part.column("counts").flatten().to_numpy().astype(np.int64)
                m = 10 + (90 * part.column("n").to_numpy() * documents) // total_terms
                share = weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, sizes)))
                row = np.repeat(np.arange(len(sizes)), sizes)
                by_weight = np.lexsort((terms, -share, row))
                begin = np.cumsum(sizes) - sizes
                first = terms[by_weight[begin]]
                second = np.where(sizes > 1, terms[by_weight[np.minimum(begin + 1, len(terms) - 1)]], -1)
                order = np.lexsort((second, first))
                ids = part.column("doc_id").to_pylist()
                rows = []
                for at in range(0, len(order), LEAF_DOCS):
                    held = order[at : at + LEAF_DOCS]
                    spots = _segments(begin[held], sizes[held])
                    top, place = np.unique(terms[spots], return_inverse=True)
                    largest = np.zeros(len(top), dtype=np.int64)
                    np.maximum.at(largest, place, share[spots])
                    rows.append((number, top, largest, [ids[i] for i in held], sizes[held], terms[spots], share[spots]))
                    number += 1
                kinds = [pa.int64(), *map(pa.list_, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))]
                names = [c.split(" ")[0] for c in _LEAF.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(list(column), kind) for column, kind in zip(zip(*rows), kinds)], names=names)

    return counted.mapInArrow(run, _LEAF)


def _likely_leaves(leaves: DataFrame, tree) -> DataFrame:
    """(leaf): for every item the leaves with the largest bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, dense = tree.value.levels[0], np.zeros(len(tree.value.weights), dtype=np.int64)
        every = np.arange(len(level.sizes))
        best = np.zeros((SEED_LEAVES + 1, len(every)), dtype=np.int64)
        which = np.full((SEED_LEAVES + 1, len(every)), -1, dtype=np.int64)
        for batch in batches:
            for leaf, terms, values in zip(batch.column(0).to_pylist(), _rows(batch.column(1)), _rows(batch.column(2))):
                dense[terms] = values
                best[-1], which[-1] = level.bounds(dense, every), leaf
                dense[terms] = 0
                order = np.argsort(-best, axis=0, kind="stable")
                best, which = np.take_along_axis(best, order, 0), np.take_along_axis(which, order, 0)
        rows = np.flatnonzero(best[:-1].ravel() > 0)
        columns = [np.tile(every, SEED_LEAVES)[rows], which[:-1].ravel()[rows], best[:-1].ravel()[rows]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "leaf", "bound"])

    bounds = leaves.select("leaf", "top_terms", "top_values").mapInArrow(run, "item long, leaf long, bound long")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "leaf")
    return bounds.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SEED_LEAVES).select("leaf").distinct()


def _searched(leaves: DataFrame, tree, top: int, floors: np.ndarray) -> DataFrame:
    """(item, item_id, doc_id, score): the best documents of every item in each task's leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(tree.value, top, floors)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_DOCS // LEAF_DOCS):
                search.add(_leaves_of(batch.slice(start, BATCH_DOCS // LEAF_DOCS)))
        rows = list(zip(*search.found())) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in rows], names=["item", "item_id", "doc_id", "score"])

    return leaves.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def item_blocks(items: DataFrame, block_terms: int) -> list[list[tuple[int | None, list[str]]]] | Iterator:
    """The distinct (id, terms) of ``items`` in blocks of at most ``block_terms`` terms (or of one item)."""
    stored = written(items.filter(F.size("terms") > 0).distinct(), "items")
    key = F.xxhash64("item_id", "terms")
    blocks = max(1, -(-(stored.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms))
    while True:
        sizes = stored.groupBy(F.pmod(key, F.lit(blocks)).alias("block")).agg(F.sum(F.size("terms")).alias("n"), F.count_distinct(key).alias("items"))
        if sizes.filter((F.col("n") > block_terms) & (F.col("items") > 1)).isEmpty():
            break
        blocks *= 2
    for block in range(blocks):
        rows = stored.filter(F.pmod(key, F.lit(blocks)) == block).collect()
        if rows:
            yield [(r["item_id"], r["terms"]) for r in rows]


def ranked_documents(
    docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS, id_column: str = "doc_id", text_column: str = "text",
    item_id_column: str = "item_id", item_text_column: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` highest-scoring documents of each item, by falling score and rising id.

    Null and empty texts have no terms: such items get no rows, such documents are not counted. Every row of
    ``docs`` is a document of its own, also where ids or texts repeat; null ids come last among equal scores. Items
    equal in id and terms count once; items with the same id and other terms are ranked apart under that id.
    Other columns are not looked at. Without items or documents there are no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    words = F.split(F.translate(F.col(item_text_column), UPPER, LOWER), BETWEEN)
    asked = items.select(F.col(item_id_column).cast("long").alias("item_id"), F.array_sort(F.array_distinct(F.filter(words, lambda w: w != ""))).alias("terms"))
    results = None
    for block in item_blocks(asked, block_terms):
        vocabulary = sorted({term for _, terms in block for term in terms})
        number = {term: i for i, term in enumerate(vocabulary)}
        counted = written(counted_documents(texts, vocabulary), "counted")
        documents, total_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequency = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # a row per term of the block
        df = np.zeros(len(vocabulary), dtype=np.int64)
        for term, n in frequency:
            df[term] = n
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], dtype=np.int64)
        tree = spark.sparkContext.broadcast(ItemTree.build([(i, [number[t] for t in terms]) for i, terms in block], weights))
        leaves = written(leaf_table(counted, weights, documents, max(1, total_terms)), "leaves")
        with small_batches(spark):
            likely = written(_likely_leaves(leaves, tree), "likely")  # at most SEED_LEAVES rows an item of the block
            none = np.zeros(len(block), dtype=np.int64)
            first = _ranked(_searched(leaves.join(F.broadcast(likely), "leaf", "left_semi"), tree, top, none), top)
            floors = none.copy()
            for item, score in first.filter(F.col("rank") == top).select("item", "score").collect():
                floors[item] = score
            best = written(_ranked(_searched(leaves, tree, top, floors), top), "ranked")
        ranked = best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        results = ranked if results is None else results.unionByName(ranked)
    return results if results is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH held AS (
    SELECT doc_id, row_number() OVER () AS row, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '{term}')) AS term FROM documents
),
tf AS (SELECT doc_id, row, term, count(*) AS tf FROM held GROUP BY ALL),
sizes AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY row),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM tf, whole GROUP BY term
),
asked AS (
    SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, '{upper}', '{lower}'), '{term}'))) AS term FROM benchmark
),
scores AS (
    SELECT item_id, doc_id, row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
    FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (row), whole
    GROUP BY ALL HAVING score > 0
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores QUALIFY rank <= 10
""".replace("{upper}", UPPER).replace("{lower}", LOWER).replace("{term}", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
