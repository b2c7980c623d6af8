"""Ranked lexical search against brute force, and what the trees leave out."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docweave.llm import ranked_search as rs

TERM = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in TERM.findall(text or "")]


def ranked_by_hand(docs, items, top=10):
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    count, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item_id, terms in {(i, tuple(sorted(set(terms_of(t))))) for i, t in items}:
        scores = []
        for doc_id, bag in bags:
            m = 10 + (90 * sum(bag.values()) * count) // total
            score = sum(
                math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in terms if t in bag
            )
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, doc_id, -score) for rank, (score, _, _, doc_id) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def found_by_spark(spark, docs, items, **options):
    docs_df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, item_id int, score int").repartition(5)
    items_df = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, doc_id int")
    return sorted((tuple(r) for r in rs.ranked_documents(docs_df, items_df, **options).collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["É", "ñandú", "Straße", "x1", "数据"]
    weight = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(draw.choices(words, weight, k=draw.randint(1, 80)))) for i in range(700)]
    docs += [(1000 + i, docs[3][1]) for i in range(60)]  # copies, so that ties go by id
    docs += [(None, docs[3][1]), (3, docs[4][1]), (3, docs[4][1]), (2000, None), (2001, ""), (2002, "--- !!\x00"), (2003, "w1 " * 50_000)]
    items = [(i, ", ".join(draw.choices(words, weight, k=draw.randint(1, 25))).upper()) for i in range(40)]
    items += [(50, docs[3][1]), (51, "unheard of"), (52, None), (53, "?!"), (50, docs[4][1]), (None, "w5 w6"), (54, "w7 w8"), (54, "W8-w7")]
    return docs, items


@pytest.mark.parametrize("block_terms", [rs.BLOCK_TERMS, 120])
def test_ranks_equal_brute_force(spark, corpus, block_terms):
    docs, items = corpus
    expected = ranked_by_hand(docs, items)
    assert found_by_spark(spark, docs, items, block_terms=block_terms) == expected and len(expected) > 400


def test_empty_tables(spark, corpus):
    docs, items = corpus
    assert found_by_spark(spark, [], items) == [] == found_by_spark(spark, docs[:50], []) == found_by_spark(spark, [(1, None)], items)


def test_terms_are_runs_of_letters_digits_and_wide_characters():
    texts = ["Aé_b9 İ-ſ", None, "", "a" * 70_000 + " b", "x\x00y"]
    vocabulary = ["aé", "b9", "İ", "ſ", "b", "x", "y"]
    padded = pa.array(["skipped"] + texts).slice(1)
    totals, row, term, count = rs.term_counts(padded, pa.array(vocabulary, pa.large_string()))
    assert totals.tolist() == [len(terms_of(t)) for t in texts]
    held = {(r, vocabulary[t]): c for r, t, c in zip(row.tolist(), term.tolist(), count.tolist())}
    assert held == {(0, "aé"): 1, (0, "b9"): 1, (0, "İ"): 1, (0, "ſ"): 1, (3, "b"): 1, (4, "x"): 1, (4, "y"): 1}


def test_whole_batches_are_left_out():
    """Most pairs of an item and a document are never scored, and the best are those of scoring all."""
    draw = np.random.default_rng(3)
    weights = np.sort(draw.integers(1, 9000, 600))
    topical = lambda: set((10 * draw.integers(0, 60) + draw.integers(0, 10, 6)).tolist()) | set(draw.integers(0, 20, 3).tolist())
    items = [(i, sorted(topical())) for i in range(90)]
    tree = rs.ItemTree.build(items, weights)
    docs = [(d, {int(t): int(weights[t] * draw.integers(1, 50)) for t in topical()}) for d in range(3000)]
    docs.sort(key=lambda d: max(d[1], key=d[1].get))
    leaves = []
    for at in range(0, len(docs), rs.LEAF_DOCS):
        held = docs[at : at + rs.LEAF_DOCS]
        top = {}
        for _, shares in held:
            for t, v in shares.items():
                top[t] = max(top.get(t, 0), v)
        leaves.append(
            {
                "top_terms": np.array(sorted(top)), "top_values": np.array([top[t] for t in sorted(top)]), "ids": [i for i, _ in held],
                "least_id": min(i for i, _ in held), "sizes": np.array([len(s) for _, s in held]),
                "terms": np.array([t for _, s in held for t in s]), "shares": np.array([v for _, s in held for v in s.values()]),
            }
        )
    search = rs.Search(tree, 10, np.zeros(len(items), dtype=np.int64))
    search.add(leaves)
    floors = np.array([-best[-1][0] if len(best) == 10 else 0 for best in search.best])
    again = rs.Search(tree, 10, floors)
    again.add(leaves)
    expected = []
    for item_id, terms in items:
        scores = sorted((-sum(s.get(t, 0) for t in terms), i) for i, s in docs)
        expected += [(item_id, i, -s) for s, i in scores[:10] if s < 0]
    assert sorted((i, d, s) for _, i, d, s in search.found()) == sorted(expected)
    assert sorted(again.found()) == sorted(search.found())
    assert search.pairs < 0.7 * len(docs) * len(items) and again.pairs < 0.15 * len(docs) * len(items)
