"""Every registered operator query on the smallest tables: its columns, their types, and one row per document where it says so."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from docweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op3_sharding": "doc_id:bigint size:bigint text_crc32:bigint law:string shard:int slot:bigint grown_shard:int",
    "op4_toxicity": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op5_pii": "doc_id:bigint n_email:bigint n_ip:bigint n_card:bigint n_phone:bigint base_sha256:string spans:string",
    "op6_sentencepiece": "doc_id:bigint n_tokens:bigint ids_sha256:string decoded_sha256:string",
    "op7_nearest_neighbours": "query_id:bigint rank:int vec_id:bigint score:double",
    "op9_language_id": "doc_id:bigint held_out:boolean lang_pred:string score:double",
    "op10_token_files": "doc_id:bigint start:bigint n_tokens:bigint ids_crc32:bigint",
    "op11_line_quality": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op12_whitening": "vec_id:bigint component:int n:bigint deviation:bigint whitened:double explained:double identity_error:double",
    "op13_ranked_search": "item_id:bigint rank:int doc_id:bigint score:bigint",
}
PER_DOCUMENT = [n for n, c in COLUMNS.items() if c.startswith("doc_id")]


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, documents, name):
    found = QUERIES[name](spark, SF)
    types = dict(found.dtypes)
    assert {c: types[c] for c in (p.split(":")[0] for p in COLUMNS[name].split())} == dict(p.split(":") for p in COLUMNS[name].split())
    rows = found.collect()
    if name in PER_DOCUMENT:
        assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    if "score" in types and types["score"] == "double" and name != "op7_nearest_neighbours":
        assert all(0 <= r["score"] <= 1 for r in rows)
    if "predicted" in types:
        assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)
    if "held_out" in types:
        parts, kept = (5, 0) if name == "op11_line_quality" else (4, 2)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == kept) for r in rows)
    if name == "op3_sharding":
        assert all(r["size"] == len(documents[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(documents[r["doc_id"]].encode()) for r in rows)
    if name == "op6_sentencepiece":
        import public_tokenizers
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
        for r in rows[:40]:
            ids = library.encode(documents[r["doc_id"]], add_eos=True)
            assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    if name == "op10_token_files":
        ordered = sorted(rows, key=lambda r: r["doc_id"])
        assert [r["start"] for r in ordered] == [sum(x["n_tokens"] for x in ordered[:i]) for i in range(len(ordered))]
    if name == "op12_whitening":
        assert {r["component"] for r in rows} == {1, 2, 3, 4} and rows[0]["identity_error"] < 1e-4
        by_component = found.groupBy("component").agg(F.avg("whitened").alias("mean"), F.first("explained").alias("e")).orderBy("component").collect()
        assert all(abs(r["mean"]) < 1e-6 for r in by_component) and [r["e"] for r in by_component] == sorted((r["e"] for r in by_component), reverse=True)
    if name in ("op7_nearest_neighbours", "op13_ranked_search"):
        first = "query_id" if name.startswith("op7") else "item_id"
        ranks = {}
        for r in rows:
            ranks.setdefault(r[first], []).append(r["rank"])
        assert all(sorted(v) == list(range(1, len(v) + 1)) for v in ranks.values())
