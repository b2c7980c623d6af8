"""Operators over single texts, on small tables and against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docweave.llm import language_id, masked_lm, pii, piece_codec, token_files, toxicity
from docweave.llm.common import held_out, work_folder

# Nulls, empty and very long texts, repeated rows, repeated and missing ids, odd white space.
ROWS = [
    (1, "plain words here"), (2, None), (3, ""), (4, "   "), (None, "no id"), (5, "twice"), (5, "twice"), (5, "other text"),
    (6, "word " * 30_000), (7, "line\nbreaks  and\ttabs \n x"), (8, "日本語 😀 ñandú"), (9, "<|endoftext|> <s>"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in ROWS]
    # Columns whose names operators use themselves.
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, score int")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def odd_texts(count=400):
    draw = random.Random(3)
    return ["".join(draw.choice("ab  \n.,é😀<>/0\t|▁") for _ in range(draw.randint(0, 40))) for _ in range(count)]


def test_word_ids_equal_the_librarys():
    own = token_files.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = odd_texts() + [t or "" for _, t in ROWS] + ["a" * 5000, "the.\nThe end,"]
    expected = own.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, dtype=own.width).tolist() for x in own.encode(texts)] == [e.ids for e in expected]


def test_runs_of_line_feeds_equal_the_librarys():
    own = token_files.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [f"{a}{chr(10) * n}{b}" for n in range(1, 6) for a in ("", "a", "the end.", "two words") for b in ("", "b", "The end,", "b\nc")]
    expected = own.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, dtype=own.width).tolist() for x in own.encode(texts)] == [e.ids for e in expected]


def test_kept_words_are_bounded(monkeypatch):
    own = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(token_files.Words, "CACHE_WORDS", 50)
    texts = [f"Line{i}\nNext{i} word{i}, {'x' * 300}{i} end{i}." for i in range(500)]
    expected = own.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, dtype=own.width).tolist() for x in own.encode(texts)] == [e.ids for e in expected]
    caches = [x for x in vars(own).values() if isinstance(x, dict)]
    held = [w for cache in caches for w in [*cache, *cache.old]]
    assert held and len(held) <= 100 and max(map(len, held)) < 100


def test_a_word_is_merged_once_whatever_signs_follow(monkeypatch):
    own = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    signs = ["", ".", ",", "!!!", "%%%", "...", '")', "'", "<|endoftext|>", "|>"]
    texts = [f"{word}{end} {word}{end}\n{word}{end}" for word in ("word", "été", "it's", "a-b", "3") for end in signs]
    expected = own.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, dtype=own.width).tolist() for x in own.encode(texts)] == [e.ids for e in expected]
    library, asked = token_files.Encoder.ids, []
    monkeypatch.setattr(token_files.Encoder, "ids", lambda self, text: asked.append(text) or library(self, text))
    own = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode([f"the word{end} été{end}" for end in signs if "|" not in end])
    assert not [text for text in asked if any(c.isalpha() for c in text)]


def test_records_packed_together_equal_single_ones():
    draw = np.random.default_rng(5)
    ranks = [(draw.integers(0, 2**32, n) >> draw.integers(0, 32, n)).astype("<u4") for n in (1, 0, 4, 7, 300, 0, 2)]
    counts = np.array([len(x) for x in ranks])
    control, data, sizes = token_files.pack_records(np.concatenate(ranks), counts)
    single = [token_files.pack(x) for x in ranks]
    assert control.tolist() == np.concatenate([c for c, _ in single]).tolist()
    assert data.tolist() == np.concatenate([d for _, d in single]).tolist() and sizes.tolist() == [len(d) for _, d in single]
    assert token_files.unpack_records(control, data, counts).tolist() == np.concatenate(ranks).tolist()


def test_packed_ranks_round_trip():
    ranks = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7], dtype="<u4")
    for n in range(len(ranks) + 1):
        control, data = token_files.pack(ranks[:n])
        assert len(control) == -(-n // 4) and token_files.unpack(control, data, n).tolist() == ranks[:n].tolist()


def test_token_files_round_trip(spark, docs):
    folder = work_folder(spark, "files")
    token_files.write_corpus(docs, folder, file_bytes=2_000)
    rows = sorted(token_files.read_corpus(spark, folder).collect(), key=lambda r: r["start"])
    ordered = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    encoded = token_files.encoder(public_tokenizers.path("byte_bpe_50k.json")).tokenizer.encode_batch([t or "" for _, t in ordered], add_special_tokens=False)
    ids = [e.ids + [2] for e in encoded]
    assert [r["doc_id"] for r in rows] == [i for i, _ in ordered]
    assert [np.frombuffer(r["ids"], dtype="<u4").tolist() for r in rows] == ids
    assert [r["start"] for r in rows] == np.cumsum([0, *map(len, ids[:-1])]).tolist()
    files = spark.read.parquet(f"{folder}/files")
    assert files.count() > 1 and files.agg(F.sum("documents")).first()[0] == len(ROWS)
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()
    assert [r["n"] for r in ranks] == sorted((r["n"] for r in ranks), reverse=True)


def test_token_files_of_an_empty_table(spark):
    folder = work_folder(spark, "files")
    token_files.write_corpus(empty(spark), folder)
    assert token_files.read_corpus(spark, folder).count() == 0


def test_merges_equal_the_librarys():
    codec = piece_codec.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    texts = odd_texts() + [t or "" for _, t in ROWS] + ["a" * 4000, " " * 300]
    assert [x.tolist() for x in codec.encode(texts)] == codec.library.encode(texts)
    codec.check()
    codec.words.unchecked.append(("▁word", [1, 2]))
    with pytest.raises(ValueError):
        codec.check()


def test_pieces_of_every_row(spark, docs):
    library = piece_codec.codec(public_tokenizers.path("piece_bpe_32k.model")).library
    rows = piece_codec.encode_decode(docs).collect()
    assert len(rows) == len(ROWS) and rows[0].asDict().keys() == {"doc_id", "n_tokens", "ids", "decoded"}
    expected = sorted((str(i), library.encode(t or "", add_eos=True)) for i, t in ROWS)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in rows) == expected
    assert all(r["decoded"] == library.decode(r["ids"]) and r["n_tokens"] == len(r["ids"]) for r in rows)
    digest = {r["doc_id"]: r["ids_sha256"] for r in piece_codec.encode_decode(docs, digests=True).collect()}
    assert digest[2] == hashlib.sha256(b"2").hexdigest()
    assert piece_codec.encode_decode(empty(spark)).count() == 0


def test_restored_words():
    text = "idiot stupid worthless and the other words of a corpus that is not empty " * 50
    counts = np.zeros((27, 27, 27))
    codes = toxicity._latin_codes()[np.frombuffer(text.encode("latin-1"), dtype=np.uint8)]
    np.add.at(counts, (codes[:-2], codes[1:-1], codes[2:]), 1)
    model = toxicity.language_model(counts)
    for disguised, word in (("1d10t", "idiot"), ("stuuuupid", "stupid"), ("w0rthle$$", "worthless"), ("idi0t", "idiot"), ("idiot", "idiot")):
        assert toxicity.decode(disguised, model) == word
    scorer = toxicity.ToxicityModel(model, {"idiot.": 5.0}, 2.0, -2.0)
    plain, hidden = scorer.score("an idiot here"), [scorer.score(t) for t in ("an 1d10t here", "an i d i o t here", "IDIOT!!", "an i.d.i.o.t")]
    assert hidden == [plain] * 4 and plain > 0.5 > scorer.score("nothing here") == scorer.score(None) == scorer.score("")


def test_toxicity_learns_and_holds_out(spark):
    draw = random.Random(5)
    words = ["".join(draw.choice("bcdfghlmnprst") + draw.choice("aeiou") for _ in range(3)) for _ in range(300)]
    rows, marks = [], []
    for i in range(600):
        bad = i % 5 == 0
        text = [draw.choice(words) for _ in range(60)] + (["grobian" + draw.choice(["", "e", "er"])] if bad else [])
        rows.append((i, " ".join(text)))
        marks.append((i, int(bad)))
    docs = spark.createDataFrame(rows + [(None, "x"), (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame(marks + [(None, 1), (7000, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scored = docs.select("doc_id", toxicity.toxicity(docs, model).alias("s")).collect()
    apart = {r["doc_id"]: r["s"] for r in scored if r["doc_id"] is not None and r["doc_id"] < 600 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert len(apart) > 100 and all((s >= toxicity.THRESHOLD) == (i % 5 == 0) for i, s in apart.items())
    assert all(0 <= r["s"] <= 1 for r in scored) and len(scored) == 603
    none = toxicity.fit(docs.limit(0), labels.limit(0))
    assert none.weights == {} and none.score("x") < toxicity.THRESHOLD


def test_held_out_rows(spark):
    ids = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in ids)


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 12, 40):
        words = language_id.codewords(n)
        assert len({tuple(w) for w in words}) == n and set(np.unique(words)) <= {-1.0, 1.0}
        assert (np.abs(words.sum(axis=0)) < n).all()


def test_languages(spark):
    draw = random.Random(2)
    stems = {"aa": ["kata", "makka", "tak"], "bb": ["sch", "licht", "ein"], "cc": ["ouv", "eau", "elle"]}
    rows = [(i, " ".join(draw.choice(stems[lang]) for _ in range(20)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 100)]
    docs = spark.createDataFrame(rows + [(900, None, "aa"), (901, "12 34 !", "bb"), (902, "", None), (None, "kata", "aa"), (903, "kata tak makka", None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    found = {r["doc_id"]: r["f"] for r in docs.select("doc_id", language_id.language(docs, model).alias("f")).collect()}
    assert all(found[i]["lang"] == lang and found[i]["score"] > 0.5 for i, _, lang in rows)
    assert [found[i]["lang"] for i in (900, 901, 902, None, 903)] == ["und", "und", "und", "aa", "aa"] and found[900]["score"] == 0
    assert language_id.fit(empty(spark)).predict("text") == ("und", 0.0, True)


def test_pseudo_likelihood_prefers_the_corpus_order(spark):
    draw = random.Random(4)
    pairs = [("red", "apple"), ("blue", "sky"), ("old", "stone"), ("wet", "dog")]
    texts = [" ".join(w for _ in range(80) for w in draw.choice(pairs)) for _ in range(120)]
    mixed = texts[0].split()
    draw.shuffle(mixed)
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(texts)] + [(900, None, 0.0), (901, "  ", 0.0), (902, " ".join(mixed), 0.0), (None, "red apple", 0.0)], "doc_id long, text string, n_tokens double")
    rows = {r["doc_id"]: r for r in masked_lm.score_documents(docs).collect()}
    assert len(rows) == 124 and rows[0]["n_tokens"] == 160
    assert rows[0]["mean_log_likelihood"] > rows[902]["mean_log_likelihood"] + 0.5
    assert rows[900]["n_tokens"] == rows[901]["n_tokens"] == 0 and rows[900]["mean_log_likelihood"] is None
    assert rows[0]["log_likelihood"] == pytest.approx(160 * rows[0]["mean_log_likelihood"])


def test_texts_are_split_into_tokens_once(spark):
    mark = "ſplit-once"
    docs = spark.createDataFrame([(i, f"{mark} red apple {i}") for i in range(6)], "doc_id long, text string").repartition(3)
    seen = masked_lm.Vocabulary({"red": 0, "apple": 1}, np.zeros(masked_lm.CLASSES), np.full((256, 256), -1.0))
    split = masked_lm.classified(docs, seen).select("doc_id", "_split.*").collect()
    assert all(len(r["classes"]) == 4 and list(r["classes"])[1:3] == [0, 1] for r in split)
    spelled = [mark, "0"]
    expected = sum(-float(len(w.lower().encode()) + 1) + np.log(masked_lm.OTHER_CLASSES) for w in spelled)
    assert all(r["within"] == pytest.approx(expected) for r in split)
    # Training and scores read the table of classes, not the texts.
    plan = masked_lm.score_documents(docs)._jdf.queryExecution().toString()
    assert "classes" in plan and "text" not in plan.split("Physical Plan")[1]


def test_every_word_has_its_share_of_the_corpus(spark):
    draw = random.Random(6)
    texts = [None, "  ", "red\u00a0fox Red\x1ffox rare", "red fox fox other other", "red rest"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counted = masked_lm.word_counts(docs)
    counts = collections.Counter(w for t in texts for w in (t or "").lower().split())
    assert {r["word"]: r["n"] for r in counted.collect()} == counts
    vocabulary = masked_lm.Vocabulary({"red": 0}, np.zeros(masked_lm.CLASSES), np.log(np.linspace(0.01, 0.4, 1 << 16)).reshape(256, 256))
    split = masked_lm.classified(docs, vocabulary).select(F.monotonically_increasing_id().alias("row"), "text", "_split.*").localCheckpoint()
    sums, within = masked_lm.word_shares(split, counted, vocabulary)
    others = sum(n for w, n in counts.items() if w != "red")
    alone = {w for w, n in counts.items() if any((t or "").lower().split().count(w) == n for t in texts)}
    own_share = sum(counts[w] for w in alone) / others

    def share(word):
        return np.log(own_share) + vocabulary.classify([word])[1][0] if word in alone else np.log(counts[word] * masked_lm.OTHER_CLASSES / others)

    for r in split.join(sums, "row", "left").select("text", within.alias("found")).collect():
        assert r["found"] == pytest.approx(sum(share(w) for w in (r["text"] or "").lower().split() if w != "red"))
    # Rare words that two documents have are likelier than those of one.
    word = lambda: "".join(draw.choices("abcdefghijklmnop", k=8))
    fill = [f"f{n:03}" for n in range(masked_lm.WORDS)]
    made = [" ".join(draw.choices(fill, k=30) + [word() for _ in range(10)]) for _ in range(40)]
    rows = masked_lm.score_documents(spark.createDataFrame(list(enumerate(made + made[:20])), "doc_id long, text string")).collect()
    mean = {r["doc_id"]: r["mean_log_likelihood"] for r in rows}
    assert min(mean[i] for i in range(20)) > max(mean[i] for i in range(20, 40)) + 0.5


def test_each_token_is_scored_from_both_sides():
    network = masked_lm.Network()
    context, target = masked_lm.windows([np.array([5, 6, 7]), np.array([8])])
    edge = masked_lm.EDGE
    assert target.tolist() == [5, 6, 7, 8]
    assert context.T.tolist() == [[edge, edge, 6, 7], [edge, 5, 7, edge], [5, 6, edge, edge], [edge, edge, edge, edge]]
    assert np.allclose(np.exp(network.forward(context)[1]).sum(axis=1), 1.0, atol=1e-4)


TEXTS = [
    "write a.b+c@mail-1.example.org, or x@y. a@b.co@d.io 😀 u@v.w", "ip 10.0.0.255 and 256.1.1.1 and 1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111, 4111-1111-1111-1112",
    "call +49 (30) 123.456-78 or +1 2 or +123456789012345678", "", None, "@" * 3000, "1 " * 4000, "a." * 3000 + "@b", "+1" + "-" * 3000, "ñ@ñ.com é a@b.c",
]


def test_entities_equal_the_plain_patterns(spark):
    import re

    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(digits):
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0

    def valid(kind, value):
        digits = re.sub("[^0-9]", "", value)
        return {
            "email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in value.split(".")),
            "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
        }[kind]

    draw = random.Random(8)
    texts = TEXTS + ["".join(draw.choice("a1.@+- 45x0") for _ in range(60)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("t", pii.entity_spans(F.col("t")).alias("s")).collect():
        text = r["t"] or ""
        expected = [(k, m.start(), m.end(), m.group()) for k in plain for m in re.finditer(plain[k], text) if valid(k, m.group())]
        assert [tuple(s) for s in r["s"]] == expected


def test_disclosing_terms_and_clean_text(spark):
    draw = random.Random(9)
    noise = ["".join(draw.choice("bdfgklmnprst") + draw.choice("aeiou") for _ in range(3)) for _ in range(400)]
    rows = [(i, " ".join(draw.choice(noise) for _ in range(60))) for i in range(80)]
    rows += [(100 + i, " ".join([draw.choice(noise) for _ in range(30)] + ["Zanzibar", "writes", "zed@example.org"])) for i in range(5)]
    docs = spark.createDataFrame([*rows, (200, None), (201, "Zanzibar alone"), (None, "+49 30 1234567")], "doc_id long, text string")
    found = pii.private_spans(docs.withColumn("pii_base", F.lit(1)))
    clean = {r["doc_id"]: r for r in found.select("doc_id", "text", "pii_terms", pii.sanitised(F.col("text"), F.concat("pii_base", "pii_terms")).alias("c")).collect()}
    assert len(clean) == 88
    for i in range(5):
        terms = [s for s in clean[100 + i]["pii_terms"]]
        words = {clean[100 + i]["text"][s["start"] : s["end"]] for s in terms}
        assert {"Zanzibar", "writes"} <= words and "[EMAIL]" in clean[100 + i]["c"] and "zed" not in clean[100 + i]["c"]
        assert "Zanzibar" not in clean[100 + i]["c"]
    # Away from the entity a term gives nothing away.
    assert clean[201]["c"] == "Zanzibar alone" and clean[None]["c"] == "[PHONE]" and clean[200]["c"] is None and clean[0]["c"] == rows[0][1]
    assert pii.private_spans(docs.limit(0)).count() == 0


def test_terms_beside_an_entity_of_one_text(spark):
    draw = random.Random(12)
    noise = ["".join(draw.choice("bdfgklmnprst") + draw.choice("aeiou") for _ in range(3)) for _ in range(100)]
    plain = lambda n: [draw.choice(noise) for _ in range(n)]
    far = " ".join([*plain(60), "Quux"])
    rows = [(i, " ".join(plain(60))) for i in range(120)]
    rows += [(200, f"{far} {' '.join(plain(40))} contact Wu of Zanzibar, acct4711 or 90210, at one@example.org {' '.join(plain(40))}")]
    rows += [(201 + i, f"contact {' '.join(plain(30))} user{i}@example.org") for i in range(20)]
    found = pii.private_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    spans = {r["doc_id"]: {r["text"][s["start"] : s["end"]] for s in r["pii_terms"]} for r in found.collect()}
    assert {"Wu", "Zanzibar", "acct4711", "90210"} <= spans[200]
    # Neither far words nor those of many texts give the entity away.
    assert not {"Quux", "contact"} & spans[200] and not any(spans[i] for i in range(120))
    (clean,) = found.filter("doc_id = 200").select(pii.sanitised(F.col("text"), F.concat("pii_base", "pii_terms"))).first()
    assert "acct4711" not in clean and "90210" not in clean and "[EMAIL]" in clean
