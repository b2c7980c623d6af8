"""Token ids in binary files: ids ranked by frequency, byte-aligned variable-length codes.

An id is replaced by its rank among all ids of the corpus (0: the most frequent), so that frequent ids
need one byte. Ranks are kept as 1 to 4 little-endian bytes; the byte counts less one stand apart as
2-bit codes, four to a control byte. A decoder looks up each control byte in a table of the four
lengths it stands for and never branches on the data.

A corpus folder holds ``documents`` files of records in ascending id order, the table ``ranks`` and the
table ``files``, which is written last: only files it names belong to the corpus, so that files of lost
or repeated tasks are without effect.
"""

from __future__ import annotations

import json
import string
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.llm.common import WordCache, small_batches, table, text_slices, work_folder, written

END_ID = 2
FILE_BYTES = 64_000_000
# Ids that are counted, packed or unpacked at once.
COUNT_IDS = 1 << 20

# One record is a header (id, id present, tokens, control bytes, data bytes), then both streams.
HEADER = "<qbqqq"

# The four code lengths that a control byte stands for, and their sum.
LENGTHS = np.array([[(byte >> shift & 3) + 1 for shift in (0, 2, 4, 6)] for byte in range(256)], dtype=np.uint8)

# White space other than the blank and the line feed.
_OTHER_SPACE = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")


def _has_wide_space(text: str) -> bool:
    """Whether white space may stand next to white space, or a blank at the end."""
    return "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text.endswith(" ") or any(c in text for c in _OTHER_SPACE)


def _byte_letters() -> dict[int, str]:
    """The characters that byte-level vocabularies write for bytes: themselves where printable, else those from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b if b in printable else 256 + others.index(b)) for b in range(256)}


class Words(WordCache):
    """Word, as it stands behind a blank or with the line feed before it, to its ids.

    A key that begins with a blank stands for the signs after it, right behind a word.
    """

    CACHE_WORDS = 600_000
    CACHE_LETTERS = 64  # longer words are seldom met again

    def __init__(self, encoder: "Encoder"):
        super().__init__()
        self.encode, self.merges = encoder.ids, encoder.tokenizer.model.tokenize
        letter_of = _byte_letters()
        # Latin letters in the vocabulary's writing of their bytes.
        self.letters = {c: "".join(map(letter_of.get, c.encode())) for c in map(chr, range(0x250)) if c.isalpha()}
        ids = np.arange(max(encoder.tokenizer.get_vocab().values()) + 1, dtype=encoder.width)
        self.id_bytes = [i.tobytes() for i in ids]
        self.line_feed = self.encode("\n")

    def keeps(self, word: str) -> bool:
        return len(word) <= self.CACHE_LETTERS

    def make(self, word: str) -> bytes:
        if word.isalpha() and word.isascii():  # most words; the vocabulary writes these bytes as they are
            return self.merged("\u0120" + word)
        # The pre-tokenizer ends a word between letters and signs.
        stem = word.rstrip(string.punctuation)
        if stem != word and stem[-1:] in self.letters:
            return self[stem] + self[" " + word[len(stem) :]]
        first = word[:1]
        if first == " ":
            return self.encode(word[1:])
        own, before = (word[1:], self.line_feed) if first == "\n" else (" " + word, b"")
        letters = word[1:] if first == "\n" else word
        try:  # one word of Latin letters to any pre-tokenizer: straight to the merges
            written = "".join([self.letters[c] for c in letters])
        except KeyError:
            return before + self.encode(own)
        return before + self.merged(written if first == "\n" else "\u0120" + written)

    def merged(self, written: str) -> bytes:
        return b"".join([self.id_bytes[t.id] for t in self.merges(written)])


class Encoder:
    """Ids of whole texts by the tokenizers library; a word's ids are looked up while the word is still met.

    A byte-level pre-tokenizer never joins what stands before a blank or a line feed with it unless white space
    stands on both sides, so a text is cut there. Texts with wider white space or an added token in them go to the
    library whole, as do all texts under a tokenizer of another kind.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        parts = json.loads(self.tokenizer.to_str())
        kind = parts["pre_tokenizer"] or {}
        self.cut = kind.get("type") == "ByteLevel" and not kind["add_prefix_space"] and kind["use_regex"]
        self.cut = self.cut and parts["normalizer"] is None and parts["truncation"] is None
        self.added = [t["content"] for t in parts["added_tokens"]]
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        if self.cut:
            self.words = Words(self)

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.width).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of ``width``."""
        return [self._words(text) if self.cut and text and not self._is_whole(text) else self.ids(text) for text in texts]

    def _is_whole(self, text: str) -> bool:
        return _has_wide_space(text) or any(t in text for t in self.added)

    def _words(self, text: str) -> bytes:
        # With a line feed before it, a text's first word is looked up like a line's; that line feed is left out again.
        words = ("\n" + text).replace("\n", " \n")[1:].split(" ")
        return b"".join(map(self.words.__getitem__, words))[len(self.words.line_feed) :]


_encoders: dict[str, Encoder] = {}


def encoder(tokenizer_file: str) -> Encoder:
    """One encoder per worker process, with its words, across the tasks it runs."""
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = Encoder(tokenizer_file)
    return _encoders[tokenizer_file]


def _places(counts: np.ndarray) -> np.ndarray:
    """Where each code stands if every record's codes begin at a new control byte; ``counts`` are the records' codes."""
    padded = -(-counts // 4) * 4
    shift = np.cumsum(padded) - padded - (np.cumsum(counts) - counts)
    return np.arange(int(counts.sum())) + np.repeat(shift, counts)


def pack_records(ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(control bytes, data bytes, data bytes of each record) of records with ``counts`` of the ``ranks`` on end."""
    ranks = ranks.astype("<u4", copy=False)
    codes = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(int((-(-counts // 4)).sum()) * 4, dtype=np.uint8)
    padded[_places(counts)] = codes
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    used = np.arange(4, dtype=np.uint8) <= codes[:, None]
    ends = np.concatenate(([0], np.cumsum(codes, dtype=np.int64)))[np.cumsum(counts)]
    return control.astype(np.uint8), ranks.view(np.uint8).reshape(-1, 4)[used], np.diff(ends, prepend=0) + counts


def unpack_records(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranks behind both streams of records with ``counts`` ranks, on end."""
    lengths = LENGTHS[control].reshape(-1)[_places(counts)]
    used = np.arange(4, dtype=np.uint8) < lengths[:, None]
    out = np.zeros((len(lengths), 4), dtype=np.uint8)
    out[used] = data
    return out.reshape(-1).view("<u4")


def pack(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(control bytes, data bytes) of ``ranks``."""
    return pack_records(ranks, np.array([len(ranks)]))[:2]


def unpack(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The ranks behind both streams."""
    return unpack_records(control, data, np.array([count]))


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")


def tokenized(docs: DataFrame, id_column: str, text_column: str, tokenizer_file: str, end_id: int) -> DataFrame:
    """(part, seq, id, ids): the ids of every text and the end id; parts are ascending ranges of document ids, seq their order inside."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_file)
        tail = np.array([end_id], dtype=own.width).tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in text_slices(batch, "text"):
                ids = [x + tail for x in own.encode([t or "" for t in rows.column(1).to_pylist()])]
                n = len(ids)
                columns = [pa.array([part] * n, pa.int64()), pa.array(range(seq, seq + n), pa.int64()), rows.column(0)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())], names=["part", "seq", "id", "ids"])
                seq += n

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    order = F.col("id").asc_nulls_first()
    ordered = rows.repartitionByRange(order).sortWithinPartitions(order, "text")
    return ordered.mapInArrow(encode, "part long, seq long, id long, ids binary")


def flat_ids(column: pa.Array, width: str) -> Iterator[np.ndarray]:
    """The ids of all rows, at most about twice ``COUNT_IDS`` at a time."""
    held, count = [], 0
    for data in column:
        ids = np.frombuffer(data.as_buffer(), dtype=width)
        for start in range(0, len(ids), COUNT_IDS):
            held.append(ids[start : start + COUNT_IDS])
            count += len(held[-1])
            if count >= COUNT_IDS:
                yield np.concatenate(held)
                held, count = [], 0
    if held:
        yield np.concatenate(held)


def id_runs(batch: pa.RecordBatch, column: str, width: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """``batch`` in runs of rows, and the ids of each row; about ``COUNT_IDS`` in a run, or one row of more."""
    start, held, count = 0, [], 0
    for row, data in enumerate(batch.column(batch.schema.get_field_index(column))):
        ids = np.frombuffer(data.as_buffer(), dtype=width)
        if held and count + len(ids) > COUNT_IDS:
            yield batch.slice(start, row - start), held
            start, held, count = row, [], 0
        held.append(ids)
        count += len(ids)
    if held:
        yield batch.slice(start), held


def frequency_ranks(tokens: DataFrame, width: str) -> DataFrame:
    """(token, n, rank) of every id in use, from all documents; as many rows as the vocabulary has at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for ids in flat_ids(batch.column(0), width):
                found = np.bincount(ids)
                if len(found) > len(total):
                    total = np.pad(total, (0, len(found) - len(total)))
                total[: len(found)] += found
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["token", "n"])

    counted = tokens.select("ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    order = Window.orderBy(F.desc("n"), "token")  # one row per vocabulary entry
    return counted.withColumn("rank", F.row_number().over(order).cast("long") - 1)


def write_corpus(
    docs: DataFrame,
    folder: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    tokenizer_file: str | None = None,
    end_id: int = END_ID,
    file_bytes: int = FILE_BYTES,
) -> None:
    """Writes all texts (null: empty) as token files under ``folder``, in ascending id order (null ids first).

    Rows that share an id are kept, in order of their texts. ``tokenizer_file`` is a tokenizers
    JSON file (default: the public byte-level vocabulary). Files end at ``file_bytes``; one document
    never spans two.
    """
    spark = docs.sparkSession
    path = tokenizer_file or public_tokenizers.path("byte_bpe_50k.json")
    width = encoder(path).width
    tokens = written(tokenized(docs, id_column, text_column, path, end_id), "tokens", "zstd")
    with small_batches(spark):
        frequency_ranks(tokens, width).write.parquet(f"{folder}/ranks")
    by_token = spark.read.parquet(f"{folder}/ranks").select("token", "rank").toPandas()  # bounded by the vocabulary
    rank_of = np.zeros(int(by_token.token.max()) + 1 if len(by_token) else 1, dtype="<u4")
    rank_of[by_token.token.to_numpy()] = by_token["rank"].to_numpy()
    shared = spark.sparkContext.broadcast(rank_of)
    system, root = _filesystem(folder)
    system.create_dir(f"{root}/documents", recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        stream, rows, name = None, [], ""
        part = first = seq = held = documents = total = 0
        runs = (run for batch in batches for run in id_runs(batch, "ids", width))
        # A file holds a run of one part; another begins where the scan starts elsewhere or the file is full.
        for records, ids in runs:
            counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            control, packed, sizes = pack_records(shared.value[np.concatenate(ids)], counts)
            control, packed = memoryview(control.tobytes()), memoryview(packed.tobytes())
            keys = (records.column(i).to_pylist() for i in range(3))
            at_control = at_packed = 0
            for own_part, own_seq, doc_id, n, n_packed in zip(*keys, counts.tolist(), sizes.tolist()):
                n_control = -(-n // 4)
                if stream is None or (own_part, own_seq) != (part, seq + 1) or held + n_packed > file_bytes:
                    if stream is not None:
                        stream.close()
                        rows.append((part, first, name, documents, total))
                    name = f"part-{own_part:06d}-{own_seq:010d}-{uuid.uuid4().hex}.tok"
                    stream = system.open_output_stream(f"{root}/documents/{name}", buffer_size=1 << 20)
                    part, first, held, documents, total = own_part, own_seq, 0, 0, 0
                seq = own_seq
                stream.write(struct.pack(HEADER, doc_id or 0, doc_id is not None, n, n_control, n_packed))
                stream.write(control[at_control : at_control + n_control])
                stream.write(packed[at_packed : at_packed + n_packed])
                at_control, at_packed = at_control + n_control, at_packed + n_packed
                held += n_packed + n_control + struct.calcsize(HEADER)
                documents += 1
                total += n
        if stream is not None:
            stream.close()
            rows.append((part, first, name, documents, total))
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)], names=["part", "seq", "name", "documents", "tokens"]
        )

    files = tokens.mapInArrow(write, "part long, seq long, name string, documents long, tokens long")
    with small_batches(spark):
        files.write.parquet(f"{folder}/files")


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the files: ids as an array, start as the ids before it."""
    files = spark.read.parquet(f"{folder}/files")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    listed = files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    ranks = spark.read.parquet(f"{folder}/ranks").select("rank", "token").toPandas()  # bounded by the vocabulary
    token_of = np.zeros(len(ranks) or 1, dtype="<u4")
    token_of[ranks["rank"].to_numpy()] = ranks.token.to_numpy()
    shared = spark.sparkContext.broadcast(token_of)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _filesystem(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held: list[tuple] = []
                count = 0
                with system.open_input_stream(f"{path}/documents/{name}", buffer_size=1 << 20) as stream:
                    while header := stream.read(struct.calcsize(HEADER)):
                        doc_id, present, n, n_control, n_data = struct.unpack(HEADER, header)
                        if held and count + n > COUNT_IDS:
                            yield _rows(held, shared.value)
                            held, count = [], 0
                        held.append((doc_id if present else None, start, n, stream.read(n_control), stream.read(n_data)))
                        start, count = start + n, count + n
                if held:
                    yield _rows(held, shared.value)

    spread = listed.select("name", "start").repartition(max(1, files.count()))
    return spread.mapInArrow(read, "doc_id long, start long, ids binary")


def _rows(held: list[tuple], token_of: np.ndarray) -> pa.RecordBatch:
    doc_ids, starts, counts, control, data = zip(*held)
    counts = np.array(counts)
    control, data = (np.frombuffer(b"".join(x), dtype=np.uint8) for x in (control, data))
    ids = token_of[unpack_records(control, data, counts)].tobytes()
    ends = (4 * np.cumsum(counts)).tolist()
    columns = [doc_ids, starts, [ids[a:b] for a, b in zip([0, *ends], ends)]]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "ids"]
    )


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through token files and back: ids before each document, its ids, and their checksum."""
    folder = work_folder(spark, "token-files")
    write_corpus(table(spark, sf_dir, "documents"), folder)

    rows = read_corpus(spark, folder)
    return rows.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
