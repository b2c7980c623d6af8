"""Merge-type (BPE) sentencepiece vocabularies: encoding by an agenda of adjacent pairs, and decoding.

The symbols of a text are its characters, with blanks as U+2581. All adjacent pairs that form a piece wait
in an agenda ordered by score, then by place; the best pair is merged and its new neighbours join the
agenda, until none is left. No piece of such a vocabulary has a blank behind another character, so no merge
crosses the start of a run of blanks: a text is cut there, and each distinct word is merged once per worker.
Every word is also encoded by the sentencepiece library in its Arrow batch, and a difference stops the job.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import WordCache, joined_ids, split_words, table, text_slices

BLANK = "▁"
_WORD = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


def merged(word: str, ranks: dict[str, int]) -> list[str]:
    """The symbols of ``word`` after all merges: lowest rank first, then leftmost.

    The agenda holds one number for each proposed pair, its rank before its place. A proposal is stale when
    the pair now at its place has another rank.
    """
    count = len(word)
    bits = count.bit_length()
    mask = (1 << bits) - 1
    rank_of = ranks.get
    text = list(word)
    before, after = list(range(-1, count - 1)), list(range(1, count + 1))
    agenda = [rank << bits | i for i in range(count - 1) if (rank := rank_of(word[i : i + 2])) is not None]
    heapify(agenda)
    while agenda:
        proposal = heappop(agenda)
        left = proposal & mask
        right = after[left]
        if not text[left] or right >= count:
            continue
        piece = text[left] + text[right]
        if rank_of(piece) != proposal >> bits:
            continue
        text[left], text[right] = piece, ""
        following = after[left] = after[right]
        if following < count:
            before[following] = left
            if (rank := rank_of(piece + text[following])) is not None:
                heappush(agenda, rank << bits | left)
        previous = before[left]
        if previous >= 0 and (rank := rank_of(text[previous] + piece)) is not None:
            heappush(agenda, rank << bits | previous)
    return [t for t in text if t]


class Words(WordCache):
    """Word to its ids, merged on first use."""

    def __init__(self, codec: "Codec"):
        super().__init__()
        self.codec = codec
        self.unchecked: list[tuple[str, list[int]]] = []

    def keeps(self, word: str) -> bool:
        return "\n" not in word or word == "\n"  # a word and the next line's first are seldom met again

    def make(self, word: str) -> bytes:
        parts = [word] if word[1:].isalpha() else self.codec.segments(word)
        if len(parts) > 1:
            return b"".join(map(self.__getitem__, parts))
        found = self.codec.word_ids(word)
        self.unchecked.append((word, found))
        return np.array(found, dtype="<i4").tobytes()


class Codec:
    """Encodes and decodes with one vocabulary; keeps the ids of words it has seen."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = self.library.get_piece_size()
        plain = [i for i in range(size) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))]
        self.ids = {self.library.id_to_piece(i): i for i in plain}
        scores = {piece: self.library.get_score(i) for piece, i in self.ids.items()}
        place = {score: i for i, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {piece: place[score] for piece, score in scores.items()}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown, self.end = self.library.unk_id(), self.library.eos_id()
        self.byte_fallback = self.library.is_byte(self.bytes[0])
        if any(BLANK in piece.lstrip(BLANK) for piece in self.ids):
            raise ValueError("this vocabulary joins words across blanks")
        # Two characters that no piece has side by side are never merged: a word may be cut between them.
        self.joined = {a + b for piece in self.ids for a, b in zip(piece, piece[1:])}
        self.words = Words(self)

    def word_ids(self, word: str) -> list[int]:
        found = []
        for piece in merged(word, self.ranks):
            own = self.ids.get(piece)
            if own is not None:
                found.append(own)
            elif self.byte_fallback:
                found.extend(self.bytes[b] for b in piece.encode("utf-8"))
            elif not found or found[-1] != self.unknown:
                found.append(self.unknown)
        return found

    def segments(self, word: str) -> list[str]:
        cuts = [i + 1 for i, pair in enumerate(zip(word, word[1:])) if pair[0] + pair[1] not in self.joined]
        return [word[i:j] for i, j in zip([0, *cuts], [*cuts, len(word)])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, without an end id."""
        out = [np.zeros(0, dtype="<i4")] * len(texts)
        plain = [i for i, t in enumerate(texts) if t and not ("  " in t or BLANK in t or t[0] == " " or t[-1] == " ")]
        if plain:
            words, order, begins = split_words([texts[i] for i in plain])
            pieces = [self.words[BLANK + word] for word in words]
            for i, ids in zip(plain, joined_ids(pieces, order, begins, "<i4")):
                out[i] = ids
        for i in set(range(len(texts))).difference(plain):
            words = _WORD.findall((" " + texts[i]).replace(" ", BLANK)) if texts[i] else []
            out[i] = np.frombuffer(b"".join(map(self.words.__getitem__, words)), dtype="<i4")
        return out

    def check(self) -> None:
        """Compares the words merged since the last check with the library."""
        # The library puts a blank before its input; a word that has none gets its own ids behind that blank's.
        merged_words, self.words.unchecked = self.words.unchecked, []
        theirs = self.library.encode([w[1:].replace(BLANK, " ") for w, _ in merged_words if w[0] == BLANK and w != BLANK], num_threads=1)
        ours = [ids for w, ids in merged_words if w[0] == BLANK and w != BLANK]
        if ours != theirs:
            raise ValueError(next(f"merged to {a}, the library has {b}" for a, b in zip(ours, theirs) if a != b))

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids)


_codecs: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    """One codec per worker process, with its words, across the tasks it runs."""
    if model_file not in _codecs:
        _codecs[model_file] = Codec(model_file)
    return _codecs[model_file]


def encode_decode(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model_file: str | None = None, digests: bool = False
) -> DataFrame:
    """Ids and decoded text of every whole text (null: empty), one row per row of ``docs``, in no order.

    Returns ``id_column``, n_tokens (with the end id), ids (array) and decoded. With ``digests`` the last two
    come as ids_sha256 (of the decimal ids joined by one blank) and decoded_sha256 (of UTF-8) instead, so that
    nothing wide leaves the workers. Null and repeated ids stay as they are; other columns are left out.
    """
    path = model_file or public_tokenizers.path("piece_bpe_32k.model")
    kind = docs.schema[id_column].dataType.simpleString()
    columns = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        decimal = [str(i) for i in range(own.library.get_piece_size())]
        for batch in batches:
            for part in text_slices(batch, "text"):
                coded = own.encode([t or "" for t in part.column(1).to_pylist()])
                own.check()
                ids = [x.tolist() + [own.end] for x in coded]
                texts = own.decode(ids) if ids else []
                if digests:
                    first = pa.array([hashlib.sha256(" ".join(map(decimal.__getitem__, x)).encode()).hexdigest() for x in ids], pa.string())
                    second = pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in texts], pa.string())
                else:
                    first, second = pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())
                lengths = pa.array([len(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), lengths, first, second], names=names)

    schema = f"id {kind}, n_tokens long, {columns}"
    names = [c.split()[0] for c in schema.split(", ")]
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded with an end id and decoded, as digests."""
    return encode_decode(table(spark, sf_dir, "documents"), digests=True)
