"""Token ids of a corpus by a public byte-level BPE vocabulary, each distinct word encoded once.

Texts are cut into words (pre-tokens) block by block; a block keeps its distinct words once and its texts as places in
that list, in order. The blocks' words meet in one shuffle, where each distinct word of the corpus is encoded once, and its
ids go back to the blocks that hold it; there the texts are put together again from the places. So what is shuffled are
a block's distinct words, not every occurrence of a word, and no table of all words is held anywhere.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint

#: The vocabulary file: a parameter, never part of the repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text into pre-tokens before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters after which a block of texts is closed. A longer text is a block of its own.
BLOCK_CHARS = 8_000_000
#: Ids after which a block of encoded texts is closed.
BLOCK_IDS = 2_000_000


def ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class _Words(dict):
    """Gives each new word the next place."""

    def __init__(self):
        super().__init__()
        self.place = count().__next__

    def __missing__(self, word: str) -> int:
        self[word] = place = self.place()
        return place


def _blocks(batches: Iterator[pa.RecordBatch], block_chars: int) -> Iterator[pa.RecordBatch]:
    import regex
    from pyspark import TaskContext

    split = regex.compile(PATTERN).findall
    number = count(TaskContext.get().partitionId() << 32)
    ids, lengths, places, words, size = [], [], array("i"), _Words(), 0

    def block() -> pa.RecordBatch:
        packed = zstandard.ZstdCompressor(level=3).compress(np.frombuffer(places, np.int32).astype(np.uint16 if len(words) < 1 << 16 else np.uint32))
        columns = [[next(number)], [ids], [lengths], [packed], [len(words) < 1 << 16], [list(words)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (f.type for f in _BLOCK), strict=True)], schema=_BLOCK)

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            before = len(places)
            if text:
                places.extend(map(words.__getitem__, split(text)))
                size += len(text)
            ids.append(doc)
            lengths.append(len(places) - before)
            if size >= block_chars:
                yield block()
                ids, lengths, places, words, size = [], [], array("i"), _Words(), 0
    if ids:
        yield block()


_BLOCK = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("places", pa.binary()), ("narrow", pa.bool_()), ("words", pa.list_(pa.string()))])


def word_blocks(documents: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """block, doc_ids, lengths (words of each text), places (all texts' words as places in words), narrow, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _blocks(batches, block_chars)

    picked = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return picked.mapInArrow(run, "block long, doc_ids array<long>, lengths array<int>, places binary, narrow boolean, words array<string>")


def encode_words(words: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """word and ids of the distinct words of the only column."""
    with open(vocabulary, "rb") as file:
        table = words.sparkSession.sparkContext.broadcast(file.read())  # under a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = None
        for batch in batches:
            encoding = encoding or _encoding(table.value)
            ids = [encoding._encode_single_piece(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return words.distinct().mapInArrow(run, "word string, ids array<int>")


_KEPT: dict[int, object] = {}


def _encoding(lines: bytes):
    """The encoder of a vocabulary file, kept for the life of a worker."""
    import tiktoken

    if (key := hash(lines)) not in _KEPT:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        _KEPT[key] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
    return _KEPT[key]


def _reassemble(blocks: pa.Table, coded: pa.Table) -> pa.Table:
    """The ids of a block's texts, from its places and the ids of its words."""
    doc_ids, lengths = blocks["doc_ids"][0].values, np.asarray(blocks["lengths"][0].values)
    raw = zstandard.ZstdDecompressor().decompress(blocks["places"][0].as_py())
    places = np.frombuffer(raw, np.uint16 if blocks["narrow"][0].as_py() else np.uint32)
    lists = coded["ids"].combine_chunks().take(pa.array(np.argsort(np.asarray(coded["place"]))))
    flat, size = np.asarray(lists.flatten()), np.asarray(lists.value_lengths()).astype(np.int64)
    begin = np.cumsum(size) - size
    n = size[places]
    ends = np.cumsum(n)
    out = flat[np.repeat(begin[places] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
    closes = np.r_[0, ends][np.r_[0, np.cumsum(lengths)]]
    ids = pa.ListArray.from_arrays(pa.array(closes.astype(np.int32)), pa.array(out.astype(np.int32)))
    return pa.table({"doc_id": doc_ids, "ids": ids})


def encode(documents: DataFrame, vocabulary: str = VOCABULARY, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id and ids of every document, without special tokens; an empty list for an empty and for a null text.

    Every row counts, also with a repeated or null doc_id. Strings of special tokens in a text are ordinary text. Texts of
    any length are encoded whole; columns besides doc_id and text are left aside."""
    blocks = checkpoint(word_blocks(documents, block_chars))
    words = blocks.select("block", F.posexplode("words").alias("place", "word"))
    coded = words.join(encode_words(words.select("word"), vocabulary), "word").select(F.col("block").alias("of_block"), "place", "ids")
    # one block at a time is in a worker's memory
    both = blocks.drop("words").groupBy("block").cogroup(coded.groupBy("of_block"))
    return both.applyInArrow(_reassemble, "doc_id long, ids array<int>")


_ID_BLOCK = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("places", pa.binary()), ("tokens", pa.list_(pa.int32()))])


def _id_blocks(batches: Iterator[pa.RecordBatch], block_ids: int) -> Iterator[pa.RecordBatch]:
    """Texts given as ids, in blocks: the distinct ids of a block once, and every id as a place among them."""
    from pyspark import TaskContext

    number = count(TaskContext.get().partitionId() << 32)
    docs, lists, size = [], [], 0

    def block() -> pa.RecordBatch:
        ids = pa.concat_arrays(lists)
        tokens, places = np.unique(np.asarray(ids.flatten()), return_inverse=True)
        lengths = np.asarray(ids.value_lengths().fill_null(0))
        packed = zstandard.ZstdCompressor(level=3).compress(places.astype(np.uint32).tobytes())
        columns = [[next(number)], [pa.concat_arrays(docs).to_pylist()], [lengths], [packed], [tokens]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ID_BLOCK, strict=True)], schema=_ID_BLOCK)

    for batch in batches:
        ids = batch.column(1)
        # a text is never cut, so blocks end behind the one that fills them
        ends = np.cumsum(np.asarray(ids.value_lengths().fill_null(0)).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            end = min(int(np.searchsorted(ends, done + block_ids - size)) + 1, batch.num_rows)
            docs.append(batch.column(0).slice(begin, end - begin))
            lists.append(ids.slice(begin, end - begin))
            size += int(ends[end - 1] - done)
            begin = end
            if size >= block_ids:
                yield block()
                docs, lists, size = [], [], 0
    if docs:
        yield block()


def _reassemble_text(blocks: pa.Table, coded: pa.Table) -> pa.Table:
    """The texts of a block, from its places and the bytes of its tokens."""
    doc_ids, lengths = blocks["doc_ids"][0].values, np.asarray(blocks["lengths"][0].values)
    places = np.frombuffer(zstandard.ZstdDecompressor().decompress(blocks["places"][0].as_py()), np.uint32)
    tokens = coded["bytes"].combine_chunks().take(pa.array(np.argsort(np.asarray(coded["place"]))))
    flat, size = np.frombuffer(b"".join(tokens.to_pylist()), np.uint8), np.asarray(pc.binary_length(tokens)).astype(np.int64)
    begin, n = np.cumsum(size) - size, size[places]
    ends = np.cumsum(n)
    raw = flat[np.repeat(begin[places] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
    closes = np.r_[0, ends][np.r_[0, np.cumsum(lengths)]]
    texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(closes[:-1], closes[1:], strict=True)]
    return pa.table({"doc_id": doc_ids, "text": pa.array(texts, pa.string())})


def token_bytes(spark: SparkSession, vocabulary: str = VOCABULARY) -> DataFrame:
    """token and bytes, a row per token of the vocabulary."""
    return spark.createDataFrame(((rank, bytearray(token)) for token, rank in ranks(vocabulary).items()), "token int, bytes binary")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, block_ids: int = BLOCK_IDS) -> DataFrame:
    """doc_id and text from doc_id and ids, by a join of each block's distinct ids with the table of token bytes.

    No ids, and null, give an empty text; ids that the vocabulary doesn't have add nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _id_blocks(batches, block_ids)

    blocks = checkpoint(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "block long, doc_ids array<long>, lengths array<int>, places binary, tokens array<int>"))
    tokens = blocks.select("block", F.posexplode("tokens").alias("place", "token"))
    # as many rows as the vocabulary has
    coded = tokens.join(F.broadcast(token_bytes(encoded.sparkSession, vocabulary)), "token", "left").select(F.col("block").alias("of_block"), "place", F.coalesce("bytes", F.lit(b"")).alias("bytes"))
    both = blocks.drop("tokens").groupBy("block").cogroup(coded.groupBy("of_block"))
    return both.applyInArrow(_reassemble_text, "doc_id long, text string")


def round_trip(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_ids and whether decoding gives the text back (null counts as empty). For unique doc_ids."""
    encoded = checkpoint(encode(documents, vocabulary))
    back = decode(encoded, vocabulary).withColumnRenamed("text", "decoded")
    sized = encoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"))
    hashed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("was"))
    return sized.join(back.select("doc_id", F.sha2("decoded", 256).alias("now")), "doc_id").join(hashed, "doc_id").select("doc_id", "n_ids", (F.col("was") == F.col("now")).alias("intact"))
