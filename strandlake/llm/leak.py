"""Passages of evaluation material inside a corpus of mails.

Q-gram filtering: a text that holds L letters of a passage with k edits shares with it at least L - Q + 1 - k * Q q-grams (of
letters and digits, whatever stands between) on nearby diagonals, that is with about one distance between their places.
Shared q-grams are counted in overlapping bands of diagonals. Bands with fewer than the smallest leak of the passage must share
under its budget of one edit in EDIT_EVERY letters are dropped, and what remains is verified by a banded local alignment,
which measures how much of the passage is there. So no leak within the budget is lost, as long as its edits shift it by less than half a band.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .mail import QUOTE, all_texts, newlines

#: Letters and digits of a q-gram.
Q = 16
#: Diagonals in half a band; bands overlap by half.
HALF_BAND = 48
#: Part of a passage, and words, that make a leak ("about half of it or more, 30 words at least").
PART, LEAST_WORDS = 0.4, 30
#: Words that an altered end of a copied passage may cost in the alignment.
END = 2
#: The edit budget: one edited letter in so many, that is k = L // EDIT_EVERY for a leak of L letters.
EDIT_EVERY = 22
#: Items in one index, and indexes that a task holds at once. More items than both allow are searched in further passes over the letters
#: of the corpus, which are then kept in the shared folder, so that no mail is parsed twice.
ITEMS, INDEXES = 5000, 4
#: Letters and digits of texts that are searched at once, pairs of places that are looked at at once, and pairs aligned at once.
CHUNK, HITS, PAIRS = 2_000_000, 4_000_000, 256
#: Alignment: a matching character counts 1, each edit takes this off.
EDIT = 2
#: Table of the q-grams' hashes: bits of its index.
TABLE_BITS = 22

_FIXED = {ord(a): b for a, b in zip("ßæœøłđð", ("ss", "ae", "oe", "o", "l", "d", "d"), strict=True)}
_QUOTES = re.compile(rf"^(?:{QUOTE}[ \t]?)+", re.M)
#: Byte to code: 1 to 36 for digits and letters (upper case as lower case), 0 for what is left out.
_CODE = np.zeros(256, np.uint8)
_CODE[48:58] = np.arange(1, 11)
_CODE[97:123] = np.arange(11, 37)
_CODE[65:91] = np.arange(11, 37)


def letters(text: str) -> np.ndarray:
    """Codes of the letters and digits of a text, without quote marks at the beginnings of lines; other scripts than
    Latin are left out, accents too."""
    if not text.isascii():
        import unicodedata

        text = unicodedata.normalize("NFKD", text.lower().translate(_FIXED))
        text = text.replace("»", ">")
    raw = _QUOTES.sub("", text) if ">" in text or "|" in text else text
    codes = _CODE[np.frombuffer(raw.encode("ascii", "ignore"), np.uint8)]
    return codes[codes > 0]


def _lines(text: str | None) -> list[str]:
    return [x.strip() for x in newlines(text or "").split("\n") if x.strip()]


def passage_of(found: list[str], shared: set[str]) -> str | None:
    """The passage of an item of these lines: without instructions (short lines that several items share) and questions; null if it
    has too few words to leak."""
    kept = [x for x in found if (x not in shared or len(x.split()) >= LEAST_WORDS) and not x.lower().startswith("question:") and not re.search(r"\bA\).*\bB\)", x)]
    text = " ".join(kept or sorted(found, key=len)[-1:])
    return text if len(text.split()) >= LEAST_WORDS else None


def passages(items: DataFrame) -> DataFrame:
    """item_id and passage of each item that has one. Lines are counted over all items."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_lines(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["item_id", "lines"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [passage_of(x, set(s or ())) for x, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["item_id", "passage"])

    picked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL")
    split = checkpoint(picked.mapInArrow(lines, "item_id long, lines array<string>").withColumn("row", F.monotonically_increasing_id()))
    each = split.select("row", F.explode(F.array_distinct("lines")).alias("line"))
    often = each.groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").select("line")
    shared = each.join(often, "line").groupBy("row").agg(F.collect_list("line").alias("shared"))
    return split.join(shared, "row", "left").select("item_id", "lines", "shared").mapInArrow(cut, "item_id long, passage string").filter("passage IS NOT NULL")


class Index(NamedTuple):
    """Q-grams of the passages."""

    item_ids: np.ndarray
    codes: np.ndarray  # of all passages, one after the other
    start: np.ndarray  # of each passage, and the end of the last
    word_at: np.ndarray  # for each code the number of its word
    n_words: np.ndarray
    hashes: np.ndarray  # sorted, distinct
    first: np.ndarray  # of each hash, into places
    places: np.ndarray
    table: np.ndarray


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q = 16 codes from each place on (fewer places than codes)."""
    a = codes.astype(np.uint64)
    with np.errstate(over="ignore"):
        for step in (1, 2, 4):
            a = (a[:-step] << np.uint64(6 * step)) | a[step:]
        a ^= a >> np.uint64(23)
        a = a[:-8] * np.uint64(0x9E3779B97F4A7C15) + a[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
        a ^= a >> np.uint64(29)
    return a


def index(found: list[tuple[int, str]]) -> Index:
    codes, words, n_words = [], [], []
    for _, text in found:
        parts = [letters(w) for w in text.split()]
        parts = [p for p in parts if len(p)]
        codes.append(np.concatenate(parts) if parts else np.zeros(0, np.uint8))
        words.append(np.repeat(np.arange(len(parts)), [len(p) for p in parts]))
        n_words.append(len(parts))
    start = np.r_[0, np.cumsum([len(c) for c in codes])]
    hashes = [gram_hashes(c) if len(c) >= Q else np.zeros(0, np.uint64) for c in codes]
    places = np.concatenate([s + np.arange(len(h)) for s, h in zip(start, hashes, strict=False)]) if hashes else np.zeros(0, np.int64)
    every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    order = np.argsort(every, kind="stable")
    distinct, first = np.unique(every[order], return_index=True)
    table = np.zeros(1 << TABLE_BITS, bool)
    table[distinct >> np.uint64(64 - TABLE_BITS)] = True
    join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
    return Index(np.array([i for i, _ in found], np.int64), join(codes).astype(np.uint8), start, join(words), np.array(n_words, np.int64), distinct, np.r_[first, len(every)], places[order], table)


def least_shared(length: np.ndarray) -> np.ndarray:
    """The lemma: q-grams that a leak of so many letters shares with its passage at least, within the edit budget."""
    return np.maximum(length - Q + 1 - Q * (length // EDIT_EVERY), 1)


def _parts(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of places with about HITS hits together, at least one place each."""
    total, a = np.cumsum(n), 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + HITS, side="right")))
        yield a, b
        a = b


def candidates(texts: list[np.ndarray], ix: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, item and lowest diagonal (place in the text less place in the passage) of bands that keep the lemma's bound."""
    size = np.array([len(t) for t in texts], np.int64)
    stream = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
    none = np.zeros(0, np.int64)
    if len(stream) < Q or not len(ix.hashes):
        return none, none, none
    begin = np.cumsum(size) - size
    grams = gram_hashes(stream)
    at = np.flatnonzero(ix.table[grams >> np.uint64(64 - TABLE_BITS)])
    slot = np.searchsorted(ix.hashes, grams[at]).clip(0, len(ix.hashes) - 1)
    real = ix.hashes[slot] == grams[at]
    at, slot = at[real], slot[real]
    text = np.searchsorted(begin, at, side="right") - 1
    inside = at + Q <= begin[text] + size[text]  # no q-gram runs over the end of its text
    at, slot, text = at[inside], slot[inside], text[inside]
    longest = int((ix.start[1:] - ix.start[:-1]).max())
    cells = int(size.max() + longest) // HALF_BAND + 2
    n = ix.first[slot + 1] - ix.first[slot]
    keys, shared = none, none
    # a q-gram that very many passages share is met with all of them, part by part, so that only counts are kept
    for a, b in _parts(n):
        times = n[a:b]
        hit = np.repeat(ix.first[slot[a:b]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        place = ix.places[hit]
        item = np.searchsorted(ix.start, place, side="right") - 1
        of, where = np.repeat(text[a:b], times), np.repeat(at[a:b], times)
        diagonal = (where - begin[of]) - (place - ix.start[item]) + longest
        key, counted = np.unique((of * len(ix.item_ids) + item) * cells + diagonal // HALF_BAND, return_counts=True)
        if len(keys):
            key, back = np.unique(np.concatenate([keys, key]), return_inverse=True)
            counted = np.bincount(back, np.concatenate([shared, counted])).astype(np.int64)
        keys, shared = key, counted
    both = shared.copy()
    follows = keys[1:] == keys[:-1] + 1
    both[:-1] += np.where(follows, shared[1:], 0)
    pair = keys // cells
    item, text = pair % len(ix.item_ids), pair // len(ix.item_ids)
    length = ix.start[item + 1] - ix.start[item]
    smallest = np.maximum(PART, LEAST_WORDS / np.maximum(ix.n_words[item], LEAST_WORDS)) * length
    fine = both >= least_shared(smallest)
    # a band seen on its own and as the second half of one before is looked at once, where it is fullest
    worse = np.zeros(len(keys), bool)
    near = (pair[1:] == pair[:-1]) & (keys[1:] - keys[:-1] <= 1)
    worse[1:] |= near & (both[1:] <= both[:-1])
    worse[:-1] |= near & (both[:-1] < both[1:])
    fine &= ~worse | (both >= 2 * least_shared(smallest))
    return text[fine], item[fine], (keys[fine] % cells) * HALF_BAND - longest


def align(texts: list[np.ndarray], which: np.ndarray, item: np.ndarray, low: np.ndarray, ix: Index) -> np.ndarray:
    """Words of each passage that the best local alignment within the band spans."""
    margin = HALF_BAND // 2
    width = 2 * HALF_BAND + 2 * margin
    spanned = np.zeros(len(which), np.int64)
    for p0 in range(0, len(which), PAIRS):
        part = slice(p0, min(p0 + PAIRS, len(which)))
        items, diag = item[part], low[part] - margin
        length = ix.start[items + 1] - ix.start[items]
        rows = int(length.max())
        # window[p, i + j]: the text's code at passage place i on the band's diagonal j, 0 beyond the text
        window = np.zeros((len(items), rows + width), np.uint8)
        passage = np.full((len(items), rows), 255, np.uint8)
        for k, (w, i, d) in enumerate(zip(which[part], items, diag, strict=True)):
            code = texts[w]
            a, b = max(0, d), min(len(code), d + rows + width)
            if b > a:
                window[k, a - d : b - d] = code[a:b]
            passage[k, : length[k]] = ix.codes[ix.start[i] : ix.start[i + 1]]
        # score times 2**24, and 2**24 - 1 less the place where the alignment began
        unit = np.int64(1 << 24)
        ramp = np.arange(width, dtype=np.int64) * EDIT * unit
        h = np.zeros((len(items), width), np.int64)
        best = np.zeros(len(items), np.int64)
        best_end = np.zeros(len(items), np.int64)
        mask = unit - 1
        for i in range(rows):
            fresh = mask - i
            same = window[:, i : i + width] == passage[:, i : i + 1]
            step = np.maximum(h, fresh) + np.where(same, unit, -EDIT * unit)
            up = np.empty_like(h)  # a character of the passage that the text leaves out: from the next diagonal
            up[:, :-1] = h[:, 1:] - EDIT * unit
            up[:, -1] = fresh
            step = np.maximum(np.maximum(step, up), fresh - 1)
            h = np.maximum.accumulate(step + ramp, axis=1) - ramp
            top = h.max(axis=1)
            better = (top >> 24) > (best >> 24)
            best = np.where(better, top, best)
            best_end = np.where(better, i, best_end)
        begin = mask - (best & mask)
        lo = ix.word_at[ix.start[items] + np.minimum(begin, length - 1)]
        hi = ix.word_at[ix.start[items] + np.minimum(best_end, length - 1)]
        spanned[part] = np.where(best >> 24 > 0, hi - lo + 1, 0)
    return spanned


def search(docs: list[tuple[int, list[np.ndarray]]], ix: Index) -> list[tuple[int, int, int]]:
    """doc_id, item_id and the most words spanned, of each document's texts (as letters) and each item that leaks."""
    owner = [doc for doc, texts in docs for _ in texts]
    texts = [t for _, found in docs for t in found]
    which, item, low = candidates(texts, ix)
    if not len(which):
        return []
    words = align(texts, which, item, low, ix)
    enough = words >= np.maximum(LEAST_WORDS - END, np.ceil(PART * ix.n_words[item]))
    best: dict[tuple[int, int], int] = {}
    for w, i, n in zip(which[enough].tolist(), item[enough].tolist(), words[enough].tolist(), strict=True):
        key = (owner[w], int(ix.item_ids[i]))
        best[key] = max(best.get(key, 0), n)
    return [(doc, i, n) for (doc, i), n in best.items()]


def _searched(docs: Iterator[tuple[int, list[np.ndarray]]], indexes: list[Index]) -> Iterator[pa.RecordBatch]:
    """Documents' letters, searched some at a time."""

    def given(held: list) -> pa.RecordBatch:
        found = [x for ix in indexes for x in search(held, ix)]
        return pa.RecordBatch.from_pylist([dict(zip(("doc_id", "item_id", "n_words"), x, strict=True)) for x in found], _FOUND)

    held, size = [], 0
    for doc, texts in docs:
        held.append((doc, texts))
        size += sum(map(len, texts))
        if size >= CHUNK:
            yield given(held)
            held, size = [], 0
    if held:
        yield given(held)


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id and n_words (of the passage, as aligned) of each document that holds an item's passage, or at
    least PART of it and LEAST_WORDS words.

    The items are a stated query set: they are held against all documents, ITEMS * INDEXES of them in one pass; so many come to the
    driver at once. Null and empty texts hold nothing, items without a passage of LEAST_WORDS words leak nowhere. Texts of any length
    are searched whole. A repeated doc_id gives a pair for each of its rows that holds it."""
    spark = documents.sparkSession
    found = checkpoint(passages(items))
    n = found.count()
    passes = max(1, -(-n // (ITEMS * INDEXES)))
    picked = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield doc, [letters(t) for t in all_texts(text.as_py())]

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
        for batch in batches:
            for doc, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield doc, [np.frombuffer(t, np.uint8) for t in texts]

    def letters_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = list(parsed([batch]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[t.tobytes() for t in texts] for _, texts in docs], pa.list_(pa.binary()))], names=["doc_id", "letters"])

    read, source = parsed, picked
    if passes > 1:
        read, source = stored, checkpoint(picked.mapInArrow(letters_of, "doc_id long, letters array<binary>"))
    out = None
    for k in range(passes):
        block = found.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k) if passes > 1 else found
        rows = sorted(tuple(r) for r in block.toLocalIterator())
        held = spark.sparkContext.broadcast([index(rows[a : a + ITEMS]) for a in range(0, max(len(rows), 1), ITEMS)])

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            return _searched(read(batches), held.value)

        part = source.mapInArrow(run, "doc_id long, item_id long, n_words long")
        out = part if out is None else out.unionByName(part)
    return out


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_words", pa.int64())])


def leaked_items(found: DataFrame, items: DataFrame) -> DataFrame:
    """Every item with the number of documents that it leaked into."""
    counts = found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n"))
    return items.select(F.col("item_id").cast("long").alias("item_id"), "suite").join(counts, "item_id", "left").select("item_id", "suite", F.coalesce("n", F.lit(0)).alias("n_documents"))
