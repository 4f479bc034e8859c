"""Reading level of the prose that a mail's author wrote.

A smoothed unigram language model per level is trained on labelled texts; a text gets the level under which it, with the
level's prior, is most likely.

Disclaimers are no words of the author. Whatever they say, they are the last paragraph of many mails that otherwise differ: such closing
paragraphs are counted over the whole corpus and left out.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, checkpoint
from .mail import paragraphs, words

LEVELS = (1, 2, 3, 4)
LEAST_WORDS = 50
#: A closing paragraph that ends so many mails with differing text before it is boilerplate.
REPEATED = 3
#: Added to every count of a word and level.
SMOOTHING = 0.1
#: Bound of the model: so many labels are taken (by the hash of doc_id, the same at every size), and all words of their texts. Where
#: there are no labels, so many texts are seeded.
MAX_LABELS = 200_000
#: Thresholds of the formula that seeds levels where no label is given: (grade) between levels.
SEED_GRADES = (5.0, 9.0, 15.0)
_SENTENCE = re.compile(r"[.!?]+(?:\s|$)")
_VOWELS = re.compile(r"[aeiouy]+")


def seeded_level(text: str) -> int:
    """A level by sentence length and syllables a word, for corpora without labels."""
    found = words(text)
    if not found:
        return 1
    syllables = sum(max(1, len(_VOWELS.findall(w))) for w in found)
    grade = 0.39 * len(found) / max(1, len(_SENTENCE.findall(text))) + 11.8 * syllables / len(found) - 15.59
    return 1 + sum(grade > x for x in SEED_GRADES)


def _key(found: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(found).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


_PROSE = pa.schema([("doc_id", pa.int64()), ("english", pa.bool_()), ("levels", pa.list_(pa.int32())), ("before", pa.string()), ("closing", pa.string()), ("before_key", pa.int64()), ("closing_key", pa.int64())])


def prose(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, english, levels (by label) and text, the author's own prose, of each document that is English (lang begins with 'en') or
    labelled. labels: doc_id and levels, a row a document.

    A closing paragraph is left out if it closes REPEATED mails or more whose text before it differs. Texts are null where
    neither their words nor a label can make them count."""
    of = F.coalesce(F.lower(F.trim("lang")).startswith("en"), F.lit(False))
    picked = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", of.alias("english")).join(broadcast_if_small(labels), "doc_id", "left").filter("english OR levels IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, english, levels = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "english", "levels"))
            out = []
            for text, labelled in zip(batch.column(batch.schema.get_field_index("text")), np.asarray(levels.is_valid()), strict=True):
                own = paragraphs(text.as_py())
                before, closing = "\n\n".join(own[:-1]), own[-1] if own else ""
                first, last = words(before), words(closing)
                counts = labelled or len(first) + len(last) >= LEAST_WORDS
                out.append((before if counts else None, closing if counts else None, _key(first), _key(last) if last else None))
            made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)] if out else [pa.array([], f.type) for f in list(_PROSE)[3:]]
            yield pa.RecordBatch.from_arrays([ids, english, levels.cast(pa.list_(pa.int32())), *made], schema=_PROSE)

    schema = "doc_id long, english boolean, levels array<int>, before string, closing string, before_key long, closing_key long"
    found = checkpoint(picked.mapInArrow(run, schema))
    repeated = found.select("closing_key", "before_key").dropna().distinct().groupBy("closing_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= REPEATED)
    marked = found.join(broadcast_if_small(checkpoint(repeated.select("closing_key", F.lit(True).alias("boilerplate")))), "closing_key", "left")
    text = F.when(F.col("boilerplate"), F.col("before")).otherwise(F.concat_ws("\n\n", "before", "closing"))
    return marked.select("doc_id", "english", "levels", F.when(F.col("before").isNotNull(), text).alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """word, level, n of texts(text, level); level null: seeded by formula. The empty word counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text, level in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                level = seeded_level(text) if level is None else level
                for word, n in Counter(["", *words(text)]).items():
                    seen[word, level] += n
            yield pa.RecordBatch.from_pylist([{"word": w, "level": v, "n": n} for (w, v), n in seen.items()], _COUNTS)

    counted = texts.select(F.coalesce("text", F.lit("")), F.col("level").cast("int").alias("level")).mapInArrow(run, "word string, level int, n long")
    return counted.groupBy("word", "level").agg(F.sum("n").alias("n"))


_COUNTS = pa.schema([("word", pa.string()), ("level", pa.int32()), ("n", pa.int64())])


def usable_labels(labels: DataFrame) -> DataFrame:
    """doc_id and levels. Each label counts, also where raters differ; labels beside the levels don't."""
    picked = labels.filter(F.col("reading_level").isin(*LEVELS)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("reading_level").cast("int").alias("level")).dropna()
    return checkpoint(picked.orderBy(F.xxhash64("doc_id"), "level").limit(MAX_LABELS).groupBy("doc_id").agg(F.collect_list("level").alias("levels")))


def train(texts: DataFrame) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Words, log likelihood of each word (last row: any other word) by level, log prior by level, from texts as prose() gives them.

    Without any label the texts are seeded by formula, MAX_LABELS of them (by the hash of doc_id), and the prior is what levels they
    got."""
    labelled = texts.filter("levels IS NOT NULL").select("text", F.explode("levels").alias("level"))
    rows = _by_word(word_counts(labelled))
    if not rows:
        seeded = texts.filter("english AND text IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELS)
        rows = _by_word(word_counts(seeded.select("text", F.lit(None).cast("int").alias("level"))))
    prior = next((np.array([r[f"n{v}"] for v in LEVELS], float) for r in rows if not r.word), np.zeros(len(LEVELS))) + 1
    rows = [r for r in rows if r.word]
    n = np.array([[r[f"n{v}"] for v in LEVELS] for r in rows] + [[0] * len(LEVELS)], float).reshape(-1, len(LEVELS)) + SMOOTHING
    return {r.word: k for k, r in enumerate(rows)}, np.log(n / n.sum(axis=0)), np.log(prior / prior.sum())


def _by_word(counts: DataFrame) -> list:
    """The model's table: as many rows as words in MAX_LABELS texts at most."""
    return counts.groupBy("word").agg(*[F.sum(F.when(F.col("level") == v, F.col("n")).otherwise(0)).alias(f"n{v}") for v in LEVELS]).collect()


def levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and reading_level of each English document (lang begins with 'en') whose own prose has 50 words or more.

    Documents of null or empty text have no prose; a text with no known word gets the level of the highest prior, the
    lowest of several. Repeated rows give repeated rows."""
    texts = prose(documents, usable_labels(labels))
    model = documents.sparkSession.sparkContext.broadcast(train(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, likely, prior = model.value
        other = len(place)
        for batch in batches:
            ids, out = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = words(text.as_py())
                if len(found) >= LEAST_WORDS:
                    score = likely[[place.get(w, other) for w in found]].sum(axis=0) + prior
                    ids.append(doc)
                    out.append(LEVELS[int(np.argmax(score))])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.int32())], names=["doc_id", "reading_level"])

    return texts.filter("english AND text IS NOT NULL").select("doc_id", "text").mapInArrow(run, "doc_id long, reading_level int")


def profile(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents by source and reading level."""
    sources = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source")
    return found.join(sources, "doc_id").groupBy("source", "reading_level").agg(F.count(F.lit(1)).alias("n_documents"))
