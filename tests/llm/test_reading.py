import random

import pyarrow.parquet as pq
from strandlake.llm import reading

rng = random.Random(3)
VOCABULARY = {1: "cat dog red sat ran big".split(), 2: "kitchen student borrowed yellow manager careful".split(), 3: "committee evaluated adequate previous supplier technical".split(), 4: "epistemological destabilises heterogeneity juxtaposition stoichiometry".split()}


def mail(level, n=70, foreign=0):
    own = [rng.choice(VOCABULARY[level]) for _ in range(n - foreign)] + [rng.choice(VOCABULARY[level % 4 + 1]) for _ in range(foreign)]
    quoted = "\n".join("> " + " ".join(rng.choice(VOCABULARY[5 - level]) for _ in range(12)) for _ in range(20))
    return f"From: x\n\nHi Bo,\n\n{' '.join(own)}.\n\nA B wrote:\n{quoted}\n\n-- \nA B"


def test_levels_in_spite_of_rating_errors(spark):
    truth = {k: k % 4 + 1 for k in range(400)}
    docs = [(k, mail(v, foreign=20), "EN-gb" if k % 2 else "en", 7) for k, v in truth.items()] + [(900, mail(1, 40), "en", 0), (901, None, "en", 0), (902, "", "en", 0), (903, mail(2), "de", 0), (904, mail(2), None, 0)]
    labels = [(k, truth[k] if rng.random() > 0.1 else rng.randrange(1, 5), "r") for k in range(0, 400, 3) for _ in range(2)] + [(1, None, "r"), (1, 9, "r"), (None, 1, "r"), (5000, 1, "r")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, reading_level int")
    got = {r.doc_id: r.reading_level for r in reading.levels(df, spark.createDataFrame(labels, "doc_id bigint, reading_level int, rater string")).collect()}
    assert got == truth


def test_disclaimers_are_told_by_the_mails_they_close(spark):
    notice = "Nobody but the addressee may read these lines, whatever they say. Thirty words of it stand below many mails."
    mine = "I sent you the wrong spreadsheet by mistake on Monday, so please delete it and keep the new one confidential."
    texts = [f"From: x\n\n{mail(k % 4 + 1).split(chr(10) * 2)[2]}\n\n{notice}" for k in range(5)]
    texts += [f"From: x\n\nThe same {'word ' * 60}\n\nIts only copy closes like this."] * 4  # copies of one mail
    texts += [f"From: x\n\n{'word ' * 60}\n\n{mine}", f"From: x\n\n{notice}", f"From: x\n\n{notice}\n\n{'more ' * 60}", "From: x\n\nshort", None, ""]
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    none = reading.usable_labels(spark.createDataFrame([], "doc_id bigint, reading_level int, rater string"))
    got = {r.doc_id: r.text for r in reading.prose(df, none).collect()}
    assert all("addressee" not in got[k] for k in range(5)) and all(got[k].endswith("closes like this.") for k in range(5, 9))
    assert got[9].endswith("new one confidential.") and got[11].startswith("Nobody") and [got[k] for k in (10, 12, 13, 14)] == [None] * 4
    assert sorted(got) == list(range(15))


def test_every_word_of_the_labelled_texts_is_in_the_model(spark):
    df = spark.createDataFrame([(k, f"From: x\n\n{'word ' * 50} only{chr(97 + k // 26)}{chr(97 + k % 26)}", "en") for k in range(300)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(k, 1 + k % 3, "r") for k in range(0, 300, 2)] + [(9999, 4, "r")], "doc_id bigint, reading_level int, rater string")
    place, likely, prior = reading.train(reading.prose(df, reading.usable_labels(labels)))
    assert set(place) == {"word", *(f"only{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(0, 300, 2))} and likely.shape == (152, 4)
    assert abs(prior - __import__("numpy").log([51 / 154, 51 / 154, 51 / 154, 1 / 154])).max() < 1e-9


def test_without_labels_and_empty(spark):
    df = spark.createDataFrame([(k, mail(k % 4 + 1), "en") for k in range(200)], "doc_id bigint, text string, lang string")
    none = spark.createDataFrame([], "doc_id bigint, reading_level int, rater string")
    assert reading.levels(df, none).count() == 200
    assert reading.levels(df.limit(0), none).count() == 0


def test_held_out_labels(spark):
    """Raters of the test data err at about 4 in 100."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/reading_labels.parquet")
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r.reading_level for r in reading.levels(documents, labels.filter("doc_id % 2 = 0")).collect()}
    held = pq.read_table(f"{folder}/reading_labels.parquet").to_pylist()
    right = [got.get(x["doc_id"]) == x["reading_level"] for x in held if x["doc_id"] % 2]
    assert sum(right) >= 0.93 * len(right) > 300
