import base64
import random

import numpy as np
from strandlake.llm import leak

rng = random.Random(9)
WORDS = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(2, 10))) for _ in range(800)]


def passage(n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


ITEMS = [(k, "Choose the best answer.\n\n" + passage(80) + "\n\nQuestion: Who is it? A) x B) y C) z") for k in range(30)]
PASSAGES = [t.split("\n")[2] for _, t in ITEMS]


def altered(text, every=14):
    out = []
    for k, w in enumerate(text.split()):
        if k % every == every - 1:
            out += rng.choice([[], [w, "really"], ["other"]])
        else:
            out.append(w)
    return " ".join(out)


def wrapped(text, prefix="> "):
    w = text.split()
    return "\n".join(prefix + " ".join(w[i : i + 9]) for i in range(0, len(w), 9))


def found(spark, docs, items=ITEMS):
    df = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id bigint, text string, item_id string")
    it = spark.createDataFrame([(k, "s", t) for k, t in items], "item_id bigint, suite string, text string")
    return sorted((r.doc_id, r.item_id) for r in leak.leaks(df, it).collect())


def test_forms(spark):
    filler = [passage(60) for _ in range(40)]
    html = "Content-Type: text/html\n\n<p>" + "<br>\n".join(f"<b>{w}</b>" if k % 9 == 0 else w for k, w in enumerate(PASSAGES[3].split())) + "</p>"
    docs = [
        (0, "From: x\n\n" + filler[0] + "\n" + PASSAGES[0]), (1, "From: x\n\n" + wrapped(altered(PASSAGES[1])) + "\n" + filler[1]),
        (2, "From: x\nContent-Transfer-Encoding: base64\n\n" + base64.encodebytes((filler[2] + PASSAGES[2]).encode()).decode()), (3, html),
        (4, "From: x\n\n" + filler[4] + " " + " ".join(altered(PASSAGES[4]).split()[:46]) + " " + filler[5]), (5, "From: x\n\n" + " ".join(PASSAGES[5].split()[20:32]) + filler[6]),
        (6, "From: x\n\nChoose the best answer.\nQuestion: Who is it? A) x B) y C) z\n" + filler[7]), (7, None), (8, ""), (9, PASSAGES[9].upper() + filler[9] + PASSAGES[10]), (10, "From: x\n\n" + PASSAGES[0] * 3),
        *((20 + k, "From: x\n\n" + " ".join(filler)) for k in range(20)), (50, " ".join(filler) * 60 + PASSAGES[11] + filler[0] * 50),
    ]
    assert found(spark, docs) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (9, 9), (9, 10), (10, 0), (50, 11)]


def test_every_altered_half_is_found(spark):
    docs, want = [], []
    for k in range(300):
        item = rng.randrange(30)
        words = altered(PASSAGES[item], rng.randrange(9, 20)).split()
        at = rng.randrange(len(words) - 44)
        docs.append((k, passage(rng.randrange(5, 80)) + " " + " ".join(words[at : at + 44]) + " " + passage(30)))
        want.append((k, item))
    got = found(spark, docs)
    assert not set(got) - set(want) and len(set(want) & set(got)) >= 0.99 * len(want)


def test_empty_tables_and_blocks(spark, monkeypatch):
    assert found(spark, []) == [] and found(spark, [(1, PASSAGES[0])], [(1, None), (2, ""), (3, "short")]) == []
    monkeypatch.setattr(leak, "ITEMS", 7)
    assert found(spark, [(1, PASSAGES[0] + passage(20) + PASSAGES[29])]) == [(1, 0), (1, 29)]


def spans(text, codes, word_at):
    """Words that the best local alignment of a passage with a whole text spans, without filter and band."""
    best, end_of, begin_of = 0, 0, 0
    h = np.zeros(len(text) + 1, np.int64)
    start = np.zeros(len(text) + 1, np.int64)
    for i, c in enumerate(codes):
        new, begin = np.zeros_like(h), np.full_like(start, i + 1)
        diagonal = h[:-1] + np.where(text == c, 1, -leak.EDIT)
        from_ = np.where(h[:-1] > 0, start[:-1], i)
        up = h[1:] - leak.EDIT
        new[1:] = np.maximum(np.maximum(diagonal, up), 0)
        begin[1:] = np.where(new[1:] == diagonal, from_, np.where(new[1:] == up, start[1:], i + 1))
        ramp = np.arange(len(h)) * leak.EDIT
        top = np.maximum.accumulate(new + ramp)
        at = np.maximum.accumulate(np.where(new + ramp == top, np.arange(len(h)), 0))
        h, start = top - ramp, begin[at]
        if h.max() > best:
            best, end_of, begin_of = int(h.max()), i, int(start[h.argmax()])
    return int(word_at[end_of] - word_at[begin_of] + 1) if best else 0


def test_against_alignment_of_every_pair(spark):
    """One edited letter in 25 and rarer is within the budget: filter, bands and blocks lose nothing, and find nothing else."""
    docs = []
    for k in range(60):
        item = rng.randrange(30)
        words = PASSAGES[item].split()
        size = rng.choice([12, 20, 26, 34, 44, 80])
        at = rng.randrange(len(words) - size + 1)
        text = list(" ".join(words[at : at + size]))
        places = [i for i, c in enumerate(text) if c.isalpha()]
        for i in range(rng.randrange(25), len(places), rng.choice([25, 40, 90])):
            text[places[i]] = rng.choice("xyz")
        docs.append((k, passage(rng.randrange(5, 40)) + " " + "".join(text) + " " + passage(20)))
    want = []
    for doc, text in docs:
        code = leak.letters(text)
        for item, p in enumerate(PASSAGES):
            parts = [leak.letters(w) for w in p.split()]
            words = spans(code, np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts]))
            if words >= max(leak.LEAST_WORDS - leak.END, np.ceil(leak.PART * len(parts))):
                want.append((doc, item))
    assert 15 < len(want) < 60 and found(spark, docs) == want


def test_a_phrase_that_all_items_share_and_hits_in_small_parts(monkeypatch):
    shared = passage(40)
    ix = leak.index([(k, shared + " " + passage(30)) for k in range(25)])
    texts = [leak.letters(passage(30) + shared * 3 + passage(30)), leak.letters(passage(50))]
    whole = leak.candidates(texts, ix)
    monkeypatch.setattr(leak, "HITS", 40)
    assert all((a == b).all() for a, b in zip(whole, leak.candidates(texts, ix), strict=True)) and set(whole[1].tolist()) == set(range(25))


def test_many_items_in_one_pass_and_in_several(spark, monkeypatch):
    items = [(k, passage(40)) for k in range(90)]
    docs = [(k, "From: x\n\n" + passage(20) + " " + items[k][1]) for k in range(90)]
    assert found(spark, docs, items) == [(k, k) for k in range(90)]
    monkeypatch.setattr(leak, "ITEMS", 10)
    assert found(spark, docs, items) == [(k, k) for k in range(90)]


def test_letters():
    text = lambda s: leak.letters(s).tolist()
    assert text("> A-b\n> > c1") == text("abc1") and text("É») ß") == text("ess") and text("") == [] and text("日本") == []
