import base64

from strandlake.llm import mail

TEXT = "The first line of it.\nAnd a second one, quite long."


def wrap(body, headers="Content-Type: text/plain; charset=utf-8"):
    return f"From: a@b.example\nSubject: x\n{headers}\n\n{body}"


def test_encodings():
    b64 = base64.b64encode("Grüße\r\nzwei".encode()).decode()
    assert mail.all_texts(wrap(b64, "Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64")) == ["Grüße\nzwei"]
    assert mail.all_texts(wrap(b64[:-5], "Content-Type: text/plain\nContent-Transfer-Encoding: base64"))[0].startswith("Grüße")
    assert mail.all_texts(wrap("Gr=C3=BC=\n=C3=9Fe", "Content-Transfer-Encoding: quoted-printable")) == ["Grüße"]
    assert mail.all_texts(wrap("<p>a &amp; <b>b</b><br>\nc</p>", "Content-Type: text/html"))[0].split() == ["a", "&", "b", "c"]
    assert mail.all_texts(wrap(base64.b64encode("é".encode("latin-1")).decode(), "Content-Type: text/plain; charset=nonsense\nContent-Transfer-Encoding: base64"))


def test_headers():
    assert mail.split_headers("Delivered-To: x\nFrom a@b Mon, 1 Jan 2025\nSubject: y\n z\n\nbody") == ("Delivered-To: x\nFrom a@b Mon, 1 Jan 2025\nSubject: y\n z\n", "body")
    assert mail.split_headers("No header: but\na text") == ("", "No header: but\na text") and mail.split_headers("A: b\n") == ("A: b\n", "")


def test_multipart_whole_and_cut_off():
    parts = f"--B1\nContent-Type: text/plain\n\n{TEXT}\n--B1\nContent-Type: text/csv\nContent-Disposition: attachment\n\na,b\n"
    for end in ("--B1--\n", "", "--B"):
        texts = mail.all_texts(wrap(parts + end, 'Content-Type: multipart/mixed;\n boundary="B1"'))
        assert texts[0].strip() == TEXT and texts[1].startswith("a,b")
    assert mail.all_texts(wrap("no boundary at all", 'Content-Type: multipart/mixed; boundary="B1"')) == ["no boundary at all"]


def test_degenerate():
    assert mail.all_texts(None) == [] and mail.all_texts("") == [] and mail.own_prose(None) == "" and mail.own_prose("") == ""
    assert mail.all_texts("just text: with no header") and mail.own_prose(" \n\n ") == ""
    nested = "x"
    for k in range(60):
        nested = f"Content-Type: multipart/mixed; boundary=b{k}\n\n--b{k}\n{nested}\n--b{k}--\n"
    assert len(mail.all_texts(nested)) == 1
    for long in ("word " * 300_000, "a, b; " * 200_000, "> " * 200_000 + "x", "<b" * 200_000, " " * 500_000 + "x", "Hi " * 200_000, "\n" * 300_000 + "x", "-" * 300_000, "wrote: " * 100_000):
        mail.own_prose(wrap(long)), mail.all_texts(wrap(long)), mail.own_prose(wrap(long, "Content-Type: text/html"))
        mail.own_prose(long), mail.all_texts(long)
    assert len(mail.own_prose(wrap("word " * 300_000))) > 1_000_000


def test_own_prose():
    body = (
        "Hi Ann,\n\nOn Mon, 06 Jan 2025, B C wrote:\n> quoted text here\n» more of it\n\n" + TEXT + "\n\n- a list: 5 mL\n2025-01-12 20:35:44 INFO unit[6] lvl=0.87\n\n"
        "Last paragraph.\n\n-- \nB C\nTel. 1\n\nThe contents of this mail may be confidential. Delete it."
    )
    assert mail.own_prose(wrap(body)) == TEXT + "\n\nLast paragraph."
    assert mail.own_prose(wrap("Mine.\n\n-----Original Message-----\nFrom: x\n\nNot mine.")) == "Mine."
    mine = "I sent you the wrong spreadsheet by mistake on Monday, so please delete it and use the new one."
    assert mail.own_prose(wrap(mine + "\n\nThe old one was confidential.")) == mine + "\n\nThe old one was confidential."
    assert mail.own_prose(wrap("<p>Dear Q,</p><p>Mine <b>too</b>.</p><p>&gt; quoted</p>", "Content-Type: text/html")) == "Mine too."


def test_text_behind_bytes_and_around_parts():
    raw = bytes(range(256)) * 12 + b"\n" + TEXT.encode()
    attachment = "Content-Type: application/octet-stream\nContent-Transfer-Encoding: base64\nContent-Disposition: attachment\n\n" + base64.b64encode(raw).decode()
    whole = wrap(f"Before: {TEXT}\n--B1\nContent-Type: text/plain\n\nMine.\n--B1\n{attachment}\n--B1--\nBehind: {TEXT}\n", 'Content-Type: multipart/mixed; boundary="B1"')
    texts = mail.all_texts(whole)
    assert len(texts) == 4 and sum(TEXT in t for t in texts) == 3
    assert mail.own_prose(whole) == "Mine."
