"""What a raw mail says: its parts decoded, and of these the prose that its author wrote."""

from __future__ import annotations

import binascii
import html
import re
from collections.abc import Iterator
from typing import NamedTuple

_HEADERS = re.compile(r"(?:(?:>?From [^\n]*|[A-Za-z][A-Za-z0-9-]*:[^\n]*(?:\n[ \t][^\n]*)*)(?:\n|\Z))+")
_TYPE = re.compile(r"^content-type:\s*([\w.+/-]+)", re.I | re.M)
_BOUNDARY = re.compile(r"boundary\s*=\s*(?:\"([^\"]+)\"|([^\s;]+))", re.I)
_CHARSET = re.compile(r"charset\s*=\s*\"?([\w.:-]+)", re.I)
_ENCODING = re.compile(r"^content-transfer-encoding:\s*([\w-]+)", re.I | re.M)
_ATTACHED = re.compile(r"^content-disposition:\s*attachment", re.I | re.M)
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]+")
_BREAKS = re.compile(r"<\s*br\s*/?>\n?", re.I)
_BLOCKS = re.compile(r"</?(?:p|div|h\d|li|ul|ol|tr|table|blockquote|body|html)\b[^>]*>", re.I)
_HIDDEN = re.compile(r"<(style|script)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.I | re.S)
_TAGS = re.compile(r"</?[A-Za-z][^<>]*>?")
#: Parts within parts are followed so deep; a mail nested deeper is read as plain text from there on.
DEPTH = 20


class Part(NamedTuple):
    kind: str
    attached: bool
    text: str


def newlines(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def split_headers(text: str) -> tuple[str, str]:
    """Headers and body; a text that begins with no header is all body."""
    at = _HEADERS.match(text)
    if not at or (at.end() < len(text) and text[at.end()] != "\n"):
        return "", text
    return at.group(), text[at.end() + 1 :]


def decode(body: str, encoding: str, charset: str) -> str:
    if encoding == "base64":
        # text after the padding isn't part of it
        code = _NOT_BASE64.sub("", body.partition("=")[0])
        raw = binascii.a2b_base64(code[: len(code) - (len(code) % 4 == 1)] + "=" * (-len(code) % 4))
    elif encoding == "quoted-printable":
        raw = binascii.a2b_qp(body.encode("utf-8", "surrogatepass"))
    else:
        return body
    try:
        return newlines(raw.decode(charset or "utf-8"))
    except LookupError:
        return newlines(raw.decode("utf-8", "replace"))
    except UnicodeDecodeError:
        return newlines(raw.decode("utf-8" if charset.lower().startswith("utf") else "latin-1", "replace"))


def plain_of_html(text: str) -> str:
    if "<!--" in text or "<s" in text.lower():
        text = _HIDDEN.sub("", text)
    return html.unescape(_TAGS.sub("", _BLOCKS.sub("\n\n", _BREAKS.sub("\n", text))))


def parts(text: str, depth: int = 0) -> Iterator[Part]:
    """The leaves of a mail in their order, decoded as far as they can be; what stands before and behind the parts of a
    multipart body comes as attached plain text. Of a damaged multipart body the parts that can be
    told apart are given; a missing or cut-off end closes at the end of the text."""
    headers, body = split_headers(text)
    kind = (_TYPE.search(headers) or _NOTHING).group(1).lower() if headers else "text/plain"
    if kind.startswith("multipart/") and depth < DEPTH and (b := _BOUNDARY.search(headers)):
        pieces = re.split(r"(?m)^--" + re.escape(b.group(1) or b.group(2)) + r"(--)?[ \t]*(?:\n|\Z)", body)
        if len(pieces) > 1:
            # pieces: text before, then of each boundary whether it closes, and the text behind
            for closes, piece in zip(["--", *pieces[1::2]], pieces[::2], strict=True):
                if not piece.strip():
                    continue
                if closes:  # before the first part or behind the last, so none of the message's own text
                    yield Part("text/plain", True, piece)
                else:
                    yield from parts(piece[1:] if piece.startswith("\n") else piece, depth + 1)
            return
    encoding = _ENCODING.search(headers)
    charset = _CHARSET.search(headers)
    attached = bool(_ATTACHED.search(headers))
    content = decode(body, encoding.group(1).lower() if encoding else "", charset.group(1) if charset else "")
    if kind == "message/rfc822" and depth < DEPTH:
        yield from parts(content, depth + 1)
    else:
        yield Part(kind, attached, plain_of_html(content) if kind == "text/html" else content)


class _Nothing:
    def group(self, _: int) -> str:
        return "text/plain"


_NOTHING = _Nothing()


def all_texts(text: str | None) -> list[str]:
    """The texts of all parts and attachments, also of those that begin with or are bytes; none for null and empty."""
    return [part.text for part in parts(newlines(text))] if text else []


#: How quoted lines begin.
QUOTE = r"[ \t]*(?:[>|»]|&gt;)"
_QUOTED = re.compile(rf"^{QUOTE}[^\n]*\n?", re.M)
_FORWARDED = re.compile(r"^[ \t]*-{3,} ?(?:original message|forwarded message|ursprüngliche nachricht|weitergeleitete nachricht|mensaje original|message d'origine)\b.*", re.I | re.M | re.S)
_ATTRIBUTION = re.compile(r"^(?:[^\n]*(?:\n[^\n]*)?\b(?:wrote|schrieb|écrit|escribió)\b[^\n]{0,80}:|[^\n]*(?:пише|написав|писав|さんは書きました)[^\n]{0,60}[:：])[ \t]*(?:\n|\Z)", re.M)
_SIGNATURE = re.compile(r"^(?:--|_{5,}|-{5,}|\*{5,}|={5,})[ \t]*(?:\n|\Z)(?s:.*)", re.M)
_LISTED = re.compile(r"[ \t]*(?:[-*•–+o] |\d{1,3}[.)] |\d{4}-\d\d-\d\d[ T]\d\d:)")
_SEPARATOR = re.compile(r"[,;\t|]")
_CELL = re.compile(r"[A-Za-z0-9_ .-]*")
_GREETING = re.compile(r"^[ \t]*(?:(?:hi|hello|hey|dear|good (?:morning|afternoon|evening)|hallo|guten tag)\b[^\n.]{0,50}|\w[\w'’]*(?: [\w'’]+){0,2})[ ]?(?:,|!|:|-|–)?[ \t]*$", re.I)
_CLOSING = re.compile(r"^(?:best|kind|warm|many)?[ \t]*(?:regards|wishes|cheers|thanks|thank you|sincerely|yours\b.*)[ \t]*[,.!]?$", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def _listed(line: str) -> bool:
    """An item of a list, a line of a log, or a row of a table (cells between separators, the last one a number)."""
    if _LISTED.match(line):
        return True
    if not line.rstrip()[-1:].isdigit():
        return False
    at = _SEPARATOR.search(line)
    return bool(at and _CELL.fullmatch(line, 0, at.start()) and _SEPARATOR.search(line, at.end()))


def paragraphs(text: str | None) -> list[str]:
    """The author's own paragraphs: of the first text that isn't attached, without quoted and forwarded mail, greetings,
    signature, log lines and lists. None for null and empty texts. A disclaimer is one of them: it is told by its standing in
    other mails too, see reading.prose."""
    if not text:
        return []
    body, fallback = None, None
    for part in parts(newlines(text)):
        if part.attached:
            continue
        if part.kind == "text/plain":
            body = part.text
            break
        if part.kind == "text/html" and fallback is None:
            fallback = part.text
    body = body if body is not None else fallback
    if not body:
        return []
    body = _QUOTED.sub("\n", body)
    body = _FORWARDED.sub("", body)
    body = _ATTRIBUTION.sub("\n", body)
    body = _SIGNATURE.sub("", body)
    kept = []
    for paragraph in re.split(r"\n[ \t]*\n", body):
        lines = [x for x in paragraph.split("\n") if x.strip() and not _listed(x)]
        if not kept and lines and _GREETING.match(lines[0]) and len(lines[0].split()) <= 6:
            lines = lines[1:]
        if lines and _CLOSING.match(lines[-1].strip()):
            lines = lines[:-1]
        lines = [x for x in lines if _WORD.search(x)]
        if lines:
            kept.append("\n".join(lines))
    return kept


def own_prose(text: str | None) -> str:
    """The author's own paragraphs as one text, a disclaimer among them."""
    return "\n\n".join(paragraphs(text))


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())
