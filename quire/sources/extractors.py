"""Plain text extractors for :mod:`quire.sources.files`: ``bytes -> page texts``.

An extractor raises on input that is not its own; what it raises becomes the reason
of a failed attempt.
"""

from __future__ import annotations

import re


def utf8_text(content: bytes) -> list[str]:
    """The bytes as UTF-8 text; malformed bytes raise."""
    return [content.decode("utf-8")]


def html_paragraphs(content: bytes) -> list[str]:
    """The closed paragraphs without inner markup of an HTML document, a page each;
    a document that breaks off raises."""
    text = content.decode("utf-8")
    if "</html>" not in text:
        raise ValueError("document breaks off")
    return re.findall(r"<p>([^<>]*)</p>", text)


def html_stripped(content: bytes) -> list[str]:
    """The body of an HTML document, tags replaced by a space, as one page; a body
    with an ampersand's entity twice in a row (escaped over again) raises."""
    text = content.decode("utf-8")
    body = text[text.index("<body>") + 6:]
    if "&amp;&amp;" in body:
        raise ValueError("repeated entities")
    return [re.sub(r"<[^<>]*>", " ", body)]
