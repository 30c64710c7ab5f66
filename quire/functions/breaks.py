"""Breaks of long texts as offsets: word wrap and sentence packing in linear time.

Word wrap is that of the standard library.  The text is cut into the wrapper's own tokens; a table of the tokens' ends tells, by
binary search, the last token that still fits a line.  A line is a pair of offsets
into the text: nothing grows from line to line, and a token longer than a line is
cut by moving an offset, so the work is linear in the text, for one endless word as
for many short ones.
"""

from __future__ import annotations

import re
import textwrap
from bisect import bisect_right
from itertools import accumulate

import numpy as np

_WRAPPER = textwrap.TextWrapper()


def munged(text: str) -> str:
    """Tabs expanded, white space characters as spaces."""
    return _WRAPPER._munge_whitespace(text)


def line_offsets(text: str, width: int) -> list[tuple[int, int]]:
    """First character and end of each line of ``textwrap.wrap``, in munged text."""
    sizes = [len(t) for t in _WRAPPER.wordsep_re.split(text) if t]
    ends = list(accumulate(sizes))
    lines: list[tuple[int, int]] = []
    token, at, n = 0, 0, len(ends)
    while token < n:
        if lines and text[at].isspace() and not text[at:ends[token]].strip():
            at = ends[token]
            token += 1
            if token == n:
                break
        begin = at
        fits = bisect_right(ends, begin + width, token)
        pieces, last, at = fits - token, at, ends[fits - 1] if fits > token else at
        if fits > token:
            last = max(begin, at - sizes[fits - 1])
        token = fits
        if token < n and ends[token] - at > width:
            # an over-long token fills the line, up to a hyphen if there is one
            room = width - (at - begin)
            cut = text.rfind("-", at, at + room)
            cut = cut + 1 if cut > at and text[at:cut].strip("-") else at + room
            last, at, pieces = at, cut, pieces + 1
        blank = not text[last:at].strip()
        if pieces > blank:
            lines.append((begin, last if blank else at))
    return lines


def wrap_lines(text: str, width: int) -> list[str]:
    text = munged(text)
    return [text[a:b] for a, b in line_offsets(text, width)]


def pack_sentences(text: str, max_length: int, min_length: int) -> list[str]:
    """The chunks of :func:`quire.functions.text.sentence_pack`.  Where a chunk that
    starts at sentence ``i`` ends follows from the sentences' cumulative lengths, for
    every ``i`` at once; the chunks are a walk along that table."""
    sentences = [s for s in map(str.strip, re.split("[.!?]+", text)) if s]
    n = len(sentences)
    ends = np.cumsum([len(s) + 2 for s in sentences], dtype=np.int64)  # each is written with a separator of 2
    starts = np.concatenate([[0], ends[:-1]])
    # a sentence joins while the chunk's length and its own stay under max_length
    after = np.maximum(np.searchsorted(ends, starts + max_length + 2, "left"), np.arange(1, n + 1)).tolist()
    chunks, at = [], 0
    while at < n:
        chunks.append(". ".join(sentences[at:after[at]]) + ".")
        at = after[at]
    return [c for c in chunks if len(c) > min_length]
