"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton of the vocabulary's pieces enumerates every match in a
text; for each position the best score of a path that ends there and the number
of its pieces are carried, nothing else.  Tie rules are the tokenizer's: a path
replaces another only if its score is greater, and paths are tried from the
longest last piece to the shortest, so of equal scores the longest last piece
stays.  A character that no piece matches alone may be unknown, with the least
score of the vocabulary less 10; an unknown character counts its UTF-8 bytes.

Spaces become U+2581, and a text that is not empty gets one in front.  No piece
has U+2581 after another character, and none holds a character outside the
vocabulary's alphabet; there a path must break, so a text is the sum of its
segments, whose counts are kept by a task in a bounded cache.

Defined cases: a null or empty text has 0 tokens; repeated rows are counted each;
long segments are counted whole but not kept; an empty table gives an empty
result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import lean, require

SPACE = "▁"


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model's ordinary pieces."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class Counter:
    def __init__(self, vocabulary, cache: int = 400_000, longest: int = 64):
        import ahocorasick
        self.auto = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.alphabet = {c for piece, _ in vocabulary for c in piece} | {SPACE}
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min(score for _, score in vocabulary) - 10.0
        self.cache, self.most, self.longest = {}, cache, longest
        inner = any(SPACE in p.lstrip(SPACE) for p, _ in vocabulary)
        self.segments = re.compile("[^\x00]+" if inner else f"{SPACE}*[^{SPACE}\x00]+|{SPACE}+").findall

    def path(self, s: str) -> int:
        """Pieces of the best path over one segment."""
        n = len(s)
        best, count = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        at = 0
        holes = [i for i, c in enumerate(s) if c not in self.single] if not self.single.issuperset(s) else []
        for end, (size, score) in self.auto.iter(s):
            end += 1
            while at < len(holes) and holes[at] + 1 < end:
                self._unknown(best, count, s, holes[at])
                at += 1
            v = best[end - size] + score
            if v > best[end]:
                best[end] = v
                count[end] = count[end - size] + 1
        for i in holes[at:]:
            self._unknown(best, count, s, i)
        return count[n]

    def _unknown(self, best, count, s, i):
        v = best[i] + self.unknown
        if v > best[i + 1]:
            best[i + 1], count[i + 1] = v, count[i] + len(s[i].encode())

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        total = 0
        foreign = set(text) - self.alphabet - {" "}
        for c in foreign:
            total += text.count(c) * len(c.encode())
        for c in foreign:
            text = text.replace(c, "\x00")
        cache = self.cache
        for s in self.segments(SPACE + text.replace(" ", SPACE)):
            n = cache.get(s)
            if n is None:
                n = self.path(s)
                if len(s) <= self.longest:
                    if len(cache) >= self.most:
                        cache.clear()
                    cache[s] = n
            total += n
        return total


def counts(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, n_tokens."""
    require(docs, doc_id, text)
    slim = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("t"))

    def run(batches):
        count = Counter(load_vocabulary(model_path))
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [t.as_py() or "" for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                     pa.array([count(t) for t in texts], pa.int64())], names=["id", "n_chars", "n_tokens"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return slim.mapInArrow(lean(run), f"id {kind}, n_chars long, n_tokens long").withColumnRenamed("id", doc_id)
