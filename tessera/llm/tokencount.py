"""Token counts by a count-only Viterbi search over a unigram vocabulary.

The vocabulary is (piece, score) pairs; an Aho-Corasick automaton lists every piece that
occurs in a text, and dynamic programming carries, for each end position, the best score
and the number of pieces of the best path, nothing else.  Rules, as the public unigram
tokenizers have them: pieces that end at one place compete by score, a later candidate
replaces an earlier one only with a strictly larger score, and candidates come by
ascending start; a character without a piece of its own costs ``least score - 10`` and
falls back to its UTF-8 bytes; white space becomes the mark U+2581 and one mark is put in
front.  Scores add as doubles.

A text is cut where no piece can cross (before a mark that follows another character,
and around characters that are in no longer piece), so equal segments of a task are
searched once; a cache of at most ``CACHE`` segments bounds memory, a text's segments
are streamed.

Defined results: a null or empty text has 0 tokens; repeated rows each get their count.
"""
from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, col

MARK = "▁"
PENALTY = 10.0
CACHE = 400_000


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces and their scores of a public piece model file."""
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())
            if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


class Counting:
    """Token counts for one vocabulary; built once in each Python worker."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick
        self.auto = ahocorasick.Automaton()
        scores: dict[str, float] = {}
        for piece, score in vocabulary:
            if piece:
                scores.setdefault(piece, float(score))
        for piece, score in scores.items():
            self.auto.add_word(piece, (len(piece), score))
        if scores:
            self.auto.make_automaton()
        self.single = {p for p in scores if len(p) == 1}
        self.unknown = (min(scores.values()) if scores else 0.0) - PENALTY
        joined = {c for p in scores if len(p) > 1 for c in p}
        self.marks_lead = all(re.fullmatch(f"{MARK}*[^{MARK}]*", p, re.S) for p in scores)
        # segments: runs of marks and what follows them; characters that join no piece stand alone
        lone = "".join(re.escape(c) for c in "\n\r\t\x0b\x0c" if c not in joined)
        self.cut = re.compile(f"[{lone}]+|{MARK}*[^{MARK}{lone}]+|{MARK}+" if lone else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.cache: dict[str, int] = {}

    def segment(self, s: str) -> int:
        """Pieces of the best path over one segment."""
        n = len(s)
        low = float("-inf")
        best, count = [0.0] + [low] * n, [0] * (n + 1)
        if self.single.issuperset(s):
            # matches come by ascending end, the longest (earliest start) first at each end
            for end, (size, score) in self.auto.iter(s):
                score += best[end + 1 - size]
                if score > best[end + 1]:
                    best[end + 1], count[end + 1] = score, count[end + 1 - size] + 1
            return count[n]
        by_end: list[list] = [[] for _ in range(n)]
        if len(self.auto):
            for end, match in self.auto.iter(s):
                by_end[end].append(match)
        for end in range(n):
            for size, score in by_end[end]:
                score += best[end + 1 - size]
                if score > best[end + 1]:
                    best[end + 1], count[end + 1] = score, count[end + 1 - size] + 1
            if s[end] not in self.single and best[end] + self.unknown > best[end + 1]:
                best[end + 1] = best[end] + self.unknown
                count[end + 1] = count[end] + len(s[end].encode("utf-8", "surrogatepass"))
        return count[n]

    def of(self, text: str | None) -> int:
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if not self.marks_lead:
            return self.segment(marked)
        total, cache = 0, self.cache
        for s, k in Counter(self.cut.findall(marked)).items():
            c = cache.get(s)
            if c is None:
                if len(cache) >= CACHE:
                    cache.clear()
                c = self.segment(s)
                if len(s) <= 64:
                    cache[s] = c
            total += c * k
        return total


_BUILT: dict = {}


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens for every row; the vocabulary (a tokenizer's, of fixed size)
    goes to the workers as a broadcast."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary)
    src = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))

    def run(batches):
        if id(shared) not in _BUILT:
            _BUILT.clear()
            _BUILT[id(shared)] = (shared, Counting(shared.value))
        counting = _BUILT[id(shared)][1]
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([counting.of(t) for t in b.column(1).to_pylist()], pa.int64())],
                names=["doc_id", "n_tokens"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens bigint")
