"""Token counts: greedy longest-match word pieces, counted by a linear automaton.

The vocabulary is a trie with two roots: pieces that start a word, and pieces that continue one.
Each node has a failure link (the node reached after popping the longest pieces off its string)
and the number of pieces popped on the way, precomputed as in linear max-match tokenisation
(Song et al., Fast WordPiece Tokenization). A word's length in pieces is then found in one pass
over its characters, without building a piece.

Words are maximal runs of characters other than space and U+0009-U+000D. A vocabulary that has the
word-start mark as a piece of its own spells words no start piece fits: the mark counts as one token,
and pieces that continue a word follow. A vocabulary with byte pieces spells characters that are in no
single piece: each of their UTF-8 bytes is a token. Both are what Spelling tells; greedy longest match takes
them last. A word that can't be finished even so counts
as one unknown token. Defined results: a null or empty text has no words and no tokens; long words cost linear time; repeated rows are counted alike; an empty
table gives no rows; columns named like a result are replaced.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from talkloom.llm.common import received, share, small_batches

#: Words whose counts are kept; beyond that the cache starts anew.
CACHE = 200_000
START, INSIDE = 0, 1
_WIDTH = 21  # bits of a code point


def piece_sets(model_path: str) -> tuple[list[str], list[str]]:
    """Pieces that start a word and pieces that continue one, from a sentencepiece vocabulary; without
    the mark alone and the byte pieces, which spelling() tells."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    plain = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return [p[1:] for p in plain if p[0] == "▁" and len(p) > 1 and "▁" not in p[1:]], [p for p in plain if "▁" not in p]


@dataclass(frozen=True)
class Spelling:
    """What a vocabulary has beside its plain pieces: the word-start mark alone, and all byte pieces."""

    mark: bool = False
    octets: bool = False


def spelling(model_path: str) -> Spelling:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    known = range(sp.get_piece_size())
    return Spelling(any(sp.id_to_piece(i) == "▁" for i in known), sum(sp.is_byte(i) for i in known) == 256)


class Automaton:
    """go: child by (node, code point) in one dict; fail and pops: by node; -1: no failure link."""

    def __init__(self, starts: Iterable[str], insides: Iterable[str], spelling: Spelling = Spelling()):
        go: dict[int, int] = {}
        children: list[list[tuple[int, int]]] = [[], []]
        ends = [False, False]
        for root, pieces in ((START, starts), (INSIDE, insides)):
            for piece in pieces:
                at = root
                for ch in piece:
                    key = at << _WIDTH | ord(ch)
                    nxt = go.get(key)
                    if nxt is None:
                        nxt = go[key] = len(ends)
                        children[at].append((ord(ch), nxt))
                        children.append([])
                        ends.append(False)
                    at = nxt
                ends[at] = True
        ends[START] = ends[INSIDE] = False
        fail, pops = [-1] * len(ends), [0] * len(ends)
        if spelling.mark:
            fail[START], pops[START] = INSIDE, 1  # nothing read of the word yet: only its mark is popped
        queue = deque([START, INSIDE])
        while queue:
            at = queue.popleft()
            for ch, child in children[at]:
                if ends[child]:
                    fail[child], pops[child] = INSIDE, 1
                else:
                    z, n = fail[at], pops[at]
                    if at == INSIDE:
                        z = INSIDE if spelling.octets else -1  # go has ch there, but no piece ends with it
                        nxt = None
                    else:
                        while z != -1 and (nxt := go.get(z << _WIDTH | ch)) is None and not (z == INSIDE and spelling.octets):
                            n += pops[z]
                            z = fail[z]
                    if z != -1:
                        fail[child], pops[child] = (nxt, n) if nxt is not None else (INSIDE, n + len(chr(ch).encode()))
                queue.append(child)
        self.go, self.fail, self.pops = go, fail, pops
        self.octets = spelling.octets

    def count(self, word: str) -> int:
        """Pieces of greedy longest match, or 0 where it fails."""
        go, fail, pops = self.go, self.fail, self.pops
        at, n = START, 0
        for ch in word:
            code = ord(ch)
            while (nxt := go.get(at << _WIDTH | code)) is None:
                n += pops[at]
                if at == INSIDE and self.octets:
                    n += len(ch.encode())
                    nxt = INSIDE
                    break
                at = fail[at]
                if at == -1:
                    return 0
            at = nxt
        while at != INSIDE:
            n += pops[at]
            at = fail[at]
            if at == -1:
                return 0
        return n


def count_tokens(docs: DataFrame, starts: Iterable[str], insides: Iterable[str], text: str = "text", spelling: Spelling = Spelling()) -> DataFrame:
    """Adds n_words, n_tokens and n_unknown (words that are one unknown token), all long.

    The automaton grows with the vocabulary only and is broadcast.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = share(spark, Automaton(starts, insides, spelling))
    new = ["n_words", "n_tokens", "n_unknown"]
    plain = docs.select(*[c for c in docs.columns if c not in new])
    schema = T.StructType(plain.schema.fields + [T.StructField(n, T.LongType()) for n in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = received(shared)

        class Counts(dict):
            def __missing__(self, word: bytes) -> int:
                n = automaton.count(word.decode())
                if len(self) >= CACHE:
                    self.clear()
                if len(word) < 64:
                    self[word] = n
                return n

        counts = Counts()
        for batch in batches:
            got = []
            for s in batch.column(batch.schema.get_field_index(text)):
                words = (s.as_py() or "").encode().split()
                each = list(map(counts.__getitem__, words))
                unknown = each.count(0)
                got.append((len(words), sum(each) + unknown, unknown))
            cols = [pa.array([x[k] for x in got], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=schema.names)

    return plain.mapInArrow(run, schema)
