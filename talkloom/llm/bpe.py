"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

The model is serialised directly from the vocabulary: each token's bytes are mapped to printable
characters (one per byte), its score is its negative rank, and the normaliser is the identity, so
that sentencepiece's merges (best score first, leftmost of equals) are the merges by rank. Each
match of the split pattern is encoded by itself; a match that is a token as a whole is that token.
Ids are ranks: the model's ids less one, as id 0 is the unknown piece that sentencepiece demands.

Defined results: a null text counts as empty, has no ids and decodes to no bytes. Texts of any
length are encoded whole, also those without a space; the caches are bounded in bytes. Repeated rows are encoded alike, an
empty table gives no rows. encode() keeps the input's other columns; a column that bears the name
of a result column is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from talkloom.llm.common import small_batches

#: Matches, and chunks, whose ids are kept; beyond that a cache starts anew before the next batch.
CACHE = 200_000
#: Longer ones are encoded each time: a cache holds at most CACHE times this many characters.
LONGEST_KEPT = 64
#: The pattern for which texts may be cut at spaces before they are split (the one of the public rank files).
CUT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def byte_chars() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else 256 and up."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(other)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The bytes of a sentencepiece model: an unknown piece, then the tokens by rank."""
    chars = byte_chars()
    score = lambda x: _varint(2 << 3 | 5) + struct.pack("<f", x)
    pieces = [_field(1, b"<unk>") + score(0.0) + _field(3, 2)]
    for token in sorted(ranks, key=ranks.get):
        pieces.append(_field(1, "".join(map(chars.__getitem__, token)).encode()) + score(-float(ranks[token])) + _field(3, 1))
    minus_one = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, minus_one) + _field(42, minus_one) + _field(43, minus_one)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes on one worker. Ranks must be 0, 1, 2 and so on, with all single bytes.

    With CUT_PATTERN a text is cut into chunks at places where the pattern can never match across:
    before a space that follows another character than white space. With another pattern it is
    split as a whole. Chunks and matches recur, so the ids of short ones are kept, up to CACHE of each.
    """

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.split = regex.compile(pattern).findall
        self.may_cut = pattern == CUT_PATTERN
        self.runs = regex.compile(r"\s ?(?=\s)|\s$").search
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.to_chars = {b: c for b, c in enumerate(byte_chars())}
        to_byte = {c: b for b, c in self.to_chars.items()}
        pieces = [self.sp.id_to_piece(i) for i in range(1, self.sp.get_piece_size())]
        self.token = [bytes(map(to_byte.__getitem__, p)) for p in pieces]
        self.decimal = [str(i) for i in range(len(pieces))]
        self.whole = {t: (i,) for i, t in enumerate(self.token)}
        self.matches: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[tuple[int, ...], str, bytes]] = {}

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.may_cut or self.runs(text):  # white space of two characters or more: no cut may fall into it
            return self.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]

    def learn(self, chunks: set[str]) -> dict[str, tuple[tuple[int, ...], str, bytes]]:
        """Fills the caches for these chunks; the model sees each unknown match once. Returns what is too long to be kept."""
        if len(self.chunks) > CACHE:
            self.chunks.clear()
        if len(self.matches) > CACHE:
            self.matches.clear()
        new = [c for c in chunks if c not in self.chunks]
        found = [self.split(c) for c in new] if self.may_cut else [[c] for c in new]  # else chunks are matches
        unknown, once = [], {}
        for m in {m for x in found for m in x if m not in self.matches}:
            ids = self.whole.get(m.encode())
            if ids is None:
                unknown.append(m)
            else:
                self.matches[m] = ids
        mapped = [m.encode().decode("latin-1").translate(self.to_chars) for m in unknown]
        for m, ids in zip(unknown, self.sp.encode(mapped, num_threads=1) if mapped else []):
            (self.matches if len(m) <= LONGEST_KEPT else once)[m] = tuple(i - 1 for i in ids)
        long = {}
        for c, x in zip(new, found):
            ids = tuple(chain.from_iterable(self.matches[m] if m in self.matches else once[m] for m in x)) if once else tuple(chain.from_iterable(map(self.matches.__getitem__, x)))
            (self.chunks if len(c) <= LONGEST_KEPT else long)[c] = ids, ",".join(map(self.decimal.__getitem__, ids)), self.decode(ids)
        return long

    def encode(self, texts: list[str]) -> Iterator[tuple[list[tuple[int, ...]], str, bytes]]:
        """For each text: its ids by chunk, the ids in decimal, and the decoded bytes."""
        cuts = [self.cut(t) for t in texts]
        long = self.learn(set(chain.from_iterable(cuts)))
        for chunks in cuts:
            got = [self.chunks[c] if c in self.chunks else long[c] for c in chunks] if long else list(map(self.chunks.__getitem__, chunks))
            yield [x[0] for x in got], ",".join([x[1] for x in got if x[1]]), b"".join([x[2] for x in got])

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """Adds token_ids (unless with_ids is false), n_tokens, ids_sha256, decoded (the ids decoded
    again; unless with_ids is false) and decoded_sha256.

    The model, about a megabyte for 50,000 tokens, is made on the driver from the given file and
    broadcast: its size is that of the vocabulary.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(serialise(load_ranks(ranks_path)))
    new = [("token_ids", T.ArrayType(T.IntegerType())), ("decoded", T.BinaryType())] if with_ids else []
    new += [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    names = {n for n, _ in new}
    kept = [c for c in docs.columns if c not in names]
    plain = docs.select(*kept)
    schema = T.StructType([f for f in plain.schema.fields if with_ids or f.name != text] + [T.StructField(n, t) for n, t in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(model.value, pattern)
            ids_of, n, said, decoded, back = [], [], [], [], []
            texts = [s or "" for s in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            for ids, decimal, raw in codec.encode(texts):
                n.append(sum(map(len, ids)))
                said.append(hashlib.sha256(decimal.encode()).hexdigest())
                decoded.append(hashlib.sha256(raw).hexdigest())
                if with_ids:
                    ids_of.append(list(chain.from_iterable(ids)))
                    back.append(raw)
            old = [(name, batch.column(i)) for i, name in enumerate(batch.schema.names) if with_ids or name != text]
            cols = [c for _, c in old] + ([pa.array(ids_of, pa.list_(pa.int32())), pa.array(back, pa.binary())] if with_ids else [])
            cols += [pa.array(n, pa.int64()), pa.array(said, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return plain.mapInArrow(run, schema)
