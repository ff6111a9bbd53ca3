"""Byte-level BPE by a sentencepiece model that is written directly from a rank file; no tokenizer is trained.

Each byte becomes one printable character, so a token of the rank file becomes a piece of as many characters. A piece's
score is its negative rank and the normaliser is the identity: sentencepiece's BPE, which merges the adjacent pair with
the best score, then makes the merges that the ranks define. Texts are cut into pre-tokens by a pattern and each is
encoded by itself; ids are decoded by mapping pieces' characters back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, text_or_empty

#: A space between two white-space characters (or before the end) is where words can't be cut off by themselves.
_RUN = re.compile(r"\s (?:\s|\Z)")

#: Patterns whose pre-tokens have a space only in front, or are white space altogether. Fixed value: the pattern as published.
SPACED = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",)
#: Bytes of a worker's memory of units, about; it starts anew when full. Longer units are not remembered.
MEMORY, LONGEST = 128 << 20, 64
#: Texts whose new units are encoded together.
BLOCK = 256


def byte_characters() -> list[str]:
    """The character of each byte: itself where it is printable Latin-1, else one from U+0100 on, in byte order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line has a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, kind: int) -> bytes:
    return _varint(number << 3 | kind)


def _number(number: int, n: int) -> bytes:
    return _field(number, 0) + _varint(n & (1 << 64) - 1)


def _bytes(number: int, b: bytes) -> bytes:
    return _field(number, 2) + _varint(len(b)) + b


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised model. Ids are ranks, so ranks must run from 0 without gaps; the unknown piece follows them."""
    ordered = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must run from 0 without gaps")
    chars = byte_characters()
    out = bytearray()
    for rank, token in enumerate(ordered):
        piece = "".join(chars[b] for b in token).encode()
        out += _bytes(1, _bytes(1, piece) + _field(2, 5) + struct.pack("<f", -float(rank)))
    out += _bytes(1, _bytes(1, b"<unk>") + _field(2, 5) + struct.pack("<f", 0.0) + _number(3, 2))
    # Trainer: BPE; the unknown id; no ids for start, end and padding. Normaliser: identity, nothing added or escaped.
    trainer = _number(3, 2) + _number(4, len(ordered) + 1) + _number(40, len(ordered)) + _number(41, -1) + _number(42, -1) + _number(43, -1)
    normaliser = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return bytes(out + _bytes(2, trainer) + _bytes(3, normaliser))


class Codec:
    """Encodes texts to ids and decodes ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes | None = None):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model or model_bytes(ranks))
        self.ranks, self.find, self.spaced = ranks, regex.compile(pattern).findall, pattern in SPACED
        self.to_chars = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        back = {c: b for b, c in enumerate(byte_characters())}
        self.id_bytes = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(ranks))]
        self.id_names = [str(i) for i in range(len(ranks))]
        self.known: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def units(self, text: str) -> list[str]:
        """text in pieces that are cut into pre-tokens without regard to what stands around them. With a SPACED pattern
        a single space with something else on either side starts a new pre-token, and a word can be taken with the
        space before it; with any other each pre-token is a piece."""
        if not self.spaced or _RUN.search(text):
            return self.find(text)
        first, *rest = text.split(" ")
        return [first, *map(" ".__add__, rest)] if first else list(map(" ".__add__, rest))

    def _tokens(self, unit: str) -> list[str]:
        if not self.spaced or (unit[1:].isalpha() and (unit[0] == " " or unit[0].isalpha())):
            return [unit]
        return self.find(unit)

    def learn(self, units: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of new units; sentencepiece gets all their new pre-tokens in one call. Short ones are remembered."""
        tokens = {u: self._tokens(u) for u in units}
        raw = {t: t.encode("utf-8") for t in set(chain.from_iterable(tokens.values()))}
        ids = {t: (self.ranks[b],) if b in self.ranks else None for t, b in raw.items()}
        rest = [t for t, found in ids.items() if found is None]
        pieces = self.model.encode([raw[t].decode("latin-1").translate(self.to_chars) for t in rest], num_threads=1)
        ids |= dict(zip(rest, map(tuple, pieces), strict=True))
        found = {u: ids[ts[0]] if len(ts) == 1 else tuple(chain.from_iterable(map(ids.__getitem__, ts))) for u, ts in tokens.items()}
        short = {u: x for u, x in found.items() if len(u) <= LONGEST}
        more = sum(4 * len(u) + 8 * len(x) for u, x in short.items()) + 160 * len(short)
        if self.held + more > MEMORY:
            self.known, self.held = {}, 0
        self.known |= short
        self.held += more
        return found

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text."""
        for at in range(0, len(texts), BLOCK):
            units = list(map(self.units, texts[at : at + BLOCK]))
            here = {u: self.known.get(u) for u in set().union(*units)}
            if new := [u for u, ids in here.items() if ids is None]:
                here |= self.learn(new)
            for of_text in units:
                yield list(chain.from_iterable(map(here.__getitem__, of_text)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.id_bytes.__getitem__, ids))

    def names(self, ids: list[int]) -> str:
        return " ".join(map(self.id_names.__getitem__, ids))


def _coded(docs: DataFrame, ranks_path: str, pattern: str, doc_col: str, text_col: str, schema: str, columns) -> DataFrame:
    bound_batches(docs.sparkSession)
    ranks = read_ranks(ranks_path)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, model_bytes(ranks)))  # the size of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, model = shared.value
        codec = Codec(ranks, pattern, model)
        for batch in batches:
            ids = codec.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns(codec, ids)], names=[x.split()[0] for x in schema.split(", ")])

    kind = docs.schema[doc_col].dataType.simpleString()
    return docs.select(F.col(doc_col), text_or_empty(text_col)).mapInArrow(run, schema.replace("doc_id long", f"doc_id {kind}"))


def encode(docs: DataFrame, *, ranks_path: str, pattern: str, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>), decoded (binary): ids and the bytes they stand for. Null texts count as empty and have no ids."""
    def columns(codec: Codec, all_ids) -> list[pa.Array]:
        ids = list(all_ids)
        return [pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(x) for x in ids], pa.binary())]

    return _coded(docs, ranks_path, pattern, doc_col, text_col, "doc_id long, ids array<int>, decoded binary", columns)


def digests(docs: DataFrame, *, ranks_path: str, pattern: str, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by a space), decoded_sha256, one row per row of docs.

    What encode() returns, digested where it is made. Null texts count as empty: no ids, and digests of nothing.
    Row order, repeated ids, null ids and other columns don't matter.
    """
    def columns(codec: Codec, all_ids) -> list[pa.Array]:
        counts, names, decoded = [], [], []
        for ids in all_ids:
            counts.append(len(ids))
            names.append(hashlib.sha256(codec.names(ids).encode()).hexdigest())
            decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(names, pa.string()), pa.array(decoded, pa.string())]

    return _coded(docs, ranks_path, pattern, doc_col, text_col, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", columns)
