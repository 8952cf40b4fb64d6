"""Byte-level BPE encoding and decoding with the `tokenizers` library over Arrow batches.

The rank file is turned into a `tokenizers` BPE model: bytes become the printable
characters of the byte-level alphabet, and every split of a token into two known
tokens becomes a merge whose priority is the token's rank, as a rank-driven merge has
it; a piece that is itself a token is taken whole. Texts are split by the pattern first; each distinct piece is encoded once per
worker and remembered, up to CACHE pieces. Letters and digits newer than this Python's
Unicode tables may be classed otherwise by the pattern's two implementations; texts with
such characters go through the rank-driven library itself.

Defined results: a null or empty text has no ids; decoding gives back the bytes of the
text. `encode` keeps all columns of its input; added names get a leading underscore
where they clash. Rows repeat as they come, and an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import models

from .common import fresh, lean

#: Remembered pieces of one worker.
CACHE = 400_000


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def bpe_model(ranks: dict[bytes, int]) -> models.BPE:
    """A `tokenizers` BPE over byte characters that merges in the order of the ranks."""
    to = byte_characters()
    spell = {token: "".join(to[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        for k in range(1, len(token)):
            if token[:k] in ranks and token[k:] in ranks:
                merges.append((spell[token[:k]], spell[token[k:]]))
    return models.BPE(vocab={spell[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0)


def unsettled(pattern: str = r"[\p{L}\p{N}]") -> tuple[str, regex.Pattern]:
    """The first of the letters and digits that this Python's Unicode tables do not have yet, and their pattern."""
    known = regex.compile(pattern).match
    new = [c for c in range(0x378, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn" and known(chr(c))]
    held = set(new)
    runs = list(zip((c for c in new if c - 1 not in held), (c for c in new if c + 1 not in held)))
    first = chr(new[0]) if new else chr(sys.maxunicode)
    return first, regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]" if runs else "(?!)")


class Codec:
    """Encodes texts to ids with byte offsets, and decodes ids to bytes."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.model = bpe_model(self.ranks)
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}
        self.spelling = dict(enumerate(byte_characters()))
        self.first_new, found = unsettled()
        self.unsettled = found.search
        self.direct = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        for text in texts:
            if text and not text.isascii() and max(text) >= self.first_new and self.unsettled(text):
                yield self.direct.encode_ordinary(text)
                continue
            known = self.known
            if len(known) > CACHE:
                known.clear()
            ids: list[int] = []
            for piece in self.pieces(text):
                coded = known.get(piece)
                if coded is None:
                    # each byte as the character that stands for it, as the model has its tokens
                    spelled = piece.encode().decode("latin-1").translate(self.spelling)
                    coded = [t.id for t in self.model.tokenize(spelled)]
                    if len(piece) < 64:
                        known[piece] = coded
                ids += coded
            yield ids

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, ids: list[int]) -> list[int]:
        """The byte at which each token ends; a token may end inside a character."""
        return np.cumsum([len(self.bytes_of[i]) for i in ids], dtype=np.int64).tolist()

    def text(self, ids: Iterable[int]) -> str:
        """Decoded text; characters that the ids hold only in part become U+FFFD."""
        return self.decode(ids).decode("utf-8", "replace")


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each file and worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _texts(column: pa.Array) -> Iterator[list[str]]:
    """Lists of 64 texts, nulls as empty."""
    for lo in range(0, len(column), 64):
        yield [x or "" for x in column.slice(lo, 64).to_pylist()]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """df with token_ids array<int>, token_ends array<int> (byte offsets) and decoded string."""
    ids_name, ends_name = fresh(df, "token_ids"), fresh(df, "token_ends")
    schema = T.StructType([*df.schema.fields, T.StructField(ids_name, T.ArrayType(T.IntegerType())), T.StructField(ends_name, T.ArrayType(T.IntegerType()))])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                coded = list(own.encode([x or "" for x in part.column(at).to_pylist()]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(coded, pa.list_(pa.int32())), pa.array([own.offsets(x) for x in coded], pa.list_(pa.int32()))],
                    names=[*part.schema.names, ids_name, ends_name],
                )

    return df.mapInArrow(lean(run), schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df with the decoded text; characters cut at either end become U+FFFD, null ids give null."""
    out = fresh(df, out)
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = [None if x is None else own.text(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(lean(run), T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, by encoding and decoding its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            n, coded_as, decoded_as = [], [], []
            for texts in _texts(batch.column(1)):
                for ids in own.encode(texts):
                    n.append(len(ids))
                    coded_as.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                    decoded_as.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(coded_as, pa.string()), pa.array(decoded_as, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
