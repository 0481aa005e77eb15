"""Encoding of a whole corpus with a public byte-level BPE tokenizer, and back.

The vocabulary file is a parameter; the default is found in the installed ``public_tokenizers``
package. It is read by every Python worker from its own path and never shipped through the driver.

Defined cases: a null and an empty text have no tokens (empty list); strings of special tokens
inside a text are ordinary text; texts of any length are encoded whole; repeated rows stay repeated.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "byte_bpe_50k.json"

#: The white space of the tokenizer's own splitting pattern (fixed values).
_SPACE = "\\t\\n\\v\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECE = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")

#: Parts of a piece: a run of letters, digits or marks that is surely followed by another class.
#: Only characters whose class is beyond doubt are named; an apostrophe may open a contraction and
#: belongs to the rest, as all else does.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u30fc\u4e00-\u9fa5"
_MARK = "!-&(-/:-@\\[-`{-~\u3001\u3002\uff01\uff08\uff09\uff1f"
_PART = re.compile(
    f"[{_SPACE}]*(?:[{_LETTER}]+(?=[{_SPACE}{_MARK}0-9']|$)|[0-9]+(?=[{_SPACE}{_MARK}{_LETTER}']|$)"
    f"|[{_MARK}]+(?=[{_SPACE}{_LETTER}0-9]|$)|[^{_SPACE}]+)|[{_SPACE}]+"
)

#: Distinct pieces a worker remembers before it starts afresh; bounds memory, never results.
REMEMBERED = 200_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Path of a public vocabulary file; a name with a slash is taken as a path."""
    if "/" in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


@functools.lru_cache(maxsize=2)
def load_tokenizer(name: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    tokenizer.encode_special_tokens = True
    return tokenizer


@functools.lru_cache(maxsize=2)
def _memory(name: str) -> tuple[dict[str, list[int]], dict[str, list[int]]]:
    return {}, {}


def _ids_of(parts: Iterable[list[str]], known: dict[str, list[int]], encode: Callable) -> None:
    """Add what is new among the parts to those known."""
    if len(known) > REMEMBERED:
        known.clear()
    new = list(set(itertools.chain.from_iterable(parts)).difference(known))
    if new:
        known.update(zip(new, encode(new)))


def _encoded_pieces(texts: list[str | None], name: str) -> tuple[list[list[str]], dict[str, list[int]]]:
    """The pieces of each text, and the ids of every distinct piece.

    The tokenizer first splits a text by a pattern whose tokens never span the start of a white-space
    run behind another character, nor a change between letters, digits and marks. Pieces are cut at
    such places, so equal pieces, and equal parts of new pieces, are encoded once.
    """
    pieces_known, parts_known = _memory(name)

    def library(parts: list[str]) -> Iterator[list[int]]:
        return (e.ids for e in load_tokenizer(name).encode_batch_fast(parts, add_special_tokens=False))

    def by_part(pieces: list[str]) -> Iterator[list[int]]:
        parts = list(map(_PART.findall, pieces))
        _ids_of(parts, parts_known, library)
        return (list(itertools.chain.from_iterable(map(parts_known.__getitem__, own))) for own in parts)

    pieces = [_PIECE.findall(text) if text else [] for text in texts]
    _ids_of(pieces, pieces_known, by_part)
    return pieces, pieces_known


def encode_texts(texts: list[str | None], name: str = TOKENIZER) -> pa.Array:
    """Ids of each text as an Arrow list array."""
    pieces, known = _encoded_pieces(texts, name)
    ids = known.__getitem__
    lists = [list(itertools.chain.from_iterable(map(ids, own))) for own in pieces]
    offsets = np.fromiter(itertools.accumulate(map(len, lists), initial=0), np.int32, len(lists) + 1)
    values = np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def count_tokens(texts: list[str | None], name: str = TOKENIZER) -> pa.Array:
    """Number of tokens of each text."""
    pieces, known = _encoded_pieces(texts, name)
    ids = known.__getitem__
    return pa.array([sum(map(len, map(ids, own))) for own in pieces], pa.int64())


def token_ids(text: Column, name: str = TOKENIZER) -> Column:
    """Column of token ids (array of int) without special tokens."""

    @F.arrow_udf(T.ArrayType(T.IntegerType(), containsNull=False))
    def encode(batch: pa.Array) -> pa.Array:
        return encode_texts(batch.to_pylist(), name)

    return encode(text)


def token_count(text: Column, name: str = TOKENIZER) -> Column:
    """Column with the number of tokens (bigint); 0 for a null or empty text."""

    @F.arrow_udf(T.LongType())
    def count(batch: pa.Array) -> pa.Array:
        return count_tokens(batch.to_pylist(), name)

    return count(text)


OFFSETS = T.StructType(
    [
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
        T.StructField("char_start", T.ArrayType(T.IntegerType(), False)),
        T.StructField("char_end", T.ArrayType(T.IntegerType(), False)),
        T.StructField("byte_start", T.ArrayType(T.IntegerType(), False)),
        T.StructField("byte_end", T.ArrayType(T.IntegerType(), False)),
    ]
)


@functools.lru_cache(maxsize=1)
def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte, reversed.

    Printable Latin-1 bytes stand for themselves; the others take characters from U+0100 on.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


@functools.lru_cache(maxsize=2)
def token_bytes(name: str) -> list[bytes]:
    """The bytes of every id; the id of a special token stands for its own text."""
    tokenizer, alphabet = load_tokenizer(name), byte_alphabet()
    special = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
    vocabulary = tokenizer.get_vocab()
    table = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        table[i] = special.get(i) or bytes(alphabet[c] for c in token)
    return table


def _offsets(text: str, ids: list[int], table: list[bytes]) -> tuple[list[int], ...]:
    """Byte and character spans. A token that holds part of a character spans that whole character."""
    ends = list(itertools.accumulate(len(table[i]) for i in ids))
    starts = [0, *ends[:-1]] if ends else []
    if len(text) == (ends[-1] if ends else 0):  # one byte a character
        return starts, ends, starts, ends
    char_of = [i for i, c in enumerate(text) for _ in range(len(c.encode()))]
    return [char_of[s] for s in starts], [char_of[e - 1] + 1 for e in ends], starts, ends


def token_offsets(text: Column, name: str = TOKENIZER) -> Column:
    """Struct of ids with the character and byte span of each token."""

    @F.arrow_udf(OFFSETS)
    def encode(batch: pa.Array) -> pa.Array:
        texts, table = batch.to_pylist(), token_bytes(name)
        rows = []
        for text, ids in zip(texts, encode_texts(texts, name).to_pylist()):
            char_start, char_end, byte_start, byte_end = _offsets(text or "", ids, table)
            rows.append({"ids": ids, "char_start": char_start, "char_end": char_end, "byte_start": byte_start, "byte_end": byte_end})
        fields = [pa.field(f.name, pa.list_(pa.int32())) for f in OFFSETS.fields]
        return pa.array(rows, pa.struct(fields))

    return encode(text)


def decoded_text(ids: Column, name: str = TOKENIZER) -> Column:
    """Text of a list of ids by the reversed byte table.

    Bytes are joined before they are read as UTF-8, so characters split over tokens come back whole;
    a list that starts or ends inside a character gives U+FFFD there. Null gives null.
    """

    @F.arrow_udf(T.StringType())
    def decode(batch: pa.Array) -> pa.Array:
        table = token_bytes(name)
        return pa.array(
            [None if own is None else b"".join([table[i] for i in own]).decode("utf-8", "replace") for own in batch.to_pylist()],
            pa.string(),
        )

    return decode(ids)


def encode_documents(documents: DataFrame, name: str = TOKENIZER) -> DataFrame:
    """``doc_id`` and ``ids`` of every row of ``documents``; one narrow pass without a shuffle."""
    return documents.select("doc_id", token_ids(F.col("text"), name).alias("ids"))
