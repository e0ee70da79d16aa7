"""Byte-level BPE over Arrow batches, with offsets, and its inverse.

The ``tokenizers`` library does the merges, one match of the pattern at a time.  Byte-level vocabularies
spell each byte as one printable character; the table between the two is built from its rule.  A match is
mapped to those characters, so the lengths of its tokens count bytes, and the places of the match's characters
turn them into offsets in characters of the text.  Decoding maps a token's characters back to bytes, so a character
split over several tokens comes together again when the bytes of the whole text are joined.

A worker keeps the tokens of matches that it has met, up to a bound.  A text is cut before single spaces that
stand between two other characters that are no white space: the pattern never matches across such a place.
The pieces bound what is held for a very long text; ids and offsets are those of the whole text.

Defined cases: a null text counts as empty and has no tokens; special tokens' spellings are ordinary text;
an empty table gives an empty result; rows may repeat; other columns are ignored, whatever their names;
null ids decode to null, ids outside the vocabulary are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Characters of a text that are encoded at a time, and matches that a worker remembers.
PIECE, REMEMBERED = 1 << 17, 150_000

OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "starts": "array<int>", "ends": "array<int>", "ids_sha256": "string", "decoded": "binary", "decoded_sha256": "string"}


def byte_characters() -> list[str]:
    """The printable character of each byte: itself where Latin-1 prints it, else the next from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return [chr(b) if b in set(own) else chr(0x100 + rest.index(b)) for b in range(256)]


def token_bytes(tokenizer: Tokenizer) -> list[bytes]:
    """The bytes of each id."""
    byte = {c: b for b, c in enumerate(byte_characters())}
    spelled = sorted((i, t) for t, i in tokenizer.get_vocab(with_added_tokens=True).items())
    return [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for _, t in spelled]


def pieces(text: str, size: int = PIECE) -> list[tuple[int, str]]:
    """``(offset, piece)`` of a text, cut only where the pattern always ends a match."""
    if len(text) <= size:
        return [(0, text)]
    cut, start = [], 0
    while len(text) - start > size:
        at = text.find(" ", start + size)
        while at > 0 and (at + 1 >= len(text) or text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        cut.append((start, text[start:at]))
        start = at
    return [*cut, (start, text[start:])]


class Matches(dict):
    """Of each match of the pattern its ids, or its ids and offsets; filled as they are met."""

    def __init__(self, tokenizer: Tokenizer, offsets: bool):
        self.model, self.offsets = tokenizer.model, offsets
        self.spelling = str.maketrans({b: c for b, c in enumerate(byte_characters())})

    def __missing__(self, match: str):
        if len(self) >= REMEMBERED:
            self.clear()
        data = match.encode()
        tokens = self.model.tokenize(data.decode("latin-1").translate(self.spelling))
        found = [t.id for t in tokens]
        if self.offsets:
            char = list(accumulate(b & 0xC0 != 0x80 for b in data))  # of each byte its character, from 1
            ends = list(accumulate(len(t.value) for t in tokens))  # a character of the spelling is a byte
            found = (found, [char[e - len(t.value)] - 1 for e, t in zip(ends, tokens)], [char[e - 1] for e in ends])
        self[match] = found
        return found


def _encoded(text: str, pattern: regex.Pattern, matches: Matches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, first characters and ends of a whole text; without offsets the last two are empty."""
    parts: list[tuple[np.ndarray, ...]] = []
    for at, piece in pieces(text):
        words = pattern.findall(piece)
        if not matches.offsets:
            parts.append((np.fromiter(chain.from_iterable(map(matches.__getitem__, words)), "<u4"), np.zeros(0, "i4"), np.zeros(0, "i4")))
            continue
        found = list(map(matches.__getitem__, words))
        counts = np.fromiter((len(f[0]) for f in found), "i8", len(found))
        lengths = np.fromiter(map(len, words), "i8", len(words))
        start = np.repeat(at + np.cumsum(lengths) - lengths, counts)
        columns = [np.fromiter(chain.from_iterable(f[i] for f in found), "i8", counts.sum()) for i in range(3)]
        parts.append((columns[0].astype("<u4"), (columns[1] + start).astype("i4"), (columns[2] + start).astype("i4")))
    return tuple(np.concatenate(x) for x in zip(*parts))


def encode(docs: DataFrame, outputs: tuple[str, ...] = ("n_tokens", "ids", "starts", "ends"), vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its identifier ``id`` and the ``outputs`` wanted, names of ``OUTPUTS``.

    ``starts`` and ``ends`` are code points of the text; tokens within one character share its place.
    ``decoded`` is what the ids decode to, and ``ids_sha256`` digests them as little-endian 32-bit integers.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer.from_file(vocabulary)
        pattern = regex.compile(public_tokenizers.PATTERN)
        spelled = token_bytes(tokenizer) if {"decoded", "decoded_sha256"} & {*outputs} else []
        matches = Matches(tokenizer, bool({"starts", "ends"} & {*outputs}))
        for batch in batches:
            rows: dict[str, list] = {o: [] for o in outputs}
            for text in batch.column(1):
                ids, starts, ends = _encoded(text.as_py() or "", pattern, matches)
                made = {"n_tokens": len(ids), "ids": ids.astype("int32"), "starts": starts, "ends": ends}
                if "ids_sha256" in rows:
                    made["ids_sha256"] = hashlib.sha256(ids.tobytes()).hexdigest()
                if spelled:
                    made["decoded"] = b"".join(map(spelled.__getitem__, ids.tolist()))
                    made["decoded_sha256"] = hashlib.sha256(made["decoded"]).hexdigest()
                for o in outputs:
                    rows[o].append(made[o])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(rows[o], TYPES[OUTPUTS[o]]) for o in outputs]], ["id", *outputs])

    schema = ", ".join([f"id {id_type}", *[f"{o} {OUTPUTS[o]}" for o in outputs]])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


TYPES = {"long": pa.int64(), "array<int>": pa.list_(pa.int32()), "string": pa.string(), "binary": pa.binary()}


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """Per row ``id``, ``decoded`` (bytes) and ``text``: null where the bytes are no UTF-8."""
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = token_bytes(Tokenizer.from_file(vocabulary))
        for batch in batches:
            out = [None if ids is None else b"".join(map(spelled.__getitem__, ids)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "decoded"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {id_type}, decoded binary")
    return rows.withColumn("text", F.expr("try_validate_utf8(cast(decoded as string))"))
