"""Byte-level byte-pair encoding through a sentencepiece model made from a rank file, and its inverse.

A rank file (.tiktoken) lists byte strings with their ranks.  Every byte is
mapped to a printable character, so that each byte string becomes a piece of a
sentencepiece BPE model with its negative rank as score; the model merges the
best-scored neighbours first, which is what the ranks mean.  The normaliser is
the identity: no prefix space, no white space escaped or removed.  Texts are
first split by the vocabulary's pattern and every match is encoded for itself.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import BYTE_PATTERN, texts_of

#: Matches encoded at once; a text of more characters than this is split lazily.
MATCHES = 1 << 16
#: Matches whose ids a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 1 << 19, 64
#: Code points of most European texts; such texts are split by the standard library, with the classes of these points spelled out.
USUAL = (*range(0x250), *range(0x2010, 0x2028), 0x20AC)
#: Bytes of ids or texts in a result batch.
RESULT_BYTES = 8 << 20


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = itertools.count(0x100)
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _message(field: int, payload: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(payload)) + payload


def _flag(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


#: Fields of a sentencepiece ModelProto (fixed values): pieces 1 (piece 1, score 2, type 3), trainer_spec 2 (model_type 3), normalizer_spec 3 (name 1, add_dummy_prefix 3, remove_extra_whitespaces 4, escape_whitespaces 5).
PIECES, TRAINER, NORMALIZER = 1, 2, 3
UNKNOWN, BPE = 2, 2


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model of the vocabulary: piece k is the byte string of the k-th rank, scored -k; the unknown piece comes last."""
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
    characters = byte_characters()
    out = bytearray()
    for k, piece in enumerate(sorted(ranks, key=ranks.get)):
        text = "".join(characters[b] for b in piece).encode()
        out += _message(PIECES, _message(1, text) + _varint(2 << 3 | 5) + struct.pack("<f", -float(k)))
    out += _message(PIECES, _message(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _flag(3, UNKNOWN))
    out += _message(TRAINER, _flag(3, BPE))
    out += _message(NORMALIZER, _message(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0))
    return bytes(out)


def _class(points) -> str:
    """The code points as a character class, in ranges."""
    out, points = "", sorted(points)
    for _, run in itertools.groupby(enumerate(points), lambda x: x[1] - x[0]):
        run = [p for _, p in run]
        out += f"\\U{run[0]:08x}-\\U{run[-1]:08x}"
    return out


def _usual_pattern() -> tuple[re.Pattern, re.Pattern]:
    """BYTE_PATTERN for texts of USUAL code points, and what finds a code point outside."""
    kinds = [[p for p in USUAL if regex.match(k, chr(p))] for k in (r"\p{L}", r"\p{N}", r"\s")]
    letter, number, white = map(_class, kinds)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{white}{letter}{number}]+|[{white}]+(?![^{white}])|[{white}]+"), re.compile(f"[^{_class(USUAL)}]")


class ByteBPE:
    """One vocabulary, built once in each Python worker."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.rank = np.array(sorted(self.ranks.values()), "<u4")
        self.pattern_text = pattern
        characters = byte_characters()
        self.characters = dict(enumerate(characters))
        byte = {c: b for b, c in enumerate(characters)}
        self.pieces = ["".join(characters[b] for b in piece) for piece in sorted(self.ranks, key=self.ranks.get)]
        self.bytes_of = {int(r): bytes(byte[c] for c in piece) for r, piece in zip(self.rank, self.pieces)}
        self.ids_of: dict[str, bytes] = {}

    # what only encoding needs is made when first asked for; workers that decode don't hold it

    @functools.cached_property
    def model(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=serialised_model(self.ranks))

    @functools.cached_property
    def whole(self) -> dict[str, list[int]]:
        """A match that is itself a piece is that piece, even one that no merges lead to."""
        return {piece: [k] for k, (piece, ids) in enumerate(zip(self.pieces, self.model.encode(self.pieces, num_threads=1))) if ids != [k]}

    @functools.cached_property
    def pattern(self):
        return regex.compile(self.pattern_text)

    @functools.cached_property
    def _usual(self) -> tuple[re.Pattern | None, re.Pattern | None]:
        return _usual_pattern() if self.pattern_text == BYTE_PATTERN else (None, None)

    def _matches(self, text: str) -> Iterator[list[str]]:
        usual, unusual = self._usual
        pattern = usual if usual and not unusual.search(text) else self.pattern
        if len(text) <= MATCHES:
            yield pattern.findall(text)
            return
        found = (m[0] for m in pattern.finditer(text))
        while part := list(itertools.islice(found, MATCHES)):
            yield part

    def _ids(self, parts: list[list[str]]) -> Iterator[bytes]:
        """The ids of each part; matches that aren't remembered are encoded in one call."""
        known = self.ids_of
        new = list(set().union(*parts).difference(known))
        mapped = [m.encode().decode("latin-1").translate(self.characters) for m in new]
        made = dict(zip(new, (self.rank[self.whole.get(m, ids)].tobytes() for m, ids in zip(mapped, self.model.encode(mapped, num_threads=1))))) if new else {}
        look = (known | made if len(known) + len(made) > REMEMBERED else known).__getitem__
        if len(known) + len(made) > REMEMBERED:
            self.ids_of = {}
        self.ids_of.update((m, ids) for m, ids in made.items() if len(m) <= LONGEST)
        for part in parts:
            try:
                yield b"".join(map(look, part))
            except KeyError:
                yield b"".join(made.get(m) or look(m) for m in part)

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, in order, each as four bytes, lowest first; some MATCHES matches and one text's ids are in work at a time."""
        now, whole, waiting, size = 0, [], [], 0

        def done():
            nonlocal now, whole
            for (k, _), ids in zip(waiting, self._ids([part for _, part in waiting])):
                if k != now:
                    yield b"".join(whole)
                    now, whole = k, []
                whole.append(ids)

        for k, text in enumerate(texts):
            for part in self._matches(text) if text else [[]]:
                waiting.append((k, part))
                size += len(part)
                if size >= MATCHES:
                    yield from done()
                    waiting, size = [], 0
        if waiting:
            yield from done()
        if waiting or whole:
            yield b"".join(whole)

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> bytes | None:
        """The bytes that ids stand for; None if they are not ids of this vocabulary."""
        if len(ids) % 4:
            return None
        look, out = self.bytes_of.__getitem__, bytearray()
        try:
            for at in range(0, len(ids), 4 * MATCHES):
                out += b"".join(map(look, np.frombuffer(ids[at : at + 4 * MATCHES], "<u4").tolist()))
        except KeyError:
            return None
        return bytes(out)


@functools.lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def _with_column(df: DataFrame, source: str, name: str, path: str, pattern: str, values) -> DataFrame:
    """df with a binary column more: values(vocabulary, column) of each Arrow batch, in result batches of about RESULT_BYTES."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())])
    at = df.columns.index(source)

    def run(batches):
        own = vocabulary(path, pattern)
        for batch in batches:
            first, size, made = 0, 0, []

            def out():
                part = batch.slice(first, len(made))
                return pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], names=schema.names)

            for value in values(own, batch.column(at)):
                made.append(value)
                size += len(value or b"")
                if size >= RESULT_BYTES:
                    yield out()
                    first, size, made = first + len(made), 0, []
            if made:
                yield out()

    return df.mapInArrow(run, schema)


def encode_texts(docs: DataFrame, path: str, pattern: str = BYTE_PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_tokens) of every whole text: ids as binary, four bytes each, lowest first.

    Null and empty texts have no ids (an empty binary) and 0 tokens; null ids
    stay null; repeated rows are encoded each for itself; other columns are not
    read; an empty table gives no rows.  Long texts are split lazily, some
    65 000 matches at a time, so that beside a text only its ids are held; a
    single match (a word or a run of white space) is merged in memory, at some
    150 bytes a byte of it.
    """
    plain = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text" if id_col == "text" else "text"))
    made = _with_column(plain, plain.columns[1], "ids" if id_col != "ids" else "_ids", path, pattern, lambda own, column: own.encode_all(texts_of(column)))
    ids = made.columns[2]
    return made.select(id_col, F.col(ids), (F.octet_length(ids) / 4).cast("long").alias("n_tokens"))


def decode_ids(df: DataFrame, path: str, pattern: str = BYTE_PATTERN, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """df with the bytes that its binary ids stand for; null for null ids, or for what are no ids of the vocabulary."""
    return _with_column(df, ids_col, name, path, pattern, lambda own, column: (None if x is None else own.decode(x) for x in (v.as_py() for v in column)))


def round_trip(docs: DataFrame, path: str, pattern: str = BYTE_PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of every text's ids and of the bytes they decode to."""
    both = decode_ids(encode_texts(docs, path, pattern, id_col, text_col), path, pattern)
    return both.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
