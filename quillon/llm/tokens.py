"""Token ids and token counts by public vocabulary files.

The ids are those of the library that a file belongs to: `tokenizers` for
.json, `sentencepiece` for .model, without begin, end or added special tokens.
A .tiktoken file of the same name beside a .json one holds the same
vocabulary; texts then take that faster encoder, whose ids are the same (tests
compare both).  Texts with a special string, or with a run of white space so
long that the faster encoder's backtracking would exhaust the stack, go to the
library itself.  Special strings inside texts are handled as it does by default.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W

#: Bytes of text handed to an encoder at once, and the characters from which a text is split.
BATCH_BYTES = 1 << 18
SPLIT_CHARS = 1 << 16

#: The split pattern of byte-level vocabularies (fixed value).
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A place where a byte-level encoder starts a new piece whatever follows: a single space between two other characters.
_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: White space that the faster encoder does not get.
_LONG_RUN = re.compile(r"\s{1000}")


class Encoder:
    """One vocabulary file, loaded once in each Python worker."""

    def __init__(self, path: str):
        self.kind = path.rsplit(".", 1)[-1]
        self.special, self.fast, self.splits = None, None, False
        if self.kind == "model":
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        strings = [x["content"] for x in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, strings))) if strings else None
        steps = spec.get("pre_tokenizer") or {}
        self.splits = spec.get("normalizer") is None and steps.get("type") == "ByteLevel" and not steps.get("add_prefix_space") and steps.get("use_regex", True)
        twin = f"{path[: -len('.json')]}.tiktoken"
        if self.splits and os.path.exists(twin):
            import tiktoken

            with open(twin, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding(os.path.basename(path), pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def parts(self, text: str) -> list[str]:
        """text in pieces that encode independently, of about SPLIT_CHARS characters."""
        if not self.splits or len(text) <= SPLIT_CHARS:
            return [text]
        found, at = [], 0
        while len(text) - at > SPLIT_CHARS and (m := _SAFE.search(text, at + SPLIT_CHARS)):
            found.append(text[at : m.start()])
            at = m.start()
        return [*found, text[at:]]

    def _encode(self, texts: list[str]) -> list[list[int]]:
        if self.kind == "model":
            return self.library.encode(texts, num_threads=1)
        if self.fast is None:
            return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        plain = self.fast._core_bpe.encode_ordinary
        return [self.library.encode(x, add_special_tokens=False).ids if self._apart(x) else plain(x) for x in texts]

    def _apart(self, text: str) -> bool:
        """Whether a text is the library's own to encode."""
        return bool(self.special and self.special.search(text) or _LONG_RUN.search(text))

    def _batches(self, texts: Iterable[str]) -> Iterator[list[tuple[int, list[int]]]]:
        """(number of the text, ids of a part of it), in order, in batches of about BATCH_BYTES of text."""
        waiting: list[tuple[int, str]] = []
        size = 0
        for k, text in enumerate(texts):
            for part in self.parts(text):
                waiting.append((k, part))
                size += len(part) if part.isascii() else len(part.encode("utf-8", "surrogatepass"))
                if size >= BATCH_BYTES:
                    yield list(zip((k for k, _ in waiting), self._encode([x for _, x in waiting])))
                    waiting, size = [], 0
        if waiting:
            yield list(zip((k for k, _ in waiting), self._encode([x for _, x in waiting])))

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order; only about BATCH_BYTES of text and one text's ids are in work at a time."""
        now, parts = 0, []
        for batch in self._batches(texts):
            for k, ids in batch:
                if k != now:
                    yield np.concatenate(parts)
                    now, parts = k, []
                parts.append(np.array(ids, np.uint32))
        if parts:
            yield np.concatenate(parts)

    def lengths(self, texts: Iterable[str], n: int) -> np.ndarray:
        """The number of ids of each of n texts; ids are dropped batch by batch."""
        total = np.zeros(n, np.int64)
        for batch in self._batches(texts):
            for k, ids in batch:
                total[k] += len(ids)
        return total


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def texts_of(column: pa.Array) -> Iterator[str]:
    """One text after the other; null is empty."""
    return (x.as_py() or "" for x in column)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Bytes and tokens of every whole text: (id, n_bytes, n_tokens, over_limit).

    Arrow batches go to the encoder in pieces balanced by bytes; only lengths
    come back.  A null or empty text has 0 bytes and 0 tokens; very long texts
    are split at single spaces between other characters, and what has none (one
    word, one run of white space) is encoded whole; a null id stays null;
    repeated rows are counted each for itself; other columns are not read; an
    empty table gives no rows.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            column = batch.column(1)
            _, offsets = W.string_buffers(column)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(enc.lengths(texts_of(column), len(column)))], names=[id_col, "n_bytes", "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
