"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths, in numpy over whole Arrow batches,
mark the words inside n-grams that a text holds twice or more; the rules
measure the share of characters so covered, and in repeated lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import words as W

#: Largest shares allowed of characters in duplicated n-grams, the first occurrence included (fixed values, those of
#: published repetition rules), and in lines equal to an earlier one (half of theirs, as the earlier line doesn't count).
NGRAM_SHARE = {5: 0.15, 8: 0.12, 10: 0.10}
LINE_SHARE = 0.10

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_START = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point
_U = np.uint64


def covered(w: W.Words, hashes: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Marks each word in an n-gram found twice or more in its text, the first included."""
    out = np.zeros(len(hashes), bool)
    keys = W.ngram_hashes(hashes, n)
    if not len(keys):
        return out
    inside = text[: len(keys)] == text[n - 1 :]
    keys = W.mix(keys ^ (text[: len(keys)].astype(_U) * _U(0xD6E8FEB86659FD93)))
    ordered = np.sort(keys[inside])
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return out
    twice = np.unique(twice)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    hit = np.flatnonzero((twice[at] == keys) & inside)
    edge = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(w: W.Words, grams=tuple(NGRAM_SHARE)) -> dict[str, np.ndarray]:
    """Counts of each text: words, characters, symbols, repeated lines and covered characters."""
    n_text, text, hashes = len(w.ptr) - 1, w.text_of_word(), w.hashes()

    def by_text(values):
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[w.ptr[1:]] - total[w.ptr[:-1]]

    def by_bytes(flags):
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total

    points = by_bytes(_START[w.data])
    chars = points[w.ends] - points[w.starts]
    symbols = by_bytes(_SYMBOL[w.data])
    out = {
        "n_words": np.diff(w.ptr).astype(np.int64),
        "word_chars": by_text(chars),
        "n_symbols": symbols[w.offsets[1:]] - symbols[w.offsets[:-1]],
        "n_repeat_words": by_text(covered(w, hashes, text, 3)),
    }
    for n in grams:
        out[f"chars_{n}"] = by_text(np.where(covered(w, hashes, text, n), chars, 0))
    out["n_dup_lines"], out["dup_line_chars"], out["line_chars"] = _lines(w, points, n_text)
    return out


def _lines(w: W.Words, points: np.ndarray, n_text: int):
    """Of the lines with a word: those equal to an earlier one, their characters, and all characters."""
    breaks = np.flatnonzero(w.data == 10)
    starts = np.sort(np.concatenate([w.offsets[:-1], breaks + 1]), kind="stable")
    text = np.searchsorted(w.offsets, starts, side="right") - 1
    # each text has a line from its offset on; empty texts have an empty one
    ends = np.sort(np.concatenate([w.offsets[1:], breaks]), kind="stable")
    keep = starts < ends
    starts, ends, text = starts[keep], ends[keep], text[keep]
    words = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends, text = starts[words], ends[words], text[words]
    if not len(starts):
        z = np.zeros(n_text, np.int64)
        return z, z, z
    power, inverse = W._power_tables(len(w.data) + 1)
    total = np.concatenate([np.zeros(1, _U), np.cumsum(W.BYTE_VALUE[w.data] * power[: len(w.data)])])
    keys = W.mix((total[ends] - total[starts]) * inverse[starts])
    order = np.lexsort((starts, keys, text))
    again = np.zeros(len(keys), bool)
    again[order[1:]] = (keys[order[1:]] == keys[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    size = points[ends] - points[starts]
    return tuple(np.bincount(text, weights, n_text).astype(np.int64) for weights in (again, np.where(again, size, 0), size))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram_share: dict[int, float] | None = None, line_share: float = LINE_SHARE, min_words: int = 50) -> DataFrame:
    """Repetition measures and a verdict for every whole text, one row per input row.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs),
    base_failed (fewer than min_words words, or over half of the words in
    repeated 3-word windows), kept (false if base_failed; else whether the
    characters in duplicated n-grams and in repeated lines stay within their
    shares), and the shares themselves.  Null texts have no words; null ids
    stay null; repeated rows are measured each for itself; an empty table
    gives no rows.
    """
    shares = dict(NGRAM_SHARE if ngram_share is None else ngram_share)
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            *(T.StructField(n, T.LongType()) for n in longs),
            T.StructField("base_failed", T.BooleanType()),
            T.StructField("kept", T.BooleanType()),
            *(T.StructField(f"share_{n}", T.DoubleType()) for n in shares),
            T.StructField("share_lines", T.DoubleType()),
        ]
    )

    def run(batches):
        for batch in batches:
            for i, j, w in W.batches_of(batch.column(1)):
                m = measure(w, tuple(shares))
                failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
                kept, found = ~failed, []
                for n, most in shares.items():
                    found.append(m[f"chars_{n}"] / np.maximum(m["word_chars"], 1))
                    kept &= found[-1] <= most
                found.append(m["dup_line_chars"] / np.maximum(m["line_chars"], 1))
                kept &= found[-1] <= line_share
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(m[n]) for n in longs), pa.array(failed), pa.array(kept), *map(pa.array, found)], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
