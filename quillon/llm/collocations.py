"""Phrase collocations by level-wise counting: a phrase is counted only where both its shorter halves are frequent.

Level k counts phrases of k words.  A place emits its phrase only if the
phrases of k - 1 words there, without the last and without the first word, are
frequent; these reach the tasks as one bit map of fixed size (hashes of the
frequent phrases), so what is broadcast doesn't grow with the data.  A wrong
bit only lets a rare phrase be counted, never a frequent one be missed; counts
themselves are sums by text and exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from . import words as W

U64 = np.uint64
#: Bytes of text counted at once, and the bits (a power of two) of the map of frequent phrases: 16 MB.
CHUNK, BITS = 1 << 22, 27
#: Classes of bytes (fixed values): 0 of words, 1 space and tab between words, 2 marks and line ends between pieces.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_ODD = [int(x) * 2 + 1 for x in np.random.Generator(np.random.PCG64(99)).integers(1, 2**62, 8)]
#: Parts in which the first rows of a language are found before they meet.
PARTS = 64

COUNTS = "lang string, phrase string, n long"


def _grams(hashes: np.ndarray, k: int, odd: list[int]) -> np.ndarray:
    size = max(0, len(hashes) - k + 1)
    total = np.zeros(size, U64)
    for i in range(k):
        total += hashes[i : i + size] * U64(odd[i])
    return W.mix(total)


def _language(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


class _Pieces:
    """Words of a stretch of texts, in pieces; `text` is the stretch with one space between words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        kind = _CLASS[data]
        self.words = words = W.Words(data, offsets, _CLASS == 0, lower=True)
        self.of = words.text_of_word()
        self.piece = np.cumsum(kind == 2)[words.starts] + self.of if len(words) else np.zeros(0, np.int64)
        after = np.zeros(len(data), bool)
        after[1:] = words.mask[:-1]
        kept = words.mask | after
        self.text = np.where(words.mask, words.data, 32).astype(np.uint8)[kept]
        place = np.cumsum(kept) - 1
        self.starts = place[words.starts]
        self.ends = self.starts + (words.ends - words.starts)

    def inside(self, k: int) -> np.ndarray:
        """Whether the k words from each place on stand in one piece."""
        n = max(0, len(self.piece) - k + 1)
        return self.piece[:n] == self.piece[k - 1 : k - 1 + n]

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        """The phrases of k words from the places on."""
        begin, size = self.starts[at], self.ends[at + k - 1] - self.starts[at]
        offsets = np.zeros(len(at) + 1, np.int64)
        np.cumsum(size, out=offsets[1:])
        take = np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(self.text[take]))


def _stretches(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, number of each text) in stretches of about CHUNK bytes.

    A longer text is cut between words; the next stretch begins k - 1 words
    before the cut, so every phrase of k words stands whole in exactly one.
    """
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        at, end = int(offsets[i]), int(offsets[j])
        while end - at > CHUNK:
            cut, blanks = at + CHUNK, np.zeros(0, int)
            while cut < end:
                # the first gap after the cut, and the words before it
                gap = np.flatnonzero(_CLASS[data[cut : cut + CHUNK]])
                if not len(gap):
                    cut = min(end, cut + CHUNK)
                    continue
                cut += int(gap[0])
                word = _CLASS[data[at:cut]] == 0
                blanks = np.flatnonzero(word & ~np.append(False, word[:-1]))
                if len(blanks) >= k:
                    break
                cut += 1 if cut == at + CHUNK else CHUNK
                cut = min(cut, end)
            if cut >= end:
                break
            yield data[at:cut], np.array([0, cut - at]), np.array([i])
            at = cut if k == 1 else at + int(blanks[-(k - 1)])
        yield data[at:end], np.concatenate([[at], offsets[i + 1 : j + 1]]) - at, np.arange(i, j)
        i = j


def _frequent(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the map may hold the keys."""
    found = np.ones(len(keys), bool)
    for place in _bit_places(keys, 64 * len(bits)):
        found &= (bits[place >> U64(6)] >> (place & U64(63))) & U64(1) == 1
    return found


def _bit_places(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    mask = U64(size - 1)
    return keys & mask, (keys >> U64(32)) & mask


def _occurrences(docs: DataFrame, k: int, bits) -> DataFrame:
    """(lang, phrase, n): counts of phrases of k words by stretch; for k = 1 also the number of words, of null phrase."""

    def run(batches):
        shorter = None if bits is None else np.frombuffer(bits.value, U64)
        for batch in batches:
            names, codes = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
            marks = np.array([_language(x) for x in names], U64)
            data, offsets = W.string_buffers(batch.column(1))
            for part, places, texts in _stretches(data, offsets, k):
                p = _Pieces(part, places)
                of, h = codes[texts][p.of], p.words.hashes()
                mark = marks[of]
                good = p.inside(k)
                if k == 1:
                    total = np.bincount(of, minlength=len(names))
                    some = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays([pa.array(names[some], pa.string()), pa.nulls(len(some), pa.string()), pa.array(total[some])], names=["lang", "phrase", "n"])
                else:
                    short = _grams(h, k - 1, W._ODD) + mark[: max(0, len(h) - k + 2)]
                    ok = _frequent(W.mix(short), shorter)
                    good &= ok[: len(good)] & ok[1 : 1 + len(good)]
                at = np.flatnonzero(good)
                one, two = (_grams(h, k, odd)[at] + mark[at] for odd in (W._ODD, _ODD))
                order = np.argsort(one, kind="stable")
                one, two = one[order], two[order]
                new = np.ones(len(at), bool)
                new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
                first = np.flatnonzero(new)
                count = np.diff(np.append(first, len(at)))
                chosen = at[order[first]]
                for s in range(0, len(chosen), 1 << 16):
                    c = chosen[s : s + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(names[of[c]], pa.string()), p.phrases(c, k), pa.array(count[s : s + (1 << 16)])], names=["lang", "phrase", "n"])

    return docs.mapInArrow(run, COUNTS)


def _bit_map(level: DataFrame, k: int, bits: int) -> bytes:
    """The map of a level's phrases: 2 ** bits bits whatever their number."""

    def run(batches):
        for batch in batches:
            data, offsets = W.string_buffers(batch.column(1))
            w = W.Words(data, offsets, _CLASS == 0)
            marks = np.array([_language(x) for x in batch.column(0).to_pylist()], U64)
            keys = W.mix(_grams(w.hashes(), k, W._ODD)[w.ptr[:-1]] + marks) if len(marks) else np.zeros(0, U64)
            place = np.concatenate(_bit_places(keys, 1 << bits))
            place.sort()
            slots = place >> U64(6)
            first = np.flatnonzero(np.append(True, slots[1:] != slots[:-1])) if len(slots) else np.zeros(0, int)
            values = np.bitwise_or.reduceat(U64(1) << (place & U64(63)), first) if len(first) else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays([pa.array(slots[first].view(np.int64)), pa.array(values.view(np.int64))], names=["slot", "bits"])

    found = level.select("lang", "phrase").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found["slot"].to_numpy()] = found["bits"].to_numpy()
    return out.tobytes()


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, lang_col: str = "lang", text_col: str = "text", map_bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """((lang, k, phrase, f): phrases of 1 to `longest` words that stand at least `least` times in their language, and (lang, n): words of each language).

    One pass over the texts for each level, until a level has no phrase.  The
    map has 2 ** map_bits bits; with many more frequent phrases than an eighth
    of that it thins out less, and counts stay right.
    """
    spark = docs.sparkSession
    plain = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    levels, totals, bits = None, None, None
    for k in range(1, longest + 1):
        counted = _occurrences(plain, k, bits).groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        level = store.cut(counted.filter((F.col("f") >= least) | F.col("phrase").isNull()))
        if bits is not None:
            bits.destroy()
        if k == 1:
            totals = store.cut(level.filter(F.col("phrase").isNull()).select("lang", F.col("f").alias("n")))
            level = level.filter(F.col("phrase").isNotNull())
        made = level.select("lang", F.lit(k).alias("k"), "phrase", "f")
        levels = made if levels is None else levels.unionByName(made)
        if k < longest:
            if level.isEmpty():
                break
            bits = spark.sparkContext.broadcast(_bit_map(level, k, map_bits))
    return levels, totals


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, first: int = 2000, share: tuple[int, int] = (100, 100), lang_col: str = "lang", text_col: str = "text", map_bits: int = BITS) -> DataFrame:
    """Each language's `first` best phrases of 2 to `longest` words: (lang, rank, phrase, a, l, r, n, score).

    a is the phrase's count, l and r those of the parts of its lowest-scoring
    cut (ties: the shortest left part), n the words of the language, and score
    floor(1000 * a * n / (l * r)), in decimals of 38 digits.  A phrase whose
    words lie inside a longer frequent one with share[0] * f(longer) >=
    share[1] * a goes.  By score, then a, both falling, then the phrase's bytes.

    A null text is empty, a null language `und`; repeated rows each count; very
    long texts are counted in stretches; ties are settled by the phrase; an
    empty table, or one without frequent phrases, gives no rows; other columns
    are not read.
    """
    levels, totals = frequent_phrases(docs, least, longest, lang_col, text_col, map_bits)
    levels = store.cut(levels)
    words = F.split("phrase", " ", -1)
    part = lambda begin, size: F.array_join(F.slice(words, begin, size), " ")
    places = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda b: F.struct(b.alias("b"), size.alias("s")))))
    inner = levels.filter("k > 2").select("lang", "f", F.explode(F.array_distinct(F.transform(places, lambda x: part(x["b"], x["s"])))).alias("phrase"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("f").alias("_m"))
    candidates = levels.filter("k > 1").join(covered, ["lang", "phrase"], "left").filter(F.col("_m").isNull() | (F.lit(share[0]) * F.col("_m") < F.lit(share[1]) * F.col("f"))).drop("_m")
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "cut", part(F.lit(1), F.col("cut")).alias("_left"), part(F.col("cut") + 1, F.col("k")).alias("_right"))
    counts = lambda name, value: levels.select("lang", F.col("phrase").alias(name), F.col("f").alias(value))
    cuts = cuts.join(counts("_left", "l"), ["lang", "_left"]).join(counts("_right", "r"), ["lang", "_right"]).join(totals, "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("_above", (F.lit(1000) * exact("a")).cast("decimal(19,0)") * exact("n")).withColumn("_below", exact("l") * exact("r")).withColumn("score", F.expr("_above div _below"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("_c")).select("lang", "phrase", "a", "n", "_c.l", "_c.r", "_c.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = best.withColumn("_part", F.pmod(F.crc32(F.col("phrase").cast("binary")), F.lit(PARTS)))
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= first)
    return ranked(ranked(dealt, "lang", "_part"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
