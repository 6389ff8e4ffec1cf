"""Benchmark decontamination by latent semantic retrieval.

Texts are read as windows of 8 to 64 words, their TF-IDF vectors (words hashed
to 2**BITS places) projected on singular vectors from a randomised SVD.
Windows near a benchmark item in cosine are candidates, or near one of the
parts of at most PASSAGE words that a long item is cut into; a longest common
subsequence of words with the whole item and a check of its answer (its last
words) decide.

Document frequencies count all passages of the corpus.  The SVD is of all of
them too: each passage's row is added with a random sign to one of SKETCH rows,
whose Gram matrix estimates that of the passages without bias; the items stand
in the matrix with more weight, so that the space keeps them apart.  The search
itself reads every word of every text.  Nothing but the counts, the SKETCH rows
and the items reaches the driver, and the search is one pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import words as W

BITS = 14
PASSAGE = 64
#: Words of a block, the unit by which windows move, and window sizes in blocks.
BLOCK = 4
SIZES = (2, 4, 8, 16)
RANK = 63
OVERSAMPLE = 17
POWER_ROUNDS = 2
#: Rows that all passages are added up to, with random signs, for the SVD.
SKETCH = 256
#: An item's weight beside a passage's in a corpus of MASS passages; larger corpora weigh as much as MASS passages in all.
ITEM_WEIGHT, MASS = 30.0, 1 << 14
#: Items that share a space (about four for a dimension), and how many such blocks one pass over the texts searches for.
ITEM_BLOCK = 256
BLOCKS_A_PASS = 16
#: Least cosine of a candidate.  An item of which half the words stand in a window up to 1.4 times its length has 0.42.
COSINE = 0.35
#: Least share of an item's words, in order, that make a leak; and a paraphrase, if the answer stands there too.
VERBATIM = 0.8
PARAPHRASE = 0.5
ANSWER_WORDS = 5
ANSWER_SHARE = 0.75

#: No place weighs less: a word in every passage still counts, and so does an item that is copied into very many.
LEAST_WEIGHT = 0.1

_SHIFT = np.uint64(64 - BITS)
_PLACES = 1 << BITS


def _batches(column: pa.Array):
    return W.batches_of(column, W.ALNUM_WORDS, lower=True)


def _passages(w: W.Words) -> np.ndarray:
    """First words of consecutive runs of PASSAGE words within the texts."""
    n = np.diff(w.ptr)
    runs = -(-n // PASSAGE)
    first = np.repeat(w.ptr[:-1], runs)
    return first + (np.arange(len(first)) - np.repeat(np.cumsum(runs) - runs, runs)) * PASSAGE


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """(passages that hold each place, passages), over the whole corpus."""

    def run(batches):
        count, passages = np.zeros(_PLACES, np.int64), 0
        for batch in batches:
            for _, _, w in _batches(batch.column(0)):
                if not len(w):
                    continue
                starts = _passages(w)
                passages += len(starts)
                own = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(w))))
                keys = np.sort((own << BITS) | (w.hashes() >> _SHIFT).astype(np.int64))
                keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
                count += np.bincount(keys & (_PLACES - 1), minlength=_PLACES)
        place = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(place, -1)), pa.array(np.append(count[place], passages))], names=["place", "n"])

    total = docs.select(text_col).mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()  # at most 2**BITS + 1 rows
    by = dict(zip(total["place"].tolist(), total["n"].tolist()))
    df = np.array([by.get(k, 0) for k in range(_PLACES)], np.int64)
    return df, by.get(-1, 0)


def place_weights(df: np.ndarray, passages: int) -> np.ndarray:
    """ln((1 + passages) / (1 + df)), LEAST_WEIGHT at least."""
    return np.maximum(LEAST_WEIGHT, np.log((1 + passages) / (1 + df)))


class Items:
    """A block of benchmark items: ids, words as hashes, and TF-IDF rows of their parts (item: whose)."""

    def __init__(self, ids: list, texts: list[str | None], idf: np.ndarray):
        self.ids, self.words = [], []
        for i, j, w in _batches(pa.array(texts, pa.string())):
            h = w.hashes()
            for k in range(j - i):
                own = h[w.ptr[k] : w.ptr[k + 1]]
                if len(own) and ids[i + k] is not None:
                    self.ids.append(ids[i + k])
                    self.words.append(own)
        cuts = [np.array_split(x, -(-len(x) // PASSAGE)) for x in self.words]
        self.item = np.repeat(np.arange(len(cuts)), [len(x) for x in cuts])
        self.lengths = np.array([len(x) for parts in cuts for x in parts], np.int64)
        self.places = [(x >> _SHIFT).astype(np.int64) for parts in cuts for x in parts]
        self.rows = [idf[p] / max(1e-9, np.sqrt((idf[p] ** 2).sum())) for p in self.places]

    def product(self, right: np.ndarray) -> np.ndarray:
        out = np.zeros_like(right)
        for p, v in zip(self.places, self.rows):
            np.add.at(out, p, v[:, None] * (v @ right[p])[None, :])
        return out

    def latent(self, v: np.ndarray) -> np.ndarray:
        """Each part's row in the space over its squared length there.

        Its product with a window's projection, over the window's whole
        TF-IDF length, estimates their cosine: 1 for the item itself, and
        near 0 for windows that lie outside the space.
        """
        q = np.array([x @ v[p] for p, x in zip(self.places, self.rows)]).reshape(len(self.item), v.shape[1])
        return q / np.maximum((q * q).sum(1, keepdims=True), 1e-4)


def _added(idf: np.ndarray):
    """A task's passages, each added with a sign to one of SKETCH rows: (bucket, places, values)."""

    def run(batches):
        sums = np.zeros(SKETCH * _PLACES, np.float32)
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            for i, j, w in _batches(batch.column(1)):
                if not len(w):
                    continue
                starts = _passages(w)
                n = np.diff(np.append(starts, len(w)))
                text = np.searchsorted(w.ptr, starts, side="right") - 1
                mixed = _mixed(keys[i:j][text], starts - w.ptr[text])
                place = (w.hashes() >> _SHIFT).astype(np.int64)
                own = np.repeat(np.arange(len(starts)), n)
                v = idf[place]
                v = v / np.maximum(np.sqrt(np.bincount(own, v * v, len(starts))), 1e-9)[own]
                sign = np.where(mixed >> np.uint64(63), 1, -1)
                np.add.at(sums, (mixed % np.uint64(SKETCH)).astype(np.int64)[own] * _PLACES + place, (v * sign[own]).astype(np.float32))
        rows = sums.reshape(SKETCH, _PLACES)
        at = [np.flatnonzero(r) for r in rows]
        some = [k for k in range(SKETCH) if len(at[k])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array([at[k].astype("<u2").tobytes() for k in some], pa.binary()), pa.array([rows[k][at[k]].astype("<f4").tobytes() for k in some], pa.binary())], names=["bucket", "places", "values"]
        )

    return run


def _mixed(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Well mixed 64 bits of a document's hash and a passage's place."""
    x = key + (at.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bucket(parts: pa.Table) -> pa.Table:
    total = np.zeros(_PLACES)
    for p, v in zip(parts["places"], parts["values"]):
        total[np.frombuffer(p.as_buffer(), "<u2")] += np.frombuffer(v.as_buffer(), "<f4")
    return pa.table({"m": pa.array([total.astype("<f4").tobytes()], pa.binary())})


def passage_rows(docs: DataFrame, idf: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """SKETCH x 2**BITS: the signed sums of all passages' TF-IDF rows, of every text of the corpus.

    Bucket and sign are hashed from the document's id and text and the
    passage's place, so they don't depend on how rows are dealt to tasks.
    """
    keyed = docs.select(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("key"), text_col)
    parts = keyed.mapInArrow(_added(idf.astype(np.float32)), "bucket int, places binary, values binary")
    rows = [np.frombuffer(r["m"], "<f4") for r in parts.groupBy("bucket").applyInArrow(_bucket, "m binary").toLocalIterator()]  # SKETCH rows at most
    return np.stack(rows) if rows else np.zeros((0, _PLACES), np.float32)


def fit_space(rows: np.ndarray, passages: int, items: Items, rank: int = RANK, seed: int = 11) -> np.ndarray:
    """Right singular vectors (2**BITS x rank) of the passages, by their summed rows, and the weighted items."""
    width, mass = rank + OVERSAMPLE, min(1.0, MASS / max(1, passages))
    right = np.random.Generator(np.random.PCG64(seed)).standard_normal((_PLACES, width))
    for turn in range(POWER_ROUNDS + 1):
        total = ITEM_WEIGHT**2 * items.product(right) + mass * (rows.T @ (rows @ right.astype(np.float32)))
        if turn < POWER_ROUNDS:
            right = np.linalg.qr(total)[0]
    # right has orthonormal columns and total is the Gram matrix times it: Rayleigh-Ritz
    values, vectors = np.linalg.eigh(right.T @ total)
    return (right @ vectors[:, ::-1][:, :rank]).astype(np.float32)


def common_subsequence(item: dict, n: int, text: list) -> int:
    """Length of the longest common subsequence, n bits at a time; item maps a word to its places."""
    full = (1 << n) - 1
    v = full
    for x in text:
        m = item.get(x)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _masks(words: list) -> dict:
    out: dict = {}
    for k, x in enumerate(words):
        out[x] = out.get(x, 0) | 1 << k
    return out


class Searcher:
    """Finds items of one block in texts."""

    def __init__(self, items: Items, space: np.ndarray, idf: np.ndarray, cosine: float = COSINE):
        self.ids, self.cosine = items.ids, cosine
        # the projection of each place's weight, its square, and a row of zeros
        self.table = np.vstack([np.column_stack([space * idf[:, None], idf**2]), np.zeros((1, space.shape[1] + 1))]).astype(np.float32)
        latent = items.latent(space).astype(np.float32)
        lengths = np.array([len(x) for x in items.words])
        sizes = np.array(SIZES) * BLOCK
        kind = np.abs(np.log(items.lengths[:, None] / sizes[None, :])).argmin(1)
        self.groups = [(size, items.item[kind == k], np.ascontiguousarray(latent[kind == k].T)) for k, size in enumerate(SIZES)]
        words = [x.tolist() for x in items.words]
        self.lengths = lengths
        self.masks = [_masks(x) for x in words]
        self.answers = [_masks(x[-ANSWER_WORDS:]) for x in words]

    def find(self, w: W.Words) -> list[tuple]:
        """(text, item number, words in common, share, answer share, cosine, first word) of every leak."""
        n_text, n = len(w.ptr) - 1, np.diff(w.ptr)
        if not len(w) or not len(self.ids):
            return []
        hashes = w.hashes()
        blocks = -(-n // BLOCK)
        own = np.repeat(np.arange(n_text), blocks)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        at = (w.ptr[own] + nth * BLOCK)[:, None] + np.arange(BLOCK)
        place = (hashes >> _SHIFT).astype(np.int64)[np.minimum(at, len(hashes) - 1)]
        place[at >= w.ptr[own + 1][:, None]] = _PLACES
        sums = self.table[place[:, 0]]
        for k in range(1, BLOCK):
            sums += self.table[place[:, k]]
        # zero blocks behind each text keep windows inside it
        gap = max(SIZES) - 1
        spot = np.arange(len(own)) + own * gap
        rows = np.zeros((spot[-1] + 1 + gap, sums.shape[1]), np.float32)
        rows[spot] = sums
        hits: dict[tuple[int, int], list] = {}
        span, window = 1, rows
        for size, members, latent in self.groups:
            while span < size:
                window = window[:-span] + window[span:]
                span *= 2
            if not len(members):
                continue
            own_window = window[spot]
            norm = np.sqrt(own_window[:, -1])
            near = own_window[:, :-1] @ latent
            at, which = np.nonzero(near >= self.cosine * np.maximum(norm, 1e-3)[:, None])
            for b, m in zip(at.tolist(), which.tolist()):
                hits.setdefault((int(own[b]), int(members[m])), []).append((int(nth[b]), size, float(near[b, m] / norm[b])))
        found = []
        for (text, item), windows in hits.items():  # of all parts of an item
            length = int(self.lengths[item])
            best = None
            for first, last, cosine in _regions(windows, length):
                a, b = int(w.ptr[text]) + max(0, first), min(int(w.ptr[text + 1]), int(w.ptr[text]) + last)
                words = hashes[a:b].tolist()
                common = common_subsequence(self.masks[item], length, words)
                answer = common_subsequence(self.answers[item], min(length, ANSWER_WORDS), words) / min(length, ANSWER_WORDS)
                row = (common / length, answer, cosine, common, a - int(w.ptr[text]))
                best = row if best is None or row > best else best
            share, answer, cosine, common, first = best
            if share >= VERBATIM or (share >= PARAPHRASE and answer >= ANSWER_SHARE and length >= 2 * ANSWER_WORDS):
                found.append((text, item, common, share, answer, cosine, first))
        return found


def _regions(windows: list, length: int) -> list[tuple[int, int, float]]:
    """(first word, last + 1, best cosine) around windows that touch, widened by half the item's length."""
    out: list[list] = []
    for block, size, cosine in sorted(windows):
        a, b = block * BLOCK - length // 2, (block + size) * BLOCK + length // 2
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
            out[-1][2] = max(out[-1][2], cosine)
        else:
            out.append([a, b, cosine])
    return [tuple(x) for x in out]


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str):
    ids, texts = [], []
    for r in benchmark.select(item_col, text_col).orderBy(item_col).toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        if len(ids) == ITEM_BLOCK:
            yield ids, texts
            ids, texts = [], []
    if ids:
        yield ids, texts


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item_id, common_words, share, answer_share, cosine, first_word): documents that hold a benchmark item.

    share is the longest common subsequence of words with the item, of the
    item's words, around the windows found; first_word is where that stretch
    starts.  A document is reported once for each item, where it matches best.
    An item that stands in very many documents, or in all, is found in each:
    no word loses its weight.  Texts and items of any length are read whole.
    Ids may have any type that Arrow has.
    Words are lower-cased runs of letters and digits.  Null and empty texts
    and items match nothing, nor do items with a null id; a null document id
    stays null; repeated rows are searched each for itself; other columns are
    not read; an empty table on either side gives no rows.
    """
    schema = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType), T.StructField("item_id", benchmark.schema[item_col].dataType), T.StructField("common_words", T.IntegerType())]
        + [T.StructField(n, T.DoubleType()) for n in ("share", "answer_share", "cosine")]
        + [T.StructField("first_word", T.IntegerType())]
    )
    spark = docs.sparkSession
    df, passages = document_frequencies(docs, text_col)
    idf = place_weights(df, passages)
    rows, out, waiting = None, spark.createDataFrame([], schema), []

    def search_pass():
        shared = spark.sparkContext.broadcast(list(waiting))  # at most BLOCKS_A_PASS tables of 2**BITS places
        waiting.clear()

        def run(batches):
            item_type = to_arrow_type(schema["item_id"].dataType)
            for batch in batches:
                types = (batch.schema.field(0).type, item_type, pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int32())
                for i, _, w in _batches(batch.column(1)):
                    rows = [(batch.column(0)[i + t].as_py(), search.ids[m], *rest) for search in shared.value for t, m, *rest in search.find(w)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], y) for k, y in enumerate(types)], names=schema.names)

        return docs.select(id_col, text_col).mapInArrow(run, schema)

    for ids, item_texts in _item_blocks(benchmark, item_col, item_text_col):
        items = Items(ids, item_texts, idf)
        if not passages or not items.ids:
            continue
        if rows is None:
            rows = passage_rows(docs, idf, id_col, text_col)
        waiting.append(Searcher(items, fit_space(rows, passages, items), idf))
        if len(waiting) == BLOCKS_A_PASS:
            out = out.union(search_pass())
    if waiting:
        out = out.union(search_pass())
    return out.withColumnRenamed("id", id_col)
