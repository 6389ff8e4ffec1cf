"""N-gram Jaccard join by a count-vector R-tree.

A document's set of word shingles becomes a point: its counts by hash group.
Equal sets are one node from the start.  The top of the tree is spread over
the cluster by keys that linked sets share: of a set of n shingles, the
n - ceil(t n) + 1 rarest are its keys (two sets of a Jaccard of at least t
agree in one of these, whatever the order, if it is the same for all).  Rarity
is read from counts of hash buckets over the whole corpus, a table of fixed
size, so that passages which very many documents share come last and bring
nobody together.  A single coordinate prunes nothing at usual sizes (its
spread is below the allowed difference), all coordinates summed do: in the
buckets of the keys, pairs pass the bound by summed coordinate minima and are
then verified on the sets themselves.

Large buckets are not expanded into pairs: members are first compared with
the bucket's smallest node, then those outside its component with a few of the
component's members, which joins near copies into one; what is still in other
components is searched with a tree for each bucket, in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .components import connected_components
from .rtree import CountTree
from .store import cut, kept, new_path, release, remove, scratch, written, written_at

#: Hash groups of the tree's points.  A set is also kept by as many groups as it has shingles, up to FINEST, for the pairs that are left.
GROUPS = 128
FINEST = 8192
#: Hash buckets whose shingles are counted, as a power of two; a rank a bucket is broadcast, whatever the corpus.
RANK_BITS = 18
#: Members of a bucket's main component that each member outside it is compared with before the search.
PARTNERS = 4
#: Members of a bucket block that one search holds at most, on average.
BLOCK = 768
#: So many of a node's first buckets go with it: pairs that share one of these are looked at there alone.
FIRST = 4
#: Ids that may be broadcast to filter the texts at the scan; beyond, a shuffle join does it.
BROADCAST_IDS = 1_000_000
_U = np.uint64
_RANK_SHIFT = _U(64 - RANK_BITS)


def shingle_ranks(docs: DataFrame, text_col: str, n: int) -> np.ndarray:
    """How common the shingles of each hash bucket are: eight steps an octave, from all texts."""

    def count(batches):
        total = np.zeros(1 << RANK_BITS, np.int64)
        for batch in batches:
            for _, _, w in W.batches_of(batch.column(0), lower=True):
                grams, own = W.ngram_hashes(w.hashes(), n), w.text_of_word()
                inside = own[: len(grams)] == own[n - 1 :] if len(grams) else np.zeros(0, bool)
                total += np.bincount((grams[inside] >> _RANK_SHIFT).astype(np.int64), minlength=len(total))
        place = np.flatnonzero(total)
        for at in range(0, len(place), 1 << 14):
            part = place[at : at + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["place", "n"])

    def pack(batches):
        for batch in batches:
            steps = np.minimum(255, 8 * np.log2(1 + batch.column(1).to_numpy())).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy().astype("<i4").tobytes()]), pa.array([steps.tobytes()])], names=["place", "step"])

    counts = docs.select(text_col).mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
    ranks = np.zeros(1 << RANK_BITS, np.uint8)
    for r in counts.mapInArrow(pack, "place binary, step binary").toLocalIterator():  # 2**RANK_BITS places in all
        ranks[np.frombuffer(r["place"], "<i4")] = np.frombuffer(r["step"], np.uint8)
    return ranks


def routing_keys(members: np.ndarray, ranks: np.ndarray, num: int, den: int) -> np.ndarray:
    """The rarest shingles of a sorted set of shingle hashes, so many that linked sets share one."""
    order = np.argsort(ranks[(members >> _RANK_SHIFT).astype(np.int64)], kind="stable")
    return members[order[: len(members) + num * -len(members) // den + 1]]


def shingle_sets(column: pa.Array, n: int):
    """The sorted distinct shingle hashes of each text, in order."""
    for i, j, w in W.batches_of(column, lower=True):
        h = w.hashes()
        grams = W.ngram_hashes(h, n)
        for k in range(j - i):
            a, b = int(w.ptr[k]), int(w.ptr[k + 1])
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield W.mix(W.ngram_hashes(h[a:b], b - a) + _U(b - a))
            else:
                yield np.zeros(0, _U)


def _node(members: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(W.signed(W.mix(W.mix(members ^ _U(0xA5A5A5A5)).sum(dtype=_U).reshape(1) + _U(len(members))))[0])


def _features(num: int, den: int, n: int, names: list[str], shared):
    def run(batches):
        ranks = shared.value
        for batch in batches:
            node, size, keys, vec, fine = [], [], [], [], []
            for s in shingle_sets(batch.column(1), n):
                node.append(_node(s) if len(s) else None)
                size.append(len(s))
                keys.append(W.signed(routing_keys(s, ranks, num, den)))
                vec.append(_counts(s, GROUPS))
                fine.append(_counts(s, _finest(len(s))))
            edge = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
            lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.int64()), pa.array(size, pa.int64()), lists, pa.array(vec, pa.binary()), pa.array(fine, pa.binary())], names=names)

    return run


def _counts(members: np.ndarray, groups: int) -> bytes:
    """Counts by hash group, as single bytes where they fit, else as four; the first byte tells which."""
    counts = np.bincount((members >> _U(65 - groups.bit_length())).astype(np.int64), minlength=groups)
    return b"\1" + counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b"\4" + counts.astype("<u4").tobytes()


def _finest(n: int) -> int:
    """Groups by which a set of n shingles is kept: a power of two."""
    return 1 << (min(max(GROUPS, n), FINEST) - 1).bit_length()


def _unpacked(raw) -> np.ndarray:
    kind = np.uint8 if memoryview(raw)[0] == 1 else "<u4"
    return np.frombuffer(raw, kind, offset=1).astype(np.int32)


def _folded(v: np.ndarray, groups: int) -> np.ndarray:
    return v if len(v) == groups else v.reshape(groups, -1).sum(1, dtype=np.int32)


def _vectors(column: pa.Array) -> np.ndarray:
    """The points of GROUPS groups."""
    data, offsets = W.string_buffers(column)
    if (np.diff(offsets) == GROUPS + 1).all():
        return data.reshape(-1, GROUPS + 1)[:, 1:].astype(np.int32)
    return np.array([_unpacked(x.as_buffer()) for x in column], np.int32).reshape(-1, GROUPS)


def _least(a: np.ndarray, b: np.ndarray) -> int:
    """Summed coordinate minima, by as many groups as both have."""
    groups = min(len(a), len(b))
    return int(np.minimum(_folded(a, groups), _folded(b, groups)).sum())


def _among(reps: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of reps whose node is among nodes: up to BROADCAST_IDS of them (counted) meet the table at the scan."""
    nodes = cut(nodes.distinct())
    return reps.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes, "node", "left_semi")


def _bounded(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes that sizes and summed coordinate minima leave possible: by the tree's groups, and what is left by the finest."""
    reps = _among(reps, pairs.select(F.col("a").alias("node")).union(pairs.select("b")))

    def run(batches):
        for t in batches:
            low = np.array([_least(_unpacked(x.as_buffer()), _unpacked(y.as_buffer())) for x, y in zip(t.column(2), t.column(3))], np.int64)
            keep = (num + den) * low >= num * t.column(4).to_numpy()
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    for vec in ("vec", "fine"):
        side = lambda c, v=vec: reps.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col(v).alias(f"v{c}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.expr(f"{num} * greatest(na, nb) <= {den} * least(na, nb)"))
        pairs = cut(both.select("a", "b", "va", "vb", (F.col("na") + F.col("nb")).alias("n")).mapInArrow(run, "a long, b long"))
    return pairs


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int) -> DataFrame:
    """The pairs whose sets link: the sets are made again from the texts of the nodes concerned."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = cut(reps.join(nodes, "node").select(F.col("id").alias(id_col), "node"))
    ids = wanted.select(id_col).distinct()
    ids = F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids
    texts = docs.select(id_col, text_col).join(ids, id_col, "left_semi")

    def sets(batches):
        for batch in batches:
            node, data = [], []
            for s in shingle_sets(batch.column(1), n):
                node.append(_node(s) if len(s) else None)
                data.append(s.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(data, pa.binary())], names=["node", "members"])

    made = written(texts.mapInArrow(sets, "node long, members binary"), "sets")
    if made.count() > wanted.count():  # ids repeat, maybe by other texts: only the wanted sets stay, each once
        made = written(made.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("members").alias("members")), "sets")
    side = lambda c: made.select(F.col("node").alias(c), F.col("members").alias(f"s{c}"))

    def run(batches):
        for t in batches:
            keep = []
            last, y = None, None
            for a, b in zip(t.column(2), t.column(3)):
                x = np.frombuffer(a.as_buffer(), "<u8")
                raw = b.as_buffer()
                if last is None or not raw.equals(last):
                    last, y = raw, np.frombuffer(raw, "<u8")
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                common = int((y[at] == x).sum())
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (key, node, root, outside, s, t) of buckets with more than one component, without their pivots.

    outside: whether the node is in another component than the bucket's pivot;
    s and t count the nodes outside and inside.
    """
    root = roots.select("node", "root")
    # a node meets its root once, with all its buckets
    held = members.groupBy("node").agg(F.collect_list(F.struct("key", "pivot")).alias("in")).join(root, "node", "left")
    labelled = cut(held.select("node", F.coalesce("root", "node").alias("root"), F.inline("in")))
    # the pivot is a member, so a bucket's rows tell its component without another join; closed buckets end here
    main = F.max(F.when(F.col("node") == F.col("pivot"), F.col("root")))
    buckets = labelled.groupBy("key").agg(main.alias("main"), F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m")).filter("low <> high and m > 2")
    rows = cut(labelled.filter("node <> pivot").join(cut(buckets.select("key", "main")), "key").select("key", "node", "root", (F.col("root") != F.col("main")).alias("outside")))
    counts = rows.groupBy("key").agg(F.sum(F.col("outside").cast("long")).alias("s"), F.sum((~F.col("outside")).cast("long")).alias("t"))
    return cut(rows.join(cut(counts), "key"))


def _partnered(rows: DataFrame) -> DataFrame:
    """Pairs of each node outside its bucket's main component with a few members inside, drawn by hash."""
    inside = rows.filter("not outside").groupBy("key").agg(*(F.min_by("node", F.xxhash64("node", F.lit(k))).alias(f"_{k}") for k in range(PARTNERS)))
    met = rows.filter("outside").select("key", "node").join(cut(inside), "key").select("node", F.explode(F.array(*(f"_{k}" for k in range(PARTNERS)))).alias("b"))
    return met.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()


def _searched(rows: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of different components that share an open bucket and pass the tree's bound.

    A bucket's members in its pivot's component meet only those outside it, and
    these one another, in blocks of about BLOCK by a hash of the node.  A task
    reads its block pairs one after the other, in order of their keys.  Two
    nodes that share one of their first buckets are left to that bucket.
    """
    outside = F.col("outside")
    # a node meets its point once, with all its open buckets, in order of their keys
    held = rows.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("key", "root", "outside", "s", "t"))).alias("in"))
    held = held.join(_among(reps, rows.select("node")).select("node", "n", "vec"), "node")
    rows = held.select("node", "n", "vec", *(F.coalesce(F.get("in.key", F.lit(k)), F.lit((1 << 63) - 1)).alias(f"f{k}") for k in range(FIRST)), F.inline("in"))
    cs, ct = F.ceil(F.col("s") / BLOCK), F.ceil(F.col("t") / BLOCK)
    spot = F.pmod(F.xxhash64("node"), F.when(outside, cs).otherwise(F.greatest(ct, F.lit(1)))).cast("long")
    rows = rows.withColumn("c", F.when(outside, spot).otherwise(cs + spot)).withColumn("j", F.explode(F.when(outside, F.sequence(F.lit(0).cast("long"), cs + ct - 1)).otherwise(F.sequence(F.lit(0).cast("long"), cs - 1))))
    rows = rows.select("key", F.least("c", "j").alias("i"), F.greatest("c", "j").alias("j"), "c", "node", "root", "n", "vec", *(f"f{k}" for k in range(FIRST))).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def search(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        key, i, j = (block.column(k)[0].as_py() for k in range(3))
        c, node, root, size = (block.column(k).to_numpy() for k in (3, 4, 5, 6))
        left, right = np.flatnonzero(c == i), np.flatnonzero(c == j)
        wanted = root[left][:, None] != root[right][None, :]
        for f in range(8, 8 + FIRST):
            x = block.column(f).to_numpy()[left]
            for g in range(8, 8 + FIRST):
                wanted &= (x >= key)[:, None] | (x[:, None] != block.column(g).to_numpy()[right][None, :])
        if not wanted.any():
            return node[:0], node[:0]
        points = _vectors(block.column(7))
        q, p = CountTree(points[right], size[right]).search(points[left], size[left], num, den, wanted)
        return node[left[q]], node[right[p]]

    def run(batches):
        waiting: list[pa.RecordBatch] = []  # the last block pair so far, which may go on
        for batch in _with_end(batches):
            if batch is not None and not batch.num_rows:
                continue
            if batch is None:
                blocks, waiting = [waiting], []
            else:
                names = np.stack([batch.column(k).to_numpy() for k in range(3)])
                edges = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
                parts = [batch.slice(a, b - a) for a, b in zip(edges, edges[1:])]
                same = waiting and all(waiting[-1].column(k)[0] == parts[0].column(k)[0] for k in range(3))
                blocks = [[*waiting, parts[0]], *([x] for x in parts[1:])] if same or not waiting else [waiting, *([x] for x in parts)]
                waiting = blocks.pop()
            found = [search(pa.concat_batches(x)) for x in blocks if x]
            a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def _with_end(batches):
    yield from batches
    yield None


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id) for every document, one row per input row.

    Words are runs of other than ASCII white space, A-Z lower-cased.  Documents
    link when den * |intersection| >= num * |union| of their distinct n-word
    shingles; with fewer words the whole sequence is the one shingle.
    component_id is the smallest id reachable by links, the own included.
    Documents without words or text link with nothing and keep their id.  A
    row with a null id has the component of the rows with its set, if any has
    an id.  Equal sets link whatever ids repeat; other columns are not read;
    an empty table gives no rows.  Sets are compared by 64-bit hashes.
    """
    with scratch(docs.sparkSession):
        return kept(_components(docs, id_col, text_col, n, num, den), "components")


def _components(docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(shingle_ranks(docs, text_col, n))  # 2**RANK_BITS bytes
    names = ["id", "node", "n", "keys", "vec", "fine"]
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("vec", T.BinaryType()), T.StructField("fine", T.BinaryType())])
    path = new_path(docs.sparkSession, "features")
    features = written_at(docs.select(id_col, text_col).mapInArrow(_features(num, den, n, names, shared), schema), path)
    sets = written(features.select("id", "node", "n"), "sets")
    some = features.filter("node is not null and id is not null")
    nodes = written(some.groupBy("node").agg(F.min(F.struct("id", "n", "vec", "fine", "keys")).alias("r")).select("node", "r.*"), "nodes")
    remove(docs.sparkSession, path)
    reps = nodes.drop("keys")

    keyed = nodes.select("node", F.explode("keys").alias("key"))
    heads = written(keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last"), F.count("*").alias("m")).filter("m > 1"), "buckets")
    release(docs.sparkSession)
    # a merge at every size, so that small corpora tell what large ones take
    members = written(keyed.join(heads.filter("m > 2").select("key", "pivot").hint("merge"), "key"), "members")
    release(docs.sparkSession)
    # keys with the same members are one bucket
    marks = members.groupBy("key").agg(F.first("pivot").alias("pivot"), F.count("*").alias("m"), *(F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"_{k}") for k in range(2)))
    chosen = cut(marks.groupBy("pivot", "m", "_0", "_1").agg(F.min("key").alias("key")).select("key"))
    members = written(members.join(chosen, "key", "left_semi"), "members")
    release(docs.sparkSession)
    pairs = cut(heads.filter("m = 2").select(F.col("last").alias("a"), F.col("pivot").alias("b")).union(members.filter("node <> pivot").select("node", "pivot")).distinct())
    edges = cut(_verified(_bounded(pairs, reps, num, den), reps, docs, id_col, text_col, n, num, den))
    roots = connected_components(edges)
    release(docs.sparkSession)
    for find in (_partnered, lambda rows: _searched(rows, reps, num, den)):
        rows = _open(members, roots)
        if rows.isEmpty():
            break
        more = _bounded(cut(find(rows)), reps, num, den)
        if not more.isEmpty():
            edges = cut(edges.union(_verified(more, reps, docs, id_col, text_col, n, num, den)))
            roots = connected_components(edges)
        release(docs.sparkSession)

    linked = roots.join(reps.select("node", "id"), "node")
    least = cut(linked.groupBy("root").agg(F.min("id").alias("least")))
    of_node = reps.select("node", "id").join(cut(linked.join(least, "root").select("node", "least")), "node", "left").select("node", F.coalesce("least", "id").alias("component_id"))
    joined = sets.select("id", "node", "n").join(cut(of_node), "node", "left")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
