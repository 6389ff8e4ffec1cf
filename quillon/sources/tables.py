"""Schemas, readers and sinks: nested dictionaries, edge lists, graph collections, logs and score files.

Readers take anything that Spark can read; layouts are told by schema, never
inferred.  What comes out is plain tables: papers, author rows, nodes, edges,
triples, interactions, readings.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PERSON = "struct<name:string,org:string>"
PAPER = f"id string, title string, abstract string, keywords array<string>, authors array<{PERSON}>, venue string, year int"
AUTHOR = "name string, normal_data array<string>, outliers array<string>, papers array<string>"

#: The driver's tables.
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


#: Rows that a task sorts or groups, on average, where rows are counted first.
TASK_ROWS = 1 << 20
#: The same of scores, which a task holds as texts.
SCORE_ROWS = 1 << 18


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tasks_for(rows: int) -> int:
    """Tasks of about TASK_ROWS rows."""
    return -(-rows // TASK_ROWS)


def dealt(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """df by hash of its keys in at least that many tasks, so that sorts and groups of a task don't grow with the table; as it is for one task.

    Windows and aggregates by these keys need no other shuffle.
    """
    return df.repartition(max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys) if tasks > 1 else df


def register_views(spark: SparkSession, folder: str) -> None:
    for name in NAMES:
        table(spark, folder, name).createOrReplaceTempView(name)


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in the cluster's shared one (spark.checkpoint.dir); it goes when the application ends.

    Only where that is unset and all runs on one machine, as in tests, a folder
    of this session's own is set.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
        folder = sc._jsc.sc().getCheckpointDir().get()
    own = f"{folder.rstrip('/')}/quillon/{sc.applicationId}"
    if own not in _own_folders:
        _own_folders.add(own)
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
    return own


_own_folders: set[str] = set()


def new_path(spark: SparkSession, name: str = "table") -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """df computed once and its lineage cut: a table in the cluster's shared folder.

    Its size estimates are those of its files, so plans of iterations neither
    grow nor misjudge their joins, and a lost executor loses nothing.
    """
    path = new_path(df.sparkSession, "cut")
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file of given bytes on any file system that Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    out.write(data)
    out.close()


# --------------------------------------------------------------- dictionaries


def _entries(spark: SparkSession, path: str, value: str, size: int | None) -> DataFrame:
    """(key, value) of JSON objects that map keys to structs; one object a file, of any size."""
    from quillon.sources import dictionaries

    return dictionaries.read_dictionary(spark, path, f"struct<{_fields(value)}>", size or dictionaries.RANGE)


def _fields(ddl: str) -> str:
    return T._parse_datatype_string(ddl).simpleString()[len("struct<") : -1]


def read_papers(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """{id: paper} dictionaries as one row a paper, read in ranges of `size` bytes; the id inside wins."""
    return _entries(spark, path, PAPER, size).select("value.*")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Papers as one JSON object a line, with the file each came from."""
    return spark.read.schema(PAPER).json(path).withColumn("file", F.input_file_name())


def read_authors(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    return unpivot_authors(_entries(spark, path, AUTHOR, size).select(F.col("key").alias("author_id"), "value.*"))


def unpivot_authors(authors: DataFrame) -> DataFrame:
    """(author_id, author_name, id, pos, label): 1 for normal papers, 0 for outliers, -1 for unlabelled; in the lists' order."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    empty = F.array().cast("array<string>")
    marked = lambda c, v: F.transform(F.coalesce(c, empty), lambda x: F.struct(x.alias("id"), F.lit(v).alias("label")))
    every = F.concat(*(marked(c, v) for c, v in (("normal_data", 1), ("outliers", 0), ("papers", -1))))
    return authors.filter(size("normal_data") + size("outliers") + size("papers") > 0).select("author_id", F.col("name").alias("author_name"), F.posexplode(every).alias("pos", "p")).select("author_id", "author_name", "p.id", "pos", "p.label")


# --------------------------------------------------------------- graphs


def numbered_lines(df: DataFrame, name: str = "line") -> DataFrame:
    """Lines of text files with their number from 0, over all files by path and inside each by place.

    df is what spark.read.text gives.  Files are read in splits, in any order;
    a line is counted in its split, and the splits' totals, one row each,
    are summed in the order of files and places.
    """
    from quillon.operators.tables import running_total

    marked = cut(df.select(*df.columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")))
    splits = cut(marked.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")))
    before = running_total(splits, [F.asc("_file"), F.asc("_block")], "_n", "_before").drop("_n")
    return marked.join(before, ["_file", "_block"]).select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias(name))


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst", tasks: int = 1) -> DataFrame:
    """Both directions of every edge once, without loops; see `dealt` for tasks."""
    kept = edges.filter(F.col(src) != F.col(dst)).select(src, dst)
    return dealt(kept.union(kept.select(dst, src)), tasks, src, dst).distinct()


def adjacency_edges(adjacency: DataFrame, node: str = "id", neighbours: str = "neighbours") -> DataFrame:
    """Undirected edges of (node, neighbour list) rows."""
    return undirected(adjacency.select(F.col(node).alias("src"), F.explode(neighbours).alias("dst")))


def split_masks(nodes: DataFrame, role: str = "role") -> DataFrame:
    return nodes.select("*", *((F.col(role) == r).alias(r) for r in ("train", "val", "test")))


def read_edge_list(spark: SparkSession, path: str, sep: str = "\t", names: tuple = ("src", "dst"), kinds: tuple = ("long", "long"), comment: str = "#") -> DataFrame:
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds))
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").csv(path, sep=sep, comment=comment)


def read_triples(spark: SparkSession, path: str, split: str) -> DataFrame:
    """(h, r, t, split) of lines "h t r"; lines of other than three fields are headers and skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") == 3)
    return lines.select(F.col("p")[0].cast("long").alias("h"), F.col("p")[2].cast("long").alias("r"), F.col("p")[1].cast("long").alias("t"), F.lit(split).alias("split"))


def read_multiplex(spark: SparkSession, path: str, split: str) -> DataFrame:
    """(etype, u, v, label, split) of lines "type u v [label]"; without a label 1."""
    p = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(p.alias("p")).filter(F.size("p") >= 3)
    return lines.select(F.col("p")[0].alias("etype"), F.col("p")[1].cast("long").alias("u"), F.col("p")[2].cast("long").alias("v"), F.coalesce(F.get("p", F.lit(3)).cast("int"), F.lit(1)).alias("label"), F.lit(split).alias("split"))


def read_interactions(spark: SparkSession, path: str, split: str = "train") -> DataFrame:
    """(user, item, split) of lines "user item item ..."; items once a user."""
    p = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("long"))
    lines = spark.read.text(path).filter(F.trim("value") != "").select(p.alias("p"))
    return lines.select(F.col("p")[0].alias("user"), F.explode(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))).alias("item")).distinct().withColumn("split", F.lit(split))


def read_collection(spark: SparkSession, edges: str, indicator: str, labels: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph collection in line files: "a, b" edges of nodes numbered from 1, the graph of each node by line.

    Nodes are numbered from 0 in their graph; loops and repeated edges go.
    """
    graph = numbered_lines(spark.read.text(indicator)).select((F.col("line") + 1).alias("node"), F.trim("value").cast("long").alias("graph_id"))
    nodes = graph.join(graph.groupBy("graph_id").agg(F.min("node").alias("first")), "graph_id").select("graph_id", "node", (F.col("node") - F.col("first")).alias("id"))
    if labels:
        by_graph = numbered_lines(spark.read.text(labels)).select((F.col("line") + 1).alias("graph_id"), F.trim("value").cast("long").alias("graph_label"))
        nodes = nodes.join(by_graph, "graph_id", "left")
    p = F.split("value", r"\s*,\s*")
    pairs = spark.read.text(edges).select(F.trim(p[0]).cast("long").alias("a"), F.trim(p[1]).cast("long").alias("b")).filter("a <> b").distinct()
    side = lambda c, n: nodes.select(F.col("node").alias(c), F.col("graph_id").alias(f"g{c}"), F.col("id").alias(n))
    made = pairs.join(side("a", "src"), "a").join(side("b", "dst"), "b").filter("ga = gb").select(F.col("ga").alias("graph_id"), "src", "dst")
    return nodes.drop("node"), made


def local_ids(edges: DataFrame, graph: str = "graph_id") -> DataFrame:
    """Edges with node numbers counted from the smallest of their graph."""
    least = F.min(F.least("src", "dst")).over(Window.partitionBy(graph))
    return edges.select(graph, (F.col("src") - least).alias("src"), (F.col("dst") - least).alias("dst"))


def repeated_edges(edges: DataFrame, times: str = "times") -> DataFrame:
    """Weighted edges in both directions, as often as their weight says."""
    each = edges.filter(F.col(times) > 0).select("x", "y", F.explode(F.sequence(F.lit(1), F.col(times))).alias("_k"))
    return each.select(F.col("x").alias("src"), F.col("y").alias("dst")).union(each.select("y", "x"))


def community_labels(lines: DataFrame, text: str = "value", number: str = "line") -> DataFrame:
    """(id, labels): of lines of node ids, one line a community."""
    each = lines.select(F.col(number).alias("label"), F.explode(F.split(F.trim(text), r"\s+")).alias("id")).filter("id <> ''")
    return each.groupBy(F.col("id").cast("long").alias("id")).agg(F.sort_array(F.collect_set("label")).alias("labels"))


def above_median(labels: DataFrame, label: str = "label") -> DataFrame:
    """1 where the label is above the interpolated median."""
    return labels.crossJoin(labels.agg(F.expr(f"percentile({label}, 0.5)").alias("_m"))).withColumn("above", (F.col(label) > F.col("_m")).cast("int")).drop("_m")


def node_types(edges: DataFrame, relations: dict[str, tuple[int, int]]) -> DataFrame:
    """(id, node_type) by the ends that nodes take in relations; later relations win."""
    parts, kinds = None, [k for pair in relations.values() for k in pair]
    low, span = min(kinds), max(kinds) - min(kinds) + 1
    for order, (name, (source, target)) in enumerate(relations.items()):
        for column, kind in (("src", source), ("dst", target)):
            # order and type in one number, whose maximum needs no sort
            part = edges.filter(F.col("rel") == name).select(F.col(column).alias("id"), F.lit(order * span + kind - low).cast("long").alias("k"))
            parts = part if parts is None else parts.union(part)
    return parts.groupBy("id").agg((F.max("k") % span + low).cast("int").alias("node_type"))


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, w) of a compressed-row matrix in a .npz file (arrays data, indices, indptr), as sparse matrices are saved."""
    import io

    import numpy as np

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for raw in batch.column(0):
                with np.load(io.BytesIO(raw.as_buffer()), allow_pickle=False) as m:
                    data, indices, pointers = (m[k] for k in ("data", "indices", "indptr"))
                lines = np.repeat(np.arange(len(pointers) - 1), np.diff(pointers))
                for at in range(0, len(lines), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(lines[part].astype(np.int64)), pa.array(indices[part].astype(np.int64)), pa.array(data[part].astype(float))], names=["src", "dst", "w"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "src long, dst long, w double")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, x) of the rows of a matrix in a .npy file."""
    import io

    import numpy as np

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for raw in batch.column(0):
                m = np.load(io.BytesIO(raw.as_buffer()), allow_pickle=False).astype(float)
                for at in range(0, len(m), 1 << 12):
                    part = m[at : at + (1 << 12)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), pa.array(list(part), pa.list_(pa.float64()))], names=["id", "x"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "id long, x array<double>")


def read_inductive(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Tables of an inductive graph's folder: edges_full, edges_train, features, labels (id, y), roles (id, train, val, test).

    adj_full.npz, adj_train.npz, feats.npy, class_map.json (id to a class, or to
    a list of 0 and 1) and role.json (lists tr, va, te).
    """
    classes = spark.read.text(f"{folder}/class_map.json", wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "y"))
    lists = spark.read.text(f"{folder}/role.json", wholetext=True).select(F.from_json("value", "tr array<long>, va array<long>, te array<long>").alias("r"))
    ids = lists.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, ("tr", "va", "te"))), F.array("r.tr", "r.va", "r.te"))).alias("role", "ids")).select("role", F.explode("ids").alias("id"))
    roles = ids.groupBy("id").agg(*(F.max(F.col("role") == k).alias(n) for k, n in (("tr", "train"), ("va", "val"), ("te", "test"))))
    return {
        "edges_full": read_adjacency(spark, f"{folder}/adj_full.npz"),
        "edges_train": read_adjacency(spark, f"{folder}/adj_train.npz"),
        "features": read_vectors(spark, f"{folder}/feats.npy"),
        "labels": classes.select(F.col("id").cast("long").alias("id"), F.from_json(F.when(F.col("y").startswith("["), F.col("y")).otherwise(F.concat(F.lit("["), F.col("y"), F.lit("]"))), "array<int>").alias("y")),
        "roles": roles,
    }


def covering_split(labels: DataFrame, shares: dict[str, float], first: str = "train", seed: int = 0, tries: int = 100) -> DataFrame:
    """(id, y, split) of the labelled rows (y not -1), split by md5 with the first seed that puts every class into `first`."""
    from quillon.operators.tables import hash_split

    known = cut(labels.filter("y <> -1").select("id", "y"))
    classes = known.agg(F.countDistinct("y")).first()[0]
    for k in range(tries):
        made = hash_split(known, ["id"], shares, str(seed + k))
        if made.filter(F.col("split") == first).agg(F.countDistinct("y")).first()[0] == classes:
            return made
    raise ValueError(f"no split of {tries} covers all {classes} classes")


# --------------------------------------------------------------- time series


def read_readings(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Sensor rows of files whose names hold a date yyyy_mm_dd; week days only, without null time or speed."""
    df = spark.read.schema(columns).option("timestampFormat", "MM/dd/yyyy HH:mm:ss").csv(path)
    day = F.to_date(F.regexp_extract(F.input_file_name(), r"(\d{4}_\d{2}_\d{2})", 1), "yyyy_MM_dd")
    return df.withColumn("day", day).filter(F.weekday("day") < 5).dropna(subset=["timestamp", "avg_speed"])


# --------------------------------------------------------------- sinks


def write_corpus(df: DataFrame, text: str, path: str) -> None:
    """Non-blank texts, a line each (line breaks inside become spaces)."""
    df.filter(F.trim(text) != "").select(F.regexp_replace(text, r"[\r\n]+", " ").alias("value")).write.text(path)


def write_sample(df: DataFrame, order: list, n: int, path: str) -> None:
    df.orderBy(*order).limit(n).write.csv(path, header=True)


def nested_scores(scores: DataFrame, outer: str = "author_id", item: str = "id", score: str = "score", order: str | None = None) -> DataFrame:
    """(outer, scores): a map of items to scores for each outer key; of several scores of an item the last by `order` (or the largest) wins.

    A task holds the scores of its outer keys, of about SCORE_ROWS counted rows.
    """
    known = scores.filter(F.col(outer).isNotNull() & F.col(item).isNotNull())
    one = dealt(known, -(-known.count() // SCORE_ROWS), outer).groupBy(outer, item).agg((F.max_by(score, order) if order else F.max(score)).alias("_s"))
    entries = F.sort_array(F.collect_list(F.struct(F.col(item).cast("string").alias("k"), F.col("_s").alias("v"))))
    return one.groupBy(outer).agg(F.map_from_entries(entries).alias("scores"))


def write_scores(scores: DataFrame, path: str, **columns) -> None:
    """Scores as lines of JSON, one object {outer key: {item: score}} a line; read_scores takes them back."""
    made = nested_scores(scores, **columns)
    outer = made.columns[0]
    made.select(F.to_json(F.create_map(F.col(outer).cast("string"), "scores")).alias("value")).write.text(path)


def write_score_object(scores: DataFrame, path: str, indent: int = 4, **columns) -> None:
    """All scores as the one JSON object {outer key: {item: score}} that a submission is, `indent` spaces a level.

    The object's lines are rows in order; its single file is written by one
    task that streams them.
    """
    made = nested_scores(scores, **columns)
    outer, pad = F.col(made.columns[0]).cast("string"), " " * indent
    line = lambda k: F.regexp_extract(F.to_json(F.create_map(k, F.lit(0))), r'^.(.*):0.$', 1)  # a key as JSON
    entries = F.transform(F.map_entries("scores"), lambda e: F.concat(F.lit(pad * 2), line(e["key"]), F.lit(": "), F.to_json(F.array(e["value"])).substr(F.lit(2), F.length(F.to_json(F.array(e["value"]))) - 2)))
    body = F.concat(F.lit(pad), line(outer), F.lit(": {\n"), F.array_join(entries, ",\n"), F.lit("\n" + pad + "}"))
    from quillon.operators.tables import dense_positions

    numbered = dense_positions(made.select(outer.alias("k"), body.alias("value")), [F.asc("k")], "at")
    last = F.lit(numbered.count() - 1)
    closed = numbered.select("at", F.concat(F.when(F.col("at") == 0, "{\n").otherwise(""), "value", F.when(F.col("at") == last, "\n}").otherwise(",")).alias("value"))
    closed.orderBy("at").coalesce(1).select("value").write.text(path)


def read_scores(spark: SparkSession, path: str, wholetext: bool = False, size: int | None = None) -> DataFrame:
    """(author_id, id, score) of written scores, as lines or as one object, which is read in ranges of `size` bytes."""
    if wholetext:
        from quillon.sources import dictionaries

        outer = dictionaries.read_dictionary(spark, path, "map<string,double>", size or dictionaries.RANGE).toDF("author_id", "_s")
    else:
        outer = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,map<string,double>>")).alias("author_id", "_s"))
    return outer.select("author_id", F.explode("_s").alias("id", "score"))


def write_csv(df: DataFrame, path: str) -> None:
    """A header line and CSV rows; arrays, maps and structs as JSON, which read_csv parses by schema."""
    nested = [n for n, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    df.select(*(F.to_json(n).alias(n) if n in nested else F.col(n) for n in df.columns)).write.option("header", True).option("quoteAll", True).option("escape", '"').option("nullValue", "\\N").option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What write_csv wrote, with its types."""
    nested = {f.name for f in schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))}
    flat = T.StructType([T.StructField(f.name, T.StringType() if f.name in nested else f.dataType) for f in schema])
    df = spark.read.schema(flat).option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\\N").option("emptyValue", "").csv(path)
    return df.select(*(F.from_json(f.name, f.dataType).alias(f.name) if f.name in nested else F.col(f.name) for f in schema))


def write_family(df: DataFrame, path: str, key: str = "author_id", buckets: int = 0, name: str | None = None) -> None:
    """A feature family as Parquet; bucketed by its key as a catalog table if asked, so later joins need no shuffle."""
    writer = df.write.mode("overwrite")
    if buckets:
        writer.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    else:
        writer.parquet(path)


def append_metrics(spark: SparkSession, path: str, step: int, metrics: dict[str, float]) -> None:
    spark.createDataFrame([(step, k, float(v)) for k, v in metrics.items()], "step int, metric string, value double").coalesce(1).write.mode("append").parquet(path)
