"""A graph in versioned Parquet tables: bucketed base files, small changes beside them, and a pointer that names what counts."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphmill.model import EDGES, NODES, as_edges, as_nodes
from graphmill.operators import labels, reader, term_index, traversal
from graphmill.operators.merge import dimension_check, file_subgraph_ids
from graphmill.operators.traversal import cut

#: Changes that may lie beside the base before they are merged into it.
MOST_CHANGES = 8
#: Stored tables: schema, the column whose hash places a row, and the column that the files of a bucket are split by. Edges are there twice, by
#: either end, so that those of a node lie in one bucket.
TABLES = {"nodes": (NODES, "id", "node_type"), "sources": (EDGES, "source_id", "edge_type"), "targets": (EDGES, "target_id", "edge_type")}
USES = T.StructType([T.StructField(c, T.StringType()) for c in ("path", "sort", "key")])


class GraphStore:
    """Merge-on-read tables of nodes and edges.

    The base of a table lies in buckets by a hash of a node's id, each in files by node or edge type. A change
    is a folder of the rows it writes and the ids it removes; readers merge the changes since into the rows of the base that they touch,
    all other rows are read as they are. Beyond MOST_CHANGES changes the buckets that they touch are written anew, and only those.
    A version is what the newest `current` document lists: for each bucket the version that wrote it, and the changes. Writers
    never touch what a version that can be read lists, and what is published at once is seen at once. Any store that Spark's
    Hadoop file systems reach will do.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        """buckets: of a base that is written from now on, by default as many as shuffles have partitions."""
        self.spark, self.root = spark, root.rstrip("/")
        self.wanted = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    # ---- documents ---------------------------------------------------------------------------------------------------

    def _path(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _listed(self, pattern: str) -> list[str]:
        """The last parts of the paths that match, in order."""
        files, path = self._path(pattern)
        return sorted(x.getPath().getName() for x in files.globStatus(path) or ())

    def _versions(self, name: str) -> list[str]:
        """The stored versions of a document, oldest first."""
        return self._listed(f"{name}-*.json")

    def read_text(self, name: str) -> str | None:
        """The newest version of a document; one that a writer removes meanwhile has a newer one beside it."""
        for _ in range(5):
            found = self._versions(name)
            if not found:
                return None
            text = self._text(found[-1])
            if text is not None:
                return text
        raise OSError(f"{name} changes faster than it can be read")

    def _text(self, file: str) -> str | None:
        files, path = self._path(file)
        if not files.exists(path):
            return None
        stream = files.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        """Written whole under a new name, then renamed to be the newest version. There is no time without one: older
        versions go after that, the last one but one excepted."""
        before = self._versions(name)
        number = max(time.time_ns(), *(int(x.removesuffix(".json").rpartition("-")[2]) + 1 for x in before[-1:]), 0)
        files, final = self._path(f"{name}-{number:020d}.json")
        _, beside = self._path(f"_{name}-{uuid.uuid4().hex}")
        stream = files.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not files.rename(beside, final):
            raise OSError(f"{final} could not be written")
        for old in before[:-1]:
            files.delete(self._path(old)[1], False)

    def pointer(self) -> dict:
        return json.loads(self.read_text("current") or '{"version": 0}')

    def state(self) -> dict | None:
        """What the last indexing run left: repository, name, time and result; None before any."""
        found = json.loads(self.read_text("state") or "null")
        if found is not None and not (isinstance(found, dict) and str(found.get("name") or "").strip()):
            raise ValueError("the index state names no graph")
        return found

    def exists(self) -> bool:
        return self.pointer()["version"] > 0

    # ---- reading -----------------------------------------------------------------------------------------------------

    def read(self) -> tuple[DataFrame, DataFrame]:
        at = self.pointer()
        return self._table(at, "nodes"), self._table(at, "sources")

    def around(self, ids: DataFrame, direction: str = "both") -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) that expanding the ids needs: edges with such an end, and nodes from the buckets of both ends. Only those
        buckets' files are opened; a bucket's number is all that the driver sees of an id."""
        at = self.pointer()
        if not at["version"]:
            return self.read()
        own = self._buckets_of(at, ids.select("id"))
        edges = []
        for name, column in (("sources", "source_id"), ("targets", "target_id")):
            if direction == "both" or direction == {"sources": "outgoing", "targets": "incoming"}[name]:
                edges.append(self._table(at, name, own).join(ids.select(F.col("id").alias(column)), column, "left_semi").select(*EDGES.names))
        # A loop, or an edge between two of the ids, is found from either end.
        held = cut(edges[0] if len(edges) == 1 else edges[0].unionByName(edges[1]).dropDuplicates(["id"]))
        ends = held.select(F.explode(F.array("source_id", "target_id")).alias("id"))
        return self._table(at, "nodes", sorted({*own, *self._buckets_of(at, ends)})), held

    def nodes_of(self, ids: DataFrame) -> DataFrame:
        """Nodes by id, from their buckets alone."""
        at = self.pointer()
        return self._table(at, "nodes", self._buckets_of(at, ids) if at["version"] else None).join(ids.select("id"), "id", "left_semi").select(*NODES.names)

    def auto_complete(self, query: str, limit: int) -> DataFrame:
        """reader.auto_complete() over the graph. Where the version has sorted terms, only their files that can hold the prefix are opened."""
        at, wanted = self.pointer(), query.strip().lower()
        if not at.get("terms") or not wanted:
            return reader.auto_complete(self._table(at, "nodes"), query, limit)
        found = term_index.newest([(term_index.with_prefix(self.spark, self._terms_at(v), wanted), self._touched(v)) for v in at["terms"]])
        return found.dropDuplicates(["id"]).orderBy("place", "id").limit(limit).select("id", "type", "label")

    def _labels(self, at: dict) -> DataFrame | None:
        return self.spark.read.schema(labels.LABELS).parquet(f"{self.root}/v{at['labels'][0]}/labels") if at.get("labels") else None

    def descendants(self, seeds: DataFrame) -> DataFrame:
        """traversal.descendants() of the graph: by interval labels where the version has them, else level by level."""
        at = self.pointer()
        held = self._labels(at)
        return traversal.descendants(self._table(at, "sources"), seeds) if held is None else labels.descendants(held, seeds)

    def ancestors(self, seeds: DataFrame) -> DataFrame:
        at = self.pointer()
        nodes, held = self._table(at, "nodes"), self._labels(at)
        return traversal.ancestors(nodes, self._table(at, "sources"), seeds) if held is None else labels.ancestors(nodes, held, seeds)

    def source_files_of(self, seeds: DataFrame) -> DataFrame:
        at = self.pointer()
        nodes, held = self._table(at, "nodes"), self._labels(at)
        return traversal.source_files_of(nodes, self._table(at, "sources"), seeds) if held is None else labels.source_files_of(nodes, held, seeds)

    def _terms_at(self, version: int) -> str:
        return f"{self.root}/v{version}/prefix"

    def _touched(self, version: int) -> DataFrame:
        return self.spark.read.schema("id string").parquet(f"{self._terms_at(version)}/touched")

    def uses(self) -> DataFrame:
        """What the files' uses rest on (path, sort, key), as the last build of each file left it."""
        found = self.spark.createDataFrame([], USES)
        for version in self.pointer().get("uses", []):
            at = f"{self.root}/v{version}"
            again = self.spark.read.schema("path string").parquet(f"{at}/again")
            found = found.join(again, "path", "left_anti").unionByName(self.spark.read.schema(USES).parquet(f"{at}/uses"))
        return found

    def _buckets_of(self, at: dict, ids: DataFrame) -> list[int]:
        return sorted(r[0] for r in ids.select(bucket("id", at)).distinct().collect())

    def _base(self, at: dict, name: str, only: list[int] | None) -> DataFrame:
        schema, _, kind = TABLES[name]
        by_version: dict[int, list[int]] = {}
        for k, version in at.get(name, {}).items():
            if only is None or int(k) in only:
                by_version.setdefault(version, []).append(int(k))
        found = self.spark.createDataFrame([], schema)
        held = None
        for version, buckets in sorted(by_version.items()):
            where = f"{self.root}/v{version}/{name}"
            whole = T.StructType([*(f for f in schema.fields if f.name != kind), T.StructField("bucket", T.IntegerType()), schema[kind]])
            part = self.spark.read.schema(whole).option("basePath", where).parquet(*(f"{where}/bucket={k}" for k in sorted(buckets))).select(*schema.names)
            held = part if held is None else held.unionByName(part)
        return found if held is None else held

    def _changes(self, at: dict, name: str) -> DataFrame | None:
        """Rows and removed ids of all changes: seq (order), gone, and the table's columns."""
        schema, key, _ = TABLES[name]
        what, found = "nodes" if name == "nodes" else "edges", None
        keyed = ["id"] if name == "nodes" else ["id", "source_id", "target_id"]
        for version in at.get("changes", []):
            where = f"{self.root}/v{version}/change"
            gone = self.spark.read.schema(T.StructType([schema[c] for c in keyed])).parquet(f"{where}/gone_{what}").withColumns({"seq": F.lit(2 * version), "gone": F.lit(True)})
            rows = self.spark.read.schema(schema).parquet(f"{where}/{what}").withColumns({"seq": F.lit(2 * version + 1), "gone": F.lit(False)})
            both = rows.unionByName(gone, allowMissingColumns=True)
            found = both if found is None else found.unionByName(both)
        return found

    def _table(self, at: dict, name: str, only: list[int] | None = None) -> DataFrame:
        """The table of a version, or what of it lies in some buckets."""
        schema, key, _ = TABLES[name]
        base, changes = self._base(at, name, only), self._changes(at, name)
        if changes is None:
            return base
        if only is not None:
            changes = changes.filter(bucket(key, at).isin(only))
        touched = changes.select("id").distinct()
        rows = base.join(touched, "id", "left_semi").withColumns({"seq": F.lit(0), "gone": F.lit(False)}).unionByName(changes.select(*schema.names, "seq", "gone"))
        return base.join(touched, "id", "left_anti").select(*schema.names).unionByName(folded(rows, schema.names))

    # ---- writing -----------------------------------------------------------------------------------------------------

    def _publish(self, pointer: dict) -> int:
        self.write_text("current", json.dumps(pointer, sort_keys=True))
        # Folders go that neither this version nor the one before it, which readers may hold, lists.
        kept = {f"v{v}" for file in self._versions("current") for v in listed_versions(json.loads(self._text(file) or "{}"))}
        for folder in self._listed("v*"):
            if folder not in kept and int(folder[1:]) <= pointer["version"]:
                files, gone = self._path(folder)
                files.delete(gone, True)
        return pointer["version"]

    def _write_buckets(self, at: dict, version: int, name: str, rows: DataFrame, ids: DataFrame | None = None) -> dict[str, int]:
        """Writes a table's rows, with ids (id) only those whose key is one, into the buckets of a pointer; {bucket: version}
        of those that hold any. Rows move once: the shuffle that places them by their key is the join's as well."""
        schema, key, kind = TABLES[name]
        where = f"v{version}/{name}"
        if at.get("hash"):
            placed = rows.repartition(at["buckets"], key)
        else:
            placed = rows.withColumn("bucket", bucket(key, at)).repartition(at["buckets"], "bucket")
        if ids is not None:
            # Not a semi-join: the optimizer would take that below the shuffle, and rows would move for it too. Ids are placed alike, as
            # the join would take a number of partitions of its own otherwise.
            own = ids.select(F.col("id").alias(key)).repartition(at["buckets"], key).distinct()
            placed = placed.join(own.hint("shuffle_hash"), key).select(*schema.names)
        placed.withColumn("bucket", bucket(key, at)).sortWithinPartitions("bucket", kind).write.mode("overwrite").partitionBy("bucket", kind).parquet(f"{self.root}/{where}")
        return {x.removeprefix("bucket="): version for x in self._listed(f"{where}/bucket=*")}

    def _vectors(self, nodes: DataFrame, before: dict | None = None) -> dict | None:
        """What the pointer says of the vectors, those of new nodes included; refuses a second length."""
        held = vector_catalog(nodes).first()
        if dimension_check(nodes).first()[0] > 1 or (before and held.vectors and held.dimension != before["dimension"]):
            raise ValueError("more than one embedding dimension in one graph")
        return {"label": held.label, "property": held.property, "dimension": held.dimension, "similarity": "cosine"} if held.vectors else before

    def write(self, nodes: DataFrame, edges: DataFrame, uses: DataFrame | None = None, only_whole: bool = False) -> int:
        """A new version of the whole graph; the one before it stays for readers that hold it, older ones go. only_whole: edges without both
        ends among the nodes are left out."""
        old = self.pointer()
        version = old["version"] + 1
        nodes, edges = as_nodes(nodes), as_edges(edges)
        pointer = {"version": version, "buckets": self.wanted, "hash": "hash", "changes": []}
        pointer["nodes"] = self._write_buckets(pointer, version, "nodes", nodes)
        pointer["vector_index"] = self._vectors(self._base(pointer, "nodes", None))
        ids = self._base(pointer, "nodes", None).select("id") if only_whole else None
        pointer["sources"] = self._write_buckets(pointer, version, "sources", edges, ids)
        # The second copy is made of the first, so edges are computed once.
        pointer["targets"] = self._write_buckets(pointer, version, "targets", self._base(pointer, "sources", None), ids)
        # Each copy lacks the edges whose own end is no node. Where the second lost some, the first is made again of it.
        if only_whole and self._base(pointer, "targets", None).count() < self._base(pointer, "sources", None).count():
            pointer["sources"] = self._write_buckets(pointer, version, "sources", self._base(pointer, "targets", None))
        pointer["uses"] = self._write_uses(version, uses, None)
        if old.get("terms"):
            pointer["terms"] = self._write_terms(version, term_index.terms(self._base(pointer, "nodes", None)))
        return self._publish(pointer)

    def _write_uses(self, version: int, uses: DataFrame | None, again: DataFrame | None) -> list[int]:
        if uses is None:
            return []
        uses.select(*USES.names).write.mode("overwrite").parquet(f"{self.root}/v{version}/uses")
        (again if again is not None else self.spark.createDataFrame([], "path string")).select("path").distinct().write.mode("overwrite").parquet(f"{self.root}/v{version}/again")
        return [version]

    def _write_terms(self, version: int, rows: DataFrame, touched: DataFrame | None = None) -> list[int]:
        """Sorted terms under a version, and the ids whose terms in older ones no longer count."""
        where = self._terms_at(version)
        term_index.write_terms(rows, where, self.wanted)
        (touched if touched is not None else self.spark.createDataFrame([], "id string")).select("id").distinct().write.mode("overwrite").parquet(f"{where}/touched")
        return [version]

    def index_terms(self) -> int:
        """A version with the same rows and sorted terms for auto_complete(); versions after it keep them up."""
        old = self.pointer()
        version = old["version"] + 1
        return self._publish(old | {"version": version, "terms": self._write_terms(version, term_index.terms(self._table(old, "nodes")))})

    def label_forest(self) -> bool:
        """A version with the same rows and interval labels of its containment forest, which stay until a change removes an edge or
        writes one of containment; False, and no version, where containment is no forest."""
        old = self.pointer()
        found = labels.forest_labels(self._table(old, "sources"))
        if found is None:
            return False
        version = old["version"] + 1
        found.select(*labels.LABELS.names).write.mode("overwrite").parquet(f"{self.root}/v{version}/labels")
        self._publish(old | {"version": version, "labels": [version]})
        return True

    def _changed_terms(self, pointer: dict, touched: DataFrame) -> list[int]:
        """The layers of terms once a change, which the pointer lists already, touched nodes (id). A change adds a layer of its own
        size. Beyond MOST_CHANGES of them they become one, or, where that one is over a quarter of the oldest, all become one."""
        version, layers = pointer["version"], pointer["terms"]
        touched = cut(touched.select("id").distinct())
        # The newest change touched all of them, so all that is read of them is folded. The terms are stored, as sorting them by range reads them twice.
        base = self._base(pointer, "nodes", self._buckets_of(pointer, touched)).withColumns({"seq": F.lit(0), "gone": F.lit(False)})
        both = base.unionByName(self._changes(pointer, "nodes").select(*base.columns))
        rows = cut(term_index.terms(folded(both.join(touched.hint("shuffle_hash"), "id", "left_semi"), NODES.names)))
        if len(layers) <= MOST_CHANGES:
            return [*layers, *self._write_terms(version, rows, touched)]
        sizes = [term_index.size_of(self.spark, self._terms_at(v)) for v in layers]
        merged = layers if 4 * sum(sizes[1:]) > sizes[0] else layers[1:]
        read = lambda v: self.spark.read.schema(term_index.TERMS).parquet(f"{self._terms_at(v)}/terms")
        whole = term_index.newest([*((read(v), self._touched(v)) for v in merged), (rows, touched)])
        if merged is layers:
            return self._write_terms(version, whole)
        for v in merged:
            touched = touched.unionByName(self._touched(v))
        return [layers[0], *self._write_terms(version, whole, touched)]

    def overwrite(self, nodes: DataFrame, edges: DataFrame, uses: DataFrame | None = None) -> int:
        """Full rebuild: edges without both ends are left out, as in an upsert into an empty graph."""
        return self.write(nodes, edges, uses, only_whole=True)

    def change(self, nodes: DataFrame, edges: DataFrame, gone_nodes: DataFrame | None = None, gone_edges: DataFrame | None = None, uses: DataFrame | None = None, again: DataFrame | None = None) -> int:
        """One version on: removes nodes (id) and edges (id, source_id, target_id), then upserts nodes and edges: a filled property of a new row
        wins, one it lacks keeps its value. An edge without both ends is left out, silently. Writes as much as it is given.

        uses replaces what the files in again (path) rest on.
        """
        old = self.pointer()
        if not old["version"]:
            return self.overwrite(nodes, edges, uses)
        version = old["version"] + 1
        where = f"{self.root}/v{version}/change"
        gone_nodes = gone_nodes if gone_nodes is not None else self.spark.createDataFrame([], "id string")
        gone_edges = gone_edges if gone_edges is not None else self.spark.createDataFrame([], "id string, source_id string, target_id string")
        as_nodes(nodes).write.mode("overwrite").parquet(f"{where}/nodes")
        gone_nodes.select("id").distinct().write.mode("overwrite").parquet(f"{where}/gone_nodes")
        gone_edges.select("id", "source_id", "target_id").distinct().write.mode("overwrite").parquet(f"{where}/gone_edges")
        new = self.spark.read.schema(NODES).parquet(f"{where}/nodes")
        vectors = self._vectors(new, old.get("vector_index"))
        lost = self.spark.read.schema("id string").parquet(f"{where}/gone_nodes")
        alive = self._table(old, "nodes").select("id").join(lost, "id", "left_anti").unionByName(new.select("id"))
        with_both_ends(as_edges(edges), alive).write.mode("overwrite").parquet(f"{where}/edges")
        # Once there are many, the changes so far go into the base in the same step, so readers lose no version early.
        held = self._compacted(old, version) if len(old.get("changes", [])) >= MOST_CHANGES else old
        pointer = held | {"version": version, "changes": [*held.get("changes", []), version], "vector_index": vectors}
        if uses is not None:
            pointer["uses"] = [*held.get("uses", []), *self._write_uses(version, uses, again)]
        if pointer.get("labels"):
            read = lambda name: self.spark.read.parquet(f"{where}/{name}")
            if not (read("gone_edges").isEmpty() and read("edges").filter("edge_type = 'CONTAINS'").isEmpty()):
                del pointer["labels"]
        if pointer.get("terms"):
            pointer["terms"] = self._changed_terms(pointer, new.select("id").unionByName(lost))
        return self._publish(pointer)

    def _compacted(self, old: dict, version: int) -> dict:
        """A pointer to the same rows without changes: the buckets that these touch are written anew, under a version."""
        pointer = old | {"changes": []}
        for name, (_, key, _) in TABLES.items():
            changes = self._changes(old, name)
            touched = self._buckets_of(old, changes.select(F.col(key).alias("id"))) if changes is not None else []
            if touched:
                written = self._write_buckets(old, version, name, self._table(old, name, touched))
                pointer[name] = {k: v for k, v in old[name].items() if int(k) not in touched} | written
        return pointer

    def compact(self) -> int:
        """A version with the same rows and no changes beside the base."""
        old = self.pointer()
        pointer = self._compacted(old, old["version"] + 1) | {"version": old["version"] + 1}
        if len(old.get("uses", [])) > 1:
            pointer["uses"] = self._write_uses(pointer["version"], self.uses(), None)
        if len(old.get("terms", [])) > 1:
            pointer["terms"] = self._write_terms(pointer["version"], term_index.terms(self._table(pointer, "nodes")))
        return self._publish(pointer)

    def upsert(self, nodes: DataFrame, edges: DataFrame) -> int:
        """All nodes, then the edges whose ends are there after that."""
        return self.change(nodes, edges)

    def _held(self, nodes: DataFrame, edges: DataFrame, paths: DataFrame | list[str]) -> DataFrame:
        """Ids of the files with these paths and of all that belongs to them."""
        if not isinstance(paths, DataFrame):
            paths = self.spark.createDataFrame([(p,) for p in paths], "path string")
        files = nodes.filter("node_type = 'File'").join(paths.select(F.col("path").alias("relative_path")), "relative_path", "left_semi").select("id")
        return cut(file_subgraph_ids(nodes, edges, files))

    def delete_files(self, paths: DataFrame | list[str]) -> int:
        """Drops the files (a list, or a table with `path`) with all they contain, their anchors and their summaries;
        returns how many nodes that were."""
        nodes, edges = self.read()
        ids = self._held(nodes, edges, paths)
        n = ids.count()
        if n:
            self.change(nodes.limit(0), edges.limit(0), ids, edges_at(edges, ids))
        return n

    def refresh(self, gone: DataFrame | list[str], nodes: DataFrame, edges: DataFrame, gone_edges: DataFrame | None = None, uses: DataFrame | None = None, again: DataFrame | None = None) -> int:
        """delete_files(gone) and upsert(nodes, edges) as one version: readers see both or neither. gone_edges (id): edges that go besides."""
        old_nodes, old_edges = self.read()
        ids = self._held(old_nodes, old_edges, gone)
        lost = edges_at(old_edges, ids)
        if gone_edges is not None:
            lost = lost.unionByName(old_edges.join(gone_edges.select("id"), "id", "left_semi").select("id", "source_id", "target_id"))
        self.change(nodes, edges, ids, lost, uses, again)
        return ids.count()

    def file_hashes(self, language: str = "java") -> DataFrame:
        return file_hashes(self.read()[0], language)

    def schema(self) -> dict:
        """What an assistant is told of the tables."""
        nodes, edges = self.read()
        return {"nodes": {f.name: f.dataType.simpleString() for f in nodes.schema}, "edges": {f.name: f.dataType.simpleString() for f in edges.schema}, "vector_index": self.pointer().get("vector_index")}


def bucket(column: str, at: dict) -> Column:
    """The bucket of a key in a pointer's base: since pointers name it, by the hash that Spark's shuffles place rows by, so that a task writes
    one bucket; an older base is placed by another one and keeps it."""
    return F.pmod(F.hash(column) if at.get("hash") else F.xxhash64(column), F.lit(at["buckets"])).cast("int").alias("bucket")


def listed_versions(pointer: dict) -> set[int]:
    """The versions whose folders a pointer needs."""
    return {*pointer.get("changes", []), *pointer.get("uses", []), *pointer.get("terms", []), *pointer.get("labels", []), *(v for name in TABLES for v in pointer.get(name, {}).values())}


def folded(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of one id as one, in order of seq: each column's last filled value since the id was last removed; none if that came last."""
    since = rows.filter("gone").groupBy("id").agg(F.max("seq").alias("since"))
    alive = rows.filter("not gone").join(since, "id", "left").filter("since is null or seq > since")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return alive.groupBy("id").agg(*(last(c) for c in columns if c != "id")).select(*columns)


def with_both_ends(edges: DataFrame, ids: DataFrame) -> DataFrame:
    for end in ("source_id", "target_id"):
        edges = edges.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    return edges.select(*EDGES.names)


def without_open_ends(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """with_both_ends() for a whole graph, of which few edges lack an end: they are stored once, ends that are no node are found among the
    different ones, and only these meet the edges again. Where there are none, no edge moves."""
    edges = cut(edges.filter("source_id is not null and target_id is not null"))
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    lost = cut(ends.join(ids, "id", "left_anti"))
    if lost.isEmpty():
        return edges
    for end in ("source_id", "target_id"):
        edges = edges.join(lost.select(F.col("id").alias(end)), end, "left_anti")
    return edges.select(*EDGES.names)


def edges_at(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, source_id, target_id) of the edges with either end among the ids."""
    parts = [edges.join(ids.select(F.col("id").alias(end)), end, "left_semi").select("id", "source_id", "target_id") for end in ("source_id", "target_id")]
    return parts[0].unionByName(parts[1]).distinct()


def file_hashes(nodes: DataFrame, language: str = "java") -> DataFrame:
    """(path, content_hash) of the files of a language."""
    return nodes.filter((F.col("node_type") == "File") & (F.col("language") == language)).select(F.col("relative_path").alias("path"), "content_hash")


def vector_catalog(nodes: DataFrame) -> DataFrame:
    """One row: label, property, dimension and number of the vectors that the nodes hold."""
    held = nodes.filter("embedding is not null")
    return held.agg(F.lit("Summary").alias("label"), F.lit("embedding").alias("property"), F.max(F.size("embedding")).cast("long").alias("dimension"), F.count("*").alias("vectors"))
