"""The store: corpora, documents and slices as layers of Parquet files behind a manifest.

Slices whose vectors are made anew at the cost of a hash (embedders.made_anew) are not stored: their layer holds the documents'
texts, and a reader cuts what it asks for out of them. All other slices are stored as rows.

A change writes one layer: its new rows, and the keys of rows of earlier layers that are gone with it. So a change costs what it
holds, however large the corpus is. Readers see the layers that one manifest names, a row being there unless a later
layer lists its key; slices lie in a folder for each size. Layers of changes are merged when there are many, and into the base once they are a fair part of
it. A manifest is written under a name of its own, then renamed to its number, which must be free: readers see it whole or not
at all, and of two writers that start from the same one the second fails. Only manifests pass through the driver.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CorpusExists, CorpusNotFound, DocumentNotFound, EmbedderMismatch, StoreUnavailable, ValidationError
from ..functions import counters
from ..functions.embedders import made_anew
from ..grid import Grid
from ..operators.retrieval import search
from ..operators.slicing import KEY, slice_documents
from .shared import few, file_system, hadoop_path, materialise, read_text, remove, write_text

#: Layers of a corpus before those above the base are merged; from this part of the base's rows on they are merged into it.
MOST_LAYERS, FAIR_PART = 8, 0.25
#: Keys of gone rows that are sent to the scan at most; more of them go through a shuffle.
BROADCAST_KEYS = 1_000_000
#: Pages that are read at once for a client that asks for one after another, and records of them at most.
READ_AHEAD, READ_AHEAD_ROWS = 20, 20_000
METRIC = "cosine"
SLICES = (
    "corpus string, document_id string, size int, codepoint_offset int, codepoint_length int, byte_offset int, byte_length int, "
    "document_codepoint_length int, text string, own_marker string, descendant_markers array<string>, token_count int, "
    "point_id string, vector array<double>"
)
DOCUMENTS = (
    "document_id string, codepoint_length int, byte_length int, slice_count long, content_marker string, "
    "metadata array<struct<key:string,value:string>>"
)
TEXTS = "document_id string, text string"
#: What lean slices go without: it ties a slice to its document's others.
TIED = ("byte_offset", "descendant_markers")
COLUMNS = {"slices": SLICES, "documents": DOCUMENTS}
#: What tells rows of a table apart.
OWN_KEY = {"slices": ["document_id", "point_id"], "documents": ["document_id"]}


@dataclass(frozen=True)
class CorpusConfig:
    """Written once, when the corpus is created."""

    name: str
    sizes: tuple[int, ...]
    embedder_fingerprint: str
    dimension: int
    token_counter_id: str
    metric: str = METRIC

    @property
    def grid(self) -> Grid:
        return Grid(tuple(self.sizes))


@dataclass(frozen=True)
class Part:
    """What a reader asks of the slices. sizes: these only; of: these documents only (document_id, each once); lean: without TIED;
    vectors: made where they are not stored, else null there."""

    sizes: tuple[int, ...] | None = None
    of: DataFrame | None = None
    lean: bool = False
    vectors: bool = True

    def held(self, df: DataFrame) -> DataFrame:
        if self.of is None:
            return df
        return df.join(F.broadcast(self.of) if few(self.of, BROADCAST_KEYS) else self.of, "document_id", "left_semi")


class Catalog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._ahead: tuple[tuple, list[dict]] = ((), [])

    # Manifests.

    def _at(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _listed(self, *parts: str) -> list[tuple[str, float]]:
        """(name, time of change in seconds) of what a folder holds."""
        fs, at = file_system(self.spark, self.root), hadoop_path(self.spark, self._at(*parts))
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(at)] if fs.exists(at) else []

    def _versions(self) -> list[int]:
        if not file_system(self.spark, self.root).exists(hadoop_path(self.spark, self._at("_manifest"))):
            raise StoreUnavailable(f"{self.root} is not set up")
        return sorted(int(n.split(".")[0]) for n, _ in self._listed("_manifest") if n.endswith(".json") and not n.startswith("_"))

    def _read(self, version: int) -> dict:
        return json.loads(read_text(self.spark, self._at("_manifest", f"{version:010d}.json")))

    def _manifest(self) -> tuple[int, dict]:
        version = self._versions()[-1]
        return version, self._read(version)

    def _flip(self, version: int, manifest: dict) -> None:
        draft, final = self._at("_manifest", f"_{uuid.uuid4().hex}.json"), self._at("_manifest", f"{version + 1:010d}.json")
        write_text(self.spark, draft, json.dumps(manifest, sort_keys=True))
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(hadoop_path(self.spark, final).toUri(), self.spark._jsc.hadoopConfiguration())
        free = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # no overwriting
        try:
            files.rename(hadoop_path(self.spark, draft), hadoop_path(self.spark, final), free)
        except Exception as e:
            remove(self.spark, draft)
            raise StoreUnavailable("another writer was first; try again") from e

    # The interface.

    def ping(self) -> bool:
        try:
            return bool(self._versions())
        except Exception:
            return False

    def bootstrap(self) -> None:
        file_system(self.spark, self.root).mkdirs(hadoop_path(self.spark, self._at("_manifest")))
        if not self._versions():
            self._flip(-1, {"corpora": {}})

    def _corpus(self, name: str) -> tuple[int, dict, dict]:
        version, manifest = self._manifest()
        if name not in manifest["corpora"]:
            raise CorpusNotFound(name)
        return version, manifest, manifest["corpora"][name]

    def create_corpus(self, config: CorpusConfig) -> None:
        version, manifest = self._manifest()
        if config.name in manifest["corpora"]:
            raise CorpusExists(config.name)
        manifest["corpora"][config.name] = {"config": asdict(config), "layers": []}
        self._flip(version, manifest)

    def drop_corpus(self, name: str) -> None:
        version, manifest, _ = self._corpus(name)
        del manifest["corpora"][name]
        self._flip(version, manifest)
        remove(self.spark, self._at("data", name.encode().hex()))

    def get_corpus_meta(self, name: str) -> CorpusConfig:
        c = self._corpus(name)[2]["config"]
        return CorpusConfig(**{**c, "sizes": tuple(c["sizes"])})

    def list_corpora(self) -> list[str]:
        return sorted(self._manifest()[1]["corpora"])

    def verify_corpus(self, name: str) -> list[str]:
        """Reasons why the corpus is degraded; none if it is healthy."""
        config, corpus = self.get_corpus_meta(name), self._corpus(name)[2]
        fs = file_system(self.spark, self.root)
        layers = corpus["layers"]
        reasons = [f"files of {table} are missing: {at}" for layer in layers for table in COLUMNS for at in layer[table].values() if not fs.exists(hadoop_path(self.spark, at))]
        if config.metric != METRIC:
            reasons.append(f"the corpus is set up for the metric {config.metric}, and searched by {METRIC}")
        for n, layer in enumerate(layers):
            if layer["grid"] not in (None, config.grid.fingerprint()):
                reasons.append(f"layer {n} was sliced on another grid")
        if any("missing" in r for r in reasons):
            return reasons
        odd = self.slices(name, lean=True, vectors=False).groupBy("size").agg(F.count_if(F.size("vector") != config.dimension).alias("n"), F.count("*").alias("all")).collect()
        own = made_anew(config.embedder_fingerprint)
        if own is not None and own.dimension() != config.dimension and any(self._texts_at(layer) for layer in layers):
            reasons.append(f"vectors that are made anew are not of dimension {config.dimension}")
        reasons += [f"size {r['size']}: {r['n']} vectors are not of dimension {config.dimension}" for r in sorted(odd) if r["n"]]
        reasons += [f"size {r['size']} is not in the grid" for r in sorted(odd) if r["size"] not in config.sizes]
        present = {r["size"] for r in odd}
        documents = self.documents(name).where("slice_count > 0").limit(1).count()
        return reasons + [f"size {s}: no slices" for s in config.sizes if documents and s not in present]

    def _texts_at(self, layer: dict) -> str | None:
        """Where a layer's texts are, whose slices are not stored."""
        return layer["slices"].get("texts") or (layer["slices"].get("rows") if layer.get("form") == "texts" else None)

    def _rows(self, layer: dict, table: str, n: int) -> DataFrame:
        if "rows" not in layer[table] or (table == "slices" and layer.get("form") == "texts"):
            return self.spark.createDataFrame([], COLUMNS[table]).withColumn("_layer", F.lit(n))
        rows = self.spark.read.schema(COLUMNS[table]).parquet(layer[table]["rows"])
        return rows.select(*self.spark.createDataFrame([], COLUMNS[table]).columns, F.lit(n).alias("_layer"))

    def _left(self, rows: DataFrame, layers: list[dict], table: str, key: list[str]) -> DataFrame:
        """Rows (with _layer) without those whose key a later layer lists as gone."""
        later = [(n, layer) for n, layer in enumerate(layers) if n and layer[table].get("gone") and layer["gone_key"][table] == key]
        if not later:
            return rows
        gone = None
        for n, layer in later:
            keys = self.spark.read.parquet(layer[table]["gone"]).select(*key, F.lit(n).alias("_gone"))
            gone = keys if gone is None else gone.unionByName(keys)
        last = gone.groupBy(*key).agg(F.max("_gone").alias("_gone"))
        small = sum(layer["gone_count"][table] for _, layer in later) <= BROADCAST_KEYS
        return rows.join(F.broadcast(last) if small else last, key, "left").where(F.col("_gone").isNull() | (F.col("_layer") >= F.col("_gone"))).drop("_gone")

    def _texts(self, layers: list[dict]) -> dict[int, DataFrame]:
        """By layer, the texts (document_id, text) whose slices are not stored, without those of documents that are gone later."""
        out = {}
        for n, layer in enumerate(layers):
            if at := self._texts_at(layer):
                texts = self.spark.read.schema(TEXTS).parquet(at).withColumn("_layer", F.lit(n))
                out[n] = self._left(texts, layers, "slices", ["document_id"]).select("document_id", "text")
        return out

    def _made(self, config: CorpusConfig, texts: DataFrame, part: Part) -> DataFrame:
        """The slices of texts, as ingest would have stored them."""
        rows = slice_documents(
            part.held(texts), config.grid, corpus=config.name, counter=counters.get(config.token_counter_id), only=part.sizes, with_descendants=not part.lean, with_bytes=not part.lean,
        )
        vector = made_anew(config.embedder_fingerprint).column(F.col("text")) if part.vectors else F.lit(None).cast("array<double>")
        return rows.withColumn("vector", vector)

    def _merged(self, layers: list[dict], table: str, config: CorpusConfig | None = None, part: Part = Part()) -> DataFrame:
        """The rows of layers, without those whose keys a later one of them lists as gone."""
        columns = [c for c in self.spark.createDataFrame([], COLUMNS[table]).columns if not (part.lean and c in TIED)]
        out = None
        for n, layer in enumerate(layers):
            if "rows" in layer[table] and not (table == "slices" and layer.get("form") == "texts"):
                rows = self._rows(layer, table, n)
                out = rows if out is None else out.unionByName(rows)
        if out is not None:
            out = self._left(part.held(out), layers, table, ["document_id"])
            out = (out if part.sizes is None else out.where(F.col("size").isin(*part.sizes))).select(*columns, "_layer")
        if table == "slices":
            for n, texts in self._texts(layers).items():
                rows = self._made(config, texts, part).select(*columns, F.lit(n).alias("_layer"))
                out = rows if out is None else out.unionByName(rows)
        if out is None:
            return self.spark.createDataFrame([], COLUMNS[table]).select(*columns)
        return self._left(out, layers, table, ["document_id", "point_id"]).select(*columns) if table == "slices" else out.select(*columns)

    def slices(self, name: str, sizes: tuple[int, ...] | None = None, of: DataFrame | None = None, *, lean: bool = False, vectors: bool = True) -> DataFrame:
        """All slices, or those of some sizes and documents; see Part."""
        return self._merged(self._corpus(name)[2]["layers"], "slices", self.get_corpus_meta(name), Part(sizes, of, lean, vectors))

    def documents(self, name: str) -> DataFrame:
        return self._merged(self._corpus(name)[2]["layers"], "documents")

    def _write_rows(self, rows: DataFrame, table: str, at: str) -> DataFrame:
        """Rows as files, in the order that look-ups go by; slices in a folder for each size. No row leaves its task."""
        if table == "slices":
            rows.sortWithinPartitions("size", "document_id", "codepoint_offset").write.partitionBy("size").parquet(at)
        else:
            rows.sortWithinPartitions("document_id").write.parquet(at)
        return self.spark.read.schema(COLUMNS[table]).parquet(at)

    def _write_texts(self, texts: DataFrame, at: str) -> DataFrame:
        """Texts in place of their slices. No row leaves its task."""
        texts.select("document_id", "text").write.option("compression", "zstd").parquet(at)
        return self.spark.read.schema(TEXTS).parquet(at)

    def _add(
        self, name: str, changes: dict[str, tuple[DataFrame | None, DataFrame, list[str]]], grid: str | None = None, check: bool = False, form: str | None = None
    ) -> None:
        """One layer of changes: for each table the rows that come (or None), those that go, and the columns that name the latter.
        In the form `texts` the slices that come are (document_id, text), after the records of the same documents.

        Rows are computed once, as they are written; what was written is checked before a manifest names it.
        """
        version, manifest, corpus = self._corpus(name)
        base = self._at("data", name.encode().hex(), uuid.uuid4().hex)
        done: dict[int, DataFrame] = {}
        listed: dict[tuple, tuple[str, int]] = {}
        layer: dict = {"slices": {}, "documents": {}, "gone_key": {}, "gone_count": {}, "count": {"slices": 0, "documents": 0}, "grid": grid, "form": form}
        try:
            for table, (added, gone, key) in changes.items():
                if added is not None and table == "slices" and form == "texts":
                    at = f"{base}/{table}"
                    self._write_texts(added, at)
                    records = self.spark.read.schema(DOCUMENTS).parquet(layer["documents"]["rows"])
                    layer[table]["rows"], layer["count"][table] = at, records.agg(F.sum("slice_count")).first()[0] or 0
                elif added is not None:
                    at = f"{base}/{table}"
                    written = self._write_rows(added.select(*self.spark.createDataFrame([], COLUMNS[table]).columns), table, at)
                    if check and table == "slices":
                        self.check_points(self.get_corpus_meta(name), written, grid)
                    layer[table]["rows"], layer["count"][table] = at, written.count()
                    done[id(added)] = written
                if corpus["layers"]:
                    if (id(gone), *key) not in listed:
                        at = f"{base}/gone_{table}"
                        done.get(id(gone), gone).select(*key).write.parquet(at)
                        listed[id(gone), *key] = at, self.spark.read.parquet(at).count()
                    layer[table]["gone"], layer["gone_count"][table] = listed[id(gone), *key]
                    layer["gone_key"][table] = key
            layers = [*corpus["layers"], layer]
            if len(layers) > MOST_LAYERS:
                changed = sum(x["count"]["slices"] for x in layers[1:])
                first = 0 if changed >= FAIR_PART * max(1, layers[0]["count"]["slices"]) else 1
                layers = [*layers[:first], self._merge(self.get_corpus_meta(name), layers, first, base)]
            corpus["layers"] = layers
            self._flip(version, manifest)
        except Exception:
            remove(self.spark, base)
            raise

    def _merge(self, config: CorpusConfig, layers: list[dict], first: int, base: str) -> dict:
        """Layers from `first` on as one: their rows that are left, and all keys they list as gone (for those before). Texts stay texts,
        but for documents that lost or got single slices: of these the slices that are left become rows."""
        tail = layers[first:]
        out: dict = {"slices": {}, "documents": {}, "gone_key": {}, "gone_count": {}, "count": {}, "grid": tail[-1]["grid"]}
        for table in COLUMNS:
            at = f"{base}/merged_{table}"
            texts = list(self._texts(tail).values()) if table == "slices" else []
            if not texts:
                rows = self._merged(tail, table, config)
            else:
                whole = texts[0]
                for more in texts[1:]:
                    whole = whole.unionByName(more)
                touched = self.spark.createDataFrame([], "document_id string")
                for layer in tail[1:]:
                    if layer[table].get("gone") and layer["gone_key"][table] == OWN_KEY[table]:
                        touched = touched.unionByName(self.spark.read.parquet(layer[table]["gone"]).select("document_id"))
                touched = touched.distinct()
                kept = self._write_texts(whole.join(touched, "document_id", "left_anti"), f"{at}_texts")
                out[table]["texts"] = f"{at}_texts"
                n = sum(F.ceil(F.length("text") / F.lit(s)) for s in config.sizes)
                out["count"][table] = kept.agg(F.sum(n).cast("long")).first()[0] or 0
                stored = [{**x, "slices": {k: v for k, v in x["slices"].items() if k != "texts" and not (k == "rows" and x.get("form") == "texts")}, "form": None} for x in tail]
                rows = self._merged(stored, table).unionByName(self._merged_texts(config, tail, touched))
            out["count"][table] = out["count"].get(table, 0) + self._write_rows(rows, table, at).count()
            out[table]["rows"] = at
            if not first:
                continue
            keys, own = None, OWN_KEY[table]
            before = self._merged(layers[:first], table, config, Part(lean=True)).select(*own)
            for layer in tail:
                if layer[table].get("gone"):
                    key = layer["gone_key"][table]
                    some = before.join(self.spark.read.parquet(layer[table]["gone"]).select(*key), key, "left_semi")
                    keys = some if keys is None else keys.unionByName(some)
            if keys is not None:
                keys.distinct().write.parquet(f"{base}/merged_gone_{table}")
                out[table]["gone"], out["gone_key"][table] = f"{base}/merged_gone_{table}", own
                out["gone_count"][table] = self.spark.read.parquet(out[table]["gone"]).count()
        return out

    def _merged_texts(self, config: CorpusConfig, layers: list[dict], of: DataFrame) -> DataFrame:
        """The slices that are not stored, of some documents, without those that a later layer lists as gone."""
        out = None
        for n, texts in self._texts(layers).items():
            rows = self._made(config, texts, Part(of=of)).withColumn("_layer", F.lit(n))
            out = rows if out is None else out.unionByName(rows)
        return self._left(out, layers, "slices", OWN_KEY["slices"]).select(*self.spark.createDataFrame([], SLICES).columns)

    def compact(self, name: str) -> None:
        """All layers as one."""
        version, manifest, corpus = self._corpus(name)
        if len(corpus["layers"]) > 1:
            corpus["layers"] = [self._merge(self.get_corpus_meta(name), corpus["layers"], 0, self._at("data", name.encode().hex(), uuid.uuid4().hex))]
            self._flip(version, manifest)

    def vacuum(self, age: float = 7 * 24 * 3600) -> list[str]:
        """Delete what no manifest of the last `age` seconds names, nor the newest: old manifests, and data older than that."""
        before = time.time() - age
        versions = self._versions()
        changed = {n: t for n, t in self._listed("_manifest")}
        kept = [v for v in versions if v == versions[-1] or changed.get(f"{v:010d}.json", 0) >= before]
        manifests = [self._read(v) for v in kept]
        named = {at for m in manifests for c in m["corpora"].values() for layer in c["layers"] for t in COLUMNS for at in layer[t].values()}
        gone = [self._at("_manifest", n) for n, t in self._listed("_manifest") if t < before and n not in {f"{v:010d}.json" for v in kept}]
        for corpus, _ in self._listed("data"):
            for folder, t in self._listed("data", corpus):
                at = self._at("data", corpus, folder)
                if t < before and not any(x.startswith(f"{at}/") for x in named):
                    gone.append(at)
        for at in gone:
            remove(self.spark, at)
        return gone

    def check_points(self, config: CorpusConfig, points: DataFrame, grid_fingerprint: str) -> None:
        """All checks before any write."""
        if grid_fingerprint != config.grid.fingerprint():
            raise EmbedderMismatch("the data was sliced on another grid")
        r = points.agg(
            F.count_if(~F.col("size").isin(*config.sizes)).alias("sizes"),
            F.count_if(F.col("vector").isNull()).alias("none"),
            F.count_if(F.size("vector") != config.dimension).alias("dims"),
        ).first()
        if r["none"]:
            raise ValidationError("a stored slice has a vector")
        if r["sizes"]:
            raise EmbedderMismatch("a size is not in the grid")
        if r["dims"]:
            raise EmbedderMismatch(f"vectors are not of dimension {config.dimension}")

    def upsert_slices(self, name: str, points: DataFrame, grid_fingerprint: str, embedder_fingerprint: str | None = None) -> None:
        """Idempotent by point_id."""
        config = self.get_corpus_meta(name)
        if embedder_fingerprint not in (None, config.embedder_fingerprint):
            raise EmbedderMismatch(f"the corpus holds vectors of {config.embedder_fingerprint}")
        self._add(name, {"slices": (points, points, ["document_id", "point_id"])}, grid_fingerprint, check=True)

    def replace_documents(self, name: str, records: DataFrame, points: DataFrame, grid_fingerprint: str) -> None:
        """Documents with exactly these slices, in one flip: slices of an earlier version are gone with it."""
        self._add(name, {"documents": (records, records, ["document_id"]), "slices": (points, records, ["document_id"])}, grid_fingerprint, check=True)

    def replace_texts(self, name: str, records: DataFrame, texts: DataFrame, grid_fingerprint: str) -> None:
        """replace_documents() of a corpus whose vectors are made anew: the texts stand for their slices."""
        config = self.get_corpus_meta(name)
        if grid_fingerprint != config.grid.fingerprint():
            raise EmbedderMismatch("the data was sliced on another grid")
        own = made_anew(config.embedder_fingerprint)
        if own is None or own.dimension() != config.dimension:
            raise EmbedderMismatch(f"vectors of {config.embedder_fingerprint} are not made anew at dimension {config.dimension}")
        self._add(name, {"documents": (records, records, ["document_id"]), "slices": (texts, records, ["document_id"])}, grid_fingerprint, form="texts")

    def put_document_meta(self, name: str, records: DataFrame) -> None:
        self._add(name, {"documents": (records, records, ["document_id"])})

    def get_document_meta(self, name: str, document_id: str) -> dict:
        r = self.documents(name).where(F.col("document_id") == document_id).limit(1).collect()
        if not r:
            raise DocumentNotFound(document_id)
        return r[0].asDict(recursive=True)

    def list_documents(self, name: str, limit: int = 100, cursor: str | None = None) -> tuple[list[dict], str | None]:
        """A page in order of id, and the cursor of the next."""
        asked = (self._versions()[-1], name, cursor)
        if self._ahead[0] != asked or len(self._ahead[1]) <= limit:
            d = self.documents(name)
            if cursor is not None:
                d = d.where(F.col("document_id") > cursor)
            # A client that goes on from a page is likely to go on again.
            most = limit if cursor is None else max(limit, min(READ_AHEAD * limit, READ_AHEAD_ROWS))
            self._ahead = asked, [r.asDict(recursive=True) for r in d.orderBy("document_id").limit(most + 1).collect()]
        rows = self._ahead[1]
        if len(rows) <= limit:
            self._ahead = (), []
            return rows, None
        last = rows[limit - 1]["document_id"]
        self._ahead = (*asked[:2], last), rows[limit:]
        return rows[:limit], last

    def list_point_ids(self, name: str, document_id: str) -> dict[int, set[str]]:
        out: dict[int, set[str]] = {s: set() for s in self.get_corpus_meta(name).sizes}
        one = self.spark.createDataFrame([(document_id,)], "document_id string")
        for r in self.slices(name, of=one, lean=True, vectors=False).where(F.col("document_id") == document_id).select("size", "point_id").collect():
            out[r["size"]].add(r["point_id"])
        return out

    def delete_points(self, name: str, document_id: str, ids: Iterable[str]) -> None:
        """Unknown ids are ignored."""
        gone = self.spark.createDataFrame([(document_id, i) for i in ids], "document_id string, point_id string")
        self._add(name, {"slices": (None, gone, ["document_id", "point_id"])})

    def delete_document(self, name: str, document_id: str) -> None:
        self.get_document_meta(name, document_id)
        gone = self.spark.createDataFrame([(document_id,)], "document_id string")
        self._add(name, {"slices": (None, gone, ["document_id"]), "documents": (None, gone, ["document_id"])})

    def search_size(self, name: str, size: int, queries: DataFrame, k: int) -> DataFrame:
        """The k best slices of one size for each query, with all their columns."""
        hits = materialise(search(queries, self.slices(name, (size,), lean=True), k, keep=("document_id", "codepoint_offset")), "hits")
        points = self.slices(name, (size,), hits.select("document_id").distinct(), vectors=False)
        return hits.join(points.drop("vector", "size"), ["document_id", "codepoint_offset", "point_id"])

    def fetch_by_ids(self, name: str, size: int, ids: list[str]) -> DataFrame:
        """Slices by id in the order asked for; unknown ids are left out."""
        asked = self.spark.createDataFrame(list(enumerate(ids)), "seq long, point_id string")
        return self.slices(name, (size,), vectors=False).join(F.broadcast(asked), "point_id").orderBy("seq").drop("seq", "vector")

    def get_slices(self, name: str, keys: DataFrame) -> DataFrame:
        """Slices at coordinates; unknown ones are left out."""
        known = keys.where(F.col("size").isin(*self.get_corpus_meta(name).sizes))
        sizes = tuple(sorted(r["size"] for r in known.select("size").distinct().collect()))
        return known.join(self.slices(name, sizes, vectors=False).drop("vector"), KEY) if sizes else keys.join(self.slices(name).drop("vector"), KEY).limit(0)

    def corpus_stats(self, name: str) -> tuple[int, dict[int, int]]:
        """Documents, and slices of each grid size, zeros included."""
        counts = {r["size"]: r["count"] for r in self.slices(name, lean=True, vectors=False).groupBy("size").count().collect()}
        return self.documents(name).count(), {s: counts.get(s, 0) for s in self.get_corpus_meta(name).sizes}


def stats(slices: DataFrame, grid: Grid) -> DataFrame:
    """size, points of each grid size, zeros included."""
    ladder = slices.sparkSession.createDataFrame([(s,) for s in grid.sizes], "size int")
    counts = slices.groupBy("size").agg(F.count("*").alias("points"))
    return ladder.join(counts, "size", "left").select("size", F.coalesce("points", F.lit(0)).cast("long").alias("points"))


#: Makers of stores of (spark, root) by kind.
STORES: dict[str, type] = {"parquet": Catalog}


def available_stores() -> list[str]:
    return sorted(STORES)


def load_store(name: str):
    if name not in STORES:
        raise ValidationError(f"no store {name!r}; known: {', '.join(available_stores())}")
    return STORES[name]
