"""Parquet store of ingested filings, extracted fields and their exports.

Tables lie in hash buckets of their documents under a manifest. A save of several
tables is computed once, into folders of its own, and becomes visible by one new
manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import blank_to_null, clipped
from tessella.operators import compare, pricing, timeline

CHILDREN = ("document_pages", "document_layers", "document_regions", "integrity_issues", "structure_evidence")
EXPORT_KEYS = ("document_id", "field_name", "document_layer", "raw_value", "normalized_value", "currency", "status", "confidence", "page", "section", "evidence", "locator_uri", "review_status")


def _bucket(document_id, n: int):
    return F.pmod(F.xxhash64(document_id), F.lit(n)).cast("int")


class Store:
    """Tables under one root path, on any file system that Spark reaches.

    Rows lie in hash buckets of their document. A save writes the touched buckets
    anew into folders of its own and then one manifest that names every bucket's
    folder; readers follow the newest manifest. So a save is seen whole or not at
    all, a failed one leaves the store as it was, and of two savers at the same time
    the later one fails. The driver handles one entry per bucket, never per document.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _fs(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(conf), path

    def _manifest(self) -> tuple[int, dict]:
        """Number and content of the newest manifest: folders by bucket for each table."""
        fs, path = self._fs()
        at = path(f"{self.root}/_manifest")
        names = sorted(f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName().endswith(".json")) if fs.exists(at) else []
        if not names:
            return 0, {"buckets": self.buckets, "tables": {}}
        stream = fs.open(path(f"{self.root}/_manifest/{names[-1]}"))
        try:
            return int(names[-1][:-5]), json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, number: int, content: dict) -> None:
        fs, path = self._fs()
        draft, final = path(f"{self.root}/_manifest/.{uuid.uuid4().hex}"), path(f"{self.root}/_manifest/{number:012d}.json")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError("the store was changed by another writer; save again")

    def exists(self, name: str) -> bool:
        return name in self._manifest()[1]["tables"]

    def read(self, name: str, documents: Sequence[str] | None = None) -> DataFrame:
        """A table, if wanted only some documents' buckets."""
        content = self._manifest()[1]
        folders = content["tables"][name]
        if documents is None:
            return self._open(sorted(set(folders.values())))
        wanted = {str(r[0]) for r in self.spark.createDataFrame([(d,) for d in documents], "d string").select(_bucket(F.col("d"), content["buckets"])).collect()}
        some = sorted({f for b, f in folders.items() if b in wanted or not b.isdigit()}) or sorted(set(folders.values()))[:1]
        return self._open(some).where(F.col("document_id").isin(list(documents)))

    def _open(self, folders: Sequence[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.root}/{f}" for f in folders])

    def _replace(self, staged: Mapping[str, str], keys: DataFrame) -> None:
        """Put staged rows in the place of those with the same keys, in all tables at once."""
        number, content = self._manifest()
        n, tables = content["buckets"], dict(content["tables"])
        touched = [r[0] for r in keys.select(_bucket(F.col("document_id"), n).alias("b")).distinct().collect()]  # at most n
        for name, at in staged.items():
            rows, old = self.spark.read.parquet(at), dict(tables.get(name, {}))
            before = sorted({old[str(b)] for b in touched if str(b) in old})
            if before:
                on = [c for c in keys.columns if c in rows.columns]
                rows = self._open(before).join(keys.select(*on).distinct(), on, "left_anti").unionByName(rows, allowMissingColumns=True)
            folder = f"{name}/{uuid.uuid4().hex}"
            rows.withColumn("_bucket", _bucket(F.col("document_id"), n)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
            fs, path = self._fs()
            for b in touched:
                old.pop(str(b), None)
                if fs.exists(path(f"{self.root}/{folder}/_bucket={b}")):
                    old[str(b)] = f"{folder}/_bucket={b}"
            if not old:  # a table without rows keeps its columns
                rows.limit(0).write.parquet(f"{self.root}/{folder}-none")
                old["none"] = f"{folder}-none"
            tables[name] = old
        self._publish(number + 1, {"buckets": n, "tables": tables})

    def _staged(self, tables: Mapping[str, DataFrame]) -> tuple[str, dict[str, str]]:
        """Compute everything once, into a folder of this save alone."""
        top = f"{self.root}/_staging/{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{top}/{name}")
        return top, {name: f"{top}/{name}" for name in tables}

    def _save(self, tables: Mapping[str, DataFrame], first: str, keys: Sequence[str]) -> int:
        top, fs = f"{self.root}/_staging", self._fs()
        try:
            top, staged = self._staged(tables)
            given = self.spark.read.parquet(staged[first])
            self._replace(staged, given.select(*keys).distinct())
            return given.count()
        finally:
            if not top.endswith("/_staging"):
                fs[0].delete(fs[1](top), True)

    def save_ingestion(self, tables: Mapping[str, DataFrame]) -> None:
        """Replace documents and their child tables, all or nothing; extracted fields stay.

        A child table that is empty for a document also empties the stored one.
        """
        self._save({n: tables[n] for n in ("documents", *CHILDREN) if n in tables}, "documents", ["document_id"])

    def save_extraction(self, rows: DataFrame) -> int:
        """Replace the rows of the same document and run; returns how many were written."""
        return self._save({"extracted_fields": rows}, "extracted_fields", ["document_id", "run_id"])

    def record_run(self, runs: DataFrame) -> None:
        """Append runs that are not registered yet."""
        new = runs.join(self.read("runs"), "run_id", "left_anti") if self.exists("runs") else runs
        self.append("runs", new.dropDuplicates(["run_id"]))

    def append(self, name: str, rows: DataFrame) -> None:
        """Append to an overlay table (runs, corrections, review decisions)."""
        folder = f"{name}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        number, content = self._manifest()
        tables = content["tables"] | {name: content["tables"].get(name, {}) | {f"more-{number + 1}": folder}}
        self._publish(number + 1, content | {"tables": tables})

    def unseen(self, files: DataFrame) -> DataFrame:
        """Files whose checksum no stored document has."""
        once = files.dropDuplicates(["checksum"])
        return once.join(self.read("documents").select("checksum"), "checksum", "left_anti") if self.exists("documents") else once

    def documents(self) -> DataFrame:
        return self.read("documents").orderBy(F.desc("ingested_at"), "document_id")

    def fields(self, document_id: str, layer: str | None = None, run_id: str | None = None) -> DataFrame:
        """Fields of a document; all conditions reach the scan."""
        df = self.read("extracted_fields", [document_id])
        df = df if run_id is None else df.where(F.col("run_id") == run_id)
        df = df if layer is None else df.where(F.col("document_layer") == layer)
        return df.orderBy("category", "field_name", "document_layer")


def value_text(rows: DataFrame):
    return compare.shown(F.struct(*[F.col(c) for c in compare.VALUE]))


def export_records(rows: DataFrame) -> DataFrame:
    """The fixed thirteen keys of a record, in order; the printed page goes first."""
    page = F.coalesce(blank_to_null(F.col("printed_page")), F.col("pdf_page").cast("string"))
    out = rows.withColumns({"normalized_value": value_text(rows), "page": page})
    return out.select(*EXPORT_KEYS)


def export_json(rows: DataFrame) -> DataFrame:
    return export_records(rows).select("document_id", F.to_json(F.struct(*EXPORT_KEYS), {"ignoreNullFields": "false"}).alias("record"))


def scoped(table: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of the documents in scope."""
    return table.join(documents.select("document_id").distinct(), "document_id", "left_semi")


def scoped_runs(runs: DataFrame, documents: DataFrame, *mentions: DataFrame) -> DataFrame:
    """Runs that any of the given tables mentions for the documents in scope."""
    used = None
    for m in mentions:
        ids = scoped(m, documents).select("run_id")
        used = ids if used is None else used.union(ids)
    return runs.join(used.distinct(), "run_id", "left_semi")


def cells(df: DataFrame) -> DataFrame:
    """Text columns cut to what a spreadsheet cell holds."""
    return df.withColumns({f.name: clipped(F.col(f.name)) for f in df.schema.fields if f.dataType.simpleString() == "string"})


def derived(rows: DataFrame, names: DataFrame | None = None) -> dict[str, DataFrame]:
    """Comparison, timeline and scenarios of all documents, labelled by file name."""
    compared = compare.compare(rows)
    entries = timeline.build(compared)
    horizons = timeline.horizon(compared)
    inputs = pricing.financing(compared, pricing.found_values(rows, compared))
    out = {"comparison": compare.flat(compared), "timeline": entries, "hedging_scenarios": pricing.run(horizons, inputs)}
    return out if names is None else {k: v.join(names.select("document_id", "filename"), "document_id", "left") for k, v in out.items()}


def assumptions(spark: SparkSession, values: Mapping) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in values.items()], "name string, value string")


def write_workbook(sheets: Mapping[str, DataFrame], root: str, kind: str = "csv") -> None:
    """One folder per sheet; an empty sheet holds one row that says so."""
    for name, df in sheets.items():
        some = df if not df.isEmpty() else df.sparkSession.createDataFrame([(f"no rows for {name}",)], "note string")
        flat = some.select(*[F.to_json(f.name).alias(f.name) if f.dataType.simpleString().startswith(("array", "struct", "map")) else F.col(f.name) for f in some.schema.fields])
        cells(flat).write.mode("overwrite").format(kind).option("header", "true").save(f"{root.rstrip('/')}/{name[:31]}")
