"""Chunk store on Parquet: keyed reads, upsert, insert-if-absent, replace and delete by source.

Rows lie in parts by a hash of their source, each a folder of Parquet files.  A write makes new folders for the parts
it touches only, and then a new numbered list of the folders that make up the store.  Lists are never changed or
replaced: a reader takes the newest one that is complete, so there is no moment without a store, and a write that
fails or dies leaves the rows as they were.  A list can be made once only, so of two writers that started from the
same one the second is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sync import require

PART = "part"
#: Parts of a new store, and the mean size from which a store is laid out anew in four times as many.
PARTS, PART_BYTES = 64, 1 << 30
#: Files of one part, so that a source with very many rows is written by several tasks.
FILES = 8


class ChunkStore:
    """A table of rows keyed by chunk_id.  A chunk id belongs to one source, whose rows share a part."""

    def __init__(self, spark: SparkSession, path: str, schema: str, parts: int = PARTS, part_bytes: int = PART_BYTES) -> None:
        self.spark, self.path, self.schema, self._first_parts, self.part_bytes = spark, path.rstrip("/"), schema, parts, part_bytes
        self._fs = self._at("state").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _versions(self) -> list[tuple[int, dict]]:
        """The complete lists, the newest first."""
        if not self._fs.exists(self._at("state")):
            return []
        names = sorted((f.getPath().getName() for f in self._fs.listStatus(self._at("state"))), reverse=True)
        out = []
        for name in names:
            if name.endswith(".json"):
                try:
                    out.append((int(name[:-5]), json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.path}/state/{name}").collect()))))
                except ValueError:  # its writer died
                    continue
        return out

    def _newest(self) -> tuple[int, int, dict[int, str]]:
        """(version, parts, folder of each part that has rows)."""
        for version, state in self._versions()[:1]:
            return version, state["parts"], {int(k): v for k, v in state["folders"].items()}
        return 0, self._first_parts, {}

    @property
    def parts(self) -> int:
        """Into how many parts the rows are laid out."""
        return self._newest()[1]

    def _part(self, source: Column, parts: int) -> Column:
        return F.pmod(F.xxhash64(source), F.lit(parts)).cast("int")

    def _parts_of(self, sources: DataFrame) -> set[int]:
        return {r["p"] for r in sources.select(self._part(F.col("source"), self.parts).alias("p")).distinct().collect()}

    def exists(self) -> bool:
        """Whether the store has been written."""
        return bool(self._versions())

    def read(self, parts: set[int] | None = None) -> DataFrame:
        """All rows, or those of some parts; an empty typed DataFrame where there are none."""
        folders = [f"{self.path}/{v}" for k, v in sorted(self._newest()[2].items()) if parts is None or k in parts]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def of_source(self, source: str) -> DataFrame:
        """Rows of one source: reads the files of its part only."""
        parts = self._parts_of(self.spark.createDataFrame([(source,)], "source string"))
        return self.read(parts).where(F.col("source") == source)

    def by_ids(self, ids: DataFrame) -> DataFrame:
        """Rows whose chunk_id is among ``ids``."""
        return self.read().join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")

    def guard(self) -> None:
        """Raises if the store is missing or empty."""
        if not self.exists():
            raise FileNotFoundError(f"no chunk store at {self.path}")
        if self.read().isEmpty():
            raise ValueError("the chunk store is empty")

    def _commit(self, rows: DataFrame, touched: set[int], parts: int | None = None, base: int | None = None) -> None:
        """Makes ``rows`` the whole content of some parts, on top of version ``base``, the newest if not given."""
        version, now, folders = self._newest()
        if base is not None and base != version:
            raise RuntimeError(f"the store was written by another writer: version {version} has followed {base}")
        parts = parts or now
        self._write_list(version, parts, {k: v for k, v in folders.items() if k not in touched} | self._write_rows(rows, touched, parts))
        self._clean_up()
        kept = self._newest()[2]
        size = sum(self._fs.getContentSummary(self._at(v)).getLength() for v in kept.values())
        if size > self.part_bytes * parts:
            self._commit(self.read(), set(range(4 * parts)) | set(kept), 4 * parts)

    def _write_rows(self, rows: DataFrame, touched: set[int], parts: int) -> dict[int, str]:
        """Writes rows to new folders; the folder of each part that has any."""
        folder = f"data-{uuid.uuid4().hex}"
        rows = rows.withColumn(PART, self._part(F.col("source"), parts))
        rows = rows.repartition(PART, F.pmod(F.xxhash64("chunk_id"), F.lit(FILES)))
        rows.write.partitionBy(PART).parquet(f"{self.path}/{folder}")
        return {k: f"{folder}/{PART}={k}" for k in touched if self._fs.exists(self._at(f"{folder}/{PART}={k}"))}

    def _write_list(self, version: int, parts: int, folders: dict[int, str]) -> None:
        """Adds the list that follows ``version``; raises if another writer has added it."""
        at = self._at(f"state/{version + 1:012d}.json")
        try:
            out = self._fs.create(at, False)
        except Exception as e:
            raise RuntimeError(f"the store was written by another writer: version {version + 1} exists") from e
        out.write(bytearray(json.dumps({"parts": parts, "folders": folders}).encode()))
        out.close()

    def _clean_up(self, keep: int = 2) -> None:
        """Deletes lists older than the newest ``keep``, which readers may still use, and the data they alone name."""
        versions = self._versions()
        used = {v.split("/")[0] + "/" + v.split("/")[1] for _, state in versions[:keep] for v in state["folders"].values()}
        for number, state in versions[keep:]:
            for folder in set(state["folders"].values()) - used:
                self._fs.delete(self._at(folder), True)
            self._fs.delete(self._at(f"state/{number:012d}.json"), False)

    def checked(self, rows: DataFrame) -> DataFrame:
        """Rows in the store's schema, columns they lack as null; raises on blank text, source or id and on repeated ids."""
        fields = self.spark.createDataFrame([], self.schema).schema
        rows = rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
        blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
        require(rows.where(blank("text") | blank("source") | blank("chunk_id")).select("chunk_id", "source"), "rows without text, source or chunk_id")
        require(rows.groupBy("chunk_id").count().where("count > 1"), "repeated chunk_id")
        return rows

    def upsert(self, rows: DataFrame) -> None:
        """Adds rows and replaces those of equal chunk_id."""
        base, rows = self._newest()[0], self.checked(rows)
        parts = self._parts_of(rows)
        if parts:
            self._commit(self.read(parts).join(rows.select("chunk_id"), "chunk_id", "left_anti").unionByName(rows), parts, base=base)

    def insert_absent(self, rows: DataFrame, embed=None) -> int:
        """Adds the rows whose chunk_id is not stored, embedding only these; returns how many there are."""
        base, rows = self._newest()[0], self.checked(rows)
        parts = self._parts_of(rows)
        new = rows.join(self.read(parts).select("chunk_id"), "chunk_id", "left_anti")
        count = new.count()
        if count:
            self._commit(self.read(parts).unionByName(embed(new) if embed else new), parts, base=base)
        return count

    def replace_sources(self, rows: DataFrame, embed=None) -> None:
        """Puts ``rows`` in place of all rows of their sources.  They are embedded first, so a failure changes nothing."""
        base, rows = self._newest()[0], self.checked(rows)
        parts = self._parts_of(rows)
        if not parts:
            raise ValueError("a source cannot be replaced by nothing")
        rows = embed(rows) if embed else rows
        kept = self.read(parts).join(rows.select("source").distinct(), "source", "left_anti")
        self._commit(kept.unionByName(rows, allowMissingColumns=True), parts, base=base)

    def replace_source(self, source: str, rows: DataFrame, embed=None) -> None:
        """``replace_sources`` for rows that must all be of one source."""
        require(rows.where(~F.col("source").eqNullSafe(F.lit(source))).select("chunk_id", "source"), "rows of another source")
        self.replace_sources(rows, embed)

    def delete_sources(self, sources: DataFrame) -> int:
        """Removes all rows of the given sources; returns how many went.  Raises if any is left."""
        base, _, folders = self._newest()
        sources = sources.select("source").distinct()
        parts = self._parts_of(sources) & set(folders)
        gone = self.read(parts).join(sources, "source", "left_semi").count() if parts else 0
        if gone:
            self._commit(self.read(parts).join(sources, "source", "left_anti"), parts, base=base)
            require(self.read(parts).join(sources, "source", "left_semi").select("source"), "rows left after a delete")
        return gone
