"""The text index of a target table: documents, postings, terms and their statistics.

In memory an index is a set of lazy frames over the target; :meth:`TextIndex.save` writes
the documents and ``mapping.json`` so that later runs read them back. Keyword, numeric,
date and boolean fields need no postings: they are joined on their values.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.analysis import analyzer
from kinweave.plans.spec import IndexField, IndexSpec, SpecError
from kinweave.plans.staging import _path, staged

ID = "_id"
#: How many documents a row stands for, where rows that read alike are one.
COPIES = "_copies"
_CASTS = {"integer": "int", "long": "bigint", "float": "float", "double": "double", "boolean": "boolean"}


def _date_patterns(fmt: str) -> list[str]:
    known = {"strict_date_optional_time": ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"], "date": ["yyyy-MM-dd"]}
    return [p for part in fmt.split("||") for p in known.get(part, [part]) if part != "epoch_millis"]


def parse_date(c: Column, fmt: str) -> Column:
    """A timestamp by the first pattern that fits; null if none does."""
    text = c.cast("string")
    tries = [F.try_to_timestamp(text, F.lit(p)) for p in _date_patterns(fmt)]
    if "epoch_millis" in fmt.split("||"):
        tries.append(F.timestamp_millis(F.when(text.rlike(r"^-?\d{1,18}$"), text.try_cast("bigint"))))
    return F.coalesce(*tries)


@dataclass
class TextIndex:
    """Documents under their ids, the mapping of their fields and the analysis settings."""

    docs: DataFrame
    mapping: dict
    settings: dict
    id_field: str

    # --- building ---------------------------------------------------------------

    @classmethod
    def over(cls, target: DataFrame, spec: IndexSpec) -> TextIndex:
        """Index a frame: its declared columns, ids from the source or generated."""
        names = [c.name for c in spec.index_columns]
        missing = [n for n in names if n not in target.columns]
        if missing:
            raise SpecError(f"{spec.source_table} has no columns {missing}")
        body = target.select(*names)
        if spec.id_from_source:
            if spec.id_field not in names:
                raise SpecError(f"id_field {spec.id_field!r} must be one of index_columns")
            docs = body.withColumn(ID, F.col(spec.id_field).cast("string"))
        else:
            docs = staged(body.withColumn(ID, F.uuid()), "index-ids")  # ids must not change from one reading to the next
        return cls(docs, {c.name: c.mapping() for c in spec.index_columns}, spec.settings(), spec.id_field)

    @classmethod
    def simple(cls, target: DataFrame, fields: dict[str, str | dict], id_field: str) -> TextIndex:
        """Index a frame by its id and a mapping from field to type."""
        full = {n: t if isinstance(t, dict) else IndexField(n, t).mapping() for n, t in fields.items()}
        return cls(target.select(*full).withColumn(ID, F.col(id_field).cast("string")), full, {}, id_field)

    # --- storage ----------------------------------------------------------------

    @staticmethod
    def _mapping_file(spark: SparkSession, path: str):
        return _path(spark, f"{path.rstrip('/')}/mapping.json")

    def save(self, path: str, upsert: bool) -> None:
        """Create the index if it is absent, then add the documents: an upsert replaces those
        with the same id, else they are appended, so a repeated run has them twice. Of new rows
        that share an id an upsert takes one by a hash of its values, the same one each time.

        An upsert writes a new folder of documents and then points ``mapping.json`` to it, so readers
        and later runs find either the old or the new ones. ``number_of_shards`` is kept as a
        setting; files follow the size of the data."""
        spark = self.docs.sparkSession
        root = path.rstrip("/")
        p, fs = self._mapping_file(spark, path)
        if fs.exists(p):
            now = self._described(spark, path)
        else:
            now = {"mappings": {"properties": self.mapping}, "settings": self.settings, "id_field": self.id_field, "docs": "docs"}
            self._describe(p, fs, now)
        old_path, old_fs = _path(spark, f"{root}/{now['docs']}")
        there = old_fs.exists(old_path)
        if not upsert:
            self.docs.repartition(ID).write.mode("append").parquet(f"{root}/{now['docs']}")
            return
        others = [c for c in self.docs.columns if c != ID]
        new = self.docs.groupBy(ID).agg(F.max_by(F.struct(*others), F.xxhash64(*others)).alias("one")).select(ID, "one.*") if others else self.docs.select(ID).distinct()
        if there:
            new = staged(new, "index-new")
            old = spark.read.parquet(f"{root}/{now['docs']}")
            new = old.join(new.select(ID), ID, "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)
        folder = f"docs-{uuid.uuid4().hex}"
        new.write.parquet(f"{root}/{folder}")
        self._describe(p, fs, now | {"docs": folder})
        if there:
            old_fs.delete(old_path, True)

    @staticmethod
    def _describe(p, fs, content: dict) -> None:
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()

    @classmethod
    def _described(cls, spark: SparkSession, path: str) -> dict:
        p, _ = cls._mapping_file(spark, path)
        raw = json.loads(spark.read.option("wholetext", True).text(str(p.toString())).first()[0])
        return {"docs": "docs"} | raw

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextIndex:
        p, fs = cls._mapping_file(spark, path)
        if not fs.exists(p):
            raise FileNotFoundError(f"no index at {path}")
        raw = cls._described(spark, path)
        return cls(spark.read.parquet(f"{path.rstrip('/')}/{raw['docs']}"), raw["mappings"]["properties"], raw.get("settings", {}), raw["id_field"])

    def missing(self, columns) -> list[str]:
        return [c for c in columns if c not in self.mapping]

    # --- access -----------------------------------------------------------------

    def kind(self, name: str) -> str:
        """The type of a field, or of ``field.keyword``."""
        base, _, sub = name.partition(".")
        entry = self.mapping.get(base)
        if entry is None:
            raise SpecError(f"the index has no field {base!r}")
        if sub:
            if sub not in entry.get("fields", {}):
                raise SpecError(f"field {base!r} has no {sub!r}")
            return entry["fields"][sub]["type"]
        return entry["type"]

    def analyze(self, name: str, c: Column) -> Column:
        return analyzer(self.mapping[name.partition(".")[0]].get("analyzer"), self.settings.get("analysis"))(c.cast("string"))

    def value(self, name: str) -> Column:
        """A field as the type it is indexed with; over-long keywords are not indexed."""
        base, _, sub = name.partition(".")
        entry, kind, c = self.mapping[base], self.kind(name), F.col(base)
        if kind == "date":
            return parse_date(c, entry.get("format", "strict_date_optional_time||epoch_millis"))
        if kind in _CASTS:
            return c.try_cast(_CASTS[kind])
        limit = (entry["fields"][sub] if sub else entry).get("ignore_above")
        return F.when(F.length(c.cast("string")) <= limit, c.cast("string")) if limit and kind == "keyword" else c.cast("string")

    def literal(self, name: str, value) -> Column:
        """A query value as the type of the field."""
        kind = self.kind(name)
        if kind == "date":
            return parse_date(F.lit(str(value)), self.mapping[name.partition(".")[0]].get("format", "strict_date_optional_time||epoch_millis"))
        return F.lit(str(value).lower() if isinstance(value, bool) and kind != "boolean" else value).try_cast(_CASTS.get(kind, "string"))

    def _copies(self) -> Column:
        return (F.col(COPIES) if COPIES in self.docs.columns else F.lit(1)).alias(COPIES)

    def postings(self, name: str) -> DataFrame:
        """``(_id, term, tf, dl, positions)`` of a text field, and the documents that a row stands for."""
        terms = self.docs.select(ID, self._copies(), self.analyze(name, F.col(name)).alias("terms"))
        each = terms.select(ID, COPIES, F.size("terms").alias("dl"), F.posexplode("terms").alias("pos", "term"))
        return each.groupBy(ID, "term", "dl", COPIES).agg(F.count(F.lit(1)).alias("tf"), F.collect_list("pos").alias("positions"))

    def field_stats(self, name: str) -> DataFrame:
        """One row: documents with the field, and their mean length in terms."""
        sizes = self.docs.where(F.col(name).isNotNull()).select(self._copies(), F.size(self.analyze(name, F.col(name))).alias("dl")).where("dl > 0")
        return sizes.agg(F.sum(COPIES).alias("n_docs"), (F.sum(F.col(COPIES) * F.col("dl")) / F.sum(COPIES)).alias("avgdl"))
