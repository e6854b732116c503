"""Categorical vocabularies under a three-state contract: seen, unseen, missing.

A vocabulary is a table (feature, level, code). Fitting numbers the distinct levels
per feature; applying never refits: a known level maps to its code, a populated
unknown one to -1, a missing one stays NULL.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalar as S
from tidemark.operators.ordering import ordered_index
from tidemark.session import materialise, small_table

FORMAT_VERSION = 1
LITERAL_LEVELS = 2_000
#: Vocabularies are broadcast up to this many bytes, as counted from their levels.
BROADCAST_BYTES = 64 << 20
WINDOW_LEVELS = 2_000_000
#: A level that holds more than one in so many rows of its feature is hot; there are at most this many.
HOT_SHARE = 1_000
_ENTRY_BYTES = 48


class SchemaContractError(ValueError):
    """A frame does not carry the columns the encoder was fitted on."""


class VocabularyVersionError(ValueError):
    """A stored vocabulary was written in another format."""


def categorical_columns(df: DataFrame) -> list[str]:
    """Not numeric and not boolean: flags stay numeric 0/1 as features."""
    return [
        f.name for f in df.schema.fields
        if not isinstance(f.dataType, (T.NumericType, T.BooleanType))
    ]


def feature_frame(df: DataFrame, label: str | None, exclude: Iterable[str]) -> DataFrame:
    """Drop id, time and label; keep the frame's own order."""
    skip = set(exclude) | ({label} if label else set())
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in skip])


def label_column(df: DataFrame, label: str) -> Column | None:
    return F.col(label).cast("tinyint") if label in df.columns else None


def levels_long(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """(keep..., feature, level) with blanks as NULL."""
    types = {f.name: f.dataType for f in df.schema.fields}
    picked = [
        S.missing_as_null(F.col(f"`{c}`").cast("string"), T.StringType()).alias(c) for c in columns
    ]
    assert all(c in types for c in columns)
    return df.select(*keep, *picked).unpivot(
        list(keep), [F.col(f"`{c}`") for c in columns], "feature", "level"
    )


def distinct_levels(df: DataFrame, columns: list[str]) -> DataFrame:
    return levels_long(df, columns).where(F.col("level").isNotNull()).distinct()


def number_levels(levels: DataFrame, window_levels: int = WINDOW_LEVELS) -> DataFrame:
    """Codes 0..n-1 per feature in level order.

    Small vocabularies are numbered by one window per feature; beyond the checked size
    the levels are range-partitioned and numbered without gathering a feature anywhere.
    """
    largest = levels.groupBy("feature").count().agg(F.max("count")).first()[0] or 0
    if largest <= window_levels:
        order = Window.partitionBy("feature").orderBy("level")
        return levels.select("feature", "level", (F.row_number().over(order) - 1).alias("code"))
    return ordered_index(levels, ["level"], by=["feature"], output="code").select(
        "feature", "level", F.col("code").cast("int").alias("code")
    )


@dataclass(frozen=True)
class FeatureEncoder:
    """Settings of a fit; ``fit`` returns the model."""

    label: str | None = None
    exclude: tuple[str, ...] = ()

    def fit(self, df: DataFrame) -> EncoderModel:
        frame = feature_frame(df, self.label, self.exclude)
        columns = categorical_columns(frame)
        if columns:
            # The table is scanned once; size check, numbering and every use read the levels written here.
            levels = materialise(distinct_levels(frame, columns), "levels")
            vocabulary = materialise(number_levels(levels), "vocabulary")
        else:
            vocabulary = small_table(df.sparkSession, [], "feature string, level string, code int")
        return EncoderModel(
            names=tuple(frame.columns), categorical=tuple(columns), vocabulary=vocabulary,
            label=self.label, fitted_rows=df.count(),
        )


@dataclass(frozen=True)
class EncoderModel:
    """A frozen vocabulary and the ordered feature contract it belongs to."""

    names: tuple[str, ...]
    categorical: tuple[str, ...]
    vocabulary: DataFrame
    label: str | None = None
    fitted_rows: int = 0
    format_version: int = FORMAT_VERSION

    @cached_property
    def footprint(self) -> tuple[int, int]:
        """(levels, bytes) of the vocabulary, counted once for the life of the model."""
        if not self.categorical:
            return 0, 0
        row = self.vocabulary.agg(F.count("*").alias("n"), F.sum(F.octet_length("level") + F.octet_length("feature") + _ENTRY_BYTES).alias("b")).first()
        return row["n"], row["b"] or 0

    @cached_property
    def literal(self) -> dict[str, dict[str, int]] | None:
        """The maps of a small vocabulary, read once for the life of the model: a stream runs no job for them."""
        if self.footprint[0] > LITERAL_LEVELS:
            return None
        maps: dict[str, dict[str, int]] = {c: {} for c in self.categorical}
        for row in self.vocabulary.collect() if self.footprint[0] else []:
            maps[row["feature"]][row["level"]] = row["code"]
        return maps

    def check(self, df: DataFrame) -> None:
        """Contract check on the schema alone, before any job runs."""
        absent = [n for n in self.names if n not in df.columns]
        if absent:
            raise SchemaContractError(f"missing fitted columns: {absent}")
        known = set(self.categorical)
        text = [
            f.name for f in df.schema.fields
            if f.name in self.names and f.name not in known
            and not isinstance(f.dataType, (T.NumericType, T.BooleanType))
        ]
        if text:
            raise SchemaContractError(f"not numeric and not fitted as categorical: {text}")

    def _codes(self, df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
        """The frame, possibly joined with its vocabulary, and a code column per category.

        Literal maps for small vocabularies, one broadcast map per column up to a checked
        number of bytes, beyond it one shuffle join for all columns.
        """
        if self.literal is not None:
            return df, {c: _literal_map(self.literal[c], _level(c)) for c in self.categorical}
        if self.footprint[1] > BROADCAST_BYTES:
            return self._shuffled_codes(df)
        codes = {}
        for i, name in enumerate(self.categorical):
            own = self.vocabulary.where(F.col("feature") == name).select(
                F.col("level").alias(f"__l{i}"), F.col("code").alias(f"__c{i}")
            )
            df = df.withColumn(f"__k{i}", _level(name))
            df = df.join(F.broadcast(own), F.col(f"__k{i}") == F.col(f"__l{i}"), "left")
            codes[name] = F.col(f"__c{i}")
        return df, codes

    def _shuffled_codes(self, df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
        """Codes from one join whatever the number of columns: levels leave the row, are coded together and come back.

        A row becomes one entry with all its columns and one per populated level. Both shuffles carry
        the wide row once; hot levels, gaps and wide entries are spread by row.
        """
        at = {name: i for i, name in enumerate(self.categorical)}
        kinds = f"array<struct<feature:string,level:string,w:{df.schema.simpleString()}>>"
        nothing = F.lit(None).cast(df.schema)
        wide = F.struct(F.lit(None).cast("string").alias("feature"), F.lit(None).cast("string").alias("level"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("w"))
        entries = [F.when(_level(n).isNotNull(), F.struct(F.lit(n).alias("feature"), _level(n).alias("level"), nothing.alias("w"))) for n in self.categorical]
        # numbered below the generator: beside it each entry would get a number of its own
        packed = df.select(F.monotonically_increasing_id().alias("__row"), F.array_compact(F.array(wide, *entries)).cast(kinds).alias("e"))
        long = packed.select("__row", F.explode_outer("e").alias("e")).select("__row", "e.*")
        hot = hot_levels(levels_long(df, list(self.categorical)), self.vocabulary)
        coded = coded_levels(long, self.vocabulary, hot)
        place = F.create_map(*[x for n, i in at.items() for x in (F.lit(n), F.lit(i))])
        pairs = F.collect_list(F.when(F.col("code").isNotNull(), F.struct(F.try_element_at(place, "feature").alias("i"), F.col("code").alias("code"))))
        back = coded.groupBy("__row").agg(F.first("w", ignorenulls=True).alias("w"), F.map_from_entries(pairs).alias("__codes"))
        return back.select("w.*", "__codes"), {n: F.try_element_at("__codes", F.lit(i)) for n, i in at.items()}

    def transform(self, df: DataFrame, keep: Iterable[str] = (), states: bool = False) -> DataFrame:
        """Ordered feature columns, codes as doubles and numbers as floats; ``states`` adds the unseen and missing name lists."""
        self.check(df)
        types = {f.name: f.dataType for f in df.schema.fields}
        joined, codes = self._codes(df)
        out, unseen, missing = [], [], []
        for name in self.names:
            if name in codes:
                level = _level(name)
                value = F.when(level.isNotNull(), F.coalesce(codes[name].cast("double"),
                                                             F.lit(S.UNKNOWN_CODE).cast("double")))
                unseen.append(F.when(level.isNotNull() & codes[name].isNull(), F.lit(name)))
            else:
                value = S.missing_as_null(F.col(f"`{name}`").cast("float"), T.FloatType())
            out.append(value.alias(name))
            missing.append(F.when(S.is_missing(F.col(f"`{name}`"), types[name]), F.lit(name)))
        if states:
            empty = F.array().cast("array<string>")
            out.append((F.array_compact(F.array(*unseen)) if unseen else empty).alias("unseen"))
            out.append((F.array_compact(F.array(*missing)) if missing else empty).alias("missing"))
        return joined.select(*keep, *out)

    def decode(self, feature: str, code: Column) -> Column:
        """The analyst's reading of a stored value."""
        if feature not in self.categorical:
            return F.coalesce(S.render_number(code), F.lit("<missing>"))
        if self.literal is None:
            raise ValueError(f"the vocabulary of {feature} is too large for an expression; use decoded() on the rows that are shown")
        inverse = {code: level for level, code in self.literal[feature].items()}
        return decode_column(code, _literal_map(inverse, code.cast("int")))

    def decoded(self, df: DataFrame, feature: str, code: str, output: str) -> DataFrame:
        """``df`` with the reading of a code column beside it; for rows that were chosen first, such as a top-k.

        The code table is joined, never collected, and only the codes that occur reach the join.
        """
        if feature not in self.categorical or self.literal is not None:
            return df.withColumn(output, self.decode(feature, F.col(code)))
        asked = df.select(F.col(code).cast("bigint").alias("__code")).distinct()
        names = self.vocabulary.where(F.col("feature") == feature).select(F.col("code").cast("bigint").alias("__code"), F.col("level").alias("__level")).join(asked, "__code", "left_semi")
        joined = df.join(names, df[code].cast("bigint") == names["__code"], "left")
        return joined.withColumn(output, decode_column(F.col(code), F.col("__level"))).drop("__code", "__level")

    def cardinality(self) -> DataFrame:
        return self.vocabulary.groupBy("feature").agg(F.count("*").alias("levels")).orderBy(
            F.desc("levels"), "feature"
        )

    def save(self, path: str) -> None:
        """Vocabulary and contract as Parquet below one folder."""
        self.vocabulary.write.mode("overwrite").partitionBy("feature").parquet(f"{path}/vocabulary")
        rows = [
            (n, i, "categorical" if n in self.categorical else "numeric", self.label,
             self.fitted_rows, self.format_version)
            for i, n in enumerate(self.names)
        ]
        small_table(
            self.vocabulary.sparkSession, rows,
            "feature string, position int, kind string, label string, fitted_rows bigint, format_version int",
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/contract")

    @staticmethod
    def load(spark: SparkSession, path: str) -> EncoderModel:
        contract = sorted(spark.read.parquet(f"{path}/contract").collect(), key=lambda r: r["position"])
        if any(r["format_version"] != FORMAT_VERSION for r in contract):
            raise VocabularyVersionError(f"{path} was not written as format {FORMAT_VERSION}")
        vocabulary = spark.read.schema("level string, code int, feature string").parquet(f"{path}/vocabulary")
        return EncoderModel(
            tuple(r["feature"] for r in contract),
            tuple(r["feature"] for r in contract if r["kind"] == "categorical"),
            vocabulary.select("feature", "level", "code"),
            contract[0]["label"], contract[0]["fitted_rows"],
        )


def build_features(df: DataFrame, label: str | None = None, exclude: Iterable[str] = (),
                   model: EncoderModel | None = None) -> tuple[DataFrame, EncoderModel]:
    """Fit and apply, or apply only when a model is given."""
    model = model or FeatureEncoder(label, tuple(exclude)).fit(df)
    keep = [F.col(label).cast("tinyint").alias(label)] if label and label in df.columns else []
    return model.transform(df, keep=keep), model


def _level(name: str) -> Column:
    return S.missing_as_null(F.col(f"`{name}`").cast("string"), T.StringType())


def _literal_map(mapping: dict, key: Column) -> Column:
    if not mapping:
        return F.lit(None)
    entries = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)


def decode_column(code: Column, level: Column) -> Column:
    return (
        F.when(code.isNull(), "<missing>")
        .when(code == S.UNKNOWN_CODE, "<unseen>")
        .otherwise(F.coalesce(level, F.concat(F.lit("<code "), code.cast("int").cast("string"), F.lit(">"))))
    )


def hot_levels(long: DataFrame, vocabulary: DataFrame, share: int = HOT_SHARE) -> DataFrame:
    """(feature, level, __hot): the codes of levels that hold more than one in ``share`` rows of their feature.

    Tasks keep a bounded summary: counts of at most twice ``share`` levels a feature, all lowered by
    the largest that has no place. No hot level is lost, and at most twice ``share`` can come out.
    """
    keep = 2 * share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            pairs = pa.table({"f": batch.column(0), "l": batch.column(1)}).group_by(["f", "l"]).aggregate([([], "count_all")])
            for feature, level, n in zip(*(pairs.column(c).to_pylist() for c in ("f", "l", "count_all"))):
                held.setdefault(feature, Counter())[level] += n
            for feature, counts in held.items():
                if len(counts) > keep:
                    cut = sorted(counts.values(), reverse=True)[keep]
                    held[feature] = Counter({level: n - cut for level, n in counts.items() if n > cut})
        rows = [(f, level, n) for f, counts in held.items() for level, n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["feature", "level", "n"])

    present = long.where(F.col("level").isNotNull()).select("feature", "level")
    summary = present.mapInArrow(run, "feature string, level string, n bigint").groupBy("feature", "level").agg(F.sum("n").alias("n"))
    rows = long.groupBy("feature").agg(F.count("level").alias("rows"))
    hot = summary.join(F.broadcast(rows), "feature").where(F.col("n") * keep > F.col("rows")).select("feature", "level")
    # one row per hot level: bounded by the share, so it may be broadcast
    return vocabulary.join(F.broadcast(hot), ["feature", "level"], "left_semi").select("feature", "level", F.col("code").alias("__hot"))


def coded_levels(long: DataFrame, vocabulary: DataFrame, hot: DataFrame) -> DataFrame:
    """(.., feature, level, code): a shuffle join with the vocabulary from which hot levels and gaps stay out.

    Hot levels get their code from a broadcast; they and rows without a level are spread by row
    instead of meeting in the partition of one key.
    """
    told = long.join(F.broadcast(hot), ["feature", "level"], "left")
    alone = F.col("level").isNull() | F.col("__hot").isNotNull()
    key = F.when(alone, F.concat(F.lit("\u0001"), F.monotonically_increasing_id().cast("string"))).otherwise(F.concat_ws("\u0002", "feature", "level"))
    own = vocabulary.select(F.concat_ws("\u0002", "feature", "level").alias("__own"), F.col("code").alias("__code"))
    joined = told.withColumn("__key", key).join(own, F.col("__key") == F.col("__own"), "left")
    return joined.withColumn("code", F.coalesce("__hot", "__code")).drop("__hot", "__code", "__key", "__own")


def _fits(vocabulary: DataFrame, limit: int) -> bool:
    total = vocabulary.agg(F.sum(F.octet_length("level") + F.octet_length("feature") + _ENTRY_BYTES)).first()[0]
    return (total or 0) <= limit


def vocabulary_lookup(long: DataFrame, vocabulary: DataFrame, broadcast_bytes: int | None = None) -> DataFrame:
    """(.., feature, level) with ``code`` and ``state`` for rows in long form."""
    if _fits(vocabulary, BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        joined = long.join(F.broadcast(vocabulary), ["feature", "level"], "left")
    else:
        joined = coded_levels(long, vocabulary, hot_levels(long, vocabulary))
    return joined.withColumn(
        "state",
        F.when(F.col("level").isNull(), "missing").when(F.col("code").isNull(), "unseen").otherwise("seen"),
    )


def unseen_levels(long: DataFrame, vocabulary: DataFrame, broadcast_bytes: int | None = None) -> DataFrame:
    """Populated levels the vocabulary does not hold, with their counts.

    Levels are counted first, so the anti join meets each level once.
    """
    counted = long.where(F.col("level").isNotNull()).groupBy("feature", "level").agg(
        F.count("*").alias("occurrences")
    )
    small = _fits(vocabulary, BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes)
    known = vocabulary.select("feature", "level")
    return counted.join(F.broadcast(known) if small else known, ["feature", "level"], "left_anti")


def state_tally(long: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Per feature: levels, unseen rows and percent, missing percent; worst first."""
    states = vocabulary_lookup(long, vocabulary)
    sizes = vocabulary.groupBy("feature").agg(F.count("*").alias("levels"))
    counts = states.groupBy("feature").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("state") == "unseen").alias("unknown_rows"),
        F.count_if(F.col("state") == "missing").alias("missing_rows"),
    )
    return counts.join(sizes, "feature", "left").select(
        "feature",
        F.coalesce("levels", F.lit(0)).cast("bigint").alias("levels"),
        "unknown_rows",
        (F.lit(100.0) * F.col("unknown_rows") / F.col("rows")).alias("unknown_pct"),
        (F.lit(100.0) * F.col("missing_rows") / F.col("rows")).alias("missing_pct"),
    ).orderBy(F.desc("unknown_rows"), "feature")


def missing_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of missing cells over the whole matrix, one aggregate."""
    types = {f.name: f.dataType for f in df.schema.fields}
    gaps = [F.count_if(S.is_missing(F.col(f"`{c}`"), types[c])) for c in columns]
    total = gaps[0]
    for gap in gaps[1:]:
        total = total + gap
    return df.agg(
        F.try_divide(total.cast("double"), F.count("*") * F.lit(float(len(columns)))).alias("missing_share")
    )
