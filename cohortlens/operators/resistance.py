"""Row-level operators: class resistance, multiresistance, binarisation, checks of wide tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..sources.matrix import BinaryMatrix, packed


def class_resistance(m: BinaryMatrix) -> DataFrame:
    """Wide ``row`` and one int per class: 1 where any drug of the class is (0 for a class without drugs)."""
    of = m.features.where("class is not null").select("feature", F.col("class").alias("name"))
    long = m.ones.join(F.broadcast(of), "feature").groupBy("row").agg(*[F.max((F.col("name") == c).cast("int")).alias(c) for c in m.classes])
    return m.rows.join(long, "row", "left").na.fill(0, m.classes)


def class_resistance_wide(df: DataFrame, classes: dict[str, list[str]], id_col: str = "Strain_ID") -> DataFrame:
    """The same from a wide table, as greatest of its drug columns: no exchange at all."""

    def of(drugs: list[str]) -> Column:
        have = [F.coalesce(F.col(f"`{d}`").cast("int"), F.lit(0)) for d in drugs if d in df.columns]
        return F.lit(0) if not have else have[0] if len(have) == 1 else F.greatest(*have)

    return df.select(F.col(f"`{id_col}`").alias("row"), *[of(d).alias(c) for c, d in classes.items()])


def multiresistance(m: BinaryMatrix, threshold: int = 3) -> DataFrame:
    """``row, n_classes, is_mdr``: resistant to ``threshold`` classes or more."""
    arrays = m.class_arrays()
    if arrays is not None:
        return arrays.select("row", F.size("has").cast("long").alias("n_classes")).withColumn("is_mdr", F.col("n_classes") >= threshold)
    of = m.features.where("class is not null").select("feature", F.col("class").alias("name"))
    n = m.ones.join(F.broadcast(of), "feature").groupBy("row").agg(F.count_distinct("name").alias("n_classes"))
    full = m.rows.join(n, "row", "left").select("row", F.coalesce("n_classes", F.lit(0)).alias("n_classes"))
    return full.withColumn("is_mdr", F.col("n_classes") >= threshold)


def mdr_subset(m: BinaryMatrix, threshold: int = 3) -> BinaryMatrix:
    if m.arrays is None:
        return m.only_rows(multiresistance(m, threshold).where("is_mdr"))
    of = m.features.where("class is not null").agg(F.map_from_entries(F.collect_list(F.struct("feature", "class"))).alias("_of"))
    many = F.size(F.array_distinct(F.array_compact(F.transform("has", lambda f: F.try_element_at("_of", f)))))
    return packed(m.arrays.crossJoin(F.broadcast(of)).where(many >= threshold).select("row", "has"), m.features, m.classes)


def fast_mdr_count(m: BinaryMatrix, threshold: int = 3) -> DataFrame:
    """One row ``n_mdr, prevalence``: rows with ``threshold`` ones or more, over raw columns."""
    flag = F.size("has") >= threshold
    return m.by_row().agg(F.coalesce(F.sum(flag.cast("long")), F.lit(0)).alias("n_mdr"), F.coalesce(F.avg(flag.cast("double")), F.lit(0.0)).alias("prevalence"))


def hybrid_binary(value: Column, null_is_one: bool = False) -> Column:
    """1 for a number other than 0; nulls are 0 unless the reference's reading of NaN is asked for."""
    return F.coalesce((value.cast("double") != 0).cast("int"), F.lit(int(null_is_one)))


def binarise_genes(df: DataFrame, gene_cols: list[str], id_col: str) -> DataFrame:
    """Numbers are truncated to int; a text column is read as ints if all of its values are, else 1 where not null or empty.

    One aggregate decides for all text columns.
    """
    text = [c for c in gene_cols if isinstance(df.schema[c].dataType, T.StringType)]
    ints: dict[str, bool] = {}
    if text:
        row = df.agg(*[F.coalesce(F.bool_and(F.col(f"`{c}`").try_cast("int").isNotNull()), F.lit(False)).alias(f"c{i}") for i, c in enumerate(text)]).first()
        ints = {c: row[i] for i, c in enumerate(text)}

    def cell(c: str) -> Column:
        v = F.col(f"`{c}`")
        if c not in ints:
            return v.cast("int")
        return v.try_cast("int") if ints[c] else (v.isNotNull() & (v != "")).cast("int")

    return df.select(F.col(f"`{id_col}`"), *[cell(c).alias(c) for c in gene_cols])


def binary_encoding(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, is_binary`` in one pass; nulls are allowed."""
    names = columns or df.columns
    flags = [F.coalesce(F.bool_and(F.col(f"`{c}`").cast("double").isin(0.0, 1.0)), F.lit(True)).alias(f"c{i}") for i, c in enumerate(names)]
    one = df.agg(*flags)
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("is_binary")) for i, c in enumerate(names)])))


def downcast(df: DataFrame) -> DataFrame:
    """Integers to the smallest of byte, short and int that holds them; doubles to float. One pass for the ranges."""
    whole = [f.name for f in df.schema if isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType))]
    row = df.agg(*[x for i, c in enumerate(whole) for x in (F.min(f"`{c}`").alias(f"l{i}"), F.max(f"`{c}`").alias(f"h{i}"))]).first() if whole else None

    def kind(f: T.StructField) -> str:
        if isinstance(f.dataType, T.DoubleType):
            return "float"
        if f.name in whole:
            lo, hi = row[f"l{whole.index(f.name)}"], row[f"h{whole.index(f.name)}"]
            for name, bits in (("byte", 7), ("short", 15), ("int", 31)):
                if lo is None or -(1 << bits) <= lo and hi < 1 << bits:
                    return name
        return f.dataType.simpleString()

    return df.select(*[F.col(f"`{f.name}`").cast(kind(f)).alias(f.name) for f in df.schema])


def density(m: BinaryMatrix, limit: float = 0.3) -> DataFrame:
    """One row ``n_ones, n_cells, density, is_dense`` of the sparse form."""
    n = m.rows.agg(F.count("*").alias("r")).crossJoin(m.features.agg(F.count("*").alias("f"))).crossJoin(m.ones.agg(F.count("*").alias("n_ones")))
    cells = F.col("r") * F.col("f")
    return n.select("n_ones", cells.alias("n_cells"), F.when(cells > 0, F.col("n_ones") / cells).otherwise(0.0).alias("density")).withColumn("is_dense", F.col("density") > limit)


def class_distribution(flags: DataFrame) -> DataFrame:
    """Rows by resistance category: extensively resistant from 6 classes, pan-resistant from 9."""
    label = F.when(F.col("n_classes") >= 9, "PDR").when(F.col("n_classes") >= 6, "XDR").when(F.col("is_mdr"), "MDR").otherwise("non-MDR")
    by = flags.groupBy(label.alias("category")).agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("total"))
    return by.crossJoin(total).select("category", "n", (F.col("n") / F.col("total")).alias("share"))
