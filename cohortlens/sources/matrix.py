"""Sources: delimited files, role inference, and the sparse long form of a binary matrix.

The canonical form has one row for each one of the matrix, ``(row, feature)``; zeros are
implied.  ``features(feature, role, ord, class)`` describes the columns and has as many
rows as the matrix has columns, so it may be broadcast.  The rows' ids are a table of
their own, as a row of zeros has no ones.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

log = logging.getLogger(__name__)

# Drugs of each antibiotic class, in order.
DRUG_CLASSES: dict[str, list[str]] = {
    "Tetracyclines": ["Oxytetracycline", "Doxycycline"],
    "Macrolides": ["Tulathromycin"],
    "Aminoglycosides": ["Spectinomycin", "Gentamicin"],
    "Pleuromutilins": ["Tiamulin"],
    "Sulfonamides": ["Trimethoprim_Sulphamethoxazole"],
    "Fluoroquinolones": ["Enrofloxacin"],
    "Penicillins": ["Penicillin", "Ampicillin", "Amoxicillin_Clavulanic_acid"],
    "Cephalosporins": ["Ceftiofur"],
    "Phenicols": ["Florfenicol"],
}
# Columns that are neither phenotype nor genotype, in lower case.
SKIPPED = ("strain_id", "mlst", "serotype")
# File names in order of preference.
PREFERRED = ("merged_resistance_data.csv", "merged_data.csv", "data.csv", "MIC.csv")

FEATURES = T.StructType([T.StructField("feature", T.StringType()), T.StructField("role", T.StringType()), T.StructField("ord", T.IntegerType()), T.StructField("class", T.StringType())])


#: Columns up to which features are looked up in a table that each row carries along; wider matrices join.
FEW_FEATURES = 1000


@dataclass
class BinaryMatrix:
    """``ones(row, feature)`` without repeats, ``rows(row)``, ``features`` (see module).

    ``arrays(row, has)``, where known, has each row's features as one array: what concerns
    a row alone (its pattern, classes, pairs, flags) is then a projection, without an exchange.
    """

    ones: DataFrame
    rows: DataFrame
    features: DataFrame
    classes: list[str] = field(default_factory=lambda: list(DRUG_CLASSES))
    arrays: DataFrame | None = None

    def by_row(self) -> DataFrame:
        """``row, has`` of all rows, those without ones included."""
        if self.arrays is not None:
            return self.arrays
        has = self.ones.groupBy("row").agg(F.collect_set("feature").alias("has"))
        return self.rows.join(has, "row", "left").select("row", F.coalesce("has", F.array().cast("array<string>")).alias("has"))

    def with_arrays(self) -> BinaryMatrix:
        return self if self.arrays is not None else packed(self.by_row(), self.features, self.classes)

    def role(self, role: str) -> BinaryMatrix:
        f = self.features.where(F.col("role") == role)
        if self.arrays is not None and few_features(f):
            names = f.agg(F.collect_list("feature").alias("_names"))
            kept = self.arrays.crossJoin(F.broadcast(names)).select("row", F.array_intersect("has", "_names").alias("has"))
            return packed(kept, f, self.classes)
        return BinaryMatrix(self.ones.join(F.broadcast(f.select("feature")), "feature").select("row", "feature"), self.rows, f, self.classes)

    def only_rows(self, rows: DataFrame) -> BinaryMatrix:
        rows = rows.select("row")
        return BinaryMatrix(self.ones.join(rows, "row", "left_semi"), rows, self.features, self.classes)

    def class_arrays(self) -> DataFrame | None:
        """``row, has`` with the classes of each row, where arrays are known."""
        of = self.features.where("class is not null")
        if self.arrays is None or not few_features(of):
            return None
        named = of.agg(F.map_from_entries(F.collect_list(F.struct("feature", "class"))).alias("_of"))
        found = F.transform("has", lambda f: F.try_element_at("_of", f))
        return self.arrays.crossJoin(F.broadcast(named)).select("row", F.array_distinct(F.array_compact(found)).alias("has"))

    def class_level(self) -> BinaryMatrix:
        """Classes as features: a class is one where any of its drugs is."""
        spark = self.features.sparkSession
        f = spark.createDataFrame([(c, "class", i, None) for i, c in enumerate(self.classes)], FEATURES)
        arrays = self.class_arrays()
        if arrays is not None:
            return packed(arrays, f, self.classes)
        named = F.broadcast(self.features.where("class is not null").select("feature", F.col("class").alias("name")))
        ones = self.ones.join(named, "feature").select("row", F.col("name").alias("feature")).distinct()
        return BinaryMatrix(ones, self.rows, f, self.classes)

    def union(self, other: BinaryMatrix) -> BinaryMatrix:
        return BinaryMatrix(self.ones.unionByName(other.ones), self.rows, self.features.unionByName(other.features), self.classes)


def few_features(features: DataFrame) -> bool:
    return features.limit(FEW_FEATURES + 1).count() <= FEW_FEATURES


def packed(arrays: DataFrame, features: DataFrame, classes: list[str] | None = None) -> BinaryMatrix:
    """A matrix from ``arrays(row, has)`` with a row for each row, without repeats in ``has``."""
    return BinaryMatrix(arrays.select("row", F.explode("has").alias("feature")), arrays.select("row"), features, classes or list(DRUG_CLASSES), arrays)


def discover(names: list[str]) -> str | None:
    """The preferred CSV of a folder's file names, else the first by name."""
    files = sorted(n for n in names if n.lower().endswith(".csv"))
    return next((p for p in PREFERRED if p in files), files[0] if files else None)


def sniff_delimiter(header: str) -> str:
    """The delimiter that splits a header line most; a comma where none does."""
    return max(",;\t|", key=lambda d: (header.count(d), -",;\t|".index(d)))


def read_delimited(spark: SparkSession, path: str, id_col: str = "Strain_ID") -> DataFrame:
    """All columns as strings, named as in the header; only the header is read to plan the scan."""
    head = spark.read.text(path).limit(1).collect()
    if not head:
        return spark.createDataFrame([], T.StructType([T.StructField(id_col, T.StringType())]))
    sep = sniff_delimiter(head[0][0])
    # header=True without inference reads the names with Spark's own rules for quotes
    return spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", False).csv(path)


def try_read_delimited(spark: SparkSession, path: str, id_col: str = "Strain_ID") -> DataFrame | None:
    """``read_delimited``, or None, with the reason in the log, where the file can't be read."""
    try:
        return read_delimited(spark, path, id_col)
    except Exception as e:  # noqa: BLE001 - whatever the reader says
        log.error("%s can't be read: %s", path, str(e).splitlines()[0])
        return None


def feature_roles(columns: list[str], classes: dict[str, list[str]] | None = None, skipped: tuple[str, ...] = SKIPPED) -> list[tuple[str, str, int, str | None]]:
    """(feature, role, ord, class) of the columns that aren't skipped: drugs of a class are phenotypes, the rest genes."""
    of = {d: c for c, drugs in (classes or DRUG_CLASSES).items() for d in drugs}
    return [(c, "phenotype" if c in of else "gene", i, of.get(c)) for i, c in enumerate(columns) if c.lower() not in skipped]


def from_wide(df: DataFrame, id_col: str = "Strain_ID", classes: dict[str, list[str]] | None = None, null_is_one: bool = False, skipped: tuple[str, ...] = SKIPPED) -> BinaryMatrix:
    """Long form of a wide 0/1 table (numbers or text): a cell is one if it is a number other than 0.

    Nulls are zeros unless ``null_is_one``; text that is no number is a zero (see
    ``binarise_genes`` for text cells).  Repeated ids are merged.
    """
    roles = feature_roles([c for c in df.columns if c != id_col], classes, skipped)
    cells = []
    for name, *_ in roles:
        number = F.col(f"`{name}`").cast("string").try_cast("double")
        one = F.coalesce(number != 0, F.lit(null_is_one))
        cells.append(F.when(one, F.lit(name)))
    ids = df.select(F.col(f"`{id_col}`").cast("string").alias("row"), F.array_compact(F.array(*cells)).alias("has"))
    ones = ids.select("row", F.explode("has").alias("feature")).distinct()
    return BinaryMatrix(ones, ids.select("row").distinct(), df.sparkSession.createDataFrame(roles, FEATURES), list(classes or DRUG_CLASSES))


def to_wide(m: BinaryMatrix, names: list[str]) -> DataFrame:
    """``row`` and an int column for each name; rows without ones are kept."""
    if not names:
        return m.rows
    wide = m.ones.groupBy("row").agg(*[F.max(F.when(F.col("feature") == n, 1).otherwise(0)).alias(n) for n in names])
    return m.rows.join(wide, "row", "left").na.fill(0, names)


def join_files(left: DataFrame, right: DataFrame, id_col: str = "Strain_ID") -> DataFrame:
    """Two tables aligned on the id; rows of either side are kept."""
    return left.join(right, id_col, "full_outer")


def load_patterns(spark: SparkSession, path: str, table: str = "mdr_patterns") -> tuple[DataFrame, dict]:
    """A pattern store by its suffix, registered as a view; also its name, columns and number of rows."""
    if path.rstrip("/").endswith(".csv"):
        df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    elif path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported file format: {path}")
    df.createOrReplaceTempView(table)
    return df, {"table_name": table, "columns": df.columns, "row_count": df.count()}


# ---- the driver's tables as a matrix ---------------------------------------------------------

#: Classes over the first 13 brands, with the sizes of DRUG_CLASSES.
BRANDS = [f"Brand#{i}" for i in range(1, 26)]


def brand_classes() -> dict[str, list[str]]:
    out, at = {}, 0
    for name, drugs in DRUG_CLASSES.items():
        out[name] = BRANDS[at : at + len(drugs)]
        at += len(drugs)
    return out


FLAGS = ["flag_AF", "flag_AO", "flag_NF", "flag_NO", "flag_RF", "flag_RO"]


def star_matrix(spark: SparkSession, sf_dir: str) -> BinaryMatrix:
    """Orders as isolates; brands of their parts and line flags as features.

    ``part`` has one row for each part and isn't hinted: its size decides the join.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    both = lines.join(part, lines.l_partkey == part.p_partkey, "left")
    flag = F.concat(F.lit("flag_"), "l_returnflag", "l_linestatus")
    # the one exchange of the rows: everything about an order comes from its arrays
    if part.where(~F.col("p_brand").isin(BRANDS)).limit(1).count() or lines.where(~flag.isin(FLAGS)).limit(1).count():
        arrays = both.groupBy(F.col("l_orderkey").alias("row")).agg(F.collect_set("p_brand").alias("b"), F.collect_set(flag).alias("f")).select("row", F.concat("b", "f").alias("has"))
    else:
        # known names are bits of one number: sets that are collected are sorted and spill, and weigh several times as much
        line = lines.select("l_orderkey", "l_partkey", _bit(flag, FLAGS, len(BRANDS)).alias("f"))
        brand = part.select("p_partkey", _bit(F.col("p_brand"), BRANDS, 0).alias("b"))
        both = line.join(brand, line.l_partkey == brand.p_partkey, "left")
        found = both.groupBy(F.col("l_orderkey").alias("row")).agg(F.bit_or(F.col("f").bitwiseOR(F.coalesce("b", F.lit(0).cast("long")))).alias("bits"))
        arrays = found.select("row", F.filter(F.array(*map(F.lit, BRANDS + FLAGS)), lambda _, i: F.getbit("bits", i) == 1).alias("has"))
    return packed(arrays, spark.createDataFrame(feature_roles(BRANDS + FLAGS, brand_classes()), FEATURES))


def _bit(name: Column, names: list[str], first: int) -> Column:
    """A number with the bit of the name's place, counted from ``first``; 0 for a null."""
    out = F.lit(0).cast("long")
    for i, known in enumerate(names, first):
        out = F.when(name == known, F.lit(1 << i).cast("long")).otherwise(out)
    return out
