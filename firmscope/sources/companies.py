"""Company sources and sinks.

* ``read_tables``   — company view over the supplied star-schema tables
                      (customer, orders, nation, region), so every operator
                      runs on the driver's parquet data.
* ``read_companies``— raw firmographic CSV: all columns as text, rows with too
                      many fields skipped, short rows padded with nulls.
* ``read_results`` / ``write_results`` — pipeline output as parquet or CSV.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Raw headers of the firmographic CSV -> engine names (fixed values).
RAW_COLUMNS = (
    ("DUNS Number ", "company_id"),
    ("Company Sites", "company_name"),
    ("Website", "website"),
    ("Address Line 1", "address"),
    ("City", "city"),
    ("State", "state"),
    ("Region", "region"),
    ("Country", "country"),
    ("Phone Number", "phone"),
    ("SIC Code", "sic_code"),
    ("SIC Description", "sic_description"),
    ("Year Found", "year_found"),
    ("Entity Type", "entity_type"),
    ("Parent Company", "parent_company"),
    ("Is Domestic Ultimate", "is_domestic_ultimate"),
    ("Revenue (USD)", "revenue_usd"),
    ("Employees Total", "employees_total"),
    ("Employees Single Site", "employees_single_site"),
    ("Corporate Family Members", "corporate_family_members"),
    ("Market Value (USD)", "market_value_usd"),
    ("IT Spend", "it_spend"),
)
ENGINE_COLUMNS = tuple(name for _, name in RAW_COLUMNS)

# Text the pandas CSV reader turns into a missing value (fixed values).
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

_OVERFLOW = "_overflow_field"

# Columns of the company view built by ``read_tables`` (in order).
RAW_VIEW_COLUMNS = (
    "company_id", "company_name", "region", "country", "sic_code", "sic_description", "entity_type", "parent_company",
    "year_found", "is_domestic_ultimate", "revenue_usd", "employees_total", "employees_single_site",
    "corporate_family_members", "market_value_usd", "it_spend",
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company table (one row per customer) over the star schema.

    Orders are aggregated per customer (partial aggregation, then one shuffle
    on the key); nation and region are TPC-H fixed-size dimensions (25 and 5
    rows), so broadcasting them is bounded by construction.
    """
    customer = _table(spark, sf_dir, "customer")
    orders = _table(spark, sf_dir, "orders")
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = _table(spark, sf_dir, "region").select("r_regionkey", "r_name")

    per_cust = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("tot"),
    )
    k = F.col("c_custkey")
    revenue_factor = (
        F.when(k % 6 == 0, F.lit(0.01).cast("decimal(3,2)"))
        .when(k % 6 == 1, F.lit(0.1).cast("decimal(3,2)"))
        .when(k % 6 == 2, F.lit(1).cast("decimal(3,2)"))
        .when(k % 6 == 3, F.lit(10).cast("decimal(5,2)"))
        .otherwise(F.lit(100).cast("decimal(5,2)"))
    )
    c = (
        customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey)
        .join(F.broadcast(region), F.col("n_regionkey") == region.r_regionkey)
        .join(per_cust, per_cust.o_custkey == customer.c_custkey, "left")
    )
    return c.select(
        k.alias("company_id"),
        F.col("c_name").alias("company_name"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("country"),
        F.when(k % 11 == 0, F.lit(None)).otherwise((F.lit(1000) + (k * 37) % 8900).cast("string")).alias("sic_code"),
        F.concat(F.lit("Industry "), F.col("c_mktsegment")).alias("sic_description"),
        F.when(k % 13 == 0, F.lit(None))
        .when(k % 5 == 0, "Parent")
        .when((k % 5 == 1) | (k % 5 == 2), "Subsidiary")
        .when(k % 5 == 3, "Branch")
        .when(k % 10 == 9, "Headquarters")
        .otherwise("Single Location")
        .alias("entity_type"),
        F.when(k % 3 == 0, F.concat(F.lit("Parent#"), (k % 97).cast("string"))).alias("parent_company"),
        F.when(k % 17 == 0, F.lit(None)).otherwise((F.lit(1900) + (k * 7) % 126).cast("string")).alias("year_found"),
        F.when(k % 4 == 0, "Yes").when(k % 4 == 1, "No").when(k % 28 == 2, "1").alias("is_domestic_ultimate"),
        F.when(k % 6 == 5, F.lit(None))
        .otherwise(F.concat(F.lit("$"), (F.col("tot") * revenue_factor).cast("decimal(18,2)").cast("string")))
        .alias("revenue_usd"),
        F.when(k % 7 == 0, F.lit("0"))
        .otherwise((F.col("n_orders") * (F.lit(1) + k % 40)).cast("string"))
        .alias("employees_total"),
        (F.lit(1) + k % 40).cast("string").alias("employees_single_site"),
        ((k * 13) % 250).cast("string").alias("corporate_family_members"),
        F.when(F.col("c_acctbal") > 6000, F.col("c_acctbal").cast("decimal(18,2)").cast("string")).alias("market_value_usd"),
        F.when(k % 8 < 3, ((k % 900) * 1000).cast("string")).alias("it_spend"),
    )


def read_companies(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Raw firmographic CSV with header, the engine's columns as text.

    Columns go by their header, in any order; unknown ones are left out, known
    ones that are absent are null. A row with more fields than the header is
    skipped; a short row is padded with nulls. ``multi_line`` allows line
    breaks inside quotes, for which Spark reads each file in one task; without
    it large files are split. The files of a folder share one header.
    """
    reader = lambda: spark.read.option("header", "true").option("multiLine", str(multi_line).lower()).option("escape", '"')
    header = reader().csv(path).columns
    # by position: names may repeat or differ in case, and a long row fills the last field
    fields = [f"c{i}" for i in range(len(header))]
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in [*fields, _OVERFLOW]])
    df = reader().option("mode", "PERMISSIVE").option("enforceSchema", "true").schema(schema).csv(path).filter(F.col(_OVERFLOW).isNull())
    place = {name.strip(): c for c, name in reversed(list(zip(fields, header)))}
    found = [F.col(place[raw.strip()]).alias(name) for raw, name in RAW_COLUMNS if raw.strip() in place]
    return ensure_columns(nullify_tokens(df.select(*found))).select(*ENGINE_COLUMNS)


def nullify_tokens(df: DataFrame, columns=None) -> DataFrame:
    """Text the pandas reader treats as missing becomes SQL NULL."""
    columns = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.col(c).isin(*NULL_TOKENS), F.col(c)) for c in columns})


def ensure_columns(df: DataFrame, columns=ENGINE_COLUMNS) -> DataFrame:
    """Absent columns become all-null text columns."""
    missing = {c: F.lit(None).cast("string") for c in columns if c not in df.columns}
    return df.withColumns(missing) if missing else df


def read_results(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "parquet":
        return spark.read.parquet(path)
    return spark.read.option("header", "true").option("inferSchema", "false").csv(path)


def write_results(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = "region") -> None:
    """Write every result column (nothing dropped). Parquet output is
    partitioned by region so the market filter prunes whole folders."""
    writer = df.write.mode("overwrite")
    if partition_by and partition_by in df.columns:
        writer = writer.partitionBy(partition_by)
    if fmt == "parquet":
        writer.parquet(path)
    else:
        writer.option("header", "true").csv(path)
