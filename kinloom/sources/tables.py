"""Person tables from Parquet, CSV, catalog tables and databases: discovery, scans, counts, pages."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.schema import ColumnMapping, TableColumns, to_persons, validate_ident


@dataclass(frozen=True)
class Source:
    """Where tables are: a folder of Parquet or CSV files, the catalog, or a database by JDBC."""

    kind: str  # parquet | csv | catalog | jdbc
    location: str = ""
    options: dict[str, str] = field(default_factory=dict)

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        validate_ident(name)
        if self.kind == "parquet":
            return spark.read.options(**self.options).parquet(f"{self.location}/{name}.parquet")
        if self.kind == "csv":
            return spark.read.options(**({"header": "true"} | self.options)).csv(f"{self.location}/{name}.csv")
        if self.kind == "catalog":
            return spark.table(f"{self.location}.{name}" if self.location else name)
        if self.kind == "jdbc":
            return spark.read.format("jdbc").options(url=self.location, dbtable=name, **self.options).load()
        raise ValueError(f"unknown kind of source: {self.kind}")

    def tables(self, spark: SparkSession) -> list[str]:
        """Names of tables, in order."""
        if self.kind == "catalog":
            return sorted(t.name for t in (spark.catalog.listTables(self.location) if self.location else spark.catalog.listTables()))
        if self.kind == "jdbc":
            return _database_tables(spark, self)
        path = spark._jvm.org.apache.hadoop.fs.Path(self.location)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        suffix = f".{self.kind}"
        return sorted(s.getPath().getName().removesuffix(suffix) for s in found if s.getPath().getName().endswith(suffix))


def jdbc(url: str, *, user: str = "", password: str = "", lower: int | None = None, upper: int | None = None, partitions: int = 64, fetch: int = 10_000, timeout: int = 30) -> Source:
    """A database; with bounds of id, scans run as that many ranges of ids side by side."""
    options = {"user": user, "password": password, "fetchsize": str(fetch), "queryTimeout": str(timeout)}
    if lower is not None and upper is not None:
        options |= {"partitionColumn": "id", "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions)}
    return Source("jdbc", url, {k: v for k, v in options.items() if v})


def _database_tables(spark: SparkSession, source: Source) -> list[str]:
    """Names of a database's tables, by the driver's own metadata."""
    jvm = spark._jvm
    properties = jvm.java.util.Properties()
    for k in ("user", "password"):
        if k in source.options:
            properties.setProperty(k, source.options[k])
    if "driver" in source.options:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(source.options["driver"])
    connection = jvm.java.sql.DriverManager.getConnection(source.location, properties)
    try:
        kinds = spark.sparkContext._gateway.new_array(jvm.java.lang.String, 1)
        kinds[0] = "TABLE"
        found, names = connection.getMetaData().getTables(connection.getCatalog(), None, "%", kinds), []
        while found.next():
            names.append(found.getString("TABLE_NAME"))
    finally:
        connection.close()
    return sorted(names)


def in_ranges(spark: SparkSession, source: Source, name: str, *, column: str = "id", partitions: int = 64) -> Source:
    """source, whose scans of a database table run as ranges of a whole-number column side by side.

    The column's least and greatest value are asked of the database.  Other sources, those with bounds of their own, and
    empty tables stay as they are.
    """
    if source.kind != "jdbc" or "partitionColumn" in source.options:
        return source
    t = validate_ident(name)
    c = next((x for x in source.table(spark, name).columns if x.lower() == column.lower()), None)
    if c is None:
        return source
    quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(source.location).quoteIdentifier(c)
    r = spark.read.format("jdbc").options(url=source.location, query=f"SELECT MIN({quoted}) AS lo, MAX({quoted}) AS hi FROM {t}", **source.options).load().first()
    if r is None or r[0] is None:
        return source
    return Source("jdbc", source.location, source.options | {"partitionColumn": c, "lowerBound": str(r[0]), "upperBound": str(int(r[1]) + 1), "numPartitions": str(partitions)})


def discover_columns(spark: SparkSession, source: Source, name: str, mapping: ColumnMapping | None = None) -> TableColumns:
    return TableColumns.of(source.table(spark, name), mapping)


def persons(spark: SparkSession, source: Source, name: str, *, mapping: ColumnMapping | None = None, where: str | Column | None = None, role: int | None = None) -> DataFrame:
    """A table as the person relation.  where is over source columns and reaches the scan."""
    df = source.table(spark, name)
    return to_persons(df.filter(where) if where is not None else df, mapping, role)


def person_count(spark: SparkSession, source: Source, name: str, *, where: str | Column | None = None) -> int:
    df = source.table(spark, name)
    return (df.filter(where) if where is not None else df).count()


def page(df: DataFrame, *, offset: int, limit: int, where: str | Column | None = None) -> DataFrame:
    """Rows offset to offset + limit in the order of id.  For whole scans use ranges of id (jdbc), not pages."""
    return (df.filter(where) if where is not None else df).orderBy("id").offset(offset).limit(limit)


def keyset_page(df: DataFrame, *, column: str, after: str | int | None, limit: int) -> DataFrame:
    """The limit rows that follow ``after`` in the order of column."""
    c = F.col(validate_ident(column))
    return (df if after is None else df.filter(c > after)).orderBy(c).limit(limit)


def read_env(path: str) -> dict[str, str]:
    """KEY=value lines of a file: comments and blank lines are passed over, an export prefix and quotes go."""
    out: dict[str, str] = {}
    for line in Path(path).read_text().splitlines():
        line = line.strip().removeprefix("export ").strip()
        if line and not line.startswith("#") and "=" in line:
            key, value = (x.strip() for x in line.split("=", 1))
            if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
                value = value[1:-1]
            out[key] = value
    return out


def merged_env(path: str, environ: dict[str, str]) -> dict[str, str]:
    """environ with what it lacks from a file."""
    return read_env(path) | environ


def write_env_template(path: str) -> None:
    """A file with every setting that the command line reads."""
    keys = {"DB_HOST": "127.0.0.1", "DB_PORT": "3307", "DB_USER": "", "DB_PASSWORD": "", "DB_NAME": "", "DB2_HOST": "", "DB2_PORT": "", "DB2_USER": "", "DB2_PASS": "", "DB2_NAME": ""}
    Path(path).write_text("# Connection settings; the environment overrides them\n" + "".join(f"{k}={v}\n" for k, v in keys.items()))
