"""Databases: JDBC with partitioned reads, and the options of well-known ones. Drivers are the user's jars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVERS = {"postgresql": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver", "sqlite": "org.sqlite.JDBC"}


def options(url: str, table: str | None = None, query: str | None = None, user: str | None = None, password: str | None = None, driver: str | None = None, partition_column: str | None = None, lower: object = None, upper: object = None, partitions: int | None = None, fetch: int = 10_000) -> dict[str, str]:
    """Reader options; a partition column with bounds splits the read over tasks."""
    if bool(table) == bool(query):
        raise ValueError("give a table or a query")
    kind = url.split(":")[1] if url.startswith("jdbc:") else ""
    out = {"url": url, "driver": driver or DRIVERS.get(kind), "user": user, "password": password, "fetchsize": str(fetch)}
    if partition_column:
        out |= {"partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions or 8)}
        out["dbtable"] = table or f"({query}) q"
    else:
        out |= {"dbtable": table} if table else {"query": query}
    return {k: v for k, v in out.items() if v is not None}


def read(spark: SparkSession, url: str, **kw) -> DataFrame:
    return spark.read.format("jdbc").options(**options(url, **kw)).load()


def postgres(host: str, database: str, table: str | None = None, schema: str = "public", port: int = 5432, **kw) -> dict[str, str]:
    return options(f"jdbc:postgresql://{host}:{port}/{database}", table=f'{schema}."{table}"' if table else None, **kw)


def mysql(host: str, database: str, port: int = 3306, **kw) -> dict[str, str]:
    return options(f"jdbc:mysql://{host}:{port}/{database}", **kw)


def sqlite(path: str, **kw) -> dict[str, str]:
    return options(f"jdbc:sqlite:{path}", **kw)


MODES = {"append": "append", "replace": "overwrite", "fail": "errorifexists", "drop_and_create": "overwrite", "truncate_then_append": "overwrite"}


def export_to_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batchSize: int = 1000, partitions: int | None = None, **kw) -> None:
    """append, replace, fail, drop_and_create or truncate_then_append; ``partitions`` bounds the connections."""
    o = options(url, table=table, **kw) | {"batchsize": str(batchSize), "truncate": str(mode == "truncate_then_append").lower()}
    (df.coalesce(partitions) if partitions else df).write.format("jdbc").options(**o).mode(MODES[mode]).save()


def export_to_db(df: DataFrame, uri: str, table: str, if_exists: str = "append", **kw) -> None:
    """A database address without jdbc: in front."""
    export_to_jdbc(df, uri if uri.startswith("jdbc:") else f"jdbc:{uri}", table, if_exists, **kw)


def export_to_warehouse(df: DataFrame, kind: str, table: str, if_exists: str = "append", **opts) -> None:
    """snowflake or bigquery, through the connector that the user's session has."""
    o = {"snowflake": {"dbtable": table}, "bigquery": {"table": table}}[kind] | opts
    df.write.format(kind).options(**o).mode(MODES[if_exists]).save()
