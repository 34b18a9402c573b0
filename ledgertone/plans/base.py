"""Query registry: a Spark plan over the driver tables and the SQL that checks it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spark_sql(text: str) -> str:
    """Expressions are written once for both engines; lists are the one difference."""
    return text.replace("LIST(", "array(")


def duck_sql(text: str) -> str:
    return text.replace("LIST(", "list_value(")


def columns(exprs: dict[str, str], dialect) -> list[str]:
    return [f"{dialect(e)} AS {n}" for n, e in exprs.items()]


def fix_text(c: str = "fix"):
    """A fix as one comparable text."""
    return F.concat_ws(
        ";",
        F.transform(
            F.col(c),
            lambda x: F.concat(
                x["field"],
                F.coalesce(F.concat(F.lit("["), x["pos"].cast("string"), F.lit("]")), F.lit("")),
                F.lit("="),
                F.coalesce(x["value"], F.array_join(x["items"], ","), F.lit("-")),
            ),
        ),
    )


def show_list(c):
    return F.array_join(c, ",")
