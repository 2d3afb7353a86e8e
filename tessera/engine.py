"""The engine: statements, tables and commands over one Spark session."""

from __future__ import annotations

import csv
import io
import re
import time
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.dialect import DialectError, resolve_division, translate, unique_names
from tessera.functions import format_value, register_functions
from tessera.operators import dictionary_encode, sorted_edges
from tessera.session import apply_semantics
from tessera.sources import copy_table, load_csv
from tessera.sources.files import stored

#: Column types as they are spelt in CREATE TABLE; declared lengths are ignored.
DDL_TYPES = {
    "bool": T.BooleanType(), "byte": T.ByteType(), "int": T.IntegerType(), "integer": T.IntegerType(), "long": T.LongType(),
    "double": T.DoubleType(), "numeric": T.DoubleType(), "character": T.StringType(), "char": T.StringType(),
    "character varying": T.StringType(), "varchar": T.StringType(), "text": T.StringType(), "string": T.StringType(),
    "stringcode": T.StringType(), "string_code": T.StringType(), "date": T.DateType(), "time": T.StringType(), "timestamp": T.TimestampNTZType(),
}


class Engine:
    """SQL statements and data commands. Tables are temporary views by name; names are case-insensitive."""

    def __init__(self, spark: SparkSession):
        self.spark = apply_semantics(spark)
        self.schemas: dict[str, T.StructType] = {}
        register_functions(spark)

    # ---- statements ----

    def sql(self, text: str) -> DataFrame | None:
        """Run one statement; SELECT returns its rows, other statements return None."""
        word = text.lstrip().split(None, 1)[0].lower()
        if word == "create":
            return self.create_table(text)
        if word == "drop":
            return self.drop_table(re.fullmatch(r"\s*drop\s+table\s+(\w+)\s*;?\s*", text, re.I)[1])
        if word not in ("select", "with"):
            raise DialectError(f"unsupported statement: {word}")
        statement = translate(text)
        df = unique_names(self.spark.sql(resolve_division(self.spark, statement.sql)))
        if statement.into:
            self._register(statement.into, stored(df))
            return None
        return df

    def explain(self, text: str) -> str:
        df = self.sql(text)
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")

    # ---- tables ----

    def _register(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(name.lower())
        self.schemas[name.lower()] = df.schema

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name.lower())

    def exists(self, name: str) -> bool:
        return name.lower() in self.schemas or self.spark.catalog.tableExists(name.lower())

    def create_table(self, ddl: str) -> None:
        """CREATE TABLE name (column type constraint*, ...): an empty table; constraints are kept as metadata only."""
        m = re.fullmatch(r"\s*create\s+table\s+(\w+)\s*\((.*)\)\s*;?\s*", ddl, re.I | re.S)
        if not m:
            raise DialectError("malformed CREATE TABLE")
        name = m[1].lower()
        if self.exists(name):
            raise DialectError(f"table {name} exists")
        fields: list[T.StructField] = []
        for part in re.split(r",(?![^(]*\))", m[2]):
            c = re.fullmatch(r"\s*(\w+)\s+(character\s+varying|\w+)\s*(?:\(\s*\d+\s*\))?\s*(.*?)\s*", part, re.I | re.S)
            kind = c and DDL_TYPES.get(" ".join(c[2].lower().split()))
            if kind is None:
                raise DialectError(f"unknown column type in {part.strip()!r}")
            if c[1].lower() in [f.name for f in fields]:
                raise DialectError(f"duplicate column {c[1].lower()}")
            flags = " ".join(c[3].lower().split())
            meta = {"pk": "primary key" in flags, "unique": "unique" in flags, "not_null": "not null" in flags, "fk": "references" in flags}
            fields.append(T.StructField(c[1].lower(), kind, True, meta))
        self._register(name, self.spark.createDataFrame([], T.StructType(fields)))

    def create_like(self, source: str, target: str) -> None:
        if self.exists(target):
            raise DialectError(f"table {target} exists")
        self._register(target, self.spark.createDataFrame([], self.table(source).schema))

    def drop_table(self, name: str) -> None:
        if not self.exists(name):
            raise DialectError(f"no table {name}")
        self.schemas.pop(name.lower(), None)
        self.spark.catalog.dropTempView(name.lower())

    def load(self, name: str, path: str, separator: str = ",", null_token: str = "NULL") -> DataFrame:
        """Replace a table's rows by those of a delimited file; a malformed field raises, and the table stays as it was."""
        df = stored(load_csv(self.spark, path, self.table(name).schema, separator, null_token))
        self._register(name, df)
        return df

    def copy(self, name: str, path: str, rows: int | None = None) -> None:
        copy_table(self.table(name), path, rows)

    def list_tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables() if t.isTemporary)

    def cardinality(self, name: str) -> int:
        return self.table(name).count()

    def compress(self, name: str) -> DataFrame:
        """Dictionary-code the string columns of a table; returns the dictionary."""
        strings = [f.name for f in self.table(name).schema if isinstance(f.dataType, T.StringType)]
        coded, dictionary = dictionary_encode(self.table(name), *strings)
        self._register(f"{name}_coded", coded)
        return dictionary

    def index(self, name: str = "edge") -> tuple[DataFrame, DataFrame]:
        """Sorted, co-partitioned layouts of an edge table."""
        return sorted_edges(self.table(name))

    # ---- output ----

    def render(self, df: DataFrame, rows: int = 1000) -> str:
        """Tab-separated text with ``[null]`` for nulls, as the shell prints it."""
        shown = df.select(*[format_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema]).limit(rows)
        return "\n".join(["\t".join(df.columns), *("\t".join(r) for r in shown.collect())])

    # ---- commands ----

    def command(self, line: str) -> str:
        """One shell line: a data command or a statement."""
        line = line.strip()
        words = line.rstrip(";").split()
        if not words:
            return ""
        match words[0].lower():
            case "help":
                return "load <table> <file> <separator> <null> | exec <file> | bench <dir> <out> | explain <query> | compress | index all | list | quit | <sql>"
            case "quit":
                raise EOFError
            case "list":
                return "\n".join(self.list_tables())
            case "load":
                _, table, path, separator, token = words
                self.load(table, path, separator, token)
                return f"loaded {self.cardinality(table)} rows"
            case "exec":
                return "\n".join(self.run_script(self._read(words[1])))
            case "bench":
                return self.bench(words[1], words[2])
            case "explain":
                return self.explain(line[len("explain") :])
            case "compress":
                return "\n".join(f"{t}: {self.compress(t).count()} strings" for t in self.list_tables() if any(isinstance(f.dataType, T.StringType) for f in self.table(t).schema) and not t.endswith("_coded"))
            case "index":
                by_source, by_target = self.index()
                by_source.createOrReplaceTempView("edge_by_sid")
                by_target.createOrReplaceTempView("edge_by_tid")
                return "indexed edge"
        df = self.sql(line)
        return "" if df is None else self.render(df)

    def run_script(self, text: str) -> list[str]:
        """Run ``;``-separated lines; an error is reported and the rest still runs."""
        out = []
        for part in re.split(r";(?=(?:[^']*'[^']*')*[^']*$)", text):
            if part.strip():
                try:
                    out.append(self.command(part))
                except EOFError:
                    break
                except Exception as error:  # a script reports each failing statement and goes on
                    out.append(f"error: {str(error).splitlines()[0]}")
        return out

    def _read(self, path: str) -> str:
        return "".join(r.value for r in self.spark.read.text(path, wholetext=True).collect())

    def bench(self, directory: str, out: str) -> str:
        """Time every ``*.sql`` of a directory, by name, without keeping results; write a CSV of seconds."""
        files = self.spark.read.text(f"{directory}/*.sql", wholetext=True).select("value", F.input_file_name().alias("file")).orderBy("file").collect()
        sheet = io.StringIO()
        writer = csv.writer(sheet)
        writer.writerow(["query", "seconds", "rows"])
        for r in files:
            began = time.perf_counter()
            rows = self.sql(r["value"]).count()
            writer.writerow([PurePosixPath(r["file"]).name, round(time.perf_counter() - began, 3), rows])
        self.spark.createDataFrame([(line,) for line in sheet.getvalue().splitlines()], "value string").coalesce(1).write.mode("overwrite").text(out)
        return sheet.getvalue()
