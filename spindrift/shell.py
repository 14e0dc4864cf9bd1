"""A small SQL shell: statements end with a semicolon, dot commands stand alone.

    .help  .exit  .quit  .tables ?PATTERN?  .schema ?TABLE?  .headers on|off  .mode column|csv|line|list
    .open FOLDER               vector tables under a folder; each is a view, and NAME_knn(query, k) searches it
    .create NAME dim=N ?type=T? ?metric=M? ?mode=hnsw|exact? ?metadata="a TEXT, b REAL"?
    .insert NAME VIEW          .info NAME      .rebuild NAME      .sync NAME     .ef_search NAME N
    .export NAME FILE          .import NAME FILE                  .drop NAME
"""

from __future__ import annotations

import csv
import fnmatch
import io
import shlex
import sys
from collections.abc import Iterable

from pyspark.sql import SparkSession

from spindrift.functions import register
from spindrift.sources.table import Catalog

HELP = __doc__.split("\n\n", 1)[1].strip()
VECTOR_COMMANDS = frozenset(".open .create .insert .info .rebuild .sync .ef_search .export .import .drop".split())
#: Bytes shown of a binary value.
SHOWN_BYTES = 20


def shown(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (bytes, bytearray)):
        return f"x'{value[:SHOWN_BYTES].hex()}{'...' if len(value) > SHOWN_BYTES else ''}'"
    return str(value)


def rendered(columns: list[str], rows: list[list[str]], mode: str, headers: bool) -> str:
    if mode == "line":
        width = max(map(len, columns), default=0)
        return "\n\n".join("\n".join(f"{c:>{width}} = {x}" for c, x in zip(columns, row)) for row in rows)
    lines = ([columns] if headers else []) + rows
    if mode == "csv":
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows(lines)
        return out.getvalue().rstrip("\n")
    if mode == "list":
        return "\n".join("|".join(x) for x in lines)
    widths = [max(len(row[k]) for row in lines) for k in range(len(columns))] if lines else []
    if headers:
        lines.insert(1, ["-" * w for w in widths])
    return "\n".join("  ".join(f"{x:<{w}}" for x, w in zip(row, widths)).rstrip() for row in lines)


class Shell:
    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.mode, self.headers, self.buffer, self.vectors = spark, "list", False, "", None
        register(spark)

    def vector_command(self, name: str, args: list[str]) -> str:
        """The output of a command on a vector table; the table is a view again afterwards."""
        if name == ".open":
            self.vectors = Catalog(self.spark, args[0])
            return "\n".join(self.vectors.open(n).register_sql() for n in self.vectors.names())
        if self.vectors is None:
            return "no folder is open"
        if name == ".create":
            self.vectors.create(args[0], **dict(a.split("=", 1) for a in args[1:])).register_sql()
            return ""
        table, out = self.vectors.get(args[0]), ""
        if name == ".drop":
            self.vectors.drop(args[0])
            return ""
        if name == ".insert":
            out = str(table.insert(self.spark.table(args[1])))
        elif name == ".export":
            with open(args[1], "wb") as f:
                f.write(table.export_arrow())
        elif name == ".import":
            with open(args[1], "rb") as f:
                out = str(table.insert_arrow(f.read()))
        else:
            ways = {".info": table.index_info, ".rebuild": table.rebuild_index, ".sync": table.sync_index, ".ef_search": lambda: table.set_ef_search(int(args[1]))}
            out = str(ways[name]())
        table.register_sql()
        return out

    def command(self, line: str) -> str | None:
        """The output of a dot command; None ends the shell."""
        name, *args = shlex.split(line)
        if name in VECTOR_COMMANDS:
            return self.vector_command(name, args)
        if name in (".exit", ".quit"):
            return None
        if name == ".help":
            return HELP
        if name == ".tables":
            names = [t.name for t in self.spark.catalog.listTables()]
            return "\n".join(fnmatch.filter(names, args[0].replace("%", "*") if args else "*"))
        if name == ".schema":
            names = args or [t.name for t in self.spark.catalog.listTables()]
            return "\n".join(f"{n} ({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in self.spark.table(n).schema)})" for n in names)
        if name == ".headers" and args in (["on"], ["off"]):
            self.headers = args[0] == "on"
            return ""
        if name == ".mode" and args and args[0] in ("column", "csv", "line", "list"):
            self.mode = args[0]
            return ""
        return f"unknown command: {line}"

    def feed(self, line: str) -> str | None:
        """What one line of input gives; None ends the shell."""
        if not self.buffer and line.strip().startswith("."):
            try:
                return self.command(line.strip())
            except Exception as e:  # noqa: BLE001
                return f"Error: {e}"
        self.buffer += line + "\n"
        if not self.buffer.strip().endswith(";"):
            return ""
        statement, self.buffer = self.buffer.strip().rstrip(";"), ""
        try:
            df = self.spark.sql(statement)
            return rendered(df.columns, [[shown(x) for x in row] for row in df.collect()], self.mode, self.headers)
        except Exception as e:  # noqa: BLE001
            return f"Error: {str(e).splitlines()[0]}"

    def run(self, lines: Iterable[str]) -> None:
        for line in lines:
            out = self.feed(line.rstrip("\n"))
            if out is None:
                return
            if out:
                print(out)


if __name__ == "__main__":
    Shell(SparkSession.builder.getOrCreate()).run(sys.stdin)
