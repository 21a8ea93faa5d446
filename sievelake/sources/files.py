"""Files and tables as sources: (path, kind, content, read_error)."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import FILE_NAME, Contract, ContractError
from ..functions.wildcards import matches_path
from ..schemas import SOURCES


def kind_of(path: Column) -> Column:
    """yaml by its (case-sensitive) extension, else python."""
    return F.when(path.rlike(r"\.ya?ml\z"), "yaml").otherwise("python")


def excluded(path: str, patterns) -> bool:
    return any(matches_path(path, p) for p in patterns)


def _walk(folder: str, rel: str, contract: Contract, depth: int = -1):
    """(path, is a folder) of the files below a folder that the contract includes, to a depth, at which folders are given instead of entered."""
    for entry in os.scandir(folder):
        at = f"{rel}{entry.name}"
        if entry.is_dir(follow_symlinks=False):
            if not excluded(f"{at}/x", contract.scan.exclude) and not excluded(at, contract.scan.exclude):
                if depth == 0:
                    yield entry.path, True
                else:
                    yield from _walk(entry.path, f"{at}/", contract, depth - 1)
        elif entry.is_file(follow_symlinks=False) and not excluded(at, contract.scan.exclude) and any(matches_path(at, p) for p in contract.scan.include):
            yield entry.path, False


def collect_files(root: str, contract: Contract) -> list[str]:
    """Files under a folder that the contract includes, by path components; excluded folders aren't entered."""
    return sorted((p for p, _ in _walk(root, "", contract)), key=lambda p: p.split(os.sep))


def scan_folder(spark: SparkSession, root: str, contract: Contract, base: str | None = None, depth: int = 1, partitions: int | None = None) -> DataFrame:
    """The same files as sources, listed and read on the executors: the driver lists the upper levels only, so a huge tree isn't a list of its."""
    partitions = partitions or spark.sparkContext.defaultParallelism
    seeds = spark.createDataFrame([(p, d) for p, d in _walk(root, "", contract, depth)], "path string, folder boolean").repartition(partitions)
    base = root if base is None else base

    def listed(batches):
        for batch in batches:
            for path, folder in zip(batch.column("path").to_pylist(), batch.column("folder").to_pylist()):
                rel = os.path.relpath(path, root).replace(os.sep, "/") + "/"
                some = [p for p, _ in _walk(path, rel, contract)] if folder else [path]
                for at in range(0, len(some), 1024):
                    part = some[at : at + 1024]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([normalise(p, base) for p in part], pa.string())], ["file", "path"])

    found = seeds.mapInArrow(listed, "file string, path string").repartition(partitions)
    return found.withColumn("kind", kind_of(F.col("path"))).mapInArrow(_read, SOURCES)


def resolve_targets(paths: list[str], contract: Contract) -> list[str]:
    """Files of the command line: folders are walked, files are taken as they are, each once."""
    out: list[str] = []
    for p in paths:
        if os.path.isdir(p):
            out += collect_files(p, contract)
        elif os.path.exists(p):
            out.append(p)
        else:
            raise ContractError(f"{p}: there is no such file or folder")
    once: dict[str, str] = {}
    for p in out:
        once.setdefault(os.path.realpath(p), p)
    return list(once.values())


def scan_root(paths: list[str]) -> str:
    first = paths[0] if paths else "."
    return first if os.path.isdir(first) else os.path.dirname(first) or "."


def normalise(path: str, base: str) -> str:
    """Relative to the base with forward slashes; absolute outside it."""
    full, root = os.path.realpath(path), os.path.realpath(base)
    inside = full == root or full.startswith(root.rstrip(os.sep) + os.sep)
    return (os.path.relpath(full, root) if inside else full).replace(os.sep, "/")


def _read(batches):
    for batch in batches:
        contents, errors = [], []
        for path in batch.column("file").to_pylist():
            try:
                with open(path, encoding="utf-8", newline="") as f:
                    contents.append(f.read())
                    errors.append(None)
            except (OSError, UnicodeDecodeError) as e:
                contents.append(None)
                errors.append(str(e))
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("kind"), pa.array(contents, pa.string()), pa.array(errors, pa.string())], ["path", "kind", "content", "read_error"])


def read_files(spark: SparkSession, paths: list[str], base: str, partitions: int | None = None) -> DataFrame:
    """The files, read on the executors, which must see them under the same paths."""
    rows = [(p, normalise(p, base)) for p in paths]
    listed = spark.createDataFrame(rows, "file string, path string")
    if partitions:
        listed = listed.repartition(partitions)
    return listed.withColumn("kind", kind_of(F.col("path"))).mapInArrow(_read, SOURCES)


def from_table(table: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """A table's text column as sources; binary content is decoded, what isn't UTF-8 is unreadable. A null content too."""
    p, c = F.col(path).cast("string"), F.col(content)
    if dict(table.dtypes)[content] == "binary":
        good = F.is_valid_utf8(c.cast("string"))
        c = F.when(good, c.cast("string"))
    error = F.when(c.isNull(), "the content isn't UTF-8 text")
    return table.select(p.alias("path"), kind_of(p).alias("kind"), c.alias("content"), error.alias("read_error"))


def include(sources: DataFrame, contract: Contract) -> DataFrame:
    """The sources of a table that the contract's globs include and don't exclude."""
    from functools import reduce

    from ..functions.wildcards import path_match

    path = F.col("path")
    some = lambda ps: reduce(lambda a, b: a | b, (path_match(path, p) for p in ps), F.lit(False))
    return sources.where(some(contract.scan.include) & ~some(contract.scan.exclude))


__all__ = ["FILE_NAME", "collect_files", "excluded", "from_table", "include", "kind_of", "normalise", "read_files", "resolve_targets", "scan_folder", "scan_root"]
