"""A folder walked level by level, with what is ignored left out before it is listed.

Every level is one job: its folders are dealt to tasks, a task lists a folder and reads its ignore file, and the rules that
hold there, those of the folders above first, decide which entries go on. Folders that a rule leaves out are
never listed, however much they hold. Paths are those of stores that Arrow opens.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import always_ignored, folder_rules, included, rule_pattern
from .shared import staged

#: (name, is a folder, bytes) of what a folder holds, and the text of its ignore file or None.
Lister = Callable[[str, str], tuple[list[tuple[str, bool, int]], str | None]]
LEVEL = "path string, is_folder boolean, length bigint, rules array<string>"
#: Levels of folders at most, a guard against links that lead back.
DEEPEST = 64


def list_with_arrow(root: str, folder: str, ignore_file: str = ".gitignore") -> tuple[list[tuple[str, bool, int]], str | None]:
    from pyarrow import fs

    store, top = fs.FileSystem.from_uri(root)
    at = f"{top}/{folder}".rstrip("/")
    found = store.get_file_info(fs.FileSelector(at))
    text = None
    if any(f.base_name == ignore_file and f.is_file for f in found):
        with store.open_input_file(f"{at}/{ignore_file}") as f:
            text = f.read().decode("utf-8", "ignore")
    return [(f.base_name, f.type == fs.FileType.Directory, f.size or 0) for f in found], text


def walk(spark: SparkSession, root: str, ignore: list[str] | None = None, lister: Lister = list_with_arrow) -> DataFrame:
    """(path, is_folder, length) of the files below ``root`` that no rule leaves out, and of the folders that were listed."""
    always = re.compile(always_ignored())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for folder, rules in zip(pdf["path"], pdf["rules"]):
                entries, text = lister(root, folder)
                held = [*rules, *(folder_rules({folder: text.splitlines()}) if text else [])]
                patterns = [(no, re.compile(p)) for no, p in filter(None, map(rule_pattern, held))]
                rows = []
                for name, is_folder, length in entries:
                    path = f"{folder}/{name}" if folder else name
                    shown, out = path + "/" * is_folder, False
                    for negated, pattern in patterns:
                        if pattern.search(shown):
                            out = not negated
                    if not out and not always.search(shown):
                        rows.append((path, is_folder, length, held if is_folder else []))
                yield pd.DataFrame(rows, columns=["path", "is_folder", "length", "rules"])

    level = spark.createDataFrame([("", ignore or [])], "path string, rules array<string>")
    levels = []
    for _ in range(DEEPEST):
        found = staged(level.repartition(max(1, spark.sparkContext.defaultParallelism), "path").mapInPandas(run, LEVEL), "walk")
        levels.append(found)
        level = found.where("is_folder").select("path", "rules")
        if level.isEmpty():
            break
    every = levels[0]
    for found in levels[1:]:
        every = every.unionByName(found)
    return every.drop("rules")


def walk_files(spark: SparkSession, root: str, ignore: list[str] | None = None, include: list[str] | None = None, max_bytes: int = 2_000_000) -> DataFrame:
    """(path, length, content) of the files that `walk` finds, without large ones and those with NUL bytes; only
    these are opened."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(root)
        for pdf in batches:
            for path, length in zip(pdf["path"], pdf["length"]):
                with store.open_input_file(f"{top.rstrip('/')}/{path}") as f:
                    content = f.read()
                if b"\0" not in content:
                    yield pd.DataFrame({"path": [path], "length": [length], "content": [content]})

    found = walk(spark, root, ignore).where(~F.col("is_folder") & (F.col("length") <= max_bytes))
    if include:
        found = found.where(included(F.col("path"), include))
    return found.select("path", "length").mapInPandas(read, "path string, length bigint, content binary")
