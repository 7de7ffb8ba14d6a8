"""Bar files that are not what their names say: found by their median step, moved aside by the file system's own rename."""

from __future__ import annotations

import posixpath

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.bars import median_step, suffix_minutes
from tidemark.sources.bars import _located, exists, inventory, load

ASIDE = "_invalid"
CHECK = "asset string, suffix string, fmt string, path string, ok boolean, median_sec double, reason string"
MANIFEST = "asset string, path string, target string, state string"


def _checked(spark: SparkSession, asset: str, suffix: str, path: str) -> tuple[bool, float | None, str]:
    expected = suffix_minutes(suffix) * 60
    try:
        bars = load(spark, path).withColumn("symbol", F.lit(asset))
        rows = median_step(bars, expected).collect()  # one row
    except Exception as error:  # noqa: BLE001  a file that can't be read is what is looked for
        return False, None, f"error: {type(error).__name__}: {error}"[:300]
    if not rows or rows[0].median_sec is None:
        return False, None, "no median step"
    median = rows[0].median_sec
    return rows[0].ok, median, "ok" if rows[0].ok else f"median step {median:.0f} s, not {expected} s"


def check_files(spark: SparkSession, root: str, assets: list[str], suffixes: list[str]) -> DataFrame:
    """Every present file of the inventory: whether its median step is that of its name, within a fifth, and why not."""
    present = inventory(spark, root, assets, suffixes).where("present").collect()  # assets times timeframes times formats
    rows = [(r.asset, r.suffix, r.fmt, r.path, *_checked(spark, r.asset, r.suffix, r.path)) for r in present]
    return spark.createDataFrame(rows, CHECK)


def _free(where: fs.FileSystem, folder: str, name: str) -> str:
    """``name`` in ``folder``, with the first free number from 2 on where it is taken."""
    stem, ext = posixpath.splitext(name)
    n, target = 1, posixpath.join(folder, name)
    while where.get_file_info(target).type != fs.FileType.NotFound:
        n += 1
        target = posixpath.join(folder, f"{stem}__{n}{ext}")
    return target


def quarantine(spark: SparkSession, checked: DataFrame, root: str) -> DataFrame:
    """Move the files of ``checked`` that are not ok to ``root``/_invalid/ASSET; a manifest of what became of each.

    Never overwrites: a name that is taken gets a number. A file that has gone meanwhile, as it has when this is
    repeated, is reported as "gone" and moves nothing.
    """
    rows = []
    for r in checked.where("not ok").select("asset", "path").collect():
        if not exists(r.path):
            rows.append((r.asset, r.path, None, "gone"))
            continue
        where, name = _located(r.path)
        folder = posixpath.join(_located(root)[1], ASIDE, r.asset)
        where.create_dir(folder, recursive=True)
        target = _free(where, folder, posixpath.basename(name))
        where.move(name, target)
        rows.append((r.asset, r.path, target, "moved"))
    return spark.createDataFrame(rows, MANIFEST)
