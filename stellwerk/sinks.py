"""Files for people: CSV with a byte-order mark, replaced in one step; appends; rotated copies.

Spark sorts and writes the parts, in order; the driver strings them together piece by piece, whatever their size, and
renames. The target is a file of the machine where the user is; large exports for other programs are written as Parquet
by the plan that makes them and need none of this.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame

BOM = b"\xef\xbb\xbf"


def _parts(df: DataFrame, columns: Sequence[str], order: Sequence[str], folder: Path) -> list[Path]:
    rows = df.select(*columns).orderBy(*order) if order else df.select(*columns)
    stamp = "yyyy-MM-dd HH:mm:ss"
    rows.write.options(header=False, nullValue="", emptyValue="", escape='"', timestampFormat=stamp, timestampNTZFormat=stamp).csv(str(folder / "parts"))
    return sorted((folder / "parts").glob("part-*.csv"))


def write_csv(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str] = (), append: bool = False) -> int:
    """Write or append; the header and the mark stand once, at the start. Returns the number of lines written."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    lines = 0
    with tempfile.TemporaryDirectory(dir=target.parent) as scratch:
        parts = _parts(df, columns, order, Path(scratch))
        add = append and target.exists()
        whole = Path(scratch) / "whole"
        with target.open("ab") if add else whole.open("wb") as out:
            if not add:
                out.write(BOM + (",".join(columns) + "\n").encode())
            for part in parts:
                with part.open("rb") as f:
                    while piece := f.read(1 << 20):
                        lines += piece.count(b"\n")
                        out.write(piece)
        if not add:
            os.replace(whole, target)
    return lines


def back_up(files: Sequence[str], folder: str, stamp: str, keep: int = 5) -> list[str]:
    """Copy what exists into ``folder/stamp``; of the copies the newest ``keep`` stay. Returns what was copied."""
    to = Path(folder) / stamp
    to.mkdir(parents=True, exist_ok=True)
    done = []
    for f in files:
        if Path(f).is_file():
            shutil.copy2(f, to)
            done.append(Path(f).name)
    for old in sorted(p for p in Path(folder).iterdir() if p.is_dir())[:-keep]:
        shutil.rmtree(old)
    return done
