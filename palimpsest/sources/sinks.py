"""Sinks: report tables and files that never overwrite, packages and cleaned copies, summaries, small JSON stores."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.keywords import DEFAULT_WORDS, KeywordError, read_profile


def write_report(df: DataFrame, path: str) -> None:
    """JSON lines; an existing path is an error."""
    df.write.mode("errorifexists").json(path)


def write_table(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("errorifexists").partitionBy(*partitions).parquet(path)


def cleaned_name(source: Column) -> Column:
    """stem.cleaned.suffix."""
    return F.regexp_replace(source, r"(\.[^./]+)$", ".cleaned$1")


def summary(findings: Column, status: Column, match_count: Column) -> Column:
    """A document's report as text: one line a finding (location, category, context)."""
    lines = F.transform(findings, lambda f: F.concat_ws(" | ", f["location"], f["category"], f["context"]))
    return F.concat_ws("\n", F.concat(F.lit("status: "), status), F.concat(F.lit("matches: "), match_count.cast("string")), F.array_join(lines, "\n"))


def write_files(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Binary rows as files of a folder that all executors share; none is overwritten, a failed one leaves nothing.

    Returns (name, error). Object stores and HDFS take ``write_table`` instead."""
    root = folder.removeprefix("file://")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            names, errors = b.column(0).to_pylist(), []
            for n, raw in zip(names, b.column(1).to_pylist(), strict=True):
                try:
                    exclusive(Path(root) / n, raw)
                    errors.append(None)
                except OSError as error:
                    errors.append(str(error))
            yield pa.record_batch([b.column(0), pa.array(errors, pa.string())], names=["name", "error"])

    return df.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content")).mapInArrow(run, "name string, error string")


def exclusive(path: Path, raw: bytes) -> None:
    """Whole or not at all, and never over an existing file: written beside and linked into place."""
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    try:
        part.write_bytes(raw)
        os.link(part, path)
    finally:
        part.unlink(missing_ok=True)


def atomic_json(path: Path, data: object) -> None:
    """Replaces a JSON file: the old or the new one is there at any time."""
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, part = tempfile.mkstemp(dir=path.parent)
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump(data, f, ensure_ascii=False, indent=2)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    except BaseException:
        Path(part).unlink(missing_ok=True)
        raise


class ProfileStore:
    """Keyword profiles in a folder of the driver, one JSON file each, and which of them is used at the start."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)

    def path(self, identifier: str) -> Path:
        if len(identifier) != 32 or any(c not in "0123456789abcdef" for c in identifier):
            raise KeywordError("a profile's id is 32 hex digits")
        return self.folder / f"{identifier}.json"

    def save(self, profile: dict, identifier: str | None = None) -> str:
        checked = read_profile(json.dumps(profile).encode())
        identifier = identifier or uuid.uuid4().hex
        atomic_json(self.path(identifier), checked)
        return identifier

    def load(self, identifier: str) -> dict:
        return read_profile(self.path(identifier).read_bytes())

    def list(self) -> tuple[dict[str, dict], int]:
        """Profiles by id, and how many files are not valid."""
        found, bad = {}, 0
        for p in sorted(self.folder.glob("*.json")):
            if p.name == "settings.json":
                continue
            try:
                found[p.stem] = self.load(p.stem)
            except (KeywordError, OSError):
                bad += 1
        return found, bad

    def set_startup(self, identifier: str | None) -> None:
        if identifier is not None:
            self.load(identifier)
        atomic_json(self.folder / "settings.json", {"schema_version": 1, "startup_profile": identifier})

    def startup_words(self) -> list[str]:
        """The chosen profile's words; the defaults where none is chosen or it is not valid any more."""
        try:
            settings = json.loads((self.folder / "settings.json").read_text("utf-8"))
            return self.load(settings["startup_profile"])["keywords"]
        except (OSError, ValueError, KeyError, TypeError, AttributeError):
            return list(DEFAULT_WORDS)
