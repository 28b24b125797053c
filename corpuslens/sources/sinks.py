"""Writers and manifests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from fnmatch import fnmatch
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_ordered_csv(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str], *, compression: str = "none") -> None:
    """CSV parts in a total order with a fixed column order; arrays joined by ``|``, nulls as empty."""
    kinds = dict(df.dtypes)
    cells = [F.concat_ws("|", F.col(c)).alias(c) if kinds[c].startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]
    df.orderBy(*order).select(*cells).write.mode("overwrite").options(header=True, compression=compression, emptyValue="").csv(path)


def content_hash(df: DataFrame) -> str:
    """A hash of the rows that no order and no partitioning changes."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    n, total = df.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)"))).first()
    return f"{n}:{total or 0}"


def manifest(inputs: dict[str, DataFrame], outputs: dict[str, DataFrame], config: dict) -> str:
    """JSON that links inputs, outputs (content hashes, row counts, columns) and the configuration."""
    side = lambda frames: {k: {"rows": v.count(), "columns": v.columns, "content": content_hash(v)} for k, v in sorted(frames.items())}
    return json.dumps({"config": config, "inputs": side(inputs), "outputs": side(outputs)}, sort_keys=True)


class RunLog:
    """A run's events as JSON lines and its state as one JSON file beside them; a stage whose output exists is not run again.

    For the driver's own small files: ``folder`` is a path that the driver can write.
    """

    def __init__(self, folder: str) -> None:
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)
        kept = self.folder / "state.json"
        self.state: dict = json.loads(kept.read_text()) if kept.exists() else {}

    def event(self, name: str, **values: object) -> None:
        with (self.folder / "events.jsonl").open("a", encoding="utf-8") as file:
            file.write(json.dumps({"event": name, **values}, sort_keys=True) + "\n")

    def keep(self, **values: object) -> None:
        """Replace the state in one step, so that a lost driver leaves the old one or the new one."""
        self.state |= values
        fresh = self.folder / "state.json.tmp"
        fresh.write_text(json.dumps(self.state, sort_keys=True), encoding="utf-8")
        fresh.replace(self.folder / "state.json")

    def stage(self, name: str, run: Callable[[], object]) -> bool:
        """Run a stage unless the state has it; whether it ran. A stage that fails is logged and raises."""
        if name in self.state.get("done", []):
            return False
        try:
            run()
        except Exception as error:
            self.event("failed", stage=name, error=str(error)[:500])
            raise
        self.keep(done=[*self.state.get("done", []), name])
        self.event("done", stage=name)
        return True


def publish(files: dict[str, bytes], folder: str, *, most_bytes: int, excluded: Sequence[str] = ()) -> dict:
    """Copy named files into a snapshot with a manifest of sizes and digests; excluded names are listed, a snapshot over ``most_bytes`` is an error."""
    taken = {name: data for name, data in sorted(files.items()) if not any(fnmatch(name, pattern) for pattern in excluded)}
    if sum(map(len, taken.values())) > most_bytes:
        raise ValueError(f"the snapshot is over {most_bytes} bytes")
    root = Path(folder)
    for name, data in taken.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    made = {"files": {name: {"bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()} for name, data in taken.items()}, "excluded": sorted(set(files) - set(taken))}
    (root / "manifest.json").write_text(json.dumps(made, indent=1, sort_keys=True), encoding="utf-8")
    return made
