"""A directory kept at a manifest's state."""

from __future__ import annotations

import datetime as dt
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.operators.trees import STATE_FILES, reconcile
from stemma.operators.versions import diff
from stemma.sources.codec import decode, dumps
from stemma.sources.scan import scan, scan_and_store
from stemma.sources.store import BlobStore


class Workspace:
    """checkout, snapshot, reset and diff of one directory; its state lies in two dot files inside."""

    def __init__(self, spark: SparkSession, folder: str, store: BlobStore | None = None):
        self.spark, self.folder, self.store = spark, os.path.abspath(folder), store
        os.makedirs(self.folder, exist_ok=True)
        self.state_file, self.manifest_file = (os.path.join(self.folder, f) for f in STATE_FILES)
        try:
            with open(self.state_file) as f:
                self.state = dict(json.load(f))
        except (OSError, ValueError, TypeError):
            self.state = {}  # absent or unreadable state starts anew

    def current(self) -> DataFrame | None:
        """Rows of the manifest checked out last."""
        if not os.path.exists(self.manifest_file):
            return None
        with open(self.manifest_file) as f:
            return decode(self.spark.createDataFrame([("current", f.read())], "manifest_id string, text string"))

    def _remember(self, entries: DataFrame) -> None:
        text = dumps(entries)
        tmp = self.manifest_file + ".part"
        with open(tmp, "w") as f:
            f.write(text)
        os.replace(tmp, self.manifest_file)
        now = dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")
        self.state = {"created": self.state.get("created", now), "last_checkout": now}
        with open(self.state_file + ".part", "w") as f:
            json.dump(self.state, f)
        os.replace(self.state_file + ".part", self.state_file)

    def checkout(self, entries: DataFrame, dry_run: bool = False) -> dict:
        _, counters = reconcile(self.spark, entries, self.folder, self.store, dry_run)
        if not dry_run:
            self._remember(entries)
        return counters

    def snapshot(self, store_content: bool = True) -> DataFrame:
        """Manifest of the directory as it is; its contents go to the store."""
        if store_content and self.store:
            return scan_and_store(self.spark, self.folder, self.store, "current")
        return scan(self.spark, self.folder, manifest_id="current")

    def reset(self) -> dict:
        entries = self.current()
        if entries is None:
            raise RuntimeError("nothing is checked out")
        return self.checkout(entries)

    def changes(self) -> DataFrame:
        """diff() of the manifest checked out and the directory as it is."""
        before = self.current()
        now = scan(self.spark, self.folder, manifest_id="current")
        return diff(now.where(F.lit(False)) if before is None else before, now).where("status <> 'same'")

    def status(self) -> dict:
        return {"folder": self.folder, "manifest": self.manifest_file if os.path.exists(self.manifest_file) else None, **{k: self.state.get(k) for k in ("created", "last_checkout")}, "store": self.store.folder if self.store else None}
