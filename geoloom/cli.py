"""Commands over an archive whose relations are Parquet folders under one path: python -m geoloom.cli --root PATH COMMAND."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone
from importlib import import_module
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.api import Archive
from geoloom.operators import grid
from geoloom.sources import adapters, storage

# The relations of an archive, with the columns that a new one begins with.
RELATIONS = {
    "scenes": "id bigint, scene_uid string, platform string, aoi_id string, status string, acquired_at timestamp",
    "observations": "id bigint, scene_id bigint, aoi_id string, acquired_at timestamp",
    "jobs": "id bigint, kind string, status string, priority int, dedupe_key string, attempts int, heartbeat_at timestamp, locked_by string, scene_id bigint, observation_id bigint, aoi_id string",
    "quarantine": "id bigint, original_name string, reason_code string, reasons array<string>, released boolean",
    "audit_log": "seq bigint, payload string, prev_hash string, record_hash string",
    "change_events": "id bigint, aoi_id string, change_type string, machine_state string, confidence double",
}


def archive(spark: SparkSession, root: str) -> Archive:
    found = {}
    for name, schema in RELATIONS.items():
        if (Path(root) / name).exists():
            found[name] = spark.read.schema(schema).parquet(f"{root}/{name}")
        else:
            found[name] = spark.createDataFrame([], schema)
    return Archive(found)


def replace(df: DataFrame, root: str, name: str) -> None:
    """Write a relation beside the old one, then put it in its place."""
    new = Path(root) / f".{name}.new"
    df.write.mode("overwrite").parquet(str(new))
    old = Path(root) / name
    if old.exists():
        old.rename(Path(root) / f".{name}.old")
    new.rename(old)
    storage.shutil.rmtree(Path(root) / f".{name}.old", ignore_errors=True)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="geoloom")
    parser.add_argument("--root", required=True)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("db-init", "aoi-sync", "jobs", "quarantine", "audit-verify", "status"):
        commands.add_parser(name)
    commands.add_parser("ingest").add_argument("folder")
    worker = commands.add_parser("worker")
    worker.add_argument("--max-jobs", type=int, default=1)
    worker.add_argument("--handlers", help="module:attribute of a mapping from kinds of jobs to functions of a job; jobs of other kinds are left alone")
    commands.add_parser("reset-archive").add_argument("--yes", action="store_true")
    a = parser.parse_args(arguments)
    if spark is None:
        from geoloom.session import local_session

        spark = local_session()
    own = archive(spark, a.root)
    show = lambda df: [print(x) for x in df.limit(1000).toJSON().collect()]  # noqa: E731 - a listing for people
    if a.command == "db-init":
        for name in RELATIONS:
            if not (Path(a.root) / name).exists():
                replace(own[name], a.root, name)
    elif a.command == "aoi-sync":
        replace(grid.grids(grid.areas(spark)), a.root, "aois")
        replace(grid.tiles(grid.grids(grid.areas(spark))), a.root, "grid_tiles")
    elif a.command in ("jobs", "quarantine"):
        show(own[a.command].orderBy("id"))
    elif a.command == "status":
        show(own.system_status())
    elif a.command == "ingest":
        show(adapters.candidates(spark, a.folder).withColumn("adapter", adapters.adapter(F.col("path"))))
    elif a.command == "worker":
        if own.next_job().first() is None:
            return 0
        if not a.handlers:
            print("refusing without --handlers: a worker without handlers would fail every job")
            return 1
        module, _, attribute = a.handlers.partition(":")
        handlers = getattr(import_module(module), attribute or "HANDLERS")
        for _ in range(a.max_jobs):
            now = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
            if own.next_job(list(handlers)).first() is None:
                break
            jobs, scenes, error = own.run_one(handlers, now, kinds=list(handlers))
            if error is not None:
                print(json.dumps({"error": error}))
            replace(jobs, a.root, "jobs")
            replace(scenes, a.root, "scenes")
            own = archive(spark, a.root)
    elif a.command == "reset-archive":
        if not a.yes:
            print("refusing without --yes")
            return 1
        storage.wipe(Path(a.root), list(RELATIONS), sure=True)
    elif a.command == "audit-verify":
        state = own.verify_audit().first()
        print(json.dumps(state.asDict()))
        return 2 if state.first_bad is not None else 0
    return 0


if __name__ == "__main__":
    sys.exit(main())
