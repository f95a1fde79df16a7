"""Command line: id, diff, verify, cat, version."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stemma import __version__


def _spark() -> SparkSession:
    spark = SparkSession.builder.appName("stemma").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _manifest(spark: SparkSession, path: str):
    """Rows of a manifest file, or of a directory's scan."""
    from stemma.sources.codec import decode
    from stemma.sources.scan import scan

    if os.path.isdir(path):
        return scan(spark, path, manifest_id="_")
    with open(path, encoding="utf-8") as f:
        return decode(spark.createDataFrame([("_", f.read())], "manifest_id string, text string"))


def cmd_id(args) -> int:
    from stemma.functions.base58 import id_text
    from stemma.operators.rollup import manifest_ids
    from stemma.sources.codec import dumps
    from stemma.sources.scan import digest_of_file, scan

    if not os.path.exists(args.path):
        print(f"{args.path}: not found", file=sys.stderr)
        return 1
    if not os.path.isdir(args.path):
        print(id_text(digest_of_file(args.path)))
        return 0
    rows = scan(_spark(), args.path, manifest_id="_")
    print(id_text(bytes(manifest_ids(rows).first().digest)) if args.id else dumps(rows), end="\n" if args.id else "")
    return 0


def cmd_diff(args) -> int:
    from stemma.operators.versions import diff

    if missing := [p for p in (args.old, args.new) if not os.path.exists(p)]:
        print(f"{missing[0]}: not found", file=sys.stderr)
        return 1
    spark = _spark()
    changes = diff(_manifest(spark, args.old), _manifest(spark, args.new)).where("status <> 'same'").orderBy("path")
    for r in changes.select("status", "path").toLocalIterator():
        print({"added": "+", "removed": "-", "modified": "~"}[r.status], r.path)
    return 0


def cmd_verify(args) -> int:
    from stemma.operators.trees import verify_tree

    if missing := [p for p in (args.manifest, args.folder) if not os.path.exists(p)]:
        print(f"{missing[0]}: not found", file=sys.stderr)
        return 1
    spark = _spark()
    bad = 0
    for r in verify_tree(spark, _manifest(spark, args.manifest), args.folder).where("status <> 'ok'").orderBy("status", "path").toLocalIterator():
        print(r.status, r.path)
        bad = 1
    return bad


def cmd_cat(args) -> int:
    from stemma.functions.base58 import parse_id
    from stemma.sources.store import ContentNotFound, open_store

    try:
        sys.stdout.buffer.write(open_store(_spark(), args.store).get_one(parse_id(args.id)))
    except (ContentNotFound, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="stemma", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("id", help="ID of a file; manifest or, with -i, ID of a directory")
    p.add_argument("path")
    p.add_argument("-i", "--id", action="store_true")
    p.set_defaults(run=cmd_id)
    p = sub.add_parser("diff", help="what differs between two manifests or directories")
    p.add_argument("old")
    p.add_argument("new")
    p.set_defaults(run=cmd_diff)
    p = sub.add_parser("verify", help="a directory against a manifest; exit status 1 if it differs")
    p.add_argument("manifest")
    p.add_argument("folder")
    p.set_defaults(run=cmd_verify)
    p = sub.add_parser("cat", help="content of an ID from the store")
    p.add_argument("id")
    p.add_argument("--store")
    p.set_defaults(run=cmd_cat)
    p = sub.add_parser("version")
    p.set_defaults(run=lambda _: print(__version__) or 0)
    args = parser.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
