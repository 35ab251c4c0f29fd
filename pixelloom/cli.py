"""Command line: ``python -m pixelloom.cli [--db FOLDER] COMMAND ...``."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import functions as F

from pixelloom import session
from pixelloom.operators import duplicates
from pixelloom.service import Service
from pixelloom.sinks.store import Store


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pixelloom")
    p.add_argument("--db", default="catalogue", help="folder of the catalogue")
    p.add_argument("--master", default="local[*]")
    c = p.add_subparsers(dest="command", required=True)
    c.add_parser("index").add_argument("folder")
    c.add_parser("dupes")
    near = c.add_parser("near-dupes")
    near.add_argument("--k", type=int, default=5)
    near.add_argument("--method", default="bands")
    o = c.add_parser("organize")
    o.add_argument("target")
    o.add_argument("--apply", action="store_true")
    o.add_argument("--copy", action="store_true")
    c.add_parser("classify")
    c.add_parser("accuracy").add_argument("labels")
    c.add_parser("undo").add_argument("--count", type=int, default=1)
    c.add_parser("status")
    s = c.add_parser("skip")
    s.add_argument("action", choices=("add", "remove", "list"))
    s.add_argument("path", nargs="?")
    return p


def _print_report(report, members) -> None:
    """A report's totals, and its groups with their members, a partition at a time."""
    t = duplicates.reclaimable(report).first()
    print(f"{t['groups']} groups, {t['wasted_bytes'] / 1_048_576:.1f} MB reclaimable")
    rows = duplicates.ranked_members(members).join(report.select("group_id", "n_files", "wasted_bytes"), "group_id")
    last = None
    for r in rows.orderBy(F.desc("wasted_bytes"), "group_id", "rank").toLocalIterator():
        if r["group_id"] != last:
            last = r["group_id"]
            print(f"group {last}: {r['n_files']} files, {r['wasted_bytes'] / 1_048_576:.1f} MB")
        print(f"  {r['path']} ({(r['size'] or 0) / 1_048_576:.1f} MB)")


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    began = time.time()
    service = Service(Store(session.build_session(a.master), a.db))
    if a.command == "index":
        print(" ".join(f"{k}={v}" for k, v in service.scan_dir(a.folder).items()))
    elif a.command == "dupes":
        _print_report(*service.exact_dupes())
    elif a.command == "near-dupes":
        _print_report(*service.near_dupes(a.k, a.method))
    elif a.command == "organize":
        if a.apply:
            print(service.organize(a.target, a.copy))
        else:
            for r in service.organize_plan(a.target).orderBy("src").toLocalIterator():
                print(f"{r['src']} -> {r['dst']}")
    elif a.command == "classify":
        print(service.run_classifier())
    elif a.command == "accuracy":
        print(service.accuracy(a.labels))
    elif a.command == "undo":
        print(service.undo_moves(a.count))
    elif a.command == "status":
        print(service.status())
        for r in service.scan_roots().collect():
            print(r.asDict())
    else:
        if a.action != "list" and not a.path:
            print("a path is needed", file=sys.stderr)
            return 2
        if a.action == "add":
            service.add_skip_dir(a.path)
        elif a.action == "remove":
            service.remove_skip_dir(a.path)
        for r in service.skip_dirs().collect():
            print(r["path"])
    print(f"{time.time() - began:.1f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
