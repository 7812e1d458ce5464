"""Command line: generate events, extract and check a dataset, run the batch pipeline and the streams, watch and export.

    python -m souk generate-deliveries --orders 1000 --output DIR
    python -m souk generate-clicks --users 1000 --output DIR
    python -m souk publish --input DIR --topic T --key order_id (--servers S | --folder DIR)
    python -m souk extract --archive ZIP --output DIR
    python -m souk batch --landing DIR --store DIR --run-id R --salt S --output FILE
    python -m souk stream --store DIR --checkpoints DIR --run-id R (--servers S | --folder DIR) [--mode continuous]
    python -m souk health --store DIR --run-id R [--fail-on-critical]
    python -m souk export --store DIR --salt S --output FILE
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from souk.session import session
from souk.settings import load
from souk.sources import files, generate
from souk.sources.contracts import CLICK_EVENT, DELIVERY_EVENT


def main(argv: list[str] | None = None) -> int:
    settings = load()
    parser = argparse.ArgumentParser(prog="souk", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    d = commands.add_parser("generate-deliveries")
    how_many = d.add_mutually_exclusive_group()
    how_many.add_argument("--orders", type=int, default=settings.generator.order_count)
    how_many.add_argument("--orders-csv", help="a file of existing ids in a column order_id")
    d.add_argument("--duplicate-rate", type=float, default=settings.generator.duplicate_rate)
    d.add_argument("--late-event-rate", type=float, default=settings.generator.late_event_rate)
    c = commands.add_parser("generate-clicks")
    c.add_argument("--users", type=int, default=settings.generator.order_count)
    for p in (d, c):
        p.add_argument("--seed", type=int, default=settings.generator.seed)
        p.add_argument("--base-time", default="2026-01-01 00:00:00")
        p.add_argument("--partitions", type=int, default=8)
        p.add_argument("--output", required=True)
    u = commands.add_parser("publish")
    u.add_argument("--input", required=True)
    u.add_argument("--topic", required=True)
    u.add_argument("--key", choices=("order_id", "user_id"), required=True)
    u.add_argument("--servers")
    u.add_argument("--folder")
    x = commands.add_parser("extract")
    x.add_argument("--archive", required=True)
    x.add_argument("--output", required=True)
    b = commands.add_parser("batch")
    for name in ("landing", "store", "run-id", "salt", "output"):
        b.add_argument(f"--{name}", required=True)
    t = commands.add_parser("stream")
    for name in ("store", "checkpoints", "run-id"):
        t.add_argument(f"--{name}", required=True)
    where = t.add_mutually_exclusive_group(required=True)
    where.add_argument("--servers")
    where.add_argument("--folder", help="with a folder of envelopes for each topic")
    t.add_argument("--mode", choices=("available_now", "continuous"), default="available_now")
    t.add_argument("--within", help="how far apart copies of an event are known, as '7 DAYS'; without it, however far")
    h = commands.add_parser("health")
    h.add_argument("--store", required=True)
    h.add_argument("--run-id", required=True)
    h.add_argument("--fail-on-critical", action="store_true")
    e = commands.add_parser("export")
    for name in ("store", "salt", "output"):
        e.add_argument(f"--{name}", required=True)
    a = parser.parse_args(argv)
    if a.command == "extract":
        files.extract(a.archive, a.output)
        m = files.manifest(a.output)
        (Path(a.output) / "_manifest.json").write_text(json.dumps(m, indent=2), encoding="utf-8")
        print(json.dumps(files.manifest_hashes(m)))
        return 0
    spark = session()
    if a.command == "generate-deliveries":
        files.write_events(generate.delivery_events(spark, files.order_ids(spark, a.orders_csv) if a.orders_csv else a.orders, a.seed, a.base_time, a.partitions, a.duplicate_rate, a.late_event_rate), a.output, a.partitions)
    elif a.command == "generate-clicks":
        files.write_events(generate.click_events(spark, a.users, a.seed, a.base_time, a.partitions), a.output, a.partitions)
    elif a.command == "publish":
        files.publish(spark.read.schema(DELIVERY_EVENT if a.key == "order_id" else CLICK_EVENT).json(a.input), a.topic, a.key, a.servers, a.folder)
    else:
        from souk.operators import health
        from souk.plans import batch
        from souk.sources.store import TableStore
        from souk.streaming import events

        store = TableStore(spark, a.store)
        if a.command == "stream":
            parsers = {"delivery_events": events.parse_delivery, "clickstream_events": events.parse_clicks}
            streams = {n: (files.kafka_stream(spark, a.servers, n) if a.servers else files.file_stream(spark, f"{a.folder}/{n}"), p) for n, p in parsers.items()}
            print(events.supervise(store, streams, a.checkpoints, a.run_id, a.mode, within=a.within))
        elif a.command == "health":
            limits = settings.streaming.max_heartbeat_minutes, settings.quality.max_quarantine_rate
            print(json.dumps(health.observe(store, a.run_id, ["quarantine_delivery_events", "quarantine_clickstream_events"], None, 24, *limits, a.fail_on_critical)))
        elif a.command == "export":
            batch.export(store, a.salt, a.output)
        else:
            batch.run(spark, store, a.landing, a.run_id, a.salt, settings, output=a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
