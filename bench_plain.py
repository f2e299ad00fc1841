"""
queries over the same parquet, as one would write them without an engine. Prints one
JSON line like bench.py; reading the parquet is part of each time, as it is there."""

from __future__ import annotations

import json
import math
import os
import re
import time
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone

import pyarrow.parquet as pq

from quillspark.functions import scrub

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)


def read(table: str, *columns: str) -> list[dict]:
    return pq.read_table(f"{SF}/{table}.parquet", columns=list(columns)).to_pylist()


def rank(values: list, q: float):
    return sorted(values)[max(0, math.ceil(q * len(values)) - 1)] if values else 0


def pipeline_stats() -> int:
    total, stages, kinds, blocked, raised = [], defaultdict(list), Counter(), 0, 0
    for r in read("pipeline_record", "ts", "duration_ms", "blocked_reason", "escalated", "target_kind", "stage_latency_ms"):
        try:
            if datetime.fromisoformat((r["ts"] or "").replace("Z", "+00:00")) < NOW - timedelta(days=7):
                continue
        except ValueError:
            continue
        if (r["duration_ms"] or -1) >= 0:
            total.append(int(r["duration_ms"]))
        for k, v in r["stage_latency_ms"] or []:
            if v is not None and v >= 0:
                stages[k].append(int(v))
        blocked += bool(r["blocked_reason"])
        raised += bool(r["escalated"])
        kinds[r["target_kind"]] += 1
    return len([rank(x, q) for x in (total, *stages.values()) for q in (0.5, 0.95, 0.99)]) + len(kinds)


def tag_peers_topk() -> int:
    newest: dict = {}
    for r in read("index_entry", "slug", "entry_id", "tags", "entry_date"):
        if r["tags"]:
            at = (r["entry_date"] is not None, r["entry_date"], r["entry_id"])
            if r["slug"] not in newest or newest[r["slug"]][0] < at:
                newest[r["slug"]] = (at, r["entry_id"], {t for t in r["tags"] if t is not None})
    return sum(len(sorted(((-len(t & u), s) for s, (_, _, u) in newest.items() if s != slug and t & u))[:5]) for slug, (_, i, t) in newest.items() if i % 100 == 0)


def scrub_chain() -> int:
    rules = [re.compile(p) for p in (scrub.EMAIL_RE, scrub.PHONE_RE, scrub.MONEY_RE, scrub.DATE_RE)]
    n = 0
    for r in read("extraction", "content"):
        if (t := r["content"]) is not None:
            for rule in rules:
                t = rule.sub("X", t)
            n += len(t)
    return n


def grep_fixed() -> int:
    return sum("lighthouse" in line for r in read("documents", "text") for line in (r["text"] or "").splitlines())


def mentions_per_day() -> int:
    c = Counter((r["slug"], r["received_at"].date()) for r in read("pipeline_record", "slug", "received_at") if r["slug"] and r["received_at"])
    days = [(NOW - timedelta(days=i)).date() for i in range(1, 31)]
    return sum(1 for s in {s for s, _ in c} for d in days if c[s, d] >= 0)


def p2_found() -> int:
    first: dict = {}
    n = 0
    for r in read("pipeline_record", "record_seq", "drop_id", "ts", "received_at"):
        try:
            key = (r["drop_id"].strip().lower(), datetime.fromisoformat(r["ts"].replace("Z", "+00:00")).astimezone(timezone.utc))
        except (AttributeError, ValueError):
            continue
        at = (r["received_at"], r["record_seq"])
        n += key in first
        first[key] = min(first.get(key, at), at)
    return n


def main() -> None:
    took = {}
    for f in (pipeline_stats, tag_peers_topk, scrub_chain, grep_fixed, mentions_per_day, p2_found):
        times = []
        for _ in range(5):
            began = time.perf_counter()
            f()
            times.append(time.perf_counter() - began)
        took[f.__name__] = round(sorted(times)[2], 3)
    print(json.dumps({"metric": "plain_python_median", "unit": "sec", "queries": took, "sf": SF}))


if __name__ == "__main__":
    main()
