"""Comparison and accounting of recorded model responses, and fixture bookkeeping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drift(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """(keys..., status): new entries, and entries whose response differs. Entries that
    are gone are not reported."""
    o = old.select(*keys, F.col("response").alias("before"), F.lit(True).alias("had"))
    j = new.join(o, list(keys), "left")
    status = F.when(F.col("had").isNull(), "new_entry").when(~F.col("response").eqNullSafe(F.col("before")), "diff")
    return j.select(*keys, status.alias("status")).where("status is not null")


def ablation(a: DataFrame, b: DataFrame, key: str, fields: list[str], least: float = 0.02) -> DataFrame:
    """Share of common keys for which any field differs, and per field; below `least`
    the ablated part has no effect."""
    j = a.alias("a").join(b.alias("b"), key)
    same = {f: F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")) for f in fields}
    all_same = F.lit(True)
    for s in same.values():
        all_same = all_same & s
    r = j.agg(F.count("*").alias("n"), F.count_if(~all_same).alias("diverged"), *(F.count_if(~s).alias(f"{f}_differs") for f, s in same.items()))
    share = F.col("diverged") / F.nullif("n", F.lit(0))
    return r.withColumn("share", share).withColumn("no_effect", F.col("share") < least)


def replay(requests: DataFrame, cassette: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Requests with their recorded response; without one, `hit` is false, or the query
    fails if strict. One response per key is taken (the greatest), so requests never multiply."""
    c = cassette.groupBy(key).agg(F.max("response").alias("response"), F.lit(True).alias("hit"))
    r = requests.join(c, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return r.where(F.assert_true("hit", "no recorded response").isNull()) if strict else r


def usage(calls: DataFrame) -> DataFrame:
    return calls.groupBy("agent").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"))


def deep_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, field, change): fields added, removed or changed between two maps of text."""
    one = lambda d, name: d.select(key, F.explode("fields").alias("field", name)).withColumn(f"has_{name}", F.lit(True))
    j = one(a, "x").join(one(b, "y"), [key, "field"], "full")
    change = F.when(F.col("has_x").isNull(), "added").when(F.col("has_y").isNull(), "removed").when(~F.col("x").eqNullSafe(F.col("y")), "changed")
    return j.select(key, "field", change.alias("change")).where("change is not null")


DIFF = "array<struct<path:string,kind:string,a:string,b:string>>"


def nested_diff(a: object, b: object, path: str = "") -> list[dict]:
    """Differences of two parsed JSON values, keys in order: `type`, `added`, `removed`,
    `list_len` (then the common items are compared) and `value`, with what stood on both
    sides, cut to 100 characters."""
    show = lambda v: repr(v)[:100]
    here = path or "/"
    if type(a) is not type(b):
        return [{"path": here, "kind": "type", "a": show(a), "b": show(b)}]
    out: list[dict] = []
    if isinstance(a, dict):
        for k in sorted(a.keys() | b.keys()):
            if k in a and k in b:
                out += nested_diff(a[k], b[k], f"{path}/{k}")
            else:
                out.append({"path": f"{path}/{k}", "kind": "removed" if k in a else "added", "a": show(a[k]) if k in a else None, "b": show(b[k]) if k in b else None})
    elif isinstance(a, list):
        if len(a) != len(b):
            out.append({"path": here, "kind": "list_len", "a": str(len(a)), "b": str(len(b))})
        for i in range(min(len(a), len(b))):
            out += nested_diff(a[i], b[i], f"{path}[{i}]")
    elif a != b:
        out.append({"path": here, "kind": "value", "a": show(a), "b": show(b)})
    return out


def response_diff(rows: DataFrame, a: str, b: str) -> DataFrame:
    """rows with `diffs`: the differences of two response texts, nested if both are JSON, else
    one of kind `text` with the lengths if they differ. Null counts as an empty text."""
    import json

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p: str | None, q: str | None) -> list[dict]:
            try:
                return nested_diff(json.loads(p), json.loads(q))
            except (TypeError, ValueError):
                return [] if (p or "") == (q or "") else [{"path": "/", "kind": "text", "a": str(len(p or "")), "b": str(len(q or ""))}]

        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)])

    return rows.withColumn("diffs", F.pandas_udf(run, DIFF)(F.col(a), F.col(b)))


def with_model(rows: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Rows through an injected model or extractor call, one data frame per Arrow batch.
    The default elsewhere is replay(); nothing here opens a network connection."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield call(b)

    return rows.mapInPandas(run, schema)


def fresh(eligible: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    return eligible.join(accepted.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def accept(pending: DataFrame, audit: DataFrame, key: str) -> DataFrame:
    return audit.join(pending.select(key).distinct(), key, "left_semi")


def accepted_rows(pending: DataFrame, audit: DataFrame, accepted: DataFrame, key: str, now: int) -> DataFrame:
    """What an approval appends: the audit rows of the proposals (key, expires_at) that have
    not expired at `now`, without those accepted before, so that a repeated approval appends
    nothing. An expiry equal to now still holds."""
    live = pending.where(F.col("expires_at") >= now)
    return fresh(accept(live, audit, key), accepted, key)


def rollback(rows: DataFrame, key: str, value: str) -> DataFrame:
    """All rows but those of one harvest; rows without the key stay."""
    return rows.where(F.col(key).isNull() | (F.col(key) != value))


def similarity(rows: DataFrame, a: str, b: str, name: str = "similarity") -> DataFrame:
    """Ratio of matching blocks of two texts."""

    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y, strict=True)])

    return rows.withColumn(name, F.pandas_udf(ratio, "double")(F.col(a), F.col(b)))


def request_key(agent: str, model: str, prompt: str, temperature: float) -> str:
    """First 16 hex digits of the digest of a request in canonical JSON."""
    import hashlib
    import json

    body = json.dumps({"agent": agent, "model": model, "prompt": prompt, "temperature": temperature}, sort_keys=True, ensure_ascii=False)
    return hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest()[:16]


def with_keys(requests: DataFrame) -> DataFrame:
    """requests (agent, model, prompt, temperature, ...) with their key."""

    def keys(agent: pd.Series, model: pd.Series, prompt: pd.Series, temperature: pd.Series) -> pd.Series:
        return pd.Series([request_key(*r) for r in zip(agent, model, prompt, temperature, strict=True)])

    return requests.withColumn("prompt_hash", F.pandas_udf(keys, "string")("agent", "model", "prompt", "temperature"))
