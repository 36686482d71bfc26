"""Folds whose next step depends on all before it. Rows of a key stream through one task in order; only the running state stays."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType
from pyspark.sql.window import Window as W


def _flagged(df: DataFrame, keys: list[str], order: list[str], flag: str, step) -> DataFrame:  # noqa: ANN001
    """df with a flag per row: step(state or None, row's columns) -> (flag, state), state None at each new key."""
    names = [c for c in df.columns if c not in keys]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for batch in batches:
            key_rows = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            rows = {c: batch.column(c).to_pylist() for c in names}
            out = []
            for i, k in enumerate(key_rows):
                if k != last:
                    last, state = k, None
                ok, state = step(state, {c: v[i] for c, v in rows.items()})
                out.append(ok)
            yield batch.append_column(flag, pa.array(out, pa.bool_()))

    ordered = df.repartition(n, *keys).sortWithinPartitions(*keys, *order)
    return ordered.mapInArrow(go, StructType([*df.schema, StructField(flag, BooleanType())]))


def admit_skipping(queue: DataFrame, cost: str, budget: int, key: str, order: str = "at") -> DataFrame:
    """Rows in order; one that would pass the key's budget is refused and takes nothing."""

    def step(used: int | None, row: dict) -> tuple[bool, int]:
        used = used or 0
        fits = used + row[cost] <= budget
        return fits, used + row[cost] if fits else used

    return _flagged(queue, [key], [order], "admitted", step)


def admit_budgets(queue: DataFrame, cost: str, budgets: dict[str, int], used: dict[str, int], order: str = "at") -> DataFrame:
    """One queue under several budgets, each with what is used of it: a row is admitted if it fits in all of them.

    A refused row takes nothing. With one queue this is one task; the rows stream through it.
    """
    left = {b: n - used.get(b, 0) for b, n in budgets.items()}
    tight = min(left.values())
    return admit_skipping(queue.withColumn("_queue", F.lit(0)), cost, tight, "_queue", order).drop("_queue")


def click_dedup(clicks: DataFrame, gap_ms: int) -> DataFrame:
    """Per key, an event within gap_ms of the last kept one is dropped. Expects key, at_ms and an id as tie-break.

    An event that comes gap_ms or more after the one before it is kept whatever was kept before: the chains between such
    events are folded apart from each other, so that a hot key's many chains are dealt over the tasks.
    """
    w = W.partitionBy("key").orderBy("at_ms", "id")
    new = F.coalesce(F.col("at_ms") - F.lag("at_ms").over(w) >= gap_ms, F.lit(True))
    chained = clicks.withColumn("_new", new).withColumn("_chain", F.sum(F.col("_new").cast("long")).over(w)).drop("_new")

    def step(last: int | None, row: dict) -> tuple[bool, int]:
        keep = last is None or row["at_ms"] - last >= gap_ms
        return keep, row["at_ms"] if keep else last

    return _flagged(chained, ["key", "_chain"], ["at_ms", "id"], "_keep", step).where("_keep").drop("_keep", "_chain")


class _Page:
    """Diverse pages over one ordered list. A step takes the first row that fits behind the one before, which is most often
    among the next few. Else, as rows of one kind (vendor, source, category, quality) can stand for each other, it looks at the
    first row of each kind that fits, not at all rows."""

    #: Rows that a step looks at one by one.
    LOOK = 64

    def __init__(self, kinds: list[tuple], vendor_cap: int, soft: int, source_caps: dict, adjacent: bool):
        self.kinds, self.vendor_cap, self.soft, self.source_caps, self.adjacent = kinds, vendor_cap, soft, source_caps, adjacent
        self.left: dict[tuple, list[int]] = {}
        for i, k in enumerate(kinds):
            self.left.setdefault(k, []).append(i)
        self.rest = sorted(i for v in self.left.values() for i in v)

    def take(self, size: int, fill: bool) -> list[int]:
        chosen: list[int] = []
        counts: list[dict] = [{}, {}, {}]
        for level in range(3):
            at = -1
            while len(chosen) < size:
                best, kind, ended = None, None, False
                start = bisect_right(self.rest, at)
                for i in self.rest[start : start + self.LOOK]:
                    if self._fits(self.kinds[i], level, counts, chosen):
                        best, kind = i, self.kinds[i]
                        break
                else:
                    ended = start + self.LOOK >= len(self.rest)
                if best is None and not ended:
                    for k, rows in self.left.items():
                        if not self._fits(k, level, counts, chosen):
                            continue
                        i = bisect_right(rows, at)
                        if i < len(rows) and (best is None or rows[i] < best):
                            best, kind = rows[i], k
                if best is None:
                    break
                at = best
                self._drop(best, kind)
                chosen.append(best)
                for c, v in zip(counts, kind, strict=False):
                    c[v] = c.get(v, 0) + 1
        while fill and len(chosen) < size and self.rest:  # what no rule admits follows in order
            best = self.rest[0]
            self._drop(best, self.kinds[best])
            chosen.append(best)
        return chosen

    def _fits(self, kind: tuple, level: int, counts: list[dict], chosen: list[int]) -> bool:
        vendor, source, category, quality = kind
        if vendor is not None and counts[0].get(vendor, 0) >= self.vendor_cap:
            return False
        if source in self.source_caps and counts[1].get(source, 0) >= self.source_caps[source]:
            return False
        if level < 2 and not self.adjacent and chosen and source is not None and self.kinds[chosen[-1]][1] == source:
            return False
        return level == 2 or counts[2].get(category, 0) < self.soft or (level == 1 and quality)

    def _drop(self, i: int, kind: tuple) -> None:
        rows = self.left[kind]
        rows.pop(bisect_right(rows, i) - 1)
        if not rows:
            del self.left[kind]
        self.rest.pop(bisect_right(self.rest, i) - 1)


def _timeline_order() -> list[Column]:
    return [F.desc(c) for c in ("published", "heat", "importance", "event_id")]


def diverse_timeline(events: DataFrame, size: int = 20, vendor_cap: int = 4, soft: int = 12, source_caps: dict | None = None) -> DataFrame:
    """(event_id, day, page, place): pages of each day, newest first. Hard vendor and source caps per page, no neighbours
    of one source, a category cap that rows of quality may pass; then without category and neighbour rules; what is left
    fills a page in order, so that nothing is lost.

    Expects event_id, day, published, heat, importance, source, vendor, category, quality. Days are dealt over tasks; a
    task holds the keys of one day, and its time grows with the day's rows times their kinds.
    """
    caps = dict(source_caps or {})
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = events.select("event_id", "day", "published", "heat", "importance", "vendor", "source", "category", F.coalesce("quality", F.lit(False)).alias("quality"))
    ordered = keys.repartition(n, "day").sortWithinPartitions("day", *_timeline_order()).select("event_id", "day", "vendor", "source", "category", "quality")

    def pages(day, ids: list, kinds: list[tuple]) -> pa.RecordBatch:  # noqa: ANN001
        p, out, page = _Page(kinds, vendor_cap, soft, caps, adjacent=False), [], 0
        while p.rest:
            out += [(ids[i], page, place) for place, i in enumerate(p.take(min(size, len(p.rest)), fill=True))]
            page += 1
        a, b, c = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([day] * len(a), pa.date32()), pa.array(b, pa.int32()), pa.array(c, pa.int32())], ["event_id", "day", "page", "place"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, kinds = None, [], []
        for batch in batches:
            for i, day, *kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and day != last:
                    yield pages(last, ids, kinds)
                    ids, kinds = [], []
                last = day
                ids.append(i)
                kinds.append(tuple(kind))
        if ids:
            yield pages(last, ids, kinds)

    return ordered.mapInArrow(go, "event_id long, day date, page int, place int")


def diverse_page(events: DataFrame, size: int = 20, vendor_cap: int = 4, soft: int = 12, source_caps: dict | None = None) -> DataFrame:
    """(event_id, place): the first page over all events. Neighbours of one source are allowed here, and rows over the
    vendor cap don't fill it.

    A row matters only if those before it of its category and quality are on the page, or its vendor or source is full.
    So a bounded number of rows of each category and quality holds the page; only these reach the one task.
    """
    caps = dict(source_caps or {})
    capped = F.when(F.col("source").isin(*caps), F.col("source")) if caps else F.lit(None).cast("string")
    rows = events.select("event_id", "published", "heat", "importance", "vendor", "source", "category", F.coalesce("quality", F.lit(False)).alias("quality"), capped.alias("_capped"))
    own = F.row_number().over(W.partitionBy("vendor", "_capped", "category", "quality").orderBy(*_timeline_order()))
    rows = rows.withColumn("_own", own).where((F.col("_own") <= vendor_cap) | F.col("vendor").isNull())
    most = size + (-(-size // vendor_cap) * vendor_cap) * (1 + len(caps)) + len(caps) * size
    place = F.row_number().over(W.partitionBy("category", "quality").orderBy(*_timeline_order()))
    few = rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_own", "_place", "_capped")

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["published", "heat", "importance", "event_id"], ascending=False, na_position="last")
        kinds = [tuple(None if pd.isna(v) else v for v in k) for k in zip(*(pdf[c] for c in ("vendor", "source", "category", "quality")), strict=True)]
        ids, p = pdf["event_id"].tolist(), _Page(kinds, vendor_cap, soft, caps, adjacent=True)
        chosen = p.take(min(size, len(ids)), fill=False)
        return pd.DataFrame({"event_id": [ids[i] for i in chosen], "place": range(len(chosen))})

    return few.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(go, "event_id long, place int")
