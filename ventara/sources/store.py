"""The month-partitioned sales store, its masters and its sync log.

Tables are Parquet folders under a manifest (see versions). Sales are partitioned by year and month; a range is replaced by
rewriting only the months it touches, lines are merged by deltas, and either is published in one step.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import date, timedelta
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F

from ventara.functions.numbers import MEASURE
from ventara.functions.rows import literal_rows
from ventara.functions.text import blank_to_null, clean, first_text
from ventara.operators.core import one_row
from ventara.plans.period import between, day, month_labels
from ventara.sources.versions import Manifest, Part, Versioned

# Columns of the compact store.
KEY_FIELDS = ("client_key", "product_key", "seller_key", "sales_scheme_key", "route_description", "channel")
NAME_FIELDS = ("client_name", "seller_name", "sales_scheme_name", "sales_force", "product_name")
MEASURES = ("amount", "amount_net", "amount_final", "internal_taxes", "amount_net_internal", "quantity")
STORE_SCHEMA = (
    "date date, invoice string, client_key string, product_key string, seller_key string, sales_scheme_key string, route_description string, "
    "channel string, client_name string, seller_name string, sales_scheme_name string, sales_force string, product_name string, "
    "amount decimal(38,6), amount_net decimal(38,6), amount_final decimal(38,6), internal_taxes decimal(38,6), "
    "amount_net_internal decimal(38,6), quantity decimal(38,6), line_id string, document_key string, line_key string, year int, month int"
)
#: Months whose statistics are observed while they are written; of more, the days are read back from what was written.
OBSERVED_MONTHS = 12
#: Pieces that the lines to be written are cut into, for each shuffle partition and for each month at least: a large month is shared by some tasks.
SLOTS_A_TASK, LEAST_PIECES = 4, 4
#: Months that a batch without a range is cut up for; it may have more or fewer.
BATCH_MONTHS = 12
#: Lines of deltas up to which their ids are broadcast when a month is read.
BROADCAST_LINES = 500_000

EMPTY_CONFIRMATIONS = ("no devolvió ventas", "no generó lotes")
SYNC_CHUNK_DAYS = 31


# --- compaction -----------------------------------------------------------------------------


def _text(df: DataFrame, name: str):
    return clean(name) if name in df.columns else F.lit("")


def _measures(df: DataFrame) -> dict:
    has = lambda c: F.col(c) if c in df.columns else F.lit(None).cast(MEASURE)
    zero = F.lit(0).cast(MEASURE)
    amount = F.coalesce(has("amount"), zero)
    net = F.coalesce(has("amount_net"), amount)
    taxes = F.coalesce(has("internal_taxes"), zero)
    return {
        "amount": amount, "amount_net": net, "amount_final": F.coalesce(has("amount_final"), amount), "internal_taxes": taxes,
        "amount_net_internal": F.coalesce(has("amount_net_internal"), net + taxes), "quantity": F.coalesce(has("quantity"), zero),
    }


def _shaped(records: DataFrame) -> DataFrame:
    names = {n: _text(records, n) for n in NAME_FIELDS}
    names["client_name"] = F.coalesce(F.nullif(names["client_name"], F.lit("")), _text(records, "client_key"))
    scheme, force = names["sales_scheme_name"], names["sales_force"]
    names["sales_scheme_name"] = F.coalesce(F.nullif(scheme, F.lit("")), force)
    names["sales_force"] = F.coalesce(F.nullif(force, F.lit("")), scheme)
    invoice = F.coalesce(first_text("invoice", "document_key") if "document_key" in records.columns else blank_to_null("invoice"), F.lit(""))
    seq = [F.col("load_seq").alias("seq")] if "load_seq" in records.columns else []
    extra = [_text(records, c).alias(c) for c in ("document_key", "line_key")]
    return records.filter(F.col("date").isNotNull()).select(
        "date", invoice.alias("invoice"), *[_text(records, k).alias(k) for k in KEY_FIELDS], *[v.alias(n) for n, v in names.items()],
        *[m for m in MEASURES if m in records.columns], *extra, *seq)


def _together(shaped: DataFrame, months: int | None, keys: list, order: list) -> DataFrame:
    """Rows of some of the keys that are grouped by in one partition, by a `slot` that is grouped by as well.

    Most keys have one line, so whole lines are shuffled once instead of partial aggregates, which hold the order with every name. Measures
    come along in their own type, and what can be made of the rest is made after the shuffle. With the number of `months` that the lines
    are about to be written to, a slot is a piece of a month, so that they need not be shuffled once more to be written by month. Lines of
    an `order`, whose texts are much the same, share a piece and are stored side by side.
    """
    if months is None:
        return shaped.repartition(*keys).withColumn("slot", F.lit(0))
    pieces = max(LEAST_PIECES, -(-SLOTS_A_TASK * int(shaped.sparkSession.conf.get("spark.sql.shuffle.partitions")) // max(months, 1)))
    month = F.year("date") * 12 + F.month("date")
    return shaped.withColumn("slot", month.cast("long") * pieces + F.pmod(F.xxhash64(*order), F.lit(pieces))).repartition("slot")


def _merged(rows: DataFrame, keys: tuple, filled: tuple) -> DataFrame:
    """One row per key of rows that lie together: first filled texts and summed measures. Orders and measures are made for the aggregate only."""
    order = F.col("seq") if "seq" in rows.columns else F.struct(*NAME_FIELDS)

    def first(name):
        value = F.nullif(F.col(name), F.lit(""))
        return F.coalesce(F.min_by(value, F.when(value.isNotNull(), order)), F.lit("")).alias(name)

    sums = [F.sum(v.cast("decimal(38,6)")).cast("decimal(38,6)").alias(n) for n, v in _measures(rows).items()]
    grouped = rows.groupBy("slot", *keys).agg(*map(first, filled), *sums)
    return grouped.drop("slot").select("*", F.year("date").alias("year"), F.month("date").alias("month"))


def compact(records: DataFrame, months: int | None = None) -> DataFrame:
    """One row per date, client, invoice, product, seller, scheme, route and channel: summed measures, first filled names."""
    near = ["date", "invoice", *[k for k in ("client_key", "product_key") if k in records.columns]]  # a column that is missing is a constant
    return _merged(_together(_shaped(records), months, near, ["date", "invoice", "client_key"]), ("date", "invoice", *KEY_FIELDS), NAME_FIELDS)


def line_id(df: DataFrame):
    """Identity of a stored line in full detail: by line key, or by all keys when there is none."""
    base = [F.col("date").cast("string"), F.col("client_key")]
    by_line = F.concat_ws("|", *base, "invoice", "line_key", "product_key")
    fallback = F.concat_ws("|", *base, "document_key", "invoice", "line_key", "product_key", "seller_key")
    return F.when(F.col("line_key") != "", by_line).otherwise(fallback)


def compact_lines(records: DataFrame, months: int | None = None) -> DataFrame:
    """Full-detail form: one row per line id, with repeated ids of a batch summed."""
    shaped = _shaped(records)
    order = F.substring_index(line_id(shaped), "|", 3)  # day, client, and invoice or document: of the id alone, since it is what lines are merged by
    rows = _together(shaped, months, [line_id(shaped), "date"], ["date", order])
    return _merged(rows.withColumn("line_id", line_id(rows)), ("line_id", "date"), ("invoice", *KEY_FIELDS, "document_key", "line_key", *NAME_FIELDS))


# --- pure table operations --------------------------------------------------------------------


def replace_range(existing: DataFrame, incoming: DataFrame, start: date, end: date) -> DataFrame:
    """Existing rows outside the range plus the incoming rows inside it."""
    return existing.filter(~between("date", start, end)).unionByName(incoming.filter(between("date", start, end)), allowMissingColumns=True)


def last_of_key(incoming: DataFrame, *keys: str) -> DataFrame:
    """One row per key: the last by `load_seq`, or by all columns where there is none. Rows without a key are dropped."""
    valid = incoming
    for key in keys:
        valid = valid.filter(clean(key) != "")
    rest = [c for c in incoming.columns if c not in keys]
    if not rest:
        return valid.distinct()
    order = F.struct(*[c for c in ("load_seq", *rest) if c in rest])
    return valid.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*").select(*incoming.columns)


def upsert(existing: DataFrame, incoming: DataFrame, *keys: str) -> DataFrame:
    """Incoming rows, the last of each key, plus existing rows whose key does not come in."""
    valid = last_of_key(incoming, *keys)
    return existing.join(valid.select(*keys).distinct(), list(keys), "left_anti").unionByName(valid, allowMissingColumns=True)


def retention_cutoff(as_of: date, keep_days: int) -> date | None:
    """First day that is kept; none when retention is off."""
    return as_of - timedelta(days=max(keep_days - 1, 0)) if keep_days > 0 else None


def prune(rows: DataFrame, cutoff: date) -> DataFrame:
    return rows.filter(F.col("date") >= day(cutoff))


# --- stored tables ----------------------------------------------------------------------------


def _number(label: str) -> int:
    return int(label[:4]) * 12 + int(label[5:])


def _month(label: str):
    return F.year("date") * 12 + F.month("date") == _number(label)


def _metrics(labels: list[str]) -> list:
    """Rows, first and last day of each month, taken while it is written."""
    return [x.alias(f"{n}_{k}") for k, m in enumerate(map(_month, labels)) for n, x in (("n", F.count_if(m)), ("a", F.min(F.when(m, F.col("date")))), ("z", F.max(F.when(m, F.col("date")))))]


def told(observed: Observation) -> dict:
    """Metrics by name; none where Spark saw before running that there were no rows to observe."""
    try:
        return observed.get
    except Py4JJavaError as error:
        if "AssertionError" not in str(error.java_exception):
            raise
        return {}


def _rebalanced(rows: DataFrame) -> DataFrame:
    """Lets Spark split large months over tasks and keep small ones in one file."""
    return rows.hint("rebalance", F.col("year"), F.col("month"))


def _write_months(table: Versioned, rows: DataFrame, labels: list[str] | None, run: str, more: list = ()) -> tuple[dict[str, Part], dict]:
    """Write rows of the given months as a run of its own: its parts by month, and the further metrics of the written rows.

    Rows come by month already: compacted for so many months, or rebalanced. Without `labels` the months are those that were written.
    The metrics are those of the writing tasks, each counted once.
    """
    observed, few = Observation(f"written-{run}"), labels is not None and len(labels) <= OBSERVED_MONTHS
    ready = rows.sortWithinPartitions("year", "month", "date", "client_key", "seller_key", "product_key", "invoice")
    if few or more:
        ready = ready.observe(observed, *(_metrics(labels) if few else ()), *more)
    ready.write.partitionBy("year", "month").parquet(f"{table.path}/run={run}")
    seen = told(observed) if few or more else {}
    folder = lambda x: f"run={run}/year={int(x[:4])}/month={int(x[5:])}"
    if not few:
        days = table.read("date date, year int, month int", [f"run={run}"]).groupBy("year", "month").agg(F.count("*").alias("n"), F.min("date").alias("a"), F.max("date").alias("z"))
        found = {f"{r.year:04}-{r.month:02}": r for r in days.collect()}  # a row per month
        return {x: Part(folder(x), found[x].n, found[x].a, found[x].z) for x in (sorted(found) if labels is None else labels) if x in found}, seen
    return {x: Part(folder(x), seen[f"n_{k}"], seen[f"a_{k}"], seen[f"z_{k}"]) for k, x in enumerate(labels) if seen.get(f"n_{k}")}, seen


def _in_months(labels: list[str]):
    """Predicate on the partition columns."""
    low, high = _number(labels[0]), _number(labels[-1])
    return (F.col("year") * 12 + F.col("month")).between(low, high) & F.col("year").between(int(labels[0][:4]), int(labels[-1][:4]))


def _visible(table: Versioned, seen: Manifest, keys: list[str]) -> DataFrame:
    """Rows of months as their parts say together: bases without what later deltas replace, by day or by line id."""
    held = [seen.parts[k] for k in keys]
    rows = table.read(STORE_SCHEMA, [p[0].folder for p in held if len(p) == 1])
    for parts in (p for p in held if len(p) > 1):  # at most as many as months with deltas; merge_months folds them
        for k, part in enumerate(parts):
            later = parts[k + 1 :]
            own = table.read(STORE_SCHEMA, [part.folder])
            for delta in later:
                if delta.since:
                    own = own.filter(~between("date", delta.since, delta.until))
            by_id = [d for d in later if not d.since]
            if by_id:
                ids = table.read(STORE_SCHEMA, [d.folder for d in by_id]).select("line_id").distinct()
                own = own.join(F.broadcast(ids) if sum(d.rows for d in by_id) <= BROADCAST_LINES else ids, "line_id", "left_anti").select(*own.columns)
            rows = rows.unionByName(own)
    return rows


def _filled(df: DataFrame) -> DataFrame:
    """A column that an old file lacks gets its default."""
    texts = {c: F.coalesce(c, F.lit("")) for c in ("seller_name", "sales_scheme_key", "sales_scheme_name", "sales_force")}
    zero = F.lit(0).cast("decimal(38,6)")
    sums = {c: F.coalesce(c, F.col("amount") if c != "internal_taxes" else zero) for c in MEASURES if c not in ("amount", "quantity")}
    return df.withColumns({**texts, **sums})


def read_sales(spark: SparkSession, path: str) -> DataFrame:
    """The whole store, as of its last published version. The declared schema spares a look at every file."""
    table = Versioned(spark, path)
    seen = table.current()
    return _filled(_visible(table, seen, sorted(seen.parts)))


def scan_range(spark: SparkSession, path: str, start: date, end: date, ordered: bool = False) -> DataFrame:
    """Rows of an inclusive range. Months outside it are not even listed; a range without any day of the store is told from the manifest."""
    table = Versioned(spark, path)
    seen = table.current()
    near = [k for k in month_labels(start, end) if any(p.first <= end and p.last >= start for p in seen.parts.get(k, ()))]
    certain = any(len(seen.parts[k]) == 1 and (start <= seen.parts[k][0].first <= end or start <= seen.parts[k][0].last <= end) for k in near)
    rows = _filled(_visible(table, seen, near)).filter(_in_months(month_labels(start, end)) & between("date", start, end))
    if not near or not certain and rows.isEmpty():
        raise ValueError(f"no sales stored from {start} to {end}")
    return rows.orderBy("date") if ordered else rows


def empty_is_confirmed(warning: str | None) -> bool:
    text = (warning or "").lower()
    return any(t in text for t in EMPTY_CONFIRMATIONS)


def chunks_of(start: date, end: date, chunk_days: int = SYNC_CHUNK_DAYS) -> list[tuple[date, date]]:
    """A range cut into chunks of so many days."""
    starts = [start + timedelta(days=d) for d in range(0, (end - start).days + 1, chunk_days)]
    return [(a, min(a + timedelta(days=chunk_days - 1), end)) for a in starts]


def sync_range(
    spark: SparkSession, path: str, incoming: DataFrame, start: date, end: date,
    log_path: str | None = None, warning: str | None = None, confirmed_empty: bool = False, origin: str = "manual", full_detail: bool = False,
) -> dict:
    """Replace a range of the store with the incoming lines, in one published version. Returns the run's entry of the log.

    Nothing changes when the incoming side is empty, unless the source confirmed that there were no sales. Running it twice with the
    same input leaves the same table.
    """
    return sync_ranges(spark, path, incoming, [(start, end)], log_path, warning, confirmed_empty, origin, full_detail, chunk_days=None)[0]


def sync_ranges(
    spark: SparkSession, path: str, incoming: DataFrame, ranges: list[tuple[date, date]],
    log_path: str | None = None, warning: str | None = None, confirmed_empty: bool = False, origin: str = "manual", full_detail: bool = False,
    chunk_days: int | None = SYNC_CHUNK_DAYS, valid=None,
) -> tuple[dict, list[dict]]:
    """Replace ranges that do not overlap, all in one version: the run's log entry, and a summary of each chunk (of each range without `chunk_days`).

    The input is read once. What is read, valid (`valid`: a condition on the incoming lines, which only counts) and stored of each chunk
    is observed while the lines are written. The lines read are observed before a shuffle, so a lost executor can make them count
    twice; what is stored is exact. Border months keep their days outside the ranges. The run is published before it is logged: a run
    that breaks off between the two is not known as covered and is fetched again.
    """
    table = Versioned(spark, path)
    seen, run = table.current(), table.new_run()
    chunks = [c for a, b in ranges for c in (chunks_of(a, b, chunk_days) if chunk_days else [(a, b)])]
    labels = sorted({x for a, b in ranges for x in month_labels(a, b)})
    inside = reduce(lambda x, y: x | y, [between("date", a, b) for a, b in ranges], F.lit(False))
    counted = Observation(f"read-{run}")
    ok = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    reads = [x.alias(f"{n}_{k}") for k, (a, b) in enumerate(chunks) for n, x in (("r", F.count_if(between("date", a, b))), ("v", F.count_if(between("date", a, b) & ok)))]
    rows = (compact_lines if full_detail else compact)(incoming.filter(inside).observe(counted, F.count("*").alias("received"), *reads), len(labels))
    if not full_detail:
        rows = rows.withColumn("line_id", document_id())
    border = [x for x in labels if any(not any(a <= d <= b for a, b in ranges) for p in seen.parts.get(x, ()) for d in _days_at_risk(p, ranges))]
    if border:
        rows = rows.unionByName(_rebalanced(_visible(table, seen, border).filter(~inside)), allowMissingColumns=True)
    stores = [F.count_if(between("date", a, b)).alias(f"s_{k}") for k, (a, b) in enumerate(chunks)]
    parts, written = _write_months(table, rows, labels, run, stores)
    read = told(counted)
    received = read.get("received", 0)
    confirmed = confirmed_empty or empty_is_confirmed(warning)
    entry = {"entity": "sales", "range_start": min(a for a, _ in ranges), "range_end": max(b for _, b in ranges), "empty_confirmed": confirmed, "warning": warning, "origin": origin, "records_received": received}
    if not received and not confirmed:
        table.drop(f"run={run}")
        if log_path:
            append_run(spark, log_path, {**entry, "status": "aborted_empty_response"})
        raise RuntimeError(f"no valid rows from {entry['range_start']} to {entry['range_end']}; stored data is left as it is")
    entry["status"] = "success"
    kept = {k: v for k, v in seen.parts.items() if k not in labels}
    table.commit(seen, kept | {k: (p,) for k, p in parts.items()}, entry)
    if log_path:
        for a, b in ranges:
            append_run(spark, log_path, {**entry, "range_start": a, "range_end": b})
    table.sweep()
    number = lambda x, name: x.get(name) or 0
    return entry, [{"chunk_start": a, "chunk_end": b, "rows_read": number(read, f"r_{k}"), "rows_valid": number(read, f"v_{k}"), "rows_stored": number(written, f"s_{k}")} for k, (a, b) in enumerate(chunks)]


def _days_at_risk(part: Part, ranges) -> list[date]:
    """Days of a part that a range may cut off: its ends, and the days just outside each range that it reaches."""
    around = [d for a, b in ranges for d in (a - timedelta(days=1), b + timedelta(days=1)) if part.first <= d <= part.last]
    return [part.first, part.last, *around]


def document_id():
    """Identity of a compacted line."""
    return F.concat_ws("|", F.col("date").cast("string"), "client_key", "invoice", "product_key", "seller_key", "sales_scheme_key", "route_description", "channel")


def merge_lines(spark: SparkSession, path: str, incoming: DataFrame, start: date | None = None, end: date | None = None, full_detail: bool = True, origin: str = "manual") -> Manifest:
    """Add lines to the store and replace those of the same id, without rewriting the months: they become deltas that reads merge.

    Repeated ids of a batch are summed first. With a range, lines of the batch outside it are left out, and stored lines of its days
    whose ids the batch lacks are gone as well. Months with many deltas are folded by merge_months.
    """
    table = Versioned(spark, path)
    seen, run = table.current(), table.new_run()
    labels = None if start is None else month_labels(start, end)
    rows = (compact_lines if full_detail else compact)(incoming if start is None else incoming.filter(between("date", start, end)), BATCH_MONTHS if labels is None else len(labels))
    if not full_detail:
        rows = rows.withColumn("line_id", document_id())
    parts, _ = _write_months(table, rows, labels, run)
    if start is None and not parts:
        table.drop(f"run={run}")
        return seen
    held = dict(seen.parts)
    for label in labels or parts:
        if start is None:
            held[label] = (*held.get(label, ()), *([parts[label]] if label in parts else []))
        elif label in parts:
            held[label] = (*held.get(label, ()), replace(parts[label], since=start, until=end))
        elif label in held:  # nothing came: the delta is the base cut down, so rewrite what is left of the month
            left, _ = _write_months(table, _rebalanced(_visible(table, seen, [label]).filter(~between("date", start, end))), [label], f"{run}-{label}")
            held[label] = (left[label],) if label in left else ()
    made = table.commit(seen, {k: v for k, v in held.items() if v}, {"entity": "sales", "status": "success", "origin": origin, "range_start": start, "range_end": end})
    table.sweep()
    return made


def merge_months(spark: SparkSession, path: str, share: float = 0.1) -> list[str]:
    """Fold the deltas of the months in which they hold more than a share of the base's rows. Returns these months."""
    table = Versioned(spark, path)
    seen, run = table.current(), table.new_run()
    due = sorted(k for k, held in seen.parts.items() if len(held) > 1 and sum(p.rows for p in held[1:]) > share * held[0].rows)
    if due:
        parts, _ = _write_months(table, _rebalanced(_visible(table, seen, due)), due, run)
        table.commit(seen, {k: v for k, v in seen.parts.items() if k not in due} | {k: (p,) for k, p in parts.items()}, {"entity": "sales", "status": "merged"})
        table.sweep()
    return due


def merge_outcome(existing: DataFrame, incoming: DataFrame, start: date, end: date) -> DataFrame:
    """What merging the lines of a range does, in one row: matched and modified ids, new ids (upserted), and ids of the range that go (deleted).

    Both sides have a line_id and the measures. One join by id; a hot day does not matter, since ids are unique.
    """
    figures = F.hash(*[F.col(m).cast("decimal(38,6)") for m in MEASURES])
    side = lambda df, n: df.filter(between("date", start, end)).select("line_id", figures.alias(n))
    both = side(existing, "old").join(side(incoming, "new"), "line_id", "full")
    there, here = F.col("old").isNotNull(), F.col("new").isNotNull()
    return both.agg(F.count_if(there & here).alias("matched"), F.count_if(there & here & (F.col("old") != F.col("new"))).alias("modified"), F.count_if(here & ~there).alias("upserted"), F.count_if(there & ~here).alias("deleted"))


def period_statistics(spark: SparkSession, path: str) -> DataFrame:
    """(month, rows, first_date, last_date) of the stored months, from the manifest alone."""
    stats = Versioned(spark, path).statistics()
    return stats.groupBy(F.col("key").alias("month")).agg(F.sum("rows").alias("rows"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))


def stored_status(spark: SparkSession, path: str) -> DataFrame:
    """Rows, first and last day of a store, from the manifest alone (see storage_status for rows at hand)."""
    return period_statistics(spark, path).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("records"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"), (F.coalesce(F.sum("rows"), F.lit(0)) > 0).alias("available"))


def prune_store(spark: SparkSession, path: str, cutoff: date) -> None:
    """Drop everything before the cutoff in one version: whole months leave the manifest, the cutoff's month is rewritten."""
    table = Versioned(spark, path)
    seen, run, label = table.current(), table.new_run(), f"{cutoff:%Y-%m}"
    kept = {k: v for k, v in seen.parts.items() if k >= label}
    if any(p.first < cutoff for p in kept.get(label, ())):
        parts, _ = _write_months(table, _rebalanced(_visible(table, seen, [label]).filter(F.col("date") >= day(cutoff))), [label], run)
        kept = {k: v for k, v in kept.items() if k != label} | {k: (p,) for k, p in parts.items()}
    if kept != seen.parts:
        table.commit(seen, kept, {"entity": "sales", "status": "pruned"})
        table.sweep()


def write_master(incoming: DataFrame, path: str, *keys: str, replace_all: bool = False) -> None:
    """Store a master in one published version: add and update rows by key, or replace all of them."""
    table = Versioned(incoming.sparkSession, path)
    seen, run = table.current(), table.new_run()
    rows = last_of_key(incoming, *keys)
    if seen.parts and not replace_all:
        rows = upsert(read_master(incoming.sparkSession, path), rows, *keys)
    observed = Observation(f"master-{run}")
    rows.observe(observed, F.count("*").alias("n")).write.parquet(f"{table.path}/run={run}")
    table.commit(seen, {"all": (Part(f"run={run}", told(observed).get("n", 0)),)}, {"entity": "master", "status": "success"})
    table.sweep()


def read_master(spark: SparkSession, path: str) -> DataFrame:
    """A master as of its last published version."""
    table = Versioned(spark, path)
    (part,) = table.current().parts["all"]
    return spark.read.parquet(f"{table.path}/{part.folder}")


RUN_SCHEMA = (
    "entity string, status string, range_start date, range_end date, records_received long, empty_confirmed boolean, "
    "warning string, origin string, timestamp timestamp"
)


def append_run(spark: SparkSession, path: str, run: dict) -> None:
    """Add one entry to the sync log."""
    from datetime import datetime, timezone

    entry = {"timestamp": datetime.now(timezone.utc), **run}
    names = [f.split()[0] for f in RUN_SCHEMA.split(", ")]
    spark.createDataFrame([tuple(entry.get(n) for n in names)], RUN_SCHEMA).write.mode("append").parquet(path)


def latest_runs(runs: DataFrame, n: int = 20, entity: str | None = None) -> DataFrame:
    rows = runs.filter(F.col("entity") == entity) if entity else runs
    return rows.orderBy(F.desc("timestamp")).limit(n)


# --- covered ranges ---------------------------------------------------------------------------


def _usable(runs: DataFrame) -> DataFrame:
    counts = (F.coalesce("records_received", F.lit(0)) > 0) | F.coalesce("empty_confirmed", F.lit(False))
    return runs.filter((F.col("status") == "success") & counts & F.col("range_start").isNotNull() & F.col("range_end").isNotNull())


def _of_entity(runs: DataFrame, entity: str | None, by) -> DataFrame:
    return runs if entity is None or "entity" in by else runs.filter(F.col("entity") == entity)


def covered_ranges(runs: DataFrame, start: date, end: date, by=(), entity: str | None = "sales") -> DataFrame:
    """Merged ranges of an entity's successful runs inside the request; ranges that overlap or touch become one.

    With `entity` None, or with "entity" in `by`, runs of all entities count.

    Runs are first reduced to the latest end per start day, so a window holds at most one row per
    calendar day of the request.
    """
    inside = _usable(_of_entity(runs, entity, by)).filter((F.col("range_start") <= day(end)) & (F.col("range_end") >= day(start)))
    clipped = inside.select(*by, F.greatest("range_start", day(start)).alias("start"), F.least("range_end", day(end)).alias("end")).filter("start <= end")
    days = clipped.groupBy(*by, "start").agg(F.max("end").alias("end"))
    order = Window.partitionBy(*by).orderBy("start") if by else Window.orderBy("start")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start") > F.date_add(reach, 1)), 1).otherwise(0)
    islands = days.withColumn("opens", opens).withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def _gaps(ranges: DataFrame, start: date, end: date, by, scopes: DataFrame | None) -> DataFrame:
    """Parts of the request that no range covers. Marks just outside both ends close the first and last gap."""
    spark = ranges.sparkSession
    marks = [(start - timedelta(days=1),), (end + timedelta(days=1),)]
    if by:
        both = F.explode(F.array(*[F.lit(m[0]) for m in marks])).alias("start")
        edge = scopes.select(*by).distinct().select(*by, both)
    else:
        edge = literal_rows(spark, ["start"], marks)
    rows = ranges.select(*by, "start", "end").unionByName(edge.withColumn("end", F.col("start")))
    order = Window.partitionBy(*by).orderBy("start", "end") if by else Window.orderBy("start", "end")
    after = F.date_add(F.lag("end").over(order), 1)
    gaps = rows.withColumn("from", after).filter(F.col("from").isNotNull() & (F.col("start") > F.col("from")))
    return gaps.select(*by, F.col("from").alias("start"), F.date_sub("start", 1).alias("end"))


def uncovered_ranges(runs: DataFrame, start: date, end: date, by=(), entity: str | None = "sales") -> DataFrame:
    """Parts of the request that still have to be fetched."""
    return _gaps(covered_ranges(runs, start, end, by, entity), start, end, by, _of_entity(runs, entity, by) if by else None)


def reused_ranges(uncovered: DataFrame, start: date, end: date) -> DataFrame:
    """Inverse of the uncovered ranges: what is already stored."""
    return _gaps(uncovered, start, end, (), None)


def range_coverage(runs: DataFrame, start: date, end: date, by=(), entity: str | None = "sales") -> DataFrame:
    """Whether the request is fully covered, and the first part that is missing."""
    missing = uncovered_ranges(runs, start, end, by, entity)
    first = F.min(F.struct("start", "end"))
    if by:
        scopes = _of_entity(runs, entity, by).select(*by).distinct()
        found = missing.groupBy(*by).agg(first.alias("m"))
        rows = scopes.join(found, list(by), "left")
    else:
        rows = missing.agg(first.alias("m"))
    return rows.select(*by, F.col("m").isNull().alias("covered"), F.col("m.start").alias("missing_start"), F.col("m.end").alias("missing_end"))


def load_with_fallback(spark: SparkSession, runs: DataFrame, main_path: str, history_path: str, start: date, end: date) -> tuple[DataFrame, str]:
    """Sales of a range from the main store when it covers all of it, else from the long history."""
    if range_coverage(runs, start, end).first().covered:
        try:
            return scan_range(spark, main_path, start, end), "main"
        except (ValueError, AnalysisException):
            pass
    return scan_range(spark, history_path, start, end), "history"


# --- status and totals --------------------------------------------------------------------------


def storage_status(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("records"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), (F.count("*") > 0).alias("available"))


def last_runs(runs: DataFrame) -> DataFrame:
    """Latest run per entity."""
    names = [c for c in runs.columns if c != "entity"]
    best = runs.groupBy("entity").agg(F.max_by(F.struct(*names), F.struct("timestamp", *[n for n in names if n != "timestamp"])).alias("r"))
    return best.select("entity", "r.*")


def chunk_totals(rows: DataFrame, ranges: DataFrame, chunk_days: int = SYNC_CHUNK_DAYS) -> DataFrame:
    """Rows read and valid per fetched chunk of the given ranges, from one pass over all of them.

    Days of a range map to their chunk arithmetically: the ranges are exploded into days (a bounded
    calendar) and met by date, so every row is looked up once.
    """
    step = F.floor(F.date_diff("day", "start") / chunk_days).cast("int")
    calendar = ranges.select("start", "end", F.explode(F.sequence("start", "end", F.expr("interval 1 day"))).alias("day"))
    calendar = calendar.select("day", F.date_add("start", step * chunk_days).alias("chunk_start"), F.least(F.date_add("start", step * chunk_days + (chunk_days - 1)), F.col("end")).alias("chunk_end"))
    per_day = rows.groupBy("date").agg(F.count("*").alias("rows_read"), F.count_if("is_valid").alias("rows_valid"))
    joined = calendar.join(per_day, calendar.day == per_day.date, "left").na.fill(0, ["rows_read", "rows_valid"])
    return joined.groupBy("chunk_start", "chunk_end").agg(F.sum("rows_read").alias("rows_read"), F.sum("rows_valid").alias("rows_valid"))


def chunk_rows(spark: SparkSession, chunks: list[dict]) -> DataFrame:
    """The summaries of sync_ranges as a table; as many rows as the calendar has chunks."""
    names = ["chunk_start", "chunk_end", "rows_read", "rows_valid", "rows_stored"]
    return literal_rows(spark, names, [tuple(c[n] for n in names) for c in chunks], {n: "date" if "chunk" in n else "bigint" for n in names})


def batch_totals(chunks: DataFrame, fetched: DataFrame | None = None, start: date | None = None, end: date | None = None) -> DataFrame:
    """One row over the chunks of a batch. With the fetched ranges of a request, also these and what of the request was already stored."""
    sums = [F.sum(c).alias(c) for c in ("rows_read", "rows_valid", "rows_stored") if c in chunks.columns]
    row = chunks.agg(F.count("*").alias("chunks"), *sums, F.min("chunk_start").alias("first_date"), F.max("chunk_end").alias("last_date"))
    if fetched is None:
        return row
    text = F.concat(F.col("start").cast("string"), F.lit(".."), F.col("end").cast("string"))
    listed = lambda df: one_row(df, F.concat_ws(", ", F.sort_array(F.collect_list(text))).alias("t")).t
    return row.withColumns({"fetched": listed(fetched), "reused": listed(reused_ranges(fetched, start, end))})


# Fields offered as filters before any sales are loaded, per master.
PREFILTER_FIELDS = {
    "articles": ("family", "line", "brand", "business_unit", "supplier"),
    "sellers": ("sales_scheme_name", "sales_force", "seller_name"),
    "routes": ("sales_scheme_name", "route_description"),
}


def prefilter_options(articles: DataFrame, sellers: DataFrame, routes: DataFrame) -> DataFrame:
    """Distinct values and row counts of the master fields; schemes come from sellers and routes together."""
    parts = []
    for name, df in (("articles", articles), ("sellers", sellers), ("routes", routes)):
        fields = [f for f in PREFILTER_FIELDS[name] if f in df.columns]
        pairs = F.array(*[F.struct(F.lit(f).alias("field"), blank_to_null(f).alias("value")) for f in fields])
        parts.append(df.select(F.inline_outer(pairs)))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.filter(F.col("value").isNotNull()).groupBy("field", "value").agg(F.count("*").alias("rows"))
