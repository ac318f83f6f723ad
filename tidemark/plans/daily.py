"""From two snapshots to a day's change log, and the daily, weekly and bootstrap runs.

A snapshot is a family of typed tables under ``root/<collection>/snapshot_date=YYYY-MM-DD``.  All of a day is one lazy
plan up to the write; drivers only see checks, alerts and rendered rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expr import category, header_detail, vendor_profile
from tidemark.functions.vocab import KEPT, PROFILE_WORDS, SCHEMA_VERSION, VENDOR_WORDS, WEEK_FILES
from tidemark.operators import alerts as alerting
from tidemark.operators import merge, quality, stats
from tidemark.operators.diff import Transition, cells_diff, feed_diff, header_diff, keyed_diff, schema_warnings, text_diff
from tidemark.plans import sinks
from tidemark.plans.schema import CHANGE, CHANGE_FIELDS, SCHEMAS

Snapshot = dict[str, DataFrame]


def empty_snapshot(spark: SparkSession) -> Snapshot:
    """V6."""
    return {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}


def log_rows(df: DataFrame, domain, collection: str, **columns) -> DataFrame:
    """Bring a difference into the form of the change log; columns that aren't named are null."""
    given = {"domain": F.lit(domain) if isinstance(domain, str) else domain, "collection": F.lit(collection)} | columns
    return df.select(*(given.get(n, F.lit(None)).cast(k).alias(n) for n, k in CHANGE_FIELDS.items()))


def entity_rows(found: DataFrame, collection: str, title, text=None, link=None, cat=None) -> DataFrame:
    """``title`` and the others are built from the record ``r``: the new one, or the old one of a removed entity."""
    r = found.withColumn("r", F.coalesce("new", "old"))
    return log_rows(
        r, "niap", collection, kind=F.col("kind"), entity_key=F.col("entity_key"), pos=F.col("r.pos"), title=title, old_value=F.col("old_value"), new_value=F.col("new_value"),
        payload=F.to_json("r"), **({"text": text} if text is not None else {}), **({"link": link} if link is not None else {}), **({"category": cat} if cat is not None else {}),
    )


def payload(df: DataFrame):
    return F.to_json(F.struct(*[c for c in df.columns if c not in ("kind", "pos")]))


def compute_changes(old: Snapshot, new: Snapshot) -> DataFrame:
    """The change log between two snapshots, all collections."""
    def pick(s):
        return s["products"].filter(vendor_profile("vendor_id_name", "protection_profiles", VENDOR_WORDS, PROFILE_WORDS))

    parts = [
        entity_rows(keyed_diff(old["profiles"], new["profiles"], "pp_id", [Transition("sunset_change", "sunset_date", "changed_to_value"), Transition("status_change", "status")], order="pos"), "pps", F.col("r.pp_short_name"), F.col("r.pp_name"), F.concat(F.lit("https://www.niap-ccevs.org/Profile/PP.cfm?id="), F.col("entity_key"))),
        entity_rows(keyed_diff(old["decisions"], new["decisions"], "td_id", [Transition("removed", "removed_on", "became_set")], removed=False, order="pos"), "tds", F.col("r.title"), F.col("r.identifier")),
        entity_rows(keyed_diff(pick(old), pick(new), "product_id", [Transition("newly_archived", "status_sort", "pair", "Certified", "Archived")], order="pos"), "cisco_ndcpp", F.col("r.product_name"), F.col("r.vendor_id_name")),
        entity_rows(keyed_diff(old["news"], new["news"], "id", removed=False, order="pos"), "news", F.col("r.title"), F.col("r.date"), F.coalesce(F.nullif(F.col("r.link"), F.lit("")), F.col("r.url")), category(F.col("r.title"))),
        entity_rows(keyed_diff(old["events"], new["events"], "id", removed=False, order="pos"), "events", F.col("r.title"), None, F.col("r.link")),
    ]
    flat = {s: snap["labs_directory"].withColumn("status_name", F.col("status_id.status_name")) for s, snap in (("o", old), ("n", new))}
    parts.append(entity_rows(keyed_diff(flat["o"], flat["n"], "cctl_id", [Transition("status_change", "status_name")], order="pos"), "cctls", F.col("r.name")))

    news = text_diff(old["portal_news"], new["portal_news"], n=80, both=False)
    parts.append(log_rows(news, "cc_portal", "news", kind=F.col("kind"), pos=F.col("pos"), text=F.col("text"), link=F.col("link"), payload=payload(news)))
    for table, collection, n in (("portal_pps", "pps", 1), ("portal_products", "products", 2)):
        rows = cells_diff(old[table], new[table], n=n)
        parts.append(log_rows(rows, "cc_portal", collection, kind=F.col("kind"), pos=F.col("pos"), text=F.array_join("cells.value", " | "), payload=payload(rows)))

    labs = F.col("domain") == "cctl_labs"
    posts = feed_diff(old["feed_items"].filter(labs), new["feed_items"].filter(labs), "feed_name", ("id", "title"))
    feeds = feed_diff(*(s["feed_items"].filter(~labs).withColumn("__feed", F.concat_ws("\0", "domain", "feed_name")) for s in (old, new)), "__feed").drop("__feed")
    for rows, told in ((posts, None), (feeds, category("title"))):  # posts of labs have no category
        parts.append(log_rows(rows, F.col("domain"), "feeds", group_key=F.col("feed_name"), kind=F.col("kind"), entity_key=F.coalesce("id", "title", "link"), pos=F.col("pos"), title=F.col("title"), text=F.col("summary"), link=F.col("link"), payload=payload(rows), **({} if told is None else {"category": told})))

    pages = text_diff(old["page_items"], new["page_items"], n=120, group=("domain", "page_key"))
    parts.append(log_rows(pages, F.col("domain"), "pages", group_key=F.col("page_key"), kind=F.col("kind"), pos=F.col("pos"), text=F.col("text"), link=F.col("href"), payload=payload(pages)))
    docs = header_diff(old["doc_headers"], new["doc_headers"], group=("domain",))
    parts.append(log_rows(docs, F.col("domain"), "documents", group_key=F.col("doc_name"), kind=F.lit("header_changed"), entity_key=F.col("doc_name"), pos=F.lit(0), text=header_detail(), link=F.col("url"), payload=F.to_json(F.struct(*docs.columns))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def watched(name: str) -> dict[tuple[str, str], Column]:
    """What is counted of a table while it is written: all rows, or those of each page that has a limit."""
    whole = {"products": ("niap", "pcl"), "profiles": ("niap", "pps")}
    if name in whole:
        return {whole[name]: F.count(F.lit(1))}
    pages = [key for limits in (quality.FATAL_LIMITS, quality.WARN_LIMITS) for key in limits if key not in whole.values()]
    return {(d, c): F.count_if((F.col("domain") == d) & (F.col("page_key") == c)) for d, c in pages} if name == "page_items" else {}


def counts(snapshot: Snapshot) -> DataFrame:
    """(domain, collection, n) of what the checks look at."""
    n = lambda df, d, c: df.agg(F.count("*").alias("n")).select(F.lit(d).alias("domain"), F.lit(c).alias("collection"), "n")
    pages = snapshot["page_items"].groupBy("domain", F.col("page_key").alias("collection")).agg(F.count("*").alias("n"))
    return n(snapshot["products"], "niap", "pcl").unionByName(n(snapshot["profiles"], "niap", "pps")).unionByName(pages)


@dataclass
class Store:
    """Snapshots and change logs under one root, by day."""

    spark: SparkSession
    root: str
    collections: tuple[str, ...] = field(default=tuple(SCHEMAS))

    def _folder(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def days(self, table: str = "snapshots/profiles", name: str = "snapshot_date") -> list[str]:
        fs, p = self._folder(f"{self.root}/{table}")
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName().split("=", 1)[1] for s in fs.listStatus(p) if s.getPath().getName().startswith(f"{name}="))

    def write(self, snapshot: Snapshot, day: str) -> DataFrame:
        """Write a day's tables and return (domain, collection, n) of what the checks look at, counted as the rows pass by."""
        found = []
        for name in self.collections:
            table, told = snapshot[name], watched(name)
            observed = Observation(f"{name} {day}") if told else None
            if observed:
                table = table.observe(observed, *(c.alias(f"n{i}") for i, c in enumerate(told.values())))
            table.write.mode("overwrite").parquet(f"{self.root}/snapshots/{name}/snapshot_date={day}")
            if observed:
                found += [(*key, observed.get.get(f"n{i}") or 0) for i, key in enumerate(told)]
        return self.spark.createDataFrame(found, "domain string, collection string, n long")

    def drop(self, day: str) -> None:
        """Take back a day that was never finished."""
        for path in [*(f"snapshots/{n}/snapshot_date={day}" for n in self.collections), f"changes/run_date={day}", f"alerts/run_date={day}", f"published/day={day}"]:
            fs, p = self._folder(f"{self.root}/{path}")
            fs.delete(p, True)

    def finish(self, day: str, version: int = SCHEMA_VERSION) -> None:
        """V4: the one step that commits a day, after all of it is written, published files too; what isn't marked is done again and no reader sees it."""
        fs, p = self._folder(f"{self.root}/finished/snapshot_date={day}/schema_version={version}")
        fs.create(p, True).close()

    def finished(self) -> list[str]:
        return self.days("finished")

    def logged(self, also: str | None = None) -> list[str]:
        """The finished days that have a change log, and the day that is about to be finished."""
        whole = {*self.finished(), also}
        return [d for d in self.days("changes", "run_date") if d in whole]

    def delivered(self, day: str) -> bool:
        fs, p = self._folder(f"{self.root}/delivered/{day}")
        return fs.exists(p)

    def mark_delivered(self, day: str) -> None:
        fs, p = self._folder(f"{self.root}/delivered/{day}")
        fs.create(p, True).close()

    def version(self, day: str | None) -> int | None:
        """The schema version of a day's snapshot."""
        fs, p = self._folder(f"{self.root}/finished/snapshot_date={day}")
        return max((int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p) if "=" in s.getPath().getName()), default=None) if fs.exists(p) else None

    def write_text(self, name: str, text: str) -> None:
        fs, p = self._folder(f"{self.root}/published/{name}")
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def promote(self, day: str) -> None:
        """Copy a finished day's files to the place of the latest; doing it again changes nothing."""
        fs, p = self._folder(f"{self.root}/published/day={day}")
        jvm = self.spark.sparkContext._jvm
        for s in fs.listStatus(p) if fs.exists(p) else ():
            target = jvm.org.apache.hadoop.fs.Path(f"{self.root}/published/{s.getPath().getName()}")
            jvm.org.apache.hadoop.fs.FileUtil.copy(fs, s.getPath(), fs, target, False, True, self.spark.sparkContext._jsc.hadoopConfiguration())

    def read(self, day: str | None) -> Snapshot:
        if day is None:
            return empty_snapshot(self.spark)
        return {n: self.spark.read.schema(SCHEMAS[n]).parquet(f"{self.root}/snapshots/{n}/snapshot_date={day}") for n in self.collections}

    def prior(self, today: str) -> str | None:
        """L2."""
        return max((d for d in self.finished() if d != today), default=None)

    def write_changes(self, changes: DataFrame, day: str) -> None:
        changes.write.mode("overwrite").parquet(f"{self.root}/changes/run_date={day}")

    def write_alerts(self, found: DataFrame, day: str) -> None:
        found.write.mode("overwrite").parquet(f"{self.root}/alerts/run_date={day}")

    def alerts(self, day: str) -> DataFrame:
        """A day's alerts, worked out once."""
        return self.spark.read.parquet(f"{self.root}/alerts/run_date={day}")

    def changes(self, days: list[str]) -> DataFrame:
        if not days:
            return self.spark.createDataFrame([], f"{CHANGE}, run_date date")
        paths = [f"{self.root}/changes/run_date={d}" for d in days]
        return self.spark.read.schema(f"{CHANGE}, run_date date").option("basePath", f"{self.root}/changes").parquet(*paths)

    def rotate(self, keep: int = KEPT) -> list[str]:
        """L3: drop all but the newest ``keep`` days."""
        gone = []
        for table, name in [("finished", "snapshot_date"), *((f"snapshots/{c}", "snapshot_date") for c in self.collections), ("changes", "run_date"), ("alerts", "run_date"), ("published", "day")]:
            for day in self.days(table, name)[:-keep]:
                fs, p = self._folder(f"{self.root}/{table}/{name}={day}")
                fs.delete(p, True)
                gone.append(f"{table}/{day}")
        return gone


def run_daily(store: Store, collect: Callable[[], Snapshot], today: str, send: Callable[[str], None] | None = None, log: Callable[[str], None] = print) -> dict:
    """Guard, collect, write and check, diff, alert, publish, commit, deliver, rotate.

    Nothing of a day is seen before its one commit, and a run that stops before that is done again from the start.  What comes after is
    delivery; a second run of a whole day does what is left of it, else nothing.
    """
    if today in store.finished():
        return {"skipped": True, "sent": deliver(store, today, send)}
    snapshot = empty_snapshot(store.spark) | collect()
    try:
        warnings = quality.require(quality.checks(store.write(snapshot, today)))
    except quality.SnapshotRejected:
        store.drop(today)
        raise
    prior = store.prior(today)
    warnings += schema_warnings(store.version(prior), SCHEMA_VERSION, SCHEMA_VERSION) if prior else []
    found = compute_changes(store.read(prior), store.read(today))
    store.write_changes(found if prior else quality.first_run(found), today)
    changes = store.changes([today])
    told = alerting.alerts(changes)
    store.write_alerts((told if prior else told.limit(0)).drop("run_date"), today)
    metrics = [r.asDict() for r in stats.domain_metrics(changes).orderBy("domain").collect()]
    for m in metrics:
        log(f"[{m['domain']}] page items added: {m['page_items_added']}, documents changed: {m['document_changes']}, feed items new: {m['feed_items_new']}, entities changed: {m['entity_changes']}")
    publish(store, today)
    store.finish(today)
    sent = deliver(store, today, send)
    store.rotate()
    return {"skipped": False, "prior": prior, "warnings": warnings, "alerts": [r.asDict() for r in store.alerts(today).collect()], "metrics": metrics, "sent": sent}


def deliver(store: Store, today: str, send: Callable[[str], None] | None = None) -> bool:
    """Show a finished day's files as the latest and send its alerts, unless that is done already.  If a run stops between the two steps of sending and
    noting it, the message is sent again rather than lost."""
    if store.delivered(today):
        return False
    if today == max(store.finished(), default=None):
        store.promote(today)
    told = store.alerts(today)
    first = [r.asDict() for r in told.orderBy("pos", "source", "title").limit(10).collect()]
    sent = sinks.notify(sinks.chat_message(first, total=told.count()), send)
    store.mark_delivered(today)
    return sent


def publish(store: Store, today: str) -> None:
    """K1-K3: the day's JSON, dashboard and feed, in a folder of the day's own."""
    changes, told = store.changes([today]), store.alerts(today)
    store.write_text(f"day={today}/{today}_diff.json", sinks.as_json(changes))
    store.write_text(f"day={today}/dashboard.html", render(store, today, today))
    items = sinks.rss_items(changes, alert_rows=told)
    store.write_text(f"day={today}/changes.rss", sinks.rss_document(items, "Changes", "https://www.niap-ccevs.org/", "Changes between snapshots"))


def run_weekly(store: Store, n: int = WEEK_FILES, send: Callable[[str], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """The merged log of the last ``n`` days there are, and the merged alerts; published as JSON, and sent as a digest."""
    days = store.logged()[-n:]
    if not days:
        raise FileNotFoundError("no change logs yet")
    log = store.changes(days)
    merged, told = merge.merge_changes(log), merge.merge_alerts(alerting.alerts(log))
    store.write_text(f"{days[-1]}_weekly.json", sinks.weekly_json(merged, told, days))
    if send:
        sinks.notify(sinks.digest_html(sinks.digest_rows(merged), alert_rows=told), send)
    return merged, told


def run_bootstrap(store: Store, collect: Callable[[], Snapshot], today: str) -> None:
    """Write today's snapshot, over an earlier one too; no diff, no rotation."""
    snapshot = empty_snapshot(store.spark) | collect()
    quality.require(quality.checks(counts(snapshot)))
    store.write(snapshot, today)
    store.finish(today)
    store.mark_delivered(today)


def render(store: Store, today: str, generated: str) -> str:
    """K2 for a day's log and the sparklines of the last days."""
    log, days = store.changes([today]), store.logged(today)[-WEEK_FILES:]
    recent = store.changes(days)
    dates = store.spark.createDataFrame([(d,) for d in days], "run_date string").select(F.to_date("run_date").alias("run_date"))
    lines: dict[str, list[int]] = {}
    for r in stats.sparkline(stats.daily_counts(recent, dates)).orderBy("section", "run_date").collect():
        lines.setdefault(r.section, []).append(r.pct)
    totals = stats.totals(log)
    items: dict[str, list[str]] = {}
    named = log.select(stats.section().alias("section"), F.concat_ws(": ", "kind", F.coalesce("title", "group_key", "text")).alias("item"), "pos").filter("section IS NOT NULL")
    for r in named.orderBy("section", "pos", "item").toLocalIterator():
        items.setdefault(r.section, []).append(r.item)
    return sinks.dashboard([r.asDict() for r in totals.orderBy("section").collect()], [r.asDict() for r in stats.roll_up(totals).orderBy("stat").collect()], lines, [r.asDict() for r in store.alerts(today).collect()], generated, items)

