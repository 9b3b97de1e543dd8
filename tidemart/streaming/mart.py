"""The whole mart as named streaming jobs over one root folder.

    python -m tidemart.streaming.mart ROOT JOB [--every "5 seconds"]

Feeds come from `ROOT/feed/log` and `ROOT/feed/db` (JSON text) or, with `--kafka SERVERS`, from the
topics of the same names. Facts land in `ROOT/fact`, dimensions in `ROOT/dim`, summaries in
`ROOT/summary`. Every job has its own checkpoint. Without `--every` a job takes what is there and
stops, so a scheduler can run the jobs in turn; the two `settled` jobs wait on the clock and run
only with it.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from tidemart import schemas as S
from tidemart.operators.logs import parse_text
from tidemart.operators.lookups import Dictionary
from tidemart.operators.visits import BOUNCE_GAP_MS, RETURN_DAYS
from tidemart.operators.windows import SIZE
from tidemart.plans import facts, summaries
from tidemart.session import build
from tidemart.sources import feeds
from tidemart.streaming import jobs, live, rules, sinks


@dataclass
class Mart:
    """Where things are, and the settings of the rules."""

    spark: SparkSession
    root: str
    kafka: str | None = None
    files_per_trigger: int | None = None
    offsets_per_trigger: int | None = None
    size: str = SIZE
    gap_ms: int = BOUNCE_GAP_MS
    return_days: int = RETURN_DAYS
    hold_ms: int = 5_000
    #: how late versions may come; with it details settle on event time instead of the clock
    settle_delay: str | None = None
    live_dictionary: bool = False
    #: the routing config changes while the dimension job runs, by the feed `routing`
    live_routing: bool = False
    order_bounds: facts.Bounds = field(default_factory=facts.Bounds)
    payment_bounds: facts.Bounds = facts.PAYMENT_BOUNDS

    def feed(self, name: str) -> DataFrame:
        if self.kafka:
            limit = ({"maxOffsetsPerTrigger": str(self.offsets_per_trigger)}
                     if self.offsets_per_trigger else None)
            return feeds.topic_text(self.spark, self.kafka, name, options=limit)
        return feeds.folder_text(self.spark, f"{self.root}/feed/{name}", stream=True,
                                 files_per_trigger=self.files_per_trigger)

    def changes(self, *tables: str) -> dict[str, DataFrame]:
        """Changes of the tables named, as `change_tables` has stored them."""
        return feeds.stored_changes(self.spark, f"{self.root}/fact/changes", *tables,
                                    files_per_trigger=self.files_per_trigger)

    def log_stream(self, name: str, stream: bool = True) -> DataFrame:
        """A stream of the behaviour log, as `log_streams` has stored it."""
        return feeds.stored_stream(self.spark, f"{self.root}/fact/log", name, stream=stream,
                                   files_per_trigger=self.files_per_trigger)

    def fact(self, name: str) -> DataFrame:
        rows = feeds.table_rows(self.spark, f"{self.root}/fact/{name}", stream=True,
                                files_per_trigger=self.files_per_trigger)
        return rows.drop("batch")

    def settled(self, name: str, key: str) -> DataFrame:
        if self.settle_delay is None:
            return rules.settled(self.fact(name), key, hold_ms=self.hold_ms)
        return jobs.settled_details(self.fact(name), key, hold_ms=self.hold_ms,
                                    delay=self.settle_delay)

    def dictionary(self) -> Dictionary:
        """The dictionary table; with `live_dictionary`, as its changes in `dim/dictionary_changes`
        (dic_code, dic_name, version) make it while the job runs."""
        stored = feeds.dictionary(self.spark, f"{self.root}/dim/dictionary").select(
            "dic_code", "dic_name")
        if not self.live_dictionary:
            return stored
        changes = feeds.table_rows(self.spark, f"{self.root}/dim/dictionary_changes",
                                   live.ENTRY, stream=True, files_per_trigger=self.files_per_trigger)
        return lambda rows, code, name: live.named_live(rows, changes, stored, code, name)

    def routing(self) -> DataFrame:
        return feeds.routing(self.spark, f"{self.root}/dim/routing")

    def dimension(self, name: str) -> DataFrame:
        return sinks.dimension(self.spark, f"{self.root}/dim", f"dim_{name}")

    def products(self) -> dict[str, DataFrame]:
        return {"sku": self.dimension("sku_info"), "spu": self.dimension("spu_info"),
                "trademark": self.dimension("base_trademark"),
                **{f"category{level}": self.dimension(f"base_category{level}")
                   for level in (1, 2, 3)}}

    def to_fact(self, rows: DataFrame, name: str) -> DataStreamWriter:
        return sinks.to_files(rows, f"{self.root}/fact/{name}")

    def to_summary(self, rows: DataFrame, name: str, keys: Sequence[str] = (),
                   mode: str = "append",
                   finish: Callable[[DataFrame], DataFrame] | None = None) -> DataStreamWriter:
        return sinks.to_upserts(rows, f"{self.root}/summary/{name}", ["stt", *keys], mode=mode,
                                finish=finish)

    def summary(self, name: str, keys: Sequence[str] = ()) -> DataFrame:
        return sinks.current(self.spark, f"{self.root}/summary/{name}", ["stt", *keys])


Job = Callable[[Mart], DataStreamWriter]
JOBS: dict[str, Job] = {}


def job(make: Job) -> Job:
    JOBS[make.__name__] = make
    return make


# Jobs with processing-time timers: they always have a next micro-batch and never run out, unless
# details settle on event time.
ON_THE_CLOCK = ("order_settled", "payment_settled")


def run(mart: Mart, name: str, every: str | None = None) -> StreamingQuery:
    if name in ON_THE_CLOCK and every is None and mart.settle_delay is None:
        raise ValueError(f"{name} needs a trigger interval")
    return sinks.start(JOBS[name](mart), f"{mart.root}/checkpoint/{name}", every)


# --- dimensions and log ------------------------------------------------------------------------

@job
def dimensions(mart: Mart) -> DataStreamWriter:
    sinks.create_targets(mart.spark, f"{mart.root}/dim", mart.routing())
    # which tables are routed is known per micro-batch only, so this job reads them all
    log = feeds.table_rows(mart.spark, f"{mart.root}/fact/changes", S.ENVELOPE, stream=True,
                           files_per_trigger=mart.files_per_trigger)
    if mart.live_routing:
        return sinks.to_routed_dimensions(
            log, feeds.routing_changes(mart.feed("routing")), f"{mart.root}/dim",
            f"{mart.root}/dim/routing_history", mart.routing())
    return sinks.to_dimensions(log, f"{mart.root}/dim", mart.routing)


@job
def change_tables(mart: Mart) -> DataStreamWriter:
    """The raw change feed is parsed here and nowhere else."""
    return sinks.to_change_tables(feeds.change_log(mart.feed("db")).filter("table IS NOT NULL"),
                                  f"{mart.root}/fact/changes")


@job
def log_streams(mart: Mart) -> DataStreamWriter:
    clean = parse_text(mart.feed("log")).clean
    return sinks.to_log_streams(rules.repair_new_visitors(clean), f"{mart.root}/fact/log")


@job
def log_rejects(mart: Mart) -> DataStreamWriter:
    return mart.to_fact(parse_text(mart.feed("log")).dirty, "log_rejects")


@job
def change_rejects(mart: Mart) -> DataStreamWriter:
    return mart.to_fact(feeds.change_log_checked(mart.feed("db"))[1], "change_rejects")


@job
def unique_visitor(mart: Mart) -> DataStreamWriter:
    return mart.to_fact(rules.daily_visitors(mart.log_stream("page")), "unique_visitor")


@job
def bounce(mart: Mart) -> DataStreamWriter:
    return mart.to_fact(rules.bounces(mart.log_stream("page"), mart.gap_ms), "bounce")


# --- facts from the change log -----------------------------------------------------------------

@job
def cart_add(mart: Mart) -> DataStreamWriter:
    return mart.to_fact(facts.cart_add(mart.changes("cart_info"), mart.dictionary()), "cart_add")


@job
def order_wide(mart: Mart) -> DataStreamWriter:
    return mart.to_fact(facts.order_wide(mart.changes(*facts.ORDER_TABLES), mart.dictionary(),
                                         mart.order_bounds), "order_wide")


@job
def order_detail(mart: Mart) -> DataStreamWriter:
    return mart.to_fact(facts.order_detail(mart.fact("order_wide")), "order_detail")


@job
def order_cancel(mart: Mart) -> DataStreamWriter:
    return mart.to_fact(facts.order_cancel(mart.fact("order_wide")), "order_cancel")


@job
def payment_success(mart: Mart) -> DataStreamWriter:
    return mart.to_fact(facts.payment_success(
        mart.changes("payment_info"), mart.fact("order_detail"), mart.dictionary(),
        mart.payment_bounds),
        "payment_success")


@job
def refund_request(mart: Mart) -> DataStreamWriter:
    return mart.to_fact(facts.refund_request(mart.changes("order_refund_info", "order_info"),
                                             mart.dictionary(), mart.order_bounds),
                        "refund_request")


@job
def refund_paid(mart: Mart) -> DataStreamWriter:
    log = mart.changes("refund_payment", "order_info", "order_refund_info")
    return mart.to_fact(facts.refund_paid(log, mart.dictionary(), mart.order_bounds), "refund_paid")


@job
def coupon_get(mart: Mart) -> DataStreamWriter:
    return mart.to_fact(facts.coupon_get(mart.changes("coupon_use")), "coupon_get")


@job
def coupon_order(mart: Mart) -> DataStreamWriter:
    return mart.to_fact(facts.coupon_order(mart.changes("coupon_use")), "coupon_order")


@job
def coupon_pay(mart: Mart) -> DataStreamWriter:
    return mart.to_fact(facts.coupon_pay(mart.changes("coupon_use")), "coupon_pay")


@job
def favor_add(mart: Mart) -> DataStreamWriter:
    return mart.to_fact(facts.favor_add(mart.changes("favor_info")), "favor_add")


@job
def comment_add(mart: Mart) -> DataStreamWriter:
    return mart.to_fact(facts.comment_add(mart.changes("comment_info"), mart.dictionary()), "comment_add")


@job
def user_register(mart: Mart) -> DataStreamWriter:
    return mart.to_fact(facts.user_register(mart.changes("user_info")), "user_register")


@job
def order_settled(mart: Mart) -> DataStreamWriter:
    """One settled version per order detail, shared by the three order summaries."""
    return mart.to_fact(mart.settled("order_detail", "id"), "order_settled")


@job
def payment_settled(mart: Mart) -> DataStreamWriter:
    return mart.to_fact(mart.settled("payment_success", "order_detail_id"), "payment_settled")


# --- summaries ---------------------------------------------------------------------------------

@job
def keyword_window(mart: Mart) -> DataStreamWriter:
    return mart.to_summary(jobs.keyword_window(mart.log_stream("page"), mart.size), "keyword",
                           ["keyword"], "update")


TRAFFIC_KEYS = ("version", "channel", "area", "is_new")


@job
def traffic_window(mart: Mart) -> DataStreamWriter:
    rows = jobs.traffic_window(mart.log_stream("page"), mart.fact("bounce"), mart.fact("unique_visitor"),
                               mart.size, mart.gap_ms)
    return mart.to_summary(rows, "traffic", TRAFFIC_KEYS, "update")


@job
def home_detail_window(mart: Mart) -> DataStreamWriter:
    return mart.to_summary(jobs.home_detail_window(mart.log_stream("page"), mart.size), "home_detail")


@job
def login_window(mart: Mart) -> DataStreamWriter:
    return mart.to_summary(jobs.login_window(mart.log_stream("page"), mart.size, mart.return_days),
                           "login")


@job
def register_window(mart: Mart) -> DataStreamWriter:
    return mart.to_summary(jobs.register_window(mart.fact("user_register"), mart.size), "register",
                           mode="update")


@job
def cart_user_window(mart: Mart) -> DataStreamWriter:
    return mart.to_summary(jobs.cart_user_window(mart.fact("cart_add"), mart.size), "cart_user")


@job
def order_window(mart: Mart) -> DataStreamWriter:
    return mart.to_summary(jobs.order_window(mart.fact("order_settled"), mart.size), "order")


@job
def payment_window(mart: Mart) -> DataStreamWriter:
    return mart.to_summary(jobs.payment_window(mart.fact("payment_settled"), mart.size), "payment")


# Names are looked up per micro-batch, after the aggregation, in the dimensions as they are then.

@job
def province_window(mart: Mart) -> DataStreamWriter:
    rows = jobs.province_counts(mart.fact("order_settled"), mart.size)
    return mart.to_summary(rows, "province", ["province_id"], finish=lambda batch:
                           summaries.province_names(batch, mart.dimension("base_province")))


BRAND_KEYS = ("trademark_id", "category3_id", "user_id")


@job
def user_spu_window(mart: Mart) -> DataStreamWriter:
    rows = jobs.user_spu_counts(mart.fact("order_settled"), mart.dimension("sku_info"), mart.size)
    return mart.to_summary(rows, "user_spu", [*BRAND_KEYS, "spu_id"], finish=lambda batch:
                           summaries.user_spu_names(batch, mart.products()))


@job
def brand_refund_window(mart: Mart) -> DataStreamWriter:
    rows = jobs.brand_refund_counts(mart.fact("refund_request"), mart.dimension("sku_info"),
                                    mart.size)
    return mart.to_summary(rows, "brand_refund", BRAND_KEYS, finish=lambda batch:
                           summaries.brand_names(batch, mart.products()))


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("root")
    parser.add_argument("job", choices=sorted(JOBS))
    parser.add_argument("--kafka", help="bootstrap servers; feeds are folders when left out")
    parser.add_argument("--every", help="trigger interval, such as '5 seconds'")
    parser.add_argument("--time-zone", default="UTC")
    parser.add_argument("--window", default=SIZE)
    parser.add_argument("--max-files", type=int, help="files of a micro-batch at most")
    parser.add_argument("--max-offsets", type=int, help="messages of a micro-batch at most")
    chosen = parser.parse_args(arguments)
    mart = Mart(build(time_zone=chosen.time_zone), chosen.root.rstrip("/"), chosen.kafka,
                files_per_trigger=chosen.max_files, offsets_per_trigger=chosen.max_offsets,
                size=chosen.window)
    run(mart, chosen.job, chosen.every).awaitTermination()


if __name__ == "__main__":
    main()
