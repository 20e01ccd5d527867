"""Payment ledgers: the CSV scan with its contract, and the canonical table that every operator reads.

Canonical columns: ``row_id, ts, account_from, account_to, amount_received, receiving_currency, amount_paid, payment_currency,
payment_format, is_laundering, base_received, base_paid``.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgersift.config import DataSpec, SchemaError, UnknownCurrencyError
from ledgersift.functions.scalars import in_base
from ledgersift.scratch import Scratch
from ledgersift.skew import global_order

#: The file's first line, fixed by its publisher. Two columns share a name: sender first, receiver second.
HEADER = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering"
RAW = T.StructType(
    [
        T.StructField(n, t)
        for n, t in (
            ("stamp", T.StringType()), ("bank_from", T.StringType()), ("number_from", T.StringType()), ("bank_to", T.StringType()), ("number_to", T.StringType()),
            ("amount_received", T.DoubleType()), ("receiving_currency", T.StringType()), ("amount_paid", T.DoubleType()), ("payment_currency", T.StringType()),
            ("payment_format", T.StringType()), ("is_laundering", T.ByteType()),
        )
    ]
)
STAMP = "yyyy/MM/dd HH:mm"


@dataclass(frozen=True)
class Ingested:
    """The loaded ledger and what its loading counted."""

    transactions: DataFrame
    accounts: DataFrame
    rows: int
    n_accounts: int
    self_transfers: int
    laundering_rows: int
    laundering_dropped: int


def assert_header(spark: SparkSession, path: str) -> None:
    try:
        lines = spark.read.text(path).limit(1).collect()
    except Exception as e:
        raise SchemaError(f"{path} cannot be read: {str(e)[:200]}") from e
    first = lines[0][0].strip() if lines else ""
    if first != HEADER:
        raise SchemaError(f"{path}: header is {first!r}, expected {HEADER!r}")


def account_key(bank: str, number: str) -> Column:
    return F.concat_ws("|", F.col(bank), F.col(number))


def codebook(raw: DataFrame, scratch: Scratch) -> DataFrame:
    """``account_key, account``: ids in order of first appearance, senders' column before receivers'."""
    sides = raw.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("row_id"), F.col("key_from").alias("account_key")), F.struct(F.lit(1).alias("side"), F.col("row_id"), F.col("key_to").alias("account_key")))).alias("s")).select("s.*")
    first = sides.groupBy("account_key").agg(F.min(F.struct("side", "row_id")).alias("seen"))
    parts = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return global_order(first, [F.col("seen.side"), F.col("seen.row_id"), F.col("account_key")], "account", scratch, "codebook", parts).select("account_key", "account")


def in_file_order(raw: DataFrame, scratch: Scratch) -> DataFrame:
    """``raw`` with ``row_id`` in the order of files by name, and of rows inside them: Spark deals the pieces of files out by size.

    ``at`` rises inside a piece (file, block); what is collected to order the pieces is a row for each.
    """
    pieces = raw.groupBy("file", "block").agg(F.min("at").alias("least"), F.max("at").alias("most"))
    starts, seen = [], 0
    for r in sorted(pieces.collect(), key=lambda r: (r["file"], r["block"])):
        starts.append((r["file"], r["block"], seen - r["least"]))
        seen += r["most"] - r["least"] + 1
    known = raw.sparkSession.createDataFrame(starts, "file string, block long, shift long")
    return scratch.save(raw.join(F.broadcast(known), ["file", "block"]).withColumn("row_id", F.col("at") + F.col("shift")).drop("file", "block", "at", "shift"), "raw")


def load_csv(spark: SparkSession, path: str, *, drop_self_transfers: bool = True) -> Ingested:
    """Read, check and encode a ledger file."""
    scratch = Scratch(spark, "ingest")
    assert_header(spark, path)
    raw = spark.read.schema(RAW).option("header", True).option("enforceSchema", True).option("mode", "FAILFAST").csv(path)
    raw = raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.to_timestamp("stamp", STAMP).alias("ts"),
        account_key("bank_from", "number_from").alias("key_from"),
        account_key("bank_to", "number_to").alias("key_to"),
        *RAW.fieldNames()[5:],
    )
    raw = in_file_order(scratch.save(raw, "scanned"), scratch)
    book = codebook(raw, scratch)
    coded = raw.join(book.select(F.col("account_key").alias("key_from"), F.col("account").alias("account_from")), "key_from").join(
        book.select(F.col("account_key").alias("key_to"), F.col("account").alias("account_to")), "key_to"
    )
    own = F.col("key_from") == F.col("key_to")
    bad = F.col("is_laundering") == 1
    counts = raw.agg(F.count("*").alias("rows"), F.count_if(own).alias("own"), F.count_if(bad).alias("bad"), F.count_if(own & bad).alias("own_bad")).first()
    kept = (coded.filter("account_from <> account_to") if drop_self_transfers else coded).drop("key_from", "key_to")
    dropped = counts["own_bad"] if drop_self_transfers else 0
    return Ingested(kept, book, counts["rows"], book.count(), counts["own"], counts["bad"] - dropped, dropped)


def validate_contract(loaded: Ingested, spec: DataSpec) -> None:
    """Compare the counts with the file's contract; all differences in one message."""
    pairs = (
        ("rows", loaded.rows, spec.expected_rows), ("accounts", loaded.n_accounts, spec.expected_accounts),
        ("self transfers", loaded.self_transfers, spec.expected_self_transfers), ("laundering rows", loaded.laundering_rows + loaded.laundering_dropped, spec.expected_laundering_rows),
    )
    wrong = [f"{name}: {got}, expected {want}" for name, got, want in pairs if got != want]
    if wrong:
        raise SchemaError("the ledger breaks its contract: " + "; ".join(wrong))


def normalise(txns: DataFrame, rates: Mapping[str, float], *, checked: bool = True) -> DataFrame:
    """Both amounts in base currency, each side by its own currency. Unknown currencies are refused, null gives null."""
    if checked:
        known = list(rates)
        pairs = txns.select(F.explode(F.array("receiving_currency", "payment_currency")).alias("c")).distinct()
        unknown = sorted(r[0] for r in pairs.filter(F.col("c").isNotNull() & ~F.col("c").isin(known)).limit(100).collect())
        if unknown:
            raise UnknownCurrencyError(f"no rate for {unknown}")
    return txns.withColumns({
        "base_received": in_base(F.col("amount_received"), F.col("receiving_currency"), rates),
        "base_paid": in_base(F.col("amount_paid"), F.col("payment_currency"), rates),
    })


def usable_span(txns: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return txns.filter((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end)))


def observed_span(txns: DataFrame) -> DataFrame:
    """First and last timestamp, and the days between."""
    return txns.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).withColumn("span_days", F.round((F.unix_timestamp("last_ts") - F.unix_timestamp("first_ts")) / F.lit(86400.0), 6))


def events_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger view of the test tables' ``events``, self-transfers included (see FIXTURES.md B1)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    users = events.agg(F.max("user_id")).first()[0]
    span = 4 * (users + 1) if users is not None else 4
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("row_id"),
        F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("ts"),
        F.col("user_id").alias("account_from"),
        F.pmod(F.col("user_id") * 7 + k * 13 + 1, F.lit(span)).alias("account_to"),
        F.col("value").alias("amount_received"),
        F.when(kind == "click", "Euro").when(kind == "view", "US Dollar").when(kind == "purchase", "UK Pound").when(kind == "signup", "Yen").otherwise("Swiss Franc").alias("receiving_currency"),
        (F.col("value") * 1.01).alias("amount_paid"),
        F.when(F.col("event_id") % 3 == 1, "Euro").when(F.col("event_id") % 3 == 2, "US Dollar").otherwise("Swiss Franc").alias("payment_currency"),
        kind.alias("payment_format"),
        F.when((kind == "error") & (F.col("value") > 100), 1).otherwise(0).alias("is_laundering"),
    )


def trade_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger view of ``lineitem`` joined to ``orders`` (see FIXTURES.md B2): no row identity, six times the rows."""
    lines, orders = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet")
    joined = lines.join(orders.select("o_orderkey", "o_custkey"), lines.l_orderkey == orders.o_orderkey)
    return joined.select(
        (F.col("l_shipdate").cast("timestamp") + F.make_interval(hours=F.col("l_linenumber"))).alias("ts"),
        F.col("o_custkey").alias("account_from"), (F.col("l_suppkey") * 15).alias("account_to"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount_received"), F.lit("Euro").alias("receiving_currency"),
        (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("amount_paid"), F.lit("US Dollar").alias("payment_currency"),
        F.col("l_returnflag").alias("payment_format"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_discount") >= 0.1), 1).otherwise(0).alias("is_laundering"),
    )
