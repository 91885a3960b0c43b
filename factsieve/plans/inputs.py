"""Inputs the reports derive from the given tables; nothing is written back."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factsieve.sources.io import PARTITIONS, read_table

# Characters per text delta.
DELTA_CHARS = 256


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), "text", "source", "lang"
    )


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "pages").select(
        F.col("page_id").alias("id"), F.col("html").alias("text")
    )


def contacts(spark: SparkSession, folder: str) -> DataFrame:
    """Per customer a text with an SSN, a card, a phone and an email made from the key."""
    k = F.col("c_custkey")

    def digits(n: Column, width: int) -> Column:
        return F.lpad((n % 10**width).cast("string"), width, "0")

    text = F.concat(
        F.lit("SSN "), digits(k, 3), F.lit("-"), digits(k, 2), F.lit("-"), digits(k, 4),
        F.lit(", card 4111-"), digits(k * 3, 4), F.lit("-"), digits(k * 7, 4), F.lit("-"),
        digits(k, 4), F.lit(", phone "), digits(k, 3), F.lit("."), digits(k * 3, 3), F.lit("."),
        digits(k * 7, 4), F.lit(" or tel("), digits(k, 3), F.lit(") 555-"), digits(k, 4),
        F.lit(", mail user"), k.cast("string"), F.lit("@mail"), (k % 7).cast("string"),
        F.lit(".example.com"),
    )
    # One row group may hold millions of customers, and a scan gives it to one task. So the keys are
    # dealt out before texts are made of them, to a number of tasks that does not depend on the file.
    tasks = int(spark.conf.get(PARTITIONS, "0")) or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return read_table(spark, folder, "customer", tasks).select(k.alias("id"), text.alias("text"))


def claims(spark: SparkSession, folder: str) -> DataFrame:
    """Per order an answer that states its total in one of twelve ways, and a context."""
    key, total = F.col("o_orderkey"), F.col("o_totalprice")
    plain = F.format_number(total, 2)
    stated = (
        F.when(key % 12 == 0, plain)
        .when(key % 12 == 1, F.concat(F.format_number(total / 1000, 5), F.lit(" thousand")))
        .when(key % 12 == 2, F.format_number(total + 0.005, 3))
        .when(key % 12 == 3, F.format_number(total + 5, 2))
        .when(key % 12 == 4, F.translate(plain, ",.", ".,"))
        .when(key % 12 == 5, F.concat(F.format_number(total / 1e6, 8), F.lit(" Million")))
        .when(key % 12 == 6, F.concat(F.format_number(total / 1e9, 11), F.lit(" billion")))
        .when(key % 12 == 7, F.concat(F.lit("±"), plain))
        .when(key % 12 == 8, F.concat(F.lit("-"), plain))
        .when(key % 12 == 9, F.concat(F.lit("+"), plain, F.lit(" %")))
        .when(key % 12 == 10, F.concat(plain, F.lit("%")))
        .otherwise(F.lit("not stated"))
    )
    mail = F.when(
        key % 10 == 0, F.concat(F.lit(" Mail user"), key.cast("string"), F.lit("@example.com"))
    ).otherwise(F.lit(""))
    context = F.when(key % 7 == 0, F.lit("")).otherwise(
        F.concat(F.lit("Total "), plain, F.lit(", order "), key.cast("string"))
    )
    return read_table(spark, folder, "orders").select(
        key.alias("request_id"),
        F.concat(
            F.lit("Order "), key.cast("string"), F.lit(" total "), stated, F.lit(" in all."), mail
        ).alias("text"),
        context.alias("context"),
    )


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Context snippets, many per order: its lines' prices and, mostly, its total."""
    lines = read_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("request_id"),
        F.concat(F.lit("Line price "), F.format_number("l_extendedprice", 2)).alias("text"),
    )
    totals = (
        claims(spark, folder)
        .where("context <> ''")
        .select("request_id", F.col("context").alias("text"))
    )
    return lines.unionByName(totals)


def as_deltas(docs: DataFrame) -> DataFrame:
    """Each text cut into pieces; every third session starts with a batch of ids only."""
    first = F.when(F.col("id") % 3 == 0, 1).otherwise(0)
    pieces = F.transform(
        F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA_CHARS}}}"), F.lit(0)),
        lambda p, i: F.struct(
            (i + first).cast("bigint").alias("seq"),
            F.array().cast("array<bigint>").alias("token_ids"),
            p.alias("text_delta"),
        ),
    )
    ids_only = F.when(
        first == 1,
        F.array(
            F.struct(
                F.lit(0).cast("bigint").alias("seq"),
                F.array(F.col("id")).alias("token_ids"),
                F.lit("").alias("text_delta"),
            )
        ),
    ).otherwise(F.slice(pieces, 1, 0))
    return docs.select(
        F.col("id").cast("string").alias("session_id"), F.inline(F.concat(ids_only, pieces))
    )


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a token log per user; errors clear the user's window."""
    return read_table(spark, folder, "events").select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("seq"),
        F.col("event_id").alias("token_id"),
        (F.col("event_id") * 10).alias("position"),
        (F.col("event_type") == "error").alias("is_reset"),
    )
