"""Users, sellers and buyers: ids, defaults, e-mail rules, digests and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commercelake.functions.text import strip
from commercelake.operators.ordered import numbered
from commercelake.operators.skew import salted_join

# Roles and why a registration is refused.
ROLES = ("buyer", "seller", "admin")
NO_CREDENTIALS = "Email and password are required"
BAD_ROLE = "Invalid role"
KNOWN_EMAIL = "Email already registered"
MEMBER_PROGRAM = "Prime-like"


def assign_ids(df: DataFrame, prefix: str, natural_key: str, start: int = 1) -> DataFrame:
    """Sequence ids in natural-key order; the very first one is always prefix123."""
    seq = numbered(df, [natural_key], name="_n").withColumn("_n", F.col("_n") + F.lit(start - 1))
    label = F.when(F.col("_n") == 1, "123").otherwise(F.col("_n").cast("string"))
    return seq.withColumn("id", F.concat(F.lit(prefix), label)).drop("_n")


def tracking_code(seq: Column) -> Column:
    return F.format_string("TRK-%06d", seq)


def normalize_email(col: Column) -> Column:
    return F.lower(strip(F.coalesce(col, F.lit(""))))


def check_registration(df: DataFrame) -> DataFrame:
    """Normalise email and role and add the reason a registration is refused."""
    clean = df.withColumn("email", normalize_email(F.col("email"))).withColumn(
        "role", F.lower(strip(F.coalesce("role", F.lit("buyer"))))
    )
    return clean.withColumn(
        "error",
        F.when((F.col("email") == "") | (F.coalesce("password", F.lit("")) == ""), NO_CREDENTIALS).when(
            ~F.col("role").isin(*ROLES), BAD_ROLE
        ),
    )


def digest(col: Column) -> Column:
    return F.sha2(col, 256)


def requires_mfa(role: Column, mfa_required: bool = True, mfa_for_sellers: bool = True) -> Column:
    return F.lit(mfa_required) & ((role == "admin") | ((role == "seller") & F.lit(mfa_for_sellers)))


def apply_defaults(df: DataFrame, kind: str, flag: str) -> DataFrame:
    """Fill a missing name, e-mail and flag of a seller or buyer record."""
    return df.select(
        "id",
        F.coalesce("name", F.lit(kind)).alias("name"),
        F.coalesce("email", F.concat(F.lower("id"), F.lit("@example.com"))).alias("email"),
        F.coalesce(flag, F.lit(False)).alias(flag),
    )


def default_parent(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Keep a known parent key, else fall back to the first parent."""
    known = parents.select(key, F.lit(True).alias("_known"))
    first = parents.agg(F.min(key)).scalar()
    return (
        children.join(known, key, "left")
        .withColumn("resolved_id", F.when(F.col("_known"), F.col(key)).otherwise(first))
        .drop("_known")
    )


def new_registrations(incoming: DataFrame, registered: DataFrame) -> DataFrame:
    """Add the reason a row is refused: an e-mail is registered once, in the store or in the batch.

    Of a batch's rows for one e-mail the lowest seq wins. It is found with an aggregate,
    so an e-mail repeated very often is reduced before the shuffle.
    """
    mails = incoming.withColumn("email", normalize_email(F.col("email")))
    taken = registered.select(normalize_email(F.col("email")).alias("email")).distinct()
    firsts = mails.groupBy("email").agg(F.min("seq").alias("seq")).join(taken, "email", "left_anti")
    firsts = firsts.withColumnRenamed("seq", "_first")
    fresh = F.col("_first").isNotNull() & (F.col("seq") == F.col("_first"))
    return salted_join(mails, firsts, ["email"], "left").withColumn("reason", F.when(~fresh, KNOWN_EMAIL)).drop("_first")


def apply_subscriptions(buyers: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Membership after a subscription log (buyer_id, seq, program): a buyer's last program
    decides, buyers without an entry keep their flag."""
    last = subscriptions.groupBy("buyer_id").agg(F.max_by("program", "seq").alias("_program"), F.lit(True).alias("_logged"))
    member = F.coalesce(F.col("_program") == MEMBER_PROGRAM, F.lit(False))
    return (
        buyers.join(last, "buyer_id", "left")
        .withColumn("is_prime", F.when(F.col("_logged"), member).otherwise(F.col("is_prime")))
        .drop("_program", "_logged")
    )


def summary(**tables: DataFrame) -> DataFrame:
    """One row with the row count of each table."""
    parts = [df.select(F.lit(name).alias("entity")) for name, df in tables.items()]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionAll(part)
    return union.agg(*[F.count_if(F.col("entity") == name).alias(name) for name in tables])
