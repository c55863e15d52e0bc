"""Access rules: what a token may read, write or delete."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import kind_name
from tidemark.schema import ACTIONS, TOKENS

ANY = ("any", "")


@dataclass(frozen=True)
class Config:
    """Settings of an archive; anonymous visitors may do anything unless told otherwise."""

    listen_addr: str = "127.0.0.1:8080"
    database: str = ""
    secret_key: str | None = None
    anonymous: dict[str, tuple[str, str]] = field(default_factory=lambda: dict.fromkeys(ACTIONS, ANY))


def allowed(kind: Column, perms: Column, slug: Column) -> Column:
    """Kinds: 0 none, 1 any, 2 a list of slugs, 3 a prefix of slugs; an unknown kind allows nothing."""
    return F.coalesce(
        F.when(kind == 1, True).when(kind == 2, F.array_contains(F.split(perms, ","), slug)).when(kind == 3, slug.startswith(perms)), F.lit(False)
    )


def resolve(requests: DataFrame, tokens: DataFrame, config: Config = Config(), action: str = "read") -> DataFrame:
    """requests (token, slug, ...) with the kind and perms that hold for them; a token that isn't known gets those of an anonymous visitor."""
    if action not in ACTIONS:
        raise ValueError(f"action is one of {ACTIONS}")
    from tidemark.functions.scalars import KINDS

    name, perms = config.anonymous[action]
    number = KINDS.index(name) if name in KINDS else 0
    mine = tokens.select(F.col("token").alias("_token"), F.col(f"{action}_perms_kind").cast("int").alias("_kind"), F.col(f"{action}_perms").alias("_perms"))
    both = requests.join(mine, requests["token"] == F.col("_token"), "left")
    known = F.col("_token").isNotNull()
    return both.select(*[requests[c] for c in requests.columns], F.when(known, F.col("_kind")).otherwise(number).alias("kind"), F.when(known, F.col("_perms")).otherwise(perms).alias("perms"))


def check(requests: DataFrame, tokens: DataFrame, config: Config = Config(), action: str = "read") -> DataFrame:
    """requests with ``allowed``."""
    done = resolve(requests, tokens, config, action)
    return done.withColumn("allowed", allowed(F.col("kind"), F.col("perms"), F.col("slug"))).drop("kind", "perms")


def readable(records: DataFrame, collections: DataFrame, tokens: DataFrame, token: str, config: Config = Config()) -> DataFrame:
    """Records of the collections that a token may read."""
    asked = collections.select("uuid", "slug", F.lit(token).alias("token"))
    open_ = check(asked, tokens, config).where("allowed").select(F.col("uuid").alias("collection"))
    return records.join(open_, "collection", "left_semi").select(records.columns)


def new_token(spark: SparkSession, comment: str = "", **perms) -> DataFrame:
    """A token row; for each action ``<action>_any``, ``<action>_list``, ``<action>_prefix`` are looked at in this order."""
    row: list = [str(uuid.uuid4()), comment]
    kinds, texts = [], []
    for a in ACTIONS:
        if perms.get(f"{a}_any"):
            kind, text = 1, ""
        elif perms.get(f"{a}_list") is not None:
            kind, text = 2, ",".join(perms[f"{a}_list"])
        elif perms.get(f"{a}_prefix") is not None:
            kind, text = 3, perms[f"{a}_prefix"]
        else:
            kind, text = 0, ""
        kinds.append(kind)
        texts.append(text)
    return spark.createDataFrame([(*row, *kinds, *texts)], TOKENS)


def delete_token(tokens: DataFrame, token: str) -> DataFrame:
    return tokens.where(~F.col("token").eqNullSafe(token))


def list_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens with each permission as ``kind(perms)``."""
    shown = [F.concat(kind_name(F.col(f"{a}_perms_kind")), F.lit("("), F.coalesce(f"{a}_perms", F.lit("")), F.lit(")")).alias(a) for a in ACTIONS]
    return tokens.select("token", "comment", *shown)
