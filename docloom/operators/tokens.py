"""Service tokens: a table in which the last row of a token wins; only hashes of tokens are kept."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import ledger
from docloom.operators.jobs import Log, now

# Fixed values.
NAME = "[a-z0-9][a-z0-9-]{1,63}"
OPERATIONS = ("search", "write")
MIN_TOKEN = 32
MANAGED_SERVICE = "easyflow"
TOKEN = "seq long, token_id string, service_id string, token_hash string, grants string, requests_per_minute int, active boolean, at string"
ASKED = "service_id string, token_id string, token string, grants map<string,array<string>>, requests_per_minute int"


def problem(kinds: dict[str, str]) -> Column:
    """The first rule that a row of ASKED breaks, or null. kinds: corpus id -> name of its kind."""
    kind_of = F.create_map(*(F.lit(x) for item in kinds.items() for x in item)) if kinds else F.lit(None).cast("map<string,string>")
    each, managed = F.map_entries("grants"), F.col("service_id") == MANAGED_SERVICE
    kind = lambda g: F.element_at(kind_of, F.lower(X.strip(g["key"])))
    known = lambda g: kind(g).isNotNull() & (F.size(g["value"]) > 0) & (F.size(F.array_except(g["value"], F.array(*map(F.lit, OPERATIONS)))) == 0)
    rules = {
        "name": F.col("service_id").rlike(f"^{NAME}$") & F.col("token_id").rlike(f"^{NAME}$"),
        "token": (F.length("token") >= MIN_TOKEN) & (F.col("token") == X.strip(F.col("token"))),
        "grants": (F.size(each) > 0) & (F.col("requests_per_minute") >= 1) & F.forall(each, known),
        "managed corpora and the managed service belong together": F.forall(each, lambda g: (kind(g) == MANAGED_SERVICE) == managed),
    }
    return F.coalesce(*(F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()))


class Tokens:
    """kinds: corpus id -> name of its kind, as the registry has it."""

    def __init__(self, spark: SparkSession, root: str, kinds: dict[str, str]):
        self.log, self.kinds = Log(spark, f"{root.rstrip('/')}/tokens", TOKEN), kinds

    def table(self) -> DataFrame:
        """Each token's last row, grants as a map."""
        return ledger.latest_by(self.log.table(), "token_id").withColumn("grants", F.from_json("grants", "map<string,array<string>>"))

    def register(self, service_id: str, token_id: str, token: str, grants: dict[str, list[str]], requests_per_minute: int = ledger.DEFAULT_RPM) -> None:
        """Also replaces a token of this id, and makes it active again."""
        one = self.log.spark.createDataFrame([(service_id, token_id, token, grants, requests_per_minute)], ASKED)
        refused = self.register_all(one).first()
        if refused is not None:
            raise ValueError(refused["problem"])

    def register_all(self, asked: DataFrame) -> DataFrame:
        """Append the tokens of a table (ASKED) that break no rule, all in one write; returns service_id, token_id, problem of the others."""
        judged = asked.withColumn("problem", problem(self.kinds))
        slugs = F.transform_keys("grants", lambda k, _: F.lower(X.strip(k)))
        good = judged.filter("problem IS NULL").select(
            "token_id", "service_id", F.sha2("token", 256).alias("token_hash"), F.to_json(F.transform_values(slugs, lambda _, v: F.array_sort(F.array_distinct(v)))).alias("grants"),
            "requests_per_minute", F.lit(True).alias("active"), F.lit(now()).alias("at"),
        )
        self.log.append_all(good, "token_id")
        return judged.filter("problem IS NOT NULL").select("service_id", "token_id", "problem")

    def revoke(self, token_id: str) -> bool:
        row = ledger.latest_by(self.log.table(), "token_id").filter(F.col("token_id") == token_id).first()
        if row is None:
            return False
        self.log.append(**(row.asDict() | {"active": False, "at": now()}))
        return True

    def listed(self) -> DataFrame:
        return self.table().select("service_id", "token_id", "requests_per_minute", "active").orderBy("service_id", "token_id")

    def service_of(self, token: str) -> str | None:
        row = self.table().filter((F.col("token_hash") == hashlib.sha256(token.encode()).hexdigest()) & F.col("active")).first()
        return row["service_id"] if row else None
