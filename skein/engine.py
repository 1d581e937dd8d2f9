"""The engine: ingest, resolve, export and health over a log in a folder.

The log is the truth: the catalog is what its replay gives, so a restart, a rebuild and a running engine agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import fallback_tokens, family_tokens, full_codes
from skein.operators import commit, resolve
from skein.operators.evidence import critical_dims, precedence, wide
from skein.operators.graph import checkpointed
from skein.plans import export
from skein.sources import events as E
from skein.sources import log
from skein.sources.adapters import Adapter, extract
from skein.sources.policy import Policy, built_in, infer_category


class Engine:
    def __init__(self, spark: SparkSession, log_path: str, policies: dict[str, Policy] | None = None, adapters: list[Adapter] | None = None) -> None:
        self.spark, self.log_path, self.adapters = spark, log_path, adapters
        self.policies = policies or built_in()
        self._catalog: dict[str, DataFrame] | None = None

    def ingest(self, events: DataFrame) -> dict[str, int]:
        """Appends the events that the log lacks; counters of what was delivered. Repeats change nothing."""
        seen = log.read(self.spark, self.log_path)
        batch = log.delivered(events.select(*E.COLUMNS, *(c for c in events.columns if c == "ord")), seen, self.adapters)
        old = checkpointed(log.related(seen, batch)) if seen is not None else None
        found = log.statuses(batch, old).withColumn("mode", E.effective_mode(F.col("operation"), F.col("update_mode"))).withColumn("reason", log.reason(F.col("status"), F.col("adapter"), F.col("x")))
        counts = log.counters(found).first().asDict()
        stored = log.store(batch, old, self.log_path)
        self._catalog = None
        return counts | {"stored": stored}

    def catalog(self) -> dict[str, DataFrame]:
        """The catalog of the whole log, worked out once until the next ingest."""
        if self._catalog is None:
            found = log.read(self.spark, self.log_path)
            if found is None:
                raise ValueError("the log is empty")
            made = commit.catalog(found.select(*E.COLUMNS, "seq"), self.policies, self.adapters)
            self._catalog = commit.tables(made["entities"]) | {"quarantine": made["quarantine"], "components": made["components"]}
        return self._catalog

    def tables(self) -> dict[str, DataFrame]:
        return {k: self.catalog()[k] for k in commit.KINDS}

    def resolve(self, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Decisions for ``requests(listing, payload)``, and the offers of matched variants; the catalog stays as it is."""
        snap = resolve.snapshot(self.tables())
        # extraction is one large expression, and each key's join reads the requests: both are worked out once
        asked = checkpointed(resolve.rooted(checkpointed(self.requests(requests)), snap["roots"]))
        found = resolve.decide(asked, *map(checkpointed, resolve.candidates(asked, snap)), snap["variants"])
        return found, resolve.offers_for(found, self.tables()["offer"])

    def requests(self, requests: DataFrame) -> DataFrame:
        """Requests as listings: evidence of highest rank, category, dimensions, keys."""
        x = extract(requests.select("listing", F.lit("browser_resolve").alias("source"), "payload"), self.adapters)
        long = x.select("listing", F.posexplode("x.attrs").alias("ord", "a")).select("listing", "ord", "a.*")
        held = x.select("listing", "x.*").join(wide(precedence(long)), "listing", "left")
        held = held.withColumn("attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>"))).withColumn("category", infer_category(F.map_keys("attributes"), F.col("title")))
        ids = F.filter("identifiers", lambda i: i["canonical"].isNotNull() & (i["validity"] != "malformed"))
        coded = F.filter(ids, lambda i: i["ns"] == "mpn")
        tokens = F.array_distinct(F.concat(family_tokens(F.col("title")), F.flatten(F.transform(coded, lambda i: family_tokens(i["raw"])))))
        return critical_dims(held, self.policies).select(
            "listing", "category", F.try_element_at("attributes", F.lit("generation")).alias("generation"), "dims", "product_type",
            F.transform(F.filter(ids, lambda i: (i["scope"] == "exact_variant") & i["ns"].isin("gtin", "mpn")), lambda i: F.concat_ws(":", i["ns"], i["canonical"])).alias("pin_keys"),
            F.array_distinct(F.concat(full_codes(F.col("title")), F.transform(coded, lambda i: i["canonical"]))).alias("code_keys"),
            F.when(F.size(tokens) > 0, tokens).otherwise(fallback_tokens(F.col("title"), F.col("brand"))).alias("token_keys"), (F.size(tokens) > 0).alias("coded"),
        )

    def export(self, path: str) -> None:
        export.write(self.tables(), self.catalog()["quarantine"], path)

    def health(self) -> dict[str, int]:
        found = log.read(self.spark, self.log_path)
        if found is None:
            return {"status": "ok", "events": 0}
        counts = {r["entity"]: r["n"] for r in export.stats(self.tables(), self.catalog()["quarantine"]).collect()}  # one row a table
        return {"status": "ok", "events": found.count()} | counts
