"""The published decision table: complete snapshots only, latest one queryable.

    <root>/customer_scores/snapshot_date=.../run_id=.../   the decisions of one run
    <root>/scoring_runs/                                    one row per run event
    <root>/commits/                                         one numbered commit per completed run

A run writes its own folder and then a commit. Readers see only folders of committed runs, and for each snapshot only
the one with the highest number, so a publication replaces the one before it at the moment its commit appears,
whatever the writers' clocks say, and a failed run is never seen. A run that builds upon the published state
passes the number it read, and is refused when another one was published since.

The files of a run are ranges of customers in order with a bloom filter each, so reading one customer opens the
files whose range and filter admit it.
"""

from __future__ import annotations

from datetime import date, datetime, timezone
from uuid import uuid4

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from lapsewise.functions.checks import require_columns, require_rules, require_unique
from lapsewise.operators.decisions import DECISION_COLUMNS
from lapsewise.sources.commits import CommitLog, Superseded

RUN_SCHEMA = (
    "run_id string, snapshot_date date, model_version string, status string, row_count bigint, "
    "started_at timestamp, completed_at timestamp, error_message string"
)
SCORE_SCHEMA = (
    "customer_id string, segment string, customer_value double, segment_frequency double, churn_probability double, "
    "above_model_threshold int, probability_threshold double, campaign_priority_band string, "
    "campaign_recommended_action string, customer_value_cap double, value_at_risk_score double, probability_rank bigint, "
    "value_at_risk_rank bigint, value_protection_priority_band string, value_protection_recommended_action string, "
    "model_version string, scored_at timestamp, snapshot_date date, run_id string"
)
_LOOKUP = {"parquet.bloom.filter.enabled#customer_id": "true", "parquet.bloom.filter.expected.ndv#customer_id": "100000"}
ORDERINGS = {"churn_probability": "churn_probability", "value_at_risk": "value_at_risk_score"}
STRATEGIES = {"churn_prevention": "churn_probability", "value_protection": "value_at_risk"}


class DecisionStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._commits = CommitLog(spark, f"{self.root}/commits")

    @property
    def _scores(self) -> str:
        return f"{self.root}/customer_scores"

    @property
    def _runs(self) -> str:
        return f"{self.root}/scoring_runs"

    def _log(self, **row) -> None:
        names = [part.strip().split()[0] for part in RUN_SCHEMA.split(",")]
        event = self.spark.createDataFrame([tuple(row.get(n) for n in names)], RUN_SCHEMA)
        event.coalesce(1).write.mode("append").parquet(self._runs)

    def version(self) -> int:
        """The number of the newest commit."""
        return self._commits.last()

    def publish(self, decisions: DataFrame, expected: int | None = None) -> str:
        """Publish one snapshot; returns the run id.

        With `expected`, the `version` that the decisions were made from, a publication since then raises `Superseded`.
        """
        require_columns(decisions, DECISION_COLUMNS, "decisions")
        facts = decisions.agg(
            F.count(F.lit(1)).alias("rows"),
            F.min(F.to_date("snapshot_date")).alias("first"), F.max(F.to_date("snapshot_date")).alias("last"),
            F.min("model_version").alias("version"), F.max("model_version").alias("other"),
        ).first()
        if not facts["rows"]:
            raise ValueError("an empty decision snapshot cannot be published")
        if facts["first"] != facts["last"]:
            raise ValueError("publish exactly one snapshot at a time")
        if facts["version"] != facts["other"]:
            raise ValueError("a snapshot must use exactly one model version")
        require_unique(decisions, ["customer_id"], "decisions")

        run, started = str(uuid4()), datetime.now(timezone.utc).replace(tzinfo=None)
        base = {"run_id": run, "snapshot_date": facts["first"], "model_version": facts["version"], "started_at": started}
        self._log(**base, status="running", row_count=0)
        stamped = decisions.withColumns({"run_id": F.lit(run), "scored_at": F.lit(started)})
        names = [part.strip().split() for part in SCORE_SCHEMA.split(",")]
        typed = stamped.select(*[F.col(n).cast(t).alias(n) for n, t in names])
        try:
            require_rules(decisions, {
                "segment": F.col("segment").isNotNull(), "value": F.col("customer_value") >= 0,
                "probability": F.col("churn_probability").between(0, 1),
            }, "decisions")
            sorted_ = typed.repartitionByRange("customer_id").sortWithinPartitions("customer_id")
            sorted_.write.mode("append").options(**_LOOKUP).partitionBy("snapshot_date", "run_id").parquet(self._scores)
        except Exception as error:
            self._log(**base, status="failed", row_count=0, error_message=str(error))
            raise
        done = datetime.now(timezone.utc).replace(tzinfo=None)
        commit = {"run_id": run, "snapshot_date": facts["first"].isoformat(), "row_count": facts["rows"], "completed_at": done.isoformat()}
        try:
            self._commits.append(commit, expected)
        except Superseded as error:
            self._log(**base, status="failed", row_count=0, error_message=str(error))
            raise
        self._log(**base, status="completed", row_count=facts["rows"], completed_at=done)
        return run

    def runs(self) -> DataFrame:
        """The last event of every run."""
        events = self.spark.read.schema(RUN_SCHEMA).parquet(self._runs)
        order = F.when(F.col("status") == "running", 0).otherwise(1)
        last = events.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in events.columns if c != "run_id"]), order).alias("e"))
        return last.select("run_id", "e.*")

    def _current_run(self, snapshot=None):
        """The last committed run of a snapshot (default: the latest); None when there is none.

        Stores from before there were commits have only their runs' rows, taken by time.
        """
        made = [Row(run_id=e["run_id"], snapshot_date=date.fromisoformat(e["snapshot_date"])) for e in self._commits.entries()]
        wanted = date.fromisoformat(str(snapshot)[:10]) if snapshot is not None else max((r.snapshot_date for r in made), default=None)
        newest = next((r for r in reversed(made) if r.snapshot_date == wanted), None)
        if newest is not None and snapshot is not None:
            return newest
        older = self._run_by_time(snapshot)
        if newest is None or older is not None and older.snapshot_date > newest.snapshot_date:
            return older
        return newest

    def _run_by_time(self, snapshot=None):
        done = self.runs().filter("status = 'completed'")
        if snapshot is not None:
            done = done.filter(F.col("snapshot_date") == F.lit(snapshot))
        return done.orderBy(F.desc("snapshot_date"), F.desc("completed_at"), F.desc("run_id")).first()

    def latest_snapshot_date(self):
        run = self._current_run()
        return None if run is None else run.snapshot_date

    def snapshot(self, snapshot=None) -> DataFrame:
        """Decisions of one snapshot; the literal filters prune to one folder."""
        scores = self.spark.read.schema(SCORE_SCHEMA).parquet(self._scores)
        run = self._current_run(snapshot)
        if run is None:
            return scores.filter(F.lit(False))
        return scores.filter((F.col("snapshot_date") == F.lit(run.snapshot_date)) & (F.col("run_id") == run.run_id))

    def customer(self, customer_id, strategy: str = "churn_prevention") -> DataFrame:
        return strategy_view(self.snapshot().filter(F.col("customer_id") == str(customer_id)), strategy)

    def customers(self, strategy: str = "churn_prevention", limit: int = 50, **filters) -> DataFrame:
        if strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {sorted(STRATEGIES)}")
        return strategy_view(list_decisions(self.snapshot(), order_by=STRATEGIES[strategy], limit=limit, **filters), strategy)


def list_decisions(
    decisions: DataFrame, campaign_priority_band: str | None = None,
    value_protection_priority_band: str | None = None, segment: str | None = None,
    order_by: str = "churn_probability", limit: int = 50,
) -> DataFrame:
    """Filter, order and cut one snapshot's decisions for a work list."""
    if order_by not in ORDERINGS:
        raise ValueError(f"order_by must be one of {sorted(ORDERINGS)}")
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    wanted = {
        "campaign_priority_band": campaign_priority_band, "segment": segment,
        "value_protection_priority_band": value_protection_priority_band,
    }
    for name, value in wanted.items():
        if value is not None:
            decisions = decisions.filter(F.col(name) == value)
    return decisions.orderBy(F.col(ORDERINGS[order_by]).desc(), "customer_id").limit(limit)


def strategy_view(decisions: DataFrame, strategy: str) -> DataFrame:
    """Attach the band and action of the chosen strategy."""
    names = {"churn_prevention": "campaign", "value_protection": "value_protection"}
    if strategy not in names:
        raise ValueError(f"strategy must be one of {sorted(names)}")
    prefix = names[strategy]
    return decisions.withColumns({
        "active_strategy": F.lit(strategy),
        "active_priority_band": F.col(f"{prefix}_priority_band"),
        "active_recommended_action": F.col(f"{prefix}_recommended_action"),
    })


def upgrade_decisions(old: DataFrame) -> DataFrame:
    """Bring a decision table of the earlier layout to the current one."""
    # Old names and the defaults of columns they lack.
    renamed = {
        "risk_band": "campaign_priority_band", "predicted_churn": "above_model_threshold",
        "recommended_action": "campaign_recommended_action",
    }
    defaults = {
        "probability_threshold": F.lit(0.40), "customer_value_cap": F.lit(0.0), "value_at_risk_score": F.lit(0.0),
        "probability_rank": F.lit(0), "value_at_risk_rank": F.lit(0),
        "value_protection_priority_band": F.lit("Standard monitoring"),
        "value_protection_recommended_action": F.lit("Monitor customer value and churn risk"),
    }
    for before, after in renamed.items():
        if before in old.columns and after not in old.columns:
            old = old.withColumnRenamed(before, after)
    return old.withColumns({n: v for n, v in defaults.items() if n not in old.columns})
