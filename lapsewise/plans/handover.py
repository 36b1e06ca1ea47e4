"""Tables the batch jobs hand to each other, built from one folder of order tables.

Cheap stages stay lazy. Those that several later jobs read (the lines' narrow columns, sale lifetimes,
purchase days, labels, training table) are written once per session in the shared folder, as a monthly run
writes them once and reads them many times.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from lapsewise.functions import fixed
from lapsewise.operators import cleaning, decisions, features, labels, netting, orders, rfm, segments, snapshots
from lapsewise.session import materialise
from lapsewise.sources.retail import sales_lines

_written: dict[tuple[str, str, str], DataFrame] = {}

# The order of the adapter's lines (`netting.ORDER`) by its single columns, so that none is kept and moved twice.
SALES_ORDER = ("invoice_date", "invoice", "line", "part", "supplier", "quantity", "extended_price")


def narrow_sales(lines: DataFrame) -> DataFrame:
    """What netting, labels and features read of the adapter's lines."""
    row = F.col("row_seq")
    return lines.select(
        *cleaning.LINE_COLUMNS, row.l_linenumber.alias("line"), row.l_partkey.alias("part"), row.l_suppkey.alias("supplier"),
        row.l_extendedprice.alias("extended_price"),
    )


class Handover:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _once(self, name: str, build) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _written:
            _written[key] = materialise(build())
        return _written[key]

    @staticmethod
    def forget() -> None:
        """Forget which tables are written, as a new run or the end of a `scratch` block demands."""
        _written.clear()

    # Lazy stages.
    def raw(self, country: bool = False) -> DataFrame:
        return sales_lines(self.spark, self.folder, country)

    def lines(self, country: bool = False) -> DataFrame:
        return cleaning.clean_lines(self.raw(country))

    def purchases(self, policy: str = "fifo", country: bool = False) -> DataFrame:
        return netting.net_purchases(self.lines(country), policy)

    def rfm(self, policy: str = "fifo") -> DataFrame:
        return rfm.rfm_table(netting.net_purchases(self.sales(), policy, SALES_ORDER), rfm.day_after_last(self.sales()))

    def orders(self) -> DataFrame:
        return orders.order_table(self.purchases())

    # Written stages.
    def sales(self) -> DataFrame:
        """The lines in their narrow columns, in `SALES_ORDER`."""
        return self._once("sales", lambda: narrow_sales(self.lines()))

    def lots(self) -> DataFrame:
        return self._once("lots", lambda: netting.lot_lifetimes(self.sales(), SALES_ORDER))

    def days(self) -> DataFrame:
        return self._once("days", lambda: orders.purchase_days_of_lots(self.lots()))

    def labels(self) -> DataFrame:
        return self._once("labels", lambda: labels.snapshot_labels(self.days(), self.snapshots(), dataset_end=self.span()[1]))

    def training(self) -> DataFrame:
        return self._once("training", lambda: features.training_table(
            self.sales(), self.labels(), lots=self.lots(), snapshots=self.snapshots(), check=False
        ))

    def rfm_written(self) -> DataFrame:
        return self._once("rfm", self.rfm)

    # Facts about them.
    def span(self) -> tuple[date, date]:
        return tuple(self.days().agg(F.min("purchase_day"), F.max("purchase_day")).first())

    def snapshots(self, history: int = fixed.HISTORY_DAYS, horizon: int = fixed.HORIZON_DAYS) -> list[date]:
        return snapshots.month_starts(*snapshots.valid_range(*self.span(), history, horizon))

    def scored(self) -> DataFrame:
        """Labelled rows with a model-free score, for the evaluation and decision operators."""
        return self.labels().select(
            "customer_id", "snapshot_date", "churn", F.col("recency_at_snapshot").alias("recency"),
            F.col("history_monetary").alias("customer_value"),
            F.least(F.lit(1.0), F.col("recency_at_snapshot") / 180.0).alias("churn_probability"),
        )

    def holdout(self) -> DataFrame:
        """The scored rows of the last snapshot."""
        return self.scored().filter(F.col("snapshot_date") == F.lit(self.snapshots()[-1]))

    def decisions(self) -> DataFrame:
        return decisions.decision_table(
            self.holdout().select("customer_id", "snapshot_date", "churn_probability"),
            segments.rule_segments(self.rfm_written()),
        )

    def context(self) -> DataFrame:
        """Rule segments with the customer's country and active years."""
        return segments.with_context(
            segments.rule_segments(self.rfm_written()), segments.customer_context(self.purchases(country=True))
        )
