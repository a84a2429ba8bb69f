"""Fitting on a stream: counts, means and squares of each micro-batch are merged into running ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.scalers import MinMaxScale, StandardScore

STATE = "last long, n long, mean double, m2 double, low double, high double"


class RunningMoments:
    """Use `update` as the function of writeStream.foreachBatch. A repeated batch number is passed over.

    With `path`, a folder that outlives the driver, the state is written behind each batch, and a new object goes on
    from the last one written there.
    """

    def __init__(self, column: str, path: str | None = None):
        self.column, self.path = column, path
        self.last, self.n, self.mean, self.m2, self.low, self.high = -1, 0, 0.0, 0.0, float("inf"), float("-inf")
        if path is not None:
            self._restore(SparkSession.getActiveSession())

    def _restore(self, spark: SparkSession) -> None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
            row = spark.read.schema(STATE).parquet(self.path).orderBy(F.desc("last")).first()  # a row a batch
            if row is not None:
                vars(self).update(row.asDict())

    def update(self, batch: DataFrame, number: int) -> None:
        if number <= self.last:
            return
        x = F.col(self.column).cast("double")
        r = batch.agg(F.count(x), F.avg(x), F.var_pop(x), F.min(x), F.max(x)).first()
        self.last = number
        if r[0]:
            n, d = self.n + r[0], r[1] - self.mean
            self.m2 += r[2] * r[0] + d * d * self.n * r[0] / n
            self.mean += d * r[0] / n
            self.n, self.low, self.high = n, min(self.low, r[3]), max(self.high, r[4])
        if self.path is not None:
            row = tuple(getattr(self, c.split()[0]) for c in STATE.split(", "))
            batch.sparkSession.createDataFrame([row], STATE).coalesce(1).write.mode("append").parquet(self.path)

    def standard_score(self, ddof: int = 1) -> StandardScore:
        out = StandardScore(ddof)
        out.finish({"n": self.n, "mean": self.mean, "var": self.m2 / self.n if self.n else None})
        return out

    def min_max(self) -> MinMaxScale:
        out = MinMaxScale()
        out.finish({"low": self.low if self.n else None, "high": self.high})
        return out
