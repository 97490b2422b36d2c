"""The engine's questions as functions, run at once or submitted and polled; no server is needed."""

from __future__ import annotations

import uuid
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.operators import scoring, timeseries
from quarrylens.plans import pipeline


class Service:
    """tables: long tables "stocks", "ratios" and "metrics" with a timeframe column, and, for questions, pipeline.Tables."""

    def __init__(self, stocks: DataFrame, ratios: DataFrame, metrics: DataFrame, filings: pipeline.Tables | None = None, workers: int = 4, keep: int = 1000):
        self.stocks, self.ratios_, self.metrics, self.filings = stocks, ratios, metrics, filings
        self._pool, self._tasks, self._keep = ThreadPoolExecutor(workers), {}, keep

    def charts(self, company: str, variables: list[str], timeframe: str = "quarterly") -> list[dict]:
        return _records(timeseries.chart(_at(self.stocks, timeframe), company, variables))

    def ratios(self, company: str, timeframe: str = "quarterly", variables: list[str] | None = None) -> list[dict]:
        return _records(timeseries.ratio_table(_at(self.ratios_, timeframe), company, variables, must_exist=True))

    def performance(self, company: str, period: str, timeframe: str = "quarterly") -> list[dict]:
        """No record for a period that is not there."""
        rows = timeseries.at_period(_at(self.metrics, timeframe), company, period).collect()
        return [{"period": rows[0].period, **{r.metric: r.value for r in rows}}] if rows else []

    def risk_matrix(self, company: str, period: str, timeframe: str = "quarterly", top_n: str = "5") -> dict[str, float | None]:
        """category -> risk. top_n is taken for compatibility and has no effect."""
        v = timeseries.point(_at(self.ratios_, timeframe), company, period).select(F.lit(company).alias("company"), F.lit(period).alias("period"), "metric", "value")
        return {r.category: r.risk for r in scoring.with_gaps(scoring.scores_without_peers(v)).collect()}

    def question(self, company: str, period: str, query: str = "", conversation_id: str | None = None) -> dict[str, Any]:
        if self.filings is None:
            raise ValueError("this service has no filings")
        t = pipeline.answer(self.filings, f"Company: {company}, Period: {period}, Query: {query}", conversation_id=conversation_id)
        return {"final_response": t.answer, "route": t.route, "n_hits": t.n_hits}

    def submit(self, name: str, *args: Any, **kwargs: Any) -> str:
        """The id to poll. Beyond `keep` tasks the oldest finished ones are forgotten."""
        task = uuid.uuid4().hex
        done = [k for k, f in self._tasks.items() if f.done()]
        for old in done[: max(0, len(self._tasks) + 1 - self._keep)]:
            del self._tasks[old]
        self._tasks[task] = self._pool.submit(getattr(self, name), *args, **kwargs)
        return task

    def status(self, task: str) -> dict[str, Any]:
        """processing, completed with data, failed with an error, or unknown."""
        f: Future | None = self._tasks.get(task)
        if f is None:
            return {"status": "unknown"}
        if not f.done():
            return {"status": "processing"}
        return {"status": "failed", "error": repr(f.exception())} if f.exception() else {"status": "completed", "data": f.result()}


def _at(df: DataFrame, timeframe: str) -> DataFrame:
    return df.filter(F.col("timeframe") == timeframe)


def _records(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]
