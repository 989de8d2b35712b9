"""Handles of the queries that one stream operator runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.streaming import StreamingQuery


@dataclass(frozen=True)
class Running:
    """The main query and the query of the rows that it leaves out; both are stopped, awaited and asked together."""

    main: StreamingQuery
    rejects: StreamingQuery

    @property
    def queries(self) -> tuple[StreamingQuery, StreamingQuery]:
        return self.main, self.rejects

    @property
    def isActive(self) -> bool:  # noqa: N802  (named as StreamingQuery names it)
        return any(q.isActive for q in self.queries)

    def awaitTermination(self) -> None:  # noqa: N802
        for q in self.queries:
            q.awaitTermination()

    def processAllAvailable(self) -> None:  # noqa: N802
        for q in self.queries:
            q.processAllAvailable()

    def stop(self) -> None:
        for q in self.queries:
            q.stop()
