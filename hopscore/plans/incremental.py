"""Reports that follow a store of results: only what has changed since the last report is read and scored again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopscore.model import KEY
from hopscore.operators.report import exact_cells, merge_cells, report_cells
from hopscore.operators.scoring import pair_results
from hopscore.plans.report_text import Report
from hopscore.sources.result_store import ResultStore

STATES = "name string, base string, version long, number long"


class IncrementalReport:
    """Cells of a report beside the state of the results that they were made of.

    ``update`` takes the results that commits have changed since, as they were and as they are now, retracts the cells of the former and
    adds those of the latter. After a new base everything is reported anew. Questions are taken as they are: a changed question needs
    ``rebuild``.
    """

    def __init__(self, store: ResultStore, questions: DataFrame, path: str, dataset: str, fields: list[str]):
        self.store, self.questions, self.path = store, questions, path.rstrip("/")
        self.dataset, self.fields = dataset, fields

    def rebuild(self) -> None:
        state = self.store.state()
        self._keep(self._cells(self.store.merged()), state, 0)

    def update(self) -> None:
        last = self._last()
        if last is None:
            return self.rebuild()
        then, now = (last.base, last.version), self.store.state()
        keys = self.store.changed_since(then)
        if keys is None:
            return self.rebuild()
        if now == then:
            return None
        before, after = (self._cells(self.store.merged(state).join(keys, KEY, "left_semi")) for state in (then, now))
        return self._keep(merge_cells(self.cells(), after, before), now, last.number + 1)

    def cells(self) -> DataFrame:
        return self.store.spark.read.parquet(f"{self.path}/{self._last().name}")

    def report(self) -> Report:
        """The report as of the last ``rebuild`` or ``update``."""
        return Report.of_cells(self.cells(), self.dataset, self.fields)

    def _cells(self, results: DataFrame) -> DataFrame:
        return report_cells(pair_results(results, self.questions), self.fields)

    def _keep(self, cells: DataFrame, state: tuple[str, int], number: int) -> None:
        name = f"cells-{uuid.uuid4().hex}"
        exact_cells(cells).write.parquet(f"{self.path}/{name}")
        line = [(name, *state, number)]
        mode = "overwrite" if number == 0 else "append"
        self.store.spark.createDataFrame(line, STATES).coalesce(1).write.mode(mode).parquet(f"{self.path}/states")

    def _last(self):
        from pyspark.errors import AnalysisException

        try:
            states = self.store.spark.read.schema(STATES).parquet(f"{self.path}/states")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        return states.orderBy(F.desc("number")).limit(1).first()
