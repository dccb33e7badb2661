"""What Spark ran: every SQL execution since a mark, inner jobs included."""

import re


class Executions:
    def __init__(self, spark):
        self.spark = spark
        self.store = spark._jsparkSession.sharedState().statusStore()
        self.before = max((e.executionId() for e in self._last()), default=-1)

    def _last(self, n: int = 200) -> list:
        """The last executions. By number, since the store drops the oldest ones of a long session and its count stands still."""
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        held = self.store.executionsList()
        return [held.apply(k) for k in range(max(held.size() - n, 0), held.size())]

    def plans(self) -> list[str]:
        """Descriptions of the final plans."""
        return [e.physicalPlanDescription() for e in self._last() if e.executionId() > self.before]

    def scans(self, table: str) -> int:
        """Scans of a Parquet table in all plans as they were run; a reused exchange or subquery counts once."""
        found = 0
        for text in self.plans():
            details = dict(re.findall(r"\n\((\d+)\) (Scan parquet[^\n]*\n(?:[^\n]+\n)*)", text))
            tree = text.split("\n\n\n")[0]
            final = re.sub(r"== Initial Plan ==.*?(?=\n\n|\Z)", "", tree, flags=re.S) if "== Final Plan ==" in tree else tree
            initial = set(re.findall(r"\((\d+)\)", tree)) - set(re.findall(r"\((\d+)\)", final))
            found += sum(f"{table}.parquet" in said for number, said in details.items() if number not in initial)
        return found

    def copies(self) -> list[str]:
        """Plans that write whole rows of the fact: its line number never belongs to an aggregate."""
        return [text for text in self.plans() if "line_no" in text and "Scan parquet" not in text]
