"""What a query plans to do and what it did."""

import re
import uuid


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def columns_read(text):
    return set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<([^>]*)", text).group(1)))


def _children(node):
    seq = node.children()
    return [seq.apply(i) for i in range(seq.size())]


def _reads_unreduced(node):
    """Whether rows reach this node from a file without an aggregate or a limit in between."""
    name = node.nodeName()
    if "Aggregate" in name or "Limit" in name or "TakeOrdered" in name:
        return False
    if "Scan" in name:
        # sums that a report stores on the way are reduced already
        kinds = ("/loans-", "/clean_loans-", "/staging-", "csv")
        return any(kind in node.toString() for kind in kinds)
    return any(_reads_unreduced(c) for c in _children(node))


def _windows(node):
    if node.nodeName() == "Window":
        yield node
    for child in _children(node):
        yield from _windows(child)


def has_window_over_rows(df):
    root = df._jdf.queryExecution().sparkPlan()
    return any(_reads_unreduced(w.children().apply(0)) for w in _windows(root))


def run(spark, df, size=False):
    """Collected rows, rows read from files and rows (or bytes) shuffled by all stages that ran for it.

    ``df`` may be a function that makes the frame, so that what it stores on the way counts.
    """
    group = f"work-{uuid.uuid4()}"
    spark.sparkContext.setJobGroup(group, "rows read")
    rows = (df() if callable(df) else df).collect()
    tracker = spark.sparkContext.statusTracker()
    store = spark._jsparkSession.sparkContext().statusStore()
    stages = {i for j in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(j).stageIds}
    ran = [s for s in map(store.lastStageAttempt, stages) if s.numCompleteTasks() > 0]
    shuffled = (s.shuffleWriteBytes() if size else s.shuffleWriteRecords() for s in ran)
    return rows, sum(s.inputRecords() for s in ran), sum(shuffled)
