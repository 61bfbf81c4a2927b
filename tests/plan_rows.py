"""Rows that the nodes of a plan made when it ran."""


def most_rows(df) -> int:
    """The rows of the node that made most of them while df was collected."""
    df.collect()

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            yield from walk(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            yield from walk(node.plan())
        made = node.metrics().get("numOutputRows")
        if made.isDefined():
            yield made.get().value()
        for i in range(node.children().size()):
            yield from walk(node.children().apply(i))

    return max(walk(df._jdf.queryExecution().executedPlan()))
