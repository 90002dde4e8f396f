"""What a physical plan holds."""


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> int:
    return sum("Exchange" in line and "BroadcastExchange" not in line for line in plan(df).splitlines())
