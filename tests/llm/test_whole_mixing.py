"""Mixing: the rates don't depend on the order of the rows."""

import random

from docweave.llm import mixing

SCHEMA = "skey string, source_size long, target double, tokens_0 long, tokens_1 long, tokens_2 long"


def test_rates_agree_in_any_order(spark):
    rng = random.Random(61)
    rows = []
    for i in range(40):
        tokens = [rng.randrange(10 ** rng.randrange(1, 8)) for _ in range(3)]
        rows.append((f"0s{i:02}", sum(tokens), sum(tokens) * rng.uniform(0.1, 2.9), *tokens))

    def rates(order):
        return {r["skey"]: tuple(r["rates"]) for r in mixing.balanced(spark.createDataFrame(order, SCHEMA).coalesce(1)).collect()}

    want = rates(rows)
    assert rates(rows[::-1]) == want and rates(sorted(rows, key=lambda r: r[1])) == want
