"""What the driver holds and plans stays small: few links are closed in one job, and no plan is made of many copies of another."""

from pagewright.llm import components, lines, near
from pagewright.llm.common import Scratch


def tables_of(monkeypatch):
    """The plans of all tables that are written from now on, as they are."""
    made, table = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, *a: made.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange ")) or table(self, df, *a))
    return made


def test_few_links_are_closed_by_one_table(spark, monkeypatch):
    made = tables_of(monkeypatch)
    for pairs, kind in (([(k, k + 1) for k in range(-40, 40)], "long"), ([(bytes([k]), bytes([k + 1])) for k in range(250)], "binary")):
        made.clear()
        got = components.components(Scratch(spark), spark.createDataFrame(pairs, f"a {kind}, b {kind}"))
        least = min(a for a, _ in pairs)
        assert sorted(map(tuple, got.collect())) == sorted((b, least) for _, b in pairs)
        assert len(made) == 2 and made[1] == 0  # the distinct edges, and their components


def test_rounds_end_in_one_task_once_few_links_are_left(spark, monkeypatch):
    pairs = [(k, k + 1) for k in range(12)] * 2 + [(100, 101)]
    table = spark.createDataFrame(pairs, "a long, b long")
    monkeypatch.setattr(components, "SMALL", 5)
    assert sorted(map(tuple, components.components(Scratch(spark), table).collect())) == [*((k, 0) for k in range(1, 13)), (101, 100)]


def test_plans_of_blocks_have_few_exchanges(spark, monkeypatch):
    made = tables_of(monkeypatch)
    text = lambda k: " ".join(f"w{x}" for x in range(k, k + 60))
    docs = spark.createDataFrame([(k, text(3 * k)) for k in range(30)], "doc_id long, text string")
    lines.deduplicated(docs).collect()
    near.one_of_each(docs).collect()
    assert made and max(made) <= 12
