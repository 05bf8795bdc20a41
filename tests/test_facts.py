"""Consistency of facts: every kind of conflict, with its places."""

import pytest

from docquarry import catalog
from docquarry.operators import facts
from docquarry.plans.consistency import ORDER, RULES


def test_every_kind_is_met(spark):
    got = catalog.QUERIES["m13_report"](spark, "/root/testdata/sf0.01").groupBy("conflict").count().collect()
    assert {r.conflict for r in got} == {"amount", "number", "party", "role", "order", "locked"}


@pytest.mark.parametrize(
    ("texts", "locked", "want"),
    [
        (["Quote: 10", "Quote: 10.0 and Quote: 10"], {}, [("amount", "quote", "10,10.0", "0:0 1:0")]),
        (["Manager: Ann, Manager: Bo", "Manager: Ann"], {}, [("role", "manager", "Ann,Bo", "0:0 0:1")]),
        (["Ref PRJ-1", "Ref. PRJ-1"], {}, []),
        (["submission on 2024-03-02, opening on 2024-03-01"], {}, [("order", "submission<opening", "2024-03-02,2024-03-01", "")]),
        (["submission on 2024-03-01, opening on 2024-03-01"], {}, []),
        (["opening on 2024-02-30, submission on 2024-03-02", "opening on 2024-03-05"], {}, []),  # no such day
        (["opening on 2024-03-05", "opening on 2024-03-01", "submission on 2024-03-02"], {}, []),  # the first one counts
        (["submission on 2024-03-02, opening on 2024-03-03"], {"opening": "2024-03-01"}, [("locked", "opening", "2024-03-03", "0:0"), ("order", "submission<opening", "2024-03-02,2024-03-01", "")]),
        (["award on 2024-05-01"], {"service": "2024-04-01"}, [("order", "award<service", "2024-05-01,2024-04-01", "")]),
        ([None, ""], {"service": "2024-04-01"}, []), ([], {}, []),
    ],
)
def test_conflicts(spark, texts, locked, want):
    sections = spark.createDataFrame([(p, i, t) for p in (1, 2) for i, t in enumerate(texts)], "project long, section long, text string")
    fixed = spark.createDataFrame([(1, k, v) for k, v in locked.items()], "project long, key string, value string")
    got = [tuple(r)[1:] for r in facts.report(sections, RULES, fixed, ORDER).where("project = 1").collect()]
    assert sorted(got) == want


def test_facts_of_one_pass(spark):
    df = spark.createDataFrame([(None, 3, "Quote: 5 Quote: 6 award on 2024-01-01")], "project long, section long, text string")
    assert sorted(map(tuple, facts.occurrences(df, RULES).collect()), key=str) == [(None, "amount", "quote", "5", 3, 0), (None, "amount", "quote", "6", 3, 1), (None, "date", "award", "2024-01-01", 3, 0)]
