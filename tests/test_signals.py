"""Patterns found by their literals against all patterns run on every text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from supplymesh.functions import evidence
from supplymesh.operators import signals
from supplymesh.plans.rule_bindings import SAID
from supplymesh.sources import reference_data as R

GROUPS = {"strong": R.STRONG, "medium": R.MEDIUM, "weak": R.WEAK, "against": R.AGAINST}
MORE = ["The factory assembled by hand; foundries including one.", "It PROVIDES\nmemory to buyers", "osat", "outsourced its manufacturing", "sources of many small parts from", "a main supplier", "SERVES AS THE MAIN SUPPLIER FOR", "nothing", "", None]


@pytest.mark.parametrize("pattern, literals", [(r"\bsupplies\b", {"supplies"}), (r"\bmanufactures?(?:\s+\w+){0,8}\s+for\b", {"manufacture"}), (r"(?:made|built)\s+by", {"made", "built"}), (r"a?b*", set()), (r"x+y", {"x"}), (r"(?:a|)c", {"c"})])
def test_needed_literals(pattern, literals):
    assert signals.needed_literals(pattern) == literals


def test_index_runs_no_pattern_too_few():
    r = random.Random(2)
    words = sorted({w for p in [*R.STRONG, *R.MEDIUM, *R.WEAK, *R.AGAINST] for w in re.findall("[a-z]{2,}", p)} | {"by", "for", "to", "the", "Chips"})
    texts = [" ".join(r.choice(words) + r.choice(["", "s", "ed", ","]) for _ in range(r.randint(0, 25))) for _ in range(2000)]
    index = signals.PatternIndex(GROUPS)
    assert not index.always
    told = [index.counts(t) for t in texts]
    assert told == [[sum(re.search(p, t.lower(), re.I) is not None for p in own) for own in GROUPS.values()] for t in texts]
    assert all(sum(x) for x in zip(*told))


def test_with_analysis_is_analysis(spark):
    r = random.Random(3)
    item = lambda: (r.choice(["", "A <b>supplier</b>", None]), "x", r.choice([*SAID, *MORE]))
    rows = [(i, [item() for _ in range(r.randint(0, 3))], "mine") for i in range(60)] + [(60, None, "mine"), (61, [("", "", "")], "mine")]
    df = spark.createDataFrame(rows, "id int, evidence array<struct<title:string,link:string,snippet:string>>, analysis string")
    got = {x["id"]: x["analysis"] for x in signals.with_analysis(df).collect()}
    wanted = {x["id"]: x["a"] for x in df.select("id", evidence.analysis(F.col("evidence")).alias("a")).collect()}
    assert got == wanted and sum(x["score"] > 0 for x in wanted.values()) > 20
    assert signals.with_analysis(df).columns == ["id", "evidence", "analysis"]
