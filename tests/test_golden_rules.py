"""Rules on small tables against the rows that they must give."""

import golden_rules
import pytest


def shown(rows):
    return sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", golden_rules.QUERIES)
def test_rule(spark, name):
    names, rows = golden_rules.ROWS[name]
    got = golden_rules.QUERIES[name](spark, None)
    assert sorted(got.columns) == sorted(names)
    assert shown(got.select(*names).collect()) == shown(rows)
