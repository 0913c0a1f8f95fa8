import re

import __spark_entry__ as entry


def test_every_numbered_operator_is_registered():
    names = entry.queries()
    assert sorted({int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))}) == [*range(1, 14)] and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
