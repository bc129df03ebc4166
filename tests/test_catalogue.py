"""Every query with SQL gives the SQL's rows; the others run and give rows."""

import pytest

from canopyforge.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, data, same, name):
    same(catalogue.queries()[name](spark, data), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_gives_rows(spark, data, name):
    assert catalogue.queries()[name](spark, data).count() > 0


def test_flagship(spark, data):
    assert catalogue.flagship(spark, data).count() == 600
