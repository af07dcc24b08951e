"""Every registered query of the transforms against its SQL; those without SQL must give rows."""

import pytest

from tessera.queries import FAMILIES
from tests.compare import connection, difference

SF = "/root/testdata/sf0.001"
NAMES = [(f, n) for f in FAMILIES for n in f.QUERIES]


@pytest.fixture(scope="module")
def db():
    return connection(SF)


@pytest.mark.parametrize("family,name", NAMES, ids=[n for _, n in NAMES])
def test_query(spark, db, family, name):
    if name in family.SQL:
        assert difference(spark, db, SF, family.QUERIES[name], family.SQL[name]) is None
    else:
        assert family.QUERIES[name](spark, SF).count() > 0
