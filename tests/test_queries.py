"""Every registered query of the engine's own operators against its SQL, or at least run."""

import pytest

from genosieve.plans import registry
from tests import oracle

SQL = registry.oracle_sql()
NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def con(request):
    from tests.conftest import SF

    return oracle.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, con, name):
    df = registry.queries()[name](spark, sf)
    if name in SQL:
        oracle.check(df, con, SQL[name])
    else:
        assert df.count() > 0
