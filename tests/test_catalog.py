import pytest
from compare import DATA, duck, same

from lodestrata.plans import catalog


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01"])
def data(request):
    folder = f"{DATA}/{request.param}"
    return folder, duck(folder)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_as_sql(spark, data, name):
    folder, con = data
    same(catalog.QUERIES[name](spark, folder), con, catalog.SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
