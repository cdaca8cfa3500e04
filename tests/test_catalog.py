"""Every query with SQL gives the rows of that SQL; the others give rows."""

import pytest
from compare import connect, differences

from skyquilt.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLE:
        assert differences(df, catalog.ORACLE[name], con, 1e-6) == ""
    else:
        assert df.count() > 0


def test_names_match():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)


def test_pair_power_spectra_reads_every_cell(spark, monkeypatch):
    seen, real = [], catalog.spectra.pair_spectra
    monkeypatch.setattr(catalog.spectra, "pair_spectra", lambda a, b, keys, shape, *rest: seen.append((a, shape)) or real(a, b, keys, shape, *rest))
    assert catalog.pair_power_spectra(spark, SF).count() > 0
    cells, shape = seen[0]
    whole = catalog.grid(spark, SF)
    assert whole.where("ri = 10").count() > 0 and cells.count() == whole.count()
    assert all(cells.where(f"{c} < 0 or {c} >= {n}").isEmpty() for c, n in zip(("fi", "ri", "di"), shape))
