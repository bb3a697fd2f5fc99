"""Every query over the driver's tables against its SQL in DuckDB."""

import pytest

from loomscan.plans.generated import ORACLES, QUERIES

from helpers import SMALL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, same_rows, name):
    same_rows(QUERIES[name](spark, SMALL), ORACLES[name])


def test_others_keep_what_they_count(spark):
    bars = QUERIES["view_distribution_compressed"](spark, SMALL).toPandas()
    whole = QUERIES["view_distribution"](spark, SMALL).toPandas()
    assert bars.groupby("metric")["count"].sum().to_dict() == whole.groupby("metric")["count"].sum().to_dict()
    assert bars.groupby("metric").size().max() <= 20


def test_tokenized_pages_cover_their_texts(spark):
    rows = QUERIES["tokenize_pages"](spark, SMALL).toPandas()
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").toPandas()
    files = rows[rows.region_id.isna()].set_index("path")
    for p in pages.itertuples():
        assert files.loc[f"./{p.page_id}", "offset_end"] == len(p.html)


def test_entry_has_rows():
    import __spark_entry__ as e

    assert set(ORACLES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
