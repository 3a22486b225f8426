"""Role tables read back from Parquet; views published and materialised."""

from reelstat.operators import revenue
from reelstat.plans import views
from reelstat.sources.roles import roles_from_parquet


def test_roles_round_trip_through_parquet(spark, roles, tmp_path):
    base = str(tmp_path / "roles")
    for name, df in roles.as_dict().items():
        df.write.parquet(f"{base}/{name}")
    back = roles_from_parquet(spark, base)
    want = sorted(map(tuple, revenue.revenue_by_category(roles).collect()))
    got = sorted(map(tuple, revenue.revenue_by_category(back).collect()))
    assert got == want


def test_publish_and_materialise_views(spark, roles, tmp_path):
    names = views.publish_views(spark, roles)
    assert sorted(names) == views.list_published(spark)
    assert len(names) == 8
    paths = views.materialise(spark, roles, str(tmp_path / "views"))
    assert spark.read.parquet(paths["v_category_revenue"]).count() == 2
    assert spark.read.parquet(paths["v_stock_utilisation"]).count() == 3
