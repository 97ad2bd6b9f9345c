"""The share of a task follows neither the size of the tables nor the session's partitions."""

from salesmix import session
from salesmix.llm.common import prepare
from salesmix.sources import retail


def test_parts_follow_the_files(spark, sf_dir):
    names = (session.INITIAL, session.ADVISED, session.SPLIT)
    session.coarse_shuffles(spark)
    before = {name: spark.conf.get(name, None) for name in names}
    path = f"{sf_dir}/lineitem.parquet"
    session.fine_shuffles(spark, *[path] * 3000)
    many = int(spark.conf.get(session.INITIAL))
    session.fine_shuffles(spark, *[path] * 6000)
    assert many > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert abs(int(spark.conf.get(session.INITIAL)) - 2 * many) <= 1
    prepare(spark)  # text operators keep the session's own settings
    assert {name: spark.conf.get(name, None) for name in names} == before


def test_order_lines_are_read_with_them(spark, sf_dir):
    for lines in (retail.sales_lines, retail.hier_lines):
        session.coarse_shuffles(spark)
        lines(spark, sf_dir)
        assert spark.conf.get(session.ADVISED) == f"{session.PARTITION_MB}m"
        assert spark.conf.get(session.SPLIT) == f"{session.SPLIT_MB}m"
    session.coarse_shuffles(spark)
