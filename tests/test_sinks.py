import os
import tempfile

from listenflow.operators import features
from listenflow.sources.sinks import export_features_csv, save_feature_table
from tests.fixture_tables import fixture_tables


def test_csv_export_and_table(spark):
    t = fixture_tables(spark)
    nb = features.notebook_features(t)
    out = os.path.join(tempfile.mkdtemp(prefix="lf-csv-"), "export")
    export_features_csv(nb, out)
    back = spark.read.option("header", True).csv(out)
    assert back.columns == list(features.EXPORT_COLUMNS)
    assert back.count() == nb.count()
    loc = os.path.join(tempfile.mkdtemp(prefix="lf-tbl-"), "t")
    save_feature_table(features.user_day7_features(t), "lf_test_features", path=loc)
    save_feature_table(features.user_day7_features(t).limit(1), "lf_test_features", path=loc)  # ignored
    assert spark.table("lf_test_features").count() == 5
