"""Adapters fail on rows outside their span."""

import pytest
from pyspark.sql import functions as F

from checks.fixtures import hourly, supplier_days

SF = "/root/testdata/sf0.001"


def test_rows_outside_the_span_are_an_error(spark, tmp_path):
    assert hourly(spark, SF).count() and supplier_days(spark, SF).count()
    for name, column, adapter in (("events", "ts", hourly), ("lineitem", "l_shipdate", supplier_days)):
        table = spark.read.parquet(f"{SF}/{name}.parquet")
        kind = table.schema[column].dataType
        late = table.limit(1).withColumn(column, F.lit("2031-01-01").cast("timestamp").cast(kind))
        table.unionByName(late).write.parquet(f"{tmp_path}/{name}.parquet")
        with pytest.raises(Exception, match="row outside"):
            adapter(spark, str(tmp_path)).agg(F.sum("v")).collect()
