import os
import sys
from datetime import date
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from kpiforge.session import get_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"

OL_SCHEMA = ("order_id long, order_date date, ship_date date, region string, state string, "
             "segment string, category string, sub_category string, product_name string, "
             "sales decimal(12,2), discount decimal(6,2), profit decimal(18,4)")


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", shuffle_partitions=4, app_name="kpiforge-tests")
    yield s


def line(order_id, d, region="EAST", sales="10.00", profit="1.0000", discount="0.10",
         segment="Consumer", category="Tech", sub_category="Phones", state="NY", product="P1"):
    return (order_id, d if isinstance(d, date) or d is None else date.fromisoformat(d),
            None, region, state, segment, category, sub_category, product,
            None if sales is None else Decimal(sales), None if discount is None else Decimal(discount),
            None if profit is None else Decimal(profit))


@pytest.fixture
def make_lines(spark):
    def make(rows):
        return spark.createDataFrame(rows, OL_SCHEMA)
    return make
