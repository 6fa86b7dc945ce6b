import os
import sys
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from tillwatch.session import build_session
from tillwatch.sources import schemas


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        **{
            "spark.master": f"local[{os.environ.get('TEST_CPUS', '8')}]",
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


class Maker:
    """Small tables in the declared schemas."""

    def __init__(self, spark):
        self.spark = spark

    def merchants(self, *ids, industry="Retail", tier="LOW"):
        rows = [(i, industry, "CA", datetime(2024, 7, 1).date(), tier) for i in ids]
        return self.spark.createDataFrame(rows, schemas.MERCHANTS)

    def txns(self, *rows):
        """Rows ``(merchant, 'YYYY-MM-DD HH:MM', amount, status, fraud, chargeback)``."""
        full = [
            (f"t{n}", m, datetime.fromisoformat(ts), Decimal(str(amount)), "CARD", status, fraud, back)
            for n, (m, ts, amount, status, fraud, back) in enumerate(rows)
        ]
        return self.spark.createDataFrame(full, schemas.TRANSACTIONS)

    def sla(self, *rows):
        """Rows ``(merchant, 'YYYY-MM-DD HH:MM', breached)``."""
        full = [
            (f"e{n}", m, datetime.fromisoformat(ts), "SETTLEMENT_DELAY", breached)
            for n, (m, ts, breached) in enumerate(rows)
        ]
        return self.spark.createDataFrame(full, schemas.SLA_EVENTS)


@pytest.fixture(scope="session")
def make(spark):
    return Maker(spark)
