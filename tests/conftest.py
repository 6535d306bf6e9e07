import os
import sys
import uuid

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from roomledger.session import local_session, shared_dir  # noqa: E402

@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "roomledger-tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g",
    })
    yield session
    session.stop()


@pytest.fixture
def folder(spark):
    return f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"


@pytest.fixture(scope="session")
def bronze_row(spark):
    """Builds bronze frames from a few changed values per row."""
    from roomledger.schemas import BRONZE_SCHEMA

    base = {
        "hotel": "City Hotel", "is_canceled": 0, "lead_time": 10, "arrival_date_year": 2016,
        "arrival_date_month": "July", "arrival_date_week_number": 27,
        "arrival_date_day_of_month": 1, "stays_in_weekend_nights": 1, "stays_in_week_nights": 2,
        "adults": "2", "children": "0", "babies": "0", "meal": "BB", "country": "PRT",
        "market_segment": "Online TA", "distribution_channel": "TA/TO", "is_repeated_guest": 0,
        "previous_cancellations": 0, "previous_bookings_not_canceled": 0,
        "reserved_room_type": "A", "assigned_room_type": "A", "booking_changes": 0,
        "deposit_type": "No Deposit", "agent": "9", "company": None, "days_in_waiting_list": 0,
        "customer_type": "Transient", "adr": "100.00", "required_car_parking_spaces": 0,
        "total_of_special_requests": 0, "reservation_status": "Check-Out",
        "reservation_status_date": None, "_rescued_data": None, "_ingested_at": None,
        "_source_file": None,
    }

    def build(*changes):
        from decimal import Decimal

        rows = []
        for change in changes:
            row = {**base, **change}
            row["adr"] = None if row["adr"] is None else Decimal(row["adr"])
            rows.append(tuple(row[name] for name in BRONZE_SCHEMA.names))
        return spark.createDataFrame(rows, BRONZE_SCHEMA)

    return build
