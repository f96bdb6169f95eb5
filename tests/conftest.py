import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from oracle.compare import session

    return session("4")


REQUEST_DEFAULTS = {
    "request_id": 7000, "date": "2021-03-14", "reporting_org_id": 5, "reporting_org": "Kite Agency",
    "copyright_owner_id": 77, "copyright_owner": "Nordlys Film", "urls_specified": 40,
    "urls_removed": 24, "urls_no_action": 6, "urls_not_in_index": 8, "urls_pending": 2,
    "removal_rate": 0.6, "from_abuser": False, "lumen_url": None,
}
REQUEST_TYPES = (
    "request_id long, date date, reporting_org_id long, reporting_org string, "
    "copyright_owner_id long, copyright_owner string, urls_specified long, urls_removed int, "
    "urls_no_action int, urls_not_in_index int, urls_pending int, removal_rate double, "
    "from_abuser boolean, lumen_url string"
)


def day(text):
    return None if text is None else dt.date.fromisoformat(text)


@pytest.fixture(scope="session")
def make_requests(spark):
    """Request rows with defaults for what a test leaves out."""

    def build(*rows):
        full = [{**REQUEST_DEFAULTS, **r} for r in rows]
        data = [tuple(day(v) if k == "date" else v for k, v in r.items()) for r in full]
        return spark.createDataFrame(data, REQUEST_TYPES)

    return build


@pytest.fixture(scope="session")
def make_dated_domains(spark):
    """(request_id, date, domain, removal_rate) rows."""

    def build(*rows):
        data = [
            (r.get("request_id", 7000), day(r.get("date", "2021-03-14")), r.get("domain", "kino.no"),
             r.get("removal_rate", 0.6)) for r in rows
        ]
        return spark.createDataFrame(
            data, "request_id long, date date, domain string, removal_rate double"
        )

    return build
