import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stellwerk.operators import timestamps as t

BERLIN = ZoneInfo("Europe/Berlin")
REF = datetime(2026, 3, 30, 10, 20, 30)


def mask(s):
    s = re.sub(r"\s+", " ", s).strip()
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]", "9", s))


def one(s, ref=REF):
    return t.parse_batch(pa.array([s]), pa.array([mask(s)]), pa.array([ref], pa.timestamp("us")), "Europe/Berlin").to_pylist()[0]


def wall(*a, fold=0):
    """Brute force: a skipped time moves on, of a doubled hour the first."""
    d = datetime(*a, tzinfo=BERLIN, fold=fold)
    return int(d.timestamp())


CASES = [
    ("2025-01-02", wall(2025, 1, 2)), ("2025-01-02T03:04:05Z", 1735787045), ("2025-01-02T03:04:05.999Z", 1735787045), ("2025-01-02T03:04:05+0530", 1735767245),
    ("2025-01-02T03:04:05-05", 1735805045), ("2025-01-02 03:04:05 MESZ", 1735779845), ("20250102T030405Z", 1735787045), ("1735787045", 1735787045), ("1735787045999", 1735787045),
    ("2.1.2025", wall(2025, 1, 2)), ("02.01.25 03:04", wall(2025, 1, 2, 3, 4)), ("Donnerstag, 02.01.2025 03:04", wall(2025, 1, 2, 3, 4)), ("2. Januar 2025, 03:04 Uhr", wall(2025, 1, 2, 3, 4)),
    ("Jan 2, 2025", wall(2025, 1, 2)), ("January 2, 2025", wall(2025, 1, 2)), ("Thu, 02 Jan 2025 03:04:05 +0100", 1735783445), ("01/02/2025 3:04 PM", wall(2025, 1, 2, 15, 4)), ("01/02/2025 12:04 AM", wall(2025, 1, 2, 0, 4)),
    ("2025-01-02T03:04:05+01:00[Europe/Berlin]", 1735783445), ("Heute, 14:18", wall(2026, 3, 30, 14, 18)), ("gestern um 23:10", wall(2026, 3, 29, 23, 10)), ("Heute 4.27", wall(2026, 3, 30, 4, 27)),
    ("vor 8 Std.", int(REF.replace(tzinfo=timezone.utc).timestamp()) - 8 * 3600), ("vor 3 Tagen", wall(2026, 3, 27)), ("posted 5 hours ago", int(REF.replace(tzinfo=timezone.utc).timestamp()) - 5 * 3600),
    ("2026-03-29T02:30:00", wall(2026, 3, 29, 3, 30)), ("2025-10-26T02:30:00", wall(2025, 10, 26, 2, 30)),
    ("31.02.2026", None), ("2026-00-10", None), ("0000-00-00 00:00:00", None), ("2025", None), ("", None), ("-", None), ("demnächst", None), ("1989-12-31", None), ("2101-01-01", None), ("2025-01-02T25:00:00", None), ("x" * 100000, None),
]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_notations(text, expected):
    assert one(text) == expected


@settings(max_examples=300, deadline=None)
@given(st.datetimes(datetime(1990, 1, 2), datetime(2099, 12, 30)))
def test_wall_clock_against_zoneinfo(d):
    d = d.replace(microsecond=0)
    assert one(d.isoformat()) == int(d.replace(tzinfo=BERLIN).timestamp())
    assert one(d.strftime("%d.%m.%Y %H:%M:%S")) == int(d.replace(tzinfo=BERLIN).timestamp())


@settings(max_examples=200, deadline=None)
@given(st.datetimes(datetime(1990, 1, 2), datetime(2099, 12, 30)), st.integers(-14 * 60, 14 * 60))
def test_offsets(d, minutes):
    d = d.replace(microsecond=0)
    z = timezone(timedelta(minutes=minutes))
    assert one(d.replace(tzinfo=z).isoformat()) == int(d.replace(tzinfo=z).timestamp())


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_any_text_is_harmless(s):
    one(s)


def test_frames(spark):
    rows = [("a", "2025-01-02", REF, 1), ("b", None, REF, 2), ("c", "heute", None, 3), ("a", "2025-01-02", REF, 1), ("d", "", REF, None)]
    df = spark.createDataFrame(rows, "job_id string, v string, ref timestamp_ntz, _m int")
    got = t.with_epoch_seconds(df, "v", "ref")
    assert got.columns == ["job_id", "v", "ref", "_m", "epoch_s"]
    assert [r.epoch_s for r in got.orderBy("job_id").collect()] == [wall(2025, 1, 2), wall(2025, 1, 2), None, None, None]
    assert t.with_epoch_seconds(df.limit(0), "v", "ref").count() == 0
    assert {r["mask"]: r.n_parsed for r in t.mask_report(df, "v", "ref").collect()}["9999-99-99"] == 2


def test_tables_are_versioned():
    z = t.zone_table("Europe/Berlin")
    assert z.version and len(z.instants) > 200
