from datetime import datetime, timedelta

BASE = datetime(2026, 7, 28)


def at(minutes: float) -> datetime:
    return BASE + timedelta(minutes=minutes)


def rows(df) -> list[dict]:
    return [row.asDict() for row in df.collect()]


def one(df) -> dict:
    found = rows(df)
    assert len(found) == 1, found
    return found[0]
