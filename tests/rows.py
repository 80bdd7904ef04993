"""Helpers of the tests."""


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()
