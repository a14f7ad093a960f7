"""Pages equal slices of the fully ordered result (hypothesis)."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from chatlens.plans import conversations, messages, users
from chatlens.sources.fixtures import from_testdata
from tests.conftest import SF_SMALL


def _key_desc_nulls_first(ts, ident):
    # DESC NULLS FIRST, then id ASC
    return (0 if ts is None else 1, -(ts.timestamp() if ts else 0), ident)


@pytest.fixture(scope="module")
def full(spark):
    t = from_testdata(spark, SF_SMALL)
    m = sorted(((r.timestamp, r.id) for r in t.messages.select("timestamp", "id").collect()),
               key=lambda x: _key_desc_nulls_first(*x))
    c = sorted(((r.last_message_at, r.id) for r in
                t.conversations.select("last_message_at", "id").collect()),
               key=lambda x: _key_desc_nulls_first(*x))
    u = sorted(((r.last_active, r.id) for r in t.users.select("last_active", "id").collect()),
               key=lambda x: _key_desc_nulls_first(*x))
    return t, [i for _, i in m], [i for _, i in c], [i for _, i in u]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(limit=st.integers(1, 200), offset=st.integers(0, 1200))
def test_pages_are_slices(full, limit, offset):
    t, m, c, u = full
    assert [r.id for r in messages.messages_list(t, limit=limit, offset=offset).collect()] == \
        m[offset:offset + limit]
    assert [r.id for r in conversations.conversations_list(t, limit=limit, offset=offset)
            .collect()] == c[offset:offset + limit]
    assert [r.id for r in users.users_list(t, limit=limit, offset=offset).collect()] == \
        u[offset:offset + limit]
