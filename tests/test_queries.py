"""Every query against its SQL on the smallest tables."""

import pytest

from sluice.plans import QUERIES, SQL

from .oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    compare(spark, SF, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_admins_are_told_of_every_action(spark):
    """Of votes and reviews, too, and not of bans alone."""
    decided = {r.message_id: r.action for r in QUERIES["rule_decision"](spark, SF).collect()}
    assert {"ban", "withdraw_vote", "review"} <= set(decided.values())
    told = [tuple(r) for r in QUERIES["notify_fanout"](spark, SF).collect()]
    assert sorted(told) == sorted((m, user) for m, action in decided.items() if action != "allow" for user in (7, 9))
