import pytest

from spanforge import catalogue, catalogue_live, oracles, oracles_live
from tests.compare import assert_same, oracle
from tests.conftest import DATA


QUERIES, ORACLES = catalogue.QUERIES | catalogue_live.QUERIES, oracles.ORACLES | oracles_live.ORACLES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    got = QUERIES[name](spark, f"{DATA}/sf0.001").toPandas()
    if name in ORACLES:
        assert_same(got, oracle(ORACLES[name], "sf0.001"))
    else:
        assert name == "detect_segments" and len(got)


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())


def test_scan_prunes_and_pushes_down(spark):
    plan = catalogue.hit_filter(spark, f"{DATA}/sf0.001")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(value), GreaterThanOrEqual(value,2.0)]" in plan and "props" not in plan.split("Physical Plan")[1]


def conversation_turns():
    table = oracle("SELECT conv_id, turn, text FROM conversations ORDER BY conv_id, turn", "sf0.001")
    return [(c, list(zip(rows.turn, rows.text))) for c, rows in table.groupby("conv_id")]


def test_rolling_dedupe_folds_whole_texts(spark):
    want = []
    for conv, turns in conversation_turns():
        out = []
        for turn, text in turns:
            s, e, t = turn * 2.0, turn * 2.0 + 2, text.strip(" ")
            if not t or (out and t in out[-1][3]):
                continue
            if out and out[-1][3] in t and s - out[-1][1] < 3:
                out[-1] = (out[-1][0], out[-1][1], e, t)
            else:
                out.append((turn, s, e, t))
        want += [(conv, *x) for x in out]
    got = catalogue.rolling_dedupe(spark, f"{DATA}/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert max(len(r.t) for r in got) > 3


def test_context_has_each_turn_as_a_span_with_all_rows_near_it(spark):
    want = []
    for conv, turns in conversation_turns():
        for span, _ in turns:
            parts = {"before": [], "span": [], "after": []}
            for turn, _ in turns:
                if turn * 10 + 8 >= span * 10 - 20 and turn * 10 <= span * 10 + 8 + 20:
                    parts["before" if turn * 10 + 8 < span * 10 else "span" if turn * 10 <= span * 10 + 8 else "after"].append(turn)
            rows = [("before", parts["before"][-12:]), ("span", parts["span"][:40]), ("after", parts["after"][:12])]
            want += [(conv, span, turn, part) for part, found in rows for turn in found]
    got = catalogue.context_before_span_after(spark, f"{DATA}/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_interval_matches_pairs_all_of_a_users_intervals(spark):
    rows = oracle("SELECT user_id, event_id, event_type, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value * 60000000) AS BIGINT) AS e FROM events WHERE event_type IN ('click', 'view') ORDER BY event_id", "sf0.01")
    want, midnights = {}, 0
    for user, mine in rows.groupby("user_id"):
        clicks, views = (list(mine[mine.event_type == kind].itertuples()) for kind in ("click", "view"))
        free, found = list(views), []
        for c in clicks:
            scored = [((min(c.e, v.e) - max(c.s, v.s)) / (max(c.e, v.e) - min(c.s, v.s)) if max(c.e, v.e) > min(c.s, v.s) else 0, -v.event_id, v) for v in free]
            best = max(scored, default=(0, 0, None))
            if best[0] >= 0.1:
                free.remove(best[2])
                found.append(best[0])
                midnights += c.s // 86_400_000_000 != best[2].s // 86_400_000_000
        want[str(user)] = (len(found), len(views) - len(found), len(clicks) - len(found), round(sum(found) / len(found), 6) if found else None)
    got = {r.key: (r.tp, r.fp, r.fn, r.mean_iou) for r in catalogue.interval_matches(spark, f"{DATA}/sf0.01").collect()}
    assert {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in want.items()}
    assert all(v[3] == pytest.approx(want[k][3], abs=2e-6) for k, v in got.items())
    assert midnights > 0
