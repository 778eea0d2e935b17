import random

import pytest

from netloom.plans.greedy_chain import greedy_chain


def plain(rows):
    """Walk one key row by row: (t, tie, resume, reset) -> chosen flags."""
    ready, out = None, {}
    for t, tie, resume, reset in sorted(rows):
        hit = reset or ready is None or t >= ready
        out[tie] = hit
        if hit:
            ready = resume
    return out


@pytest.mark.parametrize("levels,fan_in", [(0, 8), (1, 512), (1, 3), (2, 3), (5, 2)])
@pytest.mark.parametrize("resets", [False, True])
def test_matches_row_by_row(spark, levels, fan_in, resets):
    rng = random.Random(fan_in * 2 + resets)
    data, want = [], {}
    for key in range(12):
        n = rng.choice([1, 3, 40, 200])
        span = rng.choice([100, 2_000, 9_000])
        times = sorted(rng.randrange(span) for _ in range(n))
        rows = []
        for j, t in enumerate(times):
            reset = resets and rng.random() < 0.05
            # Releases come first among equal times.
            rows.append((t, j, t if reset else t + rng.randint(1, 60), reset))
        rows = [r for r in rows if not (r[3] and any(o[0] == r[0] and o[1] < r[1] for o in rows))]
        want.update({(f"k{key}", tie): hit for tie, hit in plain(rows).items()})
        data += [(f"k{key}", *r) for r in rows]
    df = spark.createDataFrame(data, "k string, t_us long, packet_id long, resume_us long, reset boolean")
    out = greedy_chain(df, ["k"], 60, reset="reset", block_us=120, fan_in=fan_in, levels=levels).collect()
    assert {(r["k"], r["packet_id"]) for r in out} == {k for k, hit in want.items() if hit}


def test_hold_before_is_the_previous_chosen(spark):
    df = spark.createDataFrame([("a", t, t, t + 10, t + 1000) for t in range(0, 500, 3)], "k string, t_us long, packet_id long, resume_us long, until long")
    rows = greedy_chain(df, ["k"], 10, hold="until", block_us=20, fan_in=2, levels=3).orderBy("t_us").collect()
    until = {t: t + 1000 for t in range(0, 500, 3)}
    assert [r["hold_before"] for r in rows[1:]] == [until[r["t_us"]] for r in rows[:-1]] and len(rows) == 42
