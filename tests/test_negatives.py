"""Negative tails against a replay of the hash, with heads that hold most or all tails of a relation."""

import hashlib

from tidemark.operators import sampling


def test_only_saturated_heads_go_without_a_negative(spark):
    rows = [(0, 1, t) for t in range(0, 160, 2) if t != 78] + [(1, 1, t) for t in range(0, 160, 2)] + [(h, 1, 2 * h) for h in range(2, 12)]
    rows += [(h, 2, 10 + h % 4) for h in range(900)] + [(5000, 3, 7)]
    tails, true = {}, {}
    for h, r, t in rows:
        tails.setdefault(r, set()).add(t)
        true.setdefault((h, r), set()).add(t)
    want, exact = {}, 0
    for h, r, t in rows:
        u = lambda k: (int(hashlib.md5(f"4:{h}:{r}:{t}:{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52  # noqa: B023, E731
        every = sorted(tails[r])
        open_ = [x for x in every if x not in true[h, r]]
        drawn = [x for k in range(4) if (x := every[int(u(k) * len(every))]) in open_]
        if open_:
            want[h, r, t] = drawn[0] if drawn else open_[int(u(4) * len(open_))]
            exact += not drawn
    got = sampling.negative_tails(spark.createDataFrame(rows, "h long, r int, t long"), 4).collect()
    assert exact > 50 and len(got) == len(want) and {(x["h"], x["r"], x["t"]): x["negative"] for x in got} == want
