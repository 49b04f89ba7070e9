"""Purge plans and set digests: results by hand, and what their plans hold in a task."""

import hashlib
import random

from scribelake.operators import identity, purge


def _executed(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_plan_needs_one_join(spark):
    r = random.Random(5)
    schema = "session_id int, source_id int"
    pick = lambda n: [(r.choice([None, *range(30)]), r.choice([None, *range(4)])) for _ in range(n)]
    sources, refs, kept = pick(120), pick(150), pick(20)
    sources += [(s, x) for s, x in refs if s is not None and s < 12]
    got = purge.plan(
        spark.createDataFrame(sources, schema), spark.createDataFrame([(s, f"a{s}") for s in [None, *range(30)]], "session_id int, path string"),
        spark.createDataFrame(refs, schema), spark.createDataFrame(kept, schema),
    )
    want = {}
    for s in {s for s, _ in sources if s is not None}:
        own = {x for t, x in sources if t == s}
        chosen = {x for x in own if x is not None and (s, x) in refs}
        if chosen:
            want[s] = "mixed_session" if chosen < own else "used_elsewhere" if any((s, x) in kept for x in chosen) else "remove"
    assert len(set(want.values())) == 3
    assert {x["session_id"]: x["decision"] for x in got.collect()} == want
    assert _executed(got).count("Join ") == 1


def test_digest_sums_are_integers(spark):
    rows = [(k, f"p{i}", f"s{i * k}") for k in (1, 2) for i in range(300)]
    got = identity.tree_digest(spark.createDataFrame(rows, "k int, path string, sha string").repartition(5), "k", "path", "sha")
    for r in got.collect():
        hashes = [hashlib.sha256(f"{p}:{s}".encode()).hexdigest() for k, p, s in rows if k == r["k"]]
        words = [sum(int(h[8 * i : 8 * i + 8], 16) for h in hashes) % 2**32 for i in range(8)]
        assert r["digest"] == hashlib.sha256(":".join(map(str, [len(hashes), *words])).encode()).hexdigest()
    assert "decimal" not in _executed(got)
