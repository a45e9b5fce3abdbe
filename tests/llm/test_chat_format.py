"""Role repair against brute force over all edits of short conversations."""

import itertools
import random

from auditlark.llm import chat_format as cf


def least_cost(roles):
    """Dijkstra-like search over (turn, state), without matrices or segments."""
    names = dict(zip(cf.ROLES, (1, 2, 3), strict=True))
    best = {0: 0.0}

    def spread(costs):
        changed = True
        while changed:
            changed = False
            for (a, b), c in itertools.product(cf.LEGAL, [cf.INSERT]):
                if a in costs and costs[a] + c < costs.get(b, 1e9):
                    costs[b], changed = costs[a] + c, True
        return costs

    for role in roles:
        r, after = names.get(role, 0), {}
        for s, c in spread(dict(best)).items():
            if s:
                after[s] = min(after.get(s, 1e9), c + (cf.MERGE if r == s else cf.MERGE_OTHER))
            for t in (1, 2, 3):
                if (s, t) in cf.LEGAL:
                    after[t] = min(after.get(t, 1e9), c + (0 if r == t else cf.RELABEL))
        best = after
    return spread(dict(best))[cf.FINAL]


def conversations():
    rng = random.Random(4)
    rows, roles = [], {}
    kinds = [*cf.ROLES, None, "Tool", " USER "]
    for c in range(120):
        n = rng.randrange(1, 9)
        roles[c] = [rng.choice(kinds) for _ in range(n)]
        rows += [(c, t, r, None if rng.random() < 0.1 else f"text {c} {t}", "extra") for t, r in enumerate(roles[c])]
    roles[999] = [rng.choice(kinds) for _ in range(9000)]  # longer than two segments
    rows += [(999, t, r, f"long {t}", "extra") for t, r in enumerate(roles[999])]
    return rows, roles


def test_repair(spark):
    rows, roles = conversations()
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seg string")
    out = {}
    for r in cf.rendered(cf.repair_chats(turns)).collect():
        out.setdefault(r.conv_id, []).append(r)
    assert set(out) == set(roles)
    for c, made in out.items():
        made.sort(key=lambda r: r.out_turn)
        assert [r.out_turn for r in made] == list(range(len(made)))
        clean = [(r or "").strip().lower() for r in roles[c]]
        assert made[0].cost == least_cost(clean), (roles[c], made)
        state = 0
        for r in made:
            to = cf.ROLES.index(r.role) + 1
            assert (state, to) in cf.LEGAL
            state = to
        assert state == cf.FINAL
        assert sum(r.n_source for r in made) == len(clean)
        want = [t for cc, _, _, t, _ in rows if cc == c]
        assert [x for r in made if r.n_source for x in r.text.split("\n")] == [t or "" for t in want]
        assert made[0].rendered.startswith(f"<|{made[0].role}|>\n") and made[0].rendered.endswith("\n<|end|>\n")


def test_nulls_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert cf.repair_chats(spark.createDataFrame([], schema)).count() == 0
    got = cf.repair_chats(spark.createDataFrame([(None, None, None, None), (None, 1, "assistant", "x"), (7, 1, "user", "q"), (7, 1, "user", "q")], schema)).collect()
    assert sorted((r.conv_id or 0, r.out_turn, r.role, r.text) for r in got) == [(0, 0, "user", ""), (0, 1, "assistant", "x"), (7, 0, "user", "q\nq"), (7, 1, "assistant", "")]


def test_one_role_for_thousands_of_turns(spark):
    """No text is lost or moved, whatever merges, relabels and insertions the repair chooses."""
    turns = spark.createDataFrame([(1, k, "user", f"t{k}") for k in range(9000)], "conv_id long, turn long, role string, text string")
    out = sorted(cf.repair_chats(turns).collect(), key=lambda r: r.out_turn)
    assert [t for r in out for t in r.text.split("\n") if t] == [f"t{k}" for k in range(9000)]
    assert [r.out_turn for r in out] == list(range(len(out))) and sum(r.n_source for r in out) == 9000
    assert all(a.role != b.role for a, b in zip(out, out[1:], strict=False))
