import hashlib
import random
import zlib

import numpy as np
import pytest

from kinesieve.llm import turns
from kinesieve.llm.queries import op11_turn_repair
from tests.conftest import SMALL

WHITE = " \t\n\x0b\x0c\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
FULL = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 1:
            text = ""
        if fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def order(rows):
    same = lambda r: hashlib.sha256(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).hexdigest()
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), same(r)))


def solve(rows):
    """Strings and all: the cheapest audits of every state, row by row."""
    seen, best, counts = set(), {"": (0, "", [])}, {"blank": 0, "duplicate": 0, "truncated": 0}

    def with_inserts(states):
        out = dict(states)
        for _ in range(4):
            for state, (cost, audit, lines) in list(out.items()):
                for role in "ua":
                    if (state, role) in NEXT:
                        got = (cost + 5, audit + "I", lines + [FULL[role] + ":"])
                        to = NEXT[state, role]
                        if to not in out or got[:2] < out[to][:2]:
                            out[to] = got
        return out

    for _, _, role, text in rows:
        bare = text.rstrip(WHITE)
        fault = "blank" if not bare.strip(WHITE) else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        after = {}

        def offer(state, got):
            if state not in after or got[:2] < after[state][:2]:
                after[state] = got

        # all runs of inserts up to three, not only the cheapest of a state: ties must be seen
        ways = [(s, c, a, x) for s, (c, a, x) in best.items()]
        frontier = ways
        for _ in range(3):
            frontier = [(NEXT[s, r], c + 5, a + "I", x + [FULL[r] + ":"]) for s, c, a, x in frontier for r in "ua" if (s, r) in NEXT]
            ways = ways + frontier
        for state, cost, audit, lines in ways:
            offer(state, (cost + 2, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if (state, role[:1]) in NEXT:
                    offer(NEXT[state, role[:1]], (cost + more, audit + "K", lines + [f"{role}:{text}"]))
                for r in "ua":
                    if (state, r) in NEXT:
                        offer(NEXT[state, r], (cost + more + 1, audit + "R", lines + [f"{FULL[r]}:{text}"]))
        best = after
    ends = [v for k, v in with_inserts(best).items() if k in ("", "a")]
    cost, audit, lines = min(ends, key=lambda v: v[:2])
    return counts, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def brute(rows):
    groups = {conv: [] for conv, *_ in rows}
    for r in damage(rows):
        groups[r[0]].append(r)
    out = {}
    for conv, part in groups.items():
        part = order(part)
        numbers = [r[1] for r in part if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        first = [r[2][:1] for r in part]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        counts, cost, audit, digest = solve(part)
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest)
    return out


def check(df, rows):
    got = [tuple(r) for r in turns.repair_damaged(df).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()]
    want = brute(rows)
    assert len(got) == len(want)
    for conv, *values in got:
        assert tuple(values) == want[conv], conv


def test_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark.read.parquet(f"{SMALL}/conversations.parquet"), rows)
    assert op11_turn_repair(spark, SMALL).count() == len({r[0] for r in rows})


def invented(seed, convs, longest):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "agent", "usher"]
    texts = ["Yes.", "No", "?", " ", "", None, "Well, well!\n", "x" * 50 + ".", "a?b", "Ünï.\x0b"]
    out = []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            role = rng.choices(roles, [8, 8, 3, 1, 1, 1, 1, 1])[0]
            text = rng.choice(texts) if rng.random() < 0.4 else f"turn {t} of {c}{rng.choice(['.', '!', ''])}"
            out.append((None if c == 3 else c, None if rng.random() < 0.03 else t * rng.choice([1, 1, 2]), role, text))
    return out


@pytest.mark.parametrize("bits,longest,convs", [(9, 9, 120), (1, 40, 60), (2, 90, 25)])
def test_odd_conversations(spark, bits, longest, convs, monkeypatch):
    """Runs of two and four rows, so that conversations take several levels."""
    monkeypatch.setattr(turns, "RUN_BITS", bits)
    rows = invented(bits, convs, longest)
    df = spark.createDataFrame([(*r, "mine", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, run int").repartition(3)
    check(df, rows)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.repair_damaged(df).collect() == []


def test_combined_nodes_are_the_whole():
    """Whatever the cut, two halves combine to what the rows give together."""
    rng = np.random.default_rng(5)
    for _ in range(50):
        kinds = rng.integers(0, 12, rng.integers(2, 30))
        k = int(rng.integers(1, len(kinds)))
        whole = turns.combine(np.array([0, len(kinds)]), turns.by_kind(kinds))
        parts = [turns.combine(np.array([0, len(x)]), turns.by_kind(x)) for x in (kinds[:k], kinds[k:])]
        cost, rank = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        again = turns.combine(np.array([0, 2]), lambda at: (cost[at], rank[at]))
        found = whole[0] < turns.FAR
        assert (whole[0] == again[0]).all() and (whole[1] == again[1])[found.all(2)].all()
