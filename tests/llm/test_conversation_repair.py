import hashlib
import itertools
import random
import re
import zlib

import pytest

from epithet.llm import conversation_repair as repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
BLANK = " \t\n\x0b\x0c\r"
LEGAL = re.compile(r"(s?(ua)+)?")


def best_of_all(rows):
    """(cost, audit, repaired rows) over every sequence of edits; rows are (role, text, fault)."""
    gaps = ["", "u", "a", "ua", "au"]
    choices = []
    for role, text, fault in rows:
        more = 5 if fault == "truncated" else 0
        ways = [(2, "D", None)]
        if fault not in ("blank", "duplicate"):
            ways += [(more, "K", (role, text)), (1 + more, "R", ("user", text)), (1 + more, "R", ("assistant", text))]
        choices.append(ways)
    names = {"u": "user", "a": "assistant"}
    found = []
    for edits in itertools.product(*choices):
        for added in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for letters, edit in itertools.zip_longest(added, edits):
                cost, audit = cost + 5 * len(letters), audit + "I" * len(letters)
                out += [(names[c], "") for c in letters]
                if edit:
                    cost, audit = cost + edit[0], audit + edit[1]
                    out += [edit[2]] if edit[2] else []
            if LEGAL.fullmatch("".join(role[:1] or "?" for role, _ in out)):
                found.append((cost, audit, out))
    return min(found)


def by_states(rows):
    """The same for long conversations: the best (cost, audit) for each state, row by row."""
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}

    def inserts(best):
        for _ in range(4):
            for state, (cost, audit) in list(best.items()):
                for c in legal[state]:
                    if c != "s":
                        best[c] = min(best.get(c, (1 << 60, "")), (cost + 5, audit + "I"))
        return best

    best = inserts({"": (0, "")})
    for role, _, fault in rows:
        more, new = 5 if fault == "truncated" else 0, {}

        def offer(state, cost, audit):
            new[state] = min(new.get(state, (1 << 60, "")), (cost, audit))

        for state, (cost, audit) in best.items():
            offer(state, cost + 2, audit + "D")
            if fault in ("blank", "duplicate"):
                continue
            for c in legal[state]:
                if role[:1] == c:
                    offer(c, cost + more, audit + "K")
                if c != "s":
                    offer(c, cost + 1 + more, audit + "R")
        best = inserts(new)
    return min(best[s] for s in ("", "a") if s in best)


def runs_of(rows):
    out = []
    for role, _, fault in rows:
        sym = repair.MUST_GO if fault in ("blank", "duplicate") else repair.symbol(role[:1], fault == "truncated")
        if out and out[-1][0] == sym:
            out[-1] = (sym, out[-1][1] + 1)
        else:
            out.append((sym, 1))
    return out


ROLES = ["system", "user", "assistant", "tool", ""]
FAULTS = ["", "", "blank", "duplicate", "truncated"]


@pytest.mark.parametrize("seed", range(40))
def test_edits_equal_trying_all(seed):
    rng = random.Random(seed)
    rows = [(rng.choice(ROLES), "x", rng.choice(FAULTS)) for _ in range(rng.randint(0, 3))]
    assert repair.cheapest(runs_of(rows)) == best_of_all(rows)[:2] == by_states(rows)


@pytest.mark.parametrize("seed", range(40))
def test_edits_of_long_conversations(seed):
    rng = random.Random(1000 + seed)
    rows = []
    while len(rows) < 200:  # runs of very different lengths
        rows += [(rng.choice(ROLES), "x", rng.choice(FAULTS))] * rng.choice([1, 1, 2, 5, 40])
    assert repair.cheapest(runs_of(rows)) == by_states(rows)


def test_a_run_of_a_million_rows():
    cost, audit = repair.cheapest([(repair.symbol("u", False), 1_000_000)])
    assert cost == 500_000 and audit == "KR" * 500_000
    assert repair.cheapest([(repair.symbol("u", False), 1_000_001)]) == (500_002, "D" + "KR" * 500_000)


def plain_report(rows):
    """The contract, conversation by conversation, in plain Python."""
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        kept += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, kept in convs.items():
        mark = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), mark(r)))
        seen, faulty = set(), []
        for _, role, text in kept:
            visible = text.strip(BLANK)
            fault = "blank" if not visible else "duplicate" if (role, text) in seen else "" if visible[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(faulty))
        cost, audit = by_states(faulty)
        repaired, at, state = [], 0, ""
        grown = {"": "user", "s": "user", "u": "assistant", "a": "user"}
        for letter in audit:
            role, text = (None, "") if letter == "I" else faulty[at][:2]
            at += letter != "I"
            if letter != "D":
                role = role if letter == "K" else grown[state]
                state = role[0]
                repaired.append(f"{role}:{text}")
        sha = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
        count = [sum(f == k for _, _, f in faulty) for k in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *count, illegal, cost, audit, sha)
    return out


def report(spark, rows, extra=()):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *extra)
    names = [*repair.COUNTS, "audit", "repaired_sha256"]
    found = [(r["conv_id"], tuple(r[c] for c in names)) for r in repair.repair_report(df).collect()]
    assert len(found) == len(dict(found))
    return dict(found)


def test_report_equals_plain_python(spark):
    rng = random.Random(5)
    texts = ["Yes.", "no", "", " \t", "What?", "End!\n ", "a.b", "...", None, "x" * 50_000 + ".", "日本。", "ok.\x00"]
    rows = []
    for conv in range(300):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            rows.append((conv, None if rng.random() < 0.05 else turn + rng.choice([0, 0, 1]), role, rng.choice(texts)))
    rows += [(None, t, "user", "Hm.") for t in range(4)] + [(None, None, None, None)]
    rows += [(900, 1, "user", "Same.")] * 3 + [(901, None, "user", "No turn.")] * 2
    rng.shuffle(rows)
    assert report(spark, rows) == plain_report(rows)


def test_one_conversation_of_many_rows(spark):
    rows = [(7, t, ("user", "assistant")[t % 2], f"Turn {t % 4000}.") for t in range(12_000)]
    assert report(spark, rows) == plain_report(rows)


def test_all_rows_dropped_and_empty_table(spark):
    gone = [(c, 0, "user", "Hello.") for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    nothing = hashlib.sha256(b"").hexdigest()
    assert set(report(spark, gone).values()) == {(0, 0, 0, 0, 0, 0, "", nothing)}
    assert report(spark, []) == {}


def test_clashing_columns_are_ignored(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Hello.")]
    extra = [f"'x' AS {c}" for c in ("gone", "kind", "mark", "audit", "fault", "copy", "place", "__conv")]
    assert report(spark, rows, extra) == report(spark, rows) == plain_report(rows)


def test_repaired_rows_are_given_whole(spark):
    df = spark.createDataFrame([(1, t, r, f"Text {t}.") for t, r in enumerate(["user", "user", "assistant"])], SCHEMA)
    turns = df.selectExpr("*", "false AS gone")
    rows = repair.repaired(turns, repair.audits(turns)).collect()
    assert [tuple(r) for r in rows] == [(1, 0, "user", "Text 1."), (1, 1, "assistant", "Text 2.")]
