import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest

from larkspur.llm import conversations
from larkspur.llm.queries import op11_conversations

SHAPE = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """Cost, audit and turns by a search over (rows used, state), least cost and audit first."""
    after = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    heap, done = [(0, "", 0, 0, [])], set()
    while heap:
        cost, audit, i, q, out = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, audit, out
        if (i, q) in done:
            continue
        done.add((i, q))
        for initial, role in (("u", "user"), ("a", "assistant")):
            if initial in after[q]:
                heapq.heappush(heap, (cost + 2, audit + "I", i, after[q][initial], out + [f"{role}:"]))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q, out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] in after[q]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, after[q][role[:1]], out + [f"{role}:{text}"]))
                for initial, other in (("u", "user"), ("a", "assistant")):
                    if initial in after[q]:
                        heapq.heappush(heap, (cost + more + 2, audit + "R", i + 1, after[q][initial], out + [f"{other}:{text}"]))


def brute(rows, damage=True):
    by, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        told = [" " if x is None else str(x) for x in (conv, turn)]
        fault = zlib.crc32(":".join(told).encode()) % 20 if damage else 9
        text = "" if fault == 1 else text.translate(str.maketrans("", "", ".!?")) if fault == 2 else text
        by[conv] += [(turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    for conv, found in by.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, marked = set(), []
        for _, role, text in found:
            last = text.rstrip(BLANKS)[-1:]
            marked.append((role, text, "blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated"))
            seen.add((role, text))
        turns = [t for t, _, _ in found if t is not None]
        kinds = [f for _, _, f in marked]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:], strict=False))
        cost, audit, left = cheapest(marked)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *map(kinds.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def told(df):
    return {r[0]: tuple(r[1:]) for r in df.select(*COLUMNS).collect()}


def conversations_of(seed, number, most):
    rng = random.Random(seed)
    roles = ["user"] * 5 + ["assistant"] * 5 + ["system", "tool", "", None, "ursa", "User"]
    texts = ["Yes.", "no", "", " \n", None, "a.\t", "b!", "é?", "\x00.", "x. y", " "]
    return [(c, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(number)] for _ in range(rng.randint(1, most))]


def test_query_against_brute_force(spark, sf_dir):
    got = op11_conversations(spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    assert told(got) == brute([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows])


@pytest.mark.parametrize("seed,most", [(1, 6), (2, 14)])
def test_odd_rows_and_small_pieces(spark, monkeypatch, seed, most):
    """Pieces of three rows, so that conversations pass through several."""
    cut = conversations._pieces

    def small(batches):
        conversations.PIECE_ROWS = 3
        return cut(batches)

    monkeypatch.setattr(conversations, "_pieces", small)
    rows = conversations_of(seed, 120, most)
    df = spark.createDataFrame(rows, SHAPE).repartition(5)
    assert told(conversations.repair_reports(df)) == brute(rows, damage=False)


def test_long_conversation_over_many_tasks(spark):
    """One conversation that holds most rows, with repeated texts far apart."""
    rng = random.Random(3)
    rows = [(7, i, rng.choice(["user", "assistant"]), rng.choice([f"line {i}.", f"line {i}", "again.", ""])) for i in range(30_000)]
    rows += [(c, 0, "user", "Hi.") for c in range(100, 150)]
    df = spark.createDataFrame(rows, SHAPE).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = conversations.cut(df).where("conv = 7")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert pieces.select("part").distinct().count() > 2
    assert told(conversations.repair_reports(df)) == brute(rows, damage=False)


def test_turns_are_those_of_the_digest(spark):
    rows = conversations_of(5, 40, 8)
    df = spark.createDataFrame(rows, SHAPE)
    left = defaultdict(list)
    for r in sorted(conversations.repaired_turns(df).collect(), key=lambda r: r["position"]):
        left[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    want = {c: v[-1] for c, v in brute(rows, damage=False).items()}
    assert {c: hashlib.sha256("\n".join(left[c]).encode()).hexdigest() for c in want} == want


def test_empty_and_long(spark):
    assert conversations.repair_reports(spark.createDataFrame([], SHAPE)).collect() == []
    rows = [(1, 0, "user", "x" * 3_000_000 + "."), (1, 1, "assistant", "ok."), (2, 5, "user", "a\n" * 900_000)]
    assert told(conversations.repair_reports(spark.createDataFrame(rows, SHAPE))) == brute(rows, damage=False)


def test_transitions_are_made_once():
    """A scan of more rows makes no more vectors once all have been met."""
    rng, machine = random.Random(4), conversations.Automaton()
    machine.scan("".join(rng.choice("suaoSUAOx") for _ in range(20_000)), machine.end)
    known = len(machine.vectors)
    machine.scan("".join(rng.choice("suaoSUAOx") for _ in range(20_000)), machine.end)
    assert len(machine.vectors) == known < 60
