import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from hypothesis import given, settings, strategies as st

from tripweave.llm import repair
from tripweave.llm.queries import QUERIES

SYMBOLS = st.text("bdsuaoSUAO", max_size=12)


def plain_repair(symbols):
    """Cheapest edits by trying every edit of every row in every state of the grammar."""
    @lru_cache(None)
    def best(i, state, inserted):
        options = []
        if i == len(symbols) and state in "-a":
            options.append((0, ""))
        follow = "a" if state == "u" else "u"
        if i < len(symbols):
            cost, audit = best(i + 1, state, 0)
            options.append((cost + 2, "D" + audit))
            if symbols[i] not in "bd":
                more = 5 if symbols[i].isupper() else 0
                initial = symbols[i].lower()
                for wanted in {follow, "s"} if state == "-" else {follow}:
                    cost, audit = best(i + 1, wanted, 0)
                    if initial == wanted:
                        options.append((cost + more, "K" + audit))
                    elif wanted != "s":
                        options.append((cost + more + 1, "R" + audit))
        if inserted < 3:
            cost, audit = best(i, follow, inserted + 1)
            options.append((cost + 5, "I" + audit))
        return min(options, default=(10**9, ""))
    return best(0, "-", 0)


@given(SYMBOLS)
@settings(max_examples=1500, deadline=None)
def test_alignment_to_each_length_finds_the_cheapest_and_least_audit(symbols):
    assert repair.repair(symbols) == plain_repair(symbols)


@given(SYMBOLS, st.integers(1, 5))
@settings(max_examples=600, deadline=None)
def test_blocks_chained_by_costs_give_the_same(symbols, size):
    blocks = [repair.block_table(symbols[at:at + size]) for at in range(0, len(symbols), size)]
    ahead, chosen = [5 * len(tail) for tail in repair.TAILS], []
    for table in reversed(blocks):
        best = [min((table[4 * e + x][0] + ahead[x], table[4 * e + x][1], x) for x in range(4) if table[4 * e + x]) for e in range(4)]
        ahead = [b[0] for b in best]
        chosen.insert(0, best)
    state, audit = 0, ""
    for best in chosen:
        audit, state = audit + best[state][1], best[state][2]
    assert (ahead[0], audit + repair.TAILS[state]) == plain_repair(symbols)


def test_known_repairs():
    assert repair.repair("ua") == (0, "KK")
    assert repair.repair("sua") == (0, "KKK")
    assert repair.repair("") == (0, "")
    assert repair.repair("u") == (2, "D")
    assert repair.repair("uu") == (1, "KR")
    assert repair.repair("uabua") == (2, "KKDKK")
    assert repair.repair("uau") == (2, "KKD")
    assert repair.repair("uuaa") == (2, "KRRK")


def prefix_order(row):
    role, text = row[1], row[2]
    digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
    return (row[0] is not None, row[0] or 0, role.encode(), text[:64].encode(), digest)


def plain_report(rows):
    """The report of one conversation's rows (turn, role, text) after damage."""
    rows = sorted(rows, key=prefix_order)
    symbols, seen, counts = [], set(), {"b": 0, "d": 0, "t": 0}
    for turn, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        kind = "b" if not words else "d" if (role, text) in seen else "t" if words[-1] not in ".!?" else ""
        seen.add((role, text))
        initial = role[:1] if role[:1] in list("sua") else "o"
        symbols.append(kind if kind in ("b", "d") else initial.upper() if kind else initial)
        if kind:
            counts[kind] += 1
    cost, audit = plain_repair("".join(symbols))
    out, at = [], 0
    made = ""
    for edit in audit:
        if edit != "D":
            role = rows[at][1] if edit == "K" else "assistant" if made[-1:] == "u" else "user"
            out.append(f"{role}:{'' if edit == 'I' else rows[at][2]}")
            made += role[0]
        at += edit != "I"
    assert re.fullmatch("(s?(ua)+)?", made)
    turns = [turn for turn, _, _ in rows if turn is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        row = (turn, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)
        out += [(conv, row)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def expected(data):
    by_conv = {row[0]: [] for row in data}
    for conv, row in plain_damage(data):
        by_conv[conv].append(row)
    return sorted(((conv, *plain_report(rows)) for conv, rows in by_conv.items()), key=repr)


def odd_rows(seed, n):
    rng = random.Random(seed)
    texts = ["Hello there.", "What now?", "yes", "", " \t", None, "No!", "a.b", "é\x85", "x" * 3000 + "."]
    return [(rng.choice([None, 7, *range(20, 30), 50, 50, 50, 50]), rng.choice([None, *range(30)]),
             rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]), rng.choice(texts))
            for _ in range(n)]


@pytest.mark.parametrize("block_rows,n", [(3, 120), (32, 400)])
def test_reports_of_odd_and_long_conversations(spark, rows, monkeypatch, block_rows, n):
    monkeypatch.setattr(repair, "BLOCK_ROWS", block_rows)
    data = odd_rows(block_rows, n) + [(99, 0, "user", "dropped?")]
    frame = spark.createDataFrame([(*row, "own", 1) for row in data],
                                  "conv_id bigint, turn bigint, role string, text string, dropped string, part int").repartition(3)
    found = repair.repair_reports(repair.damaged(frame), dropped="dropped")
    assert rows(found) == expected(data)
    assert found.columns[0] == "conv_id" and len(found.columns) == 9
    assert repair.repair_reports(repair.damaged(frame.limit(0)), dropped="dropped").collect() == []


def test_turns_of_repaired_conversations_give_the_digest(spark):
    data = odd_rows(5, 80)
    frame = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string")
    turns = {}
    for row in sorted(repair.repaired_turns(frame).collect(), key=lambda r: r.place):
        turns.setdefault(row.conv_id, []).append(f"{row.role}:{row.text}")
    for row in repair.repair_reports(frame).collect():
        assert hashlib.sha256("\n".join(turns.get(row.conv_id, [])).encode()).hexdigest() == row.repaired_sha256


def test_query_on_the_driver_table(spark, rows):
    folder = "/root/testdata/sf0.01"
    data = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    assert rows(QUERIES["op11_conversation_repair"](spark, folder)) == expected(data)
