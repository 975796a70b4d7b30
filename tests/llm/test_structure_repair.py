"""Structure repair against a search over all edits, and on edges."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tessera.llm import structure_repair as repair
from tests.oracle import differences

TURN = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")


def searched(letters):
    """Least cost, then least edits, of all edit sequences, cheapest first."""
    seen, heap = set(), [(0, "", 0, "")]
    while heap:
        cost, edits, at, roles = heapq.heappop(heap)
        if at == len(letters) and GOOD.fullmatch(roles):
            return cost, edits
        if (at, edits) in seen or edits.endswith("III"):
            continue
        seen.add((at, edits))
        tail = roles[-3:]
        for role in "ua":
            heapq.heappush(heap, (cost + 5, edits + "I", at, roles + role))
        if at < len(letters):
            letter = letters[at]
            heapq.heappush(heap, (cost + 2, edits + "D", at + 1, roles))
            if letter != "x":
                more = 5 if letter.isupper() else 0
                heapq.heappush(heap, (cost + more, edits + "K", at + 1, roles + letter.lower()))
                for role in "ua":
                    heapq.heappush(heap, (cost + 1 + more, edits + "R", at + 1, roles + role))
        heap = [h for h in heap if not re.search(r"uu|aa|o|us|as|ss|sa|^a", h[3])]
        heapq.heapify(heap)
    raise AssertionError(tail)


def test_trie_gives_the_least_edits():
    rng = random.Random(4)
    signatures = sorted({"".join(rng.choice("suaoSUAx") for _ in range(rng.randint(0, 4))) for _ in range(120)} | {"", "s", "ua", "xxxx", "sS"})
    trie = repair.Trie()
    assert [trie.answer(s) for s in signatures] == [searched(s) for s in signatures]


def test_shared_prefixes_are_made_once():
    trie = repair.Trie()
    signatures = sorted("ua" * 50 + tail for tail in ("", "u", "ux", "s", "uau"))
    for s in signatures:
        trie.answer(s)
    assert trie.made == 100 + len({s[:k] for s in signatures for k in range(101, len(s) + 1)})
    assert repair.shared("abcd", "abce") == 3 and repair.shared("", "a") == 0 and repair.shared("ab", "ab") == 2


def brute(rows, ids):
    """The contract row by row."""
    out = {}
    for conv in ids:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        turns = [r[1] for r in own if r[1] is not None]
        blank = duplicate = truncated = 0
        seen, letters = set(), ""
        for _, _, role, text in own:
            body = text.strip(" \t\n\v\f\r")
            if not body:
                blank += 1
                letters += "x"
            elif (role, text) in seen:
                duplicate += 1
                letters += "x"
            else:
                initial = role[:1] if role[:1] in tuple("sua") else "o"
                cut = body[-1] not in ".!?"
                truncated += cut
                letters += initial.upper() if cut else initial
            seen.add((role, text))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        trie = repair.Trie()
        cost, audit = trie.answer(letters)
        said, at, last = [], 0, ""
        for edit in audit:
            nxt = "assistant" if last == "u" else "user"
            if edit == "I":
                said.append((nxt, ""))
            else:
                _, _, role, text = own[at]
                at += 1
                if edit != "D":
                    said.append((role if edit == "K" else nxt, text))
            last = said[-1][0][0] if said else ""
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, blank, duplicate, truncated, illegal, cost, audit, digest)
    return out


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        part = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{part(conv)}:{part(turn)}".encode()) % 20
        role, text = part(role), part(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def edges():
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, "", "unit"]), rng.choice(["Yes.", "No", "", None, " \t", "Why?", "x!\n ", "Ünï 語。"])) for c in range(120) for t in range(rng.randint(1, 9))]
    rows += [(None, t, "user", "Hi.") for t in (0, 0, 3, None, None)] + [(500, None, None, None)] + [(501, 2, "user", "Same.")] * 40 + [(502, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(3000)]
    return rows + [(503, 0, "user", "long " * 200_000), (503, 1, "assistant", " " * 500_000 + ".")]


def test_repair_of_edges(spark, tmp_path):
    rows = edges()
    path = str(tmp_path)
    turns = spark.createDataFrame(rows, TURN).selectExpr("*", "1 AS key", "'x' AS audit", "2 AS at", "true AS there")
    turns.repartition(5).write.parquet(f"{path}/conversations.parquet")
    found = {r["conv_id"]: tuple(r)[1:] for r in repair.op11_structure_repair(spark, path).collect()}
    assert found == brute(damage(rows), {r[0] for r in rows})


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "One?"), (1, 1, "user", "Two?"), (1, 2, "assistant", "Three."), (2, 0, "assistant", "Alone.")]
    made = repair.repair_conversations(spark.createDataFrame(rows, TURN))
    turns = [(r["conv"], r["at"], r["edit"], r["role"], r["text"]) for r in made.turns.orderBy("conv", "at").collect()]
    assert turns == [(1, 0, "K", "user", "Two?"), (1, 1, "K", "assistant", "Three.")]
    audits = {r["conv"]: (r["cost"], r["audit"]) for r in made.summary.collect()}
    assert audits == {1: (2, "DKK"), 2: (2, "D")}
    assert repair.repair_conversations(spark.createDataFrame([], TURN)).turns.count() == 0


@pytest.mark.parametrize("rows", [[], [(1, 1, "user", "Hi."), (None, None, None, None)]])
def test_agrees_with_sql_on_edges(spark, tmp_path, rows):
    spark.createDataFrame(rows, TURN).write.parquet(f"{tmp_path}/conversations.parquet")
    import os

    part = next(f for f in os.listdir(tmp_path / "conversations.parquet") if f.endswith(".parquet"))
    os.rename(tmp_path / "conversations.parquet" / part, tmp_path / "one.parquet")
    os.makedirs(tmp_path / "sql")
    os.rename(tmp_path / "one.parquet", tmp_path / "sql" / "conversations.parquet")
    assert not differences(repair.op11_structure_repair(spark, str(tmp_path / "sql")), repair.OP11_SQL, str(tmp_path / "sql"))
