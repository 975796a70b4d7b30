"""Conversation structure repair: row signatures share a prefix trie, whose nodes hold one layer each of the edit costs."""

from __future__ import annotations

import hashlib
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm._common import joined_to_copies, written

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: What comes next after: nothing, a system turn, a user turn, an assistant turn. A repaired dialogue ends at the first or the last.
AFTER_INSERT = (2, 2, 3, 2)
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
ROLE_OF = {2: "user", 3: "assistant"}

Layer = tuple  # for each state None or (cost, rank of its edits among the states')


@lru_cache(maxsize=1 << 16)
def step(layer: Layer, letter: str) -> tuple[Layer, int, tuple]:
    """The layer after a row of ``letter`` with its least cost taken off, that cost, and for each state (state before, inserts, edit).

    A letter is the initial of a row's role or ``o``, in upper case for a truncated row, or ``x`` for a row that must go. What is
    written down of the edits up to a row ends with an edit of that row, so that no two are a prefix of each other, and their
    order is that of the states before, then of what is added.
    """
    best: list = [None] * 4
    more = TRUNCATED if letter.isupper() else 0
    for before, entry in enumerate(layer):
        if entry is None:
            continue
        state = before
        for inserts in range(3):
            if inserts:
                state = AFTER_INSERT[state]
            ways = [("D", state, DELETE)]
            if letter != "x":
                ways.append(("R", AFTER_INSERT[state], REROLE + more))
                if (state, letter.lower()) in KEPT:
                    ways.append(("K", KEPT[state, letter.lower()], more))
            for edit, to, cost in ways:
                way = (entry[0] + INSERT * inserts + cost, entry[1], "I" * inserts + edit, before)
                if best[to] is None or way < best[to]:
                    best[to] = way
    least = min(b[0] for b in best if b)
    order = sorted(b[1:3] for b in best if b)
    made = tuple(b and (b[0] - least, order.index(b[1:3])) for b in best)
    return made, least, tuple(b and (b[3], b[2]) for b in best)


def shared(a: str, b: str) -> int:
    """How many first characters ``a`` and ``b`` share."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """The path of the trie that leads to the last signature: a layer for each of its nodes."""

    def __init__(self) -> None:
        self.path, self.layers, self.costs, self.ways = "", [((0, 0), None, None, None)], [0], []
        self.made = 0

    def answer(self, signature: str) -> tuple[int, str]:
        """Least cost and the least edits of it. Signatures come in order, so layers of what is shared with the last one stay."""
        depth = shared(self.path, signature)
        del self.layers[depth + 1 :], self.costs[depth + 1 :], self.ways[depth:]
        for letter in signature[depth:]:
            layer, cost, ways = step(self.layers[-1], letter)
            self.layers.append(layer)
            self.costs.append(self.costs[-1] + cost)
            self.ways.append(ways)
            self.made += 1
        self.path = signature
        ends = []
        for state, entry in enumerate(self.layers[-1]):
            if entry:
                now = state
                for inserts in range(3):
                    if inserts:
                        now = AFTER_INSERT[now]
                    if now in ENDS:
                        ends.append((entry[0] + INSERT * inserts, entry[1], "I" * inserts, state))
        cost, _, last, state = min(ends)
        parts = [last]
        for ways in reversed(self.ways):
            state, part = ways[state]
            parts.append(part)
        return self.costs[-1] + cost, "".join(reversed(parts))


class Repair(NamedTuple):
    """summary: conv, key and the counts, cost and audit of each; turns: the repaired ones, in order within a partition."""

    summary: DataFrame
    turns: DataFrame


def repair_conversations(
    turns: DataFrame, conversations: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> Repair:
    """Find faults in the structure of conversations and repair them at the least cost.

    Rows of a conversation stand in order of turn, nulls first; ties by role, then by the MD5 of the text, so equal rows are
    neighbours. A row's first fault counts: blank (nothing but white space), duplicate (role and text seen earlier), truncated
    (its last character but white space is none of ``.!?``). ``gaps`` is the greatest turn less the smallest plus 1 less the
    different ones, ``illegal`` counts neighbours whose roles don't begin with su, ua or au. Edits keep a row (0), give it the role user or
    assistant (1), delete it (2, the only one for blank and duplicate rows) or insert an empty one (5); a truncated row that stays adds 5.
    The cheapest edits that lead to roles of initials ``(s?(ua)+)?`` are ``audit`` as initials, the least by ASCII of several.

    What matters of a conversation is its signature, a letter for each row. Different signatures are sorted over range
    partitions, so that neighbours share prefixes, as on a walk through their trie: layers of costs are made once
    for a shared prefix, and answers are read where a signature ends. A signature of many conversations is solved once and
    joined back split. Copies of a row are counted before they are shuffled for the signatures. A conversation's audit is one value
    and its turns have one order, so a conversation is one task's stream; what the task holds of it is one letter a row.

    ``conversations`` has ids that are to be told even without rows (cost 0, empty audit). A null role or text is one space; rows of a null
    id are one conversation; repeated rows are repeated turns (and duplicates); all turns null have no gaps. Texts of any length
    are read whole, one at a time. An empty table gives empty ones. Other columns aren't read.
    Returns summary (key, conv, gaps, blank, duplicate, truncated, illegal, cost, audit) and turns (key, conv, at, edit, role, text).
    """
    conv_type = turns.schema[conv_col].dataType.simpleString()
    key = F.coalesce(F.concat(F.lit("k"), F.col(conv_col).cast("string")), F.lit("")).alias("key")
    conv = F.col(conv_col).alias("conv")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(" "))
    rows = turns.select(key, conv, F.col(turn_col).cast("long").alias("turn"), role.alias("role"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), text.alias("text"))

    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    fault = F.when(last == "", "b").when(~last.isin(".", "!", "?"), "t").otherwise("")
    marked = rows.groupBy("key", "conv", "turn", "role", "digest", initial.alias("initial"), fault.alias("fault")).agg(F.count(F.lit(1)).alias("times"))
    first = F.row_number().over(Window.partitionBy("key", "role", "digest").orderBy("turn")) == 1
    marked = marked.withColumn("first", first).withColumn("there", F.lit(True))
    every = (turns if conversations is None else conversations).select(key, conv).distinct().withColumn("there", F.lit(False))
    marked = marked.unionByName(every, allowMissingColumns=True).repartition("key").sortWithinPartitions("key", "there", "turn", "role", "digest")
    wanted = ["key", "conv", "there", "turn", "initial", "fault", "times", "first"]
    signed = marked.select(*wanted).mapInArrow(_signed, f"key string, conv {conv_type}, gaps long, blank long, duplicate long, truncated long, illegal long, signature string")
    signed = written(signed, "repair-signatures")

    def solved(batches):
        trie = Trie()
        for batch in batches:
            answers = [trie.answer(s) for s in batch.column(0).to_pylist()]
            cost, audit = pa.array([a[0] for a in answers], pa.int64()), pa.array([a[1] for a in answers], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, cost, audit], names=["signature", "copies", "cost", "audit"])

    different = signed.groupBy("signature").agg(F.count(F.lit(1)).alias("copies")).repartitionByRange("signature").sortWithinPartitions("signature")
    answers = written(different.mapInArrow(solved, "signature string, copies long, cost long, audit string"), "repair-answers")
    summary = written(joined_to_copies(signed, answers, "signature").drop("signature", "copies"), "repair-summary")

    told = summary.select("key", "conv", F.lit(False).alias("there"), "audit")
    met = told.unionByName(rows.withColumn("there", F.lit(True)), allowMissingColumns=True)
    met = met.repartition("key").sortWithinPartitions("key", "there", "turn", "role", "digest").select("key", "conv", "there", "audit", "role", "text")
    return Repair(summary, met.mapInArrow(_repaired, f"key string, conv {conv_type}, at long, edit string, role string, text string"))


def _signed(batches):
    """One row for each conversation of a stream that is in order; a row that isn't ``there`` begins each."""
    now = None
    for batch in batches:
        done = []
        for key, conv, there, turn, initial, fault, times, first in zip(*(c.to_pylist() for c in batch.columns)):
            if not there:
                if now:
                    done.append(now.told())
                now = _Signing(key, conv)
            else:
                now.add(turn, initial, fault, times, first)
        yield _signed_batch(batch.schema.field("conv").type, done)
        conv_type = batch.schema.field("conv").type
    if now:
        yield _signed_batch(conv_type, [now.told()])


def _signed_batch(conv_type: pa.DataType, done: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), conv_type, *[pa.int64()] * 5, pa.string()]
    names = ["key", "conv", "gaps", "blank", "duplicate", "truncated", "illegal", "signature"]
    return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(types)], names=names)


class _Signing:
    def __init__(self, key: str, conv) -> None:
        self.key, self.conv, self.letters, self.last = key, conv, bytearray(), ""
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, initial: str, fault: str, times: int, first: bool) -> None:
        if turn is not None and turn != self.turn:
            self.turn, self.high, self.low = turn, turn, turn if self.low is None else self.low
            self.turns += 1
        pairs = [self.last + initial] * bool(self.last)
        self.illegal += sum(p not in ("su", "ua", "au") for p in pairs) + (times - 1)  # two of a kind never follow
        self.last = initial
        if fault == "b":
            self.blank += times
            self.letters += b"x" * times
            return
        letter = initial.upper() if fault == "t" else initial
        self.truncated += bool(first and fault == "t")
        self.duplicate += times - bool(first)
        self.letters += (letter.encode() if first else b"x") + b"x" * (times - 1)

    def told(self) -> tuple:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)
        return self.key, self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.letters.decode()


def _repaired(batches):
    """The repaired turns of a stream in which each conversation begins with a row that has its audit."""
    key = conv = audit = conv_type = None
    at = done = state = 0
    out: list[tuple] = []

    def inserted() -> None:
        nonlocal at, done, state
        while done < len(audit) and audit[done] == "I":
            state = AFTER_INSERT[state]
            out.append((key, conv, at, "I", ROLE_OF[state], ""))
            at, done = at + 1, done + 1

    def batch_of() -> pa.RecordBatch:
        types = [pa.string(), conv_type, pa.int64(), pa.string(), pa.string(), pa.string()]
        made = pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names=["key", "conv", "at", "edit", "role", "text"])
        out.clear()
        return made

    for batch in batches:
        conv_type = batch.schema.field("conv").type
        for own_key, own_conv, there, own_audit, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if not there:
                if audit is not None:
                    inserted()
                key, conv, audit, at, done, state = own_key, own_conv, own_audit, 0, 0, 0
                continue
            inserted()
            edit, done = audit[done], done + 1
            if edit != "D":
                state = KEPT[state, role[0]] if edit == "K" else AFTER_INSERT[state]
                out.append((key, conv, at, edit, role if edit == "K" else ROLE_OF[state], text))
                at += 1
        yield batch_of()
    if audit is not None:
        inserted()
        yield batch_of()


def text_hashes(turns: DataFrame) -> DataFrame:
    """(key, sha256) of ``role:text`` of each conversation's turns, joined by line breaks; ``turns`` as ``repair_conversations`` gives them."""

    def hashed(batches):
        now = running = None
        for batch in batches:
            done = []
            for key, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    if running:
                        done.append((now, running.hexdigest()))
                    now, running = key, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], names=["key", "sha256"])
        if running:
            yield pa.RecordBatch.from_pydict({"key": [now], "sha256": [running.hexdigest()]})

    return turns.select("key", "role", "text").mapInArrow(hashed, "key string, sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults put in by a hash of ``conv_id:turn``: rows dropped, emptied, without ``.!?``, repeated or said by the user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    rows = turns.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"), (kind == 3).alias("again"))
    return rows.withColumn("copy", F.explode(F.when(F.col("again"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("again", "copy")


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    repair = repair_conversations(damaged(turns), turns)
    hashes = text_hashes(repair.turns)
    told = repair.summary.join(hashes, "key", "left")
    return told.select(
        F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def _repair_sql() -> str:
    """Every state's cheapest edits and repaired text as whole strings, by a reduction over each conversation's rows by itself.

    ``l`` has, for nothing, a system, a user and an assistant turn as the last one, the least struct of cost, edits and text.
    """

    def add(state: str, cost: str, edit: str, said: str) -> str:
        return f"{{'c': {state}.c + {cost}, 'e': {state}.e || {edit}, 't': {state}.t || chr(10) || {said}}}"

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    def kept(initial: str, role: str | None) -> tuple[str, str, str]:
        fault = "CASE r.f WHEN '' THEN 0 WHEN 'truncated' THEN 5 ELSE 1000000 END"
        other = 1 if role else 1000000
        edit, name = (f"CASE WHEN r.i = '{initial}' THEN {k} ELSE {o} END" for k, o in (("'K'", "'R'"), ("r.role", f"'{role}'")))
        return f"CASE WHEN r.i = '{initial}' THEN 0 ELSE {other} END + {fault}", edit, f"{name} || ':' || r.text"

    def gone(state: str) -> str:
        return f"{{'c': {state}.c + 2, 'e': {state}.e || 'D', 't': {state}.t}}"

    user, answer = (("5", "'I'", f"'{role}:'") for role in ("user", "assistant"))
    insert_user = f"list_transform([{{'l': %s}}], lambda x: [x.l[1], x.l[2], {least('x.l[3]', *(add(f'x.l[{k}]', *user) for k in (1, 2, 4)))}, x.l[4]])[1]"
    insert_answer = f"list_transform([{{'l': {insert_user}}}], lambda y: [y.l[1], y.l[2], y.l[3], {least('y.l[4]', add('y.l[3]', *answer))}])[1]"
    row = ", ".join(
        [
            gone("a.l[1]"),
            least(gone("a.l[2]"), add("a.l[1]", *kept("s", None))),
            least(gone("a.l[3]"), *(add(f"a.l[{k}]", *kept("u", "user")) for k in (1, 2, 4))),
            least(gone("a.l[4]"), add("a.l[3]", *kept("a", "assistant"))),
        ]
    )
    none = "{'c': 0, 'e': '', 't': ''}, " + ", ".join(["{'c': 1000000, 'e': '', 't': ''}"] * 3)
    start = insert_answer % f"[{none}]"
    return f"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(
                   string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: CAST(ord(ch) AS BIGINT))),
               lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 1, 2, 3, 4, 5, 6, 7]),
                   lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 20 AS kind
    FROM conversations
), damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
    FROM said WHERE kind <> 0
), ordered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS place,
           right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last,
           CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS initial
    FROM damaged
), faults AS (
    SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
                   WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
           lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS pair
    FROM ordered
), gathered AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
           count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
           list({{'l': CASE WHEN false THEN [{none}] END, 'i': initial, 'f': fault, 'role': role, 'text': text}} ORDER BY place) AS turns
    FROM faults GROUP BY conv_id
), solved AS (
    SELECT conv_id, gaps, blank, duplicate, truncated, illegal, unnest(list_transform([list_reduce(
        list_prepend({{'l': {start}, 'i': '', 'f': '', 'role': '', 'text': ''}}, turns),
        lambda a, r: {{'l': {insert_answer % f'[{row}]'}, 'i': '', 'f': '', 'role': '', 'text': ''}}
    ).l], lambda l: list_min([l[1], l[4]]))) AS best FROM gathered
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.e, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN solved s ON o.conv_id IS NOT DISTINCT FROM s.conv_id"""


OP11_SQL = _repair_sql()
