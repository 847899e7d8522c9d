"""Conversation repair against an exhaustive plain version, with conversations cut into pieces of a few rows."""

import hashlib
import re
from functools import cache
from zlib import crc32

import numpy as np
import pytest

from sparkloom.llm import conversations, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
BODY = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        s = lambda x: " " if x is None else str(x)
        kind = crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        role, text = s(role), s(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain(rows):
    """Of one conversation's rows after damage: what the query returns, by trying all edits with a memory of (row, state)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults, seen = [], set()
    for _, _, role, text in rows:
        last = BODY.findall(text)
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @cache
    def best(k, state, inserted):
        """(cost, edits, lines) from row k on; at most four inserts in a row are tried."""
        found = [] if k < len(rows) or state in "su" and state else [(0, "", ())]
        if inserted < 4:
            for role in ("user", "assistant"):
                if (to := step.get((state, role[0]))) is not None:
                    c, e, lines = best(k, to, inserted + 1)
                    found.append((c + 2, "I" + e, (f"{role}:", *lines)))
        if k < len(rows):
            role, text = rows[k][2:]
            c, e, lines = best(k + 1, state, 0)
            found.append((c + 3, "D" + e, lines))
            if faults[k] not in ("blank", "duplicate"):
                more = faults[k] == "truncated"
                for name, new, cost in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if (to := step.get((state, new[:1]))) is not None:
                        c, e, lines = best(k + 1, to, 0)
                        found.append((c + cost + more, name + e, (f"{new}:{text}", *lines)))
        return min(found, key=lambda x: (x[0], x[1]), default=(10**9, "~", ()))

    cost, audit, lines = best(0, "", 0)
    turns = [r[1] for r in rows if r[1] is not None]
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def compare(spark, rows):
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.audit(spark.createDataFrame(rows, SCHEMA)).collect()}
    after, want = damaged(rows), {}
    for conv in {r[0] for r in rows}:
        want[conv] = plain([r for r in after if r[0] == conv])
    assert got == want
    return got


def invented(seed, n):
    rng = np.random.default_rng(seed)
    texts = ["Fine.", "Fine.", "Cut", "So be it!", " ", "", "why?\n", None, "The same long text " * 6 + "a.", "The same long text " * 6 + "b"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    rows = []
    for conv in range(n):
        for turn in range(int(rng.integers(1, 14))):
            rows.append((conv, turn if rng.random() < 0.9 else None, roles[rng.integers(len(roles))], texts[rng.integers(len(texts))]))
    return rows


def test_against_trying_all_edits(spark):
    got = compare(spark, invented(1, 150))
    assert {"D", "I", "K", "R"} <= set("".join(r[6] for r in got.values()))


@pytest.mark.parametrize("bits", [1, 3])
def test_conversations_that_cross_pieces(spark, monkeypatch, bits):
    monkeypatch.setattr(conversations, "PIECE_BITS", bits)
    rows = invented(2, 12) + [(None, k, r, f"text {k}.") for k, r in enumerate(["user", "assistant", "assistant", "user", "user"] * 12)]
    compare(spark, rows + [(77, k, "assistant", "again.") for k in range(40)])


def test_nulls_empty_tables_and_conversations_without_rows(spark):
    gone = next(c for c in range(1000) if crc32(f"{c}:0".encode()) % 20 == 0)
    got = compare(spark, [(gone, 0, "user", "Hello."), (None, None, None, None), (gone + 1, None, None, None)])
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.audit(empty).collect() == [] and conversations.repaired(empty).collect() == []


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Are you there?"), (1, 3, "user", "Hi."), (1, 4, "assistant", "x" * 3_000_000), (2, 0, "assistant", "Yes.")]
    got = conversations.repaired(spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA + ", place string")).orderBy("conv_id", "place").collect()
    assert [(r["conv_id"], r["role"], r["text"][:20]) for r in got] == [(1, "system", "Be kind."), (1, "user", "Hi."), (1, "assistant", ""), (1, "user", "Are you there?"), (1, "assistant", "x" * 20), (2, "user", ""), (2, "assistant", "Yes.")]


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    by_conv = {}
    for r in damaged(rows):
        by_conv.setdefault(r[0], []).append(r)
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, SF).collect()}
    assert got == {c: plain(by_conv.get(c, [])) for c in {r[0] for r in rows}} and len(got) == 20
