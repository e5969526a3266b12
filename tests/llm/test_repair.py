"""Conversation repair against plain searches over all edits."""

import hashlib
import itertools
import re
import sys
import zlib
from functools import lru_cache

import pytest
import xxhash

from slopeline.llm import catalog, repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, audit string, signature string, side int"
WHITE = " \t\n\x0b\x0c\r"
GRAMMAR = re.compile("(s?(ua)+)?")


def tie(role, text):
    signed = lambda h: h - (h >> 63 << 64)
    one = xxhash.xxh64_intdigest(text, seed=xxhash.xxh64_intdigest(role, seed=42))
    return signed(one)


def ordered(rows):
    return sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1], r[2])))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best(initials, found):
    """Least (cost, audit) and the repaired roles, over whole strings, by recursion over prefixes of the roles."""
    n = len(initials)

    @lru_cache(None)
    def go(i, state, run):
        # state: what the grammar has seen last ('' nothing); run: insertions in a row, of which two are enough
        options = []
        if i == n and state in ("", "a"):
            options.append((0, "", ()))
        fit = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}

        def then(cost, letter, nxt, j, edit, r=0):
            rest = go(j, nxt, r)
            if rest is not None:
                options.append((rest[0] + cost, letter + rest[1], (edit, *rest[2])))
        if run < 2:
            then(5, "I", fit, i, ("I", name[fit]), run + 1)
        if i < n:
            then(2, "D", state, i + 1, ("D", None))
            if found[i] not in ("blank", "duplicate"):
                late = 5 if found[i] == "truncated" else 0
                if initials[i] == fit or (state == "" and initials[i] == "s"):
                    then(late, "K", initials[i], i + 1, ("K", None))
                then(1 + late, "R", fit, i + 1, ("R", name[fit]))
        return min(options) if options else None
    sys.setrecursionlimit(10_000)
    return go(0, "", 0)


def plain(conversations, ids=()):
    out = {}
    for conv in {*conversations, *ids}:
        rows = ordered(conversations.get(conv, []))
        found = faults(rows)
        initials = [r[:1] for _, r, _ in rows]
        turns = [t for t, _, _ in rows if t is not None]
        cost, audit, edits = best(tuple(initials), tuple(found))
        left, lines = list(rows), []
        for edit, role in edits:
            if edit == "I":
                lines.append(f"{role}:")
                continue
            _, old, text = left.pop(0)
            if edit != "D":
                lines.append(f"{role or old}:{text}")
        kept = "".join(x[:1] for x in lines)
        assert GRAMMAR.fullmatch(kept) and not left
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(k) for k in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def report(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def table(spark, conversations):
    rows = [(c, t, r, x, "q", "z", 7) for c, turns in conversations.items() for t, r, x in turns]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


CONVERSATIONS = {
    1: [(0, "user", "Hi."), (1, "assistant", "Yes!")], 2: [(0, "system", "Be."), (3, "user", "a?"), (4, "user", "a?"), (7, "assistant", "cut")],
    3: [(0, "assistant", ""), (1, "assistant", " \t\n"), (2, "user", "why?")], 4: [(None, None, None), (None, "user", "x."), (5, "user", "x."), (5, "user", "x.")],
    5: [(2, "tool", "t."), (2, "unit", "u."), (2, "a", "v."), (9, "", "w.")], 6: [(1, "system", "only.")],
    7: [(i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(230)], 8: [(4, "user", "same.")] * 90,
    9: [(i, "user", "the same words.") for i in range(60)], 10: [(1, "assistant", "…"), (2, "assistant", "no ")],
    None: [(0, "user", "none."), (1, "assistant", "id.")], 11: [(0, "user", "x" * 300_000 + "."), (1, "assistant", "y.\x1c")],
}


def test_reports_against_a_plain_search(llm_spark):
    df = table(llm_spark, CONVERSATIONS)
    assert report(repair.repair_report(df)) == plain(CONVERSATIONS)


def test_every_short_signature_against_all_edits():
    """Costs and audits of all signatures of up to four letters, in sorted order and in any other."""
    words = ["".join(w) for n in range(5) for w in itertools.product("uasoUAO-", repeat=n)]
    kinds = {"-": "blank", **dict.fromkeys(repair.TRUNCATED, "truncated")}
    want = {w: best(tuple(c.lower() for c in w), tuple(kinds.get(c, "") for c in w))[:2] for w in words}
    shared, alone = repair.Automaton(), repair.Automaton()
    for w in sorted(words, key=lambda w: w[::-1]):
        assert shared.read(w[::-1]) == want[w]
    for w in words[::7]:
        assert alone.read(w[::-1]) == want[w]
    # every suffix is a node once
    assert shared.made == len({w[i:] for w in words for i in range(len(w) + 1)})


def test_repaired_rows_name_their_edits(llm_spark):
    rows = {2: [(0, "system", "Be."), (3, "user", "a?"), (4, "user", "a?"), (7, "user", "so."), (8, "tool", "gone")], 3: [(0, "user", "b?")]}
    df = table(llm_spark, rows)
    assert {r.conv_id: r.audit for r in repair.diagnose(df).collect()} == {2: "KKDRD", 3: "D"}
    # an audit of one's own, with insertions, which no cheapest audit of a whole row needs
    verdicts = llm_spark.createDataFrame([(2, "DKDRD"), (3, "KI")], "conv_id bigint, audit string")
    found = repair.repaired(df, verdicts).orderBy("conv_id", "place").collect()
    assert [(r.conv_id, r.place, r.edit, r.role, r.text) for r in found] == [
        (2, 0, "Keep", "user", "a?"), (2, 1, "Rerole", "assistant", "so."), (3, 0, "Keep", "user", "b?"), (3, 1, "Insert", "assistant", "")]


def test_long_conversations_lie_in_several_pieces(llm_spark, monkeypatch):
    monkeypatch.setattr(repair, "PIECE", 50)
    some = {k: CONVERSATIONS[k] for k in (4, 7, 8, 9)}
    assert report(repair.repair_report(table(llm_spark, some))) == plain(some)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_brute_force(llm_spark, folder):
    rows, ids = {}, set()
    for r in llm_spark.read.parquet(f"{folder}/conversations.parquet").collect():
        ids.add(r.conv_id)
        fate = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", r.text) if fate == 2 else r.text
        row = (r.turn, "user" if fate == 4 else r.role, text)
        rows.setdefault(r.conv_id, []).extend([row] * (0 if fate == 0 else 2 if fate == 3 else 1))
    df = catalog.op12_repair(llm_spark, folder)
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert report(df) == plain(rows, ids)


def test_damage_of_nulls(llm_spark):
    rows = [(c, t, None, None) for c in (None, 3) for t in [None, *range(40)]]
    df = llm_spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    want = []
    for c, t, *_ in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want += [(c, t, "user" if fate == 4 else " ", "" if fate == 1 else " ")] * (0 if fate == 0 else 2 if fate == 3 else 1)
    assert sorted(map(repr, map(tuple, repair.damaged(df).collect()))) == sorted(map(repr, want))


def test_empty_tables(llm_spark):
    none = llm_spark.createDataFrame([], SCHEMA)
    assert repair.repair_report(none).count() == 0
    ids = llm_spark.createDataFrame([(5,)], "conv_id bigint")
    row = repair.repair_report(none, ids).collect()
    assert [tuple(r) for r in row] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
