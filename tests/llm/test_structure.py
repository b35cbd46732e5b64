"""Repair of conversations, differencing packing and the prefix trie against brute force, with every awkward case."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from equiscreen.llm import differencing_packing, prefix_trie, sql, turn_repair

P = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, node string, part int, copies string"
BLANK = " \t\n\v\f\r"
INTO = {0: 2, 1: 2, 2: 3, 3: 2}
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, "y") for r in rows], TURNS)


@pytest.fixture(scope="module")
def talks():
    """(conv_id, turn, role, text) with nulls, blanks, ties, repeated rows, copies of conversations, a long one and a very long text."""
    r = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "us"]
    texts = ["Yes.", "No", " ", "", None, "Is it? ", "Well!\n", "a.b", "Ünï.", "x" * 30_000, "tail \x1c", "end.\t"]
    rows = [(c, t, r.choice(roles[:3]), r.choice(texts[:3]) + str(r.randint(0, 3)) + r.choice([".", "", "?"])) for c in range(40) for t in range(r.randint(1, 9))]
    rows += [(c, r.choice([None, 1, 2, 5, 5, 9]), r.choice(roles), r.choice(texts)) for c in range(40, 70) for _ in range(r.randint(1, 12))]
    rows += [(None, t, "user", "Hm.") for t in range(3)] + [(71, 1, "user", "Same.")] * 9 + [(72, None, None, None)]
    for c in range(80, 120):  # many conversations that begin alike, some of them equal
        rows += [(c, t, ("user", "assistant")[t % 2], f"Common {t}.") for t in range(c % 4 * 2)] + [(c, 20, "user", f"Own {c % 3}.")]
    return rows + [(130, t, ("user", "assistant", "tool")[t % 7 % 3], f"Turn {t % 50}." if t % 11 else "") for t in range(700)]


def repaired(rows):
    def spell(v):
        return " " if v is None else v

    talks = defaultdict(list)
    for c, t, role, text in rows:
        k, role, text = zlib.crc32(f"{spell(c)}:{spell(t)}".encode()) % 20, spell(role), spell(text)
        mine = talks[c]
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            mine += [(t, "user" if k == 4 else role, text)] * (1 + (k == 3))
    out = {}
    for c, mine in talks.items():
        mine.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), z[2].encode()))
        turns = [z[0] for z in mine if z[0] is not None]
        seen, faults = set(), []
        for _, role, text in mine:
            s = text.strip(BLANK)
            faults.append("b" if not s else "d" if (role, text) in seen else "" if s[-1] in ".!?" else "t")
            seen.add((role, text))
        first = [z[1][:1] for z in mine]
        best = {0: (0, "", ())}

        def inserted(best):
            for _ in range(4):
                for s, (cost, audit, text) in list(best.items()):
                    way = (cost + 3, audit + "I", (*text, ("user:", "assistant:")[INTO[s] - 2]))
                    best[INTO[s]] = min(best.get(INTO[s], way), way)
            return best

        best = inserted(best)
        for (_, role, text), fault in zip(mine, faults, strict=True):
            after = {}
            for s, (cost, audit, done) in best.items():
                ways = [(s, (cost + 4, audit + "D", done))]
                if fault not in ("b", "d"):
                    more = cost + 3 * (fault == "t")
                    ways.append((INTO[s], (more + 3, audit + "R", (*done, ("user:", "assistant:")[INTO[s] - 2] + text))))
                    if (s, role[:1]) in KEPT:
                        ways.append((KEPT[s, role[:1]], (more, audit + "K", (*done, role + ":" + text))))
                for z, way in ways:
                    after[z] = min(after.get(z, way), way)
            best = inserted(after)
        cost, audit, text = min(best[s] for s in (0, 3) if s in best)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
        out[c] = (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest())
    return out


def trie(rows):
    talks = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            talks[c].append(((t is not None, t or 0, role.encode(), hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()), role, text))
    for mine in talks.values():
        mine.sort()
    built = {}
    for c, mine in talks.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(z[1:] for z in talks.get(c - c % 5, [])[:h] + mine[h:])
    nodes, kids, leaves, saved = defaultdict(list), defaultdict(list), {}, {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    out = []
    for p, members in sorted(nodes.items(), key=lambda z: -len(z[0])):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members) - 1) * (len(p[-1][1].encode()) if p else 0)
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda z: z[:2])


@pytest.mark.parametrize("rows, size", [(1024, 1 << 20), (3, 1 << 20), (1024, 40)])
def test_repair(spark, talks, rows, size):
    found = turn_repair.repair(turn_repair.damage(frame(spark, talks)), rows, size).collect()
    assert {r[0]: tuple(r)[1:] for r in found} == repaired(talks) and len(found) == len({r[0] for r in talks})
    assert turn_repair.report(frame(spark, talks[:0])).count() == 0


def test_tight_edits_from_checkpoints():
    """Blocks of rows with the costs behind them give the same edits as all rows at once."""
    r = random.Random(8)
    for _ in range(60):
        rows = [(i, f, r.randint(1, 3) if f in ("b", "d") else 1) for i, f in ((r.choice("suaxt"), r.choice(["", "", "t", "b", "d"])) for _ in range(r.randint(0, 30)))]
        whole, _ = turn_repair.tight(rows, turn_repair.END, turn_repair.START, True)
        at = r.randint(0, len(rows))
        w = turn_repair.ways(rows[at:])
        between = [min(w[4 * a + z] + turn_repair.END[z] for z in range(4)) for a in range(4)]
        head, state = turn_repair.tight(rows[:at], between, turn_repair.START, False)
        tail, _ = turn_repair.tight(rows[at:], turn_repair.END, state, True)
        assert head + tail == whole


@pytest.mark.parametrize("group", [4096, 6, 1])
def test_trie(spark, talks, group):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows, convs = prefix_trie.rebuilt(prefix_trie.turns(frame(spark, talks)))
    found = prefix_trie.trie(prefix_trie.chains(rows, convs), group).select(*names).collect()
    assert sorted(map(tuple, found), key=lambda z: z[:2]) == trie(talks)


def test_trie_of_nothing(spark, talks):
    assert prefix_trie.report(frame(spark, talks[:0])).count() == 0


def test_sql(spark):
    con = duckdb.connect()
    p = f"{DATA}/conversations.parquet"
    con.execute(f"create view conversations as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    rows = con.execute("select conv_id, turn, role, text from conversations").fetchall()
    assert {r[0]: r[1:] for r in con.execute(sql.OP11).fetchall()} == repaired(rows)
    assert sorted(con.execute(sql.OP13).fetchall(), key=lambda z: z[:2]) == trie(rows)


def test_windows(spark):
    from tokenizers import Tokenizer

    r = random.Random(4)
    words = ["".join(r.choice("abcdeéñß") for _ in range(r.randint(1, 9))) for _ in range(400)]
    texts = [None, "", " ", "It's 42, isn't it?! İstanbul ΣΑΣ", "<|endoftext|> a", "x\x00y", "漢字 word", "don't" * 50] + [" ".join(r.choice(words) + r.choice(["", "", ".", ","]) for _ in range(r.choice([3, 40, 900, 9000]))) for _ in range(150)]
    rows = [(None if i == 60 else i, t, i, "s") for i, t in enumerate(texts)] + [(70, texts[70], 0, "s")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long, ids string")
    path = P.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    ids = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    for group in (1024, 20):
        found = differencing_packing.pack(differencing_packing.pieces(docs, path), group=group).collect()
        by_doc, by_seq = defaultdict(list), defaultdict(list)
        for p in found:
            by_doc[p["doc_id"]].append(p)
            by_seq[p["sequence_id"]].append(p)
        assert set(by_doc) == {d for d, *_ in rows}
        for d, ps in by_doc.items():
            i = 60 if d is None else d
            starts = Counter(p["start"] for p in ps)
            assert set(starts.values()) <= ({3, 2, 1} if d == 70 else {1})
            for p in ps:
                assert p["doc_tokens"] == len(ids[i]) and 0 < p["length"]
                part = b"".join(x.to_bytes(4, "little") for x in ids[i][p["start"] : p["start"] + p["length"]])
                assert zlib.crc32(part) == p["ids_crc32"] and len(part) == 4 * p["length"]
            covered = Counter(k for p in ps for k in range(p["start"], p["start"] + p["length"]))
            assert covered == Counter({k: 3 if d == 70 else 1 for k in range(len(ids[i]))})
        full = 0
        for ps in by_seq.values():
            at = 0
            for p in sorted(ps, key=lambda p: p["offset"]):
                assert p["offset"] == at
                at += p["length"]
            assert at <= 4096
            full += at == 4096
        if group == 1024:
            assert full >= 0.9 * len(by_seq)
    assert differencing_packing.pack(differencing_packing.pieces(docs.limit(0), path)).count() == 0


def test_differencing_is_near_equal_and_whole():
    r = random.Random(6)
    for n, k in ((1, 1), (5, 8), (60, 7), (400, 30)):
        lengths = [r.randint(1, 4095) for _ in range(n)]
        made = differencing_packing.differencing(lengths, k)
        assert sorted(i for w in made for i in w) == list(range(n)) and len(made) <= k
        sums = [sum(lengths[i] for i in w) for w in made]
        if n >= 10 * k:
            assert max(sums) - min(sums) < 0.02 * max(sums)
    assert sorted(sum((8, 7, 6, 5, 4)[i] for i in w) for w in differencing_packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]  # the textbook's case
    for n in (0, 3, 300):
        lengths = [r.randint(1, 4095) for _ in range(n)]
        made = differencing_packing.windows(lengths)
        assert sorted(i for w in made for i in w) == list(range(n)) and all(sum(lengths[i] for i in w) <= 4096 for w in made)
