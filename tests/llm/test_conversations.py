"""Chat formatting and the conversation trie against plain versions and their SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from agewise.llm import chat, prefix_trie, queries

TURN = "conv_id long, turn long, role string, text string"
LOG = "conv_id long, seq long, kind string, message long, role string, text string"
PARTS = ["<", ">", "|", "\\", "im_start", "<|im_start|>", "<|im_sep|>", "<|im_end|>", "[INST]", "[/INST]", "</s>", "<s>", "<<SYS>>", "<</SYS>>", "\n", "é", "🙂", "[", "/", "s>", "ok "]


def folded(events):
    """Conversations as a plain loop over each log leaves them: {conv_id: [(role, text)]}."""
    logs = defaultdict(set)
    for conv, *rest in events:
        logs[conv].add(tuple(rest))
    out = {}
    for conv, log in logs.items():
        now, roles = {}, {}
        for _, kind, message, role, text in sorted(log, key=lambda e: (e[0], e[4] or "")):
            if kind in ("start", "edit", "regenerate"):
                if role is not None:
                    roles[message] = role
                now[message] = text or ""
                if kind != "start":
                    now = {m: t for m, t in now.items() if m <= message}
            elif kind == "delta" and message in now:
                now[message] += text or ""
        out[conv] = [(roles.get(m, ""), now[m]) for m in sorted(now)]
    return out


def told(spark, log):
    found = chat.format_chats(log).select("conv_id", "formatted", "turns", chat.read_turns(F.col("formatted")).alias("read"), chat.read_loss(F.col("formatted"), F.col("turns")).alias("loss"))
    return {r["conv_id"]: r for r in found.collect()}


def test_fold_equals_a_plain_loop(spark):
    rng = random.Random(1)
    events = []
    for conv in range(60):
        begun = set()
        for seq in range(rng.randrange(1, 40)):
            kind = rng.choice(["start", "delta", "delta", "delta", "edit", "regenerate", "typing"])
            message = rng.randrange(6)
            if kind == "delta" and message not in begun:  # deltas without a beginning, or of what was taken back, are told apart below
                kind = "start"
            begun.add(message)
            role = rng.choice([None, "user", "assistant"]) if kind != "delta" else None
            events.append((conv, seq, kind, message, role, rng.choice([None, "", *PARTS])))
    events += rng.sample(events, 50)  # delivered twice
    # what is taken back takes no deltas: the plain loop drops it, and it returns only by a new beginning
    got = told(spark, spark.createDataFrame(events, LOG).repartition(5))
    want = folded(events)
    assert set(got) == set(want)
    for conv, r in got.items():
        assert [tuple(t) for t in r["read"]] == want[conv]
        assert r["loss"] == [t for role, t in want[conv] if role == "assistant"]
        for (role, text), turn in zip(want[conv], r["turns"], strict=True):
            inner = r["formatted"][turn["start"] : turn["end"]]
            assert turn["loss"] == (role == "assistant") and not any(c in inner for c in chat.CONTROLS)
            assert r["formatted"][turn["at"] :].startswith(chat.START)


def test_escapes_are_reversible(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(12))) for _ in range(2000)] + ["\\" * k + c for k in range(5) for c in chat.CONTROLS]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    for r in rows:
        assert r["u"] == r["t"] and not any(c in r["e"] for c in chat.CONTROLS)


def test_odd_logs(spark):
    rows = [(None, None, "start", None, None, None), (1, 1, "delta", 0, "user", "lost"), (2, 1, "start", 0, "user", "x"), (2, 1, "start", 0, "user", "x"), (3, 1, None, 0, "user", "x")]
    log = spark.createDataFrame([(*r, "own", "own") for r in rows], LOG + ", formatted string, turns string")
    got = told(spark, log)
    assert {k: [tuple(t) for t in r["read"]] for k, r in got.items()} == {None: [("", "")], 1: [], 2: [("user", "x")], 3: []}
    assert got[1]["formatted"] == "" and told(spark, spark.createDataFrame([], LOG)) == {}
    long = "a<|im_end|>\\ é" * 200_000
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", long)], TURN)
    assert told(spark, chat.log_of_turns(turns))[1]["loss"] == [long]
    with pytest.raises(ValueError):
        chat.fold_events(spark.range(1))


def tables():
    rng = random.Random(3)
    texts = ["", None, "a", "a  b", "a\tb\nc", "[INST] x </s>", "\\ <|im_end|>", "é 漢 字", "word " * 50]
    rows = []
    for conv in [c for c in range(130) if c not in (20, 40)] + [1_000_003]:
        for turn in range(rng.choice([1, 1, 2, 3, 5, 8, 9, 13])):
            rows.append((conv, turn if rng.random() < 0.97 else None, rng.choice(["user", "assistant", "assistant", "system", None]), rng.choice(texts[:3] if turn < 3 else texts)))
    rows += [(60 + k, t, "user", "same") for k in range(10) for t in range(20, 26)]
    rows += [(7, 3, "user", "tied"), (7, 3, "user", "tied"), (7, 3, "assistant", "tied"), (8, 0, "user", "x")]
    rng.shuffle(rows)
    return rows


def trie(rows, grafted):
    """Nodes by a plain dictionary of prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
        own[conv].append((turn is not None, turn or 0, role, digest, text))
    own = {c: [(role, text) for _, _, role, _, text in sorted(ts)] for c, ts in own.items()}
    built = dict(own)
    if grafted:
        for c in own:
            h = zlib.crc32(str(c).encode()) % 4
            built[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    below = lambda p: [q for q in members if q[: len(p)] == p]
    children = lambda p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p]
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(built[c]) == len(p)))
        yield (
            min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children(p)), sum(not children(q) for q in below(p)),
            sum((len(members[q]) - 1) * len(q[-1][1].encode().split()) for q in below(p) if q), hashlib.sha256(ends.encode()).hexdigest(),
        )


def key(row):
    return tuple(str(v) for v in row)


@pytest.mark.parametrize("grafted", [False, True])
def test_trie_equals_a_plain_one(spark, grafted):
    rows = tables()
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    extra = spark.createDataFrame([(*r, 1, "k") for r in rows], TURN + ", depth int, key string")
    got = prefix_trie.prefix_trie(extra, grafted=grafted).select(columns).collect()
    assert sorted(map(key, got)) == sorted(map(key, trie(rows, grafted)))


def test_trie_of_deep_and_alike_conversations(spark):
    chain = [(c, t, "user", f"t{t}") for c in range(12) for t in range(3 * c)]  # each goes on where the last ends
    forks = [(100 + c, t, "user", f"t{t}" if t < 40 - c else f"own {c}") for c in range(15) for t in range(40)]
    copies = [(c, 0, "user", "same") for c in range(5000, 15000)]
    rows = chain + forks + copies
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURN)).collect()
    want = {key(r) for r in trie(rows, False)}
    assert {key(r) for r in got} == want and len(got) == len(want)


def test_blocks_apart_only_where_siblings_are(spark):
    rows = [(c, t, "user", f"t{t}" if t < 9 or c == 0 else "other") for c in (0, 1) for t in range(12)]
    digests = prefix_trie.turn_digests(spark.createDataFrame(rows, TURN))
    blocks = prefix_trie.conversation_blocks(digests, digests.select("conv_id").distinct())
    alone = {(r["depth"], r["alone"]) for r in prefix_trie._steps(blocks).collect()}
    assert alone == {(d, True) for d in range(9)} | {(d, False) for d in range(9, 13)}


def test_odd_conversations(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURN)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 0, "user", "x")], TURN)).count() == 0
    one = prefix_trie.prefix_trie(spark.createDataFrame([(5, None, None, None)], TURN)).orderBy("depth").collect()
    assert [(r["depth"], r["n_children"], r["saved_tokens"]) for r in one] == [(0, 1, 0), (1, 0, 0)]


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_chat"])
@pytest.mark.parametrize("rows", [tables(), []])
def test_queries_equal_their_sql(spark, tmp_path, name, rows):
    names = ("conv_id", "turn", "role", "text")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    table = pa.table({n: pa.array([r[k] for r in rows], kinds[k]) for k, n in enumerate(names)})
    pq.write_table(table, tmp_path / "conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    got = queries.queries()[name](spark, str(tmp_path))
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(key, got.select(names).collect())) == sorted(map(key, want.fetchall()))
